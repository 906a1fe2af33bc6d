"""Consensus of several annotators' labels, assisted by features of the items.

Expectation-maximisation over confusion matrices of the annotators and a regularised multinomial classifier on item
features, whose output is each item's prior. An iteration is one pass over the items: workers compute posteriors under
the parameters sent to them and return sums (confusion counts, the classifier's gradient), which are added up by a
shuffle of a few rows a partition. The classifier takes one step of the fixed-bound Newton method an iteration, which
never lowers its likelihood and needs the features' second moments only once.

The fit starts from one of at most START items, the least by hash, iterated in the driver until it stands still; passes
over all items then go on until the likelihood of all stands still. Where it doesn't, an error says so.

Items hold one label an annotator at most, so an item's row is bounded by the number of annotators, and so are the
parameters (9 doubles each); MOST bounds that number.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.sources.tables import cut

CLASSES = 3
#: Buckets of hashed words among the features.
HASHED = 48
#: Annotators at most: their parameters, 7 MB, are sent to every worker. More raise an error.
MOST = 100_000
#: Items that the fit starts from, relative gain at which it stands still, and passes after which it is an error.
START, TOLERANCE, PASSES = 5_000, 1e-5, 1_000
#: Strength of the classifier's L2 penalty, and pseudo-counts of a confusion matrix off and on its diagonal.
RIDGE, OFF, ON = 2.0, 0.3, 1.0
_WORD = re.compile(r"\w+")


@dataclass
class Fit:
    """What was learned: confusion[annotator, true, given], classifier weights, class shares."""

    annotators: list[str]
    confusion: np.ndarray
    weights: np.ndarray
    shares: np.ndarray


def annotator_key(name: Column) -> Column:
    """The annotator's id: lower case, without outer spaces, `_` for `-`; null where nothing is left."""
    k = F.lower(F.trim(F.translate(name, "-", "_")))
    return F.when(k != "", k)


def features(numbers: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Constant, each number scaled with its square and a flag where missing, length and hashed words of the text."""
    n = len(texts)
    miss = np.isnan(numbers)
    z = np.where(miss, 0.0, numbers / 50.0 - 1.0)
    words = np.zeros((n, HASHED))
    length = np.zeros((n, 2))
    for i, t in enumerate(texts):
        w = _WORD.findall((t or "").lower())
        length[i] = (np.log1p(len(w)) / 4.0, float(not w))
        for x in set(w):
            if not x[0].isdigit():
                words[i, zlib.crc32(x.encode()) % HASHED] = 0.5
    return np.concatenate((np.ones((n, 1)), z, z * z, miss.astype(float), length, words), axis=1)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of each vote, its annotator and label; the feature matrix."""
    votes = b.column("votes")
    lengths = np.diff(votes.offsets.to_numpy())
    inner = votes.flatten()
    row = np.repeat(np.arange(len(votes)), lengths)
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(votes), -1) if len(votes) else np.zeros((0, 1))
    return row, inner.field("a").to_numpy(zero_copy_only=False), inner.field("l").to_numpy(zero_copy_only=False), x


def _posterior(row: np.ndarray, a: np.ndarray, lab: np.ndarray, x: np.ndarray, weights: np.ndarray, log_confusion: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each item, the classifier's prior, and the log-likelihood."""
    eta = x @ weights
    eta -= eta.max(axis=1, keepdims=True)
    prior = np.exp(eta)
    prior /= prior.sum(axis=1, keepdims=True)
    log = np.log(prior)
    np.add.at(log, row, log_confusion[a, :, lab])
    top = log.max(axis=1, keepdims=True)
    post = np.exp(log - top)
    norm = post.sum(axis=1, keepdims=True)
    return post / norm, prior, float((top + np.log(norm)).sum())


def _sums(kind: int, value: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(value)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array(at.astype(np.int64)), pa.array(value[at].astype(float))], names=["kind", "i", "v"])


def _added(df: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    out = [np.zeros(s) for s in sizes]
    t = df.groupBy("kind", "i").agg(F.sum("v").alias("v")).toArrow()
    kind, i, v = (t.column(c).to_numpy() for c in ("kind", "i", "v"))
    for k in range(len(sizes)):
        out[k][i[kind == k]] = v[kind == k]
    return out


def informedness(c: np.ndarray) -> float:
    """Mean over pairs of classes of how far the labels given to one differ from those given to the other, 0 to 1."""
    apart = [np.abs(c[i] - c[k]).sum() / 2 for i in range(len(c)) for k in range(i)]
    return float(np.mean(apart))


def votes_of(rows: DataFrame, *, item: str, annotator: str, label: str, written: str, numbers: list[str], text: str) -> DataFrame:
    """item, annotator, label (the last valid one of each annotator), and the item's features' sources."""
    a = annotator_key(F.col(annotator))
    valid = rows.where(F.col(item).isNotNull() & F.col(label).between(0, CLASSES - 1)).select(
        F.col(item).alias("item"), a.alias("a"), F.col(written).alias("w"), F.col(label).cast("int").alias("l"), F.struct(*[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(numbers)], F.col(text).alias("t")).alias("f")
    )
    return valid.where("a is not null").groupBy("item", "a").agg(F.max(F.struct("w", "l", "f")).alias("m")).select("item", "a", F.col("m.l").alias("l"), F.col("m.f").alias("f"))


def _items(votes: DataFrame, names: list[str], numbers: int) -> DataFrame:
    """item, votes (annotator's index, label), x (features); kept in the shared folder."""
    index = votes.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "a string, k int")
    rows = votes.join(F.broadcast(index), "a").groupBy("item").agg(F.sort_array(F.collect_list(F.struct(F.col("k").alias("a"), "l"))).alias("votes"), F.max("f").alias("f"))
    kind = votes.schema["item"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column("f")
            x = np.stack([f.field(f"n{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(numbers)], axis=1) if numbers else np.zeros((b.num_rows, 0))
            m = features(x, f.field("t").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("votes"), pa.array(list(m), pa.list_(pa.float64()))], names=["item", "votes", "x"])

    return cut(rows.mapInArrow(build, f"item {kind}, votes array<struct<a:int,l:int>>, x array<double>"))


def _start(batches: Iterator[pa.RecordBatch], j: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Confusion counts and gradient from the majority's labels, and second moments of the features."""
    k = CLASSES
    conf, grad, gram = np.zeros((j, k, k)), np.zeros((d, k)), np.zeros((d, d))
    for b in batches:
        row, a, lab, x = _flat(b)
        t = np.full((b.num_rows, k), 1e-9)
        np.add.at(t, (row, lab), 1.0)
        t /= t.sum(axis=1, keepdims=True)
        np.add.at(conf.transpose(0, 2, 1), (a, lab), t[row])
        grad += x.T @ (t - 1 / k)
        gram += x.T @ x
    return conf, grad, gram


def _pass(batches: Iterator[pa.RecordBatch], weights: np.ndarray, log_confusion: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Confusion counts, gradient and log-likelihood under the parameters."""
    conf, grad, ll = np.zeros_like(log_confusion), np.zeros_like(weights), np.zeros(1)
    for b in batches:
        row, a, lab, x = _flat(b)
        t, prior, gained = _posterior(row, a, lab, x, weights, log_confusion)
        np.add.at(conf.transpose(0, 2, 1), (a, lab), t[row])
        grad += x.T @ (t - prior)
        ll += gained
    return conf, grad, ll


def _confusion(conf: np.ndarray) -> np.ndarray:
    c = conf + OFF + (ON - OFF) * np.eye(CLASSES)
    return c / c.sum(axis=2, keepdims=True)


def _iterate(conf: np.ndarray, grad: np.ndarray, gram: np.ndarray, weights: np.ndarray, run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Confusion, weights and confusion counts where the likelihood stands still; `run` is a pass over the items."""
    # A bound on the curvature of the multinomial likelihood: half the second moments, for every class.
    solve = np.linalg.inv(0.5 * gram + RIDGE * np.eye(len(gram)))
    last = -np.inf
    for _ in range(PASSES):
        confusion = _confusion(conf)
        weights = weights + solve @ (grad - RIDGE * weights)
        conf, grad, ll = run(weights, np.log(confusion))
        if ll[0] - last < TOLERANCE * abs(ll[0]):
            return confusion, weights, conf
        last = ll[0]
    raise RuntimeError(f"no consensus after {PASSES} passes")


def fit(items: DataFrame, names: list[str]) -> Fit:
    """The parameters, by expectation-maximisation from the majority's labels."""
    sc = items.sparkSession.sparkContext
    j, k = len(names), CLASSES
    some = items.select("votes", "x").orderBy(F.xxhash64("item"), "item").limit(START).toArrow().to_batches()
    if not sum(b.num_rows for b in some):
        return Fit(names, np.full((j, k, k), 1 / k), np.zeros((1, k)), np.full(k, 1 / k))
    d = next(len(b.column("x")[0]) for b in some if b.num_rows)
    conf, grad, gram = _start(some, j, d)
    confusion, weights, conf = _iterate(conf, grad, gram, np.zeros((d, k)), lambda w, lc: _pass(some, w, lc))
    schema = "kind int, i bigint, v double"
    votes = items.select("votes", "x")

    def everywhere(w: np.ndarray, lc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sent = sc.broadcast((w, lc))
        sums = _added(votes.mapInArrow(lambda bs: (_sums(i, x.ravel()) for i, x in enumerate(_pass(bs, *sent.value))), schema), [j * k * k, d * k, 1])
        sent.unpersist()
        return sums[0].reshape(j, k, k), sums[1].reshape(d, k), sums[2]

    gram = _added(votes.mapInArrow(lambda bs: iter([_sums(0, _start(bs, j, d)[2].ravel())]), schema), [d * d])[0].reshape(d, d)
    conf, grad, _ = everywhere(weights, np.log(confusion))
    confusion, weights, conf = _iterate(conf, grad, gram, weights, everywhere)
    return Fit(names, confusion, weights, conf.sum(axis=(0, 2)) / max(conf.sum(), 1e-9))


def consensus(rows: DataFrame, *, item: str, annotator: str, label: str, written: str, numbers: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: the items (item, label, confidence, n_votes, agreement) and the annotators.

    Labels outside 0..2, null labels and null annotators don't count; of several labels of one annotator for an item
    the one with the latest `written` does (of equally late ones the greatest). agreement is the share of pairs of
    annotators who gave the item the same label, null with one annotator. The annotators' table has annotator, n_labels,
    reliability (chance that a label given is the true one, over the classes' shares) and informedness (how far the
    labels tell the classes apart: 0 for one who says the same always, 1 for one never wrong). An empty table gives two
    empty ones.
    """
    votes = cut(votes_of(rows, item=item, annotator=annotator, label=label, written=written, numbers=numbers, text=text))
    counted = {r["a"]: r["n"] for r in votes.groupBy("a").agg(F.count(F.lit(1)).alias("n")).limit(MOST + 1).collect()}
    if len(counted) > MOST:
        raise ValueError(f"more than {MOST} annotators")
    names = sorted(counted)
    items = _items(votes, names, len(numbers))
    got = fit(items, names)
    sent = rows.sparkSession.sparkContext.broadcast((got.weights, np.log(got.confusion)))
    kind = rows.schema[item].dataType.simpleString()

    def label_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, lc = sent.value
        for b in batches:
            row, a, lab, x = _flat(b)
            t, _, _ = _posterior(row, a, lab, x, w, lc)
            counts = np.zeros((b.num_rows, CLASSES))
            np.add.at(counts, (row, lab), 1)
            n = counts.sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                agree = (counts * (counts - 1)).sum(axis=1) / (n * (n - 1))
            best = t.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("item"), pa.array(best.astype(np.int32)), pa.array(t[np.arange(len(best)), best]), pa.array(n.astype(np.int32)), pa.array(agree, from_pandas=True)],
                names=[item, "label", "confidence", "n_votes", "agreement"],
            )

    labelled = items.mapInArrow(label_items, f"`{item}` {kind}, label int, confidence double, n_votes int, agreement double")
    table = []
    for i, name in enumerate(names):
        c = got.confusion[i]
        table.append((name, counted[name], float((got.shares * c.diagonal()).sum()), informedness(c)))
    return labelled, rows.sparkSession.createDataFrame(table, "annotator string, n_labels bigint, reliability double, informedness double")
