"""Claims and calls held against the evidence of the days after them, without a row for each pair.

Evidence and claims are put in order by bucket of days, shard and entity and taken into Arrow batches. There evidence
lies in order of group, class and day, so that a claim's window is a range of it: what only needs numbers of items
follows from running sums, and likeness only arises where a word is shared. A value, and a claim's words with its
direction, are held once against the evidence that any claim with them meets; each claim's window is a running sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.claims import signs, words_of

#: Days of a bucket, and days after a call that the longest window lasts.
SPAN, AFTER = 182, 365
#: Items of evidence of one entity that a shard holds, rows that are worked on together, and pairs or hits held at once.
HELD, ROWS, CHUNK = 200_000, 100_000, 1_000_000
#: Classes of evidence: filings with and without numbers, others with the long and the short window, and of no source.
WITH_NUMBERS, WITHOUT, OTHER, NEWS, UNKNOWN = range(5)
#: Sums of support and contradiction are whole numbers of such parts, but for likeness itself, which is summed in whole
#: numbers of far smaller ones: sums are exact in any order.
UNIT, FINE = 20, 1 << 40
_IDF = (1 + np.log(1.5)) ** 2


def _met(calls: DataFrame, evidence: DataFrame, *, key: str) -> DataFrame:
    """Both in one frame (side 0 evidence, 1 calls), in order by `at`: bucket, shard and ticker.

    Calls have `key`, ticker and call_day, evidence evidence_id, ticker and published. Evidence is in one bucket and
    shard, calls in all that their window touches; those without ticker or day are in a group of their own.
    """
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    bucket = lambda n: F.floor(n / SPAN).cast("int")
    at = F.concat_ws("|", F.col("_bucket").cast("string"), F.col("_shard").cast("string"), F.col("ticker"))
    # At most one row for HELD rows of evidence.
    large = F.broadcast(evidence.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HELD).select("ticker", F.ceil(F.col("_n") / HELD).cast("int").alias("_shards")))
    shards = F.coalesce("_shards", F.lit(1))
    es = evidence.where("ticker IS NOT NULL AND published IS NOT NULL").join(large, "ticker", "left").withColumn("_shard", F.pmod(F.xxhash64("evidence_id"), shards)).withColumn("_bucket", bucket(number(F.col("published"))))
    es = es.select(at.alias("at"), F.lit(0).alias("side"), number(F.col("published")).alias("day"), *[c for c in evidence.columns if c not in ("ticker", "published")])
    day = number(F.col("call_day"))
    cs = calls.join(large, "ticker", "left").withColumn("_shard", F.explode(F.sequence(F.lit(0), shards - 1))).select("*", F.explode_outer(F.sequence(bucket(day + 1), bucket(day + AFTER))).alias("_bucket"))
    alone = F.col("ticker").isNull() | F.col("_bucket").isNull()
    cs = cs.select(F.when(alone, F.concat_ws("|", F.lit("-"), F.col(key))).otherwise(at).alias("at"), F.lit(1).alias("side"), F.coalesce(day, F.lit(0)).alias("day"), *calls.columns)
    both = es.unionByName(cs, allowMissingColumns=True)
    return both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at").sortWithinPartitions("at", "side")


def _groups(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.Table], most: int) -> Iterator[pa.RecordBatch]:
    """`work` on tables of whole groups; of a group with many calls a part of them at a time, with all its evidence."""
    parts, rows, kept = [], 0, 0
    for b in batches:
        parts.append(b)
        rows += b.num_rows
        if rows < most + kept:
            continue
        t = pa.Table.from_batches(parts)
        start = pc.index(t["at"], t["at"][-1]).as_py()
        if start:
            yield from work(t.slice(0, start)).to_batches()
            t = t.slice(start)
        if pc.sum(t["side"]).as_py() >= most // 2:
            yield from work(t).to_batches()
            t = t.filter(pc.equal(t["side"], 0))
        t = t.combine_chunks()
        parts, rows, kept = t.to_batches(), t.num_rows, t.num_rows
    if rows:
        yield from work(pa.Table.from_batches(parts)).to_batches()


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one range after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _chunks(cost: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows whose costs add up to about `most`, a row with more alone."""
    part = np.cumsum(cost) // most
    ends = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(cost)]])
    for a, b in zip(ends[:-1], ends[1:]):
        if b > a:
            yield slice(a, b)


def _array(t: pa.Table, column: str) -> pa.Array:
    c = t[column].combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _numpy(t: pa.Table, column: str, empty) -> np.ndarray:
    return pc.fill_null(_array(t, column), empty).to_numpy(zero_copy_only=False)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of all lists, and where each list's begin, with the end."""
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))])


def _weights(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, word and 1 + ln(count) of the words of each list in order of rows, and the words that the numbers stand for."""
    flat, off = _flat(lists)
    coded = flat.dictionary_encode()
    size = max(1, len(coded.dictionary))
    key, n = np.unique(np.repeat(np.arange(len(lists)), np.diff(off)) * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    return key // size, key % size, 1 + np.log(n), coded.dictionary


class _Sides:
    """A table of groups: evidence in order of group, class and day, calls as they come."""

    def __init__(self, t: pa.Table, classes: Callable[[pa.Table], np.ndarray]) -> None:
        side, group = _array(t, "side").to_numpy(), _array(t, "at").dictionary_encode().indices.to_numpy().astype(np.int64)
        evidence, calls = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        e = t.take(pa.array(evidence))
        kinds, days = classes(e), _array(e, "day").to_numpy().astype(np.int64)
        order = np.lexsort((days, kinds, group[evidence]))
        self.evidence, self.kinds, self.calls = e.take(pa.array(order)), kinds[order], t.take(pa.array(calls))
        self._at = self._place(group[evidence][order], self.kinds, days[order])
        self.group, self._day = group[calls], _array(self.calls, "day").to_numpy().astype(np.int64)

    @staticmethod
    def _place(group: np.ndarray, kind, day: np.ndarray) -> np.ndarray:
        return ((group * 8 + kind) << 24) + day + (1 << 23)

    def window(self, kind: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        """The range of evidence of a class from the day after each call to `after` days after it."""
        return np.searchsorted(self._at, self._place(self.group, kind, self._day + 1)), np.searchsorted(self._at, self._place(self.group, kind, self._day + after), "right")


class _Questions:
    """Rows that ask the same, told by `code`: each row's question, and each question's first row."""

    def __init__(self, code: np.ndarray) -> None:
        _, self.first, self.of = np.unique(code, return_index=True, return_inverse=True)
        self._rows = np.argsort(self.of, kind="stable")
        self._starts = np.searchsorted(self.of[self._rows], np.arange(len(self.first) + 1))

    def span(self, lo: np.ndarray, hi: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range that holds those of all rows of each question that are `asked`, (0, 0) without any."""
        if not len(self.first):
            return self.first, self.first
        least = np.minimum.reduceat(np.where(asked, lo, np.iinfo(np.int64).max)[self._rows], self._starts[:-1])
        most = np.maximum.reduceat(np.where(asked, hi, 0)[self._rows], self._starts[:-1])
        return np.where(most > least, least, 0), np.where(most > least, most, 0)

    def rows(self, first: int, last: int) -> np.ndarray:
        """The rows of the questions from the first to the last."""
        return self._rows[self._starts[first] : self._starts[last + 1]]


def _total(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])


def _near(numbers: np.ndarray, off: np.ndarray, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item of evidence in the ranges of each value: whether its nearest number agrees, whether in part."""
    counts = hi - lo
    starts, n = off[lo], off[hi] - off[lo]
    v = np.repeat(value, n)
    with np.errstate(all="ignore"):
        apart = np.abs(numbers[_spans(starts, n)] - v) / np.abs(v)
    item = _spans(lo, counts)
    nearest = np.fmin.reduceat(apart, np.repeat(np.cumsum(n) - n - starts, counts) + off[item])
    agree = nearest <= 0.10
    return agree, ~agree & (nearest <= 0.25)


def _rate(t: pa.Table, reasons: bool, chunk: int) -> pa.Table:
    """Each claim's items of evidence and sums over them, of one group."""
    def classes(e: pa.Table) -> np.ndarray:
        filing, n = _numpy(e, "filing", -1), np.diff(_flat(_array(e, "numbers"))[1])
        return np.where(filing < 0, UNKNOWN, np.where(filing == 1, np.where(n > 0, WITH_NUMBERS, WITHOUT), np.where(_array(e, "lasts").to_numpy() == AFTER, OTHER, NEWS)))

    s = _Sides(t, classes)
    ev, cl, m, k = s.evidence, s.calls, len(s.kinds), len(s.calls)
    ranges = {c: s.window(c, 180 if c == NEWS else AFTER) for c in range(5)}
    n = sum(hi - lo for lo, hi in ranges.values())
    sup, con, weight, like = (np.zeros(k, np.int64) for _ in range(4))
    way, value = _array(cl, "way").to_numpy(), _numpy(cl, "value", np.nan)
    valued = pc.is_valid(_array(cl, "value")).to_numpy(zero_copy_only=False)
    for c in (WITH_NUMBERS, WITHOUT):
        weight += UNIT * (ranges[c][1] - ranges[c][0])

    # Numbers of filings.
    flat, off = _flat(_array(ev, "numbers"))
    numbers = flat.to_numpy(zero_copy_only=False)
    lo, hi = ranges[WITH_NUMBERS]
    nought = valued & (value == 0)
    con += np.where(nought, UNIT * (hi - lo), 0)
    held = np.flatnonzero(valued & ~nought & (hi > lo))
    values, code = np.unique(value[held], return_inverse=True)
    same = _Questions(s.group[held] * max(1, len(values)) + code)
    begin, end = same.span(lo[held], hi[held], np.full(len(held), True))
    for part in _chunks(off[end] - off[begin], chunk):
        found = [_total(x) for x in _near(numbers, off, value[held[same.first[part]]], begin[part], end[part])]
        width = end[part] - begin[part]
        rows = same.rows(part.start, part.stop - 1)
        i = held[rows]
        place = (np.cumsum(width) - width - begin[part])[same.of[rows] - part.start]
        a, p = (x[place + hi[i]] - x[place + lo[i]] for x in found)
        sup[i] += 20 * a + 10 * p
        con[i] += 6 * p + 20 * (hi[i] - lo[i] - a - p)

    # Direction of filings that aren't told by numbers: running sums.
    pos, neg = _numpy(ev, "pos", False), _numpy(ev, "neg", False)
    rises, falls, still = _total(pos & ~neg), _total(neg & ~pos), _total(~pos & ~neg)
    for c in (WITH_NUMBERS, WITHOUT):
        lo, hi = ranges[c]
        up, down, flat_ = (x[hi] - x[lo] for x in (rises, falls, still))
        there = (way != 0) if c == WITHOUT else (way != 0) & ~valued
        for w, yes, no in ((1, up, down), (-1, down, up), (2, flat_, 0 * up)):
            told = there & (way == w)
            sup += np.where(told, 20 * yes + 8 * (hi - lo - yes - no), 0)
            con += np.where(told, 20 * no, 0)

    # Likeness of words.
    row, word, have, vocabulary = _weights(_array(ev, "words"))
    norm = np.bincount(row, have * have, m)
    posting = np.argsort(word * m + row, kind="stable")
    places, wr = (word * m + row)[posting], have[posting]
    item = row[posting]
    texts = pc.binary_join(_array(cl, "words"), " ").dictionary_encode()
    same = _Questions((s.group * max(1, len(texts.dictionary)) + texts.indices.to_numpy()) * 4 + way + 1)
    asks, ways = len(same.first), way[same.first]
    crow, cword, wl, said = _weights(_array(cl, "words").take(pa.array(same.first)))
    cnorm = np.bincount(crow, wl * wl, asks)
    known = pc.fill_null(pc.index_in(said, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[cword] if len(said) else cword
    crow, known, wl = crow[known >= 0], known[known >= 0], wl[known >= 0]
    units = _array(ev, "weight").to_numpy().astype(np.int64)
    points = np.where(pos & ~neg, 1, np.where(neg & ~pos, -1, np.where(~pos & ~neg, 2, 0)))
    for c in (WITH_NUMBERS, WITHOUT, OTHER, NEWS):
        lo, hi = ranges[c]
        asked = hi > lo
        if c in (WITH_NUMBERS, WITHOUT):
            asked = asked & (way == 0) & (~valued if c == WITH_NUMBERS else True)
        start, stop = same.span(lo, hi, asked)
        sel = np.flatnonzero((stop > start)[crow])
        i = crow[sel]
        begin, end = np.searchsorted(places, known[sel] * m + start[i]), np.searchsorted(places, known[sel] * m + stop[i])
        hits = np.bincount(i, end - begin, asks).astype(np.int64)
        questions = np.flatnonzero(hits > 0)
        for part in _chunks((hits + stop - start)[questions], chunk):
            own = questions[part]
            width = stop[own] - start[own]
            base = np.cumsum(width) - width
            x = slice(np.searchsorted(i, own[0]), np.searchsorted(i, own[-1], "right"))
            h = (end - begin)[x]
            p = _spans(begin[x], h)
            offset = np.zeros(asks, np.int64)
            offset[own] = base - start[own]
            at, l, r = np.repeat(offset[i[x]], h) + item[p], np.repeat(wl[sel[x]], h), wr[p]
            size = int(width.sum())
            dot, ls, rs = (np.bincount(at, y, size) for y in (l * r, l * l, r * r))
            met = np.flatnonzero(dot)
            q = np.searchsorted(base, met, "right") - 1
            j = met - base[q] + start[own[q]]
            q = own[q]
            alike = dot[met] / (np.sqrt(_IDF * cnorm[q] + (1 - _IDF) * ls[met]) * np.sqrt(_IDF * norm[j] + (1 - _IDF) * rs[met]))
            few = alike >= (0.30 if c in (WITH_NUMBERS, WITHOUT) else 0.20)
            q, j, alike = q[few], j[few], alike[few]
            rows = same.rows(own[0], own[-1])
            rows = rows[asked[rows]]
            key = q * m + j
            first, last = np.searchsorted(key, same.of[rows] * m + lo[rows]), np.searchsorted(key, same.of[rows] * m + hi[rows])
            within = lambda y: (t := _total(y))[last] - t[first]
            if c in (WITH_NUMBERS, WITHOUT):
                like[rows] += within(np.rint(alike * FINE))
                continue
            w, z = ways[q], points[j]
            told = np.where(w == 2, np.where(z == 2, 1.0, 0.5), np.where((z == 2) | (z == 0), 0.5, np.where(w == z, 1.0, 0.0)))
            news = np.where(w != 0, (alike + told) / 2, alike)
            half = (news >= 0.25) & (news < 0.50)
            like[rows] += within(np.rint(np.where(news >= 0.50, news * (units[j] / UNIT), 0.0) * FINE))
            sup[rows] += within(np.where(half, 8 * units[j] // UNIT, 0))
            con[rows] += within(np.where(half, 4 * units[j] // UNIT, 0))
            weight[rows] += within(units[j])

    out = {"claim_id": cl["claim_id"], "ticker": cl["ticker"], "call_day": cl["call_day"], "n": pa.array(n.astype(np.int64)), "sup": pa.array(sup), "con": pa.array(con), "weight": pa.array(weight), "alike": pa.array(like / FINE)}
    if reasons:
        out["parts"] = _parts(ev, valued, value, numbers, off, *ranges[WITH_NUMBERS])
    return pa.table(out)


def _parts(ev: pa.Table, valued: np.ndarray, value: np.ndarray, numbers: np.ndarray, off: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """Of each claim with a value the first three filings with numbers by id, and what their numbers say."""
    ids = _array(ev, "evidence_id")
    order = pc.sort_indices(ids).to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    seen: dict[tuple[int, int], np.ndarray] = {}
    counts, items = np.zeros(len(lo), np.int64), []
    for i in np.flatnonzero(valued & (hi > lo)):
        key = (lo[i], hi[i])
        if key not in seen:
            seen[key] = order[_least(rank[key[0] : key[1]], 3)]
        counts[i] = len(seen[key])
        items.append(seen[key])
    j = np.concatenate(items) if items else np.zeros(0, np.int64)
    v = np.repeat(value, counts)
    says = np.full(len(j), "numbers disagree", object)
    told = np.flatnonzero(v != 0)
    if len(told):
        agree, partly = _near(numbers, off, v[told], j[told], j[told] + 1)
        says[told[agree]], says[told[partly]] = "numbers agree", "numbers agree in part"
    rows = pa.StructArray.from_arrays([ids.take(pa.array(j)), pa.array(says, pa.string())], names=["evidence_id", "said"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), rows)


def _least(ranks: np.ndarray, most: int) -> np.ndarray:
    return np.sort(np.partition(ranks, most - 1)[:most] if len(ranks) > most else ranks)


def rated(claims: DataFrame, evidence: DataFrame, *, reasons: bool = False) -> DataFrame:
    """claim_id, ticker, call_day, n_evidence, support and contradiction of every claim against the evidence after its call.

    `claims` has claim_id, ticker, call_day, claim_text, value and direction, `evidence` evidence_id, ticker, published,
    lasts (days of its window after a call: 365 or 180), source_type, authority_score and said. What `verify` sums pair by
    pair, with `reasons` also parts: the first three filings by id whose numbers were compared. Sums are exact, whatever
    the order, and divided once: a ratio of 0.2 is 0.2 over any number of items.
    """
    way = F.when(F.col("direction").isin("increase", "grow"), 1).when(F.col("direction") == "decrease", -1).when(F.col("direction") == "flat", 2).otherwise(0)
    filing = F.col("source_type") == "sec"
    weight = F.when(filing, 20).when(F.col("authority_score") >= 0.70, 15).when(F.col("authority_score") >= 0.45, 10).otherwise(5)
    cs = claims.select("claim_id", "ticker", "call_day", F.col("claim_text").alias("told"), F.col("value").cast("double").alias("value"), way.alias("way"))
    es = evidence.select("evidence_id", "ticker", "published", "lasts", filing.cast("int").alias("filing"), weight.alias("weight"), F.col("said").alias("told"))
    met = _met(cs, es, key="claim_id")
    # Words and signs are worked out behind the shuffle, which moves the texts alone. Only filings are told by numbers.
    of_evidence = lambda c: F.when(F.col("side") == 0, c)
    numbers, pos, neg = signs(F.coalesce("told", F.lit("")))
    met = met.select(*[c for c in met.columns if c != "told"], words_of(F.coalesce("told", F.lit(""))).alias("words"), F.when((F.col("side") == 0) & (F.col("filing") == 1), numbers).alias("numbers"), of_evidence(pos).alias("pos"), of_evidence(neg).alias("neg"))
    schema = "claim_id string, ticker string, call_day date, n bigint, sup bigint, con bigint, weight bigint, alike double" + ", parts array<struct<evidence_id: string, said: string>>" * reasons
    rows, chunk = ROWS, CHUNK
    sums = met.mapInArrow(lambda bs: _groups(bs, lambda t: _rate(t, reasons, chunk), rows), schema)
    sums = sums.groupBy("claim_id", "ticker", "call_day").agg(*[F.sum(c).alias(c) for c in ("n", "sup", "con", "weight", "alike")], *([F.flatten(F.collect_list("parts")).alias("parts")] if reasons else []))
    rate = lambda c: F.coalesce(F.try_divide(c, F.col("weight")), F.lit(0.0))
    out = sums.select("claim_id", "ticker", "call_day", F.col("n").alias("n_evidence"), rate(F.col("sup") + UNIT * F.col("alike")).alias("support"), rate(F.col("con")).alias("contradiction"), *(["parts"] if reasons else []))
    return out.withColumn("parts", F.slice(F.array_sort("parts"), 1, 3)) if reasons else out


def _foremost(t: pa.Table, most: int) -> pa.Table:
    """Of each call the number of items, and the first by authority and id, of one group."""
    s = _Sides(t, lambda e: (_array(e, "lasts").to_numpy() != AFTER).astype(np.int64))
    ids, authority = _array(s.evidence, "evidence_id"), _array(s.evidence, "authority_score")
    by_id = np.empty(len(ids), np.int64)
    by_id[pc.sort_indices(ids).to_numpy().astype(np.int64)] = np.arange(len(ids))
    known = pc.is_valid(authority).to_numpy(zero_copy_only=False)
    a = pc.fill_null(authority, 0.0).to_numpy(zero_copy_only=False)
    # Least first: no number (the greatest of all for Spark), then from the greatest down, null at the end.
    down = np.where(known, np.where(np.isnan(a), -np.inf, -a), np.inf)
    order = np.lexsort((by_id, down))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    (lo, hi), (lo2, hi2) = s.window(0, AFTER), s.window(1, 180)
    n = hi - lo + hi2 - lo2
    there = np.flatnonzero(n)
    best = [order[_least(np.concatenate([rank[lo[i] : hi[i]], rank[lo2[i] : hi2[i]]]), most)] for i in there]
    j = np.concatenate(best) if best else np.zeros(0, np.int64)
    rows = pa.StructArray.from_arrays([pa.array(down[j]), ids.take(pa.array(j)), authority.take(pa.array(j))], names=["down", "evidence_id", "authority_score"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in best], dtype=np.int64)]), pa.int32()), rows)
    calls = s.calls.take(pa.array(there))
    return pa.table({"ticker": calls["ticker"], "call_day": calls["call_day"], "n": pa.array(n[there].astype(np.int64)), "best": lists})


def foremost(calls: DataFrame, evidence: DataFrame, *, most: int) -> DataFrame:
    """ticker, call_day, n, best: of each ticker and day of calls the evidence after it, counted, and the first `most` of it.

    best lists evidence_id and authority_score by falling authority, nulls last, then id. `evidence` has evidence_id, ticker,
    published, lasts and authority_score. Days without evidence have no row.
    """
    one = calls.select("ticker", "call_day").where("ticker IS NOT NULL AND call_day IS NOT NULL").distinct()
    met = _met(one, evidence.select("evidence_id", "ticker", "published", "lasts", F.col("authority_score").cast("double").alias("authority_score")), key="ticker")
    rows = ROWS
    made = met.mapInArrow(lambda bs: _groups(bs, lambda t: _foremost(t, most), rows), "ticker string, call_day date, n bigint, best array<struct<down: double, evidence_id: string, authority_score: double>>")
    merged = made.groupBy("ticker", "call_day").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("best")).alias("best"))
    return merged.withColumn("best", F.slice(F.array_sort("best"), 1, most))
