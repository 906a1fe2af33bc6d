"""Encoding of a whole corpus with a public byte-level BPE vocabulary by a global shuffle of distinct words.

Texts are split into pre-tokens on the JVM and exploded, one row for each distinct word of a text with its positions.
Each distinct word of the corpus is encoded once. Ids are joined back: those of the heavy hitters, of which there can be
at most 1 / HEAVY, by broadcast, all others, each under that share of the rows, by a shuffle on the word. Positions put
the ids of a text in order. Rows of a text share its key and 32 bits of its hash, which tell texts of one key apart.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.tables import cut, spread

#: Folder of the public vocabulary files; a parameter of each operator.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern of the vocabulary, with (?U) for Unicode white space on the JVM.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word is a heavy hitter from this share of all pre-tokens on.
HEAVY = 0.001


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder of a vocabulary file, once a worker."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def _file(folder: str | None, name: str) -> str:
    return os.path.join(folder or VOCABULARIES, name)


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            ids = enc.encode_ordinary_batch(b.column(0).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["w", "n", "ids"])

    return run


#: Tokens that are put in order at once; a batch is taken in slices of about so many.
SLICE = 1_000_000


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE tokens each, one row at least; `ends` are the numbers of tokens up to each row."""
    at, n = 0, len(ends)
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
        yield at, to
        at = to


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text and distinct word of it, with its positions; whole arrays at a time."""
    for whole in batches:
        for start, end in _slices(np.cumsum(np.diff(whole.column(2).offsets.to_numpy()))):
            b = whole.slice(start, end - start)
            lists = b.column(2)
            words = lists.flatten().dictionary_encode()
            lengths = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(lists)), lengths)
            place = (np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            # A word's number within its text: positions stay in order under a stable sort.
            code = row * max(1, len(words.dictionary)) + words.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            c = code[order]
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, dtype=np.int64)
            at = pa.ListArray.from_arrays(pa.array(np.append(first, len(c)).astype(np.int32)), pa.array(place[order]))
            of = pa.array(row[order][first])
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), words.dictionary.take(words.indices.take(pa.array(order[first]))), at], names=["k", "h", "w", "at"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each text by the positions of its words; a position that comes twice, of a repeated row, counts once."""
    for whole in batches:
        sizes = whole.column(1)
        of_words = np.append(0, np.cumsum(np.diff(pa.compute.struct_field(sizes.flatten(), "at").offsets.to_numpy())))
        bounds = sizes.offsets.to_numpy()
        for start, end in _slices(of_words[bounds[1:] - bounds[0]]):
            b = whole.slice(start, end - start)
            lists = b.column(1)
            inner = lists.flatten()
            at, ids = (pa.compute.struct_field(inner, n) for n in ("at", "ids"))
            word_row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            word = np.repeat(np.arange(len(word_row)), np.diff(at.offsets.to_numpy()))
            place, row = at.flatten().to_numpy().astype(np.int64), word_row[word]
            code = row * (int(place.max()) + 1 if len(place) else 1) + place
            order = np.argsort(code, kind="stable")
            c = code[order]
            once = order[np.concatenate(([True], c[1:] != c[:-1]))] if len(c) else order
            offsets = ids.offsets.to_numpy().astype(np.int64)
            starts, lengths = (offsets[:-1] - offsets[0])[word[once]], np.diff(offsets)[word[once]]
            total = int(lengths.sum())
            take = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
            ends = np.append(0, np.cumsum(np.bincount(row[once], weights=lengths, minlength=len(lists)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.flatten().to_numpy()[take], pa.int32()))], names=["k", "ids"])


def encode_corpus(docs: DataFrame, *, key: str, text: str, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """`key` and `ids` (array<int>), one row per distinct (key, text), without special tokens.

    Null and empty texts have the empty list. Strings of special tokens are ordinary text. Repeated rows come out
    once; other columns are ignored, whatever their names. A null key is a key like others.
    """
    path = _file(folder, vocabulary)
    pieces = F.regexp_extract_all(F.col(text), F.lit("(?U)" + PATTERN), F.lit(0))
    kind = docs.schema[key].dataType.simpleString()
    cut_up = spread(docs.select(key, text)).where(F.col(text) != "").select(F.col(key).alias("k"), F.hash(text).alias("h"), pieces.alias("w"))
    rows = cut_up.mapInArrow(_by_word, f"k {kind}, h int, w string, at array<int>")
    words = cut(rows.groupBy("w").agg(F.sum(F.size("at")).alias("n")).mapInArrow(_encode_words(path), "w string, n bigint, ids array<int>"))
    total = words.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") > total * HEAVY  # at most 1 / HEAVY words
    hot, rest = words.where(heavy).select("w", "ids"), words.where(~heavy).select("w", "ids")
    known = rows.join(F.broadcast(hot), "w").select("k", "h", "at", "ids").unionByName(
        rows.join(F.broadcast(hot.select("w")), "w", "left_anti").join(rest.hint("merge"), "w").select("k", "h", "at", "ids")
    )
    some = known.groupBy("k", "h").agg(F.collect_list(F.struct("at", "ids")).alias("q")).select("k", "q").mapInArrow(_in_order, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")
    none = docs.where(F.col(text).isNull() | (F.col(text) == "")).select(key, F.array().cast("array<int>").alias("ids")).distinct()
    return some.unionByName(none)


def token_bytes(spark: SparkSession, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, hex: the bytes of each token; as many rows as the vocabulary has."""
    return spark.createDataFrame([(i, b.hex()) for b, i in ranks(_file(folder, vocabulary)).items()], "id int, hex string")


def decode_corpus(encoded: DataFrame, *, key: str, ids: str = "ids", folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """`key` and `text`: the inverse, by a join with the token-byte table. Empty or null lists give the empty text.

    Keys must be unique. Ids outside the vocabulary add nothing.
    """
    table = token_bytes(encoded.sparkSession, folder, vocabulary)
    rows = encoded.select(F.col(key).alias("k"), F.posexplode_outer(ids).alias("pos", "id"))
    joined = rows.join(F.broadcast(table), "id", "left").groupBy("k").agg(F.array_sort(F.collect_list(F.when(F.col("hex").isNotNull(), F.struct("pos", "hex")))).alias("p"))
    return joined.select(F.col("k").alias(key), F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["hex"]), "")), "UTF-8").alias("text"))


def token_counts(docs: DataFrame, *, key: str, text: str, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """`key` and n_tokens of each row; null and empty texts have 0."""
    path = _file(folder, vocabulary)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
