"""Lines repeated across one site's documents, by suffix arrays over line identifiers.

A site's documents are put into shards of bounded size by a hash of the document. A worker concatenates the line
identifiers of a shard's documents, with a separator of its own after each document, and builds the suffix array; the
common prefixes of neighbouring suffixes give every block of lines, of one line or more and of any length, and the
number of the shard's documents that it lies in. A document lies in one shard, so these numbers add up to the exact
number of a site's documents that a line, the block of one, lies in; lines that reach the share are deleted, those of
longer blocks with them. The length of the longest such block that a line stands in is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a shard on average; a site of more lines has more shards. Only a document of more makes a larger one.
SHARD = 100_000


def line_key(line: Column) -> Column:
    """64 bits of the letters of a line without regard to case, null where it has none."""
    letters = F.lower(F.regexp_replace(line, r"[^\p{L}]", ""))
    return F.when(letters != "", F.xxhash64(letters))


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """The suffixes of `ids` in order, by prefix doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - k] = rank[k:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if n else np.zeros(0, dtype=np.int64)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        k *= 2
        if k >= n or not n or new[-1] == n - 1:
            return order


def repeated_blocks(ids: np.ndarray, doc: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, documents) of the blocks in at least `least` documents, by length; ids < 0 are separators.

    Blocks are the groups of suffixes with a common prefix, so at each length every block comes once. Separators are
    all different, so no block runs over the end of its document. Blocks of one line come whatever their documents.
    """
    order = suffix_array(ids)
    n, d = len(ids), 0
    same = np.ones(max(0, n - 1), dtype=bool)
    whole = np.ones(n, dtype=bool)
    while True:
        at = order + d
        inside = at < n
        here = np.where(inside, ids[np.minimum(at, n - 1)], -1) if n else ids
        whole &= inside & (here >= 0)
        if not whole.any():
            return
        same &= whole[:-1] & whole[1:] & (here[:-1] == here[1:])
        d += 1
        group = np.concatenate(([0], np.cumsum(~same)))
        g, dd, where = group[whole], doc[order[whole]], order[whole]
        in_docs = np.bincount(np.unique(np.stack((g, dd)), axis=1)[0], minlength=group[-1] + 1)
        first = np.full(len(in_docs), -1, dtype=np.int64)
        first[g[::-1]] = where[::-1]
        often = np.flatnonzero(in_docs >= (1 if d == 1 else least))
        yield d, first[often], in_docs[often]
        # A block of d + 1 lines starts with one of d.
        whole &= in_docs[group] >= least


def _blocks(share: float):
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("doc", "ascending"), ("seq", "ascending"), ("part", "ascending"), ("line_no", "ascending")])
        _, doc = np.unique(t.column("doc").to_numpy(), return_inverse=True)
        n_docs = t.column("shard_docs")[0].as_py() if len(t) else 0
        names, ids = np.unique(t.column("key").to_numpy(), return_inverse=True)
        # A separator of its own after each document keeps blocks within documents.
        ends = np.flatnonzero(np.diff(doc)) + 1
        line_at = np.arange(len(ids)) + np.searchsorted(ends, np.arange(len(ids)), side="right")
        all_ids = np.zeros(len(ids) + len(ends), dtype=np.int64)
        all_docs = np.zeros(len(all_ids), dtype=np.int64)
        all_ids[line_at], all_docs[line_at] = ids, doc
        gaps = ends + np.arange(len(ends))
        all_ids[gaps], all_docs[gaps] = -1 - np.arange(len(ends)), -1
        docs, block = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int32)
        for length, at, in_docs in repeated_blocks(all_ids, all_docs, max(1, int(np.ceil(share * n_docs - 1e-9)))):
            if length == 1:
                docs[all_ids[at]] = in_docs
            for k in range(length):
                block[all_ids[at + k]] = length
        site = t.column("site")[0].as_py() if len(t) else None
        return pa.table({"site": pa.array([site] * len(names), pa.string()), "key": pa.array(names, pa.int64()), "docs": pa.array(docs), "block": pa.array(block)})

    return run


def repeated_lines(texts: DataFrame, *, part: str, doc: str, site: str, text: str, order: str, share: float, least: int) -> DataFrame:
    """part, line_no (from 0), block: the lines that lie in at least `share` of their site's documents and in `least`.

    `texts` has the documents in parts. Lines end at a line feed and are the same if their letters are, apart from
    case; lines without a letter never count. Documents are all that have a part, even with null text. Repeated rows
    count once; null parts, documents or sites are left out; block is the length of the longest block the line was
    found in. Nothing is removed within a site of fewer than `least` documents.
    """
    rows = texts.where(F.col(part).isNotNull() & F.col(doc).isNotNull() & F.col(site).isNotNull()).select(
        F.col(part).alias("segment"), F.col(doc).alias("_doc"), F.col(site).cast("string").alias("site"), F.col(text).alias("_text"), F.col(order).cast("bigint").alias("seq")
    )
    docs = rows.select("site", F.xxhash64("_doc").alias("doc")).distinct()
    lines = rows.select("site", F.xxhash64("_doc").alias("doc"), "segment", "seq", F.posexplode(F.split("_text", "\n")).alias("line_no", "line"))
    lines = lines.select("site", "doc", "segment", "seq", "line_no", line_key(F.col("line")).alias("key")).where("key is not null")
    sizes = docs.groupBy("site").agg(F.count(F.lit(1)).alias("site_docs"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("site_lines") / F.lit(SHARD)))
    spread = lines.groupBy("site").agg(F.count(F.lit(1)).alias("site_lines")).select("site", shards.alias("shards"))
    shard = F.pmod(F.col("doc"), F.col("shards")).alias("shard")
    shard_sizes = docs.join(spread, "site").groupBy("site", shard).agg(F.count(F.lit(1)).cast("int").alias("shard_docs"))
    grouped = lines.join(spread, "site").select("site", "doc", F.xxhash64("segment").alias("part"), "seq", "line_no", "key", shard).join(shard_sizes, ["site", "shard"])
    blocks = grouped.groupBy("site", "shard").applyInArrow(_blocks(share), "site string, key bigint, docs bigint, block int")
    # Shards hold a site's documents apart, so their numbers of documents add up.
    counts = blocks.groupBy("site", "key").agg(F.sum("docs").alias("in_docs"), F.max("block").alias("block")).join(sizes, "site")
    excessive = counts.where((F.col("in_docs") >= least) & (F.col("in_docs") >= F.col("site_docs") * share - 1e-9)).select("site", "key", F.greatest("block", F.lit(1)).alias("block"))
    return lines.join(excessive, ["site", "key"]).select(F.col("segment").alias(part), "line_no", "block").distinct()


def without_lines(texts: DataFrame, lines: DataFrame, *, part: str, text: str) -> DataFrame:
    """`texts` with the lines of `repeated_lines` taken out of `text`; a text of which nothing is left becomes empty."""
    gone = lines.groupBy(F.col(part).alias("_part")).agg(F.collect_set("line_no").alias("_gone"))
    joined = texts.join(gone, texts[part] == F.col("_part"), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return joined.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)).drop("_part", "_gone")
