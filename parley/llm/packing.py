"""Filling containers of fixed capacity by minimum bin slack.

Only the number of items of each length matters to the packing, and there are at most `capacity` lengths; so the
packing runs on that histogram, in the driver, whatever the number of items. For each container the largest item left
is taken, and a bitset subset-sum over the lengths left finds the fullest combination with it. The combination is
removed as often as the counts allow. Each combination brings the count of one of its lengths L below what it needs of
it, at most capacity / L, so there are at most sum(capacity / L), some capacity * ln(capacity), combinations.

Items are then numbered within their length, in two levels (hash bucket, and offset of the bucket) so that no length is
ever ordered in one task, and look up their container in the list of combinations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.sources.tables import cut

#: Items of one length that are numbered in one bucket, on average.
BUCKET = 20_000


def fullest(largest: int, counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill a container best together with one item of length `largest`, the longest left."""
    room = capacity - largest
    used = {largest: 1}
    if room <= 0:
        return used
    mask, goal, reach, steps = (1 << (room + 1)) - 1, 1 << room, 1, []
    for length in sorted(counts, reverse=True):
        have = min(counts[length] - (length == largest), room // length)
        power = 1
        while have > 0 and not reach & goal:
            take = min(power, have)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            have -= take
            power *= 2
        if reach & goal:
            break
    left = reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> left & 1:
            used[length] = used.get(length, 0) + take
            left -= length * take
    return used


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """(first container, number of containers, lengths) until every item is placed. Lengths are in 1..capacity."""
    counts = {k: v for k, v in counts.items() if v}
    out, at = [], 0
    while counts:
        used = fullest(max(counts), counts, capacity)
        times = min(counts[k] // n for k, n in used.items())
        out.append((at, times, used))
        at += times
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


def pack(items: DataFrame, *, key: str, size: str, capacity: int) -> DataFrame:
    """`key`, piece_no, start, n, container_id: where each item, or piece of an item over the capacity, goes.

    An item over the capacity is split into full pieces and a rest; no other is split. Items of size 0 or null take no
    room: they have one row with n 0 and null container_id. Containers are numbered from 0. Repeated rows are items of
    their own. An empty table gives no row.
    """
    c = F.lit(capacity).cast("bigint")
    n = F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.call_function("div", n - 1, c)))
    pieces = cut(
        items.select(F.col(key), n.alias("_n"), F.explode(numbers).alias("piece_no")).select(
            key, F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * c).alias("start"), F.least(c, F.col("_n") - F.col("piece_no") * c).cast("int").alias("n")
        )
    )
    histogram = {r["n"]: r["count"] for r in pieces.where("n > 0").groupBy("n").count().collect()}  # at most `capacity` rows
    starts: dict[int, list] = {}
    seen: dict[int, int] = {}
    for first, times, used in combinations(histogram, capacity):
        for length, k in used.items():
            starts.setdefault(length, []).append((seen.get(length, 0), k, first))
            seen[length] = seen.get(length, 0) + k * times
    plan = items.sparkSession.sparkContext.broadcast({k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in starts.items()})

    # As many buckets for a length as its items need; a length takes one entry, at most `capacity` in all.
    many = {k: -(-v // BUCKET) for k, v in histogram.items() if v > BUCKET}
    width = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("n")), F.lit(1)) if many else F.lit(1)
    b = F.pmod(F.xxhash64(key, "piece_no"), width).cast("int")
    bucketed = pieces.where("n > 0").withColumn("b", b)
    local = bucketed.withColumn("i", F.row_number().over(Window.partitionBy("n", "b").orderBy(key, "piece_no")) - 1)
    sums = bucketed.groupBy("n", "b").count().withColumn("before", F.sum("count").over(Window.partitionBy("n").orderBy("b")) - F.col("count")).select("n", "b", "before")
    ranked = local.join(sums, ["n", "b"]).select(key, "piece_no", "start", "n", (F.col("before") + F.col("i")).alias("rank"))
    kind = items.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            out = np.empty(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, k, container = plan.value[int(length[own[0]])]
                i = np.searchsorted(first, rank[own], side="right") - 1
                out[own] = container[i] + (rank[own] - first[i]) // k[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(out)], names=[key, "piece_no", "start", "n", "container_id"])

    placed = ranked.mapInArrow(place, f"`{key}` {kind}, piece_no int, start bigint, n int, container_id bigint")
    return placed.unionByName(pieces.where("n <= 0").select(key, "piece_no", "start", F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("container_id")))
