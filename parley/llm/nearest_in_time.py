"""Pairs of records nearest in time for the same entity, by DuckDB's ASOF joins inside Arrow groups.

Both sides are cut into (entity, time bucket); a right row is also put into the neighbouring bucket if a left row there
could lie within the tolerance, so each left row meets every partner in its own bucket. The keys are hash-partitioned
and sorted, and a worker takes whole keys into an Arrow group until it holds GROUP_ROWS rows, then runs both ASOF joins
on the group. An entity with a third of all rows is spread over its buckets, and right rows of one instant are one row
before the shuffle, so a key holds at most as many right rows as its bucket has distinct instants.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an Arrow group; it is exceeded only by the rest of a key that began below it.
GROUP_ROWS = 200_000
#: A time bucket is so many tolerances long.
BUCKET = 7

ASOF = """
WITH r AS (SELECT entity, bucket, t, min(rid) AS rid FROM part WHERE side = 1 GROUP BY ALL),
l AS (SELECT entity, bucket, t, lid FROM part WHERE side = 0),
b AS (SELECT l.lid, l.t, r.t AS rt, r.rid FROM l ASOF JOIN r ON l.entity = r.entity AND l.bucket = r.bucket AND l.t >= r.t),
f AS (SELECT l.lid, l.t, r.t AS rt, r.rid FROM l ASOF JOIN r ON l.entity = r.entity AND l.bucket = r.bucket AND l.t <= r.t),
c AS (SELECT lid, abs(t - rt) AS apart, rt, rid FROM (SELECT * FROM b UNION ALL SELECT * FROM f) WHERE abs(t - rt) <= {tolerance})
SELECT lid, rid FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY apart, rt, rid) AS n FROM c) WHERE n = 1
"""


def _bucket(micros: Column, width: int) -> Column:
    return F.call_function("div", micros - F.pmod(micros, F.lit(width).cast("bigint")), F.lit(width).cast("bigint"))


def nearest_in_time(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, entity: str, at: str, tolerance: int) -> DataFrame:
    """left_id, right_id: for each left row the right row of its entity nearest in time, at most `tolerance` away.

    Times are bigint microseconds, the tolerance (inclusive) too. Of equally near rows the earlier wins, then the
    smaller id. left_id must be unique; rows with null id, entity or time have no pair, a right row may serve many.
    Columns besides those named are ignored, so clashing names don't matter. Empty sides give an empty result.
    """
    width = tolerance * BUCKET
    some = lambda df, key: df.where(F.col(key).isNotNull() & F.col(entity).isNotNull() & F.col(at).isNotNull())
    t = F.col(at).cast("bigint")
    ls = some(left, left_id).select(F.col(entity).cast("string").alias("entity"), _bucket(t, width).alias("bucket"), t.alias("t"), F.col(left_id).cast("string").alias("lid"))
    rs = some(right, right_id).select(
        F.col(entity).cast("string").alias("entity"), t.alias("t"), F.col(right_id).cast("string").alias("rid"),
        F.explode(F.array_distinct(F.array(_bucket(t - tolerance, width), _bucket(t, width), _bucket(t + tolerance, width)))).alias("bucket"),
    )
    # Only keys that hold a left row are worth sending; the semi-join's keys are the left side's, a fraction of it.
    rs = rs.join(ls.select("entity", "bucket").distinct(), ["entity", "bucket"], "left_semi").groupBy("entity", "bucket", "t").agg(F.min("rid").alias("rid"))
    none = F.lit(None).cast("string")
    both = ls.select("entity", "bucket", "t", F.lit(0).alias("side"), "lid", none.alias("rid")).unionByName(rs.select("entity", "bucket", "t", F.lit(1).alias("side"), none.alias("lid"), "rid"))
    parts = both.repartition("entity", "bucket").sortWithinPartitions("entity", "bucket")
    found = parts.mapInArrow(lambda batches: _groups(batches, tolerance), "lid string, rid string")
    return found.select(F.col("lid").cast(left.schema[left_id].dataType).alias(left_id), F.col("rid").cast(right.schema[right_id].dataType).alias(right_id))


def _groups(batches: Iterator[pa.RecordBatch], tolerance: int) -> Iterator[pa.RecordBatch]:
    """Gather whole keys, which come sorted, into Arrow groups and join each."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= GROUP_ROWS:
            # The key of the last row held may go on in this batch; it is closed at the first row of another key.
            e, k = held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()
            other = pc.invert(pc.and_(pc.equal(batch.column(0), e), pc.equal(batch.column(1), k)))
            at = pc.index(other, pa.scalar(True)).as_py()
            if at >= 0:
                yield from _asof(held + [batch.slice(0, at)], tolerance)
                held, rows, batch = [], 0, batch.slice(at)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield from _asof(held, tolerance)


def _asof(held: list[pa.RecordBatch], tolerance: int) -> Iterator[pa.RecordBatch]:
    import duckdb

    part = pa.Table.from_batches(held)  # noqa: F841 - DuckDB reads it by name
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    try:
        con.register("part", part)
        yield from con.sql(ASOF.format(tolerance=int(tolerance))).to_arrow_table().cast(pa.schema([("lid", pa.string()), ("rid", pa.string())])).to_batches()
    finally:
        con.close()
