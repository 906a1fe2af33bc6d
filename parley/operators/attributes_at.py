"""Attributes as known at event time: validity intervals in dyadic time nodes, matched by equi-join.

1. `validity` turns statements (known from `since`, with a precedence) into disjoint half-open intervals: a statement
   holds from the instant it is known until one of higher precedence is known. The running best is taken in two
   levels, within (entity, span of time) and over the spans of an entity, so no entity is ever sorted in one task.
2. `dyadic_cover` gives each interval the nodes of a binary tree over time cells that together cover it: at most two
   nodes a level below TOP and one for each top node, however long it is.
3. An event looks up the LEVELS nodes above its own cell by equi-join on (entity, level, node); the exact half-open
   test then leaves the one interval that holds at the event.

The join's keys are (entity, level, node): an entity with a third of all rows is spread over its time cells, and at no
level lies under one key for more than 2**TOP cells (171 days). What remains of skew AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One time cell, in microseconds: an hour.
CELL = 3_600_000_000
#: The highest level of the tree: nodes of 2**TOP cells.
TOP = 12
#: Cells are clamped to [0, LAST]; times outside still compare exactly. 1900 and 2200, in cells from ORIGIN.
ORIGIN = -2_208_988_800_000_000
LAST = 300 * 8766
#: Span of the first level of the running best, in microseconds: about a month.
SPAN = 720 * CELL
FOREVER = 1 << 62


def _div(x: Column, by: int) -> Column:
    """Floor of x / by for bigint, exact."""
    return F.call_function("div", x - F.pmod(x, F.lit(by).cast("bigint")), F.lit(by).cast("bigint"))


def cell(micros: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(LAST).cast("bigint"), _div(micros - F.lit(ORIGIN), CELL)))


def validity(statements: DataFrame, entity: str, since: str, order: list[str]) -> DataFrame:
    """entity, since, until (exclusive), and the columns of `order`: the intervals in which a statement is the best known.

    Best is the smallest tuple of `order`, which must be unique within an entity but for repeated rows. A statement
    that is no better than one already known has no interval. `until` of the last interval is FOREVER.
    """
    best = F.struct(*[F.col(c) for c in order])
    points = statements.where(F.col(entity).isNotNull() & F.col(since).isNotNull()).groupBy(F.col(entity).alias("e"), F.col(since).alias("s")).agg(F.min(best).alias("p"))
    points = points.withColumn("span", _div(F.col("s"), SPAN))
    in_span = Window.partitionBy("e", "span").orderBy("s")
    # Best known at the start of each span: one row per (entity, span).
    spans = points.groupBy("e", "span").agg(F.min("p").alias("least"))
    spans = spans.select("e", "span", F.min("least").over(Window.partitionBy("e").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    held = (
        points.join(spans, ["e", "span"])
        .withColumn("seen", F.least("before", F.min("p").over(in_span.rowsBetween(Window.unboundedPreceding, -1))))
        .where(F.col("seen").isNull() | (F.col("p") < F.col("seen")))
        .select("e", "s", "p", "span")
    )
    # Until the next holder in the span, or else the first of a later span.
    firsts = held.groupBy("e", "span").agg(F.min("s").alias("first"))
    firsts = firsts.select("e", "span", F.lead("first").over(Window.partitionBy("e").orderBy("span")).alias("later"))
    return (
        held.join(firsts, ["e", "span"])
        .withColumn("until", F.coalesce(F.lead("s").over(in_span), F.col("later"), F.lit(FOREVER)))
        .select(F.col("e").alias(entity), F.col("s").alias("since"), "until", *[F.col("p")[c].alias(c) for c in order])
    )


def dyadic_cover(since: Column, until: Column) -> Column:
    """Array of (level, node) whose cells are those from since's cell to that of until - 1."""
    lo, hi = cell(since), cell(until - 1)
    nodes = []
    for k in range(TOP):
        # On the way up an odd left end and an even right end stand alone at level k.
        a = _up(lo, k, left=True)
        b = _up(hi, k, left=False)
        nodes.append(F.when((a <= b) & (a % 2 == 1), F.struct(F.lit(k).alias("level"), a.alias("node"))))
        nodes.append(F.when((a <= b) & (b % 2 == 0), F.struct(F.lit(k).alias("level"), b.alias("node"))))
    a, b = _up(lo, TOP, left=True), _up(hi, TOP, left=False)
    tops = F.when(a <= b, F.transform(F.sequence(a, b), lambda n: F.struct(F.lit(TOP).alias("level"), n.alias("node")))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
    return F.concat(F.array_compact(F.array(*nodes)), tops)


def _up(c: Column, k: int, left: bool) -> Column:
    """The end of what is left at level k: ceil(c / 2^k) from the left, floor((c + 1) / 2^k) - 1 from the right."""
    return F.shiftright(c + F.lit((1 << k) - 1), k) if left else F.shiftright(c + F.lit(1), k) - 1


def attributes_at(events: DataFrame, statements: DataFrame, *, entity: str, at: str, since: str, order: list[str]) -> DataFrame:
    """Each event with the columns of `order` of the statement that held at its time.

    `events` needs `entity` and `at`, `statements` `entity`, `since` (first instant at which the statement is known)
    and `order`, of which the smallest tuple prevails; instants are bigint microseconds. Events without a known
    statement, and rows with null entity or instant, have no row. Repeated statements change nothing, repeated events
    come out repeated. Other columns of the statements are ignored, those of the events kept unless `order` has them.
    """
    intervals = validity(statements.select(entity, since, *order), entity, since, order)
    nodes = intervals.select("*", F.inline(dyadic_cover(F.col("since"), F.col("until"))))
    nodes = nodes.select(F.col(entity).alias("_e"), F.col("level").alias("_level"), F.col("node").alias("_node"), F.col("since").alias("_since"), F.col("until").alias("_until"), *[F.col(c).alias(f"_o_{c}") for c in order])
    # The event's own columns travel in one struct, so that their names can't clash with those of the join.
    keep = [x for x in events.columns if x not in order]
    some = events.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).select(F.col(entity).alias("_e"), F.col(at).alias("_t"), F.struct(*[F.col(x) for x in keep]).alias("_row"))
    c = cell(F.col("_t"))
    keyed = some.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("_level"), F.shiftright(c, k).alias("_node")) for k in range(TOP + 1)])))
    met = keyed.join(nodes, ["_e", "_level", "_node"]).where((F.col("_t") >= F.col("_since")) & (F.col("_t") < F.col("_until")))
    return met.select(*[F.col("_row")[x].alias(x) for x in keep], *[F.col(f"_o_{c}").alias(c) for c in order])
