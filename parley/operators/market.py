"""Series of daily values around events: days before and after, forward changes, realised volatility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FORWARD = (1, 5, 10, 20)
#: Trading days of a year.
YEAR = 252


def indexed(series: DataFrame, *, entity: str, day: str, value: str) -> DataFrame:
    """entity, day, value, i (place of the day, from 0), change (from the day before); one value a day is needed."""
    w = Window.partitionBy(entity).orderBy(day)
    v = F.col(value)
    return series.where(v.isNotNull()).select(entity, day, value, (F.row_number().over(w) - 1).alias("i"), F.try_divide(v - F.lag(v).over(w), F.lag(v).over(w)).alias("change"))


def reaction(events: DataFrame, series: DataFrame, *, entity: str, event_day: str, day: str, value: str) -> DataFrame:
    """entity, event_day, day_before, day_after, change_{1,5,10,20}d and volatility_{5,10,20}d of each distinct event.

    The base is the last day strictly before the event, the start the first on or after it. A change is null beyond the
    series' end, volatility is the sample deviation of the daily changes to there, in years. Events without a day before
    or after have nulls. The place of an event among an entity's days comes from one ordered pass over both together.
    """
    days = indexed(series, entity=entity, day=day, value=value)
    spots = events.where(F.col(event_day).isNotNull() & F.col(entity).isNotNull()).select(entity, event_day).distinct()
    w = Window.partitionBy(entity).orderBy(day)
    ahead = days
    for k in FORWARD:
        ahead = ahead.withColumn(f"v{k}", F.lead(value, k).over(w))
        if k > 1:
            span = w.rowsBetween(1, k)
            ahead = ahead.withColumn(f"s{k}", F.when(F.lead(value, k).over(w).isNotNull(), F.stddev_samp("change").over(span) * F.sqrt(F.lit(float(YEAR)))))
    at = F.struct(F.col(day).alias("d"), F.col(value).alias("v"), *[F.col(f"v{k}") for k in FORWARD], *[F.col(f"s{k}") for k in FORWARD if k > 1])
    both = ahead.select(entity, F.col(day).alias("t"), F.lit(1).alias("kind"), at.alias("row")).unionByName(
        spots.select(entity, F.col(event_day).alias("t"), F.lit(0).alias("kind")), allowMissingColumns=True
    )
    # An event stands before the value of its own day: what comes before it is earlier, what comes after not.
    order = Window.partitionBy(entity).orderBy("t", "kind")
    placed = both.withColumns(
        {
            "b": F.last("row", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "a": F.first("row", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).where("kind = 0")
    ok = F.col("b").isNotNull() & F.col("a").isNotNull()
    base = F.col("b.v")
    return placed.select(
        entity, F.col("t").alias(event_day), F.when(ok, F.col("b.d")).alias("day_before"), F.when(ok, F.col("a.d")).alias("day_after"),
        *[F.when(ok, F.try_divide(F.col(f"a.v{k}") - base, base)).alias(f"change_{k}d") for k in FORWARD],
        *[F.when(ok, F.col(f"a.s{k}")).alias(f"volatility_{k}d") for k in FORWARD if k > 1],
    )


def abnormal(own: DataFrame, benchmark: DataFrame, *, event_day: str, windows: tuple[int, ...] = (5, 10)) -> DataFrame:
    """`own` reactions with abnormal_{w}d: the change less that of the benchmark's reaction to the same day."""
    market = benchmark.select(F.col(event_day), *[F.col(f"change_{w}d").alias(f"_m{w}") for w in windows]).distinct()
    out = own.join(market, event_day, "left")
    return out.withColumns({f"abnormal_{w}d": F.col(f"change_{w}d") - F.col(f"_m{w}") for w in windows}).drop(*[f"_m{w}" for w in windows])


def latest_within(facts: DataFrame, events: DataFrame, *, entity: str, event_day: str, day: str, value: str, lookback: int) -> DataFrame:
    """entity, event_day, value of the latest fact on or before the event, at most `lookback` days old, or null."""
    from parley.operators.claims import within_days

    spots = events.select(entity, event_day).distinct()
    met = within_days(spots, facts.select(entity, F.col(day).alias("_day"), F.col(value).alias("_value")), entity=entity, left_day=event_day, right_day="_day", before=lookback, after=0)
    best = met.groupBy(entity, event_day).agg(F.max(F.struct("_day", "_value")).alias("m"))
    return spots.join(best, [entity, event_day], "left").select(entity, event_day, F.col("m._day").alias("fact_day"), F.col("m._value").alias(value))
