"""One valid row per key: the one that was written last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, written: str, values: list[str]) -> DataFrame:
    """One row per non-null `key`: `values` of the row with the greatest `written`.

    Null `written` comes first, ties are broken by the values themselves, so repeated rows change nothing. It is an
    aggregate with map-side combine, never a collected group; a key with a third of all rows is combined before the
    shuffle.
    """
    best = F.max(F.struct(F.col(written), *[F.col(v) for v in values])).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col("_best")[v].alias(v) for v in values])


def or_prefix(ticker: Column, transcript_id: Column) -> Column:
    """The ticker, or where it is null the one that the transcript id starts with."""
    head = F.upper(F.substring_index(transcript_id, "_", 1))
    return F.coalesce(ticker, F.when(head != "", head))
