"""Writing tables: upserts by key, replaced partitions, sheets and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.sources.records import ANNOTATION_COLUMNS


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both, those of `new` in place of old ones of the same keys. Keys may be null: null equals null."""
    cond = [old[k].eqNullSafe(new[k]) for k in keys]
    return old.join(new.select(*keys), cond, "left_anti").unionByName(new, allowMissingColumns=True)


def last_written(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row with the greatest `order`."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def orphans_removed(children: DataFrame, replaced: DataFrame, key: str) -> DataFrame:
    """`children` without those of replaced parents: the cascade, made plain."""
    return children.join(replaced.select(key).distinct(), key, "left_anti")


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write, replacing just the partitions that `df` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """CSV with a header, quoted so that it reads back the same."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def annotation_sheet(pairs: DataFrame) -> DataFrame:
    """The sixteen columns of an annotation sheet; what is missing or null is empty."""
    have = set(pairs.columns)
    return pairs.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in ANNOTATION_COLUMNS])


def annotation_sample(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A sample of n pairs with a question over 30 and an answer over 50 characters, the same for the same seed."""
    long = pairs.where((F.length("question_text") > 30) & (F.length("answer_text") > 50))
    return long.orderBy(F.xxhash64("qa_id", F.lit(seed)), "qa_id").limit(n).orderBy("qa_id")


def write_report(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """The number of rows of each table, as a JSON file."""
    counts = {name: df.count() for name, df in tables.items()}
    Path(path).write_text(json.dumps({"rows": counts}, indent=2))
    return counts
