"""Queries that run a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.tables import ensure_checkpoint_dir
from parley.streaming.ingest import event_windows


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind and day, from a stream; its state and result lie in the shared folder."""
    at = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return event_windows(spark, sf_dir, f"{at}/out", f"{at}/state", close=True).select("kind", "start", "n", F.round("total", 4).alias("total"))


QUERIES = {"stream_windows": stream_windows}
ORACLES = {"stream_windows": "SELECT event_type AS kind, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"}
