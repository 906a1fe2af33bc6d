"""Calls and evidence in the form that time joins take: plain ticker, instant in microseconds, one row per id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.instants import instant_micros, plain_ticker
from parley.operators.latest import latest_per_key, or_prefix


def call_times(transcripts: DataFrame) -> DataFrame:
    """transcript_id, ticker, at (microseconds): the valid row of each transcript, if its date is readable.

    Of repeated ids the row with the latest created_at is valid, even if its date is unreadable: then the transcript
    has no row here. Null ids have no row; a null ticker is taken from the id.
    """
    raw = transcripts.select("transcript_id", "created_at", F.col("date").alias("_date"), F.col("ticker").alias("_ticker"))
    one = latest_per_key(raw, "transcript_id", "created_at", ["_date", "_ticker"])
    return one.select("transcript_id", or_prefix(plain_ticker(F.col("_ticker")), F.col("transcript_id")).alias("ticker"), instant_micros(F.col("_date")).alias("at")).where("at is not null and ticker is not null")


def evidence_times(evidence: DataFrame, extra: dict | None = None) -> DataFrame:
    """evidence_id, ticker, at (microseconds) and the columns of `extra` (name: Column): the valid row of each evidence.

    Of rows fetched again the one with the latest retrieval_timestamp is valid. A null ticker is looked up in metadata.
    Rows without readable publication_date or ticker and null ids are left out, after the valid row was chosen.
    """
    extra = extra or {}
    raw = evidence.select(
        "evidence_id", "retrieval_timestamp", instant_micros(F.col("publication_date")).alias("at"),
        F.coalesce(plain_ticker(F.col("ticker")), plain_ticker(F.col("metadata")["ticker"])).alias("ticker"),
        *[c.alias(n) for n, c in extra.items()],
    )
    return latest_per_key(raw, "evidence_id", "retrieval_timestamp", ["at", "ticker", *extra]).where("at is not null and ticker is not null")
