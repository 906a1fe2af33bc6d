"""Queries on attributes as known at event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.instants import utc_day
from parley.operators.attributes_at import attributes_at
from parley.operators.calls import call_times, evidence_times
from parley.plans.sql_text import ORACLE_CALLS, oracle_evidence
from parley.sources.tables import table

DAY = 86_400_000_000


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript_id, evidence_id: the company outlook known at each call; see attributes_at for the method.

    An outlook is known from the instant after its publication, and not before its effective day (UTC) begins. The
    later effective day prevails, then the later publication, then the smaller id.
    """
    meta = F.col("metadata")
    word = F.trim(meta["outlook"])
    outlook = F.coalesce(word.rlike(r"[\p{L}\p{N}]"), F.lit(False))
    effective = F.datediff(F.trim(meta["effective_date"]).try_cast("date"), F.lit("1970-01-01").cast("date"))
    known = evidence_times(table(spark, sf_dir, "retrieved_evidence"), {"outlook": outlook, "effective": F.when(outlook, effective)}).where("outlook")
    day = F.coalesce(F.col("effective"), utc_day(F.col("at"))).cast("bigint")
    statements = known.select("ticker", F.greatest(F.col("at") + 1, day * DAY).alias("since"), (-day).alias("late_day"), (-F.col("at")).alias("late_at"), "evidence_id")
    calls = call_times(table(spark, sf_dir, "transcripts"))
    return attributes_at(calls, statements, entity="ticker", at="at", since="since", order=["late_day", "late_at", "evidence_id"]).select("transcript_id", "evidence_id")


QUERIES = {"p4_found": p4_found}

ORACLES = {
    "p4_found": f"""
WITH {ORACLE_CALLS}, {oracle_evidence("trim(metadata['outlook']) AS outlook, try_cast(trim(metadata['effective_date']) AS DATE) AS effective")},
known AS (SELECT evidence_id, ticker, instant, coalesce(effective, CAST(instant AS DATE)) AS day FROM ev WHERE regexp_matches(outlook, '[A-Za-z0-9]'))
SELECT transcript_id, evidence_id FROM (
  SELECT c.transcript_id, k.evidence_id, row_number() OVER (PARTITION BY c.transcript_id ORDER BY k.day DESC, k.instant DESC, k.evidence_id) AS rn
  FROM calls c JOIN known k ON c.ticker = k.ticker AND k.instant < c.instant AND k.day <= CAST(c.instant AS DATE)) WHERE rn = 1""",
}
