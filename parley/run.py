"""python -m parley.run STAGE --tables DIR --out DIR [--ticker T] [--resume]: one stage of the pipeline, or all.

Stages in order: ingest, risk, claims, evidence, verify, market, validate, report. Each query's result lies under its
name in the out folder. With --ticker results are those of one ticker's calls, where they tell calls; with --resume what
the done log (`_done`) names for the same ticker is left alone, and only that: a folder without an entry is written anew.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.plans import evidence_queries as ev
from parley.plans import serving_queries as sv
from parley.plans import text_queries as tx

STAGES = {
    "ingest": [tx.record_status, tx.raw_segments, tx.question_answers],
    "risk": [tx.sentence_hedging, tx.tone_windows, tx.risk_of_sentences, sv.call_scores],
    "claims": [tx.claims, tx.claim_values],
    "evidence": [ev.evidence_categories, sv.evidence_of_claims, ev.leak_audit],
    "verify": [ev.verdicts, sv.verdict_reasons],
    "market": [sv.call_reactions, sv.price_changes],
    "validate": [ev.label_measures, ev.annotator_kappa, ev.score_correlations, sv.system_comparison],
    "report": [sv.company_scores, sv.risk_trend, sv.baseline_frame],
}
DONE = "query string, ticker string"


def of_ticker(df: DataFrame, calls: DataFrame, ticker: str | None) -> DataFrame:
    """The rows of one ticker: by its own column, or by the call; results that tell neither are left whole."""
    if ticker is None:
        return df
    if "ticker" in df.columns:
        return df.where(F.col("ticker") == ticker)
    mine = calls.where(F.col("ticker") == ticker).select("transcript_id")
    return df.join(mine, "transcript_id", "left_semi") if "transcript_id" in df.columns else df


def done(spark: SparkSession, out: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_done")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(DONE).json(f"{out}/_done") if there else spark.createDataFrame([], DONE)


def run(spark: SparkSession, stages: list[str], tables: str, out: str, ticker: str | None = None, resume: bool = False) -> list[str]:
    """The queries that were written, in order."""
    written = []
    calls = ev._calls(spark, tables)
    before = {r["query"] for r in done(spark, out).where(F.col("ticker").eqNullSafe(F.lit(ticker))).collect()} if resume else set()  # a row a query
    for stage in stages:
        for query in STAGES[stage]:
            name = query.__name__
            if name in before:
                continue
            of_ticker(query(spark, tables), calls, ticker).write.mode("overwrite").parquet(f"{out}/{name}")
            # Logged after it was written: a query that failed has no entry and runs again.
            spark.createDataFrame([(name, ticker)], DONE).coalesce(1).write.mode("append").json(f"{out}/_done")
            written.append(name)
    return written


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=[*STAGES, "all"])
    p.add_argument("--tables", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--ticker")
    p.add_argument("--resume", action="store_true", help="leave alone what the done log names")
    a = p.parse_args(argv)
    run(SparkSession.builder.getOrCreate(), list(STAGES) if a.stage == "all" else [a.stage], a.tables, a.out, a.ticker, a.resume)


if __name__ == "__main__":
    main()
