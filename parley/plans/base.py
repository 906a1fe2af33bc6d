"""Tables in the form that several queries start from, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.calls import call_times
from parley.sources.tables import table


SEGMENT_COLUMNS = ("segment_id", "transcript_id", "speaker", "speaker_role", "section", "text", "sequence")
PAIR_COLUMNS = ("qa_id", "transcript_id", "question_text", "answer_text")
SENTENCE_COLUMNS = ("sentence_id", "segment_id", "transcript_id", "sentence_number", "text")


def _rows(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...], key: str, by: str) -> DataFrame:
    """Distinct rows of some columns. Columns are chosen before, so the scan reads no others, and rows are put together
    by `by`, so a join on it needs no further shuffle; repeated rows are whole copies, which any choice leaves copies."""
    return table(spark, sf_dir, name).where(F.col(key).isNotNull()).select(*columns).repartition(by).distinct()


def segments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The segments, or some of their columns, each once."""
    return _rows(spark, sf_dir, "segments", columns or SEGMENT_COLUMNS, "segment_id", "segment_id" if not columns or "segment_id" in columns else columns[0])


def pairs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _rows(spark, sf_dir, "qa_pairs", columns or PAIR_COLUMNS, "qa_id", "qa_id")


def sentences(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """sentence_id, segment_id, transcript_id, sentence_number, text, and the segment's order, role and section.

    With `columns` just these, and of the tables just what they need.
    """
    want = columns or (*SENTENCE_COLUMNS, "segment_order", "speaker_role", "section")
    own = [c for c in SENTENCE_COLUMNS if c in want or c in ("sentence_id", "segment_id")]
    of_segment = {"segment_order": F.col("sequence").alias("segment_order"), "speaker_role": F.col("speaker_role"), "section": F.col("section")}
    met = {"segment_order": "sequence"}
    g = segments(spark, sf_dir, "segment_id", *[met.get(c, c) for c in of_segment if c in want])
    s = _rows(spark, sf_dir, "sentences", tuple(own), "sentence_id", "segment_id")
    return s.join(g.select("segment_id", *[c for n, c in of_segment.items() if n in want]), "segment_id").select(*want)


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript_id, ticker, call_day of the valid row of each call."""
    c = call_times(table(spark, sf_dir, "transcripts"))
    return c.select("transcript_id", "ticker", F.to_date(F.timestamp_micros("at")).alias("call_day"))


SEGMENTS = "(SELECT DISTINCT * FROM segments WHERE segment_id IS NOT NULL)"
PAIRS = "(SELECT DISTINCT qa_id, transcript_id, question_text, answer_text FROM qa_pairs WHERE qa_id IS NOT NULL)"
SENTENCES = f"""(SELECT s.sentence_id, s.segment_id, s.transcript_id, s.sentence_number, s.text, g.sequence AS segment_order, g.speaker_role, g.section
  FROM (SELECT DISTINCT * FROM sentences WHERE sentence_id IS NOT NULL) s JOIN {SEGMENTS} g USING (segment_id))"""
