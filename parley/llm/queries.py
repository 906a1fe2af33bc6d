"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.consensus import consensus
from parley.llm.garbled import restore_encoding
from parley.llm.nearest_in_time import nearest_in_time
from parley.llm.packing import pack
from parley.llm.pair_defects import pair_defects
from parley.llm.sentences import sentence_units
from parley.llm.site_lines import repeated_lines, without_lines
from parley.llm.tokens import decode_corpus, encode_corpus, token_counts
from parley.functions.instants import plain_ticker
from parley.llm.turns import clean_turns
from parley.operators.calls import call_times, evidence_times
from parley.operators.latest import latest_per_key, or_prefix
from parley.plans.sql_text import ORACLE_CALLS, oracle_evidence, oracle_ticker
from parley.sources.tables import table

DAY = 86_400_000_000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript_id, evidence_id: the evidence of the same ticker nearest to each call, within a day."""
    calls = call_times(table(spark, sf_dir, "transcripts"))
    evidence = evidence_times(table(spark, sf_dir, "retrieved_evidence"))
    return nearest_in_time(calls, evidence, left_id="transcript_id", right_id="evidence_id", entity="ticker", at="at", tolerance=DAY)


def _sited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments with the plain ticker of their transcript as site."""
    valid = latest_per_key(table(spark, sf_dir, "transcripts").select("transcript_id", "created_at", "ticker"), "transcript_id", "created_at", ["ticker"])
    segments = table(spark, sf_dir, "segments").select("segment_id", "transcript_id", "sequence", "text")
    return segments.join(valid, "transcript_id", "left").withColumn("site", or_prefix(plain_ticker(F.col("ticker")), F.col("transcript_id"))).drop("ticker")


def _furniture(sited: DataFrame) -> DataFrame:
    return repeated_lines(sited, part="segment_id", doc="transcript_id", site="site", text="text", order="sequence", share=0.4, least=4)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, line_no: the lines to be removed."""
    return _furniture(_sited(spark, sf_dir)).select("segment_id", "line_no")


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, text: every segment with the repeated lines removed."""
    sited = _sited(spark, sf_dir)
    return without_lines(sited.select("segment_id", "text").distinct(), _furniture(sited), part="segment_id", text="text").select("segment_id", "text")


def p3_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, start_char, end_char, unit: the sentence units of every segment."""
    return sentence_units(table(spark, sf_dir, "segments"), key="segment_id", text="text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, start_char, end_char of every sentence unit."""
    return p3_units(spark, sf_dir).drop("unit")


def _evasiveness(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "annotations").where("evaluation_type = 'human'")
    numbers = ["auto_evasiveness_score", "auto_hedging_score", "auto_hidden_risk_score"]
    return consensus(rows, item="qa_id", annotator="annotator_id", label="label_evasive", written="labelled_at", numbers=numbers, text="answer_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label_evasive: one label of each pair."""
    return _evasiveness(spark, sf_dir)[0].select("qa_id", F.col("label").alias("label_evasive"))


def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, label, confidence, n_votes, agreement of each pair."""
    return _evasiveness(spark, sf_dir)[0]


def p5_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """annotator, n_labels, reliability, informedness."""
    return _evasiveness(spark, sf_dir)[1]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, defect: the pairs whose answer is defective; languages are learned from the documents."""
    pairs, documents = table(spark, sf_dir, "qa_pairs"), table(spark, sf_dir, "documents")
    return pair_defects(pairs, documents, key="qa_id", question="question_text", answer="answer_text", labelled_text="text", label="lang")


def p7_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_no, turn_no, speaker, text, n_words: the clean turns of every call."""
    return clean_turns(table(spark, sf_dir, "sample_transcripts"), table(spark, sf_dir, "call_roster"), key="record_no", content="content", structured="structured_content")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_no, turn_no, speaker, n_words of every clean turn."""
    return p7_turns(spark, sf_dir).drop("text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids: every document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"), key="doc_id", text="text")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the ids decoded again; equals the stored text, with null as empty."""
    return decode_corpus(p8_ids(spark, sf_dir), key="doc_id")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece_no, start, n, container_id: the documents in containers of 2,048 tokens of byte_bpe_50k."""
    sizes = token_counts(table(spark, sf_dir, "documents"), key="doc_id", text="text")
    return pack(sizes, key="doc_id", size="n_tokens", capacity=2048)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, orig_chars: the documents read with a wrong encoding, and the length of their text restored."""
    return restore_encoding(table(spark, sf_dir, "documents"), key="doc_id", text="text").select("doc_id", "orig_chars")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_cleaned": p2_cleaned, "p3_found": p3_found, "p3_units": p3_units, "p5_found": p5_found, "p5_items": p5_items, "p5_annotators": p5_annotators, "p6_found": p6_found, "p7_found": p7_found, "p7_turns": p7_turns, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_containers": p9_containers, "p10_found": p10_found}

_LINES = f"""site AS (SELECT transcript_id, {oracle_ticker("ticker")} AS site FROM (
    SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY created_at DESC NULLS LAST, ticker DESC NULLS LAST) AS rn FROM transcripts) WHERE rn = 1),
s AS (SELECT DISTINCT segment_id, s.transcript_id, coalesce(site, upper(split_part(s.transcript_id, '_', 1))) AS site, text
  FROM segments s LEFT JOIN site USING (transcript_id) WHERE segment_id IS NOT NULL AND s.transcript_id IS NOT NULL),
n AS (SELECT site, count(DISTINCT transcript_id) AS docs FROM s GROUP BY site),
l AS (SELECT segment_id, transcript_id, site, i - 1 AS line_no, lower(regexp_replace(parts[i], '[^\\p{{L}}]', '', 'g')) AS k
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM s WHERE text IS NOT NULL), LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i)),
f AS (SELECT site, k FROM l WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT transcript_id) >= 4 AND count(DISTINCT transcript_id) >= 0.4 * (SELECT docs FROM n WHERE n.site = l.site))"""

ORACLES = {
    "p1_found": f"""
WITH {ORACLE_CALLS}, {oracle_evidence()}
SELECT transcript_id, evidence_id FROM (
  SELECT c.transcript_id, e.evidence_id, row_number() OVER (PARTITION BY c.transcript_id ORDER BY abs(epoch_us(e.instant) - epoch_us(c.instant)), e.instant, e.evidence_id) AS rn
  FROM calls c JOIN ev e ON c.ticker = e.ticker AND e.instant BETWEEN c.instant - INTERVAL 86400 SECOND AND c.instant + INTERVAL 86400 SECOND) WHERE rn = 1""",
    "p2_found": f"WITH {_LINES} SELECT DISTINCT segment_id, CAST(line_no AS INTEGER) AS line_no FROM l JOIN f USING (site, k)",
    "p2_cleaned": f"""
WITH {_LINES}, gone AS (SELECT DISTINCT segment_id, line_no FROM l JOIN f USING (site, k)),
d AS (SELECT DISTINCT segment_id, text FROM segments), parts AS (SELECT segment_id, text, i - 1 AS line_no, string_split(text, chr(10))[i] AS line FROM d, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS i))
SELECT d.segment_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text
FROM d LEFT JOIN (SELECT segment_id, text, string_agg(line, chr(10) ORDER BY line_no) AS kept FROM parts p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.segment_id = p.segment_id AND g.line_no = p.line_no) GROUP BY segment_id, text) k ON d.segment_id IS NOT DISTINCT FROM k.segment_id AND d.text = k.text""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
