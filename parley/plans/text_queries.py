"""Queries on the text operators: cleaning, segments, sentences, hedging, tone, pairs, risk and claims."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import lexicons as lx
from parley.functions.text import clean_text, lm_negative_score, non_ascii_ratio
from parley.operators.claims import extract_claims, normalized
from parley.operators.risk import call_risk, combined_risk, contributing_factors, evasiveness, first_density, hedging, hedging_terms, local_shift, pair_risk, risk_band, section_shift, segment_risk, tfidf_cosine, top_share_mean
from parley.operators.segments import call_segments, ingest_status, match_questions, sentence_rows, with_sections
from parley.operators.sentiment import lexicon_sentiment
from parley.plans.base import PAIRS, SEGMENTS, SENTENCES, pairs, segments, sentences
from parley.sources.tables import cut, table


def _r(c: str, n: int = 6) -> F.Column:
    return F.round(F.col(c).cast("double"), n).alias(c)


def clean_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir, "segment_id", "text")
    return s.select("segment_id", clean_text(F.col("text")).alias("clean"), F.round(non_ascii_ratio(F.col("text")).cast("double"), 6).alias("non_ascii"))


def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_rows(segments(spark, sf_dir, "segment_id", "text"), key="segment_id", text="text")


def sentence_hedging(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hedging(sentences(spark, sf_dir, "sentence_id", "text"), "text")
    return h.select("sentence_id", "word_count", "modal_count", "qualifier_count", "uncertainty_count", "deflection_count", _r("hedge_density"), _r("uncertainty_score"), _r("hedging_score"))


def hedging_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched terms of each sentence that has any, those of a kind joined by `|`."""
    s = sentences(spark, sf_dir, "sentence_id", "text").select("sentence_id", hedging_terms(F.col("text")).alias("m"))
    some = s.select("sentence_id", "m.*").where("size(modals) + size(qualifiers) + size(uncertainty) + size(deflection) > 0")
    return some.select("sentence_id", *[F.array_join(c, "|").alias(c) for c in ("modals", "qualifiers", "uncertainty", "deflection")])


def negative_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir, "sentence_id", "transcript_id", "text").groupBy("transcript_id").agg(F.round(F.avg(lm_negative_score(F.col("text"))), 6).alias("negative_score"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hedging(sentences(spark, sf_dir), "text")


def _toned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored sentences with their negative share and label by word lists."""
    rows = _scored(spark, sf_dir).select(F.struct("*").alias("row"), "text")
    return lexicon_sentiment(rows, key="row", text="text").select("row.*", "negative", "label")


def _tone(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the sentences with the negative share alone."""
    rows = sentences(spark, sf_dir, *columns, "text").select(F.struct(*columns).alias("row"), "text")
    return lexicon_sentiment(rows, key="row", text="text").select("row.*", "negative")


def tone_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = local_shift(_tone(spark, sf_dir, "sentence_id", "transcript_id", "segment_order", "sentence_number"), group="transcript_id", order=["segment_order", "sentence_number", "sentence_id"], value="negative")
    return t.select("sentence_id", _r("rolling_mean"), _r("rolling_std"), _r("previous"), _r("shift_score", 3))


def tone_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = section_shift(_tone(spark, sf_dir, "sentence_id", "transcript_id", "section"), group="transcript_id", section="section", value="negative")
    return t.select("transcript_id", _r("prepared_mean"), _r("qa_mean"), _r("section_shift"))


def pair_evasiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evasiveness(pairs(spark, sf_dir), key="qa_id", question="question_text", answer="answer_text")
    return e.select("qa_id", _r("similarity"), _r("topic_overlap"), _r("keyword_overlap"), "direct_count", "deflecting_count", "generic_count", _r("length_ratio"), "asks_number", "has_number", _r("evasive_score"))


def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf_cosine(pairs(spark, sf_dir), key="qa_id", left="question_text", right="answer_text", bigrams=False).select("qa_id", _r("similarity"))


def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_questions(segments(spark, sf_dir)).select("qa_id", "transcript_id", "question_segment_id", "answer_segment_id", "question_text", "answer_text")


def risk_of_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per call: sentences, mean and top tenth of the hedging score, their blend, and the means of the sections."""
    s = _scored(spark, sf_dir)
    top = top_share_mean(s, group="transcript_id", value="hedging_score")
    by = s.groupBy("transcript_id").agg(
        F.avg(F.when(F.col("section").isin("prepared_remarks", "opening"), F.col("hedging_score"))).alias("prepared"), F.avg(F.when(F.col("section") == "q_and_a", F.col("hedging_score"))).alias("qa"),
        F.max_by("segment_id", F.struct("hedging_score", -F.col("segment_order"), -F.col("sentence_number"), "sentence_id")).alias("worst_segment"),
    )
    return top.join(by, "transcript_id").select("transcript_id", F.col("n").cast("bigint").alias("n"), _r("mean"), _r("top_mean"), _r("blend"), _r("prepared"), _r("qa"), "worst_segment")


def risk_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_share_mean(_scored(spark, sf_dir), group="segment_id", value="hedging_score")
    return top.select("segment_id", F.col("n").cast("bigint").alias("n"), _r("blend"))


def _risky(spark: SparkSession, sf_dir: str, *, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sentences with risk and shift_score, and pairs with evasive_score.

    With `once` both are written to the shared folder, the sentences without their text, for queries that go over them
    several times; else they are worked out where they are used.

    A pair's answer counts with the hedge density of the first sentence of its first segment; its score goes to the
    sentences of that segment, of several pairs the last.
    """
    s = local_shift(_toned(spark, sf_dir), group="transcript_id", order=["segment_order", "sentence_number", "sentence_id"], value="negative")
    first = first_density(hedging(sentences(spark, sf_dir, "sentence_id", "segment_id", "sentence_number", "text"), "text"))
    m = match_questions(segments(spark, sf_dir)).join(first.withColumnRenamed("segment_id", "answer_segment_id"), "answer_segment_id", "left")
    e = evasiveness(m, key="qa_id", question="question_text", answer="answer_text", density="first_density", keep=("transcript_id", "answer_segment_id", "sequence"))
    if once:
        e = cut(e.select("qa_id", "transcript_id", "answer_segment_id", "sequence", "evasive_score"))
        s = s.select("sentence_id", "segment_id", "transcript_id", "segment_order", "sentence_number", "section", "hedging_score", "shift_score", "negative")
    last = e.groupBy(F.col("answer_segment_id").alias("segment_id")).agg(F.max_by("evasive_score", "sequence").alias("evasive"))
    j = s.join(last, "segment_id", "left").withColumn("evasive", F.coalesce("evasive", F.lit(0.0)))
    risky = j.withColumn("risk", combined_risk(F.col("hedging_score"), F.col("evasive"), F.col("shift_score")))
    return (cut(risky) if once else risky), e


def risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sentence's risk is made of; matched terms of a kind are joined by `|`."""
    f = _risky(spark, sf_dir)[0].select("sentence_id", F.round("risk", 2).alias("risk"), contributing_factors(F.col("text")).alias("f"))
    joined = [F.array_join(f"f.{c}", "|").alias(c) for c in ("matched_modals", "matched_qualifiers", "matched_uncertainty_phrases", "matched_deflection_phrases")]
    scores = [F.round(f"f.{c}", 3).alias(c) for c in ("hedging_score", "tone_shift_score", "evasive_score", "negative_prob")]
    return f.select("sentence_id", "risk", *scores, "f.hedging_weight", "f.evasive_weight", "f.shift_weight", *joined, "f.deflection_count", "f.uncertainty_phrase_count", "f.sentiment_label")


def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_risk(_risky(spark, sf_dir)[0])


def risk_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = _risky(spark, sf_dir, once=True)
    return pair_risk(e, s).select("qa_id", "pair_risk")


def risk_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of a call: overall, prepared, qa, band and the worst segment."""
    s, e = _risky(spark, sf_dir, once=True)
    shifts = section_shift(s, group="transcript_id", section="section", value="negative")
    r = call_risk(s, pair_risk(e, s), shifts)
    return r.withColumn("band", risk_band(F.col("overall")))


def sentence_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone of sentences by word lists, the stand-in for a model."""
    t = lexicon_sentiment(sentences(spark, sf_dir, "sentence_id", "text"), key="sentence_id", text="text")
    return t.select("sentence_id", _r("positive"), _r("negative"), _r("neutral"), "label")


def risk_of_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence risk: hedging, the evasiveness of the pair whose first answer segment it is in, and the local shift."""
    return _risky(spark, sf_dir)[0].select("sentence_id", F.round("risk", 3).alias("risk"), F.round("evasive", 3).alias("evasive"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_claims(sentences(spark, sf_dir))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most confident claims of each call; the text is cut to 800 characters for display, after all was read."""
    return _claims(spark, sf_dir).withColumn("claim_text", F.substring("claim_text", 1, 800))


def claim_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalized(_claims(spark, sf_dir), text="claim_text", default="claim_type")
    return n.select("claim_id", "metric", _r("value", 4), _r("lower_bound", 4), _r("upper_bound", 4), "unit", "period", "geography")


def record_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tally of raw records by what would become of them, against the calls that are there already."""
    r = ingest_status(table(spark, sf_dir, "sample_transcripts"), table(spark, sf_dir, "transcripts"))
    return r.groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"))


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the raw records, with sections told by the course of the call."""
    records = table(spark, sf_dir, "sample_transcripts").dropDuplicates(["record_no"])
    return with_sections(call_segments(records, key="record_no", structured="structured_content", content="content"), key="record_no")


QUERIES = {
    "clean_segments": clean_segments, "split_segments": split_segments, "sentence_hedging": sentence_hedging, "hedging_matches": hedging_matches, "negative_words": negative_words,
    "tone_windows": tone_windows, "tone_sections": tone_sections, "pair_evasiveness": pair_evasiveness, "pair_similarity": pair_similarity, "question_answers": question_answers,
    "risk_of_calls": risk_of_calls, "risk_of_segments": risk_of_segments, "risk_of_sentences": risk_of_sentences, "risk_of_pairs": risk_of_pairs, "risk_overall": risk_overall, "risk_factors": risk_factors, "segment_summary": segment_summary, "sentence_tone": sentence_tone, "claims": claims, "claim_values": claim_values,
    "record_status": record_status, "raw_segments": raw_segments,
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _bounded(terms: list[str]) -> str:
    return "\\b(?:" + "|".join(re.escape(t).replace("\\ ", " ") for t in sorted(set(terms), key=lambda t: (-len(t), t))) + ")\\b"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all(lower({x}), {_q(pattern)}))"


def _phrases(x: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"(length(lower({x})) - length(replace(lower({x}), {_q(p)}, ''))) // {len(p)}" for p in sorted(set(phrases))) + ")"


def _words(x: str) -> str:
    return f"greatest(1, len(list_filter(regexp_split_to_array({x}, '[\\s\\pZ\\x{{85}}]+'), lambda w: w <> '')))"


def _patterns(x: str, patterns: list[str]) -> str:
    return "(" + " + ".join(_count(x, p) for p in patterns) + ")"


def _case(x: str, patterns: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {_q('(?i)' + p)}) THEN {_q(n)}" for p, n in patterns) + f" ELSE {default} END"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


_HEDGE = f"""h0 AS (SELECT *, coalesce(text, '') AS x FROM {SENTENCES}),
h1 AS (SELECT *, {_words("x")} AS word_count, {_count("x", _bounded(lx.MODALS))} AS modal_count, {_count("x", _bounded(lx.QUALIFIERS))} AS qualifier_count,
  {_phrases("x", lx.UNCERTAINTY)} AS uncertainty_count, {_phrases("x", lx.DEFLECTION)} AS deflection_count FROM h0),
h AS (SELECT *, (modal_count + qualifier_count + uncertainty_count)::DOUBLE / word_count AS hedge_density,
  100 * (0.35::DOUBLE * least(modal_count::DOUBLE / word_count * 10, 1) + 0.35::DOUBLE * least(qualifier_count::DOUBLE / word_count * 10, 1) + 0.3::DOUBLE * least(uncertainty_count / 3.0::DOUBLE, 1)) AS uncertainty_score,
  100 * (0.5::DOUBLE * least((modal_count + qualifier_count + uncertainty_count)::DOUBLE / word_count * 8, 1) + 0.25::DOUBLE * least(uncertainty_count / 2.0::DOUBLE, 1) + 0.25::DOUBLE * least(deflection_count / 2.0::DOUBLE, 1)) AS hedging_score FROM h1)"""

_TOP = """r AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY hedging_score DESC) AS rn, count(*) OVER (PARTITION BY {g}) AS n FROM h),
t AS (SELECT {g}, max(n) AS n, avg(hedging_score) AS mean, avg(CASE WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) THEN hedging_score END) AS top_mean FROM r GROUP BY {g})"""

_STRIP = lambda x: f"regexp_replace({x}, '^[\\s\\x1c-\\x1f\\x{{85}}\\pZ]+|[\\s\\x1c-\\x1f\\x{{85}}\\pZ]+$', '', 'g')"
_ABBREVIATED = "|".join(re.escape(a) for a in sorted(lx.ABBREVIATIONS, key=lambda a: (-len(a), a)))

_TERMS = """w AS (SELECT qa_id, side, list_filter(regexp_extract_all(lower(coalesce(t, '')), '[\\pL\\pN_]{{2,}}'), lambda w: NOT list_contains({stop}, w)) AS w
  FROM (SELECT qa_id, 0 AS side, question_text AS t FROM {pairs} UNION ALL SELECT qa_id, 1, answer_text FROM {pairs})),
term AS (SELECT qa_id, side, unnest(w) AS term FROM w {bigrams}),
tf AS (SELECT qa_id, term, count(*) FILTER (side = 0) AS l, count(*) FILTER (side = 1) AS r FROM term GROUP BY ALL),
wt AS (SELECT qa_id, CASE WHEN l > 0 AND r > 0 THEN 1 ELSE 1 + ln(1.5::DOUBLE) END * CASE WHEN l > 0 THEN 1 + ln(l) ELSE 0 END AS wl, CASE WHEN l > 0 AND r > 0 THEN 1 ELSE 1 + ln(1.5::DOUBLE) END * CASE WHEN r > 0 THEN 1 + ln(r) ELSE 0 END AS wr FROM tf),
sim AS (SELECT p.qa_id, coalesce(s.sim, 0) AS similarity FROM {pairs} p LEFT JOIN (
  SELECT qa_id, CASE WHEN sum(wl * wl) > 0 AND sum(wr * wr) > 0 THEN sum(wl * wr) / (sqrt(sum(wl * wl)) * sqrt(sum(wr * wr))) END AS sim FROM wt GROUP BY qa_id) s USING (qa_id))"""
_BIGRAMS = "UNION ALL SELECT qa_id, side, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w"


def _terms(bigrams: bool, pairs: str = PAIRS) -> str:
    return _TERMS.format(stop=_list(lx.STOP_WORDS), pairs=pairs, bigrams=_BIGRAMS if bigrams else "")


_Q, _A = "coalesce(question_text, '')", "coalesce(answer_text, '')"
_CLAIM = f"""c0 AS (SELECT *, {_case("text", lx.CLAIM_TOPICS, "'other'")} AS claim_type, regexp_matches(text, {_q("(?i)" + lx.CLAIM_NUMBER)}) AS has_number, lower(regexp_extract(text, {_q("(?i)" + lx.DIRECTION)}, 1)) AS dw FROM {SENTENCES}),
c1 AS (SELECT *, CASE WHEN list_contains({_list(lx.UP)}, dw) THEN 'increase' WHEN list_contains({_list(lx.DOWN)}, dw) THEN 'decrease' WHEN list_contains({_list(lx.FLAT)}, dw) THEN 'flat' WHEN dw <> '' THEN dw END AS direction
  FROM c0 WHERE claim_type <> 'other' AND {_words("text")} >= 4 AND NOT regexp_matches(text, {_q("(?i)" + lx.BOILERPLATE)}) AND (has_number OR dw <> '' OR coalesce(section, '') = 'prepared_remarks')),
c2 AS (SELECT *, round(least(1, 0.5 + CASE WHEN has_number THEN 0.3 ELSE 0 END + CASE WHEN direction IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN speaker_role = 'executive' THEN 0.05 ELSE 0 END), 2)::DOUBLE AS confidence,
  row_number() OVER (PARTITION BY transcript_id ORDER BY segment_order, sentence_number, sentence_id) AS n FROM c1),
c AS (SELECT format('{{}}_claim_{{:03d}}', transcript_id, n) AS claim_id, transcript_id, sentence_id, text AS claim_text, claim_type, direction, has_number, confidence
  FROM c2 QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY confidence DESC, n) <= 20)"""


def _num(x: str) -> str:
    return f"try_cast(replace(nullif({x}, ''), ',', '') AS DOUBLE)"


def _ascii(x: str) -> str:
    """Letters of other scripts as z, so that an ASCII word boundary stands where a Unicode one would."""
    return f"regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F\\pL\\pN]', ' ', 'g'), '[^\\x00-\\x7F]', 'z', 'g')"


def _ex(pattern: str, i: int) -> str:
    return f"regexp_extract(claim_text, {_q('(?i)' + pattern)}, {i})"


def _evasive(pairs: str, density: str | None = None) -> str:
    """CTEs that end with ev: the features and score of evasiveness of `pairs`."""
    own = f"({_count(_A, _bounded(lx.MODALS))} + {_count(_A, _bounded(lx.QUALIFIERS))} + {_phrases(_A, lx.UNCERTAINTY)})::DOUBLE / {_words(_A)}"
    return f"""{_terms(True, pairs)},
f AS (SELECT * EXCLUDE (question_text, answer_text), {_Q} = '' OR {_A} = '' AS blank,
  list_filter(list_filter(list_distinct(regexp_extract_all(lower({_Q}), '[\\pL\\pN_]{{4,}}')), lambda w: regexp_full_match(w, '[a-z]+')), lambda w: NOT list_contains({_list(lx.TOPIC_STOP)}, w)) AS q4, list_filter(list_distinct(regexp_extract_all(lower({_A}), '[\\pL\\pN_]{{4,}}')), lambda w: regexp_full_match(w, '[a-z]+')) AS a4,
  list_distinct(regexp_extract_all(lower({_Q}), '[\\pL\\pN_]{{3,}}')) AS q3, list_distinct(regexp_extract_all(lower({_A}), '[\\pL\\pN_]{{3,}}')) AS a3,
  {_patterns(_ascii(_A), lx.DIRECT)} AS direct_count, {_patterns(_ascii(_A), lx.DEFLECTING)} AS deflecting_count, {_patterns(_ascii(_A), lx.GENERIC)} AS generic_count,
  {_words(_A)} AS aw, {_words(_Q)} AS qw, regexp_matches({_ascii(_Q)}, {_q("(?i)" + lx.ASKS_NUMBER)}) AS asks_number, regexp_matches({_ascii(_A)}, {_q("(?i)" + lx.HAS_NUMBER)}) AS has_number, {density or own} AS hd FROM {pairs}),
g AS (SELECT *, CASE WHEN len(q4) = 0 THEN 0.5::DOUBLE ELSE len(list_intersect(q4, a4))::DOUBLE / len(q4) END AS topic, CASE WHEN len(q3) = 0 OR len(a3) = 0 THEN 0::DOUBLE ELSE len(list_intersect(q3, a3))::DOUBLE / len(list_distinct(list_concat(q3, a3))) END AS keyword FROM f JOIN sim USING (qa_id)),
ev AS (SELECT *, CASE WHEN blank THEN 0 ELSE greatest(0, least(100, 20 * (1 - similarity) + 20 * (1 - topic) + 10 * (1 - keyword) + 10 * (1 - least(direct_count / 3.0::DOUBLE, 1)) + 15 * least(deflecting_count / 3.0::DOUBLE, 1)
    + 0.1::DOUBLE * least(hd * 200, 100) + 0.05::DOUBLE * least(generic_count::DOUBLE / aw * 10, 1) * 100 + 0.1::DOUBLE * CASE WHEN asks_number AND NOT has_number THEN 100 ELSE 0 END)) END AS evasive_score FROM g)"""


#: Questions matched to answers: the course of a call step by step.
_MATCHED = f"""seg AS (SELECT transcript_id, segment_id, coalesce(speaker_role, 'unknown') AS role, speaker, {_STRIP("text")} AS x, row_number() OVER (PARTITION BY transcript_id ORDER BY sequence, segment_id) AS i
  FROM {SEGMENTS} WHERE section = 'q_and_a' AND {_STRIP("text")} <> '' AND transcript_id IS NOT NULL),
fold AS (SELECT transcript_id, 0::BIGINT AS i, 'W' AS state, 0 AS pair, CAST(NULL AS VARCHAR) AS part FROM seg GROUP BY transcript_id
  UNION ALL SELECT transcript_id, i, state, pair + CASE WHEN state = 'Q' AND old <> 'Q' THEN 1 ELSE 0 END, CASE WHEN role <> 'operator' AND state <> 'W' THEN state END FROM (
    SELECT s.transcript_id, s.i, f.state AS old, f.pair, s.role, CASE WHEN role = 'operator' THEN CASE WHEN f.state = 'A' THEN 'W' ELSE f.state END
      WHEN role = 'analyst' OR role = 'unknown' AND f.state <> 'A' THEN 'Q' WHEN (role = 'executive' OR role = 'unknown') AND f.state <> 'W' THEN 'A' ELSE f.state END AS state
    FROM fold f JOIN seg s ON s.transcript_id = f.transcript_id AND s.i = f.i + 1)),
sides AS (SELECT f.transcript_id, pair, min_by(segment_id, s.i) FILTER (part = 'Q') AS question_segment_id, min_by(segment_id, s.i) FILTER (part = 'A') AS answer_segment_id,
  string_agg(x, ' ' ORDER BY s.i) FILTER (part = 'Q') AS question_text, string_agg(x, ' ' ORDER BY s.i) FILTER (part = 'A') AS answer_text FROM fold f JOIN seg s USING (transcript_id, i) WHERE part IS NOT NULL GROUP BY f.transcript_id, pair),
qa AS (SELECT format('{{}}_qa_{{:03d}}', transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY pair) - 1) AS qa_id, transcript_id, question_segment_id, answer_segment_id, question_text, answer_text
  FROM sides WHERE length(question_text) >= 20 AND length(answer_text) >= 20)"""

#: The values of the claims.
_VALUED = f"""n0 AS (SELECT claim_id, transcript_id, claim_text, direction, {_case("claim_text", lx.METRICS, "claim_type")} AS metric, coalesce({_num(_ex(lx.RANGE_PERCENT, 1))}, {_num(_ex(lx.RANGE_PERCENT, 3))}) AS lo, coalesce({_num(_ex(lx.RANGE_PERCENT, 2))}, {_num(_ex(lx.RANGE_PERCENT, 4))}) AS hi,
  {_num(_ex(lx.BASIS_POINTS, 1))} AS bp, {_num(_ex(lx.PERCENT, 1))} AS pc, {_num(_ex(lx.DOLLARS, 1))} AS usd, lower({_ex(lx.DOLLARS, 2)}) AS mag, {_case("claim_text", lx.PERIODS, "'unspecified_period'")} AS period, {_case("claim_text", lx.PLACES, "NULL")} AS geography FROM c),
n AS (SELECT *, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (lo + hi) / 2 WHEN bp IS NOT NULL THEN bp WHEN pc IS NOT NULL THEN pc ELSE usd * CASE WHEN mag IN ('billion', 'b') THEN 1e9 WHEN mag IN ('million', 'm') THEN 1e6 WHEN mag IN ('thousand', 'k') THEN 1e3 ELSE 1 END END AS value FROM n0)"""

#: Tone by the word lists, its windows and sections, each from its definition.
_TONE = f"""t0 AS (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM {SENTENCES}),
t1 AS (SELECT * EXCLUDE (w), greatest(len(w), 1) AS n, len(list_filter(w, lambda x: list_contains({_list(lx.TONE_UP)}, x))) AS p, len(list_filter(w, lambda x: list_contains({_list(lx.NEGATIVE)}, x))) AS q FROM t0),
t2 AS (SELECT * EXCLUDE (n, p, q), least(p::DOUBLE / n * 5, 1) AS p, least(q::DOUBLE / n * 5, 1) AS q FROM t1), tone AS (SELECT * EXCLUDE (p, q), p / greatest(p + q, 1) AS positive, q / greatest(p + q, 1) AS negative FROM t2)"""
_WINDOWS = """w0 AS (SELECT *, coalesce(avg(negative) OVER b, 0) AS rm, coalesce(stddev_pop(negative) OVER b, 0) AS rs, lag(negative, 1, 0) OVER o AS previous, row_number() OVER o AS rn FROM tone
  WINDOW o AS (PARTITION BY transcript_id ORDER BY segment_order, sentence_number, sentence_id), b AS (PARTITION BY transcript_id ORDER BY segment_order, sentence_number, sentence_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
win AS (SELECT *, CASE WHEN rn = 1 THEN 0 ELSE least(abs(negative - rm) / (rs + 1e-6) / 3, 1) * 100 END AS shift_score FROM w0)"""
_SECTIONS = """ss AS (SELECT *, abs(q - p) * 100 AS section_shift FROM (
  SELECT transcript_id, coalesce(avg(negative) FILTER (section = 'prepared_remarks'), 0) AS p, coalesce(avg(negative) FILTER (section = 'q_and_a'), 0) AS q FROM tone GROUP BY transcript_id))"""

#: Risk of sentences, pairs and calls, from hedging, tone and evasiveness.
_RISK = f"""{_MATCHED}, {_TONE}, {_WINDOWS}, {_SECTIONS}, {_HEDGE},
fd AS (SELECT segment_id AS answer_segment_id, min_by(hedge_density, (sentence_number, sentence_id)) AS fd FROM h GROUP BY segment_id),
qf AS (SELECT qa.*, coalesce(fd, 0) AS fd FROM qa LEFT JOIN fd USING (answer_segment_id)), {_evasive("qf", "fd")},
la AS (SELECT answer_segment_id AS segment_id, max_by(evasive_score, qa_id) AS evasive FROM ev GROUP BY answer_segment_id),
k0 AS (SELECT h.*, win.negative, win.shift_score, coalesce(la.evasive, 0) AS evasive FROM h JOIN win USING (sentence_id) LEFT JOIN la ON la.segment_id = h.segment_id),
k AS (SELECT *, greatest(0, least(100, CASE WHEN evasive = 0 THEN (0.35::DOUBLE * hedging_score + 0.25::DOUBLE * shift_score) / 0.6::DOUBLE ELSE 0.35::DOUBLE * hedging_score + 0.4::DOUBLE * evasive + 0.25::DOUBLE * shift_score END)) AS risk FROM k0),
am AS (SELECT segment_id AS answer_segment_id, avg(risk) AS ar, avg(hedging_score) AS ah, avg(shift_score) AS ash FROM k GROUP BY segment_id),
pr AS (SELECT qa_id, transcript_id, round(least(100, 0.5::DOUBLE * evasive_score + 0.25::DOUBLE * coalesce(ar, 0) + 0.15::DOUBLE * coalesce(ah, 0) + 0.1::DOUBLE * coalesce(ash, 0)), 2) AS pair_risk FROM ev LEFT JOIN am USING (answer_segment_id))"""


def _top(g: str) -> str:
    """CTEs that end with tr: n, mean, top_mean and blend of the risk by group."""
    return f"""kr AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY risk DESC) AS rn, count(*) OVER (PARTITION BY {g}) AS n FROM k),
tr AS (SELECT *, 0.6::DOUBLE * mean + 0.4::DOUBLE * top_mean AS blend FROM (SELECT {g}, max(n) AS n, avg(risk) AS mean, avg(CASE WHEN rn <= greatest(1, ceil(n * 0.1::DOUBLE)) THEN risk END) AS top_mean FROM kr GROUP BY {g}))"""


def _matches(terms: list[str], most: int) -> str:
    """Up to `most` matches as written, term by term, joined by `|`."""
    parts = [f"regexp_extract_all(coalesce(text, ''), {_q('(?i)' + re.escape(t).replace(chr(92) + ' ', ' '))})" for t in sorted(set(terms), key=lambda t: (-len(t), t))]
    return f"array_to_string(flatten([{', '.join(parts)}])[1:{most}], '|')"


_MATCHES = f"ml AS (SELECT sentence_id, {_matches(lx.MODALS, 10)} AS modals, {_matches(lx.QUALIFIERS, 10)} AS qualifiers, {_matches(lx.UNCERTAINTY, 5)} AS uncertainty, {_matches(lx.DEFLECTION, 5)} AS deflection FROM {SENTENCES})"

ORACLES = {
    "split_segments": f"""
WITH m AS (SELECT segment_id, string_split(regexp_replace(regexp_replace({_STRIP("text")}, '([.!?]+)(\\s+)([A-Z"])', '\\1' || chr(31) || '\\2\\3', 'g'),
    {_q("(?i)(^|[^A-Za-z0-9.\\-])((?:" + _ABBREVIATED + "|[a-z]|[A-Za-z0-9.\\-]*[0-9])\\.*[.!?]+)" + chr(31))}, '\\1\\2', 'g'), chr(31)) AS p FROM {SEGMENTS} WHERE text IS NOT NULL),
s AS (SELECT segment_id, list_filter(list_transform(p, lambda x: {_STRIP("x")}), lambda x: x <> '') AS p FROM m)
SELECT segment_id, CAST(i - 1 AS INTEGER) AS sentence_number, p[i] AS sentence FROM s, LATERAL (SELECT unnest(generate_series(1, len(p))) AS i)""",
    "sentence_hedging": f"WITH {_HEDGE} SELECT sentence_id, CAST(word_count AS INTEGER) AS word_count, CAST(modal_count AS INTEGER) AS modal_count, CAST(qualifier_count AS INTEGER) AS qualifier_count, CAST(uncertainty_count AS INTEGER) AS uncertainty_count, CAST(deflection_count AS INTEGER) AS deflection_count, round(hedge_density, 6) AS hedge_density, round(uncertainty_score, 6) AS uncertainty_score, round(hedging_score, 6) AS hedging_score FROM h",
    "negative_words": f"""
WITH t AS (SELECT transcript_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM {SENTENCES})
SELECT transcript_id, round(avg(CASE WHEN len(w) = 0 THEN 0 ELSE least(100, len(list_filter(w, lambda x: list_contains({_list(lx.NEGATIVE)}, x)))::DOUBLE / len(w) * 500) END), 6) AS negative_score FROM t GROUP BY transcript_id""",
    "sentence_tone": f"WITH {_TONE} SELECT sentence_id, round(positive, 6) AS positive, round(negative, 6) AS negative, round(1 - positive - negative, 6) AS neutral, CASE WHEN 1 - positive - negative >= greatest(positive, negative) THEN 'neutral' WHEN negative >= positive THEN 'negative' ELSE 'positive' END AS label FROM tone",
    "tone_windows": f"WITH {_TONE}, {_WINDOWS} SELECT sentence_id, round(rm, 6) AS rolling_mean, round(rs, 6) AS rolling_std, round(previous, 6) AS previous, round(shift_score, 3) AS shift_score FROM win",
    "tone_sections": f"WITH {_TONE}, {_SECTIONS} SELECT transcript_id, round(p, 6) AS prepared_mean, round(q, 6) AS qa_mean, round(section_shift, 6) AS section_shift FROM ss",
    "pair_similarity": f"WITH {_terms(False)} SELECT qa_id, round(similarity, 6) AS similarity FROM sim",
    "pair_evasiveness": f"""
WITH {_evasive(PAIRS)}
SELECT qa_id, round(CASE WHEN blank THEN 0 ELSE similarity END, 6) AS similarity, round(CASE WHEN blank THEN 0.5 ELSE topic END, 6) AS topic_overlap, round(CASE WHEN blank THEN 0 ELSE keyword END, 6) AS keyword_overlap,
  CAST(direct_count AS INTEGER) AS direct_count, CAST(deflecting_count AS INTEGER) AS deflecting_count, CAST(generic_count AS INTEGER) AS generic_count, round(CASE WHEN blank THEN 1 ELSE aw::DOUBLE / qw END, 6) AS length_ratio, asks_number, has_number, round(evasive_score, 6) AS evasive_score FROM ev""",
    "question_answers": f"WITH RECURSIVE {_MATCHED} SELECT * FROM qa",
    "risk_of_calls": f"""
WITH {_HEDGE}, {_TOP.format(g="transcript_id")},
b AS (SELECT transcript_id, avg(hedging_score) FILTER (section IN ('prepared_remarks', 'opening')) AS prepared, avg(hedging_score) FILTER (section = 'q_and_a') AS qa FROM h GROUP BY transcript_id),
m AS (SELECT transcript_id, segment_id AS worst_segment FROM h QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY hedging_score DESC, segment_order, sentence_number, sentence_id DESC) = 1)
SELECT transcript_id, n, round(mean, 6) AS mean, round(top_mean, 6) AS top_mean, round(0.6::DOUBLE * mean + 0.4::DOUBLE * top_mean, 6) AS blend, round(prepared, 6) AS prepared, round(qa, 6) AS qa, worst_segment FROM t JOIN b USING (transcript_id) JOIN m USING (transcript_id)""",
    "risk_of_segments": f"WITH {_HEDGE}, {_TOP.format(g='segment_id')} SELECT segment_id, n, round(0.6::DOUBLE * mean + 0.4::DOUBLE * top_mean, 6) AS blend FROM t",
    "hedging_matches": f"WITH {_MATCHES} SELECT * FROM ml WHERE modals <> '' OR qualifiers <> '' OR uncertainty <> '' OR deflection <> ''",
    "risk_of_sentences": f"WITH RECURSIVE {_RISK} SELECT sentence_id, round(risk, 3) AS risk, round(evasive, 3) AS evasive FROM k",
    "risk_of_pairs": f"WITH RECURSIVE {_RISK} SELECT qa_id, pair_risk FROM pr",
    "risk_overall": f"""
WITH RECURSIVE {_RISK}, {_top("transcript_id")},
pt AS (SELECT transcript_id, avg(pair_risk) AS asked FROM pr GROUP BY transcript_id),
b AS (SELECT transcript_id, round(coalesce(avg(risk) FILTER (section IN ('prepared_remarks', 'opening')), 0), 2) AS prepared, coalesce(avg(risk) FILTER (section = 'q_and_a'), 0) AS spoken, max_by(segment_id, (risk, -segment_order, -sentence_number)) AS worst_segment FROM k GROUP BY transcript_id),
o AS (SELECT transcript_id, n, round(least(100, round(blend, 2) + least(coalesce(section_shift, 0) * 0.1::DOUBLE, 5)), 2) AS overall, prepared, round(CASE WHEN asked IS NOT NULL THEN 0.5::DOUBLE * spoken + 0.5::DOUBLE * asked ELSE spoken END, 5) AS qa, worst_segment
  FROM tr JOIN b USING (transcript_id) LEFT JOIN pt USING (transcript_id) LEFT JOIN ss USING (transcript_id))
SELECT *, CASE WHEN overall >= 70 THEN 'critical' WHEN overall >= 40 THEN 'high' WHEN overall >= 20 THEN 'moderate' ELSE 'low' END AS band FROM o""",
    "risk_factors": f"""
WITH RECURSIVE {_RISK}, {_MATCHES}
SELECT k.sentence_id, round(risk, 2) AS risk, round(hedging_score, 3) AS hedging_score, round(shift_score, 3) AS tone_shift_score, round(evasive, 3) AS evasive_score, round(k.negative, 3) AS negative_prob, 0.35::DOUBLE AS hedging_weight, 0.4::DOUBLE AS evasive_weight, 0.25::DOUBLE AS shift_weight,
  modals AS matched_modals, qualifiers AS matched_qualifiers, uncertainty AS matched_uncertainty_phrases, deflection AS matched_deflection_phrases, CAST(deflection_count AS INTEGER) AS deflection_count, CAST(uncertainty_count AS INTEGER) AS uncertainty_phrase_count,
  CASE WHEN 1 - positive - tone.negative >= greatest(positive, tone.negative) THEN 'neutral' WHEN tone.negative >= positive THEN 'negative' ELSE 'positive' END AS sentiment_label
FROM k JOIN ml USING (sentence_id) JOIN tone USING (sentence_id)""",
    "segment_summary": f"""
WITH RECURSIVE {_RISK}, {_top("segment_id")},
b AS (SELECT segment_id, round(avg(hedging_score), 2) AS avg_hedging, round(avg(shift_score), 2) AS avg_tone_shift, round(avg(evasive), 2) AS avg_evasive, round(avg(negative), 4) AS avg_negative_prob, round(max(risk), 2) AS max_hidden_risk_in_segment, count(*) AS sentence_count,
  max_by(sentence_id, (risk, -sentence_number)) AS top_risk_sentence_id, substr(max_by(text, (risk, -sentence_number)), 1, 200) AS top_risk_sentence_text FROM k GROUP BY segment_id)
SELECT segment_id, round(blend, 2) AS segment_risk_score, round(mean, 2) AS avg_hidden_risk, round(top_mean, 2) AS top_k_risk, b.* EXCLUDE (segment_id) FROM tr JOIN b USING (segment_id)""",
    "claims": f"WITH {_CLAIM} SELECT * REPLACE (substr(claim_text, 1, 800) AS claim_text) FROM c",
    "claim_values": f"""
WITH {_CLAIM}, {_VALUED}
SELECT claim_id, metric, round(value, 4) AS value, CASE WHEN hi IS NOT NULL THEN round(lo, 4) END AS lower_bound, CASE WHEN lo IS NOT NULL THEN round(hi, 4) END AS upper_bound,
  CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN 'percent' WHEN bp IS NOT NULL THEN 'bps' WHEN pc IS NOT NULL THEN 'percent' WHEN usd IS NOT NULL THEN CASE WHEN mag IN ('billion', 'b') THEN 'usd_billions' WHEN mag IN ('million', 'm') THEN 'usd_millions' ELSE 'usd' END END AS unit, period, geography FROM n""",
    "record_status": """
WITH r AS (SELECT *, upper(trim(symbol)) AS s, CASE WHEN regexp_full_match(upper(trim(quarter)), 'Q?[1-4]') THEN 'Q' || right(trim(quarter), 1) END AS qn FROM sample_transcripts),
e AS (SELECT *, concat_ws('_', nullif(s, ''), CAST(year AS VARCHAR), coalesce(qn, nullif(upper(quarter), '')), nullif(date, '')) AS transcript_id,
  CASE WHEN coalesce(symbol, '') = '' THEN 'missing symbol' WHEN coalesce(date, '') = '' THEN 'missing date' WHEN coalesce(content, '') = '' AND coalesce(len(structured_content), 0) = 0 THEN 'empty transcript'
    WHEN year NOT BETWEEN 1990 AND 2030 THEN 'invalid year' WHEN coalesce(quarter, '') <> '' AND qn IS NULL THEN 'invalid quarter' END AS error FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY record_no) AS nth, transcript_id IN (SELECT transcript_id FROM transcripts WHERE transcript_id IS NOT NULL) AS there FROM e)
SELECT CASE WHEN there OR nth > 1 THEN 'skipped_duplicate' WHEN error IS NOT NULL THEN 'invalid' ELSE 'ok' END AS status, error, count(*) AS n FROM n GROUP BY ALL""",
}
