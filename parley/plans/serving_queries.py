"""Queries that serve scores, evidence and verdicts of calls and companies, and compare systems of labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.text import lm_negative_score
from parley.operators.claims import extract_claims, reasoned, within_days
from parley.operators.evidence_windows import foremost
from parley.operators.market import reaction
from parley.operators.risk import call_risk, pair_risk, section_shift
from parley.operators.statistics import class_measures, confusion, label_between, label_left, pearson, synthetic_label, uniform
from parley.plans import evidence_queries as ev
from parley.plans import text_queries as tx
from parley.plans.base import days, sentences
from parley.plans.sql_text import ORACLE_CALLS

#: Parameters of the lookups, as a caller gives them: tickers, and how many sentences and characters are shown.
TICKERS = ["QSYAG", "XEVWI", "ZIQMN"]
SHOWN, EXCERPT = 50, 300


def _r(c: str, n: int = 6) -> F.Column:
    return F.round(F.col(c).cast("double"), n).alias(c)


def call_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per call: overall, average, hedging, evasiveness, tone shift, prepared and qa risk."""
    s, e = tx._risky(spark, sf_dir, once=True)
    shifts = section_shift(s, group="transcript_id", section="section", value="negative")
    r = call_risk(s, pair_risk(e, s), shifts)
    means = s.groupBy("transcript_id").agg(F.avg("risk").alias("average"), F.avg("hedging_score").alias("hedging"), F.avg("shift_score").alias("tone_shift"))
    asked = e.groupBy("transcript_id").agg(F.avg("evasive_score").alias("evasiveness"))
    j = r.join(means, "transcript_id").join(asked, "transcript_id", "left")
    return j.select("transcript_id", "overall", _r("average"), _r("hedging"), _r("evasiveness"), _r("tone_shift"), "prepared", "qa")


def _rated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev._calls(spark, sf_dir).join(call_scores(spark, sf_dir), "transcript_id", "left")


def company_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per company: calls and the means of its scores, the riskiest first, companies without scores last."""
    j = _rated_calls(spark, sf_dir)
    means = [F.round(F.avg(c), 5).alias(f"avg_{c}") for c in ("overall", "hedging", "evasiveness", "tone_shift")]
    return j.groupBy("ticker", "company_name").agg(F.count_distinct("transcript_id").alias("calls"), *means).orderBy(F.desc_nulls_last("avg_overall"), "ticker", "company_name")


def ticker_comparison(spark: SparkSession, sf_dir: str, tickers: list[str] | None = None) -> DataFrame:
    """The calls of given tickers with their scores, by ticker and latest first."""
    j = _rated_calls(spark, sf_dir).where(F.col("ticker").isin(*(tickers or TICKERS))).join(days(spark, sf_dir).drop("ticker"), "transcript_id", "left")
    return j.select("ticker", "transcript_id", "call_day", "overall", "average", "hedging", "evasiveness", "tone_shift").orderBy("ticker", F.desc_nulls_last("call_day"), "transcript_id")


def average_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean overall risk of all calls, 0 without any."""
    return call_scores(spark, sf_dir).agg(F.round(F.coalesce(F.avg("overall"), F.lit(0.0)), 5).alias("average_risk"), F.count("overall").alias("n"))


def risk_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, call_day, transcript_id, overall of every call with both, in time."""
    j = days(spark, sf_dir).join(call_scores(spark, sf_dir), "transcript_id").where("overall is not null")
    return j.select("ticker", "call_day", "transcript_id", "overall").orderBy("ticker", "call_day", "transcript_id")


def high_risk_sentences(spark: SparkSession, sf_dir: str, above: float = 50.0) -> DataFrame:
    s = tx._risky(spark, sf_dir)[0]
    return s.where(F.col("risk") > above).select("sentence_id", "transcript_id", F.round("risk", 3).alias("risk"))


def call_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first SHOWN sentences of each call in order, the text cut for display: the viewer's page."""
    w = Window.partitionBy("transcript_id").orderBy("segment_order", "sentence_number", "sentence_id")
    s = sentences(spark, sf_dir, "sentence_id", "transcript_id", "segment_order", "sentence_number", "text").withColumn("place", F.row_number().over(w)).where(F.col("place") <= SHOWN)
    return s.select("transcript_id", "place", "sentence_id", F.substring("text", 1, EXCERPT).alias("excerpt"))


def call_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call with its columns and scores; a call without scores keeps its id."""
    return _rated_calls(spark, sf_dir).select("transcript_id", "ticker", "company_name", "year", "sector", "processing_status", "overall", "prepared", "qa")


def section_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each section with the means of hedging and risk."""
    s = tx._risky(spark, sf_dir)[0]
    return s.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hedging_score"), 5).alias("hedging"), F.round(F.avg("risk"), 5).alias("risk"))


# --- evidence and verdicts of claims


def _claims_of(spark: SparkSession, sf_dir: str, tickers: list[str]) -> DataFrame:
    """claim_id of the claims of given tickers: the list that a caller would give."""
    c = extract_claims(sentences(spark, sf_dir)).select("claim_id", "transcript_id")
    return c.join(ev._calls(spark, sf_dir).where(F.col("ticker").isin(*tickers)).select("transcript_id"), "transcript_id", "left_semi").select("claim_id")


def verdicts_of_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of a list of claims."""
    return ev.verdicts(spark, sf_dir).join(_claims_of(spark, sf_dir, TICKERS), "claim_id", "left_semi").select("claim_id", "status", "n_evidence")


def _foremost(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """claim_id, n, best of every claim with evidence of after the call; claims of one ticker and day have the same."""
    c = extract_claims(sentences(spark, sf_dir)).select("claim_id", "transcript_id").join(days(spark, sf_dir), "transcript_id")
    return c.join(foremost(days(spark, sf_dir), ev._after(spark, sf_dir), most=most), ["ticker", "call_day"]).select("claim_id", "n", "best")


def evidence_of_claims(spark: SparkSession, sf_dir: str, most: int = 10) -> DataFrame:
    """For each claim its evidence by authority, the first `most`: the page a reader sees. The rest is counted.

    It is worked out once for the claims of one ticker and day, so no claim is paired with its evidence.
    """
    e = _foremost(spark, sf_dir, most).select("claim_id", F.posexplode("best").alias("at", "e"))
    return e.select("claim_id", (F.col("at") + 1).alias("place"), F.col("e.evidence_id").alias("evidence_id"), F.round("e.authority_score", 6).alias("authority_score"))


def evidence_by_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, how much evidence it has, its best authority and the ids of the first three."""
    first = F.array_join(F.transform("best", lambda x: x["evidence_id"]), ",")
    return _foremost(spark, sf_dir, 3).select("claim_id", "n", F.round(F.col("best")[0]["authority_score"], 6).alias("authority"), first.alias("first_ids"))


def verdicts_by_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, call_day, status, claims and their mean confidence."""
    j = ev._rated(spark, sf_dir).where("ticker IS NOT NULL AND call_day IS NOT NULL")
    return j.groupBy("ticker", "call_day", "status").agg(F.count(F.lit(1)).alias("n_claims"), F.round(F.avg("confidence"), 7).alias("confidence"))


def verdict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, status, reason: a sentence on the signals, and the first three filings whose numbers were compared."""
    v = ev._rated(spark, sf_dir, reasons=True)
    parts = F.array_join(F.transform("parts", lambda x: F.concat(x["evidence_id"], F.lit(": "), x["said"])), " | ")
    return reasoned(v.withColumn("parts", F.when(F.size("parts") > 0, parts))).select("claim_id", "status", "reason")


# --- market and outcomes of calls


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily value of each ticker: the mean relevance of what is published on it, in place of prices."""
    return ev._evidence(spark, sf_dir).where("relevance_score > 0").groupBy("ticker", F.col("published").alias("day")).agg(F.avg("relevance_score").alias("value"))


def call_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes and volatility of the ticker's daily value around each call."""
    d = days(spark, sf_dir)
    r = reaction(d, _series(spark, sf_dir), entity="ticker", event_day="call_day", day="day", value="value")
    return d.join(r, ["ticker", "call_day"]).select("transcript_id", *[_r(c, 5) for c in r.columns if c.startswith(("change", "vol"))])


def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of the day before and of the day of each call or after it, and the change in percent; null without both."""
    d, s = days(spark, sf_dir), _series(spark, sf_dir)
    r = reaction(d, s, entity="ticker", event_day="call_day", day="day", value="value").select("ticker", "call_day", "day_before", "day_after")
    before = s.select("ticker", F.col("day").alias("day_before"), F.col("value").alias("before"))
    after = s.select("ticker", F.col("day").alias("day_after"), F.col("value").alias("after"))
    j = d.join(r, ["ticker", "call_day"]).join(before, ["ticker", "day_before"], "left").join(after, ["ticker", "day_after"], "left")
    return j.select("transcript_id", _r("before"), _r("after"), F.round(F.try_divide(F.col("after") - F.col("before"), F.col("before")) * 100, 4).alias("change"))


def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and filings of given tickers, in time."""
    d = days(spark, sf_dir).where(F.col("ticker").isin(*TICKERS)).select("ticker", F.col("call_day").alias("day"), F.lit("call").alias("kind"), F.col("transcript_id").alias("id"))
    e = ev._evidence(spark, sf_dir).where(F.col("ticker").isin(*TICKERS) & F.col("filing_type").isin(*ev.FORMS)).select("ticker", F.col("published").alias("day"), F.col("filing_type").alias("kind"), F.col("evidence_id").alias("id"))
    return d.unionByName(e).orderBy("ticker", "day", "id")


def baseline_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame that systems are compared on: scores of each call with word-ratio score, sentences, reaction and fact."""
    s = sentences(spark, sf_dir, "sentence_id", "transcript_id", "text")
    lm = s.groupBy("transcript_id").agg(F.avg(lm_negative_score(F.col("text"))).alias("lm_score"), F.count(F.lit(1)).alias("sentence_count"))
    d, best = days(spark, sf_dir), Window.partitionBy("transcript_id").orderBy(F.desc("published"), F.desc("evidence_id"))
    facts = ev._evidence(spark, sf_dir).where("filing_type = '10-K'").select("ticker", "published", "evidence_id", "relevance_score")
    fact = within_days(d, facts, entity="ticker", left_day="call_day", right_day="published", before=120, after=0).withColumn("k", F.row_number().over(best)).where("k = 1").select("transcript_id", F.col("relevance_score").alias("fact"))
    j = d.join(call_scores(spark, sf_dir), "transcript_id").join(lm, "transcript_id", "left").join(call_reactions(spark, sf_dir).select("transcript_id", "change_5d", "volatility_5d"), "transcript_id", "left").join(fact, "transcript_id", "left")
    return j.select("transcript_id", "ticker", "call_day", "overall", F.col("hedging").alias("hedging_only"), F.col("tone_shift").alias("tone_only"), _r("lm_score"), "sentence_count", "change_5d", "volatility_5d", _r("fact"))


def risk_against_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of four scores of the calls with the seven figures of the reaction."""
    j = call_scores(spark, sf_dir).join(call_reactions(spark, sf_dir), "transcript_id")
    ys = [c for c in j.columns if c.startswith(("change", "vol"))]
    return pearson(j, ["overall", "hedging", "evasiveness", "tone_shift"], ys).select("x", "y", "n", _r("r", 4))


# --- systems of labelling


def system_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 by class of four systems: random by the classes' shares, two of hedging, evasiveness."""
    v = ev._labelled(spark, sf_dir).where("evasive is not null")
    n = v.agg(*[F.avg((F.col("label") == k).cast("double")).alias(f"p{k}") for k in range(2)])  # one row
    u = uniform(F.concat_ws("|", "qa_id", "a"))
    # The shares are one row, joined by a constant key.
    w = v.withColumn("_one", F.lit(1)).join(F.broadcast(n.withColumn("_one", F.lit(1))), "_one")
    random = F.when(u < F.col("p0"), 0).when(u < F.col("p0") + F.col("p1"), 1).otherwise(2)
    hedge = F.coalesce("hedging", F.lit(0.0))
    systems = {"random": random, "hedging_tone": label_between(hedge, 15, 35), "hedging_only": label_between(hedge, 20, 50), "proposed": label_between(F.col("evasive"), 20, 50)}
    guesses = w.select("label", F.inline(F.array(*[F.struct(F.lit(k).alias("system"), g.alias("guess")) for k, g in systems.items()])))
    out = None
    for name in systems:
        m = class_measures(confusion(guesses.where(F.col("system") == name), truth="label", guess="guess")).withColumn("system", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("system", "label", _r("precision"), _r("recall"), _r("f1"), "support")


def synthetic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ev._measures(spark, sf_dir)
    left = label_left(F.col("evasive"))
    return m.select("qa_id", left.alias("label"), synthetic_label(left, F.col("qa_id")).alias("noisy"))


QUERIES = {f.__name__: f for f in (
    call_scores, company_scores, ticker_comparison, average_risk, risk_trend, high_risk_sentences, call_sentences, call_detail, section_averages, verdicts_of_claims, evidence_of_claims, evidence_by_claim, verdicts_by_call,
    verdict_reasons, call_reactions, price_changes, event_timeline, baseline_frame, risk_against_market, system_comparison, synthetic_labels,
)}

from parley.plans.evidence_queries import _EV, _FULL, _M, _VALID, _reaction  # noqa: E402
from parley.plans.text_queries import _CLAIM, _RISK, _VALUED, _list, _top  # noqa: E402

_CS = f"""{_top("transcript_id")}, pt AS (SELECT transcript_id, avg(pair_risk) AS asked FROM pr GROUP BY transcript_id), et AS (SELECT transcript_id, avg(evasive_score) AS evasiveness FROM ev GROUP BY transcript_id),
b AS (SELECT transcript_id, round(coalesce(avg(risk) FILTER (section IN ('prepared_remarks', 'opening')), 0), 2) AS prepared, coalesce(avg(risk) FILTER (section = 'q_and_a'), 0) AS spoken, avg(risk) AS average, avg(hedging_score) AS hedging, avg(shift_score) AS tone_shift FROM k GROUP BY transcript_id),
cs AS (SELECT transcript_id, round(least(100, round(blend, 2) + least(coalesce(section_shift, 0) * 0.1::DOUBLE, 5)), 2) AS overall, round(average, 6) AS average, round(hedging, 6) AS hedging, round(evasiveness, 6) AS evasiveness, round(tone_shift, 6) AS tone_shift, prepared, round(CASE WHEN asked IS NOT NULL THEN 0.5::DOUBLE * spoken + 0.5::DOUBLE * asked ELSE spoken END, 5) AS qa
  FROM tr JOIN b USING (transcript_id) LEFT JOIN pt USING (transcript_id) LEFT JOIN et USING (transcript_id) LEFT JOIN ss USING (transcript_id))"""
_SCORED = f"WITH RECURSIVE {_RISK}, {_CS}"
_VALID_ALL = _VALID.replace("company_name, processing_status FROM", "company_name, year, sector, processing_status FROM")
#: Evidence under another name than the pairs' scores, which are ev above.
_E = f"e AS (WITH {_EV} SELECT evidence_id, ticker, {_FULL} FROM ev WHERE ticker IS NOT NULL)"
_D = f"{ORACLE_CALLS}, cd AS (SELECT transcript_id, ticker, CAST(instant AS DATE) AS call_day FROM calls)"
_LINK = f"""{_CLAIM}, {_D}, {_E}, links AS (SELECT claim_id, transcript_id, evidence_id, authority_score, source_type, published FROM c JOIN cd USING (transcript_id) JOIN e USING (ticker)
  WHERE published BETWEEN call_day + 1 AND call_day + 365 AND (coalesce(filing_type IN ('10-K', '10-Q', '8-K'), false) OR source_type = 'news' AND published - call_day <= 180))"""
_VALUES = f"SELECT ticker, published AS day, avg(relevance_score) AS value FROM (WITH {_EV} SELECT ticker, relevance_score, CAST(instant AS DATE) AS published FROM ev WHERE ticker IS NOT NULL AND relevance_score > 0) GROUP BY ALL"
_CALL_EVENTS = f"SELECT DISTINCT ticker, CAST(instant AS DATE) AS event_day FROM (WITH {ORACLE_CALLS} SELECT * FROM calls)"
_MOVES = ", ".join(f"round(CASE WHEN ok THEN (v{k} - bv) / bv END, 5) AS change_{k}d" for k in (1, 5, 10, 20)) + ", " + ", ".join(f"round(CASE WHEN ok THEN s{k} END, 5) AS volatility_{k}d" for k in (5, 10, 20))
_REACTED = f"rx AS (SELECT transcript_id, {_MOVES} FROM cd JOIN {_reaction(_VALUES, _CALL_EVENTS)} x ON cd.ticker = x.ticker AND cd.call_day = x.event_day)"
_UNIFORM = "('0x' || substr(md5({x}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _between(x: str, low: int, high: int) -> str:
    return f"CASE WHEN {x} <= {low} THEN 0 WHEN {x} <= {high} THEN 1 ELSE 2 END"


_T = _list(TICKERS)
_IDF = "power(1 + ln(1.5::DOUBLE), 2)"


def _weights(key: str, text: str, source: str) -> str:
    """Words of a text, stop words left out, with 1 + ln(count)."""
    return f"SELECT {key}, term, 1 + ln(count(*)) AS w FROM (SELECT {key}, unnest(list_filter(regexp_extract_all(lower({text}), '[\\pL\\pN_]{{2,}}'), lambda x: NOT list_contains({_list(tx.lx.STOP_WORDS)}, x))) AS term FROM {source}) GROUP BY ALL"


_VERDICTS = f"""{_LINK}, {_VALUED}, es AS (SELECT evidence_id, concat_ws(' ', title, text) AS said FROM e WHERE evidence_id IN (SELECT evidence_id FROM links)),
sg AS (SELECT evidence_id, list_filter(list_transform(regexp_extract_all(said, '[-+]?\\d+[\\.,]?\\d*'), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL) AS numbers, regexp_matches(lower(said), {tx._q(tx.lx.POSITIVE)}) AS pos, regexp_matches(lower(said), {tx._q(tx.lx.NEGATIVE_SIGNS)}) AS neg FROM es),
ct AS ({_weights("claim_id", "claim_text", "c")}), et AS ({_weights("evidence_id", "said", "es")}),
cn AS (SELECT claim_id, sum(w * w) AS t FROM ct GROUP BY claim_id), en AS (SELECT evidence_id, sum(w * w) AS t FROM et GROUP BY evidence_id),
ps AS (SELECT l.claim_id, l.evidence_id, sum(c.w * e.w) AS d, sum(c.w * c.w) AS sl, sum(e.w * e.w) AS sr FROM links l JOIN ct c ON c.claim_id = l.claim_id JOIN et e ON e.evidence_id = l.evidence_id AND e.term = c.term GROUP BY ALL),
y0 AS (SELECT l.*, n.value, n.direction, numbers, pos, neg, l.source_type = 'sec' AS filing, list_min(list_transform(numbers, lambda x: abs(x - n.value) / abs(n.value))) AS apart,
  coalesce(d / (sqrt({_IDF} * cn.t + (1 - {_IDF}) * sl) * sqrt({_IDF} * en.t + (1 - {_IDF}) * sr)), 0) AS likeness
  FROM links l JOIN n USING (claim_id) JOIN sg USING (evidence_id) LEFT JOIN ps ON ps.claim_id = l.claim_id AND ps.evidence_id = l.evidence_id LEFT JOIN cn ON cn.claim_id = l.claim_id LEFT JOIN en ON en.evidence_id = l.evidence_id),
y1 AS (SELECT *, CASE WHEN value IS NULL OR len(numbers) = 0 THEN NULL WHEN value = 0 OR apart > 0.5 THEN 0 WHEN apart <= 0.1 THEN 1 WHEN apart <= 0.25 THEN 0.5 ELSE 0.2 END::DOUBLE AS near,
  CASE WHEN direction IN ('increase', 'grow') THEN CASE WHEN pos AND NOT neg THEN 1 WHEN neg AND NOT pos THEN 0 ELSE 0.5 END WHEN direction = 'decrease' THEN CASE WHEN neg AND NOT pos THEN 1 WHEN pos AND NOT neg THEN 0 ELSE 0.5 END WHEN direction = 'flat' THEN CASE WHEN NOT pos AND NOT neg THEN 1 ELSE 0.5 END END::DOUBLE AS way,
  CASE WHEN filing THEN 1 WHEN authority_score >= 0.7 THEN 0.75 WHEN authority_score >= 0.45 THEN 0.5 ELSE 0.25 END::DOUBLE AS w FROM y0),
y2 AS (SELECT *, CASE WHEN NOT filing AND likeness >= 0.2 THEN CASE WHEN way IS NOT NULL THEN (likeness + way) / 2 ELSE likeness END END AS news FROM y1),
y3 AS (SELECT *, CASE WHEN filing AND near IS NOT NULL THEN CASE WHEN near >= 0.8 THEN near WHEN near >= 0.4 THEN 0.5 ELSE 0 END WHEN filing AND way IS NOT NULL THEN CASE WHEN way >= 0.8 THEN way WHEN way <= 0.2 THEN 0 ELSE 0.4 END WHEN filing THEN CASE WHEN likeness >= 0.3 THEN likeness ELSE 0 END WHEN news >= 0.5 THEN news WHEN news >= 0.25 THEN 0.4 ELSE 0 END::DOUBLE AS sup,
  CASE WHEN filing AND near IS NOT NULL THEN CASE WHEN near >= 0.8 THEN 0 WHEN near >= 0.4 THEN 0.3 ELSE 1 END WHEN filing THEN CASE WHEN way <= 0.2 THEN 1 ELSE 0 END WHEN news < 0.5 AND news >= 0.25 THEN 0.2 ELSE 0 END::DOUBLE AS con, CASE WHEN filing OR news IS NOT NULL THEN w ELSE 0 END AS counted FROM y2),
ag AS (SELECT claim_id, count(*) AS n_evidence, sum(sup * w) / nullif(sum(counted), 0) AS sup, sum(con * w) / nullif(sum(counted), 0) AS con FROM y3 GROUP BY claim_id),
vd AS (SELECT c.claim_id, c.transcript_id, coalesce(n_evidence, 0) AS n_evidence, coalesce(sup, 0) AS support, coalesce(con, 0) AS contradiction FROM c LEFT JOIN ag USING (claim_id)),
vs AS (SELECT *, CASE WHEN n_evidence = 0 THEN 'NOT_VERIFIABLE' WHEN support >= 0.6 AND contradiction < 0.2 THEN 'SUPPORTED' WHEN contradiction >= 0.6 AND support < 0.2 THEN 'CONTRADICTED' WHEN support >= 0.3 OR contradiction >= 0.3 THEN 'PARTIALLY_SUPPORTED' ELSE 'NOT_VERIFIABLE' END AS status FROM vd),
vf AS (SELECT *, CASE WHEN n_evidence = 0 THEN 0.2 WHEN status = 'SUPPORTED' THEN least(0.5 + support * 0.5, 0.95) WHEN status = 'CONTRADICTED' THEN least(0.5 + contradiction * 0.5, 0.95) WHEN status = 'PARTIALLY_SUPPORTED' THEN 0.45 + abs(support - contradiction) * 0.3 ELSE 0.25 END::DOUBLE AS confidence FROM vs)"""
ORACLES = {
    "call_scores": f"{_SCORED} SELECT * FROM cs",
    "company_scores": f"{_SCORED}, {_VALID} SELECT ticker, company_name, count(DISTINCT transcript_id) AS calls, round(avg(overall), 5) AS avg_overall, round(avg(hedging), 5) AS avg_hedging, round(avg(evasiveness), 5) AS avg_evasiveness, round(avg(tone_shift), 5) AS avg_tone_shift FROM v LEFT JOIN cs USING (transcript_id) GROUP BY ALL",
    "ticker_comparison": f"{_SCORED}, {_VALID}, {_D} SELECT v.ticker, v.transcript_id, call_day, overall, average, hedging, evasiveness, tone_shift FROM v LEFT JOIN cs USING (transcript_id) LEFT JOIN cd ON cd.transcript_id = v.transcript_id WHERE list_contains({_T}, v.ticker)",
    "average_risk": f"{_SCORED} SELECT round(coalesce(avg(overall), 0), 5) AS average_risk, count(overall) AS n FROM cs",
    "risk_trend": f"{_SCORED}, {_D} SELECT ticker, call_day, transcript_id, overall FROM cd JOIN cs USING (transcript_id) WHERE overall IS NOT NULL",
    "high_risk_sentences": f"WITH RECURSIVE {_RISK} SELECT sentence_id, transcript_id, round(risk, 3) AS risk FROM k WHERE risk > 50",
    "call_sentences": f"SELECT transcript_id, CAST(place AS INTEGER) AS place, sentence_id, substr(text, 1, {EXCERPT}) AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY segment_order, sentence_number, sentence_id) AS place FROM {tx.SENTENCES}) WHERE place <= {SHOWN}",
    "call_detail": f"{_SCORED}, {_VALID_ALL} SELECT transcript_id, ticker, company_name, year, sector, processing_status, overall, prepared, qa FROM v LEFT JOIN cs USING (transcript_id)",
    "section_averages": f"WITH RECURSIVE {_RISK} SELECT section, count(*) AS n, round(avg(hedging_score), 5) AS hedging, round(avg(risk), 5) AS risk FROM k GROUP BY section",
    "evidence_of_claims": f"WITH {_LINK} SELECT claim_id, CAST(place AS INTEGER) AS place, evidence_id, round(authority_score, 6) AS authority_score FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY authority_score DESC NULLS LAST, evidence_id) AS place FROM links) WHERE place <= 10",
    "evidence_by_claim": f"WITH {_LINK}, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY authority_score DESC NULLS LAST, evidence_id) AS place FROM links) SELECT claim_id, count(*) AS n, round(max(authority_score), 6) AS authority, string_agg(evidence_id, ',' ORDER BY place) FILTER (place <= 3) AS first_ids FROM r GROUP BY claim_id",
    "verdicts": f"WITH {_VERDICTS} SELECT claim_id, status, n_evidence, round(support, 7) AS support, round(contradiction, 7) AS contradiction, round(confidence, 7) AS confidence FROM vf",
    "verdict_shares": f"WITH {_VERDICTS} SELECT status, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER ()::DOUBLE, 4) AS share FROM vf GROUP BY status",
    "verdicts_of_claims": f"WITH {_VERDICTS}, {_VALID} SELECT claim_id, status, n_evidence FROM vf JOIN v USING (transcript_id) WHERE list_contains({_T}, v.ticker)",
    "verdicts_by_call": f"WITH {_VERDICTS} SELECT ticker, call_day, status, count(*) AS n_claims, round(avg(confidence), 7) AS confidence FROM vf JOIN cd USING (transcript_id) GROUP BY ALL",
    "call_reactions": f"WITH {_D}, {_REACTED} SELECT * FROM rx",
    "price_changes": f"WITH {_D}, s AS ({_VALUES}), x AS (SELECT * FROM {_reaction(_VALUES, _CALL_EVENTS)}) SELECT transcript_id, round(CASE WHEN ok THEN x.bv END, 6) AS before, round(CASE WHEN ok THEN a.value END, 6) AS after, round(CASE WHEN ok THEN (a.value - x.bv) / x.bv END * 100, 4) AS change FROM cd JOIN x ON cd.ticker = x.ticker AND cd.call_day = x.event_day LEFT JOIN s a ON a.ticker = x.ticker AND a.day = x.ad",
    "event_timeline": f"WITH {_D}, {_E} SELECT ticker, call_day AS day, 'call' AS kind, transcript_id AS id FROM cd WHERE list_contains({_T}, ticker) UNION ALL SELECT ticker, published, filing_type, evidence_id FROM e WHERE list_contains({_T}, ticker) AND filing_type IN ('10-K', '10-Q', '8-K')",
    "baseline_frame": f"""{_SCORED}, {_D}, {_REACTED}, {_E},
lw AS (SELECT transcript_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM {tx.SENTENCES}),
lm AS (SELECT transcript_id, avg(CASE WHEN len(w) = 0 THEN 0 ELSE least(100, len(list_filter(w, lambda x: list_contains({_list(tx.lx.NEGATIVE)}, x)))::DOUBLE / len(w) * 500) END) AS lm_score, count(*) AS sentence_count FROM lw GROUP BY transcript_id),
fa AS (SELECT transcript_id, relevance_score AS fact FROM cd JOIN e USING (ticker) WHERE filing_type = '10-K' AND published BETWEEN call_day - 120 AND call_day QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY published DESC, evidence_id DESC) = 1)
SELECT transcript_id, ticker, call_day, overall, hedging AS hedging_only, tone_shift AS tone_only, round(lm_score, 6) AS lm_score, sentence_count, change_5d, volatility_5d, round(fact, 6) AS fact FROM cd JOIN cs USING (transcript_id) LEFT JOIN lm USING (transcript_id) LEFT JOIN rx USING (transcript_id) LEFT JOIN fa USING (transcript_id)""",
    "risk_against_market": f"{_SCORED}, {_D}, {_REACTED}, j AS (SELECT * FROM cs JOIN rx USING (transcript_id)) " + " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n, round(corr({x}, {y}), 4) AS r FROM j"
        for x in ("overall", "hedging", "evasiveness", "tone_shift") for y in ("change_1d", "change_5d", "change_10d", "change_20d", "volatility_5d", "volatility_10d", "volatility_20d")
    ),
    "system_comparison": f"""
WITH {_M}, v AS (SELECT * FROM one WHERE evasive IS NOT NULL), p AS (SELECT avg((label = 0)::INTEGER::DOUBLE) AS p0, avg((label = 1)::INTEGER::DOUBLE) AS p1 FROM v),
u AS (SELECT *, {_UNIFORM.format(x="concat_ws('|', qa_id, who)")} AS u, coalesce(hedging, 0) AS hh FROM v, p),
g AS (SELECT 'random' AS system, label, CASE WHEN u < p0 THEN 0 WHEN u < p0 + p1 THEN 1 ELSE 2 END AS guess FROM u UNION ALL SELECT 'hedging_tone', label, {_between("hh", 15, 35)} FROM u UNION ALL SELECT 'hedging_only', label, {_between("hh", 20, 50)} FROM u UNION ALL SELECT 'proposed', label, {_between("evasive", 20, 50)} FROM u),
c AS (SELECT system, x AS label, count(*) FILTER (g.label = x AND guess = x) AS hit, count(*) FILTER (g.label = x) AS support, count(*) FILTER (guess = x) AS guessed FROM g, (VALUES (0), (1), (2)) k(x) GROUP BY ALL),
mm AS (SELECT *, CASE WHEN guessed > 0 THEN hit::DOUBLE / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0 END AS recall FROM c)
SELECT system, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, support FROM mm""",
    "synthetic_labels": f"WITH {_M}, l AS (SELECT qa_id, CASE WHEN evasive < 20 THEN 0 WHEN evasive < 50 THEN 1 WHEN evasive IS NOT NULL THEN 2 END AS label, {_UNIFORM.format(x='qa_id || ' + chr(39) + '|42' + chr(39))} AS u FROM m) SELECT qa_id, label, CASE WHEN label IS NULL THEN NULL ELSE greatest(0, least(2, CASE WHEN u < 0.08 THEN label + 1 WHEN u < 0.15 THEN label - 1 ELSE label END)) END AS noisy FROM l",
}
