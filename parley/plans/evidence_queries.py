"""Queries on evidence and calls in time, series around events, statistics, and the serving queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.instants import plain_ticker
from parley.operators.calls import call_times, evidence_times
from parley.operators.claims import concluded, evidence_signs, extract_claims, leaks, normalized, temporal_category, within_days
from parley.operators.evidence_windows import rated
from parley.operators.latest import latest_per_key, or_prefix
from parley.operators.market import abnormal, latest_within, reaction
from parley.operators.risk import hedging
from parley.operators.statistics import (
    average_ranks, bootstrap_macro_f1, class_measures, cohens_kappa, confusion, correlation, descriptives, group_compare, label_left, label_right, least_squares, outcome_compare, overall_measures, pearson, quartile_compare, signed_rank, spearman,
    time_split,
)
from parley.plans.base import SENTENCES, days, pairs, sentences
from parley.plans.sql_text import ORACLE_CALLS, oracle_evidence
from parley.sources.tables import table

FORMS = ["10-K", "10-Q", "8-K"]


def _r(c: str, n: int = 6) -> F.Column:
    return F.round(F.col(c).cast("double"), n).alias(c)


def _day() -> F.Column:
    return F.to_date(F.timestamp_micros("at")).alias("published")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = {c: F.col(c) for c in ("source_type", "source_name", "source_url", "title", "text", "filing_type", "relevance_score", "authority_score")}
    return evidence_times(table(spark, sf_dir, "retrieved_evidence"), extra).select("evidence_id", "ticker", _day(), *extra)


def evidence_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per call and category: filings of the ticker from 180 days before to 365 after, and the mean authority.

    Filings of one ticker and day are added up before they meet the calls.
    """
    filings = _evidence(spark, sf_dir).where(F.col("filing_type").isin(*FORMS))
    daily = filings.groupBy("ticker", "published").agg(F.count(F.lit(1)).alias("k"), F.sum("authority_score").alias("a"))
    met = within_days(days(spark, sf_dir), daily, entity="ticker", left_day="call_day", right_day="published", before=180, after=365)
    cat = met.withColumn("category", temporal_category(F.col("published"), F.col("call_day")))
    return cat.groupBy("transcript_id", "category").agg(F.sum("k").alias("n"), F.round(F.sum("a") / F.sum("k"), 6).alias("authority"))


def evidence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    return e.groupBy("source_type", "filing_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("authority_score"), 6).alias("authority"), F.min("published").alias("first_day"), F.max("published").alias("last_day"))


def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of after the call whose url or first words the call's text holds."""
    valid = latest_per_key(table(spark, sf_dir, "transcripts").select("transcript_id", "created_at", "raw_text"), "transcript_id", "created_at", ["raw_text"])
    e = _evidence(spark, sf_dir)
    found = leaks(valid.select("transcript_id", F.col("raw_text").alias("text")), e.select("evidence_id", F.col("source_url").alias("url"), "text"))
    late = found.join(days(spark, sf_dir), "transcript_id").join(e.select("evidence_id", "published"), "evidence_id").where(F.col("published") > F.col("call_day"))
    return late.select("transcript_id", "evidence_id", "by")


def _links(spark: SparkSession, sf_dir: str, claims: DataFrame) -> DataFrame:
    """`claims` (transcript_id left out) with their evidence of after the call: filings of a year and all news of 180 days."""
    e = _evidence(spark, sf_dir).select("evidence_id", "ticker", "published", "source_type", "filing_type", "relevance_score", "authority_score", F.concat_ws(" ", "title", "text").alias("said"))
    e = evidence_signs(e, text="said").drop("said")
    met = within_days(claims.join(days(spark, sf_dir), "transcript_id"), e, entity="ticker", left_day="call_day", right_day="published", before=-1, after=365)
    filings = F.coalesce(F.col("filing_type").isin(*FORMS), F.lit(False))
    news = (F.col("source_type") == "news") & (F.datediff("published", "call_day") <= 180)
    return met.where(filings | news).select(*[c for c in claims.columns if c != "transcript_id"], "evidence_id", "source_type", "authority_score", "numbers", "pos", "neg", "terms")


def _after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that can meet claims, with the days after a call that it does: filings a year, news 180 days."""
    filings, news = F.coalesce(F.col("filing_type").isin(*FORMS), F.lit(False)), F.col("source_type") == "news"
    lasts = F.when(filings, 365).when(news, 180)
    e = _evidence(spark, sf_dir).select("evidence_id", "ticker", "published", lasts.alias("lasts"), "source_type", "authority_score", F.concat_ws(" ", "title", "text").alias("said"))
    return e.where("lasts IS NOT NULL")


def _rated(spark: SparkSession, sf_dir: str, *, reasons: bool = False) -> DataFrame:
    """Every claim, with ticker and day of its call, and its verdict."""
    c = normalized(extract_claims(sentences(spark, sf_dir)), text="claim_text", default="claim_type").select("transcript_id", "claim_id", "claim_text", "value", "direction")
    return concluded(rated(c.join(days(spark, sf_dir), "transcript_id", "left"), _after(spark, sf_dir), reasons=reasons))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).select("claim_id", "status", "n_evidence", _r("support", 7), _r("contradiction", 7), _r("confidence", 7))


def verdict_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, number and share in percent: a window over the groups."""
    g = verdicts(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return g.select("status", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("value"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 300000")
    return o.select(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("event_day")).distinct()


def series_reaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes and volatility of the daily mean price of each priority around the days of large orders."""
    r = reaction(_events(spark, sf_dir), _series(spark, sf_dir), entity="ticker", event_day="event_day", day="day", value="value")
    return r.select("ticker", "event_day", "day_before", "day_after", *[_r(c) for c in r.columns if c.startswith(("change", "vol"))])


def series_abnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    own = reaction(events, _series(spark, sf_dir), entity="ticker", event_day="event_day", day="day", value="value")
    market = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("value")).withColumn("ticker", F.lit("all"))
    bench = reaction(events.select(F.lit("all").alias("ticker"), "event_day"), market, entity="ticker", event_day="event_day", day="day", value="value")
    return abnormal(own, bench, event_day="event_day").select("ticker", "event_day", _r("abnormal_5d"), _r("abnormal_10d"))


def latest_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's balance-like fact: the latest order's price at most 120 days before each shipped return."""
    o = table(spark, sf_dir, "orders")
    facts = o.groupBy(F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("price"))
    events = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("cust"), F.date_add(F.to_date("o_orderdate"), 30).alias("event_day"))
    return latest_within(facts, events, entity="cust", event_day="event_day", day="day", value="price", lookback=120)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, a (annotator), label and scores of every valid human label: the latest of each pair and annotator."""
    a = table(spark, sf_dir, "annotations").where("evaluation_type = 'human' AND label_evasive BETWEEN 0 AND 2")
    key = F.lower(F.trim(F.translate("annotator_id", "-", "_")))
    one = a.withColumn("a", key).groupBy("qa_id", "a").agg(
        F.max(F.struct("labelled_at", "label_evasive")).alias("m"), F.max("auto_evasiveness_score").alias("evasive"), F.max("auto_hedging_score").alias("hedging"), F.max("auto_hidden_risk_score").alias("risk"), F.max("date").alias("date")
    )
    return one.withColumn("label", F.col("m.label_evasive")).drop("m")


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, scores and date of each labelled pair."""
    return _labelled(spark, sf_dir).groupBy("qa_id").agg(*[F.max(c).alias(c) for c in ("evasive", "hedging", "risk", "date")])


def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """truth, guess, n of the labels of every two annotators of a pair, the one with the smaller id first.

    Each label meets the counts of the labels before it, so a pair's work grows with its annotators, not their square.
    """
    before = Window.partitionBy("qa_id").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    met = [F.struct(F.lit(k).alias("truth"), F.coalesce(F.sum((F.col("label") == k).cast("bigint")).over(before), F.lit(0)).alias("n")) for k in range(3)]
    counts = _labelled(spark, sf_dir).select(F.col("label").alias("guess"), F.array(*met).alias("met")).select("guess", F.inline("met"))
    return counts.groupBy("truth", "guess").agg(F.sum("n").alias("n"))


def label_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(_labelled(spark, sf_dir).withColumn("guess", label_right(F.col("evasive"))), truth="label", guess="guess")


def label_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = class_measures(label_matrix(spark, sf_dir))
    return m.select("label", _r("precision"), _r("recall"), _r("f1"), "support")


def label_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = overall_measures(label_matrix(spark, sf_dir))
    return m.select(*[_r(c) for c in m.columns])


def annotator_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = cohens_kappa(_agreement(spark, sf_dir))
    return k.select("n", _r("observed"), _r("expected"), _r("kappa"))


def label_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measures(spark, sf_dir).select(time_split(F.substring("date", 1, 10)).alias("split"), label_left(F.col("evasive")).alias("label"))
    return m.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def score_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's and Spearman's correlation of evasiveness and label, with p and resampled interval."""
    v = _labelled(spark, sf_dir)
    rows = [correlation(v, "evasive", "label", ranks=k).withColumn("kind", F.lit(n)) for n, k in (("pearson", False), ("spearman", True))]
    return rows[0].unionByName(rows[1])


def score_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pairs above and below the median of evasiveness, with the rank test and its p."""
    return outcome_compare(_labelled(spark, sf_dir), by="evasive", value="label")


def macro_f1_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap_macro_f1(_labelled(spark, sf_dir).withColumn("guess", label_right(F.col("evasive"))), truth="label", guess="guess")


def score_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pearson(_labelled(spark, sf_dir), ["evasive", "hedging", "risk"], ["label"])
    return m.select("x", "y", "n", _r("r"))


def score_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spearman(_labelled(spark, sf_dir), "evasive", "label").select("n", _r("rho"))


def score_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return average_ranks(_measures(spark, sf_dir).select("qa_id", "evasive"), "evasive", "rank").select("qa_id", F.col("rank").cast("double").alias("rank"))


def score_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = least_squares(_labelled(spark, sf_dir).withColumn("label", F.col("label").cast("double")), y="label", xs=["evasive"])
    return m.select("term", _r("estimate"), _r("r_squared"))


def score_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quartile_compare(_labelled(spark, sf_dir).withColumn("label", F.col("label").cast("double")), by="evasive", value="label")
    return m.select(*[_r(c) for c in m.columns])


def score_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = group_compare(_labelled(spark, sf_dir).withColumn("g", F.col("label") == 2), group="g", value="evasive")
    return m.select(*[_r(c, 8) for c in m.columns])


def paired_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = signed_rank(_measures(spark, sf_dir), "evasive", "hedging")
    return m.select("n", _r("w"), _r("z"))


def score_descriptives(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = descriptives(_measures(spark, sf_dir), ["evasive", "hedging", "risk"])
    return m.select("name", "n", *[_r(c) for c in m.columns if c not in ("name", "n")])


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid row of each transcript with plain ticker."""
    t = table(spark, sf_dir, "transcripts")
    keep = ["ticker", "company_name", "year", "sector", "processing_status"]
    one = latest_per_key(t.select("transcript_id", "created_at", *keep), "transcript_id", "created_at", keep)
    return one.withColumn("ticker", or_prefix(plain_ticker(F.col("ticker")), F.col("transcript_id")))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hedging(sentences(spark, sf_dir), "text").groupBy("transcript_id").agg(F.avg("hedging_score").alias("score"), F.count(F.lit(1)).alias("n_sentences"))


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("ticker").distinct()


def calls_with_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).join(_scores(spark, sf_dir), "transcript_id", "left").select("transcript_id", "ticker", _r("score"), "n_sentences")


def company_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _calls(spark, sf_dir).join(_scores(spark, sf_dir), "transcript_id", "left")
    return j.groupBy("ticker").agg(F.count_distinct("transcript_id").alias("calls"), F.round(F.avg("score"), 6).alias("score"), F.sum("n_sentences").alias("n_sentences"))


def latest_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.desc("call_day"), F.desc("transcript_id"))
    return days(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n = 1").select("ticker", "transcript_id", "call_day")


def status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _calls(spark, sf_dir).groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))
    return g.select("processing_status", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def section_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).groupBy("section", "speaker_role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("segment_id").alias("n_segments"))


def riskiest_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hedging(sentences(spark, sf_dir), "text")
    return h.orderBy(F.desc("hedging_score"), "sentence_id").limit(20).select("sentence_id", _r("hedging_score"))


def searched_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _calls(spark, sf_dir)
    return c.where(F.lower(F.concat_ws(" ", "ticker", "company_name")).contains("dyne")).select("transcript_id", "ticker", "company_name")


def calls_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).where(F.col("call_day").between(F.lit("2010-01-01"), F.lit("2014-12-31"))).select("transcript_id", "ticker", "call_day")


def unscored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs not annotated yet: the anti-join by which a run resumes."""
    done = table(spark, sf_dir, "annotations").select("qa_id").distinct()
    return pairs(spark, sf_dir).select("qa_id").distinct().join(done, "qa_id", "left_anti")


def top_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence ids of each ticker's most relevant three, gathered in order."""
    e = _evidence(spark, sf_dir)
    w = Window.partitionBy("ticker").orderBy(F.desc_nulls_last("relevance_score"), "evidence_id")
    top = e.withColumn("n", F.row_number().over(w)).where("n <= 3")
    return top.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "evidence_id"))), lambda x: x["evidence_id"]), ",").alias("ids"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["transcripts", "segments", "sentences", "qa_pairs", "retrieved_evidence", "annotations"]
    out = None
    for n in names:
        c = table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


QUERIES = {f.__name__: f for f in (
    evidence_categories, evidence_sources, leak_audit, verdicts, verdict_shares, series_reaction, series_abnormal, latest_fact, label_matrix, label_measures, label_overall, annotator_kappa, label_splits, score_evidence, score_outcomes,
    macro_f1_interval, score_correlations, score_spearman, score_ranks, score_regression, score_quartiles, score_groups, paired_ranks, score_descriptives, tickers, calls_with_scores, company_rollup, latest_calls,
    status_shares, section_roles, riskiest_sentences, searched_calls, calls_between, unscored_pairs, top_evidence, table_counts,
)}

from parley.plans.text_queries import _HEDGE  # noqa: E402

_FULL = "source_type, source_name, source_url, title, text, filing_type, relevance_score, authority_score, CAST(instant AS DATE) AS published"
_EV = oracle_evidence("source_type, source_name, source_url, title, text, filing_type, relevance_score, authority_score")
_M = """a AS (SELECT *, lower(trim(replace(annotator_id, '-', '_'))) AS who FROM annotations WHERE evaluation_type = 'human' AND label_evasive BETWEEN 0 AND 2),
one AS (SELECT qa_id, who, arg_max(label_evasive, (labelled_at, label_evasive)) AS label, max(auto_evasiveness_score) AS evasive, max(auto_hedging_score) AS hedging, max(auto_hidden_risk_score) AS risk, max(date) AS date FROM a GROUP BY qa_id, who),
m AS (SELECT qa_id, max(evasive) AS evasive, max(hedging) AS hedging, max(risk) AS risk, max(date) AS date FROM one GROUP BY qa_id)"""
_GRID = "grid AS (SELECT a.x AS truth, b.x AS guess FROM (VALUES (0), (1), (2)) a(x), (VALUES (0), (1), (2)) b(x))"
_C = f"{_M}, {_GRID}, g AS (SELECT label AS truth, CASE WHEN evasive <= 20 THEN 0 WHEN evasive <= 50 THEN 1 WHEN evasive IS NOT NULL THEN 2 END AS guess FROM one), c AS (SELECT truth, guess, (SELECT count(*) FROM g WHERE g.truth = grid.truth AND g.guess = grid.guess) AS n FROM grid)"
_MEASURES = """p AS (SELECT k.x AS label, (SELECT sum(n) FROM c WHERE truth = k.x) AS support, (SELECT sum(n) FROM c WHERE guess = k.x) AS guessed, (SELECT sum(n) FROM c WHERE truth = k.x AND guess = k.x) AS hit FROM (VALUES (0), (1), (2)) k(x)),
q AS (SELECT label, support, CASE WHEN guessed > 0 THEN hit::DOUBLE / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0 END AS recall FROM p),
s AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM q)"""
_VALID = """v AS (SELECT transcript_id, coalesce(nullif(upper(trim(regexp_replace(ticker, '^.*:', ''))), ''), upper(split_part(transcript_id, '_', 1))) AS ticker, company_name, processing_status FROM transcripts WHERE transcript_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY created_at DESC NULLS LAST, ticker DESC NULLS LAST, company_name DESC NULLS LAST, year DESC NULLS LAST, sector DESC NULLS LAST, processing_status DESC NULLS LAST) = 1)"""
_SCORES = f"{_HEDGE}, sc AS (SELECT transcript_id, avg(hedging_score) AS score, count(*) AS n_sentences FROM h GROUP BY transcript_id)"
_AVG_RANK = "rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE"
_SERIES = "SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS value FROM orders GROUP BY ALL"
_EVENTS = "SELECT DISTINCT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS event_day FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000"


def _reaction(series: str, events: str) -> str:
    fwd = ", ".join(f"lead(value, {k}) OVER w AS v{k}" for k in (1, 5, 10, 20))
    vol = ", ".join(f"CASE WHEN lead(value, {k}) OVER w IS NOT NULL THEN stddev_samp(ch) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) * sqrt(252) END AS s{k}" for k in (5, 10, 20))
    return f"""(WITH s0 AS (SELECT *, (value - lag(value) OVER (PARTITION BY ticker ORDER BY day)) / lag(value) OVER (PARTITION BY ticker ORDER BY day) AS ch FROM ({series})),
s AS (SELECT *, {fwd}, {vol} FROM s0 WINDOW w AS (PARTITION BY ticker ORDER BY day)),
b AS (SELECT e.ticker, e.event_day, s.day AS bd, s.value AS bv FROM ({events}) e ASOF LEFT JOIN s ON e.ticker = s.ticker AND e.event_day > s.day),
f AS (SELECT b.*, s.day AS ad, s.v1, s.v5, s.v10, s.v20, s.s5, s.s10, s.s20 FROM b ASOF LEFT JOIN s ON b.ticker = s.ticker AND b.event_day <= s.day)
SELECT *, bd IS NOT NULL AND ad IS NOT NULL AS ok FROM f)"""


ORACLES = {
    "evidence_categories": f"""
WITH {ORACLE_CALLS}, {_EV}, e AS (SELECT ticker, {_FULL} FROM ev WHERE filing_type IN ('10-K', '10-Q', '8-K'))
SELECT c.transcript_id, CASE WHEN published - CAST(c.instant AS DATE) <= 0 THEN 'contemporaneous' WHEN published - CAST(c.instant AS DATE) > 90 THEN 'outcome' ELSE 'post_call' END AS category, count(*) AS n, round(sum(authority_score) / count(*), 6) AS authority
FROM calls c JOIN e USING (ticker) WHERE published BETWEEN CAST(c.instant AS DATE) - 180 AND CAST(c.instant AS DATE) + 365 GROUP BY ALL""",
    "evidence_sources": f"WITH {_EV} SELECT source_type, filing_type, count(*) AS n, round(avg(authority_score), 6) AS authority, min(CAST(instant AS DATE)) AS first_day, max(CAST(instant AS DATE)) AS last_day FROM ev WHERE ticker IS NOT NULL GROUP BY ALL",
    "series_reaction": f"""
SELECT ticker, event_day, CASE WHEN ok THEN bd END AS day_before, CASE WHEN ok THEN ad END AS day_after, {", ".join(f"round(CASE WHEN ok THEN (v{k} - bv) / bv END, 6) AS change_{k}d" for k in (1, 5, 10, 20))}, {", ".join(f"round(CASE WHEN ok THEN s{k} END, 6) AS volatility_{k}d" for k in (5, 10, 20))}
FROM {_reaction(_SERIES, _EVENTS)}""",
    "series_abnormal": f"""
SELECT o.ticker, o.event_day, {", ".join(f"round(CASE WHEN o.ok THEN (o.v{k} - o.bv) / o.bv END - CASE WHEN a.ok THEN (a.v{k} - a.bv) / a.bv END, 6) AS abnormal_{k}d" for k in (5, 10))}
FROM {_reaction(_SERIES, _EVENTS)} o LEFT JOIN {_reaction("SELECT 'all' AS ticker, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS value FROM orders GROUP BY ALL", f"SELECT DISTINCT 'all' AS ticker, event_day FROM ({_EVENTS})")} a ON o.event_day = a.event_day""",
    "latest_fact": """
WITH f AS (SELECT o_custkey AS cust, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS price FROM orders GROUP BY ALL), e AS (SELECT DISTINCT o_custkey AS cust, CAST(o_orderdate AS DATE) + 30 AS event_day FROM orders WHERE o_orderstatus = 'F'),
j AS (SELECT e.cust, e.event_day, f.day, f.price FROM e ASOF LEFT JOIN f ON e.cust = f.cust AND e.event_day >= f.day)
SELECT cust, event_day, CASE WHEN day >= event_day - 120 THEN day END AS fact_day, CASE WHEN day >= event_day - 120 THEN price END AS price FROM j""",
    "label_matrix": f"WITH {_C} SELECT truth, guess, n FROM c",
    "label_measures": f"WITH {_C}, {_MEASURES} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM s",
    "label_overall": f"WITH {_C}, {_MEASURES} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round((SELECT sum(n) FILTER (truth = guess)::DOUBLE / sum(n) FROM c), 6) AS accuracy FROM s",
    "annotator_kappa": f"""
WITH {_M}, k AS (SELECT x.label AS a, y.label AS b FROM one x JOIN one y ON x.qa_id = y.qa_id AND x.who < y.who), t AS (SELECT count(*) AS n, avg((a = b)::INTEGER::DOUBLE) AS po FROM k),
pe AS (SELECT sum((SELECT count(*) FROM k WHERE a = x)::DOUBLE * (SELECT count(*) FROM k WHERE b = x) / ((SELECT n FROM t)::DOUBLE * (SELECT n FROM t))) AS pe FROM (VALUES (0), (1), (2)) v(x))
SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM t, pe""",
    "label_splits": f"WITH {_M} SELECT CASE WHEN substr(date, 1, 10) <= '2018-12-31' THEN 'train' WHEN substr(date, 1, 10) <= '2021-12-31' THEN 'val' WHEN date IS NOT NULL THEN 'test' END AS split, CASE WHEN evasive < 20 THEN 0 WHEN evasive < 50 THEN 1 WHEN evasive IS NOT NULL THEN 2 END AS label, count(*) AS n FROM m GROUP BY ALL",
    "score_correlations": f"WITH {_M} " + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n, round(corr({x}, {y}), 6) AS r FROM one" for x in ("evasive", "hedging", "risk") for y in ("label",)),
    "score_spearman": f"WITH {_M}, b AS (SELECT evasive, label FROM one WHERE evasive IS NOT NULL), r AS (SELECT {_AVG_RANK.format(x='evasive')} AS a, {_AVG_RANK.format(x='label')} AS b FROM b) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r",
    "score_ranks": f"WITH {_M} SELECT qa_id, CAST({_AVG_RANK.format(x='evasive')} AS DOUBLE) AS rank FROM m WHERE evasive IS NOT NULL",
    "score_regression": f"""
WITH {_M}, b AS (SELECT label::DOUBLE AS y, evasive AS x FROM one WHERE evasive IS NOT NULL)
SELECT 'intercept' AS term, round(regr_intercept(y, x), 6) AS estimate, round(regr_r2(y, x), 6) AS r_squared FROM b UNION ALL SELECT 'evasive', round(regr_slope(y, x), 6), round(regr_r2(y, x), 6) FROM b""",
    "score_quartiles": f"""
WITH {_M}, q AS (SELECT quantile_cont(evasive::DOUBLE, 0.25) AS lo, quantile_cont(evasive::DOUBLE, 0.75) AS hi FROM one), b AS (SELECT CASE WHEN evasive >= hi THEN true WHEN evasive <= lo THEN false END AS g, label::DOUBLE AS v FROM one, q),
r AS (SELECT g, v, {_AVG_RANK.format(x='v')} AS r FROM b WHERE g IS NOT NULL),
s AS (SELECT count(*) FILTER (g) AS n_high, avg(v) FILTER (g) AS mean_high, median(v) FILTER (g) AS median_high, stddev_pop(v) FILTER (g) AS std_high, count(*) FILTER (NOT g) AS n_low, avg(v) FILTER (NOT g) AS mean_low, median(v) FILTER (NOT g) AS median_low,
  stddev_pop(v) FILTER (NOT g) AS std_low, count(*) AS n, sum(r) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2.0::DOUBLE AS u FROM r), t AS (SELECT sum(c ^ 3 - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v))
SELECT round(n_high::DOUBLE, 6) AS n_high, round(mean_high, 6) AS mean_high, round(median_high, 6) AS median_high, round(std_high, 6) AS std_high, round(n_low::DOUBLE, 6) AS n_low, round(mean_low, 6) AS mean_low, round(median_low, 6) AS median_low, round(std_low, 6) AS std_low,
  round(u, 6) AS u, round((u - n_high * n_low / 2.0::DOUBLE) / sqrt(n_high * n_low / 12.0::DOUBLE * (n + 1 - t / (n * (n - 1)))), 6) AS z FROM s, t""",
    "score_descriptives": f"WITH {_M} " + " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75 FROM m"
        for c in ("evasive", "hedging", "risk")
    ),
    "score_groups": f"""
WITH {_M}, b AS (SELECT label = 2 AS g, evasive AS v FROM one WHERE evasive IS NOT NULL), r AS (SELECT g, v, {_AVG_RANK.format(x='v')} AS r FROM b),
s AS (SELECT count(*) FILTER (g) AS n_high, avg(v) FILTER (g) AS mean_high, median(v) FILTER (g) AS median_high, stddev_pop(v) FILTER (g) AS std_high, count(*) FILTER (NOT g) AS n_low, avg(v) FILTER (NOT g) AS mean_low, median(v) FILTER (NOT g) AS median_low,
  stddev_pop(v) FILTER (NOT g) AS std_low, count(*) AS n, sum(r) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2.0::DOUBLE AS u FROM r), t AS (SELECT sum(c ^ 3 - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v))
SELECT round(n_high::DOUBLE, 8) AS n_high, round(mean_high, 8) AS mean_high, round(median_high, 8) AS median_high, round(std_high, 8) AS std_high, round(n_low::DOUBLE, 8) AS n_low, round(mean_low, 8) AS mean_low, round(median_low, 8) AS median_low, round(std_low, 8) AS std_low,
  round(u, 8) AS u, round((u - n_high * n_low / 2.0::DOUBLE) / sqrt(n_high * n_low / 12.0::DOUBLE * (n + 1 - t / (n * (n - 1)))), 8) AS z FROM s, t""",
    "paired_ranks": f"""
WITH {_M}, d AS (SELECT evasive - hedging AS d, abs(evasive - hedging) AS a FROM m WHERE evasive - hedging <> 0), r AS (SELECT d, {_AVG_RANK.format(x='a')} AS r FROM d),
s AS (SELECT count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r)
SELECT n, round(w, 6) AS w, round((w - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE), 6) AS z FROM s""",
    "tickers": f"WITH {_VALID} SELECT DISTINCT ticker FROM v",
    "calls_with_scores": f"WITH {_VALID}, {_SCORES} SELECT v.transcript_id, ticker, round(score, 6) AS score, n_sentences FROM v LEFT JOIN sc USING (transcript_id)",
    "company_rollup": f"WITH {_VALID}, {_SCORES} SELECT ticker, count(DISTINCT transcript_id) AS calls, round(avg(score), 6) AS score, CAST(sum(n_sentences) AS BIGINT) AS n_sentences FROM v LEFT JOIN sc USING (transcript_id) GROUP BY ticker",
    "latest_calls": f"WITH {ORACLE_CALLS} SELECT ticker, transcript_id, CAST(instant AS DATE) AS call_day FROM calls QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY CAST(instant AS DATE) DESC, transcript_id DESC) = 1",
    "status_shares": f"WITH {_VALID} SELECT processing_status, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM v GROUP BY processing_status",
    "section_roles": f"SELECT section, speaker_role, count(*) AS n, count(DISTINCT segment_id) AS n_segments FROM {SENTENCES} GROUP BY ALL",
    "riskiest_sentences": f"WITH {_HEDGE} SELECT sentence_id, round(hedging_score, 6) AS hedging_score FROM h ORDER BY h.hedging_score DESC, sentence_id LIMIT 20",
    "searched_calls": f"WITH {_VALID} SELECT transcript_id, ticker, company_name FROM v WHERE contains(lower(concat_ws(' ', ticker, company_name)), 'dyne')",
    "calls_between": f"WITH {ORACLE_CALLS} SELECT transcript_id, ticker, CAST(instant AS DATE) AS call_day FROM calls WHERE CAST(instant AS DATE) BETWEEN '2010-01-01' AND '2014-12-31'",
    "unscored_pairs": "SELECT DISTINCT qa_id FROM qa_pairs WHERE qa_id IS NOT NULL AND qa_id NOT IN (SELECT qa_id FROM annotations WHERE qa_id IS NOT NULL)",
    "top_evidence": f"WITH {_EV}, r AS (SELECT ticker, evidence_id, row_number() OVER (PARTITION BY ticker ORDER BY relevance_score DESC NULLS LAST, evidence_id) AS n FROM ev WHERE ticker IS NOT NULL) SELECT ticker, string_agg(evidence_id, ',' ORDER BY n) AS ids FROM r WHERE n <= 3 GROUP BY ticker",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("transcripts", "segments", "sentences", "qa_pairs", "retrieved_evidence", "annotations")),
}
