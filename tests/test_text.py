"""Cleaning, splitting, segments, pairs, risk and claims."""

import math

import pytest
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import claims as cl
from parley.operators import risk as rk
from parley.operators import segments as sg
from parley.operators.sentiment import lexicon_sentiment, model_sentiment


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_cleaning(spark):
    texts = ["“A” — b c​", "a &amp; <b>x</b> &lt;i&gt;y", "a\r\nb\rc  \n\n\n\nd", "x\f[PAGE 3]y (Continued)", "=====\n      deep", " é ", None, "", "z" * 50_000]
    assert values(spark, texts, tx.clean_text) == ['"A" -- b c', "a &  x   y", "a\nb\nc\n\nd", "x\n\ny", "deep", "é", "", "", "z" * 50_000]


def test_sentences(spark):
    t = "Mr. Cook spoke. Revenue was $90.8 billion, up 8.5% in the U.S. market. Q4 was strong! It was 2024. We grew."
    assert values(spark, [t, None, " ", "No end"], tx.split_sentences) == [["Mr. Cook spoke.", "Revenue was $90.8 billion, up 8.5% in the U.S. market.", "Q4 was strong!", "It was 2024. We grew."], [], [], ["No end"]]


def test_counts(spark):
    assert values(spark, ["We may, could and WOULD.", "maybe", "", None], lambda c: tx.bounded_count(F.coalesce(c, F.lit("")), ["may", "could", "would"])) == [3, 0, 0, 0]
    # A phrase within a phrase counts for both.
    assert values(spark, ["uncertainty"], lambda c: tx.phrase_count(c, ["uncertain", "uncertainty"])) == [2]
    assert values(spark, ["Risk and loss", "none", "", None, "日本"], tx.lm_negative_score) == [100.0, 0.0, 0.0, 0.0, 0.0]
    assert values(spark, ["a b  c", "", " "], tx.word_count) == [3, 1, 1]
    assert values(spark, ["q3", "3", " Q1 ", "Q5", "", None], tx.quarter_label) == ["Q3", "Q3", "Q1", None, None, None]
    assert values(spark, ["Q and A", "Prepared-Remarks", "intro", None, "x"], tx.section_label)[1:] == ["prepared_remarks", "opening", "unknown", "unknown"]


def test_hedging_is_zero_for_nothing_and_grows(spark):
    df = spark.createDataFrame([(1, "We may see growth."), (2, "We may possibly see growth, but we believe it is uncertain."), (3, None), (4, "")], "i int, t string")
    got = {r.i: r for r in rk.hedging(df, "t").collect()}
    assert got[3].hedging_score == got[4].hedging_score == 0 < got[1].hedging_score < got[2].hedging_score
    assert got[2].uncertainty_count == 2 and got[1].modal_count == 1


def test_tone(spark):
    rows = [("a", i, v) for i, v in enumerate([0.05] * 4 + [0.9])] + [("b", i, 0.1) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = [(r.g, r.i, round(r.shift_score, 6)) for r in rk.local_shift(df, group="g", order=["i"], value="v", window=3).orderBy("g", "i").collect()]
    assert got[4] == ("a", 4, 100.0) and got[0][2] == 0.0 and all(x[2] == 0.0 for x in got[5:])
    s = spark.createDataFrame([("a", "prepared_remarks", 0.1), ("a", "q_and_a", 0.5), ("b", None, 0.5)], "g string, s string, v double")
    assert {r.g: (round(r.section_shift, 6), r.direction) for r in rk.section_shift(s, group="g", section="s", value="v").collect()} == {"a": (40.0, "more_negative_qa"), "b": (0.0, "stable")}


def test_cosine_and_evasiveness(spark):
    df = spark.createDataFrame([("a", "margin growth", "margin growth"), ("b", "margin growth", "weather holds"), ("c", "margin growth", "margin falls"), ("d", None, "x"), ("e", "How much did it cost?", "It cost $5 million.")], "k string, q string, a string")
    sim = {r.k: r.similarity for r in rk.tfidf_cosine(df, key="k", left="q", right="a", bigrams=False).collect()}
    idf = 1 + math.log(1.5)
    assert abs(sim["a"] - 1) < 1e-9 and sim["b"] == sim["d"] == 0 and abs(sim["c"] - 1 / (1 + idf * idf)) < 1e-9
    e = {r.k: r for r in rk.evasiveness(df, key="k", question="q", answer="a").collect()}
    assert e["d"].evasive_score == 0 and e["d"].topic_overlap == 0.5 and e["b"].evasive_score > e["c"].evasive_score > e["a"].evasive_score and e["e"].asks_number and e["e"].has_number


def test_likeness_is_the_cosine(spark):
    texts = ["margin growth growth in the year", "growth of margin", "weather", "", None, "the", "margin margin year"]
    df = spark.createDataFrame([(f"{i}-{k}", a, b) for i, a in enumerate(texts) for k, b in enumerate(texts)], "k string, q string, a string")
    want = {r.k: r.similarity for r in rk.tfidf_cosine(df, key="k", left="q", right="a", bigrams=False).collect()}
    for r in df.select("k", cl.likeness(cl.term_weights(F.col("q")), cl.term_weights(F.col("a"))).alias("v")).collect():
        assert abs(r.v - want[r.k]) < 1e-9, r.k


def test_top_share(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [10] * 10 + [90, 90, 50]] + [("h", None), ("i", 5.0)], "g string, v double")
    got = {r.g: r for r in rk.top_share_mean(df, group="g", value="v").collect()}
    assert got["g"].n == 13 and got["g"].top_mean == 90 and got["i"].top_mean == 5 and "h" not in got
    assert abs(got["g"].blend - (0.6 * 330 / 13 + 0.4 * 90)) < 1e-9


def test_risk_of_pairs_and_calls(spark):
    s = spark.createDataFrame([("t", "a", "opening", 10.0, 5.0, 0.0, 0, 0), ("t", "b", "q_and_a", 50.0, 20.0, 10.0, 1, 0), ("t", "b", "q_and_a", 30.0, 10.0, 30.0, 1, 1)], "transcript_id string, segment_id string, section string, risk double, hedging_score double, shift_score double, segment_order int, sentence_number int")
    p = spark.createDataFrame([("q", "t", "b", 60.0), ("r", "u", "z", 40.0)], "qa_id string, transcript_id string, answer_segment_id string, evasive_score double")
    pr = rk.pair_risk(p, s)
    assert {r.qa_id: r.pair_risk for r in pr.collect()} == {"q": 30 + 10 + 2.25 + 2, "r": 20.0}
    c = rk.call_risk(s, pr, spark.createDataFrame([("t", 80.0)], "transcript_id string, section_shift double")).collect()
    assert [(r.transcript_id, r.n, r.overall, r.prepared, r.qa, r.worst_segment) for r in c] == [("t", 3, 0.6 * 30 + 0.4 * 50 + 5, 10.0, 0.5 * 40 + 0.5 * 44.25, "b")] or c[0].qa in (42.12, 42.13)
    df = spark.createDataFrame([(1, "Growth was strong"), (2, "loss and risk"), (3, None), (4, "")], "i int, t string")
    assert [r.label for r in lexicon_sentiment(df, key="i", text="t").orderBy("i").collect()] == ["positive", "negative", "neutral", "neutral"]
    got = model_sentiment(df, key="i", text="t", load=lambda: lambda texts: [(0.8, 0.1, 0.1) for _ in texts], batch=2).orderBy("i").collect()
    assert [r.label for r in got] == ["positive", "positive", "neutral", "neutral"]


SEG = "segment_id string, transcript_id string, speaker string, speaker_role string, section string, text string, sequence int"


def test_questions_and_answers(spark):
    long = lambda w: f"{w} and some further words"
    turns = [("operator", "first"), ("analyst", "q1"), ("analyst", "q1b"), ("executive", "a1"), ("unknown", "a1b"), ("operator", "next"), ("executive", "stray"), ("unknown", "q2"), ("executive", "a2"), ("analyst", "q3"), ("executive", None)]
    rows = [(f"s{i}", "t", f"p{i}", role, "q_and_a", text and long(text), i) for i, (role, text) in enumerate(turns)] + [("x", "t", "p", "analyst", "opening", long("no"), 99)]
    got = [(r.qa_id, r.question_segment_id, r.answer_segment_id, r.question_text, r.answer_text) for r in sg.match_questions(spark.createDataFrame(rows + rows[:1], SEG)).orderBy("qa_id").collect()]
    assert got == [("t_qa_000", "s1", "s3", f"{long('q1')} {long('q1b')}", f"{long('a1')} {long('a1b')}"), ("t_qa_001", "s7", "s8", long("q2"), long("a2"))]
    assert sg.match_questions(spark.createDataFrame([], SEG)).count() == 0


REC = "record_no int, symbol string, date string, year string, quarter string, content string, structured_content array<struct<speaker:string,role:string,section:string,text:string>>"


def test_records_and_segments(spark):
    piece = [("Operator", None, None, "Welcome to the call."), ("Tim", "CEO", None, "We grew."), ("", None, None, " "), ("operator", None, None, "Our first question is here."), ("Bo", "analyst", None, "Why?"), ("Operator", None, None, "Thank you all.")]
    rows = [(1, "abc", "2024-05-02", "2024", "2", None, piece), (2, "", "2024-05-02", "2024", "Q2", "x", None), (3, "abc", None, "2024", "Q2", "x", None), (4, "abc", "2024-05-02", "1989", "Q2", "x", None), (5, "abc", "2024-05-03", "2024", "Q5", "x", None), (6, "abc", "2024-05-02", "2024", "Q2", "Intro\nTim Cook: We grew. \nBo Munk, Analyst: Why?", None), (7, "d", "2024-05-02", "x", None, "y", None), (8, "e", "2024-05-02", None, None, "", [])]
    df = spark.createDataFrame(rows, REC)
    assert [r.error for r in sg.valid_records(df).orderBy("record_no").collect()] == [None, "missing symbol", "missing date", "invalid year", "invalid quarter", None, "non-integer year", "empty transcript"]
    existing = spark.createDataFrame([("D_x_2024-05-02",)], "transcript_id string")
    assert {r.record_no: r.status for r in sg.ingest_status(df, existing).collect()} == {1: "ok", 2: "invalid", 3: "invalid", 4: "invalid", 5: "invalid", 6: "skipped_duplicate", 7: "skipped_duplicate", 8: "invalid"}
    seg = sg.with_sections(sg.call_segments(df.where("record_no in (1, 6)"), key="record_no", structured="structured_content", content="content"), key="record_no")
    got = [(r.record_no, r.sequence, r.speaker, r.speaker_role, r.section) for r in seg.orderBy("record_no", "sequence").collect()]
    assert got == [
        (1, 0, "Operator", "operator", "opening"), (1, 1, "Tim", "executive", "prepared_remarks"), (1, 3, "operator", "operator", "q_and_a"), (1, 4, "Bo", "analyst", "q_and_a"), (1, 5, "Operator", "operator", "closing"),
        (6, 0, "Tim Cook", "unknown", "prepared_remarks"), (6, 1, "Bo Munk, Analyst", "analyst", "prepared_remarks"),
    ]


def test_claims(spark):
    rows = [
        ("t", f"s{i}", i, 0, "executive", "q_and_a", x)
        for i, x in enumerate(["We expect revenue growth of 12% next quarter.", "We see margins between 8 and 10% for the full year.", "Capex was $2 billion in North America.", "This has forward-looking statements on revenue up 5%.", "Short revenue.", None, "Sales accelerated by 50 bps in Europe."])
    ]
    df = spark.createDataFrame(rows, "transcript_id string, sentence_id string, segment_order int, sentence_number int, speaker_role string, section string, text string")
    c = cl.normalized(cl.extract_claims(df), text="claim_text", default="claim_type")
    got = {r.sentence_id: r for r in c.collect()}
    assert set(got) == {"s0", "s1", "s2", "s6"}
    assert (got["s0"].value, got["s0"].unit, got["s0"].period, got["s0"].direction, got["s0"].claim_id) == (12.0, "percent", "next_quarter", "increase", "t_claim_001")
    assert (got["s1"].value, got["s1"].lower_bound, got["s1"].upper_bound, got["s1"].period) == (9.0, 8.0, 10.0, "full_year")
    assert (got["s2"].value, got["s2"].unit, got["s2"].metric, got["s2"].geography) == (2e9, "usd_billions", "capex", "North America")
    assert (got["s6"].value, got["s6"].unit, got["s6"].direction, got["s6"].geography) == (50.0, "bps", "accelerated", "Europe")
    assert cl.extract_claims(df, most=2).count() == 2


def test_verdicts(spark):
    c = spark.createDataFrame([("a", "Revenue grew 10%", 10.0, "increase"), ("b", "Revenue grew 15%", 15.0, "increase"), ("c", "no evidence", None, None)], "claim_id string, claim_text string, value double, direction string")
    links = spark.createDataFrame([("a", "e1", "sec", 1.0, "Reported growth of 9.8 percent"), ("b", "e2", "sec", 1.0, "Revenue fell -4.2 percent"), ("b", "e3", "news", 0.1, None)], "claim_id string, evidence_id string, source_type string, authority_score double, evidence_text string")
    assert {r.claim_id: r.status for r in cl.verify(c, cl.evidence_signs(links, text="evidence_text")).collect()} == {"a": "SUPPORTED", "b": "CONTRADICTED", "c": "NOT_VERIFIABLE"}


def test_times_of_evidence_and_leaks(spark):
    d = spark.createDataFrame([(x,) for x in ["2024-04-20", "2024-04-25", "2024-05-15", "2024-07-24", "2024-07-25", None]], "d string").select(F.to_date("d").alias("d"))
    got = [r[0] for r in d.select(cl.temporal_category(F.col("d"), F.to_date(F.lit("2024-04-25")))).collect()]
    assert got == ["contemporaneous", "contemporaneous", "post_call", "post_call", "outcome", "post_call"]
    calls = spark.createDataFrame([("t", "see https://a.example/x and the rest of it is written here in full, as it stands"), ("u", None)], "transcript_id string, text string")
    ev = spark.createDataFrame([("e1", "https://a.example/x", "short"), ("e2", "", "the rest of it is written here in full, as it stands and more"), ("e3", None, None)], "evidence_id string, url string, text string")
    assert sorted((r.transcript_id, r.evidence_id, r.by) for r in cl.leaks(calls, ev).collect()) == [("t", "e1", "url"), ("t", "e2", "text")]


def test_within_days_is_that_of_brute_force(spark):
    import datetime as dt
    import random

    rng = random.Random(1)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(-900, 900))
    a, b = [(rng.choice("xy"), day()) for _ in range(40)] + [("x", None)], [(rng.choice("xy"), day()) for _ in range(80)]
    got = cl.within_days(spark.createDataFrame(a, "e string, l date"), spark.createDataFrame(b, "e string, r date"), entity="e", left_day="l", right_day="r", before=180, after=365)
    want = sorted((e, x, y) for e, x in a for f, y in b if e == f and x and -180 <= (y - x).days <= 365)
    assert sorted((r.e, r.l, r.r) for r in got.collect()) == want


def test_news_of_the_window_meets_every_claim(spark, tmp_path):
    import datetime as dt

    from parley.plans import evidence_queries as eq

    call = dt.date(2024, 1, 1)
    spark.createDataFrame([("T_1", "T", str(call), dt.datetime(2024, 1, 2))], "transcript_id string, ticker string, date string, created_at timestamp").write.parquet(str(tmp_path / "transcripts.parquet"))
    news = [(f"n{i}", "news", 10, None, 0.9) for i in range(4)] + [("late", "news", 91, None, 0.1), ("last", "news", 180, None, 0.1), ("over", "news", 181, None, 1.0), ("same", "news", 0, None, 1.0)]
    rows = [(e, s, str(call + dt.timedelta(days=n)), f, r) for e, s, n, f, r in [*news, ("filed", "sec", 365, "10-K", 0.5), ("other", "sec", 10, "S-1", 0.5), ("both", "news", 20, "8-K", 0.0)]]
    df = spark.createDataFrame(rows, "evidence_id string, source_type string, publication_date string, filing_type string, relevance_score double")
    df = df.selectExpr("*", "'T' ticker", "source_type source_name", "'' source_url", "'Revenue grew' title", "'by 12%' text", "0.5D authority_score", "cast(null as map<string, string>) metadata", "timestamp'2024-02-01' retrieval_timestamp")
    df.write.parquet(str(tmp_path / "retrieved_evidence.parquet"))
    claims = spark.createDataFrame([("c1", "T_1"), ("c2", "T_1")], "claim_id string, transcript_id string")
    got = sorted((r.claim_id, r.evidence_id) for r in eq._links(spark, str(tmp_path), claims).collect())
    assert got == sorted((c, e) for c in ("c1", "c2") for e in ("n0", "n1", "n2", "n3", "late", "last", "filed", "both"))


def test_shifts_follow_the_tone_not_the_length(spark, tmp_path):
    from parley.plans import text_queries as tq

    texts = ["Sales were the same as last year."] * 4 + ["Margins declined on weak and adverse losses.", "Sales were the same as last year " * 9 + "."]
    segments = [("g0", "T", 0, "A", "executive", "prepared_remarks", "x"), ("g1", "T", 1, "A", "executive", "q_and_a", "x")]
    spark.createDataFrame(segments, "segment_id string, transcript_id string, sequence int, speaker string, speaker_role string, section string, text string").write.parquet(str(tmp_path / "segments.parquet"))
    rows = [(f"s{i}", f"g{int(i >= 4)}", "T", i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "sentence_id string, segment_id string, transcript_id string, sentence_number int, text string").write.parquet(str(tmp_path / "sentences.parquet"))
    d = str(tmp_path)
    got = {r.sentence_id: r for r in tq.tone_windows(spark, d).collect()}
    assert [got[f"s{i}"].shift_score for i in range(5)] == [0, 0, 0, 0, 100] and got["s5"].shift_score < 100
    assert tq.tone_sections(spark, d).first().prepared_mean == 0 and tq.tone_sections(spark, d).first().section_shift > 0
    risk = {r.sentence_id: r.risk for r in tq.risk_of_sentences(spark, d).collect()}
    assert risk["s4"] - risk["s3"] > 20


def test_reasons_of_verdicts(spark):
    from parley.operators.claims import evidence_signs, verify

    claims = spark.createDataFrame([("c1", "Revenue growth of 10%", 10.0, "increase"), ("c2", "Sales", None, None)], "claim_id string, claim_text string, value double, direction string")
    links = spark.createDataFrame([("c1", f"e{i}", "sec", 1.0, t) for i, t in enumerate(["grew 9.8%", "grew 10.1%", "fell 99", "grew 10", "no figure"])], "claim_id string, evidence_id string, source_type string, authority_score double, said string")
    got = {r.claim_id: r for r in verify(claims, evidence_signs(links, text="said").drop("said"), reasons=True).collect()}
    assert got["c1"].reason.endswith("e0: numbers agree | e1: numbers agree | e2: numbers disagree") and "5 items" in got["c1"].reason
    assert got["c2"].status == "NOT_VERIFIABLE" and got["c2"].reason == "No evidence of after the call."


def test_segment_risk_and_first_density(spark):
    from parley.operators.risk import first_density, segment_risk

    s = spark.createDataFrame([("s", f"x{i}", i, "t" * 300, float(r), 1.0, 2.0, 0.0, 0.1, d) for i, (r, d) in enumerate([(10, 0.5), (40, 0.1), (40, 0.2)])],
                              "segment_id string, sentence_id string, sentence_number int, text string, risk double, hedging_score double, shift_score double, evasive double, negative double, hedge_density double")
    r = segment_risk(s).first()
    assert (r.segment_risk_score, r.avg_hidden_risk, r.top_k_risk, r.sentence_count, r.top_risk_sentence_id) == (34.0, 30.0, 40.0, 3, "x1") and len(r.top_risk_sentence_text) == 200
    assert first_density(s).first().first_density == 0.5


def test_leaks_of_planted_evidence(spark):
    from parley.operators.claims import leaks

    head = "The board has approved a plan to build a plant in the north."
    calls = spark.createDataFrame([("t1", f"As we read: {head} See https://a.example/x now."), ("t2", "nothing of it"), ("t3", None)], "transcript_id string, text string")
    evidence = spark.createDataFrame([("e1", "https://a.example/x", None), ("e2", "", head + " And more."), ("e3", None, "short"), ("e4", "https://a.example/other", "Another text that no call holds, long enough to be cut.")], "evidence_id string, url string, text string")
    assert {tuple(r) for r in leaks(calls, evidence).collect()} == {("t1", "e1", "url"), ("t1", "e2", "text")}


def test_claims_rated_over_windows_are_those_of_pairs(spark, monkeypatch):
    import datetime as dt
    import random

    from parley.operators import evidence_windows as ew
    from parley.operators.claims import concluded, evidence_signs, verify, within_days

    draw = random.Random(7)
    words = "revenue margin demand grew fell costs outlook record decline strong weak plant order".split()
    say = lambda: " ".join([*draw.choices(words, k=draw.randint(0, 6)), *[f"{draw.randint(8, 14)}.5%" for _ in range(draw.randint(0, 2))]])
    day = lambda: dt.date(1969, 6, 1) + dt.timedelta(draw.randint(0, 900))
    claims = spark.createDataFrame(
        [(f"c{i}", draw.choice(["A", "A", "B", None]), draw.choice([day(), day(), day(), None]), say(), draw.choice([None, 0.0, 10.5, 12.5]), draw.choice([None, "increase", "grow", "decrease", "flat", "reached"])) for i in range(160)],
        "claim_id string, ticker string, call_day date, claim_text string, value double, direction string",
    )
    evidence = spark.createDataFrame(
        [(f"e{i}", draw.choice(["A", "A", "B", "C"]), day(), draw.choice([365, 365, 180]), draw.choice(["sec", "sec", "news", "news", None]), draw.choice([None, 0.3, 0.5, 0.8]), say()) for i in range(400)],
        "evidence_id string, ticker string, published date, lasts int, source_type string, authority_score double, said string",
    ).where("lasts = 365 OR source_type = 'news'")
    links = within_days(claims, evidence, entity="ticker", left_day="call_day", right_day="published", before=-1, after=365).where("datediff(published, call_day) <= lasts")
    linked = evidence_signs(links, text="said").select("claim_id", "evidence_id", "source_type", "authority_score", "numbers", "pos", "neg", "terms")
    want = {r.claim_id: r for r in verify(claims, linked, reasons=True).collect()}
    # Small limits: several shards, groups in pieces, few pairs at once.
    for limits in ({}, {"HELD": 50, "ROWS": 30, "CHUNK": 100}):
        for k, v in limits.items():
            monkeypatch.setattr(ew, k, v)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20 if limits else 10000)
        rows = concluded(ew.rated(claims, evidence, reasons=True)).collect()
        assert len(rows) == 160 and max(r.n_evidence for r in rows) > 50
        for r in rows:
            w = want[r.claim_id]
            assert (r.n_evidence, r.status) == (w.n_evidence, w.status) and abs(r.support - w.support) + abs(r.contradiction - w.contradiction) < 1e-9
            said = " | ".join(f"{p.evidence_id}: {p.said}" for p in r.parts)
            assert w.reason.endswith(said) and (" | " in w.reason) == (len(r.parts) > 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


def _claims_and_evidence(spark, times):
    """Eight claims and 60 items of evidence of one ticker, each so many times."""
    import datetime as dt

    call = dt.date(2015, 3, 1)
    texts = ["Revenue grew 12%", "Margin fell 10.5%", "Demand is strong", "Costs and plant order", "Revenue grew in the north"]
    claims = [(f"c{i}_{n}", "A", call + dt.timedelta(i % 3), texts[i % 5], [10.0, 12.5, None][i % 3], ["increase", None][i % 2]) for i in range(8) for n in range(times)]
    evidence = [(f"e{i}_{n}", "A", call + dt.timedelta(4 + 2 * i), *[(365, "sec"), (180, "news")][i % 2], [0.3, 0.5, 0.8][i % 3], texts[i * 3 % 5]) for i in range(60) for n in range(times)]
    return (
        spark.createDataFrame(claims, "claim_id string, ticker string, call_day date, claim_text string, value double, direction string"),
        spark.createDataFrame(evidence, "evidence_id string, ticker string, published date, lasts int, source_type string, authority_score double, said string"),
    )


def test_claims_that_ask_the_same_are_compared_once(spark, monkeypatch):
    import pyarrow as pa

    from parley.operators import evidence_windows as ew

    worked = []
    spans, kept = ew._spans, {}
    monkeypatch.setattr(ew, "_spans", lambda starts, counts: (worked.append(int(counts.sum())), spans(starts, counts))[1])
    for times in (1, 20):
        claims, evidence = _claims_and_evidence(spark, times)
        made = []
        monkeypatch.setattr(type(claims), "mapInArrow", lambda self, f, schema: (made.append(self.toArrow()), self.limit(0).selectExpr(*[f"CAST(NULL AS {t.split(' ', 1)[1]}) AS {t.split(' ', 1)[0]}" for t in schema.split(", ")]))[1])
        ew.rated(claims, evidence)
        t, worked[:] = made[0], []
        sums = pa.concat_tables([ew._rate(t.filter(pa.compute.equal(t["at"], at)), False, ew.CHUNK) for at in t["at"].unique()])
        kept[times] = (sum(worked), {r["claim_id"]: r["n"] for r in sums.group_by("claim_id").aggregate([("n", "sum")]).rename_columns(["claim_id", "n"]).to_pylist()})
    # Twenty times the evidence is twenty times the work; twenty times the claims adds none.
    assert kept[20][0] <= 20 * kept[1][0] and kept[1][0] > 100
    assert len(kept[20][1]) == 160 and all(n == 20 * kept[1][1][c.split("_")[0] + "_0"] for c, n in kept[20][1].items())


def test_rates_do_not_depend_on_the_number_or_order_of_items(spark):
    from parley.operators import evidence_windows as ew

    claims, evidence = _claims_and_evidence(spark, 1)
    one = {r.claim_id.split("_")[0]: r for r in ew.rated(claims, evidence).collect()}
    for times in (3, 7):
        claims, evidence = _claims_and_evidence(spark, times)
        for shards in (1, 5):
            for r in ew.rated(claims.orderBy(F.xxhash64("claim_id")), evidence.repartition(shards, "evidence_id")).collect():
                w = one[r.claim_id.split("_")[0]]
                assert (r.n_evidence, r.support, r.contradiction) == (times * w.n_evidence, w.support, w.contradiction)


def test_sentences_without_a_claim_are_left_out_before_the_join(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["verdict_shares"](spark, entry.SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    read = next(i for i, line in enumerate(lines) if "Relation [sentence_id" in line)
    assert "Filter" in lines[read - 1] and "margin expansion" in lines[read - 1]


@pytest.mark.parametrize("name", ["verdicts", "verdict_shares", "verdicts_by_call", "verdict_reasons", "evidence_of_claims", "evidence_by_claim"])
def test_no_row_for_each_claim_and_item_of_evidence(spark, name):
    import re

    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, entry.SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"Join [^\n]*_bucket", plan)


def test_leaks_are_those_of_brute_force_and_no_piece_is_broadcast(spark):
    import random

    from parley.operators.claims import leaks

    draw = random.Random(3)
    say = lambda n: "".join(draw.choices("ab é😀", k=n))
    texts = [say(n) for n in (0, 39, 40, 41, 90, 500)] + ["ab" * 60, None]
    begun = [t[i : i + n] for t in texts[2:7] for i, n in ((0, 40), (1, 60), (17, 41), (30, 45), (len(t) - 40, 40)) if i >= 0] + [say(50), "ba" * 20, "ab" * 19, None]
    calls = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "transcript_id string, text string")
    evidence = spark.createDataFrame([(f"e{i}", "", t) for i, t in enumerate(begun)], "evidence_id string, url string, text string")
    got = leaks(calls, evidence)
    want = {(f"t{i}", f"e{j}", "text") for i, t in enumerate(texts) for j, b in enumerate(begun) if t and b and len(b) >= 40 and b[:40] in t}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 15
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "sequence" not in plan
