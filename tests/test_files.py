"""Sources, sinks, streams and the entry module, on small files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parley.sources import records as rc
from parley.sources import sinks as sk
from parley.streaming import ingest as ig

RECORD = {"symbol": "abc", "year": 2024, "quarter": "Q2", "date": "2024-05-02", "content": "Tim: hi", "structured_content": [{"speaker": "Tim", "role": "CEO", "section": None, "text": "hi"}]}


def test_json_sources(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text(json.dumps(RECORD) + "\n\n{broken\n" + json.dumps(RECORD | {"symbol": "x"}) + "\n")
    assert rc.read_transcripts(spark, "jsonl", str(lines)).count() == 2
    assert rc.read_jsonl(spark, str(lines), keep_malformed=True).cache().where("_corrupt_record is not null").count() == 1
    one, many = tmp_path / "one.json", tmp_path / "many.json"
    one.write_text(json.dumps(RECORD, indent=1))
    many.write_text(json.dumps([RECORD, RECORD], indent=1))
    assert rc.read_transcripts(spark, "json", str(one)).first().structured_content[0].text == "hi"
    assert rc.read_transcripts(spark, "json", str(many), limit=1).count() == 1
    spark.createDataFrame([("abc", "2024-05-02", 2024)], "Symbol string, date string, year int").write.parquet(str(tmp_path / "p"))
    assert rc.read_transcripts(spark, "export", str(tmp_path / "p")).first().symbol == "abc"
    with pytest.raises(ValueError, match="unknown source"):
        rc.read_transcripts(spark, "ftp", "x")


def test_annotation_sheets(spark, tmp_path):
    df = spark.createDataFrame([("q1", 'says "a,\nb"', 1, None), ("q2", "x", None, None), ("q3", "y", 7, None)], "qa_id string, question_text string, label_evasive int, extra string")
    sk.write_sheet(sk.annotation_sheet(df), str(tmp_path / "s"))
    got = rc.read_annotations(spark, str(tmp_path / "s")).collect()
    assert [(r.qa_id, r.question_text, r.label_evasive, r.auto_hedging_score) for r in got] == [("q1", 'says "a,\nb"', 1, None)]


def test_filings_and_facts(spark, tmp_path):
    cik = tmp_path / "cik.json"
    cik.write_text(json.dumps({"0": {"cik_str": 320193, "ticker": "abc", "title": "A"}, "1": {"cik_str": 5, "ticker": "d", "title": "D"}}))
    assert {(r.ticker, r.cik) for r in rc.cik_of_tickers(spark, str(cik)).collect()} == {("ABC", "0000320193"), ("D", "0000000005")}
    kind = "k string, r struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>,primaryDocDescription:array<string>>"
    sub = spark.createDataFrame([("a", (["10-K", "4", "8-K"], ["2024-01-05", "2024-01-06", "bad"], ["1", "2", "3"], ["d", "e", "f"], [None, None, None]))], kind)
    got = rc.filings(sub, key="k", arrays="r", start=F.to_date(F.lit("2024-01-01")))
    assert [(r.form, str(r.filing_date)) for r in got.collect()] == [("10-K", "2024-01-05")]
    assert rc.filings(sub, key="k", arrays="r").count() == 2
    facts = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"end": "2023-12-31", "val": 1e9}, {"end": "2024-03-31", "val": 2e8}, {"end": "2024-03-31", "val": 9.0, "frame": "x"}]}}}}}
    f = rc.company_facts(spark.createDataFrame([("a", json.dumps(facts)), ("b", "{}"), ("c", None)], "k string, j string"), key="k", json="j")
    assert f.count() == 3
    day = F.to_date(F.lit("2024-04-20"))
    assert rc.outcome(f, key="k", concept="Revenues", as_of=day).first().value == 200.0
    assert rc.outcome(f, key="k", concept="Revenues", as_of=F.to_date(F.lit("2020-01-01"))).count() == 0
    assert rc.reported_fact(f, key="k", concepts=["Sales", "Revenues"], target=day).first().val == 9.0


def test_news_and_prices(spark, tmp_path):
    feed = tmp_path / "f.xml"
    feed.write_text("<rss><channel><item><title>Abc margin rises - Morrow Post</title><link>l</link><pubDate>Fri, 01 Apr 2011 23:46:22 GMT</pubDate></item><item><title>no source</title><link>m</link><pubDate>x</pubDate></item></channel></rss>")
    got = rc.news_scores(rc.read_news(spark, str(feed)), query="Abc margin", known_sources=["morrow"]).orderBy("link").collect()
    assert (got[0].title, got[0].source, got[0].authority_score, got[0].relevance_score) == ("Abc margin rises", "Morrow Post", 0.75, 1.0)
    assert (got[1].source, got[1].published, got[1].authority_score) == ("unknown", None, 0.5)
    spark.createDataFrame([("abc", "2024-01-02", 5.0, 1), ("abc", "2024-01-03", None, 1)], "ticker string, Date string, Close double, Volume int").write.parquet(str(tmp_path / "p"))
    assert [(r.ticker, r.close) for r in rc.read_prices(spark, str(tmp_path / "p")).collect()] == [("ABC", 5.0)]


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), (None, 2), ("c", 2)], "k string, v int")
    assert sorted((r.k or "", r.v) for r in sk.merged(old, new, ["k"]).collect()) == [("", 2), ("a", 1), ("b", 2), ("c", 2)]
    assert sk.last_written(old.union(new), ["k"], "v").count() == 4
    sk.write_partitions(old, str(tmp_path / "t"), ["k"])
    sk.write_partitions(spark.createDataFrame([(9, "a")], "v int, k string"), str(tmp_path / "t"), ["k"])
    assert sorted((r.k or "", r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("", 1), ("a", 9), ("b", 1)]
    assert sk.write_report(spark, {"t": old}, str(tmp_path / "r.json")) == {"t": 3}
    assert sk.orphans_removed(old.where("k is not null"), new, "k").count() == 1


def test_a_second_run_adds_nothing(spark, tmp_path):
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text(json.dumps(RECORD) + "\n" + json.dumps(RECORD) + "\n" + json.dumps(RECORD | {"symbol": None}) + "\n")
    for more in (0, 0, 1):
        if more:
            (tmp_path / "in" / "2.jsonl").write_text(json.dumps(RECORD | {"symbol": "new"}) + "\n")
        ig.ingest_new_files(spark, inbox, out, state)
        assert spark.read.parquet(f"{out}/valid").count() == 1 + more
        assert spark.read.parquet(f"{out}/quarantine").count() == 1


def test_state_and_pending(spark):
    s = ig.put_state(ig.put_state(ig.empty_state(spark), "a", "RUNNING", 1), "a", "COMPLETED", 5, 1, "x")
    assert ig.get_state(s, "a")["processed"] == 5 and s.count() == 1
    assert ig.get_state(ig.reset_state(s, "a"), "a") is None
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert sorted((r.k or 0) for r in ig.pending(df, spark.createDataFrame([(1,), (None,)], "k int"), "k").collect()) == [0, 2]
    good, bad = ig.isolated(df, F.col("k") > 1, F.lit("small"))
    assert good.count() == 1 and bad.count() == 2
    assert ig.same_counts({"a": 1, "b": 2}, {"a": 1, "b": 3}) == {"b": 1}


def test_the_entry_module_names_what_runs():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "p4_found" in q and len(q) > 50


def test_late_ids_malformed_lines_and_repeated_batches(spark, tmp_path):
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    record = lambda day, **kw: json.dumps({"symbol": "abc", "year": "2020", "quarter": "1", "date": day, "content": "Hi: there"} | kw)
    (tmp_path / "in" / "a.json").write_text(record("2020-01-01") + "\n{not json\n" + record("2020-01-02", year="1989") + "\n")
    ig.ingest_new_files(spark, inbox, out, state)
    # A later file brings an id again, and a new one.
    (tmp_path / "in" / "b.json").write_text(record("2020-01-01") + "\n" + record("2020-02-01") + "\n")
    for _ in range(2):
        ig.ingest_new_files(spark, inbox, out, state)
        assert sorted(r.transcript_id for r in spark.read.parquet(f"{out}/valid").collect()) == ["ABC_2020_Q1_2020-01-01", "ABC_2020_Q1_2020-02-01"]
        assert sorted(r.error for r in spark.read.parquet(f"{out}/quarantine").collect()) == ["invalid year", "malformed line"]
    # The whole stream again from its start, as after a lost state: ids stay single, batches are replaced.
    ig.ingest_new_files(spark, inbox, out, str(tmp_path / "other"))
    assert spark.read.parquet(f"{out}/valid").groupBy("transcript_id").count().where("count > 1").count() == 0


def test_late_events_are_dropped_and_windows_written_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("ev", "out", "state"))
    put = lambda name, rows: spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{folder}/{name}")
    at = lambda d, h=0: datetime(2020, 1, d, h)
    got = lambda **kw: sorted((r.start.day, r.n) for r in ig.event_windows(spark, f"{folder}/*", out, state, pattern="*.parquet", **kw).collect())
    put("one", [(at(1), "a", 1.0), (at(1, 5), "a", 1.0), (at(2), "a", 1.0), (at(20), "a", 1.0)])
    assert got() == [(1, 2), (2, 1)]
    # The watermark stands at day 13: day 1 is closed and drops what comes late, day 15 is open.
    put("two", [(at(1, 7), "a", 1.0), (at(15), "a", 1.0), (at(30), "a", 1.0)])
    assert got() == [(1, 2), (2, 1), (15, 1), (20, 1)]
    assert got() == [(1, 2), (2, 1), (15, 1), (20, 1)]
    assert (30, 1) in got(close=True)


def test_stages_resume_by_the_done_log(spark, tmp_path):
    from parley import run

    tables, out = "/root/testdata/sf0.001", str(tmp_path / "out")
    assert run.run(spark, ["claims"], tables, out) == ["claims", "claim_values"]
    assert run.run(spark, ["claims"], tables, out, resume=True) == []
    # A result without an entry of its own ticker is written again.
    ticker = spark.read.parquet(f"{out}/claims").first().transcript_id.split("_")[0]
    assert run.run(spark, ["claims"], tables, out, ticker=ticker, resume=True) == ["claims", "claim_values"]
    assert {r.transcript_id.split("_")[0] for r in spark.read.parquet(f"{out}/claims").collect()} == {ticker}
