"""Instants, tickers, latest rows, and attributes as known at event time against brute force."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from parley.functions.instants import instant_micros, plain_ticker
from parley.operators import attributes_at as aa
from parley.operators.calls import call_times, evidence_times

SPELLED = {
    "1996-04-16T15:57:58Z": "1996-04-16 15:57:58", "2024-08-15": "2024-08-15 00:00:00", "1998/07/10": "1998-07-10 00:00:00", " 2023-08-01 ": "2023-08-01 00:00:00", "19990716": "1999-07-16 00:00:00",
    "1996-01-17T15:35:14+02:00": "1996-01-17 13:35:14", "1997-04-27T08:14:14-0400": "1997-04-27 12:14:14", "10 Dec 2017": "2017-12-10 00:00:00", "1 Apr 2021": "2021-04-01 00:00:00", "January 26, 2007": "2007-01-26 00:00:00",
    "Fri, 01 Apr 2011 23:46:22 GMT": "2011-04-01 23:46:22", "1995-01-18 17:57:58": "1995-01-18 17:57:58", "1000248518": "2001-09-11 22:48:38", "789788671": "1995-01-11 01:44:31",
    "TBD": None, "n/a": None, "": None, None: None, "unknown": None, "0000-00-00": None, "0000-00-00T00:00:00Z": None, "2021-02-30": None, "12 Foo 2020": None, "2020-13-01": None, "x" * 9000: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants_dont_depend_on_the_session(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(s,) for s in SPELLED], "s string").select("s", instant_micros(F.col("s")).alias("m")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = {r.s: r.m and datetime.fromtimestamp(r.m / 1e6, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") for r in rows}
    assert got == SPELLED


def test_tickers(spark):
    rows = ["abc", " ABC ", "NYSE:abc", "x: y:abc", ":", "", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in rows], "s string").select(plain_ticker(F.col("s"))).collect()]
    assert got == ["ABC"] * 4 + [None] * 3


def test_the_latest_row_is_valid_even_if_unreadable(spark):
    t = spark.createDataFrame([("A_1", "nyse:a", "2020-01-02", 1), ("A_1", "a", "TBD", 2), ("B_1", None, "2020-01-02", 1), ("B_1", None, "2020-01-03", 2), (None, "c", "2020-01-02", 1)], "transcript_id string, ticker string, date string, created_at int")
    assert [(r.transcript_id, r.ticker) for r in call_times(t).collect()] == [("B_1", "B")]
    e = spark.createDataFrame(
        [("e1", "a", "2020-01-02", None, 1), ("e1", "a", "unknown", None, 2), ("e2", None, "1000248518", {"ticker": "x:b"}, 1), ("e3", None, "2020-01-02", None, 1)],
        "evidence_id string, ticker string, publication_date string, metadata map<string,string>, retrieval_timestamp int",
    )
    assert [(r.evidence_id, r.ticker) for r in evidence_times(e).collect()] == [("e2", "B")]


DAY = 86_400_000_000


def matched(spark, events, statements):
    ev = spark.createDataFrame([(*x, 1, "k") for x in events], "ev string, e string, at bigint, since int, _node string")
    st = spark.createDataFrame([(*x, 7) for x in statements], "e string, known bigint, a bigint, b string, at int")
    out = aa.attributes_at(ev, st, entity="e", at="at", since="known", order=["a", "b"])
    assert out.columns == ["ev", "e", "at", "since", "_node", "a", "b"]
    return sorted((r.ev, r.b) for r in out.collect())


def brute(events, statements):
    out = []
    for ev, e, at in events:
        c = [(a, b) for e2, s, a, b in statements if e2 == e and e is not None and None not in (at, s) and s <= at]
        if c:
            out.append((ev, min(c)[1]))
    return sorted(out)


@pytest.mark.parametrize("unit", [1_000_000, 3_600_000_000, 40 * DAY])
def test_attributes_are_those_of_brute_force(spark, unit):
    rng = random.Random(unit)
    pick = lambda: "hot" if rng.random() < 0.5 else rng.choice("ab")
    statements = [(pick(), rng.randrange(-300, 300) * unit, rng.randrange(-20, 20), f"s{i}") for i in range(200)]
    events = [(f"v{i}", pick(), rng.randrange(-320, 400) * unit) for i in range(150)]
    statements += [statements[0], (None, 5, 1, "x"), ("a", None, -99, "y")]
    events += [events[0], ("n", None, 5), ("m", "a", None)]
    assert matched(spark, events, statements) == brute(events, statements)


def test_exact_ends_and_empty_tables(spark):
    statements = [("e", 10, 5, "old"), ("e", 20, 3, "new"), ("e", 20, 4, "worse"), ("e", 30, 9, "never")]
    assert matched(spark, [("a", "e", 9), ("b", "e", 10), ("c", "e", 19), ("d", "e", 20), ("f", "e", 10**18)], statements) == [("b", "old"), ("c", "old"), ("d", "new"), ("f", "new")]
    assert matched(spark, [], statements) == [] == matched(spark, [("a", "e", 9)], [])


def test_the_cover_is_exact_and_short(spark):
    rng = random.Random(3)
    spans = [(a, a + rng.choice([1, 2, 7, 1000, 50_000])) for a in (rng.randrange(0, 60_000) for _ in range(60))]
    h = aa.CELL
    df = spark.createDataFrame([(aa.ORIGIN + a * h, aa.ORIGIN + b * h) for a, b in spans], "a bigint, b bigint")
    for (a, b), r in zip(spans, df.select(aa.dyadic_cover(F.col("a"), F.col("b")).alias("n")).collect(), strict=True):
        cells = [c for x in r.n for c in range(x.node << x.level, (x.node + 1) << x.level)]
        assert sorted(cells) == list(range(a, b))
        assert len(r.n) <= 2 * aa.TOP + (b - a) // 2**aa.TOP
