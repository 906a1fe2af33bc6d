"""Series around events and statistics, against closed forms and numpy."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import market as mk
from parley.operators import statistics as sx
from parley.plans import evidence_queries as eq


def test_reaction(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40) if i % 7 not in (5, 6)]
    price = {d: 100.0 + i * i % 17 for i, d in enumerate(days)}
    series = spark.createDataFrame([("x", d, v) for d, v in price.items()] + [("x", dt.date(2025, 1, 1), None)], "e string, day date, v double")
    events = [dt.date(2024, 1, 6), dt.date(2024, 1, 8), dt.date(2024, 1, 1), dt.date(2024, 2, 8), dt.date(2025, 1, 1)]
    out = mk.reaction(spark.createDataFrame([("x", d) for d in events] + [("y", events[0]), ("x", None)], "e string, at date"), series, entity="e", event_day="at", day="day", value="v")
    got = {(r.e, r["at"]): r for r in out.collect()}
    for at in events:
        before, after = [d for d in days if d < at], [d for d in days if d >= at]
        r = got["x", at]
        if not before or not after:
            assert r.day_before is None and r.change_1d is None
            continue
        i = days.index(after[0])
        assert (r.day_before, r.day_after) == (before[-1], after[0])
        for k in mk.FORWARD:
            want = (price[days[i + k]] - price[before[-1]]) / price[before[-1]] if i + k < len(days) else None
            assert r[f"change_{k}d"] == pytest.approx(want) if want is not None else r[f"change_{k}d"] is None
            if k > 1 and i + k < len(days):
                p = np.array([price[d] for d in days[i : i + k + 1]])
                assert r[f"volatility_{k}d"] == pytest.approx(np.std(np.diff(p) / p[:-1], ddof=1) * 252**0.5)
    assert got["y", events[0]].day_before is None and len(got) == 6


def test_labels(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 20, 50, 80)], "s double")
    assert [tuple(r) for r in df.select(sx.label_left(F.col("s")), sx.label_right(F.col("s"))).collect()] == [(0, 0), (1, 0), (2, 1), (2, 2)]
    assert [r[0] for r in spark.createDataFrame([("2015-01-01",), ("2020-06-15",), ("2023-03-01",), (None,)], "d string").select(sx.time_split(F.col("d"))).collect()] == ["train", "val", "test", None]


def test_measures(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(3)) for _ in range(200)] + [(5, 1), (None, 1)]
    m = sx.confusion(spark.createDataFrame(rows, "t int, g int"), truth="t", guess="g")
    x = np.zeros((3, 3))
    for a, b in rows[:200]:
        x[a, b] += 1
    assert {(r.truth, r.guess): r.n for r in m.collect()} == {(a, b): x[a, b] for a in range(3) for b in range(3)}
    k = sx.cohens_kappa(m).first()
    po, pe = np.trace(x) / 200, (x.sum(0) * x.sum(1)).sum() / 200**2
    assert k.kappa == pytest.approx((po - pe) / (1 - pe))
    empty = sx.confusion(spark.createDataFrame([], "t int, g int"), truth="t", guess="g")
    assert sx.cohens_kappa(empty).first().kappa == 0 and sx.overall_measures(empty).first().accuracy == 0
    same = sx.confusion(spark.createDataFrame([(1, 1)] * 4, "t int, g int"), truth="t", guess="g")
    assert sx.cohens_kappa(same).first().kappa == 1
    b = sx.bootstrap_macro_f1(spark.createDataFrame(rows, "t int, g int"), truth="t", guess="g").first()
    assert b.low < b.macro_f1 < b.high


def ranks(x):
    return np.array([sum(y < v for y in x) + (sum(y == v for y in x) + 1) / 2 for v in x])


def test_ranks_correlations_and_tests(spark):
    rng = random.Random(2)
    x = [float(rng.randrange(30)) for _ in range(150)]
    y = [v + rng.gauss(0, 8) for v in x]
    g = [rng.random() < 0.4 for _ in x]
    df = spark.createDataFrame([*zip(range(150), x, y, g), (900, None, 1.0, True), (901, float("nan"), 1.0, None)], "i int, x double, y double, g boolean")
    got = {r.i: r["rank"] for r in sx.average_ranks(df, "x", "rank").collect()}
    assert [got[i] for i in range(150)] == list(ranks(x)) and len(got) == 150
    clean = df.where("i < 900")
    assert sx.spearman(clean, "x", "y").first().rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert sx.pearson(df, ["x"], ["y"]).first().r == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert sx.pearson(df.limit(3), ["x"], ["y"]).first().r is None
    u = sx.group_compare(clean, group="g", value="x").first()
    a, b = [v for v, k in zip(x, g) if k], [v for v, k in zip(x, g) if not k]
    assert u.u == sum((p > q) + (p == q) / 2 for p in a for q in b) and u.n_high == len(a) and u.median_low == np.median(b)
    s = sx.signed_rank(clean, "x", "y").first()
    d = np.array(x) - np.array(y)
    r = ranks(np.abs(d))
    assert s.w == pytest.approx(min(r[d > 0].sum(), r[d < 0].sum()))
    q = sx.descriptives(df.where("not isnan(x) or x is null"), ["x"]).first()
    assert (q.n, q.q25, q["max"]) == (150, pytest.approx(np.percentile(x, 25)), max(x))
    fit = {t.term: t for t in sx.least_squares(clean, y="y", xs=["x"]).collect()}
    slope, intercept = np.polyfit(x, y, 1)
    assert fit["x"].estimate == pytest.approx(slope) and fit["intercept"].estimate == pytest.approx(intercept) and 0 <= fit["x"].p < 1e-6
    assert sx.least_squares(clean.limit(5), y="y", xs=["x"]).count() == 0


def test_distributions():
    # Table values of Student's t.
    assert sx.student_p(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert sx.student_p(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)
    assert sx.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_every_annotator_counts(spark, tmp_path):
    rng = random.Random(3)
    score = {f"q{i:02d}": rng.uniform(0, 90) for i in range(40)}
    labels = {(q, f"ann_{a:02d}"): rng.randrange(3) for q in score for a in rng.sample(range(1, 9), rng.randint(1, 6))}
    day = dt.datetime(2024, 1, 1)
    rows = [(q, "2020-01-01", score[q], score[q] % 7, score[q] % 11, "human", a, k, day) for (q, a), k in labels.items()]
    q, a = next(iter(labels))
    rows += [(q, "2020-01-01", score[q], 1.0, 2.0, "human", a.upper().replace("_", "-"), (labels[q, a] + 1) % 3, day - dt.timedelta(1)), (q, "2020-01-01", score[q], 1.0, 2.0, "synthetic", "ann_99", 0, day), (q, "2020-01-01", score[q], 1.0, 2.0, "human", "ann_98", 7, day)]
    spark.createDataFrame(rows, "qa_id string, date string, auto_evasiveness_score double, auto_hedging_score double, auto_hidden_risk_score double, evaluation_type string, annotator_id string, label_evasive int, labelled_at timestamp").write.parquet(str(tmp_path / "annotations.parquet"))
    d = str(tmp_path)
    want = np.zeros((3, 3))
    for (q, _), k in labels.items():
        want[k, 0 if score[q] <= 20 else 1 if score[q] <= 50 else 2] += 1
    assert {(r.truth, r.guess): r.n for r in eq.label_matrix(spark, d).collect()} == {(i, j): want[i, j] for i in range(3) for j in range(3)}
    both = np.zeros((3, 3))
    for q in score:
        for x, y in itertools.combinations(sorted(a for p, a in labels if p == q), 2):
            both[labels[q, x], labels[q, y]] += 1
    n = both.sum()
    po, pe = np.trace(both) / n, (both.sum(0) * both.sum(1)).sum() / n**2
    k = eq.annotator_kappa(spark, d).first()
    assert (k.n, k.kappa) == (n, pytest.approx((po - pe) / (1 - pe), abs=1e-6))
    assert {r.y: r.n for r in eq.score_correlations(spark, d).collect()} == {"label": len(labels)} and eq.score_spearman(spark, d).first().n == len(labels)
    g = eq.score_groups(spark, d).first()
    assert g.n_high + g.n_low == len(labels) and eq.macro_f1_interval(spark, d).first().n == len(labels)
    assert eq.score_descriptives(spark, d).first().n == len(score)


def test_correlation_with_p_and_interval(spark):
    rng = random.Random(1)
    rows = [(x, 0.8 * x + rng.gauss(0, 0.5)) for x in (rng.gauss(0, 1) for _ in range(300))]
    df = spark.createDataFrame([*rows, (None, 1.0)], "x double, y double")
    r = sx.correlation(df, "x", "y").first()
    assert r.n == 300 and 0.7 < r.low < r.r < r.high < 0.95 and 0 <= r.p < 1e-6
    ranks = sx.correlation(df, "x", "y", ranks=True).first()
    assert ranks.n == 300 and abs(ranks.r - r.r) < 0.1 and ranks.low < ranks.r < ranks.high
    few = sx.correlation(df.limit(3), "x", "y").first()
    assert few.r is None and few.p is None and few.low is None
    # Published value: r = 0.5 of 20 pairs has p = 0.0248.
    assert abs(sx.correlation_p(0.5, 20) - 0.0248) < 1e-4 and sx.correlation_p(1.0, 20) == 0.0


def test_outcome_groups(spark):
    df = spark.createDataFrame([(float(i), float(i % 7) + (3.0 if i >= 20 else 0.0)) for i in range(40)], "b double, v double")
    r = sx.outcome_compare(df, by="b", value="v").first()
    assert (r.n_high, r.n_low) == (20, 20) and r.mean_high > r.mean_low and r.p < 0.01 and r.note is None
    r = sx.outcome_compare(df.limit(4), by="b", value="v").first()
    assert r.note == "too few values" and r.p is None


def test_ranks_do_not_depend_on_the_number_of_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 50),) for i in range(500)], "v double")
    one = {r.v: r.k for r in sx.average_ranks(df, "v", "k").collect()}
    monkeypatch.setattr(sx, "RANGE_VALUES", 7)
    assert {r.v: r.k for r in sx.average_ranks(df, "v", "k").collect()} == one


def test_noise_and_shares_of_uniform(spark):
    u = [r.u for r in spark.range(4000).select(sx.uniform(F.col("id").cast("string")).alias("u")).collect()]
    assert min(u) >= 0 and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.02
