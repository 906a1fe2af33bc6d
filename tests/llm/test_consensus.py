"""Consensus on simulated annotators whose truth is known."""

import random
from collections import Counter

from parley.llm.consensus import consensus

SCHEMA = "item string, who string, label int, at bigint, score double, text string, n_votes int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)
    items, people = consensus(df, item="item", annotator="who", label="label", written="at", numbers=["score"], text="text")
    return {r.item: r for r in items.collect()}, {r.annotator: r for r in people.collect()}


def simulated(n=400, seed=7):
    rng = random.Random(seed)
    truth, rows = {}, []
    for i in range(n):
        t = rng.choice([0, 0, 1, 2])
        truth[f"i{i}"] = t
        for who in rng.sample(["good1", "good2", "good3", "always1", "flip", "noise"], 4):
            u = rng.random()
            lab = {"always1": 1, "noise": rng.randrange(3), "flip": 2 - t if u < 0.9 else t}.get(who, t if u < 0.92 else rng.randrange(3))
            rows.append((f"i{i}", who, lab, i, 20.0 + 20 * t + rng.gauss(0, 12), "words"))
    return truth, rows


def test_it_beats_the_majority_and_tells_annotators_apart(spark):
    truth, rows = simulated()
    items, people = run(spark, rows)
    votes = {}
    for i, _, lab, *_ in rows:
        votes.setdefault(i, []).append(lab)
    majority = sum(Counter(v).most_common(1)[0][0] == truth[i] for i, v in votes.items())
    right = sum(items[i].label == t for i, t in truth.items())
    assert len(items) == len(truth) and right > majority and right >= 0.93 * len(truth)
    assert people["good1"].reliability > 0.85 > people["noise"].reliability
    assert people["always1"].informedness < 0.2 and people["flip"].informedness > 0.4
    for i, v in votes.items():
        same = sum(a == b for k, a in enumerate(v) for b in v[:k]) / (len(v) * (len(v) - 1) / 2)
        assert abs(items[i].agreement - same) < 1e-9


def test_dirty_rows(spark):
    _, rows = simulated(60)
    rows += [("x", "Good1 ", 0, 1, None, None), ("x", "GOOD1", 2, 5, None, None), ("x", "good1", 9, 9, None, None), ("x", "good2", None, 1, None, None), (None, "good1", 1, 1, None, None), ("x", None, 1, 1, None, None), ("y", "good2", 3, 1, 1.0, "")]
    items, people = run(spark, rows + rows[:20])
    assert items["x"].n_votes == 1 and items["x"].agreement is None and items["x"].label == 2
    assert "y" not in items and None not in items and len(people) == 6
    assert sum(p.n_labels for p in people.values()) == 60 * 4 + 1


def test_empty(spark):
    assert run(spark, []) == ({}, {})
