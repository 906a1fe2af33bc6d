"""Nearest in time, repeated lines: against brute force, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from parley.llm import nearest_in_time as nt
from parley.llm import site_lines as sl

L, R = "lid string, e string, t bigint, bucket string, at string", "rid string, e string, t bigint, side int"


def nearest(spark, left, right, tol):
    ls = spark.createDataFrame([(*x, "x", "y") for x in left], L)
    rs = spark.createDataFrame([(*x, 9) for x in right], R)
    out = nt.nearest_in_time(ls, rs, left_id="lid", right_id="rid", entity="e", at="t", tolerance=tol)
    return {r.lid: r.rid for r in out.collect()}


def brute(left, right, tol):
    out = {}
    for lid, e, t in left:
        if None in (lid, e, t):
            continue
        c = [(abs(t - rt), rt, rid) for rid, re_, rt in right if rid is not None and re_ == e and rt is not None and abs(t - rt) <= tol]
        if c:
            out[lid] = min(c)[2]
    return out


@pytest.mark.parametrize("group_rows", [5, 200_000])
def test_nearest_is_that_of_brute_force_with_a_hot_entity(spark, monkeypatch, group_rows):
    monkeypatch.setattr(nt, "GROUP_ROWS", group_rows)
    rng = random.Random(1)
    pick = lambda: "hot" if rng.random() < 0.4 else rng.choice("abc")
    left = [(f"l{i}", pick(), rng.randrange(-500, 3000)) for i in range(150)] + [(None, "a", 5), ("n1", None, 5), ("n2", "a", None)]
    right = [(f"r{i}", pick(), rng.randrange(-500, 3000)) for i in range(300)] + [("r0", "a", 7), ("zz", None, 5), ("yy", "a", None), (None, "a", 5)]
    assert nearest(spark, left, right, 20) == brute(left, right, 20)


def test_nearest_ties_bounds_and_repeats(spark):
    left = [("at", "e", 100), ("edge", "e", 1000), ("over", "e", 2000)]
    right = [("late", "e", 110), ("early2", "e", 90), ("early1", "e", 90), ("early1", "e", 90), ("edge", "e", 1010), ("far", "e", 2011)]
    assert nearest(spark, left, right, 10) == {"at": "early1", "edge": "edge"}


def test_nearest_of_empty_tables(spark):
    assert nearest(spark, [], [("r", "e", 1)], 5) == {} == nearest(spark, [("l", "e", 1)], [], 5)


T = "part string, doc string, site string, text string, seq int, key string, line string"


def lines(spark, rows, share=0.4, least=4):
    df = spark.createDataFrame([(*r, "k", "l") for r in rows], T)
    out = sl.repeated_lines(df, part="part", doc="doc", site="site", text="text", order="seq", share=share, least=least)
    return {(r.part, r.line_no): r.block for r in out.collect()}, df, out


def brute_lines(rows, share, least):
    key = lambda s: "".join(c for c in s if c.isalpha()).lower()
    docs, where = {}, {}
    for part, doc, site, text, _ in rows:
        if None in (part, doc, site):
            continue
        docs.setdefault(site, set()).add(doc)
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            if key(line):
                where.setdefault((site, key(line)), set()).add((doc, part, i))
    return {(p, i) for (s, _), w in where.items() if len({d for d, _, _ in w}) >= max(least, share * len(docs[s])) for _, p, i in w}


@pytest.mark.parametrize("shard", [3, 1000])
def test_repeated_lines_are_those_of_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(sl, "SHARD", shard)
    rng = random.Random(2)
    pool = ["Page 1 of 3", "All rights reserved.", "ALL rights, reserved", "123 --", "", "share | this"] + [f"line {chr(97 + i)} text" for i in range(15)]
    rows = [(f"p{i}", f"d{i // 2}", "hot" if i % 3 else "b", "\n".join(rng.choices(pool, [9] * 6 + [1] * 15, k=rng.randrange(0, 6))), i) for i in range(60)]
    rows += [rows[0], ("px", "d1", "hot", None, 1), (None, "d1", "hot", "a", 1), ("py", None, "hot", "a", 1), ("pz", "d1", None, "a", 1)]
    got, _, _ = lines(spark, rows)
    assert set(got) == brute_lines(rows, 0.4, 4)
    assert got


def test_blocks_and_removal(spark):
    rows = [(f"p{i}", f"d{i}", "s", f"legal one\nlegal two\nown words {chr(97 + i) * 3}\nlegal one\nlegal two", i) for i in range(6)]
    got, df, found = lines(spark, rows)
    assert got == {(f"p{i}", n): 2 for i in range(6) for n in (0, 1, 3, 4)}
    clean = sl.without_lines(df, found, part="part", text="text")
    assert {r.text for r in clean.collect()} == {f"own words {chr(97 + i) * 3}" for i in range(6)}
    assert clean.columns == df.columns


def test_no_line_is_removed_below_the_least_and_from_empty_tables(spark):
    assert lines(spark, [(f"p{i}", f"d{i}", "s", "same", i) for i in range(3)])[0] == {}
    assert lines(spark, [])[0] == {}


def test_suffix_array():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60):
        ids = rng.integers(0, 4, n)
        got = list(sl.suffix_array(ids))
        assert got == sorted(range(n), key=lambda i: tuple(ids[i:]))


def test_repeated_blocks_are_those_of_brute_force():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, least in ((1, 1), (9, 2), (40, 2), (60, 3)):
        doc = np.sort(rng.integers(0, 6, n))
        ids = rng.integers(0, 3, n).astype(np.int64)
        # Separators of their own between documents.
        cut = np.flatnonzero(np.diff(doc)) + 1
        all_ids, all_doc = np.insert(ids, cut, -1 - np.arange(len(cut))), np.insert(doc, cut, -1)
        want = {}
        for d in range(1, n + 1):
            for i in range(n - d + 1):
                if doc[i] == doc[i + d - 1]:
                    want.setdefault(tuple(ids[i : i + d]), set()).add(doc[i])
        got = {tuple(all_ids[p : p + d]): k for d, at, k_ in sl.repeated_blocks(all_ids, all_doc, least) for p, k in zip(at, k_, strict=True)}
        assert got == {b: len(ds) for b, ds in want.items() if len(b) == 1 or len(ds) >= least}


def test_very_long_text(spark):
    rows = [(f"p{i}", f"d{i}", "s", "\n".join(f"words {chr(97 + i)} {chr(97 + k % 26) * (k // 26 + 1)}" for k in range(400)) + "\nfooter", i) for i in range(5)]
    assert set(lines(spark, rows)[0]) == {(f"p{i}", 400) for i in range(5)}
    assert F is not None
