"""Tokens against the public library, decoding as an exact round trip, packing by its invariants."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import packing as pk
from parley.llm import tokens as tk

TEXTS = [
    None, "", " ", "Hello world", "Hello  world \n\n next\tline  ", "It's I'll they've", "<|endoftext|> is text", "数年12.5% 日本語。", "é́ ‍👨‍💻 x", "a" * 5000, " 　 \x85 \x1c x", "naïve 1234567 -- ??",
    "word " * 4000, "ไทย ภาษา", "\r\n\r\n", "𝒳𝒴 𐍈",
]


def encoded(spark, rows, schema="id bigint, text string, w string, pos int, ids string"):
    df = spark.createDataFrame([(*r, "c", 1, "d") for r in rows], schema)
    return tk.encode_corpus(df, key="id", text="text")


def test_ids_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tk.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {r.id: list(r.ids) for r in encoded(spark, list(enumerate(TEXTS))).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}


def test_decoding_gives_the_text_back(spark):
    e = encoded(spark, list(enumerate(TEXTS)))
    assert {r.id: r.text for r in tk.decode_corpus(e, key="id").collect()} == {i: x or "" for i, x in enumerate(TEXTS)}


def test_repeated_rows_null_keys_and_empty_tables(spark):
    got = encoded(spark, [(1, "two words"), (1, "two words"), (None, "x"), (2, None), (2, None)]).collect()
    assert sorted((r.id or -1, len(r.ids)) for r in got) == [(-1, 1), (1, 2), (2, 0)]
    assert encoded(spark, []).collect() == []


def test_heavy_words_take_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tk, "HEAVY", 0.2)
    rows = [(i, "the the the " + "abcdefgh"[i]) for i in range(8)]
    a = {r.id: list(r.ids) for r in encoded(spark, rows).collect()}
    monkeypatch.setattr(tk, "HEAVY", 2.0)
    assert a == {r.id: list(r.ids) for r in encoded(spark, rows).collect()}


def packed(spark, sizes, capacity):
    df = spark.createDataFrame([(i, n, 1, 2) for i, n in enumerate(sizes)], "id bigint, size bigint, n int, b int")
    return pk.pack(df, key="id", size="size", capacity=capacity).collect()


@pytest.mark.parametrize("seed", range(3))
def test_no_container_overflows_and_nothing_is_lost(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([5, 7, 20, 20, 20, rng.randrange(1, 130)]) for _ in range(300)] + [0, None, 250, 100]
    rows = packed(spark, sizes, 100)
    fill = {}
    for r in rows:
        if r.container_id is not None:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    for i, n in enumerate(sizes):
        own = sorted((r.piece_no, r.start, r.n) for r in rows if r.id == i)
        assert sum(x[2] for x in own) == (n or 0)
        assert len(own) == max(1, -(-(n or 0) // 100))
        assert [x[1] for x in own] == [100 * k for k in range(len(own))]
    assert len(fill) <= -(-sum(s or 0 for s in sizes) // 100) * 1.05 + 1


def test_empty_table_and_repeated_items(spark):
    assert packed(spark, [], 10) == []
    rows = packed(spark, [5, 5, 5, 5], 10)
    assert sorted(r.container_id for r in rows) == [0, 0, 1, 1]


def best(largest, counts, capacity):
    """The fullest sum with the largest item, by trying all subsets."""
    rest = [k for k, c in counts.items() for _ in range(c - (k == largest))]
    return max(largest + sum(s) for n in range(len(rest) + 1) for s in itertools.combinations(rest, n) if largest + sum(s) <= capacity)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(30, 60))
def test_the_combination_is_the_fullest(items, capacity):
    counts = {k: items.count(k) for k in items}
    used = pk.fullest(max(items), counts, capacity)
    assert all(used[k] <= counts[k] for k in used)
    assert sum(k * n for k, n in used.items()) == best(max(items), counts, capacity)


def test_the_number_of_combinations_doesnt_follow_the_number_of_items():
    rng = random.Random(4)
    counts = {k: rng.randrange(1, 50) for k in range(1, 300)}
    few = len(pk.combinations(dict(counts), 512))
    many = len(pk.combinations({k: v * 1000 for k, v in counts.items()}, 512))
    assert many <= sum(512 // k for k in counts) and few <= sum(counts.values())


def test_slices_change_nothing(spark, monkeypatch):
    from parley.llm import tokens as tk

    docs = spark.createDataFrame([(i % 7, f"word {i % 5} again and again, word {i % 3}!" * (i % 4)) for i in range(60)], "id int, text string")
    want = {(r.id, tuple(r.ids)) for r in tk.encode_corpus(docs, key="id", text="text").collect()}
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0], pa.int32()), pa.array([["a", "b", "a"], [], ["b"]])], names=["k", "h", "w"])
    rows = [r for b in tk._by_word(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(tk, "SLICE", 1)
    assert [r for b in tk._by_word(iter([batch])) for r in b.to_pylist()] == rows == [{"k": 1, "h": 0, "w": "a", "at": [0, 2]}, {"k": 1, "h": 0, "w": "b", "at": [1]}, {"k": 3, "h": 0, "w": "b", "at": [0]}]
    enc = tk.encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert want == {(r.id, tuple(enc.encode_ordinary(r.text))) for r in docs.collect()}
