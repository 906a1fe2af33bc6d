"""The chains of sentence units on lines labelled by hand that no training has seen; where they part from a plain rule."""

import random
from collections import Counter

import numpy as np
import pytest

from parley.llm import sentences as se

NAMES = ["Vale", "Hume", "Ray", "Oster", "Lind", "Karo", "Munk", "Adler", "Bern", "Holt", "Pell", "Voss"]
HELD_OUT = [
    ["Dr. A. Holt joined the board.", "We expect more of it."],
    ["The plant in St. Oster reopened at 6 a.m. on Monday.", "That may change."],
    ["Sales rose 4.5% in Q2.", "Was it weather?", "It hurt!"],
    ["The call went through Vale Ltd.", "We grew."],
    ["Most came from the U.S.", "They may stay."],
    ["Prof. Lind et al. put it at 3 pts.", "He said so."],
    ['He asked, "Is it where it should be?" and then left.', "They agreed."],
    ["売上高は増加しました。", "「まだです。続きます。」と述べました。"],
]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    name, n = lambda: rng.choice(NAMES), lambda: rng.randint(1, 99)
    makers = [
        lambda: f"Dr. {rng.choice('ABCDEH')}. {name()} joined the board.", lambda: f"Our plant in St. {name()} reopened at 6 a.m. on Monday.", lambda: f"Sales rose {n()}.{n()}% in Q{n()}.", lambda: "Was it weather?",
        lambda: f"Prof. {name()} et al. put it at {n()} pts.", lambda: f"It went through {name()} Ltd.", lambda: "Most came from the U.S.", lambda: "We expect more, and they may change that.", lambda: f"That fell in {n()}, and it hurt us.",
        lambda: "He said so, but we grew.", lambda: f"They agreed with {name()}.", lambda: "売上高は増加しました。", lambda: f"「まだです。続きます。」と{name()}は述べました。", lambda: "รายได้เพิ่มขึ้นในไตรมาสนี้", lambda: "ต้นทุนลดลงเพราะค่าขนส่ง", lambda: f"กำไรอยู่ที่{n()}ล้านบาท",
    ]
    texts = []
    for _ in range(900):
        kind = rng.random()
        some = makers[-3:] if kind < 0.15 else makers[-5:-3] if kind < 0.3 else makers[:-5]
        lines = [("" if some is makers[-5:-3] else " ").join(rng.choice(some)() for _ in range(rng.randint(1, 3))) for _ in range(3)]
        texts.append("\n".join(lines))
    c: Counter = Counter()
    for t in texts:
        for line in t.split("\n"):
            c.update(se.observe(line))
    h = np.array([se.bucket(*k) for k in c], dtype=np.int64)
    order = np.argsort(h)
    counts = se.Counts(h[order], np.array(list(c.values()), dtype=np.float32)[order])
    return se.learn(texts, counts), counts


def ends(text, model):
    return [text[s:e] for s, e in se.units(text, *model)]


def test_held_out_lines(model):
    right = total = 0
    for parts in HELD_OUT:
        got = ends(("" if parts[0][-1] == "。" else " ").join(parts), model)
        right += len(set(got) & set(parts))
        total += max(len(got), len(parts))
    assert right / total >= 0.99, [ends(" ".join(p), model) for p in HELD_OUT]


def test_blanks_of_a_script_without_stops_are_learned_from_stripped_text(model):
    assert ends("ต้นทุนลดลงเพราะค่าขนส่ง รายได้เพิ่มขึ้นในไตรมาสนี้ กำไรอยู่ที่7ล้านบาท", model) == ["ต้นทุนลดลงเพราะค่าขนส่ง", "รายได้เพิ่มขึ้นในไตรมาสนี้", "กำไรอยู่ที่7ล้านบาท"]


def test_stripped():
    text, at, ended = se.stripped("We grew. They (too) fell! Yes", {8, 25})
    assert text == "We grew They (too fell Yes" and [text[:i] for i, e in zip(at, ended, strict=True) if e] == ["We grew", "We grew They (too fell"]
