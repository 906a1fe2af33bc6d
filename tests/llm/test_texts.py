"""Sentences, defects, turns and garbled texts: cases, properties and held-out accuracy."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import garbled as gb
from parley.llm import pair_defects as pd_
from parley.llm import sentences as se
from parley.llm import turns as tu

FILLER = [
    "We started this in 2014.", "Our plant in St. Ivo reopened at 6 a.m. on Monday.", "Most of the demand came from the U.S.", "Mr. Vale will cover it in a moment.", "Revenue rose 4.5% in Q2.",
    "Frankly, it hurt.", "How should we think about it?", "Was it weather?", "That may change.", "The call ended at 5 p.m.", "Everything went through Vale Ltd.", "We expect more.",
    "当四半期の売上高は増加しました。", "รายได้เพิ่มขึ้นในไตรมาสนี้", "ต้นทุนลดลงเพราะค่าขนส่ง", "Die Kosten lagen bei ca. 5 Mio. Euro.", "La marge progresse.", "Расходы снизились.",
]


def found(spark, texts):
    rng = random.Random(0)
    rows = [(f"f{i}", "\n".join(rng.sample(FILLER, 3)), "x", 1) for i in range(600)] + [(f"t{i}", t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, text string, unit string, start_char int")
    out = {}
    for r in se.sentence_units(df, key="id", text="text").where("id like 't%'").orderBy("id", "start_char").collect():
        assert texts[int(r.id[1:])][r.start_char : r.end_char] == r.unit
        out.setdefault(int(r.id[1:]), []).append(r.unit)
    return out


def test_sentences(spark):
    cases = [
        (["We started this in 2014.", "Our plant in St. Ivo reopened at 6 a.m. on Monday."], " "),
        (["Mr. Vale will cover it in a moment.", "Was it weather?", "That may change!"], "  "),
        (["no stop here", "  indented line", "Q2"], "\n"),
        (['He asked, "Is it where it should be?" and then answered.', "We expect more."], " "),
        (["当四半期の売上高は増加しました。", "「まだです。続きます。」と述べました。"], ""),
        (["ต้นทุนลดลงเพราะค่าขนส่ง", "รายได้เพิ่มขึ้นในไตรมาสนี้"], " "),
        (["Revenue rose 4.5% in Q2.", "Die Kosten lagen bei ca. 5 Mio. Euro."], " "),
        (["It closed at 9.5.", "Frankly, it hurt."], "\r\n"),
    ]
    texts = [sep.join(parts) for parts, sep in cases] + [None, "", " \n \t", "...", "—"]
    got = found(spark, texts)
    for i, (parts, _) in enumerate(cases):
        assert got[i] == [p.strip() for p in parts], texts[i]
    assert all(i not in got for i in range(len(cases), len(cases) + 3))
    assert got[len(cases) + 3] == ["..."] and got[len(cases) + 4] == ["—"]


def test_sentences_of_an_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert se.sentence_units(df, key="id", text="text").collect() == []
    df = spark.createDataFrame([("a", "One. Two."), ("a", "One. Two."), (None, "x.")], "id string, text string")
    rows = [tuple(r)[1:3] for r in se.sentence_units(df, key="id", text="text").orderBy("start_char").collect()]
    # The row came out once, whatever a model of four words takes for a unit: all of it and nothing twice.
    assert rows in ([(0, 9)], [(0, 4), (5, 9)])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1 .!?。」「\"“”«»\n\r ก่า日(),", max_size=60))
def test_units_cover_every_character_once(text):
    import numpy as np

    counts = se.Counts(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))
    chain = (se.Chain({"1": 0.1, "next=upper": 1.0}, (0.0, 0.0)), se.Chain({"1": 0.1}, (0.0, 0.0)))
    at = 0
    for s, e in se.units(text, chain, counts):
        assert at <= s < e <= len(text) and not text[at:s].strip() and text[s:e] == text[s:e].strip()
        at = e
    assert not text[at:].strip()


ENGLISH = ["The main driver was weather, which cost us $5 million.", "We plan to reach 4% by the end of 2020.", "Yes, pricing rose by 3%, mostly because of tariffs.", "It was roughly half volume and half price, so pricing held."]
GERMAN = ["Die Kosten lagen über dem Plan des Vorjahres.", "Wir bleiben vorsichtig, weil die Währung drückt.", "Der Umsatz stieg im Quartal deutlich an."]


def test_pair_defects(spark):
    q = "Thanks. What drove the move in pricing?"
    cases = {
        "empty": [None, "", "  ", "N/A", "[inaudible]", "<p></p>", "--", "null", "​", "..."],
        "copied": [q, q.upper(), f"{q} {q}", "  What  drove  the  move  in  pricing? ", f'You asked: "{q}"'],
        "refusal": ["We do not comment on pricing.", "That is not something we disclose, sorry.", "Look, we are going to decline to answer that one, so let us move on. Thank you."],
        "other_language": [" ".join(GERMAN), GERMAN[0] + " " + GERMAN[1]],
        "truncated": ["The main driver was weather, which cost", "We plan to reach 4% by the", "It was roughly half volume and half pri", "Yes, pricing rose by 3%, mostly…", "We plan to reach 4% by the end of [cut]"],
        None: ["Yes.", "No, not this year", *ENGLISH, f"{q} {ENGLISH[0]}", "We cannot give the split, but in total it was 5%.", "None at all."],
    }
    rng = random.Random(5)
    rows, want = [], {}
    for d, answers in cases.items():
        for a in answers:
            i = f"c{len(rows)}"
            rows.append((i, q, a, "x"))
            if d:
                want[i] = d
    rows += [(f"n{i}", q, " ".join(rng.sample(ENGLISH, 2)), "x") for i in range(200)] + [(f"s{i}", q, "No, not this year", "x") for i in range(9)]
    rows += [(f"g{i}", "Wie hat sich der Umsatz des Quartals entwickelt?", " ".join(rng.sample(GERMAN, 2)), "x") for i in range(60)]
    rows += [(None, q, "", "x"), rows[0], ("nq", None, ENGLISH[0], "x")]
    pairs = spark.createDataFrame(rows, "id string, q string, a string, defect string")
    texts = spark.createDataFrame([(" ".join(rng.choices(ENGLISH, k=3)), "en") for _ in range(50)] + [(" ".join(rng.choices(GERMAN, k=3)), "de-XX") for _ in range(50)] + [(None, "en"), ("", None)], "text string, lang string")
    got = [(r.id, r.defect) for r in pd_.pair_defects(pairs, texts, key="id", question="q", answer="a", labelled_text="text", label="lang").collect()]
    assert dict(got) == want and len(got) == len(want)


def test_pair_defects_of_empty_tables(spark):
    pairs, texts = spark.createDataFrame([], "id string, q string, a string"), spark.createDataFrame([], "text string, lang string")
    assert pd_.pair_defects(pairs, texts, key="id", question="q", answer="a", labelled_text="text", label="lang").collect() == []


PEOPLE = [("Operator", "operator", None), ("Ada Vale", "executive", "Chief Financial Officer"), ("Bo Munk", "analyst", "Oxbar Capital"), ("Cy Holm", "executive", "President")]


def turns(spark, calls, people=PEOPLE):
    kind = "id bigint, content string, s array<struct<speaker:string,role:string,section:string,text:string>>, turn_no int"
    extra = [(100 + i, None, [("Ada Vale", None, None, f"[00:0{i % 6}:10] We, um, grew (applause) 5% in Q{i % 4 + 1}."), ("Operator", None, None, "uh — Next: question, please."), ("B. Munk", None, None, "<crosstalk> Two points: (1) price; (2) cost."), ("Audience", None, None, "[laughter] uh...")], 0) for i in range(40)]
    df = spark.createDataFrame([(i, c, s, 0) for i, c, s in calls] + extra, kind)
    roster = spark.createDataFrame([(i, *p) for i in [*{c[0] for c in calls if c[0] is not None}, *range(100, 140)] for p in people], "id bigint, speaker string, role string, title string")
    rows = tu.clean_turns(df, roster, key="id", content="content", structured="s").where("id < 100").orderBy("id", "turn_no").collect()
    return {i: [(r.turn_no, r.speaker, r.text, r.n_words) for r in rows if r.id == i] for i in {r.id for r in rows}}


def test_turns(spark):
    content = "Conference Operator: Hmm, welcome.\n\nVale, Ada:\nWe grew um, 5% (in constant currency) at 4:30 p.m. Eastern.\n\nOne more thing: it held.\n\nSpeaker 1: [laughter] uh...\n\nCFO: *coughs* Well, you know.\n\n>> bo munk -- Oxbar Capital: Why?"
    pieces = [("Mr. Holm", None, None, "[00:02:00] Second."), ("BO MUNK", None, None, "[00:01:00] First (0:01:30) half."), (None, None, None, "[00:03:00] Still second."), ("Ada Vael", "executive", None, "[00:04:00] ♪ music ♪ Third, erm, er.")]
    got = turns(spark, [(1, content, None), (2, "Operator: not used.", pieces), (3, None, None), (4, "", []), (5, "no label at all", None), (1, content, None), (None, content, None)])
    assert got[1] == [(0, "Operator", "welcome.", 1), (1, "Ada Vale", "We grew 5% (in constant currency) at 4:30 p.m. Eastern. One more thing: it held. Well, you know.", 18), (2, "Bo Munk", "Why?", 1)]
    assert got[2] == [(0, "Bo Munk", "First half.", 2), (1, "Cy Holm", "Second. Still second.", 3), (2, "Ada Vale", "Third,", 1)]
    assert got[5] == [(0, None, "no label at all", 4)]
    assert set(got) == {1, 2, 5}


def test_turns_of_empty_tables(spark):
    df = spark.createDataFrame([], "id bigint, content string, s array<struct<speaker:string,role:string,section:string,text:string>>")
    roster = spark.createDataFrame([], "id bigint, speaker string, role string, title string")
    assert tu.clean_turns(df, roster, key="id", content="content", structured="s").collect() == []


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "ab", 1), ("abcd", "xbcd", 1), ("abcd", "badc", 2), ("abc", "xyz", 3)])
def test_distance(a, b, d):
    assert tu.distance(a, b) == d


CLEAN = [
    "Café and résumé are naïve — “quoted” words.", "Die Größe der Geschäfte für Österreich wächst.", "L’été dernier, les coûts ont été réduits.", "¿Cómo evolucionó el margen del año?", "Выручка выросла в третьем квартале.",
    "営業利益率は改善しています。", "当四半期の売上高は増加しました。", "毛利率达到三个百分点，高于去年同期。", "Não haverá alteração na política.", "Plain words only.", "It costs £5 – about €6 or 40 °C.",
]


def garble(text, true, wrong, times=1):
    for _ in range(times):
        raw = text.encode(true, "strict")
        text = "".join(bytes([b]).decode(wrong) if _ok(b, wrong) else chr(b) for b in raw)
    return text


def _ok(b, codec):
    try:
        bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return False
    return True


def test_garbled_texts_are_restored_and_clean_ones_left(spark):
    rng = random.Random(6)
    docs, want = [], {}
    for i in range(900):
        docs.append((i, " ".join(rng.sample(CLEAN, 3)), "x", 1))
    chains = [("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 2), ("cp1251", "cp1252", 1), ("cp932", "cp1252", 1), ("cp1252", "mac_roman", 1), ("utf-8", "mac_roman", 1), ("cp1252", "cp437", 1)]
    for k in range(80):
        true, wrong, times = chains[k % len(chains)]
        pool = {"cp1251": CLEAN[4:5], "cp932": CLEAN[5:7], "cp1252": CLEAN[0:4]}.get(true, CLEAN[:9])
        part = rng.choice(pool)
        whole = f"{CLEAN[9]}\n{part}"
        docs.append((1000 + k, f"{CLEAN[9]}\n{garble(part, true, wrong, times)}", "x", 1))
        want[1000 + k] = whole
    docs += [(2000, "lost � here", "x", 1), (2001, None, "x", 1), (2002, "", "x", 1), (2003, "Plain ASCII " * 3000, "x", 1)]
    df = spark.createDataFrame(docs, "id bigint, text string, restored string, orig_chars int")
    got = {r.id: (r.restored, r.orig_chars) for r in gb.restore_encoding(df, key="id", text="text").collect()}
    assert got.pop(2000)[1] == 0
    assert not [i for i in got if i not in want]
    right = sum(got.get(i, ("", 0)) == (t, len(t)) for i, t in want.items())
    wrong = [(docs[900 + i - 1000][1], got.get(i)) for i, t in want.items() if got.get(i, ("", 0)) != (t, len(t))]
    assert right >= 0.95 * len(want), wrong


def test_garbled_of_an_empty_table(spark):
    assert gb.restore_encoding(spark.createDataFrame([], "id bigint, text string"), key="id", text="text").collect() == []


def test_margins_are_validated_on_all_clean_records(spark):
    import random

    import numpy as np

    from parley.llm import garbled

    assert not hasattr(garbled, "SAMPLE")
    draw = random.Random(5)
    for zeros in (0, 100, 3000, 9000):
        gains = [(draw.choice([0.0, draw.expovariate(0.05)]), draw.expovariate(0.1)) for _ in range(5000)]
        rows = [(1, *map(garbled._bits, x)) for x in gains] + [(0, garbled._bits(1e6), garbled._bits(1e6)), (zeros, 0, 0)]
        got = garbled.margins_of(spark.createDataFrame(rows, "clean bigint, a bigint, b bigint").repartition(5))
        want = [max(m, garbled.SLACK * np.percentile([*[g[k] for g in gains], *[0.0] * zeros], 100 * (1 - garbled.TAIL))) for k, m in enumerate(garbled.MARGINS)]
        assert np.allclose(got, want)
    assert garbled.margins_of(spark.createDataFrame([], "clean bigint, a bigint, b bigint")) == garbled.MARGINS
