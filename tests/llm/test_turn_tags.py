"""The token tagger of speaker turns: lines labelled by hand that no training has seen, and noise put into speech."""

import random
import re

from parley.llm import turns as tu

#: Labelled by hand, in the notation of STARTER. None of these lines is trained on.
HELD_OUT = """
S|Operator: F|Um, W|the next question is from Ann Lee.
S|Ann Lee: T|[00:07:12] W|Thanks. M. A. Hume said 10:1 was enough at 7:45 a.m. Central.
S|Ann Lee (Vale Capital): W|Is it price, F|erm... W|or N|[pause] W|mix (mainly in Asia)?
T|(0:11:09) S|LEE, ANN: W|Three items: (1) cost; (2) mix; (3) M. Hart.
W|We held, F|mm-hmm, W|about 4% T|[00:09:10] W|in Q2. N|<crosstalk> W|Well, you know, it is fine.
S|Ann Lee -- Vale Capital: N|*coughs* F|ehm W|We agreed.
S|Operator: N|{background noise}
W|Most of E. M. Hart's N|((phone rings)) W|notes came at 6:30 p.m. F|hmm... W|Eastern.
T|<00:12:55> F|uhh W|Two points: we grew, and N|(applause) W|we will.
S|>> A. Lee: T|[00:03:21] W|H. M. and K. Ray retire N|♪ music ♪ W|soon.
"""
WORDS = "We see headwinds in Canada (mainly weather), and M. A. Hume of Vale Inc. could lower our view at 4:30 p.m. by 3.2% or 20:1 , well, you know".split()


def calls(n=150):
    rng = random.Random(3)
    noise = ["um,", "uh", "hmm...", "erm,", "mm-hmm,", "ah", "uhm", "er,", "ehm", "(applause)", "[pause]", "<crosstalk>", "*coughs*", "{background noise}", "[00:03:12]", "(0:04:10)"]
    nouns, verbs = ["price", "cost", "mix", "volume", "debt", "cash"], ["rose", "fell", "held", "moved"]
    out = []
    for _ in range(n):
        pieces = []
        for who in ("Ann Lee", "Operator", "Bo Munk", "Ann Lee"):
            words = f"In {rng.choice(['May', 'June', 'Asia', 'Canada'])} our {rng.choice(nouns)} {rng.choice(verbs)} by {rng.randint(1, 30)}.{rng.randint(1, 9)}% and M. {rng.choice(['Hart', 'Ray', 'Hume'])} saw {rng.choice(nouns)} at {rng.randint(1, 9)}:30 p.m. on plan.".split()
            for _ in range(rng.randint(0, 2)):
                words.insert(rng.randint(0, len(words)), rng.choice(noise))
            pieces.append((who, " ".join(words)))
        out.append((pieces, [("Ann Lee", "analyst", "Vale Capital"), ("Operator", "operator", None), ("Bo Munk", "executive", "Treasurer")]))
    return out


def tagged(text):
    tokens, tags = [], []
    for part in re.split(r"\s+(?=[STNFW]\|)", text):
        found = tu._TOKEN.findall(part.split("|", 1)[1])
        tokens += found
        tags += ["WSTNF".index(part[0])] * len(found)
    return tokens, tags


def test_held_out_lines():
    model = tu.learn(calls(150))
    roster = tu.Roster([("Ann Lee", "analyst", "Vale Capital"), ("Operator", "operator", None)])
    right = total = 0
    for line in HELD_OUT.strip().split("\n"):
        tokens, gold = tagged(line)
        got = model.tags(tu.seen([tokens], roster))
        right += sum(a == b for a, b in zip(gold, got, strict=True))
        total += len(gold)
    assert right / total >= 0.99, (right, total)


def test_an_initial_is_no_hesitation():
    """A rule by the form of sounds takes M. for one; the chain has learned from its use that it is a word."""
    model = tu.learn(calls(150))
    tokens = "M. A. Hume met M. Hart um, in May.".split()
    tags = model.tags(tu.seen([tokens], tu.Roster([])))
    assert [t for t, g in zip(tokens, tags, strict=True) if g == tu.FILL] == ["um,"]


def test_use_tells_words_from_what_is_put_in():
    use = tu.usage([tu._TOKEN.findall(text) for pieces, _ in calls(200) for _, text in pieces])
    assert use["m."] is False and use["our"] is False and use["um"] is True and use["[x"] is True and use["(0:"] is True


def test_viterbi_need_not_run_where_tags_are_sure():
    model = tu.learn(calls(10))
    row = tu.seen([WORDS], tu.Roster([]))
    assert model.tags(row) == tu.viterbi([model.emission(x) for x in row], model.moves)
