"""Sentence units in any language and script by a linear-chain model over characters.

Every character is inside a unit or its last one. Only few can be the last: closing marks of a run of stops, characters
before a blank between letters of a script without stops, and ends of lines, which always are. Viterbi decoding runs
over those, all others being inside with certainty.

The model's evidence is counted over the whole corpus: how often a word opens or closes a line, and how often it comes
with and without a point. Its weights are learned by a perceptron with averaged weights from a bounded sample, whose
labels are found in the texts themselves (`natural`): a line's end is one still when the next line is joined to it, a
stop before a word in lower case ends nothing, nor does the point of a word that many times never ended a line. What
these leave open is filled in by the best way through, as the weights become known.

For scripts without stops a chain of its own is learned from text that has them: its stops are stripped, and where they
stood is the label of the blanks left. Lines of those scripts, joined, are added to it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.tables import cut, spread

#: Texts at most that the weights are learned from.
TRAIN = 3000
EPOCHS = 5
#: Share of all that is counted which a word or pair of words must have to be kept: at most 1 / RARE are.
RARE = 2e-7
#: Times that a word with a point must occur, never at the end of a line, to be known to end nothing.
NEVER = 10
#: Share of a word's occurrences that are followed by the same word from which both are a phrase, which tells nothing.
FIXED = 0.2

STOPS = ".!?…。！？｡।॥؟۔"
WIDE = "。！？｡"
OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‘": "’", "(": ")", "（": "）", "[": "]", "‹": "›"}
CLOSE = "\"'”’»」』)）]›“"
#: Scripts without stops: a blank between two of their letters may end a unit. Thai, Lao, Khmer, Myanmar.
NO_STOP = re.compile("[฀-໿က-႟ក-៿]")
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
#: Common abbreviations that sentences seldom end with, without their points.
ABBREVIATIONS = set(
    "mr mrs ms dr prof gov sen rep gen col capt lt st rev hon messrs vs approx no nos fig figs dept est incl excl resp jan feb mar apr jun jul aug sep sept oct nov dec "
    "i.e e.g cf viz al ca bzw usw z b d h u a mio mrd nr str hr fr env m mme mlle mm p ex av ave aprox sr sra srta dra ee núm pág руб млн млрд тыс т е г д ул inc corp co ltd etc".split()
)
_STOP_RUN = re.compile(f"[{re.escape(STOPS)}]+[{re.escape(CLOSE)}]*")
_ORDINAL = re.compile(r"(?:^|\s)\d{1,2}\.$")
_GLUED = re.compile(r"[A-Za-zß-ÿ]{2}[a-zß-ÿ]|\d[%x]?|[)%]$")
_LATIN = re.compile(r"[^\W฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]+")
_NARROW = re.compile(rf"[   ]+[!?»]+[{re.escape(STOPS + CLOSE)}]*")


def bucket(kind: int, *parts: str) -> int:
    """64 bits of a word or pair of words of a kind."""
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"), seed=kind) - (1 << 63)


def folded(word: str) -> str:
    return re.sub(r"\d[\d.,]*\d|\d", "0", word)


def following(text: str, at: int, n: int = 2) -> list[str]:
    """Up to n words from a place on, opening marks left out; two characters each where words aren't spaced."""
    while at < len(text) and (text[at].isspace() or text[at] in "\"'“„«「『‘(¿¡•-—–*"):
        at += 1
    if at < len(text) and UNSPACED.match(text[at]):
        return [text[at : at + 2], text[at : at + 4]][:n]
    # A spaced script's word inside an unspaced one ends where that begins.
    if (m := _LATIN.match(text, at)) and m.end() < len(text) and UNSPACED.match(text[m.end()]):
        return [folded(m.group())]
    words = text[at : at + 80].split(None, n)[:n]
    return [folded(w.rstrip(CLOSE + ",;:")) if i else folded(w) for i, w in enumerate(words)]


def preceding(text: str, end: int, n: int = 2) -> list[str]:
    """Up to n words that end at a place, the last first; stops but points, and closing marks, left out."""
    while end > 0 and (text[end - 1].isspace() or text[end - 1] in CLOSE + "!?…。！？｡।॥؟۔"):
        end -= 1
    if end and UNSPACED.match(text[end - 1]):
        return [text[max(0, end - 2) : end], text[max(0, end - 4) : end]][:n]
    words = text[max(0, end - 80) : end].split()
    return [folded(w.lstrip("\"'“„«「『‘(¿¡")) for w in words[: -n - 1 : -1]]


def observe(line: str) -> Iterator[tuple]:
    """(kind, words) of what a line shows."""
    if not line.strip():
        return
    first, last = following(line, 0), preceding(line, len(line))
    if first:
        yield 1, first[0]
    if len(first) > 1:
        yield 3, *first
    if last:
        yield 4, last[0]
    if len(last) > 1:
        yield 5, *last
    words = [folded(w.strip("\"'“„«」「『‘(¿¡”’»)")) for w in line.split()]
    if (m := _LATIN.match(line)) and m.end() < len(line) and UNSPACED.match(line[m.end()]):
        yield 0, folded(m.group())
    for i, w in enumerate(words):
        yield 0, w
        if i:
            yield 2, words[i - 1], w
        yield 6, w.rstrip(".,;:!?"), "." if w.endswith(".") else ""
        if w.endswith(".") and words[i + 1 : i + 2] and words[i + 1][:1].islower() and words[i + 1].islower():
            yield 7, w
    for m in UNSPACED.finditer(line):
        yield 0, line[m.start() : m.start() + 2]


class Counts:
    """Exact counts by kind and words: hashes in order, and how often."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.h, self.n = hashes, counts
        self.get = lru_cache(maxsize=500_000)(self._get)

    def _get(self, kind: int, *words: str) -> float:
        h = bucket(kind, *words)
        i = int(np.searchsorted(self.h, h))
        return float(self.n[i]) if i < len(self.h) and self.h[i] == h else 0.0

    def opens(self, words: list[str], less: int = 0) -> float:
        """How much of what begins with a word, or with two, begins a line; below 0 for a word hardly known.

        `less` lines are left out of account: the one that is asked about, where that is known to begin one.
        """
        if not words:
            return 0.0
        known, first = max(0.0, self.get(0, words[0]) - less), max(0.0, self.get(1, words[0]) - less)
        if known < 5 and not first:
            return -1.0
        one = first / max(1.0, known)
        if len(words) > 1 and (n := self.get(2, *words) - less) >= 3:
            return max(one if n < 20 else 0.0, max(0.0, self.get(3, *words) - less) / n)
        return one

    def closes(self, words: list[str], less: int = 0) -> float:
        """How much of what ends with a word, or with two where they are known, ends a line."""
        if not words:
            return 0.0
        letter = len(words[0]) == 2 and words[0][0].isalpha()
        if letter and len(words) == 1:
            return 0.0
        if len(words) > 1 and (n := self.get(2, words[1], words[0]) - less) >= (3 if letter else 20) or letter:
            return max(0.0, self.get(5, *words) - less) / max(n, 1.0)
        return max(0.0, self.get(4, words[0]) - less) / max(1.0, self.get(0, words[0]) - less)

    def goes_on(self, words: list[str]) -> float:
        """How often a word with a point is followed by a word in lower case."""
        return self.get(7, words[0]) / max(1.0, self.get(0, words[0])) if words else 0.0

    def lowered(self, words: list[str]) -> str:
        """Whether a capitalised word is known in lower case: then its capital marks a beginning."""
        if not words or not words[0][:1].isupper():
            return "-"
        return "y" if self.get(6, words[0].lower().rstrip(".,;:!?"), "") >= 3 else "n"

    def pointed(self, word: str) -> float:
        """How much of a word comes with a point."""
        stem = word.rstrip(".")
        with_point = self.get(6, stem, ".")
        return with_point / max(1.0, with_point + self.get(6, stem, ""))


def abbreviated(word: str, counts: Counts, ordinal: bool) -> str:
    """What kind of word a point ends: listed, letter, inner (U.S.), number (that may be an ordinal), always or word."""
    stem = word.rstrip(".")
    low = stem.lower().lstrip("-–—")
    if len(low) == 1 and low.isalpha():
        return "letter"
    if low in ABBREVIATIONS:
        return "listed"
    if "." in stem and not any(c.isdigit() for c in stem):
        return "inner"
    if stem and stem[-1].isdigit():
        return "number" if ordinal else "word"
    known = counts.get(6, stem, ".")
    if len(stem) <= 5 and known >= 5 and counts.pointed(word) > 0.97 and counts.closes([word]) < 0.02:
        return "always"
    return "word"


def quotes(line: str) -> list[int]:
    """For each character the place after the mark that closes the quotation it stands in, 0 outside.

    A mark without its partner in the line opens nothing.
    """
    inside = [0] * len(line)
    at = 0
    while at < len(line):
        c = line[at]
        end = -1
        if c == '"':
            end = line.find('"', at + 1)
        elif c in OPEN and not (c == "‘" or c == "“" and at and line[at - 1] not in " \t (—–-「" and not UNSPACED.match(line[at - 1]) and line[at - 1] not in STOPS):
            ends = [e for x in OPEN[c] if (e := line.find(x, at + 1)) >= 0]
            end = min(ends) if ends else -1
        if end > at:
            for i in range(at + 1, end):
                inside[i] = end + 1
            at = end + 1
        else:
            at += 1
    return inside


def candidates(line: str) -> list[tuple[int, str]]:
    """(end, kind) of each place in a line where a unit may end; the end of the line is not among them."""
    out = {}
    last = len(line.rstrip())
    for m in _STOP_RUN.finditer(line):
        end = m.end()
        # “ closes what „ has opened, and opens elsewhere.
        while "“" in (marks := line[m.start() : end]) and line.count("„", 0, end) < line.count("“", 0, end):
            end = m.start() + marks.rindex("“")
        # A closing mark after a blank, as in French, belongs to the unit.
        if n := _NARROW.match(line, end):
            if "»" in n.group() or "!" in n.group() or "?" in n.group():
                end = n.end()
        wide = any(c in WIDE for c in m.group())
        if end < last and (line[end].isspace() or wide or line[end - 1] in CLOSE and UNSPACED.match(line[end])):
            out[end] = "wide" if wide else m.group()[0]
        elif end < last and line[end].isupper() and _GLUED.search(line[max(0, m.start() - 3) : m.start()]):
            out[end] = "glued"
    for i in range(1, last - 1):
        if not line[i].isspace() or line[i - 1].isspace():
            continue
        k = i
        while line[k].isspace():
            k += 1
        if NO_STOP.match(line[i - 1]) and line[k].isalnum() or NO_STOP.match(line[k]) and (line[i - 1].isalnum() or line[i - 1] == "%"):
            out.setdefault(i, "blank")
    return sorted(out.items())


def next_kind(line: str, at: int) -> str:
    while at < len(line) and line[at].isspace():
        at += 1
    c = line[at] if at < len(line) else ""
    if not c:
        return "none"
    if c in "([":
        return "paren"
    if c in "\"'“„«「『‘¿¡":
        return "quote"
    if c.isdigit():
        return "digit"
    if c.islower():
        word = line[at : at + 40].split()[0]
        return "mixed" if any(x.isupper() for x in word) else "lower"
    if c.isupper():
        return "upper"
    return "other" if c.isalpha() else "mark"


def grade(x: float) -> str:
    return "u" if x < 0 else "0" if x == 0 else "a" if x < 0.02 else "b" if x < 0.1 else "c" if x < 0.3 else "d"


def describe(line: str, cands: list[tuple[int, str]], counts: Counts, joints: frozenset | set = frozenset()) -> list[dict[str, str]]:
    """The evidence at each candidate; at joined lines without what the joint itself has added to the counts."""
    inside = quotes(line)
    out = []
    for end, kind in cands:
        run = line[:end].rstrip(CLOSE + "   ")
        words, after = preceding(line, end), following(line, end)
        prev = words[0] if words else ""
        goes_on = ""
        if 0 < end < len(line) and inside[end - 1]:
            close = inside[end - 1]
            rest = line[close:].lstrip()
            goes_on = "end" if not rest else "on" if rest[0] in ",;:—–-、，" or next_kind(line, close) in ("lower",) or not line[close : close + 1].isspace() else "new"
        closed = line[end - 1] in CLOSE and line[end - 1] != ")"
        out.append(
            {
                "kind": "run" if run.endswith("..") and not run.endswith("...") else "dots" if run.endswith(("...", "…")) else kind,
                "prev": abbreviated(prev, counts, bool(_ORDINAL.search(run))) if kind == "." else "-",
                "closes": grade(counts.closes(words, int(end in joints))),
                "opens": grade(counts.opens(after, int(end in joints))),
                "case": counts.lowered(after),
                "goes": grade(counts.goes_on(words)),
                "next": next_kind(line, end),
                "inside": goes_on,
                "closed": str(closed),
                "spaced": str(line[end].isspace()),
            }
        )
    return out


def natural(line: str, cands: list[tuple[int, str]], ds: list[dict[str, str]], counts: Counts, joints: set[int]) -> list[bool | None]:
    """What the texts themselves tell of each candidate, None where they don't.

    `joints` are places where lines were joined: they are ends. Words in lower case don't begin a unit, nor does what
    goes on behind a quotation; a word mostly in lower case has a capital at a beginning. An abbreviation that often
    ends lines, and that nothing in lower case follows, ends a unit. A word whose point was seen often, and never at the
    end of a line, doesn't end one, nor does an abbreviation before a word that never begins a line;
    a stop other than a point, before a capital or in a script without them, does, outside quotations.
    """
    out: list[bool | None] = []
    for (end, kind), d in zip(cands, ds, strict=True):
        words = preceding(line, end)
        told: bool | None = None
        if end in joints:
            told = True
        elif d["inside"] == "on" or kind != "blank" and (d["next"] == "mark" or (after := following(line, end, 1)) and after[0][:1].islower() and after[0].islower()):
            told = False
        elif d["closed"] == "True" and d["spaced"] == "False" and d["opens"] in "0ua":
            told = False
        elif kind in (".", "glued") and d["case"] == "y" and (kind == "glued" or d["prev"] in ("word", "always") or d["prev"] == "listed" and d["closes"] in "abcd") and not d["inside"]:
            told = True
        elif kind == "." and d["prev"] in ("inner", "listed", "letter") and d["opens"] == "0" and d["case"] != "y" and counts.get(0, *following(line, end, 1)) >= 5 * NEVER:
            told = False
        elif kind == "." and d["next"] == "upper" and d["goes"] == "0" and d["closes"] in ("c", "d") and d["prev"] in ("listed", "letter") and not d["inside"]:
            told = True
        elif kind == "." and words and (n := counts.get(0, words[0])) >= NEVER and counts.get(4, words[0]) == 0 and counts.closes(words) == 0:
            after = following(line, end, 1)
            told = False if not after or counts.get(2, words[0], after[0]) < FIXED * n else None
        elif kind in ("!", "?", "wide") and not d["inside"] and d["closed"] == "False" and d["next"] in ("upper", "other", "quote"):
            told = True if kind == "wide" or d["opens"] in "bcd" or d["case"] == "y" else None
        out.append(told)
    return out


def features(d: dict[str, str]) -> tuple[str, ...]:
    one = [f"{k}={v}" for k, v in d.items()]
    two = [f"{a}{b}={d[a]}|{d[b]}" for a, b in (("prev", "opens"), ("prev", "closes"), ("next", "opens"), ("kind", "next"), ("inside", "next"), ("closed", "spaced"), ("kind", "inside"))]
    three = [f"3={d['prev']}|{d['closes']}|{d['opens']}", f"0={d['prev']}|{d['closes']}|{d['goes']}|{d['next']}", f"4={d['prev']}|{d['next']}|{d['opens']}", f"5={d['closed']}|{d['spaced']}|{d['opens']}", f"6={d['kind']}|{d['opens']}|{d['next']}", f"7={d['prev']}|{d['closes']}|{d['case']}", f"8={d['kind']}|{d['prev']}|{d['case']}|{d['next']}", f"9={d['inside']}|{d['kind']}|{d['next']}"]
    return (*one, *two, *three, "1")


class Chain:
    """Weights for `last` against `inside` at a candidate, and of a unit's end following an end or no end before."""

    def __init__(self, weights: dict[str, float], moves: tuple[float, float]) -> None:
        self.weights, self.moves = weights, moves
        self.emit = lru_cache(maxsize=100_000)(lambda f: sum(self.weights.get(x, 0.0) for x in f))

    def decode(self, feats: list[tuple[str, ...]]) -> list[bool]:
        """The best tags, by Viterbi; before the first candidate stands the end of a unit."""
        return best_tags([self.emit(f) for f in feats], self.moves)


def best_tags(emissions: list[float], moves: tuple[float, float], fixed: list[bool | None] | None = None) -> list[bool]:
    """The best tags under the scores of `last`; those that are `fixed` stay."""
    no, yes, back = -1e9, 0.0, []
    for i, e in enumerate(emissions):
        back.append((yes > no, yes + moves[1] > no + moves[0]))
        no, yes = max(no, yes), max(no + moves[0], yes + moves[1]) + e
        if fixed is not None and fixed[i] is not None:
            no, yes = (-1e9, yes) if fixed[i] else (no, -1e9)
    tags, tag = [], yes > no
    for b in reversed(back):
        tags.append(tag)
        tag = b[int(tag)]
    return tags[::-1]


#: Features of the candidates, tags where they are known, and whether neighbouring tags are like those to be decoded.
Example = tuple[list[tuple[str, ...]], list[bool | None], bool]


def perceptron(data: list[Example]) -> Chain:
    """Averaged weights; a tag that is open is what the best way through the known ones makes it."""
    w: dict[str, float] = defaultdict(float)
    s: dict[str, float] = defaultdict(float)
    moves, sums, step = [0.0, 0.0], [0.0, 0.0], 1
    for _ in range(EPOCHS):
        for feats, told, chained in data:
            e = [sum(w[x] for x in f) for f in feats]
            # A tag that is known must win by a margin.
            got = best_tags([x + (0.0 if t is None else -1.0 if t else 1.0) for x, t in zip(e, told, strict=True)], (moves[0], moves[1]))
            if any(t is not None and t != g for t, g in zip(told, got, strict=True)):
                gold = best_tags(e, (moves[0], moves[1]), told)
                for i, (a, b) in enumerate(zip(gold, got, strict=True)):
                    if a != b:
                        for f in feats[i]:
                            w[f] += 1 if a else -1
                            s[f] += step if a else -step
                    for tags, sign in ((gold, 1), (got, -1)):
                        if tags[i] and chained:
                            k = int(tags[i - 1]) if i else 1
                            moves[k] += sign
                            sums[k] += sign * step
            step += 1
    return Chain({k: v - s[k] / step for k, v in w.items()}, (moves[0] - sums[0] / step, moves[1] - sums[1] / step))


def joined(lines: list[str]) -> Iterator[tuple[str, set[int]]]:
    """Each line with the next one of its text, and the place where they meet."""
    for a, b in zip(lines, lines[1:], strict=False):
        if a.strip() and b.strip():
            a = a.strip()
            yield f"{a} {b.strip()}", {len(a)}


def stripped(line: str, ends: set[int]) -> tuple[str, list[int], list[bool]]:
    """A line without its stops, its blanks, and whether a unit ended at each."""
    out, at, told = [], [], []
    size = 0
    for i, c in enumerate(line):
        if c in STOPS or c in CLOSE:
            continue
        if c.isspace():
            if size and not out[-1].isspace():
                at.append(size)
                told.append(i in ends)
            else:
                continue
        out.append(c)
        size += 1
    while at and at[-1] >= size - 1:
        at.pop()
        told.pop()
    return "".join(out), at, told


def learn(texts: list[str], counts: Counts) -> tuple[Chain, Chain]:
    """The chains for stops and for blanks of scripts without them."""
    data: list[Example] = []
    lines = [(line, joints) for t in texts for parts in [t.split("\n")] for line, joints in [*((x, set()) for x in parts), *joined(parts)]]
    plain, blanks = [], []
    for line, joints in lines:
        cands = candidates(line)
        stops = [c for c in cands if c[1] != "blank"]
        if stops:
            ds = describe(line, stops, counts, joints)
            data.append(([features(d) for d in ds], natural(line, stops, ds, counts, joints), True))
            if not joints and not NO_STOP.search(line):
                plain.append((line, stops, data[-1]))
        if joints and (gaps := [c for c in cands if c[1] == "blank"]):
            blanks.append(([features(d) for d in describe(line, gaps, counts, joints)], [True if end in joints else None for end, _ in gaps], True))
    stop_chain = perceptron(data)
    # Where stops stood is known from texts that have them: there the other chain learns what blanks without them mean.
    bare: list[Example] = []
    for line, stops, (feats, told, _) in plain:
        tags = [t if t is not None else g for t, g in zip(told, stop_chain.decode(feats), strict=True)]
        text, at, ended = stripped(line, {end for (end, _), last in zip(stops, tags, strict=True) if last})
        if any(ended):
            bare.append(([features(d) for d in describe(text, [(i, "blank") for i in at], counts)], list(ended), False))
    return stop_chain, perceptron(bare + blanks)


def line_ends(line: str, chains: tuple[Chain, Chain], counts: Counts) -> list[int]:
    """Where units end within a line: stops by the first chain, blanks by the second."""
    cands = candidates(line)
    out = []
    for chain, part in ((chains[0], [c for c in cands if c[1] != "blank"]), (chains[1], [c for c in cands if c[1] == "blank"])):
        if part:
            tags = chain.decode([features(d) for d in describe(line, part, counts)])
            out += [end for (end, _), last in zip(part, tags, strict=True) if last]
    return sorted(out)


def units(text: str, chains: tuple[Chain, Chain], counts: Counts) -> Iterator[tuple[int, int]]:
    """(start, end) of each unit of a text, in characters."""
    base = 0
    for line in re.split("[\n\u2028\u2029]", text):
        at = 0
        for end in (*line_ends(line, chains, counts), len(line)):
            part = line[at:end]
            bare = part.strip()
            if bare:
                start = base + at + len(part) - len(part.lstrip())
                yield start, start + len(bare)
            at = end
        base += len(line) + 1


def sentence_units(texts: DataFrame, *, key: str, text: str) -> DataFrame:
    """`key`, start_char, end_char (exclusive, in code points of the stored text) and unit of each sentence unit.

    Null and blank texts have no unit, null keys are left out, repeated rows come out once. Every non-space character
    is in exactly one unit of its text.
    """
    some = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket(*k) for k in sums], pa.int64()), pa.array(sums.values(), pa.int64())], names=["h", "n"])

        for b in batches:
            for x in b.column(0).to_pylist():
                for line in x.split("\n"):
                    sums.update(observe(line))
            if len(sums) > 400_000:
                yield out()
                sums.clear()
        yield out()

    counted = cut(spread(some.select(text)).mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = counted.where(F.col("n") >= total * RARE).orderBy("h").toArrow()
    tables = (kept.column("h").to_numpy(), kept.column("n").to_numpy().astype(np.float32))
    chains = learn([r[text] for r in some.orderBy(F.xxhash64(key), key, text).limit(TRAIN).select(text).distinct().collect()], Counts(*tables))
    sent = texts.sparkSession.sparkContext.broadcast((tables, [(c.weights, c.moves) for c in chains]))
    rows = some.repartition(key).distinct()
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = Counts(*sent.value[0]), tuple(Chain(*c) for c in sent.value[1])
        for b in batches:
            rows, starts, ends, parts = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for s, e in units(t, model, known):
                    rows.append(i)
                    starts.append(s)
                    ends.append(e)
                    parts.append(t[s:e])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(parts, pa.string())], names=[key, "start_char", "end_char", "unit"])

    return rows.mapInArrow(run, f"`{key}` {kind}, start_char int, end_char int, unit string")
