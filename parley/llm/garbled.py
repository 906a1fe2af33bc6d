"""Text decoded with the wrong character encoding: found and restored by a character n-gram model.

1. Pairs of neighbouring characters are counted over all records that show no trace of garbling, into a table of fixed
   size (hashed), which makes a smoothed bigram model.
2. Each text is cut into units (sentences and lines, and where scripts mix, stretches that a wrong encoding can hold).
   Every chain "encode with the encoding that was wrongly used, decode with the true one" that runs without error gives
   a candidate; chains are repeated on what they restore, for texts garbled twice or more.
3. The likeliest candidate is accepted if its log-likelihood exceeds that of the unit as it stands by a margin. The
   margin is validated on all clean records: it lies above what chains reach by chance on most of them.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.tables import cut, spread

#: log2 of the buckets of the bigram table; 2**SIZE doubles are broadcast, 2 MB, whatever the corpus.
SIZE = 18
#: Times that chains are repeated on a restored text.
ROUNDS = 3
#: The margins of the two families of chains, in nats: at least these, and SLACK times what chance gains on most (1 - TAIL) of the clean.
MARGINS, SLACK, TAIL = (2.0, 7.0), 1.25, 0.25
#: Nats that each further step of a chain costs, and that a chain usual in the text is ahead.
STEP, POOLED = 2.0, 12.0
#: Nats that a double-byte encoding costs: it swallows ASCII letters that are not scored.
DOUBLE = 12.0
#: Times that a character must occur in the corpus to be known.
KNOWN = 5

_MASK = (1 << SIZE) - 1
_HIGH = re.compile(r"[^\x00-\x7f]+")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_RUNS = re.compile(r"[^\x00-\x7f]{2,}")
_PRIVATE = re.compile("[\ue000-\uf8ff]")
_CONTROL = re.compile("[\x80-\x9f\ufffd]")
#: Ends of units: after a stop and a blank or closing mark, or at a line break. ASCII blanks only: U+00A0 and U+0085
#: may be parts of garbled characters.
_UNITS = re.compile(r"[^\n]*?(?:[.!?]+[\"')\]]*(?: +|(?=\n)|$)|[。！？।؟]|\n+|$)")


def _inverse(codec: str) -> dict[int, int]:
    """Code point to byte for the upper half; bytes the codec leaves undefined stand for the C1 control of that value."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        table.setdefault(b, b)
    if codec == "cp1252":
        for b in range(0xA0, 0x100):
            table.setdefault(b, b)
    return table


#: Wrong encoding: the encodings that texts read with it may really have had.
CHAINS = {
    "cp1252": ["utf-8", "cp1251", "koi8-r", "cp1250", "cp1253", "cp1254", "cp1256", "cp874", "mac_roman", "cp437", "gb18030", "big5", "euc_jp", "cp932", "cp949"],
    "mac_roman": ["utf-8", "cp1252", "cp1251"],
    "cp437": ["utf-8", "cp1252", "cp1251"],
    "cp850": ["utf-8", "cp1252"],
    "cp1250": ["utf-8", "cp1252"],
    "cp1251": ["utf-8", "cp1252", "koi8-r", "mac_cyrillic", "cp866"],
    "koi8-r": ["utf-8", "cp1251"],
    "cp866": ["utf-8", "cp1251"],
    "iso8859_15": ["utf-8"],
    "iso8859_2": ["utf-8"],
    "cp1254": ["utf-8"],
    "cp932": ["utf-8"],
    "gb18030": ["utf-8", "cp949", "cp932", "euc_jp"],
}
_MULTI = {"gb18030", "big5", "euc_jp", "cp932", "cp949"}
_TABLES = {c: _inverse(c) for c in CHAINS if c not in _MULTI}
_SETS = {c: frozenset(t) for c, t in _TABLES.items()}


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def folded(text: str, before: str = "\n", after: str = "\n") -> np.ndarray:
    """Code points with digits as one and letters in lower case, with the characters before and after."""
    x = codes(before + text + after).copy()
    x[(x >= 48) & (x <= 57)] = 48
    x[(x >= 65) & (x <= 90)] += 32
    return x


def pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the pairs that hold a character beyond ASCII, and of the first and second characters of these pairs."""
    a, b = x[:-1], x[1:]
    high = (a > 127) | (b > 127)
    a, b = a[high], b[high]
    return ((a * 1_000_003) ^ (b * 7_919)) & _MASK, single(a), single(b)


def single(a: np.ndarray) -> np.ndarray:
    return (a * 2_654_435_761 >> 7) & _MASK


#: A chain: the encoding wrongly used, the true one, and whether only what is whole UTF-8 is restored.
Chain = tuple[str, str, bool]


def apply(unit: str, chain: Chain) -> str | None:
    """The unit after a chain, None where it can't run."""
    wrong, true, partly = chain
    if partly:
        return _HIGH.sub(lambda m: _run(m.group(), wrong), unit)
    try:
        raw = unit.encode(wrong) if wrong in _MULTI else unit.translate(_TABLES[wrong]).encode("latin-1")
        return raw.decode(true)
    except UnicodeError:
        return None


def candidates(unit: str) -> Iterator[tuple[Chain, str]]:
    """Each chain that runs on a unit without error and changes it, and what it makes of it."""
    chars = {ord(c) for c in unit if c > "\x7f"}
    for wrong, trues in CHAINS.items():
        multi = wrong in _MULTI
        if multi and max(chars) < 0x2E80:
            continue
        if multi or chars <= _SETS[wrong]:
            for true in trues:
                text = apply(unit, (wrong, true, False))
                if text is not None and text != unit and not _PRIVATE.search(text):
                    yield (wrong, true, False), text
        # UTF-8 read as single bytes shows in runs beyond ASCII: restore those that are whole characters.
        if not multi and not chars.isdisjoint(_SETS[wrong]):
            text = apply(unit, (wrong, "utf-8", True))
            if text != unit:
                yield (wrong, "utf-8", True), text


_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _run(run: str, wrong: str) -> str:
    """A run with the stretches that are UTF-8 decoded, the rest as it is."""
    table = _TABLES[wrong]
    out, held = [], []

    def flush() -> None:
        if held:
            raw = bytes(table[ord(c)] for c in held)
            at = 0
            for m in _UTF8.finditer(raw):
                try:
                    text = m.group().decode("utf-8")
                except UnicodeDecodeError:
                    continue
                out.append("".join(held[at : m.start()]) + text)
                at = m.end()
            out.append("".join(held[at:]))
            held.clear()

    for c in run:
        if ord(c) in table:
            held.append(c)
        else:
            flush()
            out.append(c)
    flush()
    return "".join(out)


#: ASCII that touches no other character says nothing about encodings: a unit is judged by the rest of it.
_PLAIN = re.compile(r"(?<=[\x00-\x7f])[\x00-\x7f]+(?=[\x00-\x7f])")


def essence(unit: str) -> str:
    return _PLAIN.sub("\n", unit)


class Model:
    """Smoothed bigrams over hashed characters, backed off to single characters."""

    def __init__(self, pair_counts: np.ndarray, char_counts: np.ndarray, alpha: float = 0.5) -> None:
        self.pair, self.char, self.alpha = pair_counts, char_counts, alpha
        self.total = max(1.0, float(char_counts.sum()))
        self.known: dict[tuple[str, str, str], list[tuple[float, tuple[Chain, ...]]]] = {}

    def score(self, text: str, before: str = "\n", after: str = "\n") -> float:
        p, f, c = pairs(folded(text, before, after))
        back = (self.char[c] + 0.01) / (self.total + 1.0)
        n = self.pair[p]
        return float(np.log((n + self.alpha * back) / (np.maximum(self.char[f], n) + self.alpha)).sum())

    def judge(self, unit: str, before: str = "\n", after: str = "\n") -> list[tuple[float, tuple[Chain, ...]]]:
        """The chains with a gain in log-likelihood, the likeliest first; one after another where there are several."""
        key = (essence(unit), before, after)
        hit = self.known.get(key)
        if hit is None:
            if len(self.known) > 200_000:
                self.known.clear()
            hit = self.known[key] = self._judge(*key)
        return hit

    def _judge(self, key: str, before: str, after: str) -> list[tuple[float, tuple[Chain, ...]]]:
        base = self.score(key, before, after)
        # Garbled twice: each step leads on from the likeliest few texts of the step before, a gain in it or not.
        ends: list[tuple[float, tuple[Chain, ...], str]] = [(0.0, (), key)]
        seen, found = {key}, []
        for step in range(ROUNDS):
            made = []
            for _, chain, text in ends:
                if not _NOT_ASCII.search(text):
                    continue
                for c, t in candidates(text):
                    if t not in seen:
                        seen.add(t)
                        made.append((self.score(t, before, after) - base - STEP * step - DOUBLE * (c[1] in _MULTI), (*chain, c), t))
            ends = sorted(made, key=lambda x: -x[0])[:2]
            found += [(g, c) for g, c, _ in made if g > 0]
            if not ends:
                break
        return sorted(found, key=lambda x: (-x[0], x[1]))[:8]


def family(chain: tuple[Chain, ...]) -> int:
    """0: whole UTF-8 characters, which chance seldom makes; 1: other encodings."""
    return int(any(c[1] != "utf-8" for c in chain))


def stretches(text: str) -> Iterator[str]:
    """The text in units, without loss."""
    at = 0
    while at < len(text):
        m = _UNITS.match(text, at)
        end = m.end() if m and m.end() > at else at + 1
        unit = text[at:end]
        if _NOT_ASCII.search(unit) and max(unit) > "⹿":
            yield from _by_script(unit)
        else:
            yield unit
        at = end


_SCRIPTS = re.compile("[^฀-๿ऀ-ॿ⺀-\U0010ffff]+|[฀-๿ऀ-ॿ⺀-\U0010ffff]+")


def _by_script(unit: str) -> list[str]:
    return _SCRIPTS.findall(unit)


def judged(text: str, model: Model) -> Iterator[tuple[str, list]]:
    """The units of a text, each judged between its neighbours."""
    at = 0
    for unit in stretches(text):
        end = at + len(unit)
        yield unit, model.judge(unit, text[at - 1] if at else "\n", text[end] if end < len(text) else "\n") if _NOT_ASCII.search(unit) else []
        at = end


def restore(text: str, model: Model, margins: tuple[float, float]) -> str:
    """The text with its garbled units restored.

    A unit is restored by its likeliest chain if the gain exceeds the margin of the chain's family. Chains by which the
    whole text gains three margins count as its way of being garbled: units prefer them, and any gain by them will do.
    """
    return decided(list(judged(text, model)), margins)


def decided(units: list[tuple[str, list]], margins: tuple[float, float]) -> str:
    """The text of units that are judged, restored where the margins say so."""
    pooled: dict[tuple[Chain, ...], float] = {}
    for _, found in units:
        for gain, chain in found:
            pooled[chain] = pooled.get(chain, 0.0) + gain
    out = []
    for unit, found in units:
        if found:
            usual = {c: pooled[c] - g > 3 * margins[family(c)] for g, c in found}
            gain, chain = max(found, key=lambda x: (x[0] + POOLED * usual[x[1]]))
            if gain > margins[family(chain)] or usual[chain]:
                for c in chain:
                    unit = apply(unit, c) or unit
        out.append(unit)
    return "".join(out)


def traced(text: str, char: np.ndarray) -> bool:
    """Whether a text shows traces of garbling: controls, lost bytes, or runs that are UTF-8 of known characters."""
    if _CONTROL.search(text):
        return True
    for m in _RUNS.finditer(text):
        for wrong in _TABLES:
            made = _run(m.group(), wrong)
            if made != m.group() and all(char[single(codes(c))[0]] >= KNOWN for c in set(made) - set(m.group())):
                return True
    return False


def _counts(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """kind (0 characters, 1 pairs), bucket and count, summed within the partition. of: the arrays of a text's buckets."""
    sums = [np.zeros(_MASK + 1, dtype=np.int64) for _ in range(2)]
    for b in batches:
        for text in b.column(0).to_pylist():
            for kind, x in of(text) if text else ():
                np.add.at(sums[kind], x, 1)
    for kind in range(2):
        at = np.flatnonzero(sums[kind])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[kind][at])], names=["kind", "bucket", "n"])


def _table(counted: DataFrame) -> list[np.ndarray]:
    """The summed tables; at most 2 * 2**SIZE rows reach the driver."""
    out = [np.zeros(_MASK + 1) for _ in range(2)]
    for r in counted.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["kind"]][r["bucket"]] = r["n"]
    return out


def train(docs: DataFrame, text: str) -> Model:
    """The model of all records without traces of garbling."""
    texts = docs.select(text).where(F.col(text).isNotNull())
    kind = "kind int, bucket int, n bigint"
    chars, _ = _table(texts.mapInArrow(lambda bs: _counts(bs, lambda t: [(0, single(codes(t)))] if not _CONTROL.search(t) else []), kind))
    sent = docs.sparkSession.sparkContext.broadcast(chars)

    def clean(t: str) -> list[tuple[int, np.ndarray]]:
        if traced(t, sent.value):
            return []
        y = folded(t)
        return [(0, single(y)), (1, pairs(y)[0])]

    char, pair = _table(texts.mapInArrow(lambda bs: _counts(bs, clean), kind))
    return Model(pair, char)


def _bits(x: float) -> int:
    """A number from 0 on as a whole number in the same order."""
    return int(np.float64(x).view(np.int64))


def at_rank(rows: DataFrame, column: str, rank: int) -> float:
    """The value at a rank (from 0 on) of all `rows` in the order of `column`, which holds `_bits`; exact.

    It is narrowed down by counts of 16 bits at a time, of which at most 65,536 reach the driver.
    """
    known = 0
    for shift in (48, 32, 16, 0):
        part = rows if shift == 48 else rows.where(F.shiftright(column, shift + 16) == known)
        for r in sorted(part.groupBy(F.shiftright(column, shift).alias("p")).count().toLocalIterator(), key=lambda r: r["p"]):
            if rank < r["count"]:
                known = r["p"]
                break
            rank -= r["count"]
    return float(np.int64(known).view(np.float64))


def margins_of(judgements: DataFrame) -> tuple[float, float]:
    """Validated margins: above what chance brings on most (1 - TAIL) of all records without traces.

    `judgements` has clean, the number of such records that a row stands for, and the `_bits` of their gains a and b.
    """
    out = []
    some = judgements.where("clean > 0")
    n, *above = some.agg(F.coalesce(F.sum("clean"), F.lit(0)), *[F.coalesce(F.sum(F.when(F.col(c) > 0, F.col("clean"))), F.lit(0)) for c in "ab"]).first()
    for c, more, least in zip("ab", above, MARGINS):
        place = (n - 1) * (1 - TAIL)
        # Ranks among the gains above nought; all others come before.
        low, high = (int(x) - (n - more) for x in (np.floor(place), np.ceil(place)))
        gains = some.where(F.col(c) > 0).select(c)
        x, y = (at_rank(gains, c, k) if k >= 0 and n else 0.0 for k in (low, high))
        out.append(max(least, SLACK * (x + (y - x) * (place - np.floor(place)))))
    return out[0], out[1]


def restore_encoding(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """`key`, restored, orig_chars of each record that was garbled, wholly or in part, once or more.

    `restored` is the whole text restored and orig_chars its length in characters. Where bytes are lost (U+FFFD) the
    text is restored as far as may be, and orig_chars is 0. Null, empty and clean texts have no row, repeated rows come
    out repeated. The model is trained and its margins are validated on all rows of `docs`. Each text is judged once;
    those with a chain that gains wait in a checkpoint till the margins are known.
    """
    docs = spread(docs.select(key, text))
    model = train(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast((model.pair, model.char))
    kind = docs.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in batches:
            # The first row stands for the clean records that no chain gains on.
            rows, held, texts, clean, gains = [None], [None], [None], [0], [(0, 0)]
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                units = list(judged(t, m)) if _NOT_ASCII.search(t) else []
                lost, whole = "\ufffd" in t, not _CONTROL.search(t) and not (units and traced(t, m.char))
                if not lost and not any(found for _, found in units):
                    clean[0] += whole
                    continue
                best = [0.0, 0.0]
                for _, found in units:
                    for g, c in found:
                        best[family(c)] = max(best[family(c)], g)
                rows.append(i)
                held.append(zlib.compress(pickle.dumps([found for _, found in units]), 1))
                texts.append(t)
                clean.append(int(whole))
                gains.append((_bits(best[0]), _bits(best[1])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array(held, pa.binary()), pa.array(clean, pa.int64()), pa.array([x for x, _ in gains], pa.int64()), pa.array([x for _, x in gains], pa.int64())],
                names=[key, "text", "held", "clean", "a", "b"],
            )

    judgements = cut(docs.select(key, text).mapInArrow(judge, f"`{key}` {kind}, text string, held binary, clean bigint, a bigint, b bigint"))
    margins = margins_of(judgements)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, made, chars = [], [], []
            for i, (t, found) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                r, lost = decided(list(zip(stretches(t), pickle.loads(zlib.decompress(found)))), margins), "\ufffd" in t
                if lost or r != t:
                    rows.append(i)
                    made.append(r)
                    chars.append(0 if lost else len(r))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(made, pa.string()), pa.array(chars, pa.int32())], names=[key, "restored", "orig_chars"])

    return judgements.where("held IS NOT NULL").select(key, "text", "held").mapInArrow(run, f"`{key}` {kind}, restored string, orig_chars int")
