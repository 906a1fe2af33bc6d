"""Defective prompt and response pairs: empty, copied, refused, in another language, broken off.

Empty and copied responses are what they are by definition. The rest is judged by models of the whole tables.

Language: a naive Bayes classifier on character n-grams, trained on labelled texts and then on those prompts and
responses that it is sure of; a response is in another language if the posterior odds between its own best language and
that of its prompt exceed a margin, for both texts.
Truncation: it is counted how often each n-gram of tokens is followed by an end. The likelihood of an end after the
last words of a response, marks behind them left out, is held together with how often the response's last mark closes
what breaks off; that is learned from the responses whose last words alone are decisive.
Refusal: the same n-grams are counted in responses with a phrase that declines (SEEDS) and in all. A sentence declines
if its odds are high; a response is a refusal if a sentence declines and none tells anything, that is, none is made of
n-grams that refusals do without.

Counts are exact. Of n-grams the model keeps those with at least a share RARE of all, or RARE_DECLINED of those in
responses that decline: at most 1 / RARE + 1 / RARE_DECLINED.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.tables import cut, spread

#: log2 of the buckets of the language model; shares of buckets, not counts, are compared.
LANG_SIZE = 16
#: Languages at most; more labels raise an error.
LANGUAGES = 512
#: Nats by which the posterior of another language must be ahead, for prompt and response, and to train on a text.
#: Each character is in three n-grams, so sums are divided by three.
AHEAD, SURE = 4.0, 15.0
#: Tokens of the longest n-gram before an end and of the longest that refusals are told by.
ORDER, WORDS = 5, 3
#: Share of all n-grams, or of those in responses that decline, that one must have to be known, and times it must occur
#: to tell of ends.
RARE, RARE_DECLINED, SEEN = 1e-6, 1e-5, 3
#: Occurrences from which the last words alone are decisive; the chance of an end below and above which they are.
DECISIVE, BREAKS, ENDS = 10, 0.02, 0.2
#: Nats of a broken off response, of a sentence that declines, and of one that tells something.
BROKEN, DECLINES, TELLS = 1.0, 8.0, -3.0
#: Occurrences that what is expected of an n-gram weighs.
PRIOR = 2.0
#: Words of a text that may be complete without a final stop.
SHORT = 5

_STOP = set(".!?。！？।؟")
_CLOSE = "\"'”’»」』)）］] \t\r\n ​“"
_TOKEN = re.compile(r"\d[\d.,]*\d|\d|[฀-๿぀-ヿ㐀-鿿]|[^\W\d_฀-๿぀-ヿ㐀-鿿]+|[^\w\s]|(?<=[฀-๿])\s+")
_NOTHING = re.compile(r"<[^>]*>|\[[^\]]*\]|\([^)]*\)")
#: Placeholders that say nothing.
_PLACEHOLDERS = {"", "null", "none", "nan", "na", "n/a", "nil", "tbd", "blank", "empty", "a", "answer", "no response", "no answer", "undefined"}
#: Phrases that decline, in the languages of the calls: what the model of refusals starts from.
SEEDS = re.compile(
    r"not something we (?:disclose|share|discuss)|no comment|(?:do|does|will|would|can) ?not (?:be )?comment(?:ing)?\b|declin\w+ to (?:answer|comment)|rather not get into|inappropriate for me to|"
    r"policy is not to|not able to (?:share|answer|comment)|unable to (?:share|answer|comment|discuss)|advice of counsel|never broken that out|cannot (?:discuss|answer|comment|help)|can't (?:discuss|answer|comment|help)|"
    r"no puedo responder|no hacemos comentarios|no podemos (?:comentar|responder)|ne peux .{0,20}pas répondre|ne commentons pas|ne pouvons .{0,20}pas (?:répondre|commenter)|pas de commentaire|"
    r"können wir .{0,12}nicht beantworten|äußern wir uns .{0,16}nicht|kein kommentar|kommentieren wir nicht|não (?:posso|podemos) (?:responder|comentar)|não comentamos|sem comentários|"
    r"お答えできません|コメントは差し控え|コメントできません|回答を控え|无法回答|不予置评|不便(?:评论|透露|回答)|无可奉告|답변(?:드릴|할) 수 없|언급하지 않|말씀드릴 수 없|"
    r"не комментиру|не могу ответить|не можем ответить|без комментариев|لا (?:يمكنني|يمكننا|أستطيع|نستطيع) (?:الإجابة|التعليق)|لا نعلق|لا تعليق|"
    r"उत्तर नहीं दे|टिप्पणी नहीं|जवाब नहीं दे|ไม่สามารถตอบ|ไม่ขอแสดงความ|ไม่สามารถให้ความ",
    re.IGNORECASE,
)
_SENTENCE = re.compile(r"[^.!?。！？।؟]*[.!?。！？।؟]*")


def ngrams(text: str) -> np.ndarray:
    """Buckets of the character n-grams of length 1 to 3 that hold a letter; digits and marks are blanks."""
    x = np.frombuffer(("\n" + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    out = []
    for n in (1, 2, 3):
        if len(x) < n:
            break
        h = np.full(len(x) - n + 1, n, dtype=np.int64)
        for i in range(n):
            h = h * 1_000_003 + x[i : len(x) - n + 1 + i]
        out.append((h ^ (h >> 17)) & ((1 << LANG_SIZE) - 1))
    return np.concatenate(out)


def tokens(text: str) -> list[str]:
    return ["0" if t[0].isdigit() else " " if t.isspace() else t.lower() for t in _TOKEN.findall(text)]


def ending(text: str) -> str:
    """The text without closing marks and blanks at its end."""
    return text.rstrip(_CLOSE)


def _hash(gram: tuple[str, ...]) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(gram).encode("utf-8", "surrogatepass")) - (1 << 63)


def contexts(toks: list[str], at: int) -> Iterator[tuple[str, ...]]:
    """The n-grams that end before position `at`, the longest first; a start mark anchors those that reach it."""
    seq = ["^", *toks[:at]]
    for n in range(min(ORDER, len(seq)), 0, -1):
        if n == 1 and seq[-1] == "^":
            break
        yield tuple(seq[-n:])


def _sums(kind: int, value: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(value)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(value[at].astype(np.int64))], names=["kind", "i", "v"])


def _added(df: DataFrame, kinds: int, size: int) -> np.ndarray:
    """The summed tables; at most kinds * size rows reach the driver, in Arrow."""
    out = np.zeros((kinds, size))
    t = df.groupBy("kind", "i").agg(F.sum("v").alias("v")).toArrow()
    out[t.column("kind").to_numpy(), t.column("i").to_numpy()] = t.column("v").to_numpy()
    return out


def _log_shares(counts: np.ndarray) -> np.ndarray:
    share = (counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * (1 << LANG_SIZE))
    return np.log(share).astype(np.float32)


def _language_counts(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """Counts of n-gram buckets by language; `of` gives the language of a row's text, or None."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] and (k := of(row)) is not None:
                sums.setdefault(k, np.zeros(1 << LANG_SIZE, dtype=np.int64))
                np.add.at(sums[k], ngrams(row[0]), 1)
    for k, v in sums.items():
        yield _sums(k, v)


def train_languages(texts: DataFrame, *, text: str, label: str, own: DataFrame) -> np.ndarray:
    """Log-shares of n-gram buckets by language, from all labelled texts and the texts of `own` (column t) it is sure of."""
    name = F.lower(F.regexp_extract(F.trim(F.col(label)), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    rows = spread(texts.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), name.alias("l")).where("l <> ''"))
    names = sorted(r["l"] for r in rows.select("l").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} language labels")
    index = {n: i for i, n in enumerate(names)}
    schema = "kind int, i int, v bigint"
    counts = _added(rows.mapInArrow(lambda bs: _language_counts(bs, lambda r: index[r[1]]), schema), max(1, len(names)), 1 << LANG_SIZE)
    sent = texts.sparkSession.sparkContext.broadcast(_log_shares(counts))

    def sure(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Languages(sent.value)

        def language(row) -> int | None:
            x = model.scores(row[0])
            best = int(x.argmax())
            return best if len(x) > 1 and x[best] - np.partition(x, -2)[-2] > SURE else None

        return _language_counts(bs, language)

    more = _added(own.mapInArrow(sure, schema), max(1, len(names)), 1 << LANG_SIZE)
    return _log_shares(counts + more)


def is_end(toks: list[str], i: int, letters: int) -> bool:
    """Whether a sentence or text ends before token i: at a stop, or where a short text ends.

    The end of a text without a stop counts for short texts only: they may be complete without one.
    """
    if i < len(toks):
        return toks[i] in _STOP and toks[i + 1 : i + 2] != ["."] or toks[i] == " "
    return letters <= SHORT


def count_ngrams(responses: DataFrame, text: str) -> DataFrame:
    """h, n, e, r: hash of each n-gram, its occurrences, those before an end, and those in responses with a seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, ...], list[int]] = {}

        def out() -> pa.RecordBatch:
            v = np.array(list(sums.values()), dtype=np.int64).reshape(-1, 3)
            return pa.RecordBatch.from_arrays([pa.array([_hash(c) for c in sums], pa.int64()), *(pa.array(v[:, k]) for k in range(3))], names=["h", "n", "e", "r"])

        for b in batches:
            for t in b.column(0).to_pylist():
                toks = tokens(ending(t))
                seed = SEEDS.search(t) is not None
                words = sum(x[0].isalnum() for x in toks)
                for i in range(1, len(toks) + 1):
                    end = is_end(toks, i, words)
                    for c in contexts(toks, i):
                        x = sums.get(c)
                        if x is None:
                            x = sums[c] = [0, 0, 0]
                        x[0] += 1
                        x[1] += end
                        x[2] += seed
            if len(sums) > 400_000:
                yield out()
                sums.clear()
        yield out()

    return responses.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "h bigint, n bigint, e bigint, r bigint").groupBy("h").agg(*[F.sum(c).alias(c) for c in "ner"])


class Grams:
    """Known n-grams by hash, in order: occurrences, ends and occurrences in responses that decline.

    `mark_odds` has the log-odds that a response with a last mark is broken off.
    """

    def __init__(self, table: np.ndarray, total: int, declined: int, mark_odds: dict[str, float]) -> None:
        self.h, self.counts = table[:, 0], table[:, 1:]
        self.total, self.declined, self.mark_odds = total, declined, mark_odds

    def get(self, gram: tuple[str, ...]) -> np.ndarray | None:
        h = _hash(gram)
        i = int(np.searchsorted(self.h, h))
        return self.counts[i] if i < len(self.h) and self.h[i] == h else None

    def ending(self, toks: list[str]) -> tuple[int, float]:
        """Occurrences of the longest known n-gram at the end, and the chance that it ends something; 0 for none known."""
        for c in contexts(toks, len(toks)):
            if (x := self.get(c)) is not None and x[0] >= SEEN:
                return int(x[0]), float(x[1] / x[0])
        return 0, 0.0

    def declines(self, toks: list[str]) -> float:
        """Log-odds of a sentence's words in responses that decline against all others; unknown words say nothing."""
        p = (self.declined + 1.0) / (self.total + 2.0)
        ratio, score = np.log((1 - p) / p), 0.0
        for i in range(1, len(toks) + 1):
            for n in range(min(WORDS, i), 0, -1):
                if (x := self.get(tuple(toks[i - n : i]))) is not None:
                    score += np.log((x[2] + PRIOR * p) / (x[0] - x[2] + PRIOR * (1 - p))) + ratio
                    break
        return float(score)


def last_mark(answer: str) -> str:
    """What a response ends with: its marks behind the last word, one kind of runs, or without any its length."""
    tail = re.search(r"[^\w]*$|\[[^\]]*\]\s*$", answer).group().strip().translate({ord(c): None for c in _CLOSE if not c.isspace()})
    bracket = re.search(r"\[[^\]]*\]\s*$", answer)
    mark = "[]" if bracket else tail[-1:] if not tail.endswith(("..", "…")) else "..."
    return mark or ("short" if sum(t[0].isalnum() for t in tokens(answer)) <= SHORT else "long")


def last_words(answer: str) -> list[str]:
    """The tokens of a response up to its last word: a note in brackets and marks behind it are left out."""
    toks = tokens(re.sub(r"\s*\[[^\]]*\]\s*$", "", answer))
    while toks and not toks[-1][0].isalnum() and not toks[-1].isspace() and not _SPOKEN_MARK.match(toks[-1]):
        toks.pop()
    return toks


#: Marks that end a sentence as words do.
_SPOKEN_MARK = re.compile(r"[%)）]")


def mark_odds(responses: DataFrame, text: str, sent) -> dict[str, float]:
    """For each last mark the log-odds that what it closes is broken off, from responses with decisive last words.

    At most as many rows as there are marks reach the driver, the most frequent 1,000 in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(*sent.value)
        sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for b in batches:
            for t in b.column(0).to_pylist():
                toks = last_words(t)
                n, share = grams.ending(toks)
                if n >= DECISIVE and (share < BREAKS or share > ENDS):
                    sums[last_mark(t)][share < BREAKS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.int64())], names=["m", "whole", "broken"])

    rows = responses.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "m string, whole bigint, broken bigint").groupBy("m").agg(F.sum("whole").alias("whole"), F.sum("broken").alias("broken"))
    return {r["m"]: float(np.log((r["broken"] + 0.5) / (r["whole"] + 0.5))) for r in rows.orderBy(F.desc(F.col("whole") + F.col("broken")), "m").limit(1000).collect()}


def letters(text: str) -> str:
    return "".join(c for c in text.casefold() if c.isalnum())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    inner = answer.replace("​", "").replace("﻿", "").strip()
    bare = _NOTHING.sub(" ", inner).strip()
    if letters(bare) == "":
        return not any(c.isdigit() for c in inner)
    return bare.strip(" .:-–—_*\"'").lower() in _PLACEHOLDERS


def is_copied(question: str, answer: str) -> bool:
    """Whether the answer is the question once or more, or sentences of it, if need be after a lead-in with a colon."""
    q = letters(question)
    if not q:
        return False
    a = letters(answer)
    if not a:
        return False
    body = answer.split(":", 1)[1] if ":" in answer and q not in letters(answer.split(":", 1)[0]) else answer
    for text in (a, letters(body)):
        rest = text.replace(q, "")
        if text and (not rest and len(text) >= len(q)):
            return True
        if len(text) >= 12 and len(text) * 2 >= len(q) and text in q:
            return True
        if len(text) >= 12 and not rest:
            return True
    parts = [letters(s) for s in _SENTENCE.findall(question) if len(letters(s)) >= 12]
    for p in parts:
        a = a.replace(p, "")
    return bool(parts) and not a


def is_refusal(answer: str, grams: Grams) -> bool:
    """Whether a sentence declines and none tells anything."""
    scores = [grams.declines(["^", *toks]) for x in _SENTENCE.findall(answer) if (toks := [t for t in tokens(x) if t[0].isalnum()])]
    return bool(scores) and max(scores) >= DECLINES and min(scores) > TELLS


class Languages:
    def __init__(self, log: np.ndarray) -> None:
        self.log = log

    def scores(self, text: str) -> np.ndarray:
        return self.log[:, ngrams(text)].sum(axis=1) / 3.0

    def differ(self, question: str, answer: str) -> bool:
        q, a = self.scores(question), self.scores(answer)
        i, k = int(q.argmax()), int(a.argmax())
        return i != k and q[i] - q[k] > AHEAD and a[k] - a[i] > AHEAD


def broken_off(answer: str, grams: Grams) -> bool:
    """Whether the last words and the last mark together tell that a response breaks off.

    Words that are not known at all say nothing, but that a whole response mostly ends with known ones.
    """
    toks = last_words(answer)
    if not toks:
        return False
    n, share = grams.ending(toks)
    words = np.log((1 - share + 0.5 / (n + 1)) / (share + 0.5 / (n + 1))) if n else 1.0
    return bool(words + grams.mark_odds.get(last_mark(answer), 0.0) > BROKEN)


def pair_defects(pairs: DataFrame, labelled: DataFrame, *, key: str, question: str, answer: str, labelled_text: str, label: str) -> DataFrame:
    """`key` and defect (empty, copied, refusal, other_language, truncated; the first that applies) of each bad pair.

    `labelled` are texts with the language they are in, for the language model; a null or empty question can't be
    copied or be in another language. Pairs with null key are left out, repeated rows come out once. Empty tables give
    no rows.
    """
    one = pairs.where(F.col(key).isNotNull()).select(key, question, answer).repartition(key).distinct()
    own = spread(pairs.select(F.explode(F.array(question, answer)).alias("t")).where("t is not null"))
    language = train_languages(labelled, text=labelled_text, label=label, own=own)
    counted = cut(count_ngrams(one, answer))
    total, declined = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()
    kept = counted.where((F.col("n") >= total * RARE) | (F.col("r") >= max(1, declined * RARE_DECLINED))).orderBy("h").toArrow()
    table = np.stack([kept.column(c).to_numpy() for c in "hner"], axis=1) if kept.num_rows else np.zeros((0, 4), dtype=np.int64)
    sc = pairs.sparkSession.sparkContext
    marks = mark_odds(one, answer, sc.broadcast((table, total, declined, {})))
    sent = sc.broadcast((language, table, total, declined, marks))
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, grams = Languages(sent.value[0]), Grams(*sent.value[1:])
        for b in batches:
            rows, out = [], []
            for i, (q, a) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                q = q or ""
                if is_empty(a):
                    d = "empty"
                elif is_copied(q, a):
                    d = "copied"
                elif is_refusal(a, grams):
                    d = "refusal"
                elif letters(q) and lang.differ(q, a):
                    d = "other_language"
                elif broken_off(a, grams):
                    d = "truncated"
                else:
                    continue
                rows.append(i)
                out.append(d)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.string())], names=[key, "defect"])

    return one.mapInArrow(run, f"`{key}` {kind}, defect string").distinct()
