"""Column functions on text: cleaning, splitting, counting of terms. All but normalisation run on the JVM."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parley.functions import lexicons as lx

# Punctuation brought to ASCII, and characters without width.
_PUNCTUATION = {
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "--", "\u00a0": " ",
    "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "",
}
_FOLD = str.maketrans(_PUNCTUATION)


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html.unescape(unicodedata.normalize("NFC", t).translate(_FOLD)), na_action="ignore")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Composed characters, plain punctuation, no tags, page marks, rules or surplus white space; null becomes empty.

    Only a text with a character beyond ASCII or an entity takes the way through Python.
    """
    needs = text.rlike(r"[^\x00-\x7f]|&")
    c = F.when(needs, _composed(F.when(needs, text))).otherwise(text)
    for pattern, by in (
        (r"<[^>]{1,200}>", " "), (r"\r\n?", "\n"), (r"(?i)\f|\[PAGE\s*\d*\]|\(continued\)", "\n"), (r"[-_=]{5,}", ""),
        (r"(?m)[ \t]+$", ""), (r"(?m)^[ \t]{4,}", " "), (r"\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, by)
    return F.coalesce(strip(c), F.lit(""))


def non_ascii_ratio(text: Column) -> Column:
    """Share of characters beyond ASCII; null for null and empty texts."""
    return F.try_divide(F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")), F.length(text))


def _choice(values: list[str], x: Column, default: str) -> Column:
    return F.when(x.isin(*values), x).otherwise(F.lit(default))


# Spellings of sections and roles.
_SECTIONS = {
    "prepared_remarks": ["prepared_remarks", "prepared", "remarks", "management_discussion"],
    "q_and_a": ["q_and_a", "q&a", "qa", "questions_and_answers", "questions_answers", "question_and_answer"],
    "opening": ["opening", "introduction", "intro", "welcome", "operator_intro"],
    "closing": ["closing", "conclusion", "outro", "wrap_up", "wrap"],
}
_ROLES = {
    "executive": ["executive", "management", "ceo", "cfo", "coo", "chairman", "president", "evp", "svp", "vp"],
    "analyst": ["analyst", "questioner", "question"],
    "operator": ["operator", "moderator", "facilitator"],
}


def _canonical(x: Column, spellings: dict[str, list[str]]) -> Column:
    c = F.lit("unknown")
    for name, forms in reversed(spellings.items()):
        c = F.when(x.isin(*forms), F.lit(name)).otherwise(c)
    return F.coalesce(c, F.lit("unknown"))


def section_label(label: Column) -> Column:
    """prepared_remarks, q_and_a, opening, closing or unknown."""
    return _canonical(F.translate(F.lower(strip(label)), "- ", "__"), _SECTIONS)


def role_label(role: Column) -> Column:
    """executive, analyst, operator or unknown."""
    return _canonical(F.lower(strip(role)), _ROLES)


def speaker_role(speaker: Column, role: Column) -> Column:
    """The canonical role, or else what the speaker's name or title says."""
    name = F.lower(strip(speaker))
    known = role_label(role)
    guess = F.when(name.isin(*lx.OPERATORS), "operator").when(name.rlike("(?i)" + lx.EXECUTIVE_TITLE), "executive").when(name.rlike("(?i)" + lx.ANALYST_TITLE), "analyst").otherwise("unknown")
    return F.when(known != "unknown", known).otherwise(F.coalesce(guess, F.lit("unknown")))


def quarter_label(quarter: Column) -> Column:
    """Q1 to Q4 from Qn or n, null for anything else."""
    n = F.regexp_extract(F.upper(strip(quarter.cast("string"))), "^Q?([1-4])$", 1)
    return F.when(n != "", F.concat(F.lit("Q"), n))


_MARK = "\x1f"


def split_sentences(text: Column) -> Column:
    """Array of sentences: cut after stops followed by white space and a capital or quotation mark.

    There is no cut after a listed abbreviation, a single letter or a digit. Blank and null texts give an empty array.
    """
    words = "|".join(re.escape(a) for a in sorted(lx.ABBREVIATIONS, key=lambda a: (-len(a), a)))
    marked = F.regexp_replace(strip(text), r'([.!?]+)(\s+)(?=[A-Z"])', f"$1{_MARK}$2")
    kept = F.regexp_replace(marked, rf"(?i)(^|[^A-Za-z0-9.\-])((?:{words}|[a-z]|[A-Za-z0-9.\-]*[0-9])\.*[.!?]+){_MARK}", "$1$2")
    return F.coalesce(F.filter(F.transform(F.split(kept, _MARK), strip), lambda x: x != ""), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Words between white space, at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")))


def bounded_count(text: Column, terms: list[str]) -> Column:
    """Occurrences of whole terms, without regard to case: one alternation, the longest first."""
    return F.regexp_count(text, F.lit(rf"(?i)\b(?:{'|'.join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))})\b"))


def phrase_count(text: Column, phrases: list[str]) -> Column:
    """Occurrences of each phrase, summed: phrases within phrases count for both."""
    low = F.lower(text)
    total = F.lit(0)
    for p in sorted(set(phrases)):
        total = total + F.call_function("div", F.length(low) - F.length(F.replace(low, F.lit(p), F.lit(""))), F.lit(len(p)))
    return total.cast("int")


def pattern_count(text: Column, patterns: list[str]) -> Column:
    """Matches of each pattern, summed, without regard to case."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit("(?i)" + p))
    return total.cast("int")


def matched_terms(text: Column, terms: list[str], most: int) -> Column:
    """Up to `most` matches as written, by term: the longest first, then in the order of the alphabet."""
    parts = [F.regexp_extract_all(text, F.lit(rf"(?i)({re.escape(t)})"), F.lit(1)) for t in sorted(set(terms), key=lambda t: (-len(t), t))]
    return F.slice(F.flatten(F.array(*parts)), 1, most)


def first_of(text: Column, patterns: list[tuple[str, str]], default: Column) -> Column:
    """The name of the first pattern that matches."""
    c = default
    for p, name in reversed(patterns):
        c = F.when(text.rlike("(?i)" + p), F.lit(name)).otherwise(c)
    return c


def lm_negative_score(text: Column) -> Column:
    """Share of negative words among words of ASCII letters, times 500, at most 100; 0 without words."""
    tokens = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")
    bad = F.filter(tokens, lambda x: x.isin(*lx.NEGATIVE))
    return F.when(F.size(tokens) > 0, F.least(F.size(bad) / F.size(tokens) * 500, F.lit(100.0))).otherwise(0.0)
