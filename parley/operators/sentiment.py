"""Probabilities of tone of sentences, from a model of the caller's or from word lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import lexicons as lx

#: A model takes texts and gives (positive, negative, neutral) of each.
Model = Callable[[list[str]], list[tuple[float, float, float]]]


def model_sentiment(df: DataFrame, *, key: str, text: str, load: Callable[[], Model], batch: int = 64) -> DataFrame:
    """`key`, positive, negative, neutral, label by a model that `load` makes once a task; texts go in batches.

    Null and empty texts are neutral. Arrow batches keep the memory of a task bounded, whatever the table's size.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            texts = [t or "" for t in f[text]]
            out: list[tuple[float, float, float]] = []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                out += [p if t else (0.0, 0.0, 1.0) for t, p in zip(part, model(part), strict=True)]
            p = pd.DataFrame(out, columns=["positive", "negative", "neutral"])
            yield pd.concat([f[[key]].reset_index(drop=True), p, p.idxmax(axis=1).rename("label") if len(p) else pd.Series(dtype=str, name="label")], axis=1)

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, positive double, negative double, neutral double, label string")


def lexicon_sentiment(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """The same columns from shares of words of both kinds: a stand-in, not the figures of any trained model."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    pos, neg = (F.size(F.filter(words, lambda w: w.isin(*x))) for x in (lx.TONE_UP, lx.NEGATIVE))
    p, q = F.least(pos / n * 5, F.lit(1.0)), F.least(neg / n * 5, F.lit(1.0))
    total = F.greatest(p + q, F.lit(1.0))
    shares = df.select(key, (p / total).alias("positive"), (q / total).alias("negative"))
    rest = shares.withColumn("neutral", 1 - F.col("positive") - F.col("negative"))
    best = F.greatest("positive", "negative", "neutral")
    return rest.withColumn("label", F.when(F.col("neutral") == best, "neutral").when(F.col("negative") == best, "negative").otherwise("positive"))
