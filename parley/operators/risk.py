"""Hedging, tone, evasiveness and risk of sentences, pairs and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import lexicons as lx
from parley.functions.text import bounded_count, matched_terms, pattern_count, phrase_count, word_count


def hedging(df: DataFrame, text: str) -> DataFrame:
    """`df` with the counts, densities and scores of hedging in `text`; null and empty texts have zeros.

    The added columns replace columns of the same names.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    counts = df.withColumns(
        {
            "word_count": word_count(t),
            "modal_count": bounded_count(t, lx.MODALS),
            "qualifier_count": bounded_count(t, lx.QUALIFIERS),
            "uncertainty_count": phrase_count(t, lx.UNCERTAINTY),
            "deflection_count": phrase_count(t, lx.DEFLECTION),
        }
    )
    n = F.col("word_count")
    hedges = F.col("modal_count") + F.col("qualifier_count") + F.col("uncertainty_count")
    cap = lambda x: F.least(x, F.lit(1.0))
    dense = counts.withColumns({"hedge_count": hedges, "hedge_density": hedges / n, "modal_density": F.col("modal_count") / n, "qualifier_density": F.col("qualifier_count") / n})
    return dense.withColumns(
        {
            "uncertainty_score": (100 * (0.35 * cap(F.col("modal_density") * 10) + 0.35 * cap(F.col("qualifier_density") * 10) + 0.30 * cap(F.col("uncertainty_count") / 3))),
            "hedging_score": (100 * (0.50 * cap(F.col("hedge_density") * 8) + 0.25 * cap(F.col("uncertainty_count") / 2) + 0.25 * cap(F.col("deflection_count") / 2))),
        }
    )


def hedging_terms(text: Column) -> Column:
    """The matched modals and qualifiers (10 each), phrases of uncertainty and deflection (5 each)."""
    return F.struct(
        matched_terms(text, lx.MODALS, 10).alias("modals"), matched_terms(text, lx.QUALIFIERS, 10).alias("qualifiers"),
        matched_terms(text, lx.UNCERTAINTY, 5).alias("uncertainty"), matched_terms(text, lx.DEFLECTION, 5).alias("deflection"),
    )


def local_shift(df: DataFrame, *, group: str, order: list[str], value: str, window: int = 5) -> DataFrame:
    """`df` with rolling_mean, rolling_std (of the `window` rows before), previous and shift_score (0 to 100).

    The score is the distance from the rolling mean in standard deviations, a third of it, at most 1, times 100; the
    first row of a group has 0. Orders must be total for a defined result; a group is one call, never a source.
    """
    w = Window.partitionBy(group).orderBy(*order)
    before = w.rowsBetween(-window, -1)
    mean, std = F.coalesce(F.avg(value).over(before), F.lit(0.0)), F.coalesce(F.stddev_pop(value).over(before), F.lit(0.0))
    with_stats = df.withColumns({"rolling_mean": mean, "rolling_std": std, "previous": F.lag(value, 1, 0.0).over(w), "_first": F.row_number().over(w) == 1})
    score = F.least(F.abs(F.col(value) - F.col("rolling_mean")) / (F.col("rolling_std") + 1e-6) / 3, F.lit(1.0)) * 100
    return with_stats.withColumn("shift_score", F.when(F.col("_first"), 0.0).otherwise(score)).drop("_first")


def section_shift(df: DataFrame, *, group: str, section: str, value: str) -> DataFrame:
    """Per group: mean of the prepared remarks and of questions and answers, their distance times 100, and direction."""
    p, q = (F.coalesce(F.avg(F.when(F.col(section) == s, F.col(value))), F.lit(0.0)) for s in ("prepared_remarks", "q_and_a"))
    out = df.groupBy(group).agg(p.alias("prepared_mean"), q.alias("qa_mean"))
    gap = F.col("qa_mean") - F.col("prepared_mean")
    return out.withColumns({"section_shift": F.abs(gap) * 100, "direction": F.when(gap > 0.02, "more_negative_qa").when(gap < -0.02, "less_negative_qa").otherwise("stable")})


def tokens_of(text: Column, least: int) -> Column:
    """Runs of at least so many letters, digits and underscores of any script, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"([\p{{L}}\p{{N}}_]{{{least},}})"), F.lit(1))


def overlap(question: Column, answer: Column) -> tuple[Column, Column]:
    """Topic overlap (share of the question's content words in the answer, 0.5 without any) and keyword overlap."""
    plain = lambda x: F.filter(F.array_distinct(tokens_of(x, 4)), lambda w: w.rlike("^[a-z]+$"))
    q4, a4 = F.array_except(plain(question), F.array(*map(F.lit, lx.TOPIC_STOP))), plain(answer)
    q3, a3 = (F.array_distinct(tokens_of(x, 3)) for x in (question, answer))
    topic = F.when(F.size(q4) == 0, 0.5).otherwise(F.try_divide(F.size(F.array_intersect(q4, a4)), F.size(q4)))
    jaccard = F.when((F.size(q3) == 0) | (F.size(a3) == 0), 0.0).otherwise(F.try_divide(F.size(F.array_intersect(q3, a3)), F.size(F.array_union(q3, a3))))
    return topic.cast("double"), jaccard.cast("double")


def tfidf_cosine(pairs: DataFrame, *, key: str, left: str, right: str, bigrams: bool = True) -> DataFrame:
    """`key`, similarity: cosine of sublinear term weights of two texts, the documents being just the two.

    A term in both weighs 1, in one only 1 + ln(3/2). Pairs without a common or any term have 0. Keys must be unique.
    """
    # Pairs are put together once; terms are counted where their pair is, so only texts are shuffled.
    pairs = pairs.repartition(key)
    sides = pairs.select(F.col(key).alias("k"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(left).alias("t")), F.struct(F.lit(1).alias("side"), F.col(right).alias("t")))).alias("s"))
    words = F.filter(tokens_of(F.col("s.t"), 2), lambda x: ~x.isin(*lx.STOP_WORDS))
    rows = sides.select("k", F.col("s.side").alias("side"), words.alias("w"))
    two = F.zip_with(F.slice(F.col("w"), 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice(F.col("w"), 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    terms = rows.select("k", "side", F.explode(F.concat("w", two) if bigrams else F.col("w")).alias("term"))
    one = F.col("side") == 0
    tf = terms.groupBy("k", "term").agg(F.count(F.when(one, 1)).alias("l"), F.count(F.when(~one, 1)).alias("r"))
    both = (F.col("l") > 0) & (F.col("r") > 0)
    idf = F.when(both, 1.0).otherwise(1.0 + F.log(F.lit(1.5)))
    wl, wr = (F.when(F.col(c) > 0, (1 + F.log(F.greatest(F.col(c), F.lit(1)))) * idf).otherwise(0.0) for c in ("l", "r"))
    sums = tf.groupBy("k").agg(F.sum(wl * wr).alias("dot"), F.sum(wl * wl).alias("ll"), F.sum(wr * wr).alias("rr"))
    sim = F.coalesce(F.try_divide(F.col("dot"), F.sqrt("ll") * F.sqrt("rr")), F.lit(0.0))
    return pairs.select(F.col(key).alias("k")).join(sums, "k", "left").select(F.col("k").alias(key), F.coalesce(sim, F.lit(0.0)).alias("similarity"))


def evasiveness(pairs: DataFrame, *, key: str, question: str, answer: str, density: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """`key`, the columns `keep`, and the features and score of evasiveness of each pair; keys must be unique.

    A null or empty question or answer gives score 0, topic overlap 0.5 and length ratio 1. `density` names a column
    with the answer's hedge density, as where that of its first sentence counts; without it the whole answer is taken.
    """
    pairs = pairs.repartition(key)
    q, a = F.coalesce(F.col(question), F.lit("")), F.coalesce(F.col(answer), F.lit(""))
    topic, keyword = overlap(q, a)
    words = word_count(a)
    own = (bounded_count(a, lx.MODALS) + bounded_count(a, lx.QUALIFIERS) + phrase_count(a, lx.UNCERTAINTY)) / words
    base = pairs.select(
        key, *keep, ((q == "") | (a == "")).alias("blank"), topic.alias("topic_overlap"), keyword.alias("keyword_overlap"),
        pattern_count(a, lx.DIRECT).alias("direct_count"), pattern_count(a, lx.DEFLECTING).alias("deflecting_count"), pattern_count(a, lx.GENERIC).alias("generic_count"),
        words.alias("answer_words"), word_count(q).alias("question_words"),
        q.rlike("(?i)" + lx.ASKS_NUMBER).alias("asks_number"), a.rlike("(?i)" + lx.HAS_NUMBER).alias("has_number"),
        (own if density is None else F.coalesce(F.col(density).cast("double"), F.lit(0.0))).alias("hedge_density"),
    )
    joined = base.join(tfidf_cosine(pairs, key=key, left=question, right=answer), key)
    cap = lambda x: F.least(x, F.lit(1.0))
    generic = cap(F.col("generic_count") / F.col("answer_words") * 10) * 100
    number = F.when(F.col("asks_number") & ~F.col("has_number"), 100.0).otherwise(0.0)
    raw = (
        20 * (1 - F.col("similarity")) + 20 * (1 - F.col("topic_overlap")) + 10 * (1 - F.col("keyword_overlap")) + 10 * (1 - cap(F.col("direct_count") / 3))
        + 15 * cap(F.col("deflecting_count") / 3) + 0.10 * F.least(F.col("hedge_density") * 200, F.lit(100.0)) + 0.05 * generic + 0.10 * number
    )
    return joined.select(
        key, *keep, F.when(F.col("blank"), 0.0).otherwise(F.col("similarity")).alias("similarity"), F.when(F.col("blank"), 0.5).otherwise(F.col("topic_overlap")).alias("topic_overlap"),
        F.when(F.col("blank"), 0.0).otherwise(F.col("keyword_overlap")).alias("keyword_overlap"), "direct_count", "deflecting_count", "generic_count",
        F.when(F.col("blank"), 1.0).otherwise(F.col("answer_words") / F.col("question_words")).alias("length_ratio"), "asks_number", "has_number",
        F.when(F.col("blank"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(raw, F.lit(100.0)))).alias("evasive_score"),
    )


def first_density(sentences: DataFrame) -> DataFrame:
    """segment_id, first_density: the hedge density of each segment's first sentence."""
    order = F.struct("sentence_number", "sentence_id")
    return sentences.groupBy("segment_id").agg(F.min_by("hedge_density", order).alias("first_density"))


def combined_risk(hedge: Column, evasive: Column, shift: Column) -> Column:
    """0.35, 0.40 and 0.25 of the three; where evasiveness is 0 the others share its weight."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(evasive == 0, (WEIGHTS[0] * hedge + WEIGHTS[2] * shift) / (WEIGHTS[0] + WEIGHTS[2])).otherwise(WEIGHTS[0] * hedge + WEIGHTS[1] * evasive + WEIGHTS[2] * shift)))


def top_share_mean(df: DataFrame, *, group: str, value: str, share: float = 0.10) -> DataFrame:
    """Per group: n, mean, top_mean (of the greatest ceil(n * share) values, at least one) and their blend (0.6, 0.4).

    Ranks come from counts of equal values, so a group is summed by value before it is ordered.
    """
    by_value = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_value.withColumns({"before": F.coalesce(F.sum("c").over(w), F.lit(0)), "n": F.sum("c").over(Window.partitionBy(group))})
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    taken = F.greatest(F.lit(0), F.least(F.col("c"), k - F.col("before")))
    out = ranked.groupBy(group).agg(F.max("n").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), (F.sum(F.col(value) * taken) / F.sum(taken)).alias("top_mean"))
    return out.withColumn("blend", 0.6 * F.col("mean") + 0.4 * F.col("top_mean"))


def pair_risk(pairs: DataFrame, sentences: DataFrame) -> DataFrame:
    """qa_id, transcript_id, pair_risk: half the pair's evasiveness, and means over the sentences of its answer.

    `pairs` has qa_id, transcript_id, answer_segment_id and evasive_score, `sentences` segment_id, risk, hedging_score
    and shift_score. A pair whose answer has no sentences has only its own half.
    """
    means = sentences.groupBy(F.col("segment_id").alias("answer_segment_id")).agg(*[F.avg(c).alias(c) for c in ("risk", "hedging_score", "shift_score")])
    of = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = 0.50 * of("evasive_score") + 0.25 * of("risk") + 0.15 * of("hedging_score") + 0.10 * of("shift_score")
    return pairs.join(means, "answer_segment_id", "left").select("qa_id", "transcript_id", F.round(F.least(F.lit(100.0), score), 2).alias("pair_risk"))


def call_risk(sentences: DataFrame, pairs: DataFrame, shifts: DataFrame) -> DataFrame:
    """Per call: n, overall, prepared, qa and the worst segment.

    overall is the blend of mean and top tenth of the sentences' risk and a tenth of the section shift, 5 at most; qa
    the mean of the sentences' and the pairs' means where there are pairs. `sentences` has transcript_id, segment_id,
    section, risk, segment_order and sentence_number, `pairs` transcript_id and pair_risk, `shifts` transcript_id and
    section_shift. Calls without sentences have no row.
    """
    blend = top_share_mean(sentences, group="transcript_id", value="risk").select("transcript_id", "n", "blend")
    parts = sentences.groupBy("transcript_id").agg(
        F.avg(F.when(F.col("section").isin("prepared_remarks", "opening"), F.col("risk"))).alias("prepared"), F.avg(F.when(F.col("section") == "q_and_a", F.col("risk"))).alias("spoken"),
        F.max_by("segment_id", F.struct("risk", -F.col("segment_order"), -F.col("sentence_number"))).alias("worst_segment"),
    )
    asked = pairs.groupBy("transcript_id").agg(F.avg("pair_risk").alias("asked"))
    j = blend.join(parts, "transcript_id").join(asked, "transcript_id", "left").join(shifts.select("transcript_id", "section_shift"), "transcript_id", "left")
    spoken = F.coalesce("spoken", F.lit(0.0))
    overall = F.least(F.lit(100.0), F.round("blend", 2) + F.least(F.coalesce("section_shift", F.lit(0.0)) * 0.1, F.lit(5.0)))
    qa = F.when(F.col("asked").isNotNull(), 0.5 * spoken + 0.5 * F.col("asked")).otherwise(spoken)
    return j.select("transcript_id", F.col("n").cast("bigint").alias("n"), F.round(overall, 2).alias("overall"), F.round(F.coalesce("prepared", F.lit(0.0)), 2).alias("prepared"), F.round(qa, 5).alias("qa"), "worst_segment")


# Weights of hedging, evasiveness and shift in a sentence's risk.
WEIGHTS = (0.35, 0.40, 0.25)


def contributing_factors(text: Column) -> Column:
    """What a sentence's risk is made of: scores, weights, matched terms, counts and tone.

    Needs the columns of hedging, shift_score, evasive, negative and label.
    """
    m = hedging_terms(text)
    return F.struct(
        F.col("hedging_score"), F.col("shift_score").alias("tone_shift_score"), F.col("evasive").alias("evasive_score"),
        *[F.lit(w).alias(f"{n}_weight") for n, w in zip(("hedging", "evasive", "shift"), WEIGHTS, strict=True)],
        m["modals"].alias("matched_modals"), m["qualifiers"].alias("matched_qualifiers"), m["uncertainty"].alias("matched_uncertainty_phrases"), m["deflection"].alias("matched_deflection_phrases"),
        F.col("deflection_count"), F.col("uncertainty_count").alias("uncertainty_phrase_count"), F.col("label").alias("sentiment_label"), F.col("negative").alias("negative_prob"),
    )


def segment_risk(sentences: DataFrame) -> DataFrame:
    """Per segment: risk (0.6 of the mean, 0.4 of the top tenth), both, means, the greatest risk and its sentence.

    Needs segment_id, sentence_id, sentence_number, text, risk, hedging_score, shift_score, evasive and negative. Of
    equally risky sentences the first counts; its text is cut to 200 characters for display.
    """
    top = top_share_mean(sentences, group="segment_id", value="risk").select("segment_id", F.col("mean"), "top_mean", "blend")
    means = {"avg_hedging": ("hedging_score", 2), "avg_tone_shift": ("shift_score", 2), "avg_evasive": ("evasive", 2), "avg_negative_prob": ("negative", 4)}
    worst = F.max_by(F.struct("sentence_id", F.substring("text", 1, 200).alias("t")), F.struct("risk", -F.col("sentence_number"))).alias("w")
    by = sentences.groupBy("segment_id").agg(*[F.round(F.avg(c), n).alias(k) for k, (c, n) in means.items()], F.round(F.max("risk"), 2).alias("max_hidden_risk_in_segment"), F.count(F.lit(1)).alias("sentence_count"), worst)
    return top.join(by, "segment_id").select(
        "segment_id", F.round("blend", 2).alias("segment_risk_score"), F.round("mean", 2).alias("avg_hidden_risk"), F.round("top_mean", 2).alias("top_k_risk"), *means, "max_hidden_risk_in_segment", "sentence_count",
        F.col("w.sentence_id").alias("top_risk_sentence_id"), F.col("w.t").alias("top_risk_sentence_text"),
    )


def risk_band(score: Column) -> Column:
    """critical from 70, high from 40, moderate from 20, else low; null for null."""
    return F.when(score >= 70, "critical").when(score >= 40, "high").when(score >= 20, "moderate").when(score.isNotNull(), "low")
