"""Claims in sentences: candidates, kinds, numbers, and their check against evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import lexicons as lx
from parley.functions.text import first_of, word_count
from parley.operators.risk import tokens_of


def candidates(sentences: DataFrame) -> DataFrame:
    """Those with at least four words, no boilerplate, a topic, and a number or direction or the prepared remarks.

    What the text alone decides stands in a filter of its own, which plans move before the join with segments.
    """
    text = F.col("text")
    topic = text.rlike("(?i)" + "|".join(p for p, _ in lx.CLAIM_TOPICS))
    says = text.rlike("(?i)" + lx.CLAIM_NUMBER) | text.rlike("(?i)" + lx.DIRECTION) | (F.col("section") == "prepared_remarks")
    return sentences.where(topic & (word_count(text) >= 4) & ~text.rlike("(?i)" + lx.BOILERPLATE)).where(says)


def direction(text: Column) -> Column:
    """increase, decrease, flat, or the word of direction itself; null without one."""
    word = F.lower(F.regexp_extract(text, "(?i)" + lx.DIRECTION, 1))
    return F.when(word.isin(*lx.UP), "increase").when(word.isin(*lx.DOWN), "decrease").when(word.isin(*lx.FLAT), "flat").when(word != "", word)


def extract_claims(sentences: DataFrame, *, most: int = 20) -> DataFrame:
    """claim_id, transcript_id, sentence_id, claim_text, claim_type, direction, has_number, confidence.

    Needs transcript_id, sentence_id, segment_order, sentence_number, speaker_role, section and text. Claims are
    numbered in the order of the call; of a call the `most` most confident are kept, earlier ones first among equals:
    a top-k report of the pipeline, whose k is a parameter. Texts are whole; cut them for display only.
    """
    t = F.col("text")
    number = t.rlike("(?i)" + lx.CLAIM_NUMBER)
    way = direction(t)
    confidence = F.least(F.lit(1.0), 0.50 + F.when(number, 0.30).otherwise(0.0) + F.when(way.isNotNull(), 0.15).otherwise(0.0) + F.when(F.col("speaker_role") == "executive", 0.05).otherwise(0.0))
    found = candidates(sentences).select(
        "transcript_id", "sentence_id", "segment_order", "sentence_number", F.col("text").alias("claim_text"),
        first_of(t, lx.CLAIM_TOPICS, F.lit("other")).alias("claim_type"), way.alias("direction"), number.alias("has_number"), F.round(confidence, 2).alias("confidence"),
    )
    order = Window.partitionBy("transcript_id").orderBy("segment_order", "sentence_number", "sentence_id")
    numbered = found.withColumn("n", F.row_number().over(order))
    best = numbered.withColumn("rank", F.row_number().over(Window.partitionBy("transcript_id").orderBy(F.desc("confidence"), "n"))).where(F.col("rank") <= most)
    return best.select(F.format_string("%s_claim_%03d", "transcript_id", "n").alias("claim_id"), "transcript_id", "sentence_id", "claim_text", "claim_type", "direction", "has_number", "confidence")


def _number(c: Column) -> Column:
    return F.regexp_replace(F.when(c != "", c), ",", "").try_cast("double")


def normalized(claims: DataFrame, *, text: str, default: str) -> DataFrame:
    """`claims` with metric, value, lower_bound, upper_bound, unit, period and geography.

    Of a range of percentages the middle, else basis points, a percentage, or dollars in full are taken, in this order.
    """
    t = F.col(text)
    low = F.coalesce(*[_number(F.regexp_extract(t, "(?i)" + lx.RANGE_PERCENT, i)) for i in (1, 3)])
    high = F.coalesce(*[_number(F.regexp_extract(t, "(?i)" + lx.RANGE_PERCENT, i)) for i in (2, 4)])
    points, percent = (_number(F.regexp_extract(t, "(?i)" + p, 1)) for p in (lx.BASIS_POINTS, lx.PERCENT))
    dollars, size = _number(F.regexp_extract(t, "(?i)" + lx.DOLLARS, 1)), F.lower(F.regexp_extract(t, "(?i)" + lx.DOLLARS, 2))
    scale = F.when(size.isin("billion", "b"), 1e9).when(size.isin("million", "m"), 1e6).when(size.isin("thousand", "k"), 1e3).otherwise(1.0)
    ranged = low.isNotNull() & high.isNotNull()
    return claims.withColumns(
        {
            "metric": first_of(t, lx.METRICS, F.col(default)),
            "value": F.when(ranged, (low + high) / 2).when(points.isNotNull(), points).when(percent.isNotNull(), percent).otherwise(dollars * scale),
            "lower_bound": F.when(ranged, low),
            "upper_bound": F.when(ranged, high),
            "unit": F.when(ranged, "percent").when(points.isNotNull(), "bps").when(percent.isNotNull(), "percent").when(dollars.isNotNull(), F.when(scale == 1e9, "usd_billions").when(scale == 1e6, "usd_millions").otherwise("usd")),
            "period": first_of(t, lx.PERIODS, F.lit("unspecified_period")),
            "geography": first_of(t, lx.PLACES, F.lit(None).cast("string")),
        }
    )


def temporal_category(published: Column, call: Column) -> Column:
    """contemporaneous (not after the call), post_call (to 90 days after, or undated) or outcome (later)."""
    days = F.datediff(published, call)
    return F.when(days <= 0, "contemporaneous").when(days > 90, "outcome").otherwise("post_call")


#: Days of a bucket of the window join.
SPAN = 182


def within_days(left: DataFrame, right: DataFrame, *, entity: str, left_day: str, right_day: str, before: int, after: int) -> DataFrame:
    """Pairs of the same entity with right_day in [left_day - before, left_day + after], all columns of both.

    Days are dates. An equi-join on (entity, bucket of days): a left row is put in each bucket its window touches, a
    right row in one, so every pair comes once and a large entity is spread over its buckets. Column names of both
    sides must differ but for `entity`; null entities and days have no pair.
    """
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    bucket = lambda n: F.floor(n / SPAN).cast("int")
    at = number(F.col(left_day))
    ls = left.where(F.col(left_day).isNotNull()).select("*", F.explode(F.sequence(bucket(at - before), bucket(at + after))).alias("_bucket"))
    rs = right.where(F.col(right_day).isNotNull()).withColumn("_bucket", bucket(number(F.col(right_day))))
    return ls.join(rs, [entity, "_bucket"]).where(F.col(right_day).between(F.date_sub(left_day, before), F.date_add(left_day, after))).drop("_bucket")


def words_of(text: Column) -> Column:
    """The words of a text as they come, stop words left out."""
    return F.filter(tokens_of(text, 2), lambda x: ~x.isin(*lx.STOP_WORDS))


def term_weights(text: Column) -> Column:
    """Map of the words of a short text, stop words left out, to 1 + ln(count)."""
    words = words_of(text)
    weigh = lambda w: F.map_from_entries(F.transform(F.array_distinct(w), lambda t: F.struct(t, 1 + F.log(F.size(F.filter(w, lambda x: x == t)).cast("double")))))
    return F.transform(F.array(words), weigh)[0]


def likeness(left: Column, right: Column) -> Column:
    """The cosine that tfidf_cosine gives for single words, from the term weights of the two texts.

    A shared term weighs 1, another 1 + ln(3/2): so a text's norm follows from its sum of squares and the shared part.
    """
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x)
    idf = (1 + F.log(F.lit(1.5))) * (1 + F.log(F.lit(1.5)))
    shared = F.transform(F.array_intersect(F.map_keys(left), F.map_keys(right)), lambda k: F.struct(F.element_at(left, k).alias("l"), F.element_at(right, k).alias("r")))
    sums = F.aggregate(shared, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("l"), F.lit(0.0).alias("r")), lambda s, x: F.struct((s["d"] + x["l"] * x["r"]).alias("d"), (s["l"] + x["l"] * x["l"]).alias("l"), (s["r"] + x["r"] * x["r"]).alias("r")))
    norm = lambda total, part: F.sqrt(idf * total + (1 - idf) * part)
    return F.coalesce(F.transform(F.array(sums), lambda s: F.try_divide(s["d"], norm(square(left), s["l"]) * norm(square(right), s["r"])))[0], F.lit(0.0))


def signs(text: Column) -> tuple[Column, Column, Column]:
    """The numbers in a text, and whether it holds words of rise and of fall."""
    numbers = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([-+]?\d+[\.,]?\d*)"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda x: x.isNotNull())
    return numbers, F.lower(text).rlike(lx.POSITIVE), F.lower(text).rlike(lx.NEGATIVE_SIGNS)


def evidence_signs(evidence: DataFrame, *, text: str) -> DataFrame:
    """`evidence` with numbers, pos, neg and terms of its text: what every claim is held against, worked out once."""
    t = F.coalesce(F.col(text), F.lit(""))
    numbers, pos, neg = signs(t)
    return evidence.withColumns({"numbers": numbers, "pos": pos, "neg": neg, "terms": term_weights(t)})


def told(claims: DataFrame, *keys: str) -> DataFrame:
    """`keys`, claim_id, value, direction and claim_terms: what of a claim is held against evidence."""
    return claims.select(*keys, "claim_id", "value", "direction", term_weights(F.col("claim_text")).alias("claim_terms"))


def verify(claims: DataFrame, links: DataFrame, *, reasons: bool = False) -> DataFrame:
    """claim_id, status, confidence, n_evidence, support, contradiction of every claim against its evidence.

    `links` has claim_id, evidence_id, source_type, authority_score and the columns of `evidence_signs` of what was
    published after the call; columns of `told` that it has too spare the join by claim. Numbers of filings count most,
    then direction, then likeness of words. With `reasons` there is a reason too: what the signals add up to, and of the
    filings whose numbers were compared the first three by id, at most 800 characters. A claim without evidence is
    NOT_VERIFIABLE with confidence 0.20.
    """
    pairs = links if "claim_terms" in links.columns else links.join(told(claims), "claim_id")
    numbers, pos, neg = F.col("numbers"), F.col("pos"), F.col("neg")
    apart = F.array_min(F.transform(numbers, lambda x: F.abs(x - F.col("value")) / F.abs(F.col("value"))))
    near = F.when(F.col("value").isNull() | (F.size(numbers) == 0), None).when((F.col("value") == 0) | (apart > 0.5), 0.0).when(apart <= 0.10, 1.0).when(apart <= 0.25, 0.5).otherwise(0.2)
    up, down = F.col("direction").isin("increase", "grow"), F.col("direction") == "decrease"
    way = (
        F.when(up, F.when(pos & ~neg, 1.0).when(neg & ~pos, 0.0).otherwise(0.5))
        .when(down, F.when(neg & ~pos, 1.0).when(pos & ~neg, 0.0).otherwise(0.5))
        .when(F.col("direction") == "flat", F.when(~pos & ~neg, 1.0).otherwise(0.5))
    )
    filing = F.col("source_type") == "sec"
    weight = F.when(filing, 1.0).when(F.col("authority_score") >= 0.70, 0.75).when(F.col("authority_score") >= 0.45, 0.50).otherwise(0.25)
    rated = pairs.withColumns({"near": near, "way": way, "w": weight, "filing": filing})
    # Likeness of words decides only where a filing gives neither number nor direction, and for news.
    asked = ~F.col("filing") | (F.col("near").isNull() & F.col("way").isNull())
    s = rated.withColumn("similarity", F.when(asked, likeness(F.col("claim_terms"), F.col("terms"))).otherwise(0.0)).select("claim_id", "evidence_id", "near", "way", "w", "filing", "similarity")
    news = F.when(F.col("similarity") >= 0.20, F.when(F.col("way").isNotNull(), (F.col("similarity") + F.col("way")) / 2).otherwise(F.col("similarity")))
    s = s.withColumn("news", F.when(~F.col("filing"), news))
    support = (
        F.when(F.col("filing") & F.col("near").isNotNull(), F.when(F.col("near") >= 0.8, F.col("near")).when(F.col("near") >= 0.4, 0.5).otherwise(0.0))
        .when(F.col("filing") & F.col("way").isNotNull(), F.when(F.col("way") >= 0.8, F.col("way")).when(F.col("way") <= 0.2, 0.0).otherwise(0.4))
        .when(F.col("filing"), F.when(F.col("similarity") >= 0.30, F.col("similarity")).otherwise(0.0))
        .when(F.col("news") >= 0.50, F.col("news")).when(F.col("news") >= 0.25, 0.4).otherwise(0.0)
    )
    against = (
        F.when(F.col("filing") & F.col("near").isNotNull(), F.when(F.col("near") >= 0.8, 0.0).when(F.col("near") >= 0.4, 0.3).otherwise(1.0))
        .when(F.col("filing"), F.when(F.col("way") <= 0.2, 1.0).otherwise(0.0))
        .when((F.col("news") < 0.50) & (F.col("news") >= 0.25), 0.2).otherwise(0.0)
    )
    counted = F.when(F.col("filing") | F.col("news").isNotNull(), F.col("w")).otherwise(0.0)
    sums = s.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.sum(support * F.col("w")).alias("s"), F.sum(against * F.col("w")).alias("c"), F.sum(counted).alias("w"))
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("w")), F.lit(0.0))
    out = claims.select("claim_id").join(sums, "claim_id", "left").select("claim_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), rate("s").alias("support"), rate("c").alias("contradiction"))
    rated_out = concluded(out)
    if not reasons:
        return rated_out
    said = F.when(F.col("near") >= 0.8, "numbers agree").when(F.col("near") >= 0.4, "numbers agree in part").otherwise("numbers disagree")
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy("evidence_id"))
    # Of each claim three rows at most: ranks are limited before the shuffle.
    first = s.where(F.col("filing") & F.col("near").isNotNull()).select("claim_id", "evidence_id", F.concat("evidence_id", F.lit(": "), said).alias("part")).withColumn("k", place).where("k <= 3")
    parts = first.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), " | ").alias("parts"))
    return reasoned(rated_out.join(parts, "claim_id", "left"))


def concluded(sums: DataFrame) -> DataFrame:
    """`sums` (n_evidence, support, contradiction) with status and confidence."""
    sup, con = F.col("support"), F.col("contradiction")
    status = (
        F.when(F.col("n_evidence") == 0, "NOT_VERIFIABLE").when((sup >= 0.60) & (con < 0.20), "SUPPORTED").when((con >= 0.60) & (sup < 0.20), "CONTRADICTED")
        .when((sup >= 0.30) | (con >= 0.30), "PARTIALLY_SUPPORTED").otherwise("NOT_VERIFIABLE")
    )
    confidence = (
        F.when(F.col("n_evidence") == 0, 0.20).when(status == "SUPPORTED", F.least(0.50 + sup * 0.50, F.lit(0.95))).when(status == "CONTRADICTED", F.least(0.50 + con * 0.50, F.lit(0.95)))
        .when(status == "PARTIALLY_SUPPORTED", 0.45 + F.abs(sup - con) * 0.30).otherwise(0.25)
    )
    return sums.withColumns({"status": status, "confidence": confidence})


def reasoned(verdicts: DataFrame) -> DataFrame:
    """`verdicts` with the reason: what the signals add up to and `parts`, which goes, at most 800 characters."""
    signals = F.format_string("support %.2f, contradiction %.2f", "support", "contradiction")
    summary = F.when(F.col("n_evidence") == 0, "No evidence of after the call.").otherwise(F.concat(F.lower(F.replace("status", F.lit("_"), F.lit(" "))), F.lit(" by "), F.col("n_evidence").cast("string"), F.lit(" items: "), signals, F.lit(".")))
    return verdicts.withColumn("reason", F.substring(F.concat(summary, F.coalesce(F.concat(F.lit(" "), F.col("parts")), F.lit(""))), 1, 800)).drop("parts")


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for every `n` neighbouring characters along the last axis."""
    size = codes.shape[-1] - n + 1
    h = np.zeros((*codes.shape[:-1], size), np.uint64)
    for k in range(n):
        h = h * np.uint64(1_099_511_628_211) + codes[..., k : k + size]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _pieces(text: str, prefix: int) -> dict[tuple[int, str], None]:
    """The least gram of every stretch of `prefix` characters, with the piece of text that all stretches with it lie in."""
    n = max(1, prefix // 2)
    width = prefix - n + 1
    h = _grams(_codes(text), n)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(h, width).argmin(axis=1) + np.arange(len(h) - width + 1))
    return dict.fromkeys((g, text[max(0, p - width + 1) : p + prefix]) for p, g in zip(at.tolist(), h[at].view(np.int64).tolist()))


def leaks(calls: DataFrame, evidence: DataFrame, *, prefix: int = 40) -> DataFrame:
    """transcript_id, evidence_id, by (url or text): evidence whose url, or text's first characters, a call's text holds.

    `calls` has transcript_id and text, `evidence` evidence_id, url and text. Urls meet those written in a text. First
    characters meet the text by the least of their grams of half as many characters: the same gram is the least of the
    stretch of the text that equals them, and a text has few of these. The characters themselves decide. Null and empty
    urls and shorter texts never match.
    """
    urls = calls.select("transcript_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(https?://[^\s<>\"']+)"), F.lit(1)))).alias("url"))
    by_url = urls.hint("merge").join(evidence.where("url <> ''").select("evidence_id", "url"), "url").select("transcript_id", "evidence_id", F.lit("url").alias("by"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, grams, texts = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for g, piece in _pieces(t, prefix):
                    rows.append(i)
                    grams.append(g)
                    texts.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), b.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string())], names=["gram", "transcript_id", "piece"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = _grams(_codes("".join(b.column(1).to_pylist())).reshape(-1, prefix), max(1, prefix // 2)).min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), b.column(0), b.column(1)], names=["gram", "evidence_id", "head"])

    there = calls.where(F.length("text") >= prefix).select(F.col("transcript_id").cast("string"), "text").mapInArrow(pieces, "gram bigint, transcript_id string, piece string")
    begun = evidence.where(F.length("text") >= prefix).select(F.col("evidence_id").cast("string"), F.substring("text", 1, prefix).alias("head")).mapInArrow(heads, "gram bigint, evidence_id string, head string")
    # A hint, since plans take the pieces to be as small as the calls they are made of and would send them to all workers.
    by_text = there.hint("merge").join(begun, "gram").where(F.contains("piece", "head")).select("transcript_id", "evidence_id", F.lit("text").alias("by"))
    return by_url.unionByName(by_text).distinct()
