"""Labels, agreement, classification measures, correlation, regression and rank tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_left(score: Column) -> Column:
    """0 below 20, 1 below 50, else 2; null for null."""
    return F.when(score < 20, 0).when(score < 50, 1).when(score.isNotNull(), 2)


def label_right(score: Column) -> Column:
    """0 to 20, 1 to 50, else 2, ends included."""
    return F.when(score <= 20, 0).when(score <= 50, 1).when(score.isNotNull(), 2)


def label_between(score: Column, low: float, high: float) -> Column:
    """0 to `low`, 1 to `high`, else 2, ends included; null for null."""
    return F.when(score <= low, 0).when(score <= high, 1).when(score.isNotNull(), 2)


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def time_split(day: Column) -> Column:
    """train to the end of 2018, val to the end of 2021, test after."""
    return F.when(day <= "2018-12-31", "train").when(day <= "2021-12-31", "val").when(day.isNotNull(), "test")


def synthetic_label(label: Column, key: Column, seed: int = 42) -> Column:
    """The label with noise: raised for 8 % of the keys, lowered for 7 %, within 0..2; the same for the same seed."""
    u = uniform(F.concat_ws("|", key.cast("string"), F.lit(seed)))
    return F.when(label.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(2), F.when(u < 0.08, label + 1).when(u < 0.15, label - 1).otherwise(label))))


def confusion(df: DataFrame, *, truth: str, guess: str, labels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """truth, guess, n for every pair of labels, absent ones with 0; other labels are left out."""
    counts = df.where(F.col(truth).isin(*labels) & F.col(guess).isin(*labels)).groupBy(F.col(truth).cast("int").alias("truth"), F.col(guess).cast("int").alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "truth int, guess int")
    return grid.join(counts, ["truth", "guess"], "left").select("truth", "guess", F.coalesce("n", F.lit(0)).alias("n"))


def class_measures(matrix: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support of a confusion matrix; a division by zero gives 0."""
    hit = F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0))
    rows = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    cols = matrix.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    m = rows.join(cols, "label").withColumns({"precision": zero(F.col("hits"), F.col("guessed")), "recall": zero(F.col("hits"), F.col("support"))})
    return m.select("label", "precision", "recall", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def overall_measures(matrix: DataFrame) -> DataFrame:
    """One row: accuracy and macro averages of precision, recall and f1."""
    hits = F.sum(F.col("recall") * F.col("support"))
    return class_measures(matrix).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.coalesce(F.try_divide(hits, F.sum("support")), F.lit(0.0)).alias("accuracy")
    )


def cohens_kappa(matrix: DataFrame) -> DataFrame:
    """One row: n, observed and expected agreement, kappa; 1 where chance agrees wholly, 0 without items."""
    hit = F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0))
    rows = matrix.groupBy(F.col("truth").alias("k")).agg(F.sum("n").alias("a"), hit.alias("h"))
    both = rows.join(matrix.groupBy(F.col("guess").alias("k")).agg(F.sum("n").alias("b")), "k")
    n = F.sum("a")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = both.agg(n.alias("n"), zero(F.try_divide(F.sum("h"), n)).alias("observed"), zero(F.try_divide(F.sum((F.col("a") * F.col("b")).cast("double")), n * n)).alias("expected"))
    kappa = F.when(F.col("n") == 0, 0.0).when(F.col("expected") >= 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return out.withColumn("kappa", kappa)


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """`df` (nulls left out) with the average rank of each value, from 1.

    Values are counted first; places of the distinct values come from counts in ranges, so no task orders all rows.
    """
    d = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = d.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    parts = counts.withColumn("_part", _range(counts, value))
    sums = parts.groupBy("_part").agg(F.sum("_c").alias("_s"))
    offset = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("_c").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = parts.withColumn("_in", inner).join(offset.select("_part", "_before"), "_part")
    rank = (F.col("_before") + F.col("_in") + (F.col("_c") + 1) / 2).alias(name)
    return d.join(ranked.select(F.col(value).alias("_ranked"), rank), d[value] == F.col("_ranked")).drop("_ranked")


#: Distinct values of a range, on average, and ranges at most: a bound on what is sent back and forth, not on values.
RANGE_VALUES, RANGES = 200_000, 10_000


def _range(counts: DataFrame, value: str) -> Column:
    """The range of a value: quantiles of the distinct values, as many as these need."""
    n = min(RANGES, max(1, -(-counts.count() // RANGE_VALUES)))
    if n == 1:
        return F.lit(0)
    cuts = sorted(set(counts.select(F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
    return F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda k, c: k + F.when(F.col(value) > c, 1).otherwise(0))


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs by Student's t; null below 5 pairs or without r, 0 where |r| is 1."""
    if r is None or n < 5:
        return None
    return 0.0 if abs(r) >= 1 else student_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def resampled(df: DataFrame, x: str, y: str, *, ranks: bool = False, resamples: int = 2000, seed: int = 42, blocks: int = 1000) -> tuple[float, float] | None:
    """The 2.5 and 97.5 percentiles of the correlation over resamples of blocks of rows; null below 5 rows.

    Rows fall into `blocks` blocks by hash, whose moments are added up in one pass; resamples draw blocks, so what
    reaches the driver is `blocks` rows however many there are. Below `blocks` rows about every row is a block of its own.
    """
    import numpy as np

    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if ranks:
        both = average_ranks(average_ranks(both, "x", "rx"), "y", "ry").select(F.col("rx").alias("x"), F.col("ry").alias("y"))
    b = F.pmod(F.xxhash64("x", "y", F.monotonically_increasing_id()), F.lit(blocks))
    one = lambda c: F.sum(c)
    rows = both.groupBy(b.alias("b")).agg(F.count(F.lit(1)).cast("double"), one("x"), one("y"), one(F.col("x") * F.col("x")), one(F.col("y") * F.col("y")), one(F.col("x") * F.col("y"))).collect()
    m = np.array([list(r)[1:] for r in rows])
    if not len(m) or m[:, 0].sum() < 5:
        return None
    draws = np.random.default_rng(seed).multinomial(len(m), np.full(len(m), 1 / len(m)), size=resamples) @ m
    n, sx, sy, xx, yy, xy = draws.T
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (n * xy - sx * sy) / np.sqrt((n * xx - sx**2) * (n * yy - sy**2))
    r = r[np.isfinite(r)]
    return (float(np.percentile(r, 2.5)), float(np.percentile(r, 97.5))) if len(r) else None


def correlation(df: DataFrame, x: str, y: str, *, ranks: bool = False) -> DataFrame:
    """One row: n, r (of ranks: Spearman's), p, low, high of two columns over the rows that have both."""
    row = (spearman(df, x, y).withColumnRenamed("rho", "r") if ranks else pearson(df, [x], [y])).first()
    ends = resampled(df, x, y, ranks=ranks) if row["r"] is not None else None
    low, high = ends or (None, None)
    return df.sparkSession.createDataFrame([(row["n"], row["r"], correlation_p(row["r"], row["n"]), low, high)], "n bigint, r double, p double, low double, high double")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho over rows where both are there; null below 5 rows."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = average_ranks(average_ranks(both, "_x", "_rx"), "_y", "_ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 5, F.corr("_rx", "_ry")).alias("rho"))


def pearson(df: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    """x, y, n, r of every pair of columns, in one pass; null below 5 rows in common."""
    cols = []
    for x in xs:
        for y in ys:
            ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
            n = F.count(F.when(ok, 1))
            cols.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), n.alias("n"), F.when(n >= 5, F.corr(F.when(ok, F.col(x).cast("double")), F.when(ok, F.col(y).cast("double")))).alias("r")))
    return df.agg(F.array(*cols).alias("a")).select(F.inline("a"))


def least_squares(df: DataFrame, *, y: str, xs: list[str]) -> DataFrame:
    """term, estimate, std_error, t, p, r_squared of y ~ 1 + xs; no rows below 10 complete rows or if singular.

    One pass adds up the moments, (len(xs) + 1)^2 numbers, which the driver solves.
    """
    import numpy as np

    spark = df.sparkSession
    schema = "term string, estimate double, std_error double, t double, p double, r_squared double"
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna()
    terms = ["1", *xs]
    val = lambda t: F.lit(1.0) if t == "1" else F.col(t)
    sums = [F.sum(val(a) * val(b)).alias(f"m{i}_{k}") for i, a in enumerate(terms) for k, b in enumerate(terms) if k >= i]
    row = complete.agg(*sums, *[F.sum(val(a) * F.col(y)).alias(f"v{i}") for i, a in enumerate(terms)], F.sum(F.col(y) * F.col(y)).alias("yy")).first()
    n = row["m0_0"] or 0
    if n < 10:
        return spark.createDataFrame([], schema)
    m = np.array([[row[f"m{min(i, k)}_{max(i, k)}"] for k in range(len(terms))] for i in range(len(terms))])
    v = np.array([row[f"v{i}"] for i in range(len(terms))])
    try:
        inv = np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return spark.createDataFrame([], schema)
    beta = inv @ v
    rss = float(row["yy"] - beta @ v)
    tss = float(row["yy"] - v[0] ** 2 / n)
    df_left = n - len(terms)
    se = np.sqrt(np.maximum(np.diag(inv) * rss / df_left, 0.0))
    r2 = 1 - rss / tss if tss > 0 else 0.0
    out = [("intercept" if t == "1" else t, float(b), float(s), float(b / s) if s else None, float(student_p(b / s, df_left)) if s else None, float(r2)) for t, b, s in zip(terms, beta, se, strict=True)]
    return spark.createDataFrame(out, schema)


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    return incomplete_beta(df / 2, 0.5, x)


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return front * h / a


def group_compare(df: DataFrame, *, group: str, value: str) -> DataFrame:
    """One row: n, mean, median, population deviation of the rows where `group` is true and false, U and z of the first.

    U counts the pairs in which the first exceeds, ties half; z has the ties' correction and none for continuity.
    """
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    ranked = average_ranks(d, "_v", "_r")
    g, o = F.col("_g"), ~F.col("_g")
    side = lambda c, n: [F.count(F.when(c, 1)).alias(f"n_{n}"), F.avg(F.when(c, F.col("_v"))).alias(f"mean_{n}"), F.median(F.when(c, F.col("_v"))).alias(f"median_{n}"), F.stddev_pop(F.when(c, F.col("_v"))).alias(f"std_{n}")]
    s = ranked.agg(*side(g, "high"), *side(o, "low"), F.sum(F.when(g, F.col("_r"))).alias("_rs"), F.count(F.lit(1)).alias("_n"))
    ties = d.groupBy("_v").agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum(F.col("c") ** 3 - F.col("c"))).first()[0] or 0.0
    u = F.col("_rs") - F.col("n_high") * (F.col("n_high") + 1) / 2
    nn = F.col("n_high") * F.col("n_low")
    var = nn / 12.0 * (F.col("_n") + 1 - F.try_divide(F.lit(float(ties)), F.col("_n") * (F.col("_n") - 1)))
    return s.withColumns({"u": u, "z": F.try_divide(u - nn / 2, F.sqrt(var))}).drop("_rs", "_n")


def with_p(compared: DataFrame) -> DataFrame:
    """`compared` with p, two-sided, of its column z by the normal distribution; null for null."""
    p = [(r["z"], None if r["z"] is None else normal_p(r["z"])) for r in compared.select("z").collect()]  # one row
    z, value = p[0] if p else (None, None)
    return compared.withColumn("p", F.lit(value).cast("double"))


def outcome_compare(df: DataFrame, *, by: str, value: str, least: int = 3) -> DataFrame:
    """One row: n, mean and median of `value` where `by` is above and below its median, U, z, p and a note.

    With fewer than `least` values on a side, the note says so and the figures of the test are null.
    """
    middle = df.agg(F.median(F.col(by).cast("double"))).first()[0]
    side = F.when(F.col(by).cast("double") > F.lit(middle), True).when(F.col(by).cast("double") <= F.lit(middle), False)
    m = with_p(group_compare(df.withColumn("_side", side), group="_side", value=value))
    few = (F.col("n_high") < least) | (F.col("n_low") < least)
    return m.select("n_high", "mean_high", "median_high", "n_low", "mean_low", "median_low", *[F.when(~few, F.col(c)).alias(c) for c in ("u", "z", "p")], F.when(few, "too few values").alias("note"))


def quartile_compare(df: DataFrame, *, by: str, value: str) -> DataFrame:
    """group_compare of the rows at or above the upper quartile of `by` with those at or below the lower one."""
    q = df.agg(F.percentile(F.col(by).cast("double"), F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
    low, high = q if q else (None, None)
    side = F.when(F.col(by) >= F.lit(high), True).when(F.col(by) <= F.lit(low), False)
    return group_compare(df.withColumn("_side", side), group="_side", value=value)


def signed_rank(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, w (the smaller sum of signed ranks), z of paired columns; pairs with a null or no difference left out."""
    d = df.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("_d")).where("_d is not null and _d <> 0").withColumn("_a", F.abs("_d"))
    ranked = average_ranks(d, "_a", "_r")
    s = ranked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("minus"))
    n = F.col("n")
    w = F.least("plus", "minus")
    return s.select("n", w.alias("w"), F.try_divide(w - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("z"))


def descriptives(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, mean, median, std (of a sample), min, max, q25, q75 of each column, nulls left out, in one pass."""
    per = [
        F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
                 F.percentile(c, F.lit(0.25)).alias("q25"), F.percentile(c, F.lit(0.75)).alias("q75"))
        for c in columns
    ]
    return df.agg(F.array(*per).alias("a")).select(F.inline("a"))


def bootstrap_macro_f1(df: DataFrame, *, truth: str, guess: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """One row: macro F1 of the labels 0..2 and its 2.5 and 97.5 percentiles over resamples.

    Resamples are drawn from the nine counts of the confusion matrix, which is the same as drawing rows, by numpy.
    """
    import numpy as np

    m = np.zeros((3, 3))
    for r in confusion(df, truth=truth, guess=guess).collect():  # nine rows
        m[r["truth"], r["guess"]] = r["n"]

    def f1(x: np.ndarray) -> float:
        with np.errstate(invalid="ignore", divide="ignore"):
            p, q = np.nan_to_num(np.diag(x) / x.sum(axis=0)), np.nan_to_num(np.diag(x) / x.sum(axis=1))
            return float(np.nan_to_num(2 * p * q / (p + q)).mean())

    n = int(m.sum())
    rng = np.random.default_rng(seed)
    draws = [f1(rng.multinomial(n, (m / n).ravel()).reshape(3, 3)) for _ in range(resamples)] if n else [0.0]
    low, high = np.percentile(draws, [2.5, 97.5])
    return df.sparkSession.createDataFrame([(n, f1(m), float(low), float(high))], "n bigint, macro_f1 double, low double, high double")
