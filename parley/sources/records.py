"""Raw transcript records, annotation sheets, filings, facts, prices and news from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = T.StructType([T.StructField(n, T.StringType()) for n in ("speaker", "role", "section", "text")])
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("symbol", "company_name", "company_id", "year", "quarter", "date", "sector", "content")]
    + [T.StructField("structured_content", T.ArrayType(PIECE))]
)


def read_jsonl(spark: SparkSession, path: str, *, keep_malformed: bool = False) -> DataFrame:
    """One record a line; blank lines are skipped, malformed ones dropped, or kept in _corrupt_record."""
    if keep_malformed:
        schema = T.StructType([*RECORD.fields, T.StructField("_corrupt_record", T.StringType())])
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A file that holds one record or an array of them."""
    return spark.read.schema(RECORD).option("multiLine", True).json(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet export of a data set, brought to the columns of a record; missing ones are null."""
    df = spark.read.parquet(path)
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(have[f.name]) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields])


def read_transcripts(spark: SparkSession, source: str, path: str, limit: int | None = None) -> DataFrame:
    """Records of a source (export, jsonl or json); another name raises ValueError. The limit counts source records.

    It takes the first ones in the order of the source's files and needs no sort.
    """
    readers = {"export": read_export, "jsonl": read_jsonl, "json": read_json}
    if source not in readers:
        raise ValueError(f"unknown source {source!r}; known are {sorted(readers)}")
    df = readers[source](spark, path)
    return df if limit is None else df.limit(limit)


ANNOTATION_COLUMNS = [
    "qa_id", "transcript_id", "ticker", "date", "question_text", "answer_text", "auto_evasiveness_score", "auto_hedging_score", "auto_hidden_risk_score",
    "evaluation_type", "annotator_id", "label_evasive", "label_hedging", "label_topic_avoidance", "label_perceived_uncertainty", "annotator_notes",
]


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows of an annotation sheet: those whose label_evasive is 0, 1 or 2; numbers that can't be read are null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    kinds = {c: "double" for c in ANNOTATION_COLUMNS if c.endswith("score")} | {c: "int" for c in ANNOTATION_COLUMNS if c.startswith("label_")}
    cols = [(F.trim(F.col(c)).try_cast(kinds[c]) if c in kinds else F.col(c)).alias(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in ANNOTATION_COLUMNS]
    return df.select(*cols).where(F.col("label_evasive").isin(0, 1, 2))


def cik_of_tickers(spark: SparkSession, path: str) -> DataFrame:
    """ticker, cik (ten digits): of a JSON object whose values have ticker and cik_str."""
    entry = T.MapType(T.StringType(), T.StructType([T.StructField("cik_str", T.StringType()), T.StructField("ticker", T.StringType()), T.StructField("title", T.StringType())]))
    raw = spark.read.option("wholetext", True).text(path)
    e = raw.select(F.explode(F.map_values(F.from_json("value", entry))).alias("e"))
    return e.select(F.upper("e.ticker").alias("ticker"), F.lpad("e.cik_str", 10, "0").alias("cik")).where("ticker is not null").distinct()


_ARRAYS = ["form", "filingDate", "accessionNumber", "primaryDocument", "primaryDocDescription"]


def filings(recent: DataFrame, *, key: str, arrays: str, forms: tuple[str, ...] = ("10-K", "10-Q", "8-K"), start: Column | None = None, end: Column | None = None) -> DataFrame:
    """key, form, filing_date, ... of a struct of parallel arrays, of the forms and between the days given (inclusive)."""
    zipped = F.arrays_zip(*[F.col(f"{arrays}.{a}").alias(a) for a in _ARRAYS])
    rows = recent.select(key, F.inline(zipped)).withColumn("filing_date", F.col("filingDate").try_cast("date"))
    rows = rows.where(F.col("form").isin(*forms))
    if start is not None:
        rows = rows.where(F.col("filing_date") >= start)
    if end is not None:
        rows = rows.where(F.col("filing_date") <= end)
    return rows.select(key, "form", "filing_date", F.col("accessionNumber").alias("accession"), F.col("primaryDocument").alias("document"), F.col("primaryDocDescription").alias("description"))


def overlapping(archives: DataFrame, start: Column, end: Column) -> DataFrame:
    """Archives whose interval [filingFrom, filingTo] overlaps [start, end]."""
    return archives.where((start <= F.col("filingTo")) & (end >= F.col("filingFrom")))


_FACT = T.StructType([T.StructField(n, T.StringType()) for n in ("end", "filed", "form", "frame")] + [T.StructField("val", T.DoubleType())])
_FACTS = T.StructType([T.StructField("facts", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(_FACT)))]))))])


def company_facts(documents: DataFrame, *, key: str, json: str) -> DataFrame:
    """key, taxonomy, concept, unit, position, end, filed, form, frame, val of companies' facts in JSON."""
    parsed = documents.select(key, F.from_json(json, _FACTS).alias("d")).select(key, F.explode("d.facts").alias("taxonomy", "concepts"))
    units = parsed.select(key, "taxonomy", F.explode("concepts").alias("concept", "c")).select(key, "taxonomy", "concept", F.explode("c.units").alias("unit", "items"))
    return units.select(key, "taxonomy", "concept", "unit", F.posexplode("items").alias("position", "f")).select(
        key, "taxonomy", "concept", "unit", "position", F.col("f.end").try_cast("date").alias("end"), F.col("f.filed").try_cast("date").alias("filed"), "f.form", "f.frame", "f.val"
    )


def reported_fact(facts: DataFrame, *, key: str, concepts: list[str], target: Column, within: int = 45) -> DataFrame:
    """key, concept, val: the first fact by priority of its concept, the last listed, that ends within so many days."""
    rank = F.array_position(F.array(*map(F.lit, concepts)), F.col("concept"))
    near = facts.where(F.col("concept").isin(*concepts) & (F.abs(F.datediff("end", target)) <= within) & F.col("val").isNotNull())
    w = Window.partitionBy(key).orderBy(rank, "unit", F.desc("position"))
    return near.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "concept", "val")


def outcome(facts: DataFrame, *, key: str, concept: str, as_of: Column, lookback: int = 120, unit: str = "USD") -> DataFrame:
    """key, value in millions of the latest fact that ended (or was filed) on or before a day, at most so long ago.

    Facts with a frame are left out, as they repeat others; so are those marked as accruals or preferred stock.
    """
    day = F.coalesce("end", "filed")
    seen = facts.where((F.col("concept") == concept) & (F.col("unit") == unit) & F.col("frame").isNull() & ~F.coalesce(F.lower("form").rlike("accrual|preferred"), F.lit(False)) & day.between(F.date_sub(as_of, lookback), as_of))
    return seen.groupBy(key).agg((F.max_by("val", F.struct(day, -F.col("position"))) / 1e6).alias("value"))


def read_prices(spark: SparkSession, path: str, events: DataFrame | None = None, days: int = 60) -> DataFrame:
    """ticker, date, open, high, low, close, volume of price files; days without a close are left out.

    With `events` (ticker, event_day) just the days within `days` of an event of the ticker, each once. Columns that the
    files don't have are null.
    """
    df = spark.read.parquet(path)
    low = {c.lower(): c for c in df.columns}
    of = lambda c, kind: (F.col(low[c]) if c in low else F.lit(None)).cast(kind).alias(c)
    prices = df.select(F.upper(F.col(low["ticker"])).alias("ticker"), F.to_date(F.col(low["date"])).alias("date"), *[of(c, "double") for c in ("open", "high", "low", "close")], of("volume", "bigint")).where("close is not null")
    if events is None:
        return prices
    from parley.operators.claims import within_days

    met = within_days(events.select("ticker", "event_day").distinct(), prices.withColumnRenamed("date", "day"), entity="ticker", left_day="event_day", right_day="day", before=days, after=days)
    return met.drop("event_day").withColumnRenamed("day", "date").distinct()


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """title, link, published, source of the items of an RSS file; the source follows the last ` - ` of a title."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string").load(path)
    cut = F.regexp_extract("title", r"^(.*) - ([^-]+)$", 1)
    from parley.functions.instants import instant_micros

    return items.select(
        F.when(cut != "", cut).otherwise(F.col("title")).alias("title"), "link", F.timestamp_micros(instant_micros(F.col("pubDate"))).alias("published"),
        F.when(cut != "", F.regexp_extract("title", r"^(.*) - ([^-]+)$", 2)).otherwise("unknown").alias("source"),
    )


def news_scores(items: DataFrame, *, query: str, known_sources: list[str]) -> DataFrame:
    """`items` with authority_score (0.75 for a known source, else 0.50) and relevance_score (words of the query in the title)."""
    q = sorted({w for w in query.lower().split() if w})
    hits = F.size(F.array_intersect(F.array(*map(F.lit, q)).cast("array<string>"), F.split(F.lower("title"), r"\W+")))
    known = F.lower("source").rlike("|".join(known_sources).lower()) if known_sources else F.lit(False)
    return items.withColumns({"authority_score": F.when(known, 0.75).otherwise(0.50), "relevance_score": F.round(F.least(F.lit(1.0), 0.6 + 0.4 * hits / max(1, len(q))), 2)})
