"""Calls into segments, segments into sentences, and questions matched to answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import lexicons as lx
from parley.functions.text import quarter_label, section_label, speaker_role, split_sentences, strip


def valid_records(records: DataFrame) -> DataFrame:
    """`records` with quarter_norm, transcript_id and error: the first rule that a raw record breaks, or null.

    Needs symbol, date, content, structured_content, year and quarter; rules are tried in this order.
    """
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    year = F.col("year").cast("string")
    error = (
        F.when(missing("symbol"), "missing symbol")
        .when(missing("date"), "missing date")
        .when(missing("content") & (F.coalesce(F.size("structured_content"), F.lit(0)) <= 0), "empty transcript")
        .when(year.isNotNull() & year.try_cast("int").isNull(), "non-integer year")
        .when(~year.try_cast("int").between(1990, 2030), "invalid year")
        .when(~missing("quarter") & quarter_label(F.col("quarter")).isNull(), "invalid quarter")
    )
    filled = lambda c: F.when(c != "", c)
    id_parts = F.concat_ws("_", filled(F.upper(strip(F.col("symbol")))), filled(year), F.coalesce(quarter_label(F.col("quarter")), filled(F.upper("quarter"))), filled(F.col("date")))
    return records.withColumns({"quarter_norm": quarter_label(F.col("quarter")), "transcript_id": id_parts, "error": error})


def ingest_status(records: DataFrame, existing: DataFrame) -> DataFrame:
    """transcript_id and status (invalid, skipped_duplicate, ok) of raw records against ids that are there already.

    Of several valid records of one id the first by record_no is ok, the others are duplicates.
    """
    checked = valid_records(records)
    w = Window.partitionBy("transcript_id").orderBy("record_no")
    known = existing.select("transcript_id").distinct().withColumn("_there", F.lit(True))
    joined = checked.join(known, "transcript_id", "left").withColumn("_nth", F.row_number().over(w))
    status = F.when(F.col("_there") | (F.col("_nth") > 1), "skipped_duplicate").when(F.col("error").isNotNull(), "invalid").otherwise("ok")
    return joined.select("transcript_id", "record_no", status.alias("status"), "error")


def structured_segments(records: DataFrame, *, key: str, structured: str) -> DataFrame:
    """key, sequence (place in the array, blank pieces leave gaps), segment_id, speaker, speaker_role, section, text."""
    pieces = records.select(F.col(key), F.posexplode(structured).alias("sequence", "p"))
    text = strip(F.col("p.text"))
    return pieces.where(text != "").select(
        key, "sequence", F.format_string("%s_seg_%04d", F.col(key).cast("string"), F.col("sequence")).alias("segment_id"),
        F.coalesce(F.when(strip(F.col("p.speaker")) != "", F.col("p.speaker")), F.lit("Unknown")).alias("speaker"),
        speaker_role(F.col("p.speaker"), F.col("p.role")).alias("speaker_role"), F.col("p.section").alias("section"), text.alias("text"),
    )


_CUT = "\x1e"


def raw_segments(records: DataFrame, *, key: str, content: str) -> DataFrame:
    """The same of plain text with `Speaker: text` lines; text before the first label is left out.

    A text without a label is one segment of speaker Unknown.
    """
    c = F.col(content)
    labelled = c.rlike(lx.SPEAKER_LABEL)
    parts = F.split(F.regexp_replace(c, lx.SPEAKER_LABEL, f"{_CUT}$1\x1f"), _CUT)
    pieces = F.when(labelled, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(F.array(F.concat(F.lit("Unknown\x1f"), c)))
    rows = records.where(strip(c) != "").select(key, F.posexplode(pieces).alias("_at", "_p"))
    split = rows.select(key, "_at", F.split("_p", "\x1f").alias("s")).select(key, "_at", strip(F.col("s")[0]).alias("speaker"), strip(F.get("s", F.lit(1))).alias("text")).where("text <> ''")
    seq = F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1
    out = split.withColumn("sequence", seq)
    return out.select(key, "sequence", F.format_string("%s_seg_%04d", F.col(key).cast("string"), F.col("sequence")).alias("segment_id"), "speaker", speaker_role(F.col("speaker"), F.lit(None).cast("string")).alias("speaker_role"), F.lit(None).cast("string").alias("section"), "text")


def call_segments(records: DataFrame, *, key: str, structured: str, content: str) -> DataFrame:
    """Segments from the structured pieces where a record has any that say something, else from its plain text."""
    spoken = F.exists(structured, lambda x: strip(x["text"]) != "")
    use = F.coalesce(spoken, F.lit(False))
    return structured_segments(records.where(use), key=key, structured=structured).unionByName(raw_segments(records.where(~use), key=key, content=content))


def with_sections(segments: DataFrame, *, key: str) -> DataFrame:
    """`segments` with `section` made canonical, or told by what operator and speakers say.

    A call with any label but unknown keeps its labels, and a segment without label has that of the one before. Else
    the section follows from the course of the call: an operator's cue for questions opens q_and_a, which lasts until
    the operator's thanks; a welcome opens the call. The fold runs over one call at a time.
    """
    label = section_label(F.col("section"))
    given = F.col("section").isNotNull() & (strip(F.col("section")) != "")
    low = F.lower("text")
    op = F.lower(strip(F.col("speaker"))).isin("operator", "moderator")
    event = (
        F.when(~op, "talk")
        .when(F.col("text").rlike("(?i)" + lx.QUESTION_CUE), "questions")
        .when(low.contains("welcome") | low.contains("good morning"), "welcome")
        .when(low.contains("thank you"), "thanks")
        .otherwise("bridge")
    )
    item = F.struct("sequence", F.when(given, label).alias("label"), event.alias("event"), *[F.col(c) for c in segments.columns if c not in (key, "sequence", "section")])
    calls = segments.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"), F.max(given & (label != "unknown")).alias("explicit"))

    def step(acc, x):
        last = F.coalesce(F.try_element_at(acc, F.lit(-1))["section"], F.lit("unknown"))
        told = (
            F.when(x["event"] == "questions", "q_and_a")
            .when(x["event"] == "welcome", "opening")
            .when((x["event"] == "thanks") & (last == "q_and_a"), "closing")
            .when(last == "q_and_a", "q_and_a")
            .when(x["event"] != "talk", F.when(last == "unknown", "opening").otherwise(last))
            .when(last.isin("opening", "unknown"), "prepared_remarks")
            .otherwise(last)
        )
        section = F.when(F.col("explicit"), F.coalesce(x["label"], last)).otherwise(told)
        return F.concat(acc, F.array(F.struct(x["sequence"].alias("sequence"), section.alias("section"))))

    empty = F.array().cast("array<struct<sequence:int,section:string>>")
    folded = calls.select(key, F.explode(F.zip_with("items", F.aggregate("items", empty, step), lambda i, s: F.struct(i.alias("i"), s["section"].alias("section")))).alias("z"))
    return folded.select(key, "z.i.sequence", F.col("z.section").alias("section"), *[F.col(f"z.i.{c}") for c in segments.columns if c not in (key, "sequence", "section")])


def sentence_rows(segments: DataFrame, *, key: str, text: str) -> DataFrame:
    """`key`, sentence_number (from 0) and sentence of every segment; blank texts have no row."""
    return segments.select(key, F.posexplode(split_sentences(F.col(text))).alias("sentence_number", "sentence"))


#: Characters that a question and an answer must have at least.
LEAST = 20


def match_questions(segments: DataFrame) -> DataFrame:
    """qa_id, transcript_id, first segments, speakers and joined texts of each question with its answer.

    Within q_and_a an analyst, or an unknown speaker while no answer runs, asks; an executive, or an unknown speaker
    while one runs, answers; an operator ends a running answer. Blank segments are passed over. The state is folded
    over one call's segments in their order; a call is the largest group.
    """
    talk = segments.where((F.col("section") == "q_and_a") & (strip(F.col("text")) != ""))
    item = F.struct("sequence", "segment_id", F.coalesce("speaker_role", F.lit("unknown")).alias("role"), "speaker", strip(F.col("text")).alias("text"))
    calls = talk.groupBy("transcript_id").agg(F.array_sort(F.collect_set(item)).alias("items"))

    def step(acc, x):
        state, role = acc["state"], x["role"]
        asks = role.isin("analyst") | ((role == "unknown") & (state != "A"))
        answers = (role == "executive") | ((role == "unknown") & (state == "A"))
        # W: waiting, Q: in a question, A: in an answer.
        new = F.when((role == "operator") & (state == "A"), "W").when(role == "operator", state).when(asks, "Q").when(answers & (state != "W"), "A").otherwise(state)
        pair = acc["pair"] + F.when((new == "Q") & (state != "Q"), 1).otherwise(0)
        part = F.when((role != "operator") & (new != "W"), new)
        return F.struct(new.alias("state"), pair.alias("pair"), F.concat(acc["out"], F.array(F.struct(pair.alias("pair"), part.alias("part")))).alias("out"))

    start = F.struct(F.lit("W").alias("state"), F.lit(0).alias("pair"), F.array().cast("array<struct<pair:int,part:string>>").alias("out"))
    tagged = calls.select("transcript_id", F.explode(F.zip_with("items", F.aggregate("items", start, step, lambda a: a["out"]), lambda i, s: F.struct(i.alias("i"), s.alias("s")))).alias("z"))
    rows = tagged.select("transcript_id", "z.s.pair", "z.s.part", "z.i.*").where("part is not null")

    def side(p: str, name: str) -> list:
        of = F.when(F.col("part") == p, F.struct("sequence", "segment_id", "speaker", "text"))
        return [F.array_sort(F.collect_list(of)).alias(name)]

    pairs = rows.groupBy("transcript_id", "pair").agg(*side("Q", "q"), *side("A", "a"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), " ")
    full = pairs.withColumns({"question_text": joined("q"), "answer_text": joined("a")}).where((F.length("question_text") >= LEAST) & (F.length("answer_text") >= LEAST))
    n = F.row_number().over(Window.partitionBy("transcript_id").orderBy("pair")) - 1
    return full.withColumn("sequence", n).select(
        F.format_string("%s_qa_%03d", "transcript_id", "sequence").alias("qa_id"), "transcript_id", F.col("q")[0]["segment_id"].alias("question_segment_id"), F.col("a")[0]["segment_id"].alias("answer_segment_id"),
        F.col("q")[0]["speaker"].alias("analyst_speaker"), F.col("a")[0]["speaker"].alias("executive_speaker"), "question_text", "answer_text", "sequence",
    )
