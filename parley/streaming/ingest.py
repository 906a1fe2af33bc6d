"""Incremental runs: files as they come, what is pending, and the state of jobs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from parley.operators.segments import valid_records
from parley.sources.records import RECORD
from parley.sources.sinks import merged

STATE = "job_name string, status string, processed bigint, failed bigint, last_id string, updated_at timestamp"


def ingest_new_files(spark: SparkSession, inbox: str, out: str, state: str) -> None:
    """Validate the records of files not read yet (JSON lines in `inbox`) and add them under `out`.

    Good records go to out/valid, once each by id over all runs: ids that are there are left out. Broken ones, and lines
    that are no record, go to out/quarantine with their error; out/processed logs the ids of each batch. Each batch
    writes partitions of its own number in place of what it wrote before, so a batch that is tried again adds nothing.
    The stream's state in `state` makes a second run over the same files add nothing.
    """
    kept = StructType([*RECORD.fields, StructField("_corrupt_record", StringType())])

    def there(name: str, batch: int) -> DataFrame | None:
        """The ids that other batches have written."""
        path = f"{out}/{name}"
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
            return None
        return spark.read.parquet(path).where(F.col("batch") != batch).select("transcript_id")

    def put(batch: DataFrame, number: int) -> None:
        checked = valid_records(batch.withColumn("record_no", F.lit(0))).drop("record_no")
        broken = F.col("_corrupt_record").isNotNull()
        checked = checked.withColumn("error", F.when(broken, "malformed line").otherwise(F.col("error"))).withColumn("batch", F.lit(number)).persist()
        good = checked.where("error is null").drop("error", "_corrupt_record").dropDuplicates(["transcript_id"])
        old = there("valid", number)
        good = good if old is None else good.join(old, "transcript_id", "left_anti")
        for name, rows in (("valid", good), ("quarantine", checked.where("error is not null")), ("processed", checked.where("error is null").select("transcript_id", "batch").distinct())):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")
        checked.unpersist()

    stream = spark.readStream.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(inbox)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def event_windows(spark: SparkSession, folder: str, out: str, state: str, width: str = "1 day", late: str = "7 days", pattern: str = "events*.parquet", close: bool = False) -> DataFrame:
    """kind, start, n, total of the events by kind and window, from a stream over the events' files.

    Windows are written once, when the watermark has passed them: what comes more than `late` behind the latest event
    finds its window closed and is dropped, and the state holds open windows only. A run takes the files that are
    there. With `close` the run's open windows are written too, beside the state: for a stream that has come to its end.
    """
    files = spark.read.option("pathGlobFilter", pattern).parquet(folder)
    events = spark.readStream.schema(files.schema).option("pathGlobFilter", pattern).parquet(folder)

    def counted(df: DataFrame) -> DataFrame:
        g = df.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        return g.select(F.col("event_type").alias("kind"), F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")

    timed = lambda df: df.withColumn("at", F.col("ts").cast("timestamp"))
    flat = counted(timed(events).withWatermark("at", late))
    q = flat.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    closed = spark.read.schema(flat.schema).parquet(out)
    if not close:
        return closed
    # Open are the windows that end after the watermark: those that no batch has written.
    rest = counted(timed(files)).join(closed.select("kind", "start"), ["kind", "start"], "left_anti")
    return closed.unionByName(rest)


def pending(everything: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done. What gave no result counts as done if it is logged there."""
    return everything.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def put_state(state: DataFrame, job: str, status: str, processed: int, failed: int = 0, last_id: str | None = None) -> DataFrame:
    """`state` with the row of a job added or replaced."""
    row = (job, status, processed, failed, last_id, datetime.now(timezone.utc).replace(tzinfo=None))
    return merged(state, state.sparkSession.createDataFrame([row], STATE), ["job_name"])


def get_state(state: DataFrame, job: str) -> dict | None:
    row = state.where(F.col("job_name") == job).first()
    return row.asDict() if row else None


def reset_state(state: DataFrame, job: str) -> DataFrame:
    return state.where(F.col("job_name") != job)


def isolated(rows: DataFrame, ok: F.Column, reason: F.Column) -> tuple[DataFrame, DataFrame]:
    """Rows that can be worked on, and the others with the reason: one bad row never stops a run."""
    good = F.coalesce(ok, F.lit(False))
    return rows.where(good), rows.where(~good).withColumn("error", reason)


def resources() -> dict[str, float]:
    """Peak memory in MB and CPU seconds of the driver's process and the children it has waited for."""
    import resource

    own, children = resource.getrusage(resource.RUSAGE_SELF), resource.getrusage(resource.RUSAGE_CHILDREN)
    return {"peak_mb": max(own.ru_maxrss, children.ru_maxrss) / 1024, "cpu_seconds": own.ru_utime + own.ru_stime + children.ru_utime + children.ru_stime}


def same_counts(before: dict[str, int], after: dict[str, int]) -> dict[str, int]:
    """The tables whose number of rows a repeated run changed, with the difference; empty if it was idempotent."""
    return {k: after.get(k, 0) - before.get(k, 0) for k in sorted({*before, *after}) if after.get(k, 0) != before.get(k, 0)}
