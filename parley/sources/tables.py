"""Reading tables and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table in at least as many partitions as there are cores; one that has them is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's, or the one that spark.checkpoint.dir names.

    Where none is named a session of one machine (master local) has a folder of its own there; any other is an error,
    since a machine's folder doesn't survive its loss.
    """
    sc = spark.sparkContext
    where = sc._jsc.sc().getCheckpointDir()
    if where.isDefined():
        return where.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="parley-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
