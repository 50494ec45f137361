"""Sessions, tables and checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "tomar") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TOMAR_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, written to the folder that all executors share.

    The folder is the one named in spark.checkpoint.dir. Only where that is unset, as in tests on one
    machine, a folder of this machine is used.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tomar-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, rows: int = 500_000, megabytes: int = 64) -> DataFrame:
    """df with a broadcast hint if it is small, else as it is, for a join by shuffle. df should be cheap to run.

    Small is a bound on rows and on bytes: the rows are counted up to the bound, their bytes taken from a text of each row.
    """
    size = F.sum(F.length(F.to_json(F.struct("*")))).alias("size")
    n, size_ = df.limit(rows + 1).agg(F.count("*").alias("n"), size).first()
    return F.broadcast(df) if n <= rows and (size_ or 0) <= megabytes << 20 else df


def spread(df: DataFrame, megabytes: int = 64) -> DataFrame:
    """A scan of a small table over at least as many partitions as there are cores, for tables that come in few small files.

    Only for a scan with filters and columns chosen, whose partitions and size are known without running anything. A table above
    the bound is read as the files are split (spark.sql.files.maxPartitionBytes) and never shuffled for this.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= n or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > megabytes << 20:
        return df
    return df.repartition(n)
