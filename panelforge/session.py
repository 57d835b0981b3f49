"""Session helpers: tables, checkpoints, partition counts and size checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side that the optimiser's estimate puts below so many bytes may be broadcast.
BROADCAST_BYTES = 8 << 20
#: Whether an action removes the shuffle files of its plan when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; without one only a local master gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    The shuffle files of its plan are removed at once: nothing reads them again, and else they stay on disk
    until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting when it is made
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the size of df, from file sizes; no job runs. Joins are estimated too high."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimate is small; else as it is, and adaptive execution decides by real sizes."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for steps that cost much per row.

    Only inputs of few files are shuffled; a large table has more splits than cores. A plan that shuffles
    anyway stays as it is: asking for its partitions would run its stages.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(step in plan for step in ("Join ", "Aggregate ", "Window ", "Repartition", "Sort ")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, those with the lowest hash of key, the same at every run.

    Rows far above the cut are dropped where they are read, by the share of n in the count, so about 4 n
    rows reach the sort, however many tasks there are.
    """
    total = df.count()
    h = F.xxhash64(key)
    if total > 4 * n:
        share = -(-4 * n * (1 << 40) // total)
        df = df.where(F.pmod(h, F.lit(1 << 40)) < F.lit(share))
        h = F.pmod(h, F.lit(1 << 40))
    return df.orderBy(h, key).limit(n)
