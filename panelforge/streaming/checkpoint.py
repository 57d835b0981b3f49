"""Extension: simulated answers as a stream, merged into a result table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.dedup import keep_last


def latest_by_key(
    spark: SparkSession, source: str, schema, target: str, state: str, key: list[str], order: list[str], files_per_batch: int = 1
) -> DataFrame:
    """The last row per key of a stream of parquet files, brought up to date with all files that are there.

    Every micro-batch is reduced to its last row per key and written to a folder of its own number, so a
    batch that is repeated after a failure overwrites itself; reading merges the folders by the same rule.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        keep_last(batch, key, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    run = stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return keep_last(spark.read.parquet(target).drop("batch"), key, order)


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind; on a stream, windows close once the watermark has passed."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, window), by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), by, "n")
    )
