"""Keep-last deduplication, resume and union of checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by order, then by all columns. An aggregate, so rows combine before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    packed = F.struct(*[F.col(f"`{c}`") for c in (*order, *[r for r in rest if r not in order])])
    last = df.groupBy(*key).agg(F.max(packed).alias("_last"))
    return last.select(*[F.col(f"`{c}`") if c in key else F.col(f"_last.`{c}`").alias(c) for c in df.columns])


def pending(tasks: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Tasks without a row in done. Rows that ended in an error count as done, too."""
    return tasks.join(done.select(*key).distinct(), key, "left_anti")


def merged(checkpoint: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Checkpoint and new rows together, the last of each key; columns that one side lacks are NULL."""
    return keep_last(checkpoint.unionByName(new, allowMissingColumns=True), key, order)
