"""Top N items within every group, with hot groups split off (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import broadcast_if_small, cut


def top_n_per_group(
    df: DataFrame, group: str, item: str, score: str, n: int = 10, hot_rows: int = 10_000
) -> DataFrame:
    """The n best items of every group: columns group, item, score and rank (bigint, from 1).

    Exact row counts tell hot groups (over hot_rows rows) from cold ones. Cold groups go through one
    ordinary window. A hot group is cut by a hash of the item into salts of about hot_rows rows, range
    partitioned and sorted by group and salt; each salt keeps its n best and a second window ranks
    what is left, so no task ever sorts a whole hot group. Both parts are united.

    An item counts once per group, with its highest score. Ties go to the smaller item (by bytes).
    Rows with a NULL group, NULL item, or a NULL or NaN score do not count; infinities do. A group of
    fewer than n items keeps them all, one without valid rows does not appear, an empty table gives an
    empty result. Other columns of df are ignored, whatever their names.
    """
    rows = df.select(
        F.col(f"`{group}`").alias("_g"),
        F.col(f"`{item}`").alias("_i"),
        (F.col(f"`{score}`").cast("double") + F.lit(0.0)).alias("_s"),
    ).where("_g is not null and _i is not null and _s is not null and not isnan(_s)")
    hot = cut(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows))
    hot = broadcast_if_small(hot)
    best = rows.groupBy("_g", "_i").agg(F.max("_s").alias("_s"))

    order = (F.col("_s").desc(), F.col("_i").asc())
    by_group = Window.partitionBy("_g").orderBy(*order)
    cold = best.join(hot, "_g", "left_anti").withColumn("_r", F.row_number().over(by_group)).where(F.col("_r") <= n)

    salted = best.join(hot, "_g").select(
        "_g", "_i", "_s", F.pmod(F.xxhash64("_i"), F.ceil(F.col("_n") / hot_rows).cast("bigint")).alias("_salt")
    )
    by_salt = Window.partitionBy("_g", "_salt").orderBy(*order)
    kept = (
        salted.repartitionByRange("_g", "_salt")
        .withColumn("_r", F.row_number().over(by_salt))
        .where(F.col("_r") <= n)
        .drop("_r", "_salt")
    )
    hottest = kept.withColumn("_r", F.row_number().over(by_group)).where(F.col("_r") <= n)
    return cold.unionByName(hottest).select(
        F.col("_g").alias(group),
        F.col("_i").alias(item),
        F.col("_s").alias(score),
        F.col("_r").cast("bigint").alias("rank"),
    )
