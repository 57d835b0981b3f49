"""Extension: answer distributions, their distance, and performance by semantic distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distribution(answers: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, share: how often each value occurs within each group. Two map-side combined aggregates."""
    group = [*by, "_all"]
    counts = answers.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(1))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group]
    joined = counts.alias("l").join(totals.alias("r"), on)
    return joined.select(*[F.col(f"l.{c}") for c in (*by, value)], F.col("l.n"), (F.col("l.n") / F.col("r.total")).alias("share"))


def total_variation(a: DataFrame, b: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, tv: half the sum of the differences of two distributions, for groups that both have."""
    left, right = distribution(a, by, value), distribution(b, by, value)
    both = left.select(*by).distinct().join(right.select(*by).distinct(), by)
    signed = left.select(*by, value, "share").unionByName(right.select(*by, value, (-F.col("share")).alias("share")))
    gaps = signed.join(both, by).groupBy(*by, value).agg(F.abs(F.sum("share")).alias("gap"))
    return gaps.groupBy(*by).agg((F.sum("gap") / 2).alias("tv"))


def by_similarity(scores: DataFrame, index: DataFrame, key: str, score: str, bins: int = 10) -> DataFrame:
    """bin, n, mean: a score of target questions by the similarity of their nearest candidate, in bins of equal width."""
    nearest = index.where("neighbor_rank = 1").select(F.col("target_variable_name").alias(key), F.col("cosine_similarity").alias("s"))
    bin_ = F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).cast("bigint")
    return scores.join(nearest, key).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))


def retrieved_context(index: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """respondent_id, target, context: the respondent's own answers to the target's nearest questions, best first."""
    near = index.select(F.col("target_variable_name").alias("target"), "neighbor_rank", F.col("neighbor_variable_name").alias("variable_name"))
    told = answers.join(near, "variable_name").where("variable_name <> target").join(questions.select("variable_name", F.col("label").alias("asked")), "variable_name")
    line = F.concat(F.lit("Q: "), F.coalesce("asked", F.lit("")), F.lit(" R: "), "value")
    rows = told.groupBy("respondent_id", "target").agg(F.array_sort(F.collect_list(F.struct("neighbor_rank", line.alias("line")))).alias("x"))
    return rows.select("respondent_id", "target", F.array_join(F.transform("x", lambda p: p["line"]), "\n").alias("context"))
