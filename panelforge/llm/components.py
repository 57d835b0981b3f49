"""Splits that keep related records together (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.text import parent_var
from panelforge.session import cut


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge set."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """Columns node and component (its smallest node) of the undirected graph of edges.

    Alternates large-star and small-star: each vertex hands its neighbours to the smallest vertex it
    knows, until the edge set is a forest of stars. Per round the minimum of each neighbourhood is a
    map-side combined aggregate joined back to the edges; no neighbourhood is ever collected, and
    skewed vertices are left to the adaptive join. Every round is checkpointed. Edges with a NULL end
    are ignored; a self-loop names an isolated node. Raises if max_rounds do not suffice.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    loops = e.where("a = b").select(F.col("a").alias("node"))
    cur = cut(
        e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = _state(cur)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u")
            .join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        cur = cut(small)
        after = _state(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node")).unionByName(loops).distinct().join(found, "node", "left_anti")
    return found.unionByName(roots.select("node", F.col("node").alias("component")))


def canonical_domain(col: Column) -> Column:
    """A thematic domain without case, outer blanks and the choice of blank, `_` or `-`."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), r"(?U)^\s+|\s+$", ""), r"(?U)[\s_-]", "_")


def related_records(questions: DataFrame) -> DataFrame:
    """variable_name, split, parent and component of all records but those of split drop.

    Records are related by parent variable or thematic domain. The graph has one vertex per entity and
    one edge per distinct (parent, domain), so a hot domain is one vertex, not a clique of records.
    A NULL domain relates nothing; a NULL variable_name is left out; a NULL split counts as a split of
    its own named ''.
    """
    rows = (
        questions.where("variable_name is not null and (split is null or split <> 'drop')")
        .select(
            "variable_name",
            F.coalesce("split", F.lit("")).alias("split"),
            F.concat(F.lit("p:"), F.lower(parent_var(F.col("variable_name")))).alias("parent"),
            F.concat(F.lit("d:"), canonical_domain(F.col("thematic_domain"))).alias("domain"),
        )
        .distinct()
    )
    links = rows.select("parent", F.coalesce("domain", "parent").alias("other")).distinct()
    nodes = connected_components(links, "parent", "other")
    named = nodes.where("node like 'p:%'").withColumnRenamed("node", "parent")
    return rows.drop("domain").join(named, "parent")


def assign_splits(records: DataFrame, train: float = 0.8, validation: float = 0.1, seed: str = "split") -> DataFrame:
    """Adds assigned_split: the component's hash, a number in [0, 1), falls into a range per split."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.col("component"))), 1, 8), 16, 10).cast("double")
    part = draw / F.lit(4294967296.0)
    return records.withColumn(
        "assigned_split",
        F.when(part < train, "train").when(part < train + validation, "validation").otherwise("test"),
    )


def torn_records(records: DataFrame) -> DataFrame:
    """variable_name of each record whose component now lies in more than one split.

    Splits are first summed up per parent, so a hot component shuffles one row per parent.
    """
    parents = records.groupBy("parent", "component").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    torn = parents.groupBy("component").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b")
    bad = parents.join(torn.select("component"), "component", "left_semi").select("parent")
    return records.join(bad, "parent", "left_semi").select("variable_name").distinct()
