"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bpe, canonical, components, defects, forest, leaks, overlap, residue, topn
from panelforge.session import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL if there is any."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# -- 1: typed answers to entries of their list


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_to_entries(
        read_table(spark, sf_dir, "condition2_samples"), read_table(spark, sf_dir, "questions")
    )


# -- 2: broken question and response pairs


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("condition1_samples", "condition2_samples")
    return defects.broken_pairs({n: read_table(spark, sf_dir, n) for n in names}, read_table(spark, sf_dir, "questions"))


# -- 3: most similar vectors


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = forest.nearest_vectors(read_table(spark, sf_dir, "questions"), "variable_name", "embedding", 64, 5)
    return near.select(
        F.least("name", "neighbor").alias("variable_name_a"), F.greatest("name", "neighbor").alias("variable_name_b")
    ).distinct()


# -- 4: top N items within every group

TOP_SQL = """
with best as (
  select target_variable_name, neighbor_variable_name, max(cosine_similarity) as s
  from rag_similarity
  where cosine_similarity is not null and not isnan(cosine_similarity)
    and target_variable_name is not null and neighbor_variable_name is not null
    and target_variable_name <> neighbor_variable_name
  group by 1, 2),
ranked as (
  select *, row_number() over (partition by target_variable_name
                               order by s desc, neighbor_variable_name) as r
  from best)
select target_variable_name, cast(r as bigint) as neighbor_rank, neighbor_variable_name
from ranked where r <= 10
"""


@query("p4_found", TOP_SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read_table(spark, sf_dir, "rag_similarity").where("target_variable_name <> neighbor_variable_name")
    top = topn.top_n_per_group(pairs, "target_variable_name", "neighbor_variable_name", "cosine_similarity", 10)
    return top.select("target_variable_name", F.col("rank").alias("neighbor_rank"), "neighbor_variable_name")


# -- 5: splits that keep related records together

RELATED_SQL = r"""
with recursive recs as (
  select distinct variable_name, coalesce(split, '') as split,
    'p:' || lower(regexp_replace(variable_name, '_+[0-9]+$', '')) as parent,
    'd:' || regexp_replace(regexp_replace(lower(thematic_domain), '^\s+|\s+$', '', 'g'), '[\s_-]', '_', 'g') as domain
  from questions where variable_name is not null and (split is null or split <> 'drop')),
links as (select distinct parent as a, coalesce(domain, parent) as b from recs),
edges as (select a, b from links union select b, a from links),
reach(node, root) as (
  select a, a from edges
  union
  select e.b, r.root from reach r join edges e on r.node = e.a),
comp as (select node, min(root) as component from reach group by node),
labelled as (select r.variable_name, r.split, c.component from recs r join comp c on r.parent = c.node)
"""


@query(
    "p5_found",
    RELATED_SQL
    + """, torn as (select component from labelled group by component having count(distinct split) > 1)
select distinct l.variable_name from labelled l join torn using (component)""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.torn_records(components.related_records(read_table(spark, sf_dir, "questions")))


@query(
    "p5_splits",
    RELATED_SQL
    + """, drawn as (
  select variable_name, component,
    cast(('0x' || substring(md5('split|' || component), 1, 8))::bigint as double) / 4294967296.0 as part
  from labelled)
select distinct variable_name, component,
  case when part < 0.8 then 'train' when part < 0.9 then 'validation' else 'test' end as assigned_split
from drawn""",
)
def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = components.assign_splits(components.related_records(read_table(spark, sf_dir, "questions")))
    return records.select("variable_name", "component", "assigned_split").distinct()


# -- 6: same or near-same records across splits


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.overlapping_records(read_table(spark, sf_dir, "questions"))
    return pairs.select(
        F.least("held_name", "corpus_name").alias("variable_name_a"),
        F.greatest("held_name", "corpus_name").alias("variable_name_b"),
    ).distinct()


@query("p6_report")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping records and pairs per split and thematic domain."""
    questions = read_table(spark, sf_dir, "questions")
    pairs = overlap.overlapping_records(questions)
    sides = pairs.select(F.col("held_name").alias("variable_name"), F.lit("test").alias("split")).unionByName(
        pairs.select(F.col("corpus_name").alias("variable_name"), F.lit("train").alias("split"))
    )
    domain = components.canonical_domain(F.col("thematic_domain")).alias("domain")
    return (
        sides.join(questions.select("variable_name", domain).distinct(), "variable_name")
        .groupBy("split", "domain")
        .agg(F.countDistinct("variable_name").alias("records"), F.count(F.lit(1)).alias("pairs"))
    )


# -- 7: token ids of the corpus


@query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"))


# -- 8: evaluation texts leaking into the corpus


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "heldout_items"))


# -- 9: template residue and error pages


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.with_residue(read_table(spark, sf_dir, "documents"))
