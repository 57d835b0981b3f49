"""What is written by the sinks and read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelforge.functions.options import options_list
from panelforge.plans import sqltext as S
from panelforge.plans.registry import query
from panelforge.session import ensure_checkpoint_dir, read_table
from panelforge.sources import io


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"


@query("examples_written", "select label as input, question as output from questions where label is not null and question is not null")
def examples_written(spark, d):
    rows = read_table(spark, d, "questions").select(F.col("label").alias("input"), F.col("question").alias("output")).where("input is not null and output is not null")
    path = _folder(spark)
    io.write_examples(rows, path)
    return io.read_examples(spark, path)


@query("checkpoint_written", "select question, sample_idx, simulated_response from condition1_samples")
def checkpoint_written(spark, d):
    """A checkpoint that is appended to twice."""
    rows, path = read_table(spark, d, "condition1_samples").select("question", "sample_idx", "simulated_response"), _folder(spark)
    for part in (0, 1):
        io.append_checkpoint(rows.where(F.col("sample_idx") % 2 == part), path)
    return io.read_checkpoint(spark, path, "question string, sample_idx bigint, simulated_response string")


@query("domains_written", "select variable_name, label, thematic_domain as domain from questions where thematic_domain is not null")
def domains_written(spark, d):
    rows = read_table(spark, d, "questions").where("thematic_domain is not null").select("variable_name", "label", F.col("thematic_domain").alias("domain"))
    path = f"{_folder(spark)}/domains.json"
    io.write_domains(rows, path)
    return io.read_domains(spark, path)


@query(
    "codebook_written",
    f"""select 'CPS' as section, variable_name as variable, coalesce(label, '') as label, coalesce(question, '') as question,
    array_to_string({S.options('options')}, '|') as options from questions""",
)
def codebook_written(spark, d):
    """A codebook of JSON lines, as the extraction writes it."""
    entry = F.struct(
        F.lit("CPS").alias("section"), F.col("variable_name").alias("variable"), F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce("question", F.lit("")).alias("question"), F.coalesce(options_list(F.col("options")), F.array().cast("array<string>")).alias("options"),
    )
    path = _folder(spark)
    read_table(spark, d, "questions").select(F.to_json(entry)).write.text(path)
    return io.read_codebook(spark, path).select("section", "variable", "label", "question", F.array_join("options", "|").alias("options"))


@query("tables_written", "select variable_name, label, question, split from questions where split = 'test'")
def tables_written(spark, d):
    """Parquet written over an older output."""
    rows, path = read_table(spark, d, "questions").select("variable_name", "label", "question", "split"), f"{_folder(spark)}.parquet"
    io.write_table(rows, path)
    io.write_table(rows.where("split = 'test'"), path, force=True)
    return spark.read.parquet(path)
