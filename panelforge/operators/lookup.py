"""Lookup joins: value labels, regions, codebook entries, overrides, domains and value translation.

A lookup table is broadcast only if a count shows that it is small; otherwise the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.options import option_pairs, options_list
from panelforge.functions.survey import riding, split_of
from panelforge.functions.text import parent_var, strip
from panelforge.session import broadcast_if_small

#: Profile answers whose French wording is not in any option list.
FR_VALUES = {"yes": "oui", "no": "non", "French": "Francais", "English": "Anglais", "Other": "Autre"}


def label_values(answers: DataFrame, labels: DataFrame, normalise: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """answers(…, variable, code) with value: the code's label, else the code as text (`nan` for NULL).

    normalise: per variable, the wording to use for a label, looked up without case.
    """
    value = F.col("label")
    for variable, words in (normalise or {}).items():
        for old, new in words.items():
            hit = (F.col("variable") == variable) & (F.lower("label") == old.lower())
            value = F.when(hit, new).otherwise(value)
    known = broadcast_if_small(labels.select("variable", "code", "label"))
    return (
        answers.join(known, ["variable", "code"], "left")
        .withColumn("value", F.coalesce(value, F.col("code").cast("string"), F.lit("nan")))
        .drop("label")
    )


def add_region(df: DataFrame, regions: DataFrame, name: str, alias: str = "riding") -> DataFrame:
    """df with `name (region)`; regions has the columns name and region."""
    known = broadcast_if_small(regions.select(F.col("name").alias("_name"), "region"))
    joined = df.join(known, strip(F.col(name)) == F.col("_name"), "left")
    return joined.withColumn(alias, riding(F.col(name), F.col("region"))).drop("_name", "region")


def codebook_lookup(variables: DataFrame, codebook: DataFrame) -> DataFrame:
    """variables(variable_name) with the codebook's label, question and options, own entry or parent's.

    codebook: variable, label, question, options (array). exact tells whether the entry is the variable's own.
    """
    entry = F.struct("label", "question", "options")
    own = codebook.select(F.col("variable").alias("variable_name"), entry.alias("own"))
    parent = codebook.select(F.col("variable").alias("_parent"), entry.alias("above"))
    found = F.coalesce("own", "above")
    return (
        variables.withColumn("_parent", parent_var(F.col("variable_name")))
        .join(broadcast_if_small(own), "variable_name", "left")
        .join(broadcast_if_small(parent), "_parent", "left")
        .select(
            *variables.columns, found["label"].alias("label"), found["question"].alias("question"),
            F.coalesce(found["options"], F.array().cast("array<string>")).alias("options"), F.col("own").isNotNull().alias("exact"),
        )
    )


def override(df: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df in which the named columns take the non-empty values of overrides, matched by key."""
    new = overrides.select(key, *[F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in columns])
    joined = df.join(broadcast_if_small(new), key, "left")
    picked = [F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns]
    return joined.select(*picked)


def add_domain(df: DataFrame, domains: DataFrame, test: list[str], drop: list[str]) -> DataFrame:
    """df(variable_name) with thematic_domain and split; unclassified variables have no domain and are dropped."""
    known = broadcast_if_small(domains.select("variable_name", F.col("domain").alias("thematic_domain")))
    return df.join(known, "variable_name", "left").withColumn("split", split_of(F.col("thematic_domain"), test, drop))


def value_map(questions: DataFrame, mode: str = "code_then_position") -> DataFrame:
    """value, value_fr: the French wording of each English answer label.

    code: pairs options of one question by code, the first question by name wins. position: pairs lists of
    equal length place by place, the last question by name and place wins. code_then_position: by code, or
    by position where a list has no codes; the first question wins. Many questions share their lists, so equal
    lists are read once, for the question of them that can win. Lists are paired inside their row, without a
    join; one aggregate by label keeps the winner.
    """
    if mode not in ("code", "position", "code_then_position"):
        raise ValueError(f"unknown mode {mode!r}")
    en, fr = option_pairs(F.col("options")), option_pairs(F.col("options_fr"))
    winner = F.max if mode == "position" else F.min
    shared = (
        questions.where("variable_name is not null and options is not null and options_fr is not null")
        .groupBy("options", "options_fr").agg(winner("variable_name").alias("variable_name"))
    )
    rows = shared.select(
        "variable_name", en.alias("en"), fr.alias("fr"), options_list(F.col("options")).alias("le"),
        options_list(F.col("options_fr")).alias("lf"),
    )

    def last(pairs: Column, code: Column) -> Column:
        return F.element_at(F.filter(pairs, lambda x: x["code"] == code), -1)["label"]

    def is_last(x: Column) -> Column:
        return ~F.exists("en", lambda y: (y["code"] == x["code"]) & (y["pos"] > x["pos"]))

    by_code = F.transform(
        F.filter("en", lambda x: is_last(x) & F.exists("fr", lambda y: y["code"] == x["code"])),
        lambda x: F.struct(x["pos"].alias("pos"), x["label"].alias("value"), last(F.col("fr"), x["code"]).alias("value_fr")),
    )
    same = F.size("le") == F.size("lf")
    by_place = F.transform(
        F.when(same, F.arrays_zip("le", "lf")),
        lambda x, i: F.struct(i.cast("bigint").alias("pos"), x["le"].alias("value"), x["lf"].alias("value_fr")),
    )
    coded = (F.size("en") > 0) & (F.size("fr") > 0)
    pairs = {"code": by_code, "position": by_place, "code_then_position": F.when(coded, by_code).otherwise(by_place)}[mode]
    flat = rows.select("variable_name", F.explode(pairs).alias("x")).select("variable_name", "x.*").where("value_fr <> ''")
    pick = F.max_by if mode == "position" else F.min_by
    return flat.groupBy("value").agg(pick("value_fr", F.struct("variable_name", "pos")).alias("value_fr"))


def localise(df: DataFrame, column: str, french: Column, values: DataFrame, alias: str | None = None) -> DataFrame:
    """df with the answer in the respondent's language: fixed wordings first, then the value map, else as is."""
    fixed = F.create_map(*[F.lit(x) for pair in FR_VALUES.items() for x in pair])
    known = broadcast_if_small(values.select(F.col("value").alias("_v"), F.col("value_fr").alias("_vf")))
    words = F.coalesce(F.try_element_at(fixed, F.col(column)), F.col("_vf"), F.col(column))
    joined = df.join(known, F.col(column) == F.col("_v"), "left")
    return joined.withColumn(alias or column, F.when(french, words).otherwise(F.col(column))).drop("_v", "_vf")
