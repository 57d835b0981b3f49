"""Raw coded survey to the tables of questions and respondents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.survey import age, language_profile, voted
from panelforge.functions.text import child_from_parent_question, clean_codebook_text, parent_var, split_child_label
from panelforge.operators.groups import to_long
from panelforge.operators.lookup import add_domain, add_region, codebook_lookup, label_values, override
from panelforge.operators.sampling import stratified_split


def province_counts(df: DataFrame, column: str, code: int | str) -> DataFrame:
    """total, kept and percent: how many rows are of one province."""
    kept, total = F.count_if(F.col(column) == code), F.count(F.lit(1))
    return df.agg(total.alias("total"), kept.alias("kept"), F.coalesce(100.0 * kept / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("percent"))


def keep_province(df: DataFrame, column: str, code: int | str) -> tuple[DataFrame, dict]:
    """Rows of one province, and how many of all they are."""
    return df.where(F.col(column) == code), province_counts(df, column, code).first().asDict()


def thematic_domains(domains: DataFrame, labels: DataFrame) -> DataFrame:
    """variable_name, label, domain of every classified variable; the label is "" if the survey lacks the variable.

    domains: variable_name, domain. labels: variable_name, label.
    """
    known = labels.select("variable_name", "label").dropDuplicates(["variable_name"])
    return domains.select("variable_name", "domain").join(known, "variable_name", "left").withColumn("label", F.coalesce("label", F.lit("")))


def domain_counts(built: DataFrame) -> DataFrame:
    """domain, n: variables per domain, and of all of them under TOTAL."""
    rows = built.rollup("domain").agg(F.count(F.lit(1)).alias("n"), F.grouping("domain").alias("g"))
    return rows.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("domain")).alias("domain"), "n")


def chosen_variables(columns: list[str], profile: list[str], classified: list[str]) -> list[str]:
    """Profile variables first, then the classified ones in their order; only those present, each once."""
    return [v for v in dict.fromkeys([*profile, *classified]) if v in set(columns)]


def prepare_respondents(
    raw: DataFrame, variables: list[str], value_labels: DataFrame, regions: DataFrame, key: str = "respondent_id",
    names: dict[str, str] | None = None, english: str = "cps21_language_1", french: str = "cps21_language_2",
    others: list[str] | None = None, interface: str = "UserLanguage", riding: str = "fedname", test_share: float = 0.2, seed: int = 42,
) -> DataFrame:
    """One row per respondent: labelled answers, age, language, riding, voted_2019, language and split columns.

    names renames profile variables, such as {"cps21_yob": "age"}; the birth year, first language flag and
    2019 vote are derived. Codes are labelled in long form, with one join for all variables.
    """
    names = {"cps21_yob": "age", "cps21_language_1": "language", "cps21_vote_2019": "voted_2019"} | (names or {})
    derived = {"cps21_yob", english}
    labelled = [v for v in variables if v not in derived]
    base = raw.select(
        key, F.coalesce(F.col(interface).cast("string"), F.lit("EN")).alias("survey_language"), F.col(riding).alias("_riding"),
        age(F.col("cps21_yob").cast("string")).alias("age"),
        language_profile(F.col(english), F.col(french), [F.col(c) for c in others or []], F.col(interface)).alias("language"),
    )
    base = add_region(base, regions, "_riding").drop("_riding")
    codes = raw.select(key, *[F.col(v).cast("double").alias(v) for v in labelled]).unpivot(key, labelled, "variable", "code")
    wide = label_values(codes, value_labels).groupBy(key).pivot("variable", labelled).agg(F.max("value"))
    out = base.join(wide, key)
    for v in labelled:
        if v in names:
            value = voted(F.col(v)) if names[v] == "voted_2019" else F.col(v)
            out = out.withColumn(names[v], value).drop(v)
    stratum = F.when(F.col("language") == "French", "FR").otherwise("non-FR")
    return stratified_split(out.withColumn("_s", stratum), "_s", [key], test_share, seed, "respondent_split").drop("_s")


def prepare_questions(
    variables: DataFrame, value_labels: DataFrame, codebook_en: DataFrame, codebook_fr: DataFrame, domains: DataFrame,
    parent_labels: DataFrame, child_labels: DataFrame, options_fr: DataFrame, overrides: DataFrame,
    test: list[str], drop: list[str], names: dict[str, str] | None = None,
) -> DataFrame:
    """The table of questions from variable labels, codebooks and hand-made tables, all given as DataFrames.

    variables: variable_name, label. value_labels: variable, code, label. Codebooks: variable, label,
    question, options. parent_labels: parent_var, en, fr; child_labels and overrides: variable_name, en, fr;
    options_fr: parent_var, options. Own codebook entries come before those of the parent. A variable with
    a number at its end is a child: its label is `parent - child`, and French options hold only if the
    entry is its own. Options without a codebook entry are the value labels as `code: label`.
    """
    listed = value_labels.groupBy(F.col("variable").alias("variable_name")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("code", "label"))),
            lambda x: F.concat(F.regexp_replace(x["code"].cast("string"), r"\.0$", ""), F.lit(": "), x["label"]),
        ).alias("_listed")
    )
    en = codebook_lookup(variables.select("variable_name"), codebook_en).select(
        "variable_name", F.when(F.col("exact"), F.col("question")).alias("_q"), F.col("question").alias("_q_any"),
        F.when(F.col("exact"), F.col("options")).otherwise(F.array().cast("array<string>")).alias("_o"),
    )
    fr = codebook_lookup(variables.select("variable_name"), codebook_fr).select(
        "variable_name", F.col("label").alias("_lf"), F.col("question").alias("_qf"), F.col("options").alias("_of"), F.col("exact").alias("_exact"),
    )
    above = codebook_fr.select(F.col("variable").alias("parent_var"), F.col("question").alias("_qf_parent"))
    rows = (
        variables.join(en, "variable_name").join(fr, "variable_name").join(listed, "variable_name", "left")
        .withColumn("parent_var", parent_var(F.col("variable_name")))
        .join(above, "parent_var", "left")
        .join(parent_labels.select("parent_var", F.col("en").alias("_pe"), F.col("fr").alias("_pf")), "parent_var", "left")
        .join(child_labels.select("variable_name", F.col("en").alias("_ce"), F.col("fr").alias("_cf")), "variable_name", "left")
        .join(options_fr.select("parent_var", F.col("options").alias("_manual")), "parent_var", "left")
    )
    label, label_fr = clean_codebook_text(F.col("label")), clean_codebook_text(F.col("_lf"))
    child = F.col("variable_name").rlike("_+[0-9]+$")
    pe, ce = split_child_label(label)
    pf, cf = split_child_label(label_fr)
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    pe, pf = F.coalesce(some("_pe"), pe), F.coalesce(some("_pf"), pf)
    ce = F.coalesce(some("_ce"), ce, child_from_parent_question(F.col("_q_any"), F.col("variable_name")))
    cf = F.coalesce(some("_cf"), cf, child_from_parent_question(F.col("_qf_parent"), F.col("variable_name")))

    def full(parent, item, plain):
        return F.when(child & (parent != "") & item.isNotNull(), F.concat(parent, F.lit(" - "), item)).otherwise(plain)

    empty = F.array().cast("array<string>")
    own_fr = F.when(child & ~F.col("_exact"), empty).otherwise(F.col("_of"))
    fr_options = F.when(child & (F.size(own_fr) == 0), F.coalesce("_manual", empty)).otherwise(own_fr)
    options = F.when(F.size("_o") > 0, F.col("_o")).otherwise(F.coalesce("_listed", empty))
    stored = lambda a: F.when(F.size(a) > 0, F.to_json(a)).otherwise("")
    columns = F.col("variable_name")
    for old, new in (names or {}).items():
        columns = F.when(F.col("variable_name") == old, new).otherwise(columns)
    made = rows.select(
        "variable_name", columns.alias("column_name"), full(pe, ce, label).alias("label"), clean_codebook_text(F.col("_q")).alias("question"),
        stored(options).alias("options"), full(pf, cf, label_fr).alias("label_fr"), clean_codebook_text(F.col("_qf")).alias("question_fr"),
        stored(fr_options).alias("options_fr"),
    )
    final = override(made, overrides.select("variable_name", F.col("en").alias("label"), F.col("fr").alias("label_fr")), "variable_name", ["label", "label_fr"])
    return add_domain(final, domains, test, drop)


def prune_dropped(respondents: DataFrame, questions: DataFrame, profile: list[str]) -> DataFrame:
    """Respondents without the columns of dropped questions: profile columns and kept ones, in their order."""
    kept = {r["column_name"] for r in questions.where("split <> 'drop'").select("column_name").distinct().collect()}
    return respondents.select(*[c for c in respondents.columns if c in kept or c in profile])


def require_rows(df: DataFrame, what: str = "rows") -> DataFrame:
    """df, if it has any row; else an error."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def split_counts(questions: DataFrame) -> DataFrame:
    """train, test, drop: how many questions each split has, 0 if none."""
    return questions.agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "test", "drop")])


def long_answers(respondents: DataFrame, questions: DataFrame, key: str = "respondent_id") -> DataFrame:
    """answers(key, variable_name, value) for every question whose column the respondents have."""
    present = set(respondents.columns)
    wanted = [r["column_name"] for r in questions.select("column_name").distinct().collect() if r["column_name"] in present]
    return to_long(respondents, key, sorted(wanted))
