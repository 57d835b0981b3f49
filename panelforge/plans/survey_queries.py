"""Queries over questions, respondents, lookups, splits and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import survey as V
from panelforge.functions.options import options_list
from panelforge.functions.text import normalize_text
from panelforge.functions.vectors import cosine, embedding, norm
from panelforge.operators import dedup, embedding as encoders, groups, lookup, prepare, sampling, simulate
from panelforge.operators.corpus import parents
from panelforge.operators.similarity import similarity_index
from panelforge.plans import sqltext as S
from panelforge.plans.registry import query
from panelforge.session import read_table


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


# -- similarity

_EMB = """(select cast(vec_id as varchar) as variable_name, case when label in (0, 1) then 'test' else 'train' end as split,
  cast(label as varchar) as domain, cast(embedding as double[]) as v from embeddings)"""


def _embeddings(spark, d):
    return _t(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("variable_name"), F.when(F.col("label").isin(0, 1), "test").otherwise("train").alias("split"),
        F.col("label").cast("string").alias("thematic_domain"), "embedding",
    )


def _topk_sql(source: str, targets: str, candidates: str, k: int, extra: str = "true") -> str:
    return f"""with e as {source},
    p as (select t.variable_name as target_variable_name, t.domain as target_thematic_domain, c.variable_name as neighbor_variable_name,
      c.domain as neighbor_thematic_domain, round(case when list_dot_product(t.v, t.v) = 0 or list_dot_product(c.v, c.v) = 0 then 0.0
        else list_cosine_similarity(t.v, c.v) end, 9) as s
      from e t, e c where t.split = '{targets}' and c.split = '{candidates}' and {extra}),
    r as (select *, row_number() over (partition by target_variable_name order by s desc, neighbor_variable_name) as r from p)
    select target_variable_name, target_thematic_domain, cast(r as bigint) as neighbor_rank, neighbor_variable_name,
      neighbor_thematic_domain, round(s, 6) as cosine_similarity from r where r <= {k}"""


def _shown(index: DataFrame) -> DataFrame:
    return index.select(
        "target_variable_name", "target_thematic_domain", "neighbor_rank", "neighbor_variable_name", "neighbor_thematic_domain",
        F.round("cosine_similarity", 6).alias("cosine_similarity"),
    )


@query("rag_topk", _topk_sql(_EMB, "test", "train", 5))
def rag_topk(spark, d):
    return _shown(similarity_index(_embeddings(spark, d)))


@query("rag_topk_exclude_self", _topk_sql(_EMB, "test", "test", 3, "t.variable_name <> c.variable_name"))
def rag_topk_exclude_self(spark, d):
    return _shown(similarity_index(_embeddings(spark, d), "test", "test", 3))


_QEMB = """(select variable_name, split, thematic_domain as domain, cast(embedding as double[]) as v from questions where len(embedding) = 64)"""


@query("rag_topk_questions", _topk_sql(_QEMB, "test", "train", 5))
def rag_topk_questions(spark, d):
    return _shown(similarity_index(_t(spark, d, "questions"), dims=64))


@query(
    "vector_norms",
    """select variable_name, cast(len(embedding) as bigint) as dims, round(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 6) as norm
    from questions where len(embedding) > 0""",
)
def vector_norms(spark, d):
    v = embedding(F.col("embedding"), "array<float>")
    return _t(spark, d, "questions").where(v.isNotNull()).select(
        "variable_name", F.size("embedding").cast("bigint").alias("dims"), F.round(norm(v), 6).alias("norm")
    )


@query(
    "pair_cosines",
    """with e as (select variable_name, cast(embedding as double[]) as v from questions where len(embedding) = 64)
    select distinct p.target_variable_name, p.neighbor_variable_name, round(case when list_dot_product(t.v, t.v) = 0 or list_dot_product(n.v, n.v) = 0
      then 0.0 else list_cosine_similarity(t.v, n.v) end, 6) as cosine
    from rag_similarity p join e t on p.target_variable_name = t.variable_name join e n on p.neighbor_variable_name = n.variable_name""",
)
def pair_cosines(spark, d):
    v = _t(spark, d, "questions").where("size(embedding) = 64").select(
        "variable_name", F.col("embedding").alias("v"), norm(F.col("embedding")).alias("n")
    )
    pairs = _t(spark, d, "rag_similarity").select("target_variable_name", "neighbor_variable_name").distinct()
    left, right = v.toDF("target_variable_name", "tv", "tn"), v.toDF("neighbor_variable_name", "nv", "nn")
    both = pairs.join(left, "target_variable_name").join(right, "neighbor_variable_name")
    return both.select(
        "target_variable_name", "neighbor_variable_name", F.round(cosine(F.col("tv"), F.col("nv"), F.col("tn"), F.col("nn")), 6).alias("cosine")
    )


# -- lookups

_CODES = "values (1.0, 'Urgent'), (2.0, 'High'), (3.0, 'Medium'), (4.0, 'not specified')"


@query(
    "value_labels",
    f"""with c as (select o_orderkey, cast(substring(o_orderpriority, 1, 1) as double) as code from orders),
    l(code, label) as ({_CODES})
    select value, count(*) as n from (select coalesce(case when lower(label) = 'not specified' then 'NOT SPECIFIED' else label end, cast(c.code as varchar), 'nan') as value
      from c left join l on c.code = l.code) group by value""",
)
def value_labels(spark, d):
    answers = _t(spark, d, "orders").select("o_orderkey", F.lit("priority").alias("variable"), F.substring("o_orderpriority", 1, 1).cast("double").alias("code"))
    labels = spark.createDataFrame([("priority", c, t) for c, t in ((1.0, "Urgent"), (2.0, "High"), (3.0, "Medium"), (4.0, "not specified"))], "variable string, code double, label string")
    labelled = lookup.label_values(answers, labels, {"priority": {"not specified": "NOT SPECIFIED"}})
    return labelled.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "riding_region",
    """with r as (select n_name as name, r_name as region from nation join region on n_regionkey = r_regionkey where n_regionkey <> 0),
    c as (select c_custkey, case when c_mktsegment = 'BUILDING' then ' ' else ' ' || n_name || ' ' end as name from customer join nation on c_nationkey = n_nationkey)
    select c_custkey, case when trim(c.name) = '' then 'Inconnu' when region is not null then trim(c.name) || ' (' || region || ')' else trim(c.name) end as riding
    from c left join r on trim(c.name) = r.name""",
)
def riding_region(spark, d):
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    regions = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).where("n_regionkey <> 0").select(F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    named = _t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.concat(F.lit(" "), "n_name", F.lit(" "))).alias("where_")
    )
    return lookup.add_region(named, regions, "where_").select("c_custkey", "riding")


@query(
    "codebook_lookup",
    f"""with b as (select variable_name as variable, label, question, {S.options('options')} as o from questions where not regexp_matches(variable_name, '_+[0-9]+$'))
    select q.variable_name, coalesce(b1.label, b2.label) as label, coalesce(b1.question, b2.question) as question,
      array_to_string(coalesce(b1.o, b2.o, []), '|') as options, b1.variable is not null as exact
    from questions q left join b b1 on q.variable_name = b1.variable left join b b2 on {S.parent('q.variable_name')} = b2.variable""",
)
def codebook_lookup(spark, d):
    q = _t(spark, d, "questions")
    book = q.where("not variable_name rlike '_+[0-9]+$'").select(F.col("variable_name").alias("variable"), "label", "question", options_list(F.col("options")).alias("options"))
    found = lookup.codebook_lookup(q.select("variable_name"), book)
    return found.withColumn("options", F.array_join("options", "|"))


@query(
    "label_overrides",
    """with o as (select variable_name, 'Renamed: ' || label as label, '' as label_fr from questions where split = 'drop')
    select q.variable_name, coalesce(nullif(o.label, ''), q.label) as label, coalesce(nullif(o.label_fr, ''), q.label_fr) as label_fr
    from questions q left join o on q.variable_name = o.variable_name""",
)
def label_overrides(spark, d):
    q = _t(spark, d, "questions").select("variable_name", "label", "label_fr", "split")
    new = q.where("split = 'drop'").select("variable_name", F.concat(F.lit("Renamed: "), "label").alias("label"), F.lit("").alias("label_fr"))
    return lookup.override(q, new, "variable_name", ["label", "label_fr"]).drop("split")


_EN_FR = f"""select variable_name, options, options_fr from questions where variable_name is not null"""


def _pairs_sql(column: str) -> str:
    from panelforge.plans.text_queries import _PAIRS

    return f"(select variable_name, pos, code, label from ({_PAIRS.replace('@', column)}) where code <> '' and label <> '')"


_CODE_SQL = f"""(select e.variable_name, e.pos, e.label as value, f.label as value_fr
  from (select * from {_pairs_sql('options')} qualify row_number() over (partition by variable_name, code order by pos desc) = 1) e
  join (select * from {_pairs_sql('options_fr')} qualify row_number() over (partition by variable_name, code order by pos desc) = 1) f
    on e.variable_name = f.variable_name and e.code = f.code)"""
_PLACE_SQL = f"""(select variable_name, unnest(range(len(le))) as pos, unnest(le) as value, unnest(lf) as value_fr
  from (select variable_name, {S.options('options')} as le, {S.options('options_fr')} as lf from questions) where len(le) = len(lf))"""
_CODED_SQL = f"""(select variable_name from {_pairs_sql('options')} intersect select variable_name from {_pairs_sql('options_fr')})"""


@query("value_map_code", f"select value, arg_min(value_fr, (variable_name, pos)) as value_fr from {_CODE_SQL} where value_fr <> '' group by value")
def value_map_code(spark, d):
    return lookup.value_map(_t(spark, d, "questions"), "code")


@query("value_map_position", f"select value, arg_max(value_fr, (variable_name, pos)) as value_fr from {_PLACE_SQL} where value_fr <> '' group by value")
def value_map_position(spark, d):
    return lookup.value_map(_t(spark, d, "questions"), "position")


_MAP_SQL = f"""(select value, arg_min(value_fr, (variable_name, pos)) as value_fr from
  (select * from {_CODE_SQL} union all select * from {_PLACE_SQL} where variable_name not in {_CODED_SQL}) where value_fr <> '' group by value)"""


@query("value_map", f"select * from {_MAP_SQL}")
def value_map(spark, d):
    return lookup.value_map(_t(spark, d, "questions"))


_FIXED = " ".join(f"when '{k}' then '{v}'" for k, v in lookup.FR_VALUES.items())


@query(
    "localized_values",
    f"""select respondent_id, case when {S.french()} then coalesce(case language {_FIXED} end, m.value_fr, language) else language end as language,
    case when {S.french()} then coalesce(case voted_2019 {_FIXED} end, voted_2019) else voted_2019 end as voted_2019
    from respondents r left join {_MAP_SQL} m on r.language = m.value""",
)
def localized_values(spark, d):
    from panelforge.operators.corpus import is_french

    rows = _t(spark, d, "respondents").select("respondent_id", "survey_language", "language", "voted_2019")
    values = lookup.value_map(_t(spark, d, "questions"))
    french = is_french(F.col("survey_language"))
    for c in ("language", "voted_2019"):
        rows = lookup.localise(rows, c, french, values)
    return rows.select("respondent_id", "language", "voted_2019")


@query(
    "thematic_splits",
    """with s as (select case when thematic_domain is null or thematic_domain = '_drop' then 'drop' when thematic_domain like 'vote%' or thematic_domain in
      (select distinct thematic_domain from questions where split = 'test') then 'test' else 'train' end as split from questions)
    select coalesce(split, 'all') as split, count(*) as n from s group by rollup(split)""",
)
def thematic_splits(spark, d):
    q = _t(spark, d, "questions").select("variable_name", "thematic_domain", "split")
    # the classification is a parameter of the operator: a list of domain names
    test = q.where("split = 'test' and thematic_domain is not null").select("thematic_domain").distinct()
    domains = q.select("variable_name", F.col("thematic_domain").alias("domain"))
    marked = lookup.add_domain(q.select("variable_name"), domains, [r[0] for r in test.collect()], ["_drop"])
    return marked.rollup("split").agg(F.count(F.lit(1)).alias("n")).withColumn("split", F.coalesce("split", F.lit("all")))


@query(
    "thematic_domains",
    """select variable_name, thematic_domain as domain, coalesce(label, '') as label from questions where thematic_domain is not null""",
)
def thematic_domains(spark, d):
    q = _t(spark, d, "questions")
    domains = q.where("thematic_domain is not null").select("variable_name", F.col("thematic_domain").alias("domain"))
    return prepare.thematic_domains(domains, q)


@query(
    "domain_counts",
    """select case when grouping(thematic_domain) = 1 then 'TOTAL' else thematic_domain end as domain, count(*) as n from questions
    where thematic_domain is not null group by rollup(thematic_domain)""",
)
def domain_counts(spark, d):
    return prepare.domain_counts(thematic_domains(spark, d))


@query("split_counts", "select count(*) filter (split = 'train') as train, count(*) filter (split = 'test') as test, count(*) filter (split = 'drop') as drop from questions")
def split_counts(spark, d):
    return prepare.split_counts(_t(spark, d, "questions"))


@query("embedded_questions")
def embedded_questions(spark, d):
    """Vectors of the stand-in encoder; an encoder has no counterpart in SQL."""
    return encoders.embed_questions(_t(spark, d, "questions"), force=True).select("variable_name", "embedding")


# -- respondents


@query(
    "province_filter",
    """select count(*) as total, count(*) filter (province = 'Quebec') as kept, round(100.0 * count(*) filter (province = 'Quebec') / count(*), 6) as percent from respondents""",
)
def province_filter(spark, d):
    return prepare.province_counts(_t(spark, d, "respondents"), "province", "Quebec").withColumn("percent", F.round("percent", 6))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "pivot_respondents",
    "select user_id, "
    + ", ".join(f"coalesce(cast(max(case when event_type = '{t}' then v end) as varchar), '-') as {t}" for t in _TYPES)
    + " from (select user_id, event_type, max(event_id) as v from events group by user_id, event_type) group by user_id",
)
def pivot_respondents(spark, d):
    long = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").cast("string").alias("value"))
    return groups.to_wide(long.withColumnRenamed("event_type", "variable_name"), "user_id", _TYPES).na.fill("-")


@query(
    "unpivot_answers",
    " union all ".join(f"select respondent_id, '{c}' as variable_name, {S.norm(c)} as value from respondents where {S.norm(c)} is not null" for c in ("age", "education", "gender", "riding")),
)
def unpivot_answers(spark, d):
    return groups.to_long(_t(spark, d, "respondents"), "respondent_id", ["age", "education", "gender", "riding"])


@query(
    "derived_profiles",
    f"""with f as (select respondent_id, age, education, case when education like '%university' then '1' end as en, case when gender = 'A woman' then '1' end as fr,
      case when voted_2019 = 'no' then '1' end as other, survey_language as ui from respondents)
    select respondent_id, cast(2021 - try_cast(age as integer) as varchar) as birth,
      case when en is not null and fr is null and other is null then 'English' when fr is not null and en is null and other is null then 'French'
        when en is not null or fr is not null then case when coalesce(ui, 'EN') = 'FR-CA' then 'French' else 'English' end
        when other is not null then 'Other' else 'Not specified' end as language,
      case when coalesce(education, 'nan') = 'Some university' then 'no' else 'yes' end as voted from f""",
)
def derived_profiles(spark, d):
    one = F.lit("1")
    r = _t(spark, d, "respondents")
    en, fr, other = (
        F.when(F.col("education").like("%university"), one), F.when(F.col("gender") == "A woman", one), F.when(F.col("voted_2019") == "no", one),
    )
    return r.select(
        "respondent_id", V.age(F.col("age")).alias("birth"), V.language_profile(en, fr, [other], F.col("survey_language")).alias("language"),
        V.voted(F.col("education"), "Some university").alias("voted"),
    )


@query(
    "language_profiles",
    f"""with f as (select respondent_id, age, case when respondent_id % 3 = 0 then '1' end as en, case when respondent_id % 5 < 2 then '1' end as fr,
      case when respondent_id % 7 = 0 then '1' end as other, survey_language as ui, voted_2019 as v from respondents)
    select respondent_id, case when en is not null and fr is null and other is null then 'English' when fr is not null and en is null and other is null then 'French'
        when en is not null or fr is not null then case when coalesce(ui, 'EN') = 'FR-CA' then 'French' else 'English' end
        when other is not null then 'Other' else 'Not specified' end as language,
      case when coalesce(v, 'nan') = 'no' then 'no' else 'yes' end as voted from f""",
)
def language_profiles(spark, d):
    """Every combination of the language flags, decided by the interface language where they tie."""
    i, one = F.col("respondent_id"), F.lit("1")
    en, fr, other = F.when(i % 3 == 0, one), F.when(i % 5 < 2, one), F.when(i % 7 == 0, one)
    return _t(spark, d, "respondents").select(
        "respondent_id", V.language_profile(en, fr, [other], F.col("survey_language")).alias("language"), V.voted(F.col("voted_2019"), "no").alias("voted")
    )


# a raw coded survey of the respondents: codes, flags, birth years and ridings follow from the id
_CODES = {
    "cps21_province": {0: "Ontario", 1: "Quebec", 2: "Manitoba"}, "cps21_education": {0: "None", 1: "School", 2: "College", 3: "University"},
    "cps21_vote_2019": {0: "Voted", 1: "Did not vote", 2: "Refused"},
}


def _coded(variable: str, code: str) -> str:
    """A code's label; a code without one is its number, a missing one is nan."""
    told = " ".join(f"when {c} then '{label}'" for c, label in _CODES[variable].items())
    return f"coalesce(case {code} {told} end, cast(cast({code} as double) as varchar), 'nan')"


_RAW = """(select respondent_id, survey_language as ui, 1930 + respondent_id % 71 as yob, respondent_id % 3 = 0 as en, respondent_id % 5 < 2 as fr,
  respondent_id % 7 = 0 as other, case when respondent_id % 27 = 26 then ' ' else 'NATION_' || (respondent_id % 27) end as fedname,
  case when respondent_id % 11 <> 0 then respondent_id % 4 end as province, respondent_id % 5 as education, respondent_id % 3 as vote from respondents)"""


@query(
    "prepared_respondents",
    f"""with made as (select respondent_id, coalesce(ui, 'EN') as survey_language, cast(2021 - yob as varchar) as age,
      case when en and not fr and not other then 'English' when fr and not en and not other then 'French'
        when en or fr then case when coalesce(ui, 'EN') = 'FR-CA' then 'French' else 'English' end when other then 'Other' else 'Not specified' end as language,
      case when {S.strip('fedname')} = '' then 'Inconnu' when r_name is not null then {S.strip('fedname')} || ' (' || r_name || ')' else {S.strip('fedname')} end as riding,
      {_coded('cps21_province', 'province')} as province, {_coded('cps21_education', 'education')} as education,
      case when {_coded('cps21_vote_2019', 'vote')} = 'Did not vote' then 'no' else 'yes' end as voted_2019
      from {_RAW} left join (select n_name, r_name from nation join region on n_regionkey = r_regionkey) on {S.strip('fedname')} = n_name),
    placed as (select *, case when language = 'French' then 'FR' else 'non-FR' end as s from made)
    select * exclude (s), case when row_number() over (partition by s order by {S.key(42, 's', 'respondent_id')}, respondent_id) - 1 < round(0.2 * count(*) over (partition by s))
      then 'test' else 'train' end as respondent_split from placed""",
)
def prepared_respondents(spark, d):
    """The table of respondents from a coded survey: labels, age, language, riding, vote and split."""
    i = F.col("respondent_id")
    flag = lambda c: F.when(c, F.lit(1))
    raw = _t(spark, d, "respondents").select(
        "respondent_id", F.col("survey_language").alias("UserLanguage"), (1930 + i % 71).alias("cps21_yob"), flag(i % 3 == 0).alias("cps21_language_1"),
        flag(i % 5 < 2).alias("cps21_language_2"), flag(i % 7 == 0).alias("cps21_language_3"),
        F.when(i % 27 == 26, " ").otherwise(F.concat(F.lit("NATION_"), (i % 27).cast("string"))).alias("fedname"),
        F.when(i % 11 != 0, i % 4).alias("cps21_province"), (i % 5).alias("cps21_education"), (i % 3).alias("cps21_vote_2019"),
    )
    labels = spark.createDataFrame([(v, float(c), x) for v, codes in _CODES.items() for c, x in codes.items()], "variable string, code double, label string")
    regions = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    variables = prepare.chosen_variables(raw.columns, ["cps21_yob", "cps21_language_1", "cps21_province"], ["cps21_education", "cps21_vote_2019", "cps21_absent"])
    names = {"cps21_province": "province", "cps21_education": "education"}
    made = prepare.prepare_respondents(raw, variables, labels, regions, names=names, others=["cps21_language_3"])
    return made.select("respondent_id", "survey_language", "age", "language", "riding", "province", "education", "voted_2019", "respondent_split")


# -- groups


@query(
    "parent_groups",
    f"""select {S.parent('variable_name')} as parent_key, count(*) as n_items, string_agg(variable_name, ',' order by variable_name) as names from questions group by 1""",
)
def parent_groups(spark, d):
    return parents(_t(spark, d, "questions"))


_ITEMS = f"""(select {S.parent('variable_name')} as parent_key, variable_name, {S.pick('false')} as label_en, {S.pick('true')} as label_fr,
  {S.options('options')} as options_en, {S.options('options_fr')} as options_fr
  from questions where split = '@' and coalesce(variable_name, '') <> '' and coalesce(column_name, '') <> '')"""
_ANSWERS = """(select respondent_id, question as variable_name, arg_max(simulated_response, (collected_at, sample_idx, coalesce(simulated_response, ''))) as value
  from (select distinct respondent_id, question, sample_idx, simulated_response, collected_at from condition2_samples) group by 1, 2)"""


def answers(spark, d):
    """The last response of every respondent to every question."""
    rows = _t(spark, d, "condition2_samples").where("simulated_response is not null").select(
        "respondent_id", F.col("question").alias("variable_name"), F.col("simulated_response").alias("value"), "collected_at", "sample_idx"
    )
    return dedup.keep_last(rows, ["respondent_id", "variable_name"], ["collected_at", "sample_idx", "value"]).select("respondent_id", "variable_name", "value")


_ANSWERS = _ANSWERS.replace("from condition2_samples)", "from condition2_samples where simulated_response is not null)")
_KINDS = f"""(select parent_key, count(*) as items, case when count(*) = 1 then 'simple' when coalesce(bool_and(lo = hi), true) then 'select_all' else 'battery' end as kind
  from (select distinct parent_key, variable_name from {_ITEMS.replace('@', 'test')}) left join
    (select variable_name, min({S.norm('value')}) as lo, max({S.norm('value')}) as hi from {_ANSWERS} where {S.norm('value')} is not null group by 1) using (variable_name) group by 1)"""


@query("group_kinds", f"select * from {_KINDS}")
def group_kinds(spark, d):
    return groups.group_kinds(groups.question_items(_t(spark, d, "questions"), "test"), answers(spark, d))


@query(
    "question_groups",
    f"""select parent_key, arg_min({S.child_parent('label_en')}, variable_name) as prompt_en, arg_min({S.child_parent('label_fr')}, variable_name) as prompt_fr,
    array_to_string(arg_min(options_en, variable_name), '|') as options_en, array_to_string(arg_min(options_fr, variable_name), '|') as options_fr,
    string_agg(variable_name, ',' order by variable_name) as names from {_ITEMS.replace('@', 'train')} group by 1""",
)
def question_groups(spark, d):
    found = groups.question_groups(groups.question_items(_t(spark, d, "questions")))
    return found.select(
        "parent_key", "prompt_en", "prompt_fr", F.array_join("options_en", "|").alias("options_en"), F.array_join("options_fr", "|").alias("options_fr"),
        F.array_join("names", ",").alias("names"),
    )


# -- counts, splits and samples


@query(
    "status_counts",
    f"""select question, count(*) as n, count(*) filter ({S.norm('simulated_response')} is not null) as answered, count(*) filter (model_name is null) as no_model,
    count(distinct respondent_id) as respondents from condition2_samples group by question""",
)
def status_counts(spark, d):
    return _t(spark, d, "condition2_samples").groupBy("question").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(normalize_text(F.col("simulated_response")).isNotNull()).alias("answered"),
        F.count_if(F.col("model_name").isNull()).alias("no_model"), F.countDistinct("respondent_id").alias("respondents"),
    )


@query(
    "run_status",
    """select count(*) filter (simulated_response is not null) as ok, count(*) filter (simulated_response is null and model_name is not null) as error, count(*) as total
    from condition1_samples""",
)
def run_status(spark, d):
    status = F.when(F.col("simulated_response").isNotNull(), "ok").when(F.col("model_name").isNotNull(), "error")
    return simulate.status_counts(_t(spark, d, "condition1_samples").withColumn("status", status))


_SPLIT = f"""(select respondent_id, language, case when pos < round(0.2 * n) then 'test' else 'train' end as part from
  (select *, row_number() over (partition by stratum order by {S.key(42, 'stratum', 'respondent_id')}, respondent_id) - 1 as pos, count(*) over (partition by stratum) as n
   from (select respondent_id, language, case when language = 'French' then 'FR' else 'non-FR' end as stratum from respondents)))"""


def _split(spark, d):
    r = _t(spark, d, "respondents").select("respondent_id", "language", F.when(F.col("language") == "French", "FR").otherwise("non-FR").alias("stratum"))
    return sampling.stratified_split(r, "stratum", ["respondent_id"], 0.2, 42, "part")


@query("respondent_split", f"select respondent_id, part from {_SPLIT}")
def respondent_split(spark, d):
    return _split(spark, d).select("respondent_id", "part")


@query(
    "split_by_language",
    f"select language, count(*) filter (part = 'train') as train, count(*) filter (part = 'test') as test from {_SPLIT} group by language",
)
def split_by_language(spark, d):
    return _split(spark, d).groupBy("language").pivot("part", ["train", "test"]).count().na.fill(0)


@query(
    "train_eval_split",
    f"""select doc_id, case when row_number() over (order by {S.key(42, '1', 'doc_id')}, doc_id) - 1 < round(0.05 * count(*) over ()) then 'eval' else 'train' end as part from documents""",
)
def train_eval_split(spark, d):
    return sampling.train_eval_split(_t(spark, d, "documents").select("doc_id"), ["doc_id"]).select("doc_id", "part")


@query("sample_cap", f"select doc_id from documents order by {S.key(42, 'doc_id')}, doc_id limit 100")
def sample_cap(spark, d):
    return sampling.sample_cap(_t(spark, d, "documents").select("doc_id"), ["doc_id"], 100)


@query("row_index", "select variable_name, row_number() over (order by variable_name) - 1 as row_index from questions")
def row_index(spark, d):
    return sampling.row_index(_t(spark, d, "questions").select("variable_name"), "variable_name")


@query("dedup_keep_last", f"select * from {_ANSWERS}")
def dedup_keep_last(spark, d):
    return answers(spark, d)


@query(
    "resume_pending",
    """select q.variable_name as question from questions q where split in ('test', 'train') and not exists (select 1 from condition1_samples c where c.question = q.variable_name)""",
)
def resume_pending(spark, d):
    todo = _t(spark, d, "questions").where("split in ('test', 'train')").select(F.col("variable_name").alias("question"))
    return dedup.pending(todo, _t(spark, d, "condition1_samples"), ["question"])


@query(
    "merged_checkpoint",
    """select question, sample_idx, arg_max(simulated_response, (src, coalesce(simulated_response, ''))) as simulated_response, max(src) as src from
    (select question, sample_idx, simulated_response, 0 as src from condition1_samples union all select question, sample_idx, simulated_response, 1 from condition2_samples)
    where simulated_response is not null group by 1, 2""",
)
def merged_checkpoint(spark, d):
    a, b = (_t(spark, d, f"condition{i}_samples").where("simulated_response is not null").select("question", "sample_idx", "simulated_response").withColumn("src", F.lit(i - 1)) for i in (1, 2))
    return dedup.merged(a, b, ["question", "sample_idx"], ["src"])
