"""Queries over texts, labels and option lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import options as O
from panelforge.functions import text as T
from panelforge.operators import codebook, groups
from panelforge.plans import sqltext as S
from panelforge.plans.registry import query
from panelforge.session import read_table


def _q(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "questions")


@query(
    "normalize_text",
    f"""select respondent_id, {S.norm('age')} as age, {S.norm('province')} as province, {S.norm('education')} as education,
    {S.value('province')} as province_shown, {S.value('education')} as education_shown from respondents""",
)
def normalize_text(spark, d):
    return read_table(spark, d, "respondents").select(
        "respondent_id", *[T.normalize_text(F.col(c)).alias(c) for c in ("age", "province", "education")],
        *[T.normalize_value(F.col(c)).alias(f"{c}_shown") for c in ("province", "education")],
    )


@query(
    "picked_texts",
    f"""select variable_name, {S.pick('false')} as text_en, {S.pick('true')} as text_fr,
    {S.strip("coalesce(nullif(label, ''), nullif(question, ''), '')")} as raw_en from questions""",
)
def picked_texts(spark, d):
    cols = [F.col(c) for c in ("label", "question", "label_fr", "question_fr")]
    return _q(spark, d).select(
        "variable_name", T.pick_lang(F.lit(False), *cols).alias("text_en"), T.pick_lang(F.lit(True), *cols).alias("text_fr"),
        T.pick_raw(F.col("label"), F.col("question")).alias("raw_en"),
    )


@query(
    "option_lists",
    f"""select variable_name, array_to_string({S.options('options')}, '|') as labels, len({S.options('options')}) as n_labels,
    array_to_string({S.stored_options('options_fr')}, '|') as stored_fr,
    case when len({S.stored_options('options')}) >= 0 and json_valid(options) and json_type(options) = 'ARRAY'
      and json_array_length(options) = 1 then {S.norm(f"regexp_replace(cast(json(options) as varchar[])[1], '^{T.WS}*[0-9]+{T.WS}*:{T.WS}*', '')")} end as only_option
    from questions""",
)
def option_lists(spark, d):
    labels = O.options_list(F.col("options"))
    return _q(spark, d).select(
        "variable_name", F.array_join(labels, "|").alias("labels"), F.size(labels).cast("bigint").alias("n_labels"),
        F.array_join(O.options_kept(F.col("options_fr")), "|").alias("stored_fr"), O.single_option(F.col("options")).alias("only_option"),
    )


_PAIRS = rf"""
  select variable_name, pos, case when regexp_matches(o, '(?s)^{T.WS}*[0-9]+{T.WS}*:') then regexp_extract(o, '(?s)^{T.WS}*([0-9]+){T.WS}*:{T.WS}*(.*)$', 1)
      else regexp_extract(o, '(?s)^(.*?){T.WS}*\(([0-9]+)\){T.WS}*$', 2) end as code,
    {S.strip(rf"case when regexp_matches(o, '(?s)^{T.WS}*[0-9]+{T.WS}*:') then regexp_extract(o, '(?s)^{T.WS}*([0-9]+){T.WS}*:{T.WS}*(.*)$', 2) else regexp_extract(o, '(?s)^(.*?){T.WS}*\(([0-9]+)\){T.WS}*$', 1) end")} as label
  from (select variable_name, unnest(l) as o, unnest(range(len(l))) as pos
        from (select variable_name, case when json_valid(@) and json_type(@) = 'ARRAY' then cast(json(@) as varchar[]) else [] end as l from questions))
"""


@query("option_pairs", f"select variable_name, cast(pos as bigint) as pos, code, label from ({_PAIRS.replace('@', 'options')}) where code <> '' and label <> ''")
def option_pairs(spark, d):
    return _q(spark, d).select("variable_name", F.explode(O.option_pairs(F.col("options"))).alias("x")).select("variable_name", "x.*")


@query(
    "child_labels",
    f"""select variable_name, {S.child_parent('label')} as parent_label, {S.child('label')} as child_label,
    {S.usable(S.child('label'))} as usable from questions""",
)
def child_labels(spark, d):
    parent, child = T.split_child_label(F.col("label"))
    return _q(spark, d).select(
        "variable_name", parent.alias("parent_label"), child.alias("child_label"), T.is_usable_child_label(child).alias("usable")
    )


@query(
    "item_labels",
    f"""with items as (select {S.parent('variable_name')} as parent_key, variable_name, {S.pick('false')} as en, {S.pick('true')} as fr
      from questions where split = 'train' and coalesce(variable_name, '') <> '' and coalesce(column_name, '') <> ''),
    placed as (select *, row_number() over (partition by parent_key order by variable_name) as place,
      case when {S.usable(S.child('en'))} then {S.child('en')} end as ce, case when {S.usable(S.child('fr'))} then {S.child('fr')} end as cf,
      regexp_extract(variable_name, '_([0-9]+)$', 1) as suffix from items)
    select variable_name, coalesce(ce, cf, 'item_' || case when suffix <> '' then suffix else cast(place as varchar) end) as label_en,
      coalesce(cf, ce, 'item_' || case when suffix <> '' then suffix else cast(place as varchar) end) as label_fr from placed""",
)
def item_labels(spark, d):
    items = groups.question_items(_q(spark, d))
    placed = items.withColumn("place", F.row_number().over(Window.partitionBy("parent_key").orderBy("variable_name")))
    return placed.select(
        "variable_name", groups.child_label(F.lit(False), F.col("place")).alias("label_en"),
        groups.child_label(F.lit(True), F.col("place")).alias("label_fr"),
    )


@query(
    "child_from_question",
    rf"""with t as (select variable_name, {S.strip("'Pick all: ▢ none (0) ▢ ' || coalesce(label, '') || ' (' || variable_name || ') ▢ other'")} as q from questions),
    b as (select variable_name, case when instr(q, '(' || variable_name || ')') > 0 then substring(q, 1, instr(q, '(' || variable_name || ')') - 1) end as p from t),
    i as (select variable_name, regexp_replace(regexp_replace(p, '(?s)^.*[▢□■;]', ''), '^[ \-:\t]+|[ \-:\t]+$', '', 'g') as item from b)
    select variable_name, case when length(item) >= 3 then item end as item from i""",
)
def child_from_question(spark, d):
    asked = F.concat(F.lit("Pick all: ▢ none (0) ▢ "), F.coalesce("label", F.lit("")), F.lit(" ("), "variable_name", F.lit(") ▢ other"))
    return _q(spark, d).select("variable_name", T.child_from_parent_question(asked, F.col("variable_name")).alias("item"))


@query("clean_texts", f"select variable_name, {S.clean('question')} as cleaned, {S.clean_codebook('question')} as codebook_text, {S.clean_codebook('label_fr')} as label_fr from questions")
def clean_texts(spark, d):
    return _q(spark, d).select(
        "variable_name", T.clean_text(F.col("question")).alias("cleaned"), T.clean_codebook_text(F.col("question")).alias("codebook_text"),
        T.clean_codebook_text(F.col("label_fr")).alias("label_fr"),
    )


@query("content_terms", f"select doc_id, array_to_string({S.terms('text')}, ' ') as terms from documents")
def content_terms(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.array_join(T.content_terms(F.col("text")), " ").alias("terms"))


_BEST = f"""(with c as (select variable_name, {S.clean('label')} as a, {S.clean('question')} as q from questions)
  select variable_name, case when a <> '' and q <> '' then case when contains(lower(a), lower(q)) then a when contains(lower(q), lower(a)) then q else a || '. ' || q end
    when a <> '' then a when q <> '' then q else {S.strip('variable_name')} end as base from c)"""


@query(
    "embedding_input",
    f"""select variable_name, base, case when len({S.terms('base')}) > 0
      then base || chr(10) || chr(10) || 'key_terms: ' || array_to_string(({S.terms('base')})[1:24], ' ') else base end as embedding_input from {_BEST}""",
)
def embedding_input(spark, d):
    base = T.best_text(F.col("label"), F.col("question"), F.col("variable_name"))
    return _q(spark, d).select("variable_name", base.alias("base")).withColumn("embedding_input", T.embedding_input(F.col("base")))


@query("compact_texts", f"select doc_id, {S.compact('text')} as short, {S.compact('text', 200)} as shorter from documents")
def compact_texts(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.compact(F.col("text")).alias("short"), T.compact(F.col("text"), 200).alias("shorter"))


# codebook notes: every line `name_N | text` is a heading once its bar is taken out
_PREFIX = "[a-z]+_"


def _note_lines(spark, d):
    notes = read_table(spark, d, "documents").where("doc_kind = 'codebook_note'")
    text = F.regexp_replace("text", r"^(\w+_[0-9]+) \|", "$1")
    text = F.regexp_replace(text, r"\n(\w+_[0-9]*[05]) \|", "\n$1")
    return codebook.text_lines(notes.withColumn("text", text), "doc_id", "text")


_LINES = r"""(select doc_id, i - 1 as line_no, regexp_replace(l[i], '\s+$', '') as line from
  (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, regexp_split_to_array(replace(
    regexp_replace(regexp_replace(text, '^([A-Za-z0-9_]+_[0-9]+) \|', '\1'), '\n([A-Za-z0-9_]+_[0-9]*[05]) \|', chr(10) || '\1', 'g'), chr(12), ''), '\r\n|\n') as l
   from documents where doc_kind = 'codebook_note' and text is not null)))"""
_HEAD = rf"^{T.WS}*({_PREFIX}[A-Za-z0-9_]+)\b(?:{T.WS}+(.*\S))?{T.WS}*$"
_BLOCKS = rf"""(select *, sum(h) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as block_no from
  (select doc_id, line_no, {S.strip('line')} as line,
    case when not contains({S.strip('line')}, '|') and regexp_matches({S.strip('line')}, '{_HEAD}')
      and regexp_matches({S.strip(f"regexp_extract({S.strip('line')}, '{_HEAD}', 2)")}, '^$|^[\p{{Lu}}\p{{Nd}}"''\[(]') then 1 else 0 end as h,
    regexp_extract({S.strip('line')}, '{_HEAD}', 1) as v from {_LINES}))"""


@query(
    "codebook_blocks",
    f"""select doc_id, cast(block_no as bigint) as block_no, max(case when h = 1 then v end) as variable, cast(min(line_no) as bigint) as first_line,
    cast(count(case when h = 0 and line <> '' then 1 end) as bigint) as n_lines,
    coalesce(string_agg(case when h = 0 and line <> '' then line end, '|' order by line_no), '') as body
    from {_BLOCKS} where block_no > 0 group by doc_id, block_no""",
)
def codebook_blocks(spark, d):
    found = codebook.blocks(_note_lines(spark, d), "doc_id", _PREFIX)
    return found.select(
        "doc_id", "block_no", "variable", "first_line", F.size("lines").cast("bigint").alias("n_lines"), F.array_join("lines", "|").alias("body")
    )


@query(
    "section_bounds",
    f"""select doc_id, cast(coalesce(max(case when contains(line, 'The') then line_no end), -1) as bigint) as "CPS",
    cast(coalesce(max(case when contains(line, 'answered') then line_no end), -1) as bigint) as "PES" from {_LINES} group by doc_id""",
)
def section_bounds(spark, d):
    return codebook.section_bounds(_note_lines(spark, d), "doc_id", {"CPS": "The", "PES": "answered"}).na.fill(-1)


@query("codebook_entries")
def codebook_entries(spark, d):
    """Entries with merged options; the fold over lines has no counterpart in SQL."""
    found = codebook.entries(codebook.blocks(_note_lines(spark, d), "doc_id", _PREFIX), _PREFIX)
    return found.select("doc_id", "block_no", "variable", "label", "question", F.to_json("options").alias("options"))


@query("codebook_report")
def codebook_report(spark, d):
    return codebook.report(codebook.entries(codebook.blocks(_note_lines(spark, d), "doc_id", _PREFIX), _PREFIX), "doc_id")


@query(
    "first_and_later",
    """select source, arg_min(doc_id, doc_id) as first_doc, case when count(*) > 1 then arg_max(doc_id, doc_id) end as later_doc, count(*) as n
    from documents group by source""",
)
def first_and_later(spark, d):
    rows = codebook.first_and_later(read_table(spark, d, "documents"), "source", "doc_id", ["doc_id", "lang"])
    return rows.select("source", F.col("first.doc_id").alias("first_doc"), F.col("later.doc_id").alias("later_doc"), "n")


@query("mojibake_repair")
def mojibake_repair(spark, d):
    """Documents whose text the repair changes."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", T.repair_mojibake(F.col("text")).alias("repaired"))
    return docs.where("not (text <=> repaired)")


_FIRST_LINE = r"(regexp_split_to_array(body, '\r\n|\r|\n'))[1]"
_C2 = "(select distinct question, sample_idx, simulated_response from condition2_samples)"


@query(
    "clean_generation",
    f"""with t as (select question, sample_idx, {S.strip('simulated_response')} as body from {_C2})
    select question, sample_idx, {S.strip("split_part(case when starts_with(body, question) then " + S.strip("substring(body, length(question) + 1)") + " else body end, chr(10), 1)")} as answer from t""",
)
def clean_generation(spark, d):
    rows = read_table(spark, d, "condition2_samples").select("question", "sample_idx", "simulated_response").distinct()
    return rows.select("question", "sample_idx", T.clean_generation(F.col("question"), F.col("simulated_response")).alias("answer"))


@query(
    "extracted_answers",
    rf"""with t as (select s.question, s.sample_idx, {S.strip('s.simulated_response')} as body, {S.options('q.options')} as labels
      from {_C2} s join questions q on s.question = q.variable_name),
    n as (select *, list_filter(labels, lambda o: o <> '' and contains(body, o))[1] as named from t)
    select question, sample_idx, case when body <> '' then coalesce(named, nullif({S.strip(_FIRST_LINE)}, ''), body) end as answer from n""",
)
def extracted_answers(spark, d):
    rows = read_table(spark, d, "condition2_samples").select("question", "sample_idx", "simulated_response").distinct()
    lists = _q(spark, d).select(F.col("variable_name").alias("question"), O.options_list(F.col("options")).alias("labels"))
    return rows.join(lists, "question").select(
        "question", "sample_idx", T.extract_answer(F.col("simulated_response"), F.col("labels")).alias("answer")
    )


@query(
    "training_texts",
    f"""select question, sample_idx, question || case when question like '% ' or question like '%' || chr(10) then '' else ' ' end || simulated_response || '</s>' as train_text,
    question || simulated_response as joined, substring(question || simulated_response, 1, 200) as preview from {_C2}""",
)
def training_texts(spark, d):
    rows = read_table(spark, d, "condition2_samples").select("question", "sample_idx", "simulated_response").distinct()
    joined = F.concat("question", "simulated_response")
    return rows.select(
        "question", "sample_idx", T.training_text(F.col("question"), F.col("simulated_response"), "</s>").alias("train_text"),
        joined.alias("joined"), F.substring(joined, 1, 200).alias("preview"),
    )
