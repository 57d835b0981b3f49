"""Queries over prompts, corpora, simulation runs and their evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.text import normalize_text
from panelforge.operators import corpus, evaluate, groups, lookup, sampling, simulate
from panelforge.operators.similarity import similarity_index
from panelforge.plans import sqltext as S
from panelforge.plans.registry import query
from panelforge.plans.survey_queries import _ANSWERS, _ITEMS, _KINDS, _MAP_SQL, answers
from panelforge.session import cut, read_table
from panelforge.streaming import checkpoint

_FR = S.french()
_FIXED = " ".join(f"when '{k}' then '{v}'" for k, v in lookup.FR_VALUES.items())


def _put(value: str, french: str) -> str:
    return f"(case when {french} then coalesce(case {value} {_FIXED} end, m.value_fr, {value}) else {value} end)"


# -- rendered answers and profiles

_ITEMS_TEST = _ITEMS.replace("@", "test")
_PLACED = f"""(select parent_key, variable_name, row_number() over (partition by parent_key order by variable_name) as place,
  case when {S.usable(S.child('label_en'))} then {S.child('label_en')} end as ce, case when {S.usable(S.child('label_fr'))} then {S.child('label_fr')} end as cf
  from {_ITEMS_TEST})"""
_LABEL = "coalesce(case when fr then coalesce(cf, ce) else coalesce(ce, cf) end, 'item_' || case when regexp_extract(variable_name, '_([0-9]+)$', 1) <> '' then regexp_extract(variable_name, '_([0-9]+)$', 1) else cast(place as varchar) end)"
_RENDERED = f"""(select respondent_id, parent_key, fr, case when kind = 'battery' then string_agg({_LABEL} || ': ' || value, ' / ' order by variable_name)
    else string_agg(case when kind = 'simple' then value else {_LABEL} end, ', ' order by variable_name) end as answer
  from (select a.respondent_id, p.*, k.kind, r.fr, {_put('a.v', 'r.fr')} as value
    from (select respondent_id, variable_name, {S.norm('value')} as v from {_ANSWERS}) a join {_PLACED} p on a.variable_name = p.variable_name
    join {_KINDS} k on p.parent_key = k.parent_key join (select respondent_id, {_FR} as fr from respondents) r on a.respondent_id = r.respondent_id
    left join {_MAP_SQL} m on a.v = m.value where a.v is not null)
  group by respondent_id, parent_key, fr, kind)"""


def _parts(spark: SparkSession, d: str):
    questions, respondents = read_table(spark, d, "questions"), read_table(spark, d, "respondents")
    # answers and values are each read twice below
    items, told, values = groups.question_items(questions, "test"), cut(answers(spark, d)), cut(lookup.value_map(questions))
    kinds = groups.group_kinds(items, told)
    french = respondents.select("respondent_id", corpus.is_french(F.col("survey_language")).alias("is_french"))
    rendered = groups.rendered_answers(told, items, kinds, values, french)
    return questions, respondents, items, told, values, rendered


@query("rendered_answers", f"select respondent_id, parent_key, fr as is_french, answer from {_RENDERED}")
def rendered_answers(spark, d):
    return _parts(spark, d)[5].select("respondent_id", "parent_key", "is_french", "answer")


_PROFILE_ROWS = " union all ".join(
    f"select respondent_id, {_FR} as fr, {i} as place, '{en}' as en, '{fr}' as capt_fr, {S.norm(c)} as v from respondents" for i, (c, en, fr) in enumerate(corpus.PROFILE_FIELDS)
)
_PROFILES = f"""(select r.respondent_id, coalesce(p.profile, '') as profile from respondents r left join
  (select respondent_id, string_agg('- ' || case when fr then capt_fr else en end || ': ' || {_put('v', 'fr')}, chr(10) order by place) as profile
   from ({_PROFILE_ROWS}) x left join {_MAP_SQL} m on x.v = m.value where v is not null group by respondent_id) p on r.respondent_id = p.respondent_id)"""


@query("profile_lines", f"select * from {_PROFILES}")
def profile_lines(spark, d):
    values = lookup.value_map(read_table(spark, d, "questions"))
    return corpus.profile_lines(read_table(spark, d, "respondents"), values).select("respondent_id", "profile")


# -- contexts and corpora

_GROUPS = f"""(select parent_key, arg_min({S.child_parent('label_en')}, variable_name) as pe, arg_min({S.child_parent('label_fr')}, variable_name) as pf,
  arg_min(options_en, variable_name) as oe, arg_min(options_fr, variable_name) as of from {_ITEMS_TEST} group by 1)"""
_ROWS = f"""(select r.respondent_id, r.parent_key, r.fr, r.answer, case when r.fr then g.pf else g.pe end as prompt, case when r.fr then g.of else g.oe end as choices,
  'Q: ' || case when r.fr then g.pf else g.pe end || ' R: ' || r.answer as line,
  row_number() over (partition by r.respondent_id order by {S.key(42, 'r.respondent_id', 'r.parent_key')}, r.parent_key) - 1 as pos,
  count(*) over (partition by r.respondent_id) as m, {S.draw(42, 'r.respondent_id', 'r.parent_key')} % {corpus.PRIME} as h,
  {S.draw('42|target', 'r.respondent_id', 'r.parent_key')} % {corpus.PRIME - 1} + 1 as a from {_RENDERED} r join {_GROUPS} g on r.parent_key = g.parent_key)"""


def _contexts(n_ctx: int) -> str:
    """Each target's own shuffle of the respondent's other groups, cut after n_ctx."""
    return f"""(select respondent_id, parent_key, string_agg(line, chr(10) order by nth) as context, count(*) as n_context from
    (select t.respondent_id, t.parent_key, c.line, row_number() over (partition by t.respondent_id, t.parent_key order by (t.a * c.h) % {corpus.PRIME}, c.parent_key) as nth
     from rws t join rws c on t.respondent_id = c.respondent_id and t.parent_key <> c.parent_key) where nth <= {n_ctx} group by 1, 2)"""


_INPUT = """(case when fr then 'Voici des reponses du meme repondant au sondage.' else 'Here are responses from the same survey respondent.' end || chr(10)
  || case when profile <> '' then case when fr then 'Profil SES:' else 'SES profile:' end || chr(10) || profile || chr(10) || chr(10) else '' end
  || context || chr(10) || chr(10) || case when fr then 'Question cible:' else 'Target question:' end || chr(10) || 'Q: ' || prompt || chr(10)
  || case when len(choices) > 0 then case when fr then 'Choix: ' else 'Choices: ' end || array_to_string(choices, ' / ') || chr(10) else '' end || 'R:')"""


@query("leave_one_out", f"with rws as materialized {_ROWS} select * from {_contexts(10)}")
def leave_one_out(spark, d):
    *_, items, _, _, rendered = _parts(spark, d)
    rows = corpus.prompted(rendered, groups.question_groups(items))
    return corpus.leave_one_out(rows).select("respondent_id", "parent_key", "context", "n_context")


@query(
    "sft_questions",
    f"""with rws as materialized {_ROWS} select t.respondent_id, t.parent_key, {_INPUT} as input, answer as output
    from rws t join {_contexts(10)} c on t.respondent_id = c.respondent_id and t.parent_key = c.parent_key join {_PROFILES} p on t.respondent_id = p.respondent_id""",
)
def sft_questions(spark, d):
    _, respondents, items, _, values, rendered = _parts(spark, d)
    return corpus.sft_questions(rendered, groups.question_groups(items), corpus.profile_lines(respondents, values))


GRID = (10, 15, 25, 50)


@query(
    "sft_grid",
    f"""with rws as materialized {_ROWS} """
    + " union all ".join(
        f"select '{part}' as mode, {n} as n_ctx, count(*) as examples, cast(sum(n_context) as bigint) as context_lines from {_contexts(n)} {extra}"
        for part, extra in (("q", ""), ("r", "where respondent_id in (select respondent_id from respondents where respondent_split = 'train')"))
        for n in (10, 15, 25, 50)
    ),
)
def sft_grid(spark, d):
    """The grid of corpora: all and training respondents, four context sizes.

    A context of n lines is the beginning of the one of 50, and a respondent's contexts are the same in both
    modes, so the contexts are made once and counted eight times.
    """
    _, respondents, items, _, _, rendered = _parts(spark, d)
    rows = corpus.prompted(rendered, groups.question_groups(items))
    train = respondents.where("respondent_split = 'train'").select("respondent_id", F.lit(True).alias("trained")).distinct()
    made = corpus.leave_one_out(rows, max(GRID)).select("respondent_id", "n_context").join(train, "respondent_id", "left")
    return _grid_counts(made)


def _grid_counts(made: DataFrame) -> DataFrame:
    """Examples and context lines of every cell of the grid; without contexts, too, there is a row for each."""

    def cell(mode: str, n: int):
        inside = F.lit(True) if mode == "q" else F.coalesce("trained", F.lit(False))
        lines = F.sum(F.when(inside, F.least("n_context", F.lit(n).cast("bigint"))))
        return F.struct(F.lit(mode).alias("mode"), F.lit(n).alias("n_ctx"), F.count_if(inside).alias("examples"), lines.alias("context_lines"))

    cells = made.agg(F.array(*[cell(mode, n) for mode in ("q", "r") for n in GRID]).alias("x"))
    return cells.select(F.explode("x").alias("x")).select("x.*")


def _specs(spark: SparkSession, d: str) -> list[dict]:
    """Virtual targets over the first test variables by name: the shapes are fixed, the variables come from the data."""
    v = [r[0] for r in read_table(spark, d, "questions").where("split = 'test'").select("variable_name").orderBy("variable_name").limit(10).collect()]
    return [
        {"name": "intention", "kind": "first", "variables": v[0:3], "prompt_en": "Which party?", "prompt_fr": "Quel parti?", "choices_en": ["A", "B"], "choices_fr": ["A", "B"]},
        {"name": "never", "kind": "named", "variables": v[3:6], "names_en": ["one", "two", "three"], "names_fr": ["un", "deux", "trois"], "prompt_en": "Which never?", "prompt_fr": "Lesquels jamais?"},
        {"name": "identity", "kind": "default", "variables": v[6:7], "default_en": "None", "default_fr": "Aucun", "prompt_en": "Which identity?", "prompt_fr": "Quelle appartenance?"},
        {"name": "plain", "kind": "raw", "variables": v[7:8], "prompt_en": "Which one?", "prompt_fr": "Lequel?"},
    ]


_NTH = "(select variable_name, row_number() over (order by variable_name) as nth from questions where split = 'test' qualify nth <= 10)"
_TARGETS = f"""(with told as (select a.respondent_id, n.nth, {S.norm('a.value')} as v from {_ANSWERS} a join {_NTH} n on a.variable_name = n.variable_name where {S.norm('a.value')} is not null),
  w as (select respondent_id, {', '.join(f'max(case when nth = {i} then v end) as v{i}' for i in range(1, 9))} from told group by 1),
  b as (select r.respondent_id, {_FR} as fr, w.* exclude (respondent_id) from respondents r left join w on r.respondent_id = w.respondent_id)
  select respondent_id, fr, 'intention' as target, case when fr then 'Quel parti?' else 'Which party?' end as prompt, ['A', 'B'] as choices, coalesce(v1, v2, v3) as value, true as tr from b where coalesce(v1, v2, v3) is not null
  union all select respondent_id, fr, 'never', case when fr then 'Lesquels jamais?' else 'Which never?' end, [], concat_ws(', ', case when v4 is not null then case when fr then 'un' else 'one' end end,
    case when v5 is not null then case when fr then 'deux' else 'two' end end, case when v6 is not null then case when fr then 'trois' else 'three' end end), false from b where coalesce(v4, v5, v6) is not null
  union all select respondent_id, fr, 'identity', case when fr then 'Quelle appartenance?' else 'Which identity?' end, [], coalesce(v7, case when fr then 'Aucun' else 'None' end), true from b
  union all select respondent_id, fr, 'plain', case when fr then 'Lequel?' else 'Which one?' end, [], v8, true from b where v8 is not null)"""


@query("virtual_targets", f"select respondent_id, target, prompt, array_to_string(choices, '|') as choices, value from {_TARGETS}")
def virtual_targets(spark, d):
    found = corpus.virtual_targets(answers(spark, d), read_table(spark, d, "respondents"), _specs(spark, d))
    return found.select("respondent_id", "target", "prompt", F.array_join("choices", "|").alias("choices"), "value")


@query(
    "sft_respondents",
    f"""with rws as materialized {_ROWS}, ctx as (select respondent_id, string_agg(line, chr(10) order by pos) as context from rws where pos < 10 group by 1)
    select t.respondent_id, t.target, {_INPUT} as input, case when tr then {_put('t.value', 'fr')} else t.value end as output
    from {_TARGETS} t join ctx on t.respondent_id = ctx.respondent_id join {_PROFILES} p on t.respondent_id = p.respondent_id left join {_MAP_SQL} m on t.value = m.value""",
)
def sft_respondents(spark, d):
    _, respondents, items, told, values, rendered = _parts(spark, d)
    rows = corpus.prompted(rendered, groups.question_groups(items))
    targets = corpus.virtual_targets(told, respondents, _specs(spark, d))
    return corpus.sft_respondents(targets, rows, corpus.profile_lines(respondents, values), values, 10)


_FLAT = f"""(select a.respondent_id, r.fr, 'Q: ' || case when r.fr then q.pf else q.pe end || ' R: ' || {_put('a.v', 'r.fr')} as line,
  row_number() over (partition by a.respondent_id order by {S.key(42, 'a.respondent_id', 'a.variable_name')}, a.variable_name) as pos
  from (select respondent_id, variable_name, {S.norm('value')} as v from {_ANSWERS}) a
  join (select variable_name, {S.strip("coalesce(nullif(label, ''), nullif(question, ''), '')")} as pe, {S.strip("coalesce(nullif(label_fr, ''), nullif(question_fr, ''), '')")} as pf from questions where split = 'test') q on a.variable_name = q.variable_name
  join (select respondent_id, {_FR} as fr from respondents) r on a.respondent_id = r.respondent_id left join {_MAP_SQL} m on a.v = m.value where a.v is not null)"""


@query("flat_context", f"select respondent_id, string_agg(line, chr(10) order by pos) as context, count(*) as n_context from {_FLAT} group by 1")
def flat_context(spark, d):
    questions = read_table(spark, d, "questions").where("split = 'test'").withColumn("split", F.lit("train"))
    values = lookup.value_map(read_table(spark, d, "questions"))
    return corpus.flat_context(answers(spark, d), questions, read_table(spark, d, "respondents"), values)


@query(
    "choices_union",
    f"""with o as (select n.nth, unnest({S.options('options')}) as o, unnest(range(len({S.options('options')}))) as i from questions q join {_NTH} n on q.variable_name = n.variable_name where n.nth <= 5)
    select string_agg(o, '|' order by nth, i) as choices from (select o, min(nth) as nth, arg_min(i, (nth, i)) as i from o group by o)""",
)
def choices_union(spark, d):
    q = read_table(spark, d, "questions")
    names = [r[0] for r in q.where("split = 'test'").select("variable_name").orderBy("variable_name").limit(5).collect()]
    return corpus.choices_union(q, names).select(F.array_join("choices", "|").alias("choices"))


_QIDX = "(select *, row_number() over (order by variable_name) - 1 as question_index from questions where split = 'test' and thematic_domain is null)"


@query(
    "task_build",
    f"""with rws as materialized {_ROWS}, qs as {_QIDX}, who as (select respondent_id, coalesce({S.norm('survey_language')}, 'EN') as survey_language, {_FR} as fr from respondents),
    pairs as (select w.*, q.question_index, {S.draw('42|target', 'w.respondent_id', 'q.question_index')} % {corpus.PRIME - 1} + 1 as a from who w cross join qs q),
    ctx as (select respondent_id, question_index, string_agg(line, chr(10) order by nth) as context from
      (select p.respondent_id, p.question_index, c.line, row_number() over (partition by p.respondent_id, p.question_index order by (p.a * c.h) % {corpus.PRIME}, c.parent_key) as nth
       from pairs p join rws c on p.respondent_id = c.respondent_id) where nth <= 30 group by 1, 2),
    j as (select p.respondent_id, cast(p.question_index as bigint) as question_index, q.variable_name as question, case when p.fr then {S.pick('true', 'q.')} else {S.pick('false', 'q.')} end as question_text,
      case when p.fr then {S.options('q.options_fr')} else {S.options('q.options')} end as choices, p.fr, p.survey_language, ctx.context, pr.profile
      from pairs p join qs q on p.question_index = q.question_index join ctx on p.respondent_id = ctx.respondent_id and p.question_index = ctx.question_index join {_PROFILES} pr on p.respondent_id = pr.respondent_id)
    select respondent_id, question_index, question, question_text, array_to_string(choices, '|') as choices, fr as is_french, {_INPUT.replace("'Q: ' || prompt", "'Q: Q: ' || question_text")} as input, survey_language from j""",
)
def task_build(spark, d):
    """Every respondent with every test question that has no domain, as in the SQL; task_build_all has all."""
    return _tasks(spark, d, "split = 'test' and thematic_domain is null").withColumn("choices", F.array_join("choices", "|"))


@query("task_build_all")
def task_build_all(spark, d):
    """Every respondent with every test question."""
    return _tasks(spark, d).withColumn("choices", F.array_join("choices", "|"))


def _task_maker(spark: SparkSession, d: str, asked: str = "split = 'test'") -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The respondents, and what makes the tasks of some of them."""
    questions, respondents, items, _, values, rendered = _parts(spark, d)
    rows = corpus.context_lines(rendered, groups.question_groups(items))
    return respondents, lambda some, **how: corpus.tasks(some, questions.where(asked), rows, corpus.profile_lines(some, values), **how)


def _tasks(spark: SparkSession, d: str, asked: str = "split = 'test'") -> DataFrame:
    respondents, made = _task_maker(spark, d, asked)
    return made(respondents)


# -- prompts of the simulations


def _question_sql(french: str, p: str = "") -> tuple[str, str, str]:
    def either(fr: str, en: str) -> str:
        return f"(case when {french} then coalesce(nullif({p}{fr}, ''), {p}{en}, '') else coalesce({p}{en}, '') end)"

    label, question, stored = either("label_fr", "label"), either("question_fr", "question"), either("options_fr", "options")
    head = f"case when {label} <> '' then {label} else {question} end"
    body = f"case when {label} <> '' and {question} <> '' and not contains({question}, 'Display This Choice') then {question} || chr(10) || chr(10) else '' end"
    listed = f"coalesce(array_to_string(list_transform({S.stored_options(stored)}, lambda o: '- ' || o || chr(10)), ''), '')"
    return head, body, listed


def _cold(french: bool) -> str:
    head, body, listed = _question_sql("true" if french else "false")
    system, ask = corpus.COLD["FR" if french else "EN"]
    return f"""select '{"FR-CA" if french else "EN"}' as lang, variable_name as question, '{system.replace("'", "''")}' as system_prompt,
      'Question: ' || {head} || chr(10) || chr(10) || {body} || 'Options:' || chr(10) || {listed} || chr(10) || '{ask}' as user_prompt from questions where split = 'test'"""


@query("cold_prompts", f"{_cold(False)} union all {_cold(True)}")
def cold_prompts(spark, d):
    asked = read_table(spark, d, "questions").where("split = 'test'")
    made = [corpus.cold_prompts(asked, fr).withColumn("lang", F.lit(lang)) for fr, lang in ((False, "EN"), (True, "FR-CA"))]
    return made[0].unionByName(made[1])


_HEAD, _BODY, _LISTED = _question_sql("fr", "q.")
_P = corpus.PROFILED


def _either(i: int) -> str:
    return f"(case when fr then '{_P['FR'][i].replace(chr(39), chr(39) * 2)}' else '{_P['EN'][i]}' end)"


@query(
    "demographic_prompts",
    f"""with pool as (select *, row_number() over (order by {S.key('42|pool', 'respondent_id')}, respondent_id) - 1 as slot, count(*) over () as n from respondents),
    draws as (select q.*, cast(s as bigint) as sample_idx, {S.draw(42, 'q.variable_name', 's')} % (select count(*) from respondents) as slot
      from (select * from questions where split = 'test') q cross join range(3) t(s)),
    j as (select q.*, p.respondent_id, p.survey_language, p.age, p.province, p.education, p.gender, p.language, upper({S.value('p.survey_language')}) like 'FR%' as fr from draws q join pool p on q.slot = p.slot)
    select variable_name as question, sample_idx, respondent_id, {_either(0)} as system_prompt,
      {_either(1)} || chr(10) || 'Age: ' || {S.value('age')} || chr(10) || 'Province: ' || {S.value('province')} || chr(10) || 'Education: ' || {S.value('education')} || chr(10)
      || 'Gender: ' || {S.value('gender')} || chr(10) || 'Primary language: ' || {S.value('language')} || chr(10) || chr(10) || 'Question: ' || {_HEAD} || chr(10) || chr(10) || {_BODY}
      || 'Options:' || chr(10) || {_LISTED} || chr(10) || {_either(2)} as user_prompt from j q""",
)
def demographic_prompts(spark, d):
    asked = read_table(spark, d, "questions").where("split = 'test'")
    made = simulate.sampled_profiles(asked, read_table(spark, d, "respondents"), 3)
    return made.select(F.col("variable_name").alias("question"), "sample_idx", "respondent_id", "system_prompt", "user_prompt")


@query("simulate_condition1")
def simulate_condition1(spark, d):
    """Answers of the stub responder; a responder has no counterpart in SQL."""
    return simulate.condition1(read_table(spark, d, "questions").where("split = 'test'"), simulate.stub_responder, 5, "stub")


@query("simulate_condition2")
def simulate_condition2(spark, d):
    asked = read_table(spark, d, "questions").where("split = 'test'")
    return simulate.condition2(asked, read_table(spark, d, "respondents"), simulate.stub_responder, 5, "stub")


@query("simulate_tasks")
def simulate_tasks(spark, d):
    """All tasks with resume: what respondents of the test split got before counts as done."""
    respondents, made = _task_maker(spark, d)
    twice = respondents.groupBy("respondent_id").count().where("count > 1").select("respondent_id")
    # the prompts of the earlier run are made for its respondents only
    old = respondents.where("respondent_split = 'test'").select("respondent_id")
    single, begun = respondents.join(twice, "respondent_id", "left_anti"), respondents.join(old, "respondent_id", "left_semi")
    before = made(begun.join(twice, "respondent_id", "left_anti"), once=True)
    done = simulate.run_tasks(before, simulate.stub_responder)
    # a run has a result for each task, also an error, so its keys are known without the answers
    told = simulate.run_rest(made(single, once=True, done=before), simulate.stub_responder, done)
    if not twice.isEmpty():  # of a respondent who is there more than once the last result counts
        several = respondents.join(twice, "respondent_id", "left_semi")
        done = simulate.run_tasks(made(begun.join(twice, "respondent_id", "left_semi")), simulate.stub_responder)
        told = told.unionByName(simulate.run_tasks(made(several), simulate.stub_responder, done))
    return told.select("respondent_id", "question", "response_text", "predicted_answer", "status")


# -- extensions: evaluation, retrieval, chat format, streaming


@query(
    "answer_distribution",
    f"""with a as (select question, {S.norm('simulated_response')} as v from condition2_samples where {S.norm('simulated_response')} is not null)
    select question, v as answer, count(*) as n, round(count(*) / sum(count(*)) over (partition by question), 9) as share from a group by question, v""",
)
def answer_distribution(spark, d):
    told = read_table(spark, d, "condition2_samples").select("question", normalize_text(F.col("simulated_response")).alias("answer"))
    return evaluate.distribution(told, ["question"], "answer").withColumn("share", F.round("share", 9))


@query(
    "subgroup_distribution",
    f"""with a as (select question, {S.value('gender')} as gender, {S.norm('simulated_response')} as v from condition2_samples where {S.norm('simulated_response')} is not null)
    select question, gender, v as answer, count(*) as n, round(count(*) / sum(count(*)) over (partition by question, gender), 9) as share from a group by question, gender, v""",
)
def subgroup_distribution(spark, d):
    from panelforge.functions.text import normalize_value

    told = read_table(spark, d, "condition2_samples").select(
        "question", normalize_value(F.col("gender")).alias("gender"), normalize_text(F.col("simulated_response")).alias("answer")
    )
    return evaluate.distribution(told, ["question", "gender"], "answer").withColumn("share", F.round("share", 9))


_DIST = "(select question, v, count(*) / sum(count(*)) over (partition by question) as share from (select question, {n} as v from condition{i}_samples where {n} is not null) group by question, v)"
_TV = f"""(select question, sum(gap) / 2 as tv from (select question, v, abs(sum(s)) as gap from
  (select question, v, share as s from {_DIST.format(i=1, n=S.norm('simulated_response'))} union all select question, v, -share from {_DIST.format(i=2, n=S.norm('simulated_response'))})
  where question in (select question from condition1_samples where {S.norm('simulated_response')} is not null) and question in (select question from condition2_samples where {S.norm('simulated_response')} is not null)
  group by question, v) group by question)"""


def _tv(spark, d) -> DataFrame:
    a, b = (read_table(spark, d, f"condition{i}_samples").select("question", normalize_text(F.col("simulated_response")).alias("answer")) for i in (1, 2))
    return evaluate.total_variation(a, b, ["question"], "answer")


@query("tv_distance", f"select question, round(tv, 6) as tv from {_TV}")
def tv_distance(spark, d):
    return _tv(spark, d).withColumn("tv", F.round("tv", 6))


@query(
    "similarity_bins",
    f"""with e as (select variable_name, split, cast(embedding as double[]) as v from questions where len(embedding) = 64),
    s as (select t.variable_name as question, max(round(case when list_dot_product(t.v, t.v) = 0 or list_dot_product(c.v, c.v) = 0 then 0.0 else list_cosine_similarity(t.v, c.v) end, 9)) as s
      from e t, e c where t.split = 'test' and c.split = 'train' group by 1)
    select cast(least(floor(s * 20), 19) as bigint) as bin, count(*) as n, round(avg(tv), 6) as mean from {_TV} join s using (question) group by 1""",
)
def similarity_bins(spark, d):
    index = similarity_index(read_table(spark, d, "questions"), top_k=1, dims=64)
    return evaluate.by_similarity(_tv(spark, d), index, "question", "tv", 20).withColumn("mean", F.round("mean", 6))


_RETRIEVED = f"""with e as (select variable_name, cast(embedding as double[]) as v from questions where split = 'test' and len(embedding) = 64),
    p as (select t.variable_name as target, c.variable_name as near, round(case when list_dot_product(t.v, t.v) = 0 or list_dot_product(c.v, c.v) = 0 then 0.0
      else list_cosine_similarity(t.v, c.v) end, 9) as s from e t, e c where t.variable_name <> c.variable_name),
    r as (select *, row_number() over (partition by target order by s desc, near) as r from p)
    select a.respondent_id, r.target, string_agg('Q: ' || coalesce(q.label, '') || ' R: ' || a.value, chr(10) order by r.r) as context
    from r join {_ANSWERS} a on a.variable_name = r.near join questions q on q.variable_name = r.near where r.r <= 5 group by 1, 2"""


@query("retrieved_context", _RETRIEVED)
def retrieved_context(spark, d):
    """Each respondent's own answers to the nearest other test questions of a target."""
    questions = read_table(spark, d, "questions")
    index = similarity_index(questions, "test", "test", 5, dims=64)
    return evaluate.retrieved_context(index, answers(spark, d), questions)


@query(
    "sft_retrieved",
    f"""with ctx as ({_RETRIEVED}), j as (select c.respondent_id, c.target, c.context, r.fr, p.profile, {S.norm('a.value')} as output,
      case when r.fr then {S.pick('true', 'q.')} else {S.pick('false', 'q.')} end as prompt, case when r.fr then {S.options('q.options_fr')} else {S.options('q.options')} end as choices
      from ctx c join {_ANSWERS} a on c.respondent_id = a.respondent_id and c.target = a.variable_name join (select respondent_id, {_FR} as fr from respondents) r on c.respondent_id = r.respondent_id
      join {_PROFILES} p on c.respondent_id = p.respondent_id join questions q on q.variable_name = c.target where {S.norm('a.value')} is not null)
    select respondent_id, target, {_INPUT} as input, output from j""",
)
def sft_retrieved(spark, d):
    """Examples whose context is what the respondent answered to the nearest other questions."""
    questions, respondents, told = read_table(spark, d, "questions"), read_table(spark, d, "respondents"), answers(spark, d)
    profiles = corpus.profile_lines(respondents, lookup.value_map(questions))
    return corpus.sft_retrieved(retrieved_context(spark, d), told, questions, respondents, profiles)


@query(
    "chat_messages",
    f"""with rws as materialized {_ROWS}, x as (select t.respondent_id, t.parent_key, {_INPUT} as input, answer as output
      from rws t join {_contexts(10)} c on t.respondent_id = c.respondent_id and t.parent_key = c.parent_key join {_PROFILES} p on t.respondent_id = p.respondent_id)
    select respondent_id, parent_key, cast(to_json([{{'role': 'system', 'content': 'Answer as this respondent.'}}, {{'role': 'user', 'content': input}},
      {{'role': 'assistant', 'content': output}}]) as varchar) as messages from x""",
)
def chat_messages(spark, d):
    return corpus.chat_messages(sft_questions(spark, d), "Answer as this respondent.").select("respondent_id", "parent_key", "messages")


@query(
    "stream_latest",
    """select question, sample_idx, arg_max(simulated_response, (collected_at, simulated_response)) as simulated_response from condition1_samples where simulated_response is not null group by 1, 2""",
)
def stream_latest(spark, d):
    """The samples read as a stream of files, the last row per key kept."""
    import os
    import uuid

    from panelforge.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    source = f"{d}/condition1_samples.parquet"
    schema = spark.read.parquet(source).schema
    if not os.path.isdir(source):  # a stream reads folders
        spark.read.parquet(source).write.parquet(f"{root}/source")
        source = f"{root}/source"
    rows = checkpoint.latest_by_key(spark, source, schema, f"{root}/target", f"{root}/state", ["question", "sample_idx"], ["collected_at", "simulated_response"])
    return rows.where("simulated_response is not null").select("question", "sample_idx", "simulated_response")


@query(
    "windowed_counts",
    "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n from events group by 1, 2",
)
def windowed_counts(spark, d):
    return checkpoint.windowed_counts(read_table(spark, d, "events"), "ts", "event_type")
