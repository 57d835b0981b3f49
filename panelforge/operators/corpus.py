"""Prompts and supervised corpora from answers, groups and profiles."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.hashing import draw
from panelforge.functions.options import bulleted, choices_line, options_kept, options_list
from panelforge.functions.text import normalize_text, normalize_value, parent_var, pick_lang, pick_raw
from panelforge.operators.contexts import BLOCK_PAIRS, PRIME, contexts_of_others, contexts_of_range
from panelforge.operators.lookup import localise
from panelforge.operators.sampling import row_index, shuffled_positions
from panelforge.session import BROADCAST_BYTES, cut

# Profile fields with their English and French captions, in order.
PROFILE_FIELDS = [
    ("age", "Birth year", "Annee de naissance"),
    ("gender", "Gender", "Genre"),
    ("education", "Education", "Scolarite"),
    ("province", "Province", "Province"),
    ("language", "Language", "Langue"),
    ("voted_2019", "Voted in 2019", "A vote en 2019"),
    ("riding", "Riding", "Circonscription"),
]
# The frame of a prompt.
FRAME = {
    "EN": ("Here are responses from the same survey respondent.", "SES profile:", "Target question:"),
    "FR": ("Voici des reponses du meme repondant au sondage.", "Profil SES:", "Question cible:"),
}
# Instructions of the two simulation prompts.
COLD = {
    "EN": (
        "You are participating in a Canadian federal election survey (CES 2021). "
        "Answer the following survey question as a Quebec resident would. "
        "Reply with exactly one of the provided options, word for word. Nothing else.",
        "Your answer:",
    ),
    "FR": (
        "Tu participes à un sondage politique canadien (CES 2021). "
        "Réponds à la question suivante comme un résidant du Québec le ferait. "
        "Réponds avec exactement une des options fournies, mot pour mot. Rien d'autre.",
        "Ta réponse:",
    ),
}
PROFILED = {
    "EN": (
        "You are participating in a Canadian federal election survey (CES 2021). "
        "Using the respondent demographic profile below, answer the question "
        "as that person would. Reply with exactly one of the provided options, "
        "word for word. Nothing else.",
        "Respondent profile:",
        "Your answer:",
    ),
    "FR": (
        "Tu participes a un sondage politique canadien (CES 2021). "
        "En te basant sur le profil socio-demographique fourni, reponds a la "
        "question suivante comme cette personne repondrait. "
        "Reponds avec exactement une des options fournies, mot pour mot. "
        "Rien d'autre.",
        "Profil socio-demographique:",
        "Ta reponse:",
    ),
}


def is_french(survey_language: Column) -> Column:
    """True for an interface language that begins with FR; a missing one is English."""
    return F.upper(F.coalesce(normalize_text(survey_language), F.lit("EN"))).startswith("FR")


def profile_lines(respondents: DataFrame, values: DataFrame, fields: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """respondent_id, is_french, profile: one line `- Caption: value` per known field, '' if there is none.

    Fields are unpivoted, translated in one join and put together again in their order.
    """
    fields = PROFILE_FIELDS if fields is None else fields
    french = is_french(F.col("survey_language"))
    told = F.array(
        *[
            F.struct(
                F.lit(i).alias("at"), F.when(french, fr).otherwise(en).alias("caption"),
                normalize_text(F.col(c).cast("string")).alias("value"),
            )
            for i, (c, en, fr) in enumerate(fields)
        ]
    )
    base = respondents.select("respondent_id", french.alias("is_french"), told.alias("told"))
    rows = base.select("respondent_id", "is_french", F.explode("told").alias("x")).select("respondent_id", "is_french", "x.*")
    rows = localise(rows.where("value is not null"), "value", F.col("is_french"), values)
    lines = rows.groupBy("respondent_id").agg(
        F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit("- "), "caption", F.lit(": "), "value").alias("line")))).alias("x")
    )
    text = F.array_join(F.transform("x", lambda p: p["line"]), "\n")
    return base.select("respondent_id", "is_french").join(
        lines.select("respondent_id", text.alias("profile")), "respondent_id", "left"
    ).withColumn("profile", F.coalesce("profile", F.lit("")))


def input_text(profile: Column, context: Column, target: Column, french: Column, choices: Column) -> Column:
    """The prompt: frame, profile if any, context lines, target question, choices if any, `R:`."""

    def frame(lang: str) -> Column:
        intro, caption, ask = FRAME[lang]
        block = F.when(profile != "", F.concat(F.lit(f"{caption}\n"), profile, F.lit("\n\n"))).otherwise("")
        offered = F.coalesce(F.concat(choices, F.lit("\n")), F.lit(""))
        return F.concat(F.lit(f"{intro}\n"), block, context, F.lit(f"\n\n{ask}\nQ: "), target, F.lit("\n"), offered, F.lit("R:"))

    return F.when(french, frame("FR")).otherwise(frame("EN"))


def _prompted(rendered: DataFrame, groups: DataFrame) -> DataFrame:
    """rendered answers with the group's prompt and choices in the respondent's language, and the context line."""
    fr = F.col("is_french")
    return (
        rendered.join(groups, "parent_key")
        .withColumn("prompt", F.when(fr, F.col("prompt_fr")).otherwise(F.col("prompt_en")))
        .withColumn("choices", F.when(fr, F.col("options_fr")).otherwise(F.col("options_en")))
        .withColumn("line", F.concat(F.lit("Q: "), "prompt", F.lit(" R: "), "answer"))
        .select("respondent_id", "parent_key", "is_french", "prompt", "choices", "answer", "line")
    )


def prompted(rendered: DataFrame, groups: DataFrame) -> DataFrame:
    """_prompted, written once to the checkpoint folder: contexts, counts and targets all read it."""
    return cut(_prompted(rendered, groups))


def context_lines(rendered: DataFrame, groups: DataFrame) -> DataFrame:
    """respondent_id, parent_key, line: what tasks need of prompted; only that is written."""
    return cut(_prompted(rendered, groups).select("respondent_id", "parent_key", "line"))


def _lines(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """context: the lines of each key in order, one per line of text."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("x"))
    return rows.select(*keys, F.array_join(F.transform("x", lambda p: p["line"]), "\n").alias("context"), F.size("x").cast("bigint").alias("n_context"))


def line_arrays(rows: DataFrame, seed: int = 42, carried: tuple[str, ...] = ()) -> DataFrame:
    """respondent_id, lines: every respondent's context lines as one array of (key, line, h, …), h a draw per group, by key.

    A respondent has at most one line per question group, so the array is bounded by the number of groups.
    """
    h = draw(seed, F.col("respondent_id"), F.col("parent_key")) % F.lit(PRIME)
    entry = F.struct(F.col("parent_key").alias("key"), "line", h.alias("h"), *carried)
    return rows.groupBy("respondent_id").agg(F.array_sort(F.collect_list(entry)).alias("lines"))


def target_draw(seed: int, *cols: Column) -> Column:
    return draw(f"{seed}|target", *cols) % F.lit(PRIME - 1) + 1


def leave_one_out(
    rows: DataFrame, n_ctx: int | None = 10, seed: int = 42, carried: tuple[str, ...] = (), who: DataFrame | None = None
) -> DataFrame:
    """respondent_id, parent_key, context, n_context: for every answered group, other groups as context.

    Each target has a seeded shuffle of its own over the respondent's other groups, cut after n_ctx (all for
    None): the order is that of target * h modulo PRIME, at one digest per line and one per target. Targets without
    context are left out. A respondent's lines are gathered once, in one array; targets of a respondent with many
    lines are dealt to several tasks, each with that array, and the contexts are made in place. carried: columns
    of rows that come along; who: columns by respondent_id that come along.
    """
    a = target_draw(seed, F.col("respondent_id"), F.col("parent_key"))
    gathered = line_arrays(rows.withColumn("a", a), seed, ("a", *carried)).where(F.size("lines") > 1)
    if who is not None:
        gathered = gathered.join(who, "respondent_id")
    per = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_PAIRS) / F.size("lines"))).cast("int")
    last = F.floor((F.size("lines") - 1) / per).cast("int")
    dealt = gathered.withColumn("_per", per).withColumn("_block", F.explode(F.sequence(F.lit(0), last)))
    mine = F.slice("lines", F.col("_block") * F.col("_per") + 1, F.col("_per"))
    blocks = dealt.select(
        *[c for c in gathered.columns if c != "lines"], "_block",
        F.transform("lines", lambda x: F.struct(x["key"].alias("key"), x["line"].alias("line"), x["h"].alias("h"))).alias("lines"),
        F.transform(mine, lambda x: F.struct(*[x[c].alias(c) for c in ("key", "a", *carried)])).alias("targets"),
    )
    # a number given is not merged by adaptive execution, which would go by bytes: a block is few bytes and much work
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = contexts_of_others(blocks.repartition(parts, "respondent_id", "_block"), n_ctx)
    return told.withColumnRenamed("key", "parent_key").drop("_block")


def sft_questions(
    rendered: DataFrame, groups: DataFrame, profiles: DataFrame, n_ctx: int | None = 10, seed: int = 42
) -> DataFrame:
    """respondent_id, parent_key, input, output: one example per respondent and answered group."""
    carried = ("is_french", "prompt", "choices", "answer")
    made = leave_one_out(prompted(rendered, groups), n_ctx, seed, carried, profiles.select("respondent_id", "profile"))
    text = input_text(
        F.col("profile"), F.col("context"), F.col("prompt"), F.col("is_french"), choices_line(F.col("choices"), F.col("is_french"))
    )
    return made.select("respondent_id", "parent_key", text.alias("input"), F.col("answer").alias("output"))


def shared_context(rows: DataFrame, n_ctx: int | None = 10, seed: int = 42) -> DataFrame:
    """respondent_id, context, n_context: the first n_ctx groups of each respondent's seeded order."""
    placed = shuffled_positions(rows, ["respondent_id"], ["parent_key"], seed)
    kept = placed if n_ctx is None else placed.where(F.col("pos") < n_ctx)
    return _lines(kept, ["respondent_id"], "pos")


def virtual_targets(answers: DataFrame, respondents: DataFrame, specs: list[dict]) -> DataFrame:
    """respondent_id, target, prompt, choices, value, translate: derived targets of every respondent.

    A spec has name, kind, variables, prompt_en, prompt_fr, choices_en, choices_fr, and for some kinds
    names_en and names_fr, or default_en and default_fr. Kinds: first (first answered variable), named
    (names of all answered variables, joined by `, `), default (the answer, or a default), raw (the answer).
    Targets without value are left out. The specs are a parameter, so they are exploded in place, without
    a cross join; only the variables they name are read.
    """
    wanted = sorted({v for s in specs for v in s["variables"]})
    told = (
        answers.where(F.col("variable_name").isin(wanted))
        .select("respondent_id", "variable_name", normalize_text(F.col("value")).alias("value"))
        .where("value is not null")
        .groupBy("respondent_id", "variable_name").agg(F.max("value").alias("value"))
        .groupBy("respondent_id").agg(F.map_from_entries(F.collect_list(F.struct("variable_name", "value"))).alias("told"))
    )
    base = respondents.select("respondent_id", is_french(F.col("survey_language")).alias("is_french")).join(told, "respondent_id", "left")
    french = F.col("is_french")

    def texts(xs: list[str]) -> Column:
        return F.array(*[F.lit(x) for x in xs]).cast("array<string>")

    def one(s: dict) -> Column:
        got = [F.try_element_at(F.col("told"), F.lit(v)) for v in s["variables"]]
        if s["kind"] == "first":
            value = F.coalesce(*got)
        elif s["kind"] == "named":
            named = [
                F.when(g.isNotNull(), F.when(french, f).otherwise(e)) for g, e, f in zip(got, s["names_en"], s["names_fr"])
            ]
            value = F.nullif(F.concat_ws(", ", *named), F.lit(""))
        elif s["kind"] == "default":
            value = F.coalesce(got[0], F.when(french, s["default_fr"]).otherwise(s["default_en"]))
        else:
            value = got[0]
        return F.struct(
            F.lit(s["name"]).alias("target"), F.when(french, s["prompt_fr"]).otherwise(s["prompt_en"]).alias("prompt"),
            F.when(french, texts(s.get("choices_fr", []))).otherwise(texts(s.get("choices_en", []))).alias("choices"),
            value.alias("value"), F.lit(s["kind"] != "named").alias("translate"),
        )

    rows = base.select("respondent_id", "is_french", F.explode(F.array(*[one(s) for s in specs])).alias("x"))
    return rows.select("respondent_id", "is_french", "x.*").where("value is not null")


def sft_respondents(
    targets: DataFrame, rows: DataFrame, profiles: DataFrame, values: DataFrame, n_ctx: int | None = None, seed: int = 42
) -> DataFrame:
    """respondent_id, target, input, output: every virtual target of every respondent, with one shared context."""
    put = localise(targets, "value", F.col("is_french") & F.col("translate"), values)
    made = put.join(shared_context(rows, n_ctx, seed), "respondent_id").join(profiles.select("respondent_id", "profile"), "respondent_id")
    text = input_text(
        F.col("profile"), F.col("context"), F.col("prompt"), F.col("is_french"), choices_line(F.col("choices"), F.col("is_french"))
    )
    return made.select("respondent_id", "target", text.alias("input"), F.col("value").alias("output"))


def sft_retrieved(
    contexts: DataFrame, answers: DataFrame, questions: DataFrame, respondents: DataFrame, profiles: DataFrame
) -> DataFrame:
    """respondent_id, target, input, output: one example per answered question that has a retrieved context.

    contexts: respondent_id, target, context, such as evaluate.retrieved_context gives. The output is the
    respondent's own answer to the target.
    """
    told = answers.select("respondent_id", F.col("variable_name").alias("target"), normalize_text(F.col("value")).alias("output")).where("output is not null")
    who = respondents.select("respondent_id", is_french(F.col("survey_language")).alias("is_french"))
    asked = questions.select(
        F.col("variable_name").alias("target"), "label", F.col("question").alias("asked"), "label_fr", "question_fr", "options", "options_fr"
    )
    made = (
        contexts.select("respondent_id", "target", "context").join(told, ["respondent_id", "target"]).join(who, "respondent_id")
        .join(profiles.select("respondent_id", "profile"), "respondent_id").join(asked, "target")
    )
    fr = F.col("is_french")
    prompt = pick_lang(fr, F.col("label"), F.col("asked"), F.col("label_fr"), F.col("question_fr"))
    offered = F.when(fr, options_list(F.col("options_fr"))).otherwise(options_list(F.col("options")))
    text = input_text(F.col("profile"), F.col("context"), prompt, fr, choices_line(offered, fr))
    return made.select("respondent_id", "target", text.alias("input"), "output")


def choices_union(questions: DataFrame, variables: list[str], column: str = "options") -> DataFrame:
    """choices: option labels of the named questions, in the order of the names, each once."""
    place = F.array_position(F.array(*[F.lit(v) for v in variables]), F.col("variable_name"))
    rows = questions.where(F.col("variable_name").isin(variables)).select(F.struct(place.alias("at"), options_list(F.col(column)).alias("o")).alias("x"))
    gathered = rows.agg(F.array_sort(F.collect_list("x")).alias("x"))
    return gathered.select(F.array_distinct(F.flatten(F.transform("x", lambda p: p["o"]))).alias("choices"))


def tasks(
    respondents: DataFrame, questions: DataFrame, rows: DataFrame, profiles: DataFrame, n_ctx: int | None = 30, seed: int = 42,
    max_questions: int | None = None, max_respondents: int | None = None, once: bool = False, done: DataFrame | None = None,
) -> DataFrame:
    """Every respondent with every question: the prompt to answer, and what is needed to read the answer.

    questions are the target questions; question_index is their place by name. Every task has a seeded shuffle of
    its own over the respondent's answered groups, cut after n_ctx; respondents without context have no tasks. Lines
    and profile are joined once per respondent, what a question shows is made once per question and language. Only
    respondents are dealt to tasks, once; the questions are broadcast in slices that are small by their real size, and
    each slice reads the same blocks of respondents, so no prompt or context is ever shuffled.
    max_questions and max_respondents, for trial runs, keep the first by name and by respondent_id. once: of questions
    with one name, only the last by place. done: respondent_id and question of tasks to leave out (all that have the
    name); they are gathered to a bit per question, and no prompt is made for them.
    """
    if max_questions is not None:
        questions = questions.orderBy("variable_name").limit(max_questions)
    if max_respondents is not None:
        respondents = respondents.orderBy("respondent_id").limit(max_respondents)
    asked = row_index(
        questions.select("variable_name", *[_shown(f).alias(f"shown_{lang}") for lang, f in (("en", False), ("fr", True))]),
        "variable_name", "question_index",
    )
    words = [F.length(F.to_json(f"shown_{lang}")) for lang in ("en", "fr")]
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(words[0] + words[1]), F.lit(0))).first()
    if once:
        last = F.max("question_index").over(Window.partitionBy("variable_name"))
        asked = cut(asked.withColumn("_last", last).where("question_index = _last").drop("_last"))
    who = respondents.select(
        "respondent_id", F.coalesce(normalize_text(F.col("survey_language")), F.lit("EN")).alias("survey_language"),
        is_french(F.col("survey_language")).alias("is_french"),
    ).join(line_arrays(rows, seed), "respondent_id").join(profiles.select("respondent_id", "profile"), "respondent_id")
    if done is not None:
        who = who.join(_done_bits(done, asked, n), "respondent_id", "left")
    who = cut(who)
    per = max(1, n * BROADCAST_BYTES // max(1, size))
    parts = max(who.sparkSession.sparkContext.defaultParallelism, -(-who.count() * min(n, per) // TASKS_AT_ONCE))
    blocks = _blocks(who, n, parts, seed)
    made = [_tasks_of(blocks, asked, lo, min(n, lo + per), n_ctx) for lo in range(0, max(1, n), per)]
    return functools.reduce(DataFrame.unionByName, made)


def _shown(french: bool) -> Column:
    """What a question shows in one language: text, choices and their line."""
    text = pick_lang(F.lit(french), F.col("label"), F.col("question"), F.col("label_fr"), F.col("question_fr"))
    offered = options_list(F.col("options_fr" if french else "options"))
    return F.struct(text.alias("text"), offered.alias("choices"), choices_line(offered, F.lit(french)).alias("line"))


#: Bits of a bitmap of bitmap_construct_agg.
BITS = 32_768


def _done_bits(done: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """respondent_id, _done: bitmaps of the places of questions that are done, by number of their bucket.

    done can have a row per task, so only names and places of the questions move to it, and its rows are combined where
    they are.
    """
    names = asked.select(F.col("variable_name").alias("_name"), "question_index")
    size = names.agg(F.coalesce(F.sum(F.length("_name")) + 16 * F.count(F.lit(1)), F.lit(0))).first()[0]
    names = F.broadcast(names) if size <= BROADCAST_BYTES else names
    placed = done.select("respondent_id", "question").join(names, F.col("question").eqNullSafe(F.col("_name")))
    bits = placed.groupBy("respondent_id", F.floor(F.col("question_index") / BITS).alias("at")).agg(
        F.bitmap_construct_agg(F.col("question_index") % BITS).alias("bits")
    )
    used = F.substring("bits", 1, -(-min(n, BITS) // 8)).alias("bits")  # the only bucket may be short
    return bits.groupBy("respondent_id").agg(F.map_from_entries(F.collect_list(F.struct("at", used))).alias("_done"))


#: Tasks that one partition makes of one slice of the questions, about.
TASKS_AT_ONCE = 250_000


def _blocks(who: DataFrame, n: int, parts: int, seed: int) -> DataFrame:
    """who with the places from _from to below _to of n questions, in several blocks where there are many lines."""
    per = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_PAIRS) / F.size("lines")))
    dealt = who.withColumn("_per", per).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, n - 1)).cast("bigint"), F.col("_per"))))
    blocks = dealt.select(
        "respondent_id", "survey_language", "is_french", "profile", F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["h"].alias("h"))).alias("lines"),
        F.concat_ws("|", F.lit(f"{seed}|target"), F.col("respondent_id").cast("string")).alias("_prefix"),
        "_from", F.least(F.col("_from") + F.col("_per"), F.lit(n)).alias("_to"), *[c for c in who.columns if c == "_done"],
    )
    return blocks.repartition(parts, "respondent_id", "_from")


def _tasks_of(blocks: DataFrame, asked: DataFrame, lo: int, hi: int, n_ctx: int | None) -> DataFrame:
    """The tasks of the questions from lo to below hi, by place, for every respondent of blocks.

    The shuffle of blocks is the same plan for every slice, so it is done once and read again: what is not of the
    slice is left out behind it, by contexts_of_range, as a condition here would be pushed below it.
    """
    told = contexts_of_range(blocks, n_ctx, "question_index", lo, hi)
    part = asked.where((F.col("question_index") >= lo) & (F.col("question_index") < hi))
    made = told.join(F.broadcast(part), "question_index")
    fr = F.col("is_french")
    shown = F.when(fr, F.col("shown_fr")).otherwise(F.col("shown_en"))
    made = made.withColumn("shown", shown)
    prompt = input_text(F.col("profile"), F.col("context"), F.concat(F.lit("Q: "), "shown.text"), fr, F.col("shown.line"))
    return made.select(
        "respondent_id", "question_index", F.col("variable_name").alias("question"), F.col("shown.text").alias("question_text"),
        F.col("shown.choices").alias("choices"), "is_french", prompt.alias("input"), "survey_language",
    )


def _question_parts(french: Column) -> tuple[Column, Column, Column]:
    """Head, body and option lines of a simulation prompt."""

    def either(fr: str, en: str) -> Column:
        plain = F.coalesce(en, F.lit(""))
        return F.when(french, F.coalesce(F.nullif(F.col(fr), F.lit("")), plain)).otherwise(plain)

    label, question = either("label_fr", "label"), either("question_fr", "question")
    stored = either("options_fr", "options")
    head = F.when(label != "", label).otherwise(question)
    shown = (label != "") & (question != "") & ~F.contains(question, F.lit("Display This Choice"))
    body = F.when(shown, F.concat(question, F.lit("\n\n"))).otherwise("")
    return head, body, bulleted(options_kept(stored))


def cold_prompts(questions: DataFrame, french: bool = False) -> DataFrame:
    """question, system_prompt, user_prompt: the prompt without any profile."""
    system, ask = COLD["FR" if french else "EN"]
    head, body, options = _question_parts(F.lit(french))
    user = F.concat(F.lit("Question: "), head, F.lit("\n\n"), body, F.lit("Options:\n"), options, F.lit(f"\n{ask}"))
    return questions.select(F.col("variable_name").alias("question"), F.lit(system).alias("system_prompt"), user.alias("user_prompt"))


def demographic_prompts(pairs: DataFrame) -> DataFrame:
    """pairs with system_prompt and user_prompt; pairs hold the columns of a question and of a profile."""
    french = F.upper(normalize_value(F.col("survey_language"))).startswith("FR")
    head, body, options = _question_parts(french)
    captions = [("Age", "age"), ("Province", "province"), ("Education", "education"), ("Gender", "gender"), ("Primary language", "language")]
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), normalize_value(F.col(x))) for c, x in captions])

    def text(part: int) -> Column:
        return F.when(french, PROFILED["FR"][part]).otherwise(PROFILED["EN"][part])

    user = F.concat(
        text(1), F.lit("\n"), lines, F.lit("\n\nQuestion: "), head, F.lit("\n\n"), body, F.lit("Options:\n"), options, F.lit("\n"), text(2)
    )
    return pairs.withColumn("system_prompt", text(0)).withColumn("user_prompt", user)


def flat_context(answers: DataFrame, questions: DataFrame, respondents: DataFrame, values: DataFrame, seed: int = 42) -> DataFrame:
    """respondent_id, context, n_context: one line per answered training variable, all kept, in seeded order."""
    asked = questions.where("split = 'train' and coalesce(column_name, '') <> ''").select(
        "variable_name", pick_raw(F.col("label"), F.col("question")).alias("prompt_en"),
        pick_raw(F.col("label_fr"), F.col("question_fr")).alias("prompt_fr"),
    )
    who = respondents.select("respondent_id", is_french(F.col("survey_language")).alias("is_french"))
    told = answers.select("respondent_id", "variable_name", normalize_text(F.col("value")).alias("value")).where("value is not null")
    rows = localise(told.join(asked, "variable_name").join(who, "respondent_id"), "value", F.col("is_french"), values)
    prompt = F.when(F.col("is_french"), F.col("prompt_fr")).otherwise(F.col("prompt_en"))
    rows = rows.withColumn("line", F.concat(F.lit("Q: "), prompt, F.lit(" R: "), "value"))
    return _lines(shuffled_positions(rows, ["respondent_id"], ["variable_name"], seed), ["respondent_id"], "pos")


def chat_messages(examples: DataFrame, system: str) -> DataFrame:
    """Extension: examples as one JSON array of system, user and assistant messages."""
    said = F.array(
        *[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("system", F.lit(system)), ("user", F.col("input")), ("assistant", F.col("output")))]
    )
    return examples.withColumn("messages", F.to_json(said))


def parents(questions: DataFrame) -> DataFrame:
    """parent_key with its number of variables and their names in order."""
    return (
        questions.where("variable_name is not null")
        .groupBy(parent_var(F.col("variable_name")).alias("parent_key"))
        .agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("variable_name")), ",").alias("names"))
    )
