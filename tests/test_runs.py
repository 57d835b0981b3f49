"""Contexts per target, replies of endpoints, counts and option lines."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelforge.operators import codebook, contexts, corpus, prepare, simulate
from panelforge.plans import corpus_queries
from panelforge.session import BROADCAST_BYTES, SHUFFLE_CLEANUP, broadcast_if_small, cut, estimated_bytes


def rows_of(spark, n):
    made = [(r, f"g{g:02d}", f"Q: g{g:02d} R: {r}") for r in (1, 2) for g in range(n)] + [(3, "g00", "alone")]
    return spark.createDataFrame(made, "respondent_id bigint, parent_key string, line string")


def test_every_target_has_its_own_order(spark):
    got = corpus.leave_one_out(rows_of(spark, 40), 10).collect()
    assert len(got) == 80 and all(r["n_context"] == 10 for r in got)
    lines = {(r["respondent_id"], r["parent_key"]): r["context"].split("\n") for r in got}
    assert all(f"Q: {g} R: {r}" not in c and len(set(c)) == 10 for (r, g), c in lines.items())
    assert len({tuple(c) for c in lines.values()}) == 80
    # neighbours in one target's context are no neighbours in the next one's, and every line is used about as often
    used = {}
    for c in lines.values():
        for x in c:
            used[x] = used.get(x, 0) + 1
    assert len(used) == 80 and max(used.values()) < 30
    whole = corpus.leave_one_out(rows_of(spark, 40), None).collect()
    assert all(r["n_context"] == 39 for r in whole)
    assert corpus.leave_one_out(rows_of(spark, 40).limit(0)).count() == 0


def test_few_lines_below_the_cut_fall_back_to_all(spark):
    for n in (2, 3, 11, 12):
        got = corpus.leave_one_out(rows_of(spark, n), 10).collect()
        assert {r["n_context"] for r in got} == {min(10, n - 1)}


def by_hand(lines, target, n):
    """The context of one target as the SQL has it: places target * h modulo the prime, then keys."""
    order = sorted((target * h % contexts.PRIME, key, line) for key, line, h in lines)
    return "\n".join(line for *_, line in order[:n])


def test_targets_of_one_respondent_in_several_tasks(spark, monkeypatch):
    rows = rows_of(spark, 300)
    monkeypatch.setattr(corpus, "BLOCK_PAIRS", 3000)
    told = corpus.leave_one_out(rows, 10)
    assert told.select(F.spark_partition_id()).distinct().count() > 1
    drawn = {(r[0], r[1]): r[2] for r in rows.select("respondent_id", "parent_key", corpus.target_draw(42, F.col("respondent_id"), F.col("parent_key"))).collect()}
    lines = {r[0]: [tuple(x) for x in r[1]] for r in corpus.line_arrays(rows).collect()}
    got = told.collect()
    assert len(got) == 600 and {r["n_context"] for r in got} == {10}
    for r in got:
        others = [x for x in lines[r["respondent_id"]] if x[0] != r["parent_key"]]
        assert r["context"] == by_hand(others, drawn[r["respondent_id"], r["parent_key"]], 10)


def test_first_lines_of_extreme_draws():
    top = contexts.PRIME - 1
    a, h = np.array([1, 2, top, 12345]), np.array([0, 1, top, 77, 77, 2**30])
    for n in (1, 3, None):
        chosen, counts = contexts.first_lines(a, h, n)
        want = [sorted(range(6), key=lambda i: (int(x) * int(h[i]) % contexts.PRIME, i))[: n or 6] for x in a]
        assert counts.tolist() == [n or 6] * 4 and chosen.tolist() == sum(want, [])
    # own lines are left out, equal draws come in order of key, also where only a part is sorted
    chosen, counts = contexts.first_lines(np.array([1, 1]), np.full(40, 5), 3, np.arange(40) == np.array([[0], [39]]))
    assert counts.tolist() == [3, 3] and chosen.tolist() == [1, 2, 3, 0, 1, 2]


def test_lines_without_text_are_counted_only():
    lines = pa.array([[{"line": "x", "h": 1}, {"line": None, "h": 2}]], pa.list_(pa.struct([("line", pa.string()), ("h", pa.int64())])))
    (_, _, context, counts), = contexts.context_batches(lines, None, lambda i: (np.array([1]), None, None))
    assert context.to_pylist() == ["x"] and counts.tolist() == [2]


def test_replies_of_every_shape():
    for reply in (
        [{"generated_text": "a"}], [{"text": "a"}], {"generated_text": "a"}, {"choices": [{"text": "a"}]},
        {"choices": [{"message": {"content": "a"}}]}, {"text": "a"},
    ):
        assert simulate.answer_of(reply) == "a"
    for reply in ([], {}, {"choices": []}, [1], None, "text"):
        with pytest.raises(ValueError):
            simulate.answer_of(reply)


def test_status_counts(spark):
    df = spark.createDataFrame([("ok",), ("ok",), ("error",), (None,)], "status string")
    assert simulate.status_counts(df).first().asDict() == {"ok": 2, "error": 1, "total": 4}
    assert simulate.status_counts(df.limit(0)).first().asDict() == {"ok": 0, "error": 0, "total": 0}
    assert [r[0] for r in simulate.in_order(df.where("status is not null"), "status").collect()] == ["error", "ok", "ok"]


def test_province_and_domains(spark):
    df = spark.createDataFrame([(11,), (24,), (24,), (None,)], "p int")
    assert prepare.province_counts(df, "p", 24).first().asDict() == {"total": 4, "kept": 2, "percent": 50.0}
    assert prepare.keep_province(df.limit(0), "p", 24)[1] == {"total": 0, "kept": 0, "percent": 0.0}
    domains = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "variable_name string, domain string")
    labels = spark.createDataFrame([("a", "A"), ("z", "Z")], "variable_name string, label string")
    built = prepare.thematic_domains(domains, labels)
    assert {tuple(r) for r in built.select("variable_name", "label").collect()} == {("a", "A"), ("b", ""), ("c", "")}
    assert {tuple(r) for r in prepare.domain_counts(built).collect()} == {("x", 2), ("y", 1), ("TOTAL", 3)}


def test_option_lines(spark):
    cases = {
        ("A", "o B", "C (1)", "D (2)"): ["B C (1)", "D (2)"], ("o Yes (1)", "o  No (2)"): ["Yes (1)", "No (2)"], ("over (a) b", "o", "(3)"): [],
        ("Don't know (-99)",): ["Don't know (-99)"], ("x (1) y",): [], ("w" * 200 + " (1)",): [], (): [],
    }
    for lines, want in cases.items():
        df = spark.createDataFrame([(list(lines),)], "l array<string>")
        assert df.select(codebook.merged_options(F.col("l"))).first()[0] == want


def test_trial_runs_keep_the_first(spark):
    questions = spark.createDataFrame(
        [(f"q{i}", f"L{i}", "W?", '["a","b"]', "", "", "") for i in range(4)],
        "variable_name string, label string, question string, options string, label_fr string, question_fr string, options_fr string",
    )
    respondents = spark.createDataFrame([(1, "EN"), (2, "FR-CA")], "respondent_id bigint, survey_language string")
    profiles = respondents.select("respondent_id", F.lit("- Age: 4").alias("profile"))
    made = corpus.tasks(respondents, questions, rows_of(spark, 5), profiles, 3, max_questions=2, max_respondents=1).collect()
    assert {(r["respondent_id"], r["question"]) for r in made} == {(1, "q0"), (1, "q1")}
    assert all(r["input"].count(" R: 1") == 3 for r in made)
    assert corpus.tasks(respondents, questions.limit(0), rows_of(spark, 5), profiles).count() == 0


def test_tasks_in_slices_and_blocks(spark, monkeypatch):
    """Questions in several broadcast slices, each respondent's tasks in several blocks: as by hand."""
    questions = spark.createDataFrame(
        [(f"q{i:02d}", f"L{i}", "W?", '["a","b"]', f"F{i}", "", '["c"]') for i in range(20)],
        "variable_name string, label string, question string, options string, label_fr string, question_fr string, options_fr string",
    )
    respondents = spark.createDataFrame([(1, "EN"), (2, "FR-CA")], "respondent_id bigint, survey_language string")
    profiles = respondents.select("respondent_id", F.lit("- Age: 4").alias("profile"))
    rows = rows_of(spark, 12)
    monkeypatch.setattr(corpus, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(corpus, "BLOCK_PAIRS", 48)
    made = corpus.tasks(respondents, questions, rows, profiles, 3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= plan.count("MapInArrow") > 2
    drawn = respondents.crossJoin(spark.range(20).toDF("q")).select("respondent_id", "q", corpus.target_draw(42, F.col("respondent_id"), F.col("q")))
    drawn = {(r[0], r[1]): r[2] for r in drawn.collect()}
    lines = {r[0]: [tuple(x) for x in r[1]] for r in corpus.line_arrays(rows).collect()}
    got = {(r["respondent_id"], r["question_index"]): r for r in made.collect()}
    assert set(got) == set(drawn)
    for (who, at), r in got.items():
        assert f"\n\n{by_hand(lines[who], drawn[who, at], 3)}\n\n" in r["input"]
        assert r["question"] == f"q{at:02d}" and r["question_text"] == f"{'LF'[who - 1]}{at}" and r["choices"] == (["a", "b"] if who == 1 else ["c"])


def test_grid_has_every_cell(spark):
    made = spark.createDataFrame([(1, 12, True), (2, 60, None)], "respondent_id bigint, n_context bigint, trained boolean")
    got = {(r["mode"], r["n_ctx"]): (r["examples"], r["context_lines"]) for r in corpus_queries._grid_counts(made).collect()}
    assert got[("q", 10)] == (2, 20) and got[("q", 50)] == (2, 62) and got[("r", 15)] == (1, 12) and len(got) == 8
    none = corpus_queries._grid_counts(made.limit(0)).collect()
    assert len(none) == 8 and {(r["examples"], r["context_lines"]) for r in none} == {(0, None)}


def test_broadcast_follows_the_estimate(spark):
    small, large = spark.range(10), spark.range(BROADCAST_BYTES)
    assert estimated_bytes(small) < BROADCAST_BYTES < estimated_bytes(large)
    assert "broadcast" in broadcast_if_small(small)._jdf.queryExecution().logical().toString().lower()
    assert broadcast_if_small(large) is large


def test_batches_of_contexts_go_by_bytes():
    """However long the lines and however many the targets are, no batch of contexts is large."""
    for n, size, n_ctx in ((20, 2_000, 30), (300, 5_000, None), (600, 2_000, 30)):
        lines = pa.array([[{"line": f"{i:04d}" + "x" * size, "h": 7 + i} for i in range(n)]] * 2)
        made = list(contexts.context_batches(lines, n_ctx, lambda i: (np.arange(1, 1501), None, None)))
        assert sum(len(counts) for *_, counts in made) == 3000
        assert max(context.nbytes for _, _, context, _ in made) <= 4 << 20
        places = np.concatenate([row * 1500 + place for row, place, _, _ in made])
        assert (places == np.arange(3000)).all()


def test_respondents_with_few_lines_are_taken_together(monkeypatch):
    """Small rows are not worked off one by one, and give what a row of its own gives."""
    rng, calls = np.random.default_rng(2), []
    alone = contexts.first_lines
    monkeypatch.setattr(contexts, "first_lines", lambda *a: (calls.append(1), alone(*a))[1])
    sizes = rng.integers(2, 9, 700)
    lines = pa.array([[{"line": f"{r}-{i}", "h": int(rng.integers(5))} for i in range(n)] for r, n in enumerate(sizes)])
    drawn = [rng.integers(1, contexts.PRIME, n) for n in sizes]
    got = {}
    for row, place, context, counts in contexts.context_batches(lines, 3, lambda r: (drawn[r], np.arange(sizes[r]), np.arange(sizes[r]))):
        got |= {(r, p): (c, n) for r, p, c, n in zip(row.tolist(), place.tolist(), context.to_pylist(), counts.tolist())}
    assert len(got) == sizes.sum() and not calls
    for r, n in enumerate(sizes):
        said = lines[r].as_py()
        for p in range(n):
            others = [(x["line"], x["line"], x["h"]) for i, x in enumerate(said) if i != p]
            assert got[r, p] == (by_hand(others, int(drawn[r][p]), 3), min(3, n - 1))


def test_a_cut_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}

    setting, before = spark.conf.get(SHUFFLE_CLEANUP), shuffled()
    made = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept = cut(made)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(SHUFFLE_CLEANUP) == setting
    again = kept.join(made, ["k", "n"])  # what was cut is read again, and its plan still runs
    assert kept.count() == again.count() == 7


def test_slices_read_the_same_blocks(spark, monkeypatch):
    """Respondents are dealt once, however many slices the questions take: nothing is shuffled for the contexts of a slice."""
    questions = spark.createDataFrame(
        [(f"q{i:02d}", f"L{i}", "W?", "[]", f"F{i}", "", "[]") for i in range(20)],
        "variable_name string, label string, question string, options string, label_fr string, question_fr string, options_fr string",
    )
    respondents = spark.createDataFrame([(1, "EN"), (2, "FR-CA")], "respondent_id bigint, survey_language string")
    profiles = respondents.select("respondent_id", F.lit("").alias("profile"))
    whole = corpus.tasks(respondents, questions, rows_of(spark, 12), profiles, 3).collect()
    monkeypatch.setattr(corpus, "BROADCAST_BYTES", 200)
    made = corpus.tasks(respondents, questions, rows_of(spark, 12), profiles, 3)
    got = made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x]
    assert len(dealt) > 2 and sum("ReusedExchange" not in x for x in dealt) == 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole))


def test_resume_makes_no_prompt_twice(spark, monkeypatch):
    """Done tasks are left out before prompts are made, in every slice, and the results are not shuffled."""
    assert contexts.numbers_left({0: b"\x01\x80", 1: b"\x02\x00"}, range(1, 20)).tolist() == [*range(1, 15), 16, *range(18, 20)]
    monkeypatch.setattr(corpus, "BROADCAST_BYTES", 2000)
    questions = spark.createDataFrame(
        [(name, f"L{i}", "W?", '["a","b"]', "", "", "") for i, name in enumerate([None, "q00", *[f"q{i:02d}" for i in range(20)]])],
        "variable_name string, label string, question string, options string, label_fr string, question_fr string, options_fr string",
    )
    respondents = spark.createDataFrame([(1, "EN"), (2, "FR-CA")], "respondent_id bigint, survey_language string")
    profiles = respondents.select("respondent_id", F.lit("").alias("profile"))
    every = corpus.tasks(respondents, questions, rows_of(spark, 12), profiles, 3, once=True).collect()
    assert len(every) == 42 and len({(r["respondent_id"], r["question"]) for r in every}) == 42
    keys = "respondent_id bigint, question string"
    done = [(1, None), (1, "q00"), (1, "q07"), (1, "q08"), (1, "q19"), (1, "gone"), (3, "q01")]
    left = corpus.tasks(respondents, questions, rows_of(spark, 12), profiles, 3, once=True, done=spark.createDataFrame(done, keys)).collect()
    assert sorted(map(str, left)) == sorted(str(r) for r in every if (r["respondent_id"], r["question"]) not in done)
    whole = [(1, r["question"]) for r in every if r["respondent_id"] == 1]
    left = corpus.tasks(respondents, questions, rows_of(spark, 12), profiles, 3, once=True, done=spark.createDataFrame(whole, keys))
    assert {r["respondent_id"] for r in left.collect()} == {2}
    task = "respondent_id bigint, question string, input string, choices array<string>"
    first, rest = ([(who, "q", "Q: x\nChoices: A / B\nR:", ["A", "B"])] for who in (1, 2))
    before = simulate.run_tasks(spark.createDataFrame(first, task), simulate.stub_responder)
    told = simulate.run_rest(spark.createDataFrame(rest, task), simulate.stub_responder, before)
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["respondent_id"] for r in told.collect()) == [1, 2]
