"""Operators on small tables: invariants, edge cases and independence of partitions."""

import pytest
from pyspark.sql import functions as F

from panelforge.operators import codebook, corpus, dedup, evaluate, groups, lookup, prepare, sampling, similarity, simulate
from panelforge.sources import io
from panelforge.streaming import checkpoint

QUESTIONS = "variable_name string, column_name string, label string, question string, options string, label_fr string, question_fr string, options_fr string, thematic_domain string, split string"


@pytest.fixture(scope="module")
def questions(spark):
    rows = [
        ("a_1", "a_1", "Top - One", "Q", '["Yes (1)", "No (2)"]', "Haut - Un", "QF", '["Oui (1)", "Non (2)"]', "d", "train"),
        ("a_2", "a_2", "Top - Two", "Q", '["Yes (1)", "No (2)"]', "Haut - Deux", "QF", '["Oui (1)", "Non (2)"]', "d", "train"),
        ("b", "b", "Single", "", '["Left", "Right"]', "", "", '["Gauche", "Droite"]', "d", "train"),
        ("c_1", "c_1", "Pick - Xa", "", "", "Choix - Xa", "", "", "d", "train"),
        ("c_2", "c_2", "Pick - Yb", "", "", "Choix - Yb", "", "", "d", "train"),
        ("t", "t", "Target", "What?", '["P", "Q_TEXT", "R"]', "Cible", "Quoi?", "", "v", "test"),
    ]
    return spark.createDataFrame(rows, QUESTIONS)


@pytest.fixture(scope="module")
def respondents(spark):
    rows = [(1, "EN", "30", "Quebec"), (2, "FR-CA", "nan", "Quebec"), (3, None, None, None)]
    return spark.createDataFrame(rows, "respondent_id bigint, survey_language string, age string, province string")


@pytest.fixture(scope="module")
def answers(spark):
    rows = [(1, "a_1", "Yes"), (1, "a_2", "No"), (1, "b", "Left"), (1, "c_2", "picked"), (2, "a_1", "No"), (2, "b", "Right"), (2, "c_1", "picked"), (2, "c_2", "picked"), (3, "b", "nan")]
    return spark.createDataFrame(rows, "respondent_id bigint, variable_name string, value string")


@pytest.fixture(scope="module")
def rendered(questions, respondents, answers):
    items = groups.question_items(questions)
    kinds = groups.group_kinds(items, answers)
    french = respondents.select("respondent_id", corpus.is_french(F.col("survey_language")).alias("is_french"))
    return groups.rendered_answers(answers, items, kinds, lookup.value_map(questions), french)


def test_groups(questions, answers, rendered):
    kinds = {r["parent_key"]: r["kind"] for r in groups.group_kinds(groups.question_items(questions), answers).collect()}
    assert kinds == {"a": "battery", "b": "simple", "c": "select_all"}
    told = {(r["respondent_id"], r["parent_key"]): r["answer"] for r in rendered.collect()}
    assert told == {
        (1, "a"): "One: Yes / Two: No", (1, "b"): "Left", (1, "c"): "Yb",
        (2, "a"): "Un: Non", (2, "b"): "Droite", (2, "c"): "Xa, Yb",
    }


def test_value_maps(questions):
    got = lambda m: {r["value"]: r["value_fr"] for r in lookup.value_map(questions, m).collect()}
    assert got("code") == {"Yes": "Oui", "No": "Non"}
    assert got("code_then_position") == {"Yes": "Oui", "No": "Non", "Left": "Gauche", "Right": "Droite"}
    with pytest.raises(ValueError):
        lookup.value_map(questions, "x")


def test_leave_one_out(questions, respondents, rendered):
    items = groups.question_items(questions)
    rows = corpus.prompted(rendered, groups.question_groups(items))
    for n in (None, 1, 10):
        for r in corpus.leave_one_out(rows, n).collect():
            own = rows.where(f"respondent_id = {r['respondent_id']} and parent_key = '{r['parent_key']}'").first()["line"]
            lines = r["context"].split("\n")
            assert own not in lines and len(lines) == len(set(lines)) == min(n or 2, 2)
    profiles = corpus.profile_lines(respondents.withColumns({c: F.lit(None).cast("string") for c in ("gender", "education", "language", "voted_2019", "riding")}), lookup.value_map(questions))
    made = corpus.sft_questions(rendered, groups.question_groups(items), profiles).where("respondent_id = 2 and parent_key = 'b'").first()
    assert made["input"].startswith("Voici des reponses") and made["input"].endswith("Q: Single\nChoix: Gauche / Droite\nR:") and made["output"] == "Droite"


def test_empty_inputs(questions, rendered):
    none = rendered.limit(0)
    rows = corpus.prompted(none, groups.question_groups(groups.question_items(questions)))
    assert corpus.leave_one_out(rows).count() == 0
    assert sampling.shuffled_positions(questions.limit(0), [], ["variable_name"], 1).count() == 0


def test_shuffled_positions(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    one = {(r["g"], r["id"]): r["pos"] for r in sampling.shuffled_positions(df, ["g"], ["id"], 7).collect()}
    two = {(r["g"], r["id"]): r["pos"] for r in sampling.shuffled_positions(df.repartition(13), ["g"], ["id"], 7).collect()}
    assert one == two
    for g in range(3):
        assert sorted(p for (h, _), p in one.items() if h == g) == list(range(sum(1 for h, _ in one if h == g)))
    assert [r[0] for r in sampling.row_index(df, "id").orderBy("id").select("row_index").collect()] == list(range(1000))


def test_splits(spark):
    df = spark.range(103).withColumn("s", F.when(F.col("id") < 50, "a"))
    counts = {(r["s"], r["split"]): r["count"] for r in sampling.stratified_split(df, "s", ["id"]).groupBy("s", "split").count().collect()}
    assert counts == {("a", "train"): 40, ("a", "test"): 10, (None, "train"): 42, (None, "test"): 11}
    assert sampling.sample_cap(df, ["id"], 5).count() == 5
    drawn = sampling.with_replacement(spark.range(20).toDF("k"), df.select("id"), ["k"], ["id"])
    assert drawn.count() == 20
    with pytest.raises(ValueError):
        sampling.with_replacement(df, df.limit(0), ["id"], ["id"])


def test_lookups(spark):
    codes = spark.createDataFrame([(1, "v", 1.0), (2, "v", 9.0), (3, "v", None)], "id int, variable string, code double")
    labels = spark.createDataFrame([("v", 1.0, "One")], "variable string, code double, label string")
    got = {r["id"]: r["value"] for r in lookup.label_values(codes, labels).collect()}
    assert got == {1: "One", 2: "9.0", 3: "nan"}
    over = spark.createDataFrame([("v", "New", "")], "variable_name string, label string, label_fr string")
    base = spark.createDataFrame([("v", "Old", "Vieux"), ("w", "Same", None)], "variable_name string, label string, label_fr string")
    assert [tuple(r) for r in lookup.override(base, over, "variable_name", ["label", "label_fr"]).orderBy("variable_name").collect()] == [("v", "New", "Vieux"), ("w", "Same", None)]


def test_similarity(spark):
    rows = [("t", "test", "d", [1.0, 0.0]), ("a", "train", None, [1.0, 0.0]), ("b", "train", None, [2.0, 0.0]), ("c", "train", None, [0.0, 1.0]), ("z", "train", None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "variable_name string, split string, thematic_domain string, embedding array<double>")
    got = [(r["neighbor_rank"], r["neighbor_variable_name"], r["cosine_similarity"]) for r in similarity.similarity_index(df, top_k=9).orderBy("neighbor_rank").collect()]
    assert got == [(1, "a", 1.0), (2, "b", 1.0), (3, "c", 0.0), (4, "z", 0.0)]
    for bad in ({"top_k": 0}, {"target_split": "x"}, {"candidate_split": "x"}):
        with pytest.raises(ValueError):
            similarity.similarity_index(df, **bad)
    with pytest.raises(ValueError, match="missing columns"):
        similarity.similarity_index(df.drop("split"))


def test_codebook(spark):
    text = "Campaign Period Survey Questions\ncps21_a Label A\nWhat do you think?\no Yes\nreally (1)\nNo (2)\nTiming\n\nPost-Election Suvey Questions\npes21_b\nFirst line\nSecond line\n"
    lines = codebook.text_lines(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    rows = codebook.with_sections(lines, "id", codebook.section_bounds(lines, "id"))
    assert {r["section"] for r in rows.collect()} == {"CPS", "PES"}
    got = codebook.entries(codebook.blocks(lines, "id")).orderBy("block_no").collect()
    assert [(r["variable"], r["label"], r["question"], r["options"]) for r in got] == [
        ("cps21_a", "Label A", "What do you think? Post-Election Suvey Questions", ["Yes really (1)", "No (2)"]),
        ("pes21_b", "First line", "Second line", []),
    ]
    assert "### `cps21_a`" in codebook.report(codebook.entries(codebook.blocks(lines, "id")), "id").first()["markdown"]
    with pytest.raises(Exception, match="sections"):
        codebook.with_sections(lines, "id", codebook.section_bounds(lines, "id", {"CPS": "nowhere", "PES": "x"})).collect()


def test_prepare(spark):
    raw = spark.createDataFrame(
        [(1, 11, 1980.0, "1", None, 1.0, "EN", "Town"), (2, 11, None, None, "1", 2.0, "FR-CA", " "), (3, 4, 1990.0, "1", "1", None, None, None)],
        "respondent_id bigint, cps21_province int, cps21_yob double, cps21_language_1 string, cps21_language_2 string, q1 double, UserLanguage string, fedname string",
    )
    kept, n = prepare.keep_province(raw, "cps21_province", 11)
    assert n == {"total": 3, "kept": 2, "percent": pytest.approx(66.6666, abs=1e-3)}
    assert prepare.chosen_variables(["b", "a", "c"], ["a", "x"], ["c", "a"]) == ["a", "c"]
    labels = spark.createDataFrame([("q1", 1.0, "One")], "variable string, code double, label string")
    regions = spark.createDataFrame([("Town", "North")], "name string, region string")
    made = prepare.prepare_respondents(raw.withColumn("cps21_yob", F.col("cps21_yob").cast("int").cast("string")), ["cps21_yob", "cps21_language_1", "q1"], labels, regions)
    got = {r["respondent_id"]: (r["age"], r["language"], r["riding"], r["q1"]) for r in made.collect()}
    assert got == {1: ("41", "English", "Town (North)", "One"), 2: (None, "French", "Inconnu", "2.0"), 3: ("31", "English", "Inconnu", "nan")}


def test_prepare_questions(spark):
    s = lambda rows, schema: spark.createDataFrame(rows, schema)
    book = "variable string, label string, question string, options array<string>"
    made = prepare.prepare_questions(
        s([("p_1", "Top - Item [x]"), ("q", "Plain")], "variable_name string, label string"), s([("q", 2.0, "B"), ("q", 1.0, "A")], "variable string, code double, label string"),
        s([("p_1", "L", "Own ${x} text", ["Yes (1)"])], book), s([("p", "Haut", "▢ Chose (p_1)", ["Oui (1)"]), ("q", "Simple", "Quoi?", ["Oui"])], book),
        s([("p_1", "x", "v"), ("q", "x", None)], "variable_name string, label string, domain string"), s([], "parent_var string, en string, fr string"),
        s([], "variable_name string, en string, fr string"), s([], "parent_var string, options array<string>"), s([("q", "", "Autre")], "variable_name string, en string, fr string"),
        ["v"], ["_drop"],
    )
    got = {r["variable_name"]: r.asDict() for r in made.collect()}
    assert got["p_1"]["label"] == "Top - Item" and got["p_1"]["label_fr"] == "Haut - Chose" and got["p_1"]["options_fr"] == "" and got["p_1"]["split"] == "test"
    assert got["q"]["options"] == '["1: A","2: B"]' and got["q"]["label_fr"] == "Autre" and got["q"]["split"] == "drop"


def test_dedup_and_resume(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1)], "k int, v string, seq int")
    assert {(r["k"], r["v"]) for r in dedup.keep_last(df, ["k"], ["seq"]).collect()} == {(1, "b"), (2, None)}
    assert [r["k"] for r in dedup.pending(spark.range(4).toDF("k"), df, ["k"]).orderBy("k").collect()] == [0, 3]
    both = dedup.merged(df, spark.createDataFrame([(1, "c", 3, "e")], "k int, v string, seq int, error string"), ["k"], ["seq"])
    assert {(r["k"], r["v"], r["error"]) for r in both.collect()} == {(1, "c", "e"), (2, None, None)}


def test_responder(spark, questions, respondents):
    def broken(system, user):
        raise RuntimeError("no")

    asked = questions.where("split = 'test'")
    got = simulate.condition1(asked, simulate.stub_responder, 4, "m").collect()
    assert len(got) == 4 and {r["simulated_response"] for r in got} <= {"P", "R"}
    people = respondents.withColumns({c: F.lit("x") for c in ("education", "gender", "language")})
    assert simulate.condition2(asked, people, simulate.stub_responder, 3, "m").count() == 3
    failed = simulate.respond(asked.withColumn("s", F.lit("")), broken, "s", "label", retries=1, pause=0.0).collect()
    assert [(r["status"], r["error"]) for r in failed] == [("error", "RuntimeError: no")]
    task = spark.createDataFrame([(1, "q", "Q: x\nChoices: A / B\nR:", ["A", "B"])], "respondent_id bigint, question string, input string, choices array<string>")
    first = simulate.run_tasks(task, simulate.stub_responder)
    again = simulate.run_tasks(task, broken, first)
    assert again.count() == 1 and again.first()["predicted_answer"] in ("A", "B")


def test_evaluate(spark):
    a = spark.createDataFrame([("q", "x"), ("q", "y"), ("r", "x")], "q string, v string")
    b = spark.createDataFrame([("q", "x"), ("q", "x")], "q string, v string")
    assert [tuple(r) for r in evaluate.total_variation(a, b, ["q"], "v").collect()] == [("q", 0.5)]
    assert {tuple(r) for r in evaluate.distribution(b, [], "v").collect()} == {("x", 2, 1.0)}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("é", ["a", "b"])], "x string, y array<string>")
    io.write_table(df, f"{tmp_path}/t.csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/t.csv").first()["y"] == "a | b"
    with pytest.raises(Exception):
        io.write_table(df, f"{tmp_path}/t.csv")
    with pytest.raises(ValueError):
        io.write_table(df, f"{tmp_path}/t.txt")
    schema = "a int, error string"
    assert io.read_checkpoint(spark, f"{tmp_path}/none", schema).count() == 0
    io.append_checkpoint(spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/c")
    io.append_checkpoint(spark.createDataFrame([(2,)], "a int"), f"{tmp_path}/c")
    assert io.read_checkpoint(spark, f"{tmp_path}/c", schema).count() == 2
    (tmp_path / "book.jsonl").write_text('{"variable": "v", "label": "EN", "options": []}\n\n{"variable": "v", "label": "FR", "options": ["x"]}\n')
    rows = codebook.first_and_later(io.read_codebook(spark, f"{tmp_path}/book.jsonl"), "variable", "line_no", ["label"]).first()
    assert (rows["first"]["label"], rows["later"]["label"]) == ("EN", "FR")
    io.write_domains(spark.createDataFrame([("v", "l", "d")], "variable_name string, label string, domain string"), f"{tmp_path}/d.json")
    assert io.read_domains(spark, f"{tmp_path}/d.json").first()["domain"] == "d"
    with pytest.raises(ValueError):
        io.guard_column(df, "x")


def test_stata(spark, tmp_path):
    import pandas as pd

    path = f"{tmp_path}/s.dta"
    pd.DataFrame({"a": [1.0, 2.0, None], "s": ["x", "y", "z"]}).to_stata(path, write_index=False, value_labels={"a": {1: "One"}}, variable_labels={"a": "Label"})
    assert [(r["a"], r["s"]) for r in io.read_stata(spark, path).collect()] == [(1.0, "x"), (2.0, "y"), (None, "z")]
    assert [tuple(r) for r in io.read_stata(spark, path, "value_labels").collect()] == [("a", 1.0, "One")]
    assert io.read_stata(spark, path, "variable_labels").where("variable_name = 'a'").first()["label"] == "Label"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1)], "k int, v string, t int").write.parquet(f"{tmp_path}/in", mode="append")
    spark.createDataFrame([(1, "b", 2), (2, "c", 1)], "k int, v string, t int").write.parquet(f"{tmp_path}/in", mode="append")
    run = lambda: checkpoint.latest_by_key(spark, f"{tmp_path}/in", "k int, v string, t int", f"{tmp_path}/out", f"{tmp_path}/state", ["k"], ["t"])
    assert {(r["k"], r["v"]) for r in run().collect()} == {(1, "b"), (2, "c")}
    assert run().count() == 2


def test_embedding_and_guards(spark, questions):
    from panelforge.operators import embedding

    made = embedding.embed_questions(questions)
    assert {len(r["embedding"]) for r in made.collect()} == {64} and made.columns == [*questions.columns, "embedding"]
    with pytest.raises(ValueError):
        embedding.embed_questions(made)
    wide = spark.createDataFrame([("x", "1", "2")], "age string, b string, gone string")
    dropped = spark.createDataFrame([("b", "train"), ("gone", "drop")], "column_name string, split string")
    assert prepare.prune_dropped(wide, dropped, ["age"]).columns == ["age", "b"]
    with pytest.raises(ValueError):
        prepare.require_rows(wide.limit(0))
    assert tuple(prepare.split_counts(questions).first()) == (5, 1, 0)


def test_bounded_sample(spark):
    from panelforge.session import bounded_sample

    df = spark.range(10_000)
    one = [r[0] for r in bounded_sample(df, "id", 50).collect()]
    assert len(one) == 50 and sorted(one) == sorted(r[0] for r in bounded_sample(df.repartition(7), "id", 50).collect())
    assert bounded_sample(df.limit(3), "id", 50).count() == 3
