"""Text, option, vector and survey functions on edge rows."""

import pytest
from pyspark.sql import functions as F

from panelforge.functions import hashing, options as O, survey as V, text as T, vectors as X


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_missing(spark):
    values = [None, "", "  ", "nan", "NaN", "None", "null", " a ", "\u00a0b\t", "nano"]
    assert col(spark, values, T.normalize_text) == [None] * 7 + ["a", "b", "nano"]
    assert col(spark, [None, "", "null", "nan", " x "], T.normalize_value) == ["Not specified"] * 3 + ["nan", "x"]


def test_parent_and_children(spark):
    assert col(spark, ["v_1", "v__12", "v_2a", "v2", "v_2019"], T.parent_var) == ["v", "v", "v_2a", "v2", "v"]
    labels = ["A - B", "A - B - C", "A - ", " - B", "A-B", None]
    assert col(spark, labels, lambda c: T.split_child_label(c)[0]) == ["A", "A - B", "A -", "- B", "A-B", ""]
    assert col(spark, labels, lambda c: T.split_child_label(c)[1]) == ["B", "C", None, None, None, None]
    assert col(spark, ["e (6)", "DK", "x", "ok", None, "(3)"], T.is_usable_child_label) == [False, False, False, True, False, False]


def test_cleaning(spark):
    assert col(spark, ["  Display This Choice: a\u00a0 b :; ", None], T.clean_text) == ["a b", ""]
    assert col(spark, ["- Display This Question: ${x} [y] a\r\n b -"], T.clean_codebook_text) == ["a b"]
    assert col(spark, ["éàçñüŒß", "é"], T.strip_diacritics) == ["eacnuŒß", "e"]
    assert col(spark, ["The café, the CAFE is a z à"], T.content_terms) == [["cafe"]]
    assert col(spark, ["the"], T.embedding_input) == ["the"]
    assert col(spark, ["a " * 300], lambda c: F.length(T.compact(c))) == [480]
    assert col(spark, ["Québec", "QuÃ©bec", "x", None], T.repair_mojibake) == ["Québec", "Québec", "x", None]


def test_headings(spark):
    lines = ["cps21_a Label", "cps21_b", "cps21_c lower", "cps21_d | x", "text", "pes21_e_1 École"]
    assert col(spark, lines, lambda c: T.heading(c)[0]) == [True, True, False, False, False, True]
    assert col(spark, ["Timing", "12", "If x", "Who?", ""], T.is_prompt_line) == [False, False, False, True, False]


def test_generation(spark):
    df = spark.createDataFrame([("P", "P yes\nQ: z"), ("P", "  no "), ("P", "")], "p string, g string")
    assert [r[0] for r in df.select(T.clean_generation(F.col("p"), F.col("g"))).collect()] == ["yes", "no", ""]
    opts = F.array(F.lit("Yes"), F.lit("Yes, often"))
    assert col(spark, ["I say Yes, often", "maybe\nso", "", None], lambda c: T.extract_answer(c, opts)) == ["Yes", "maybe", None, None]
    assert col(spark, ["a", "a ", "a\n"], lambda c: T.training_text(c, F.lit("b"), "|")) == ["a b|", "a b|", "a\nb|"]


def test_options(spark):
    stored = ['["1: Yes", "No (2)", "1: Yes", "x_TEXT", null, " nan "]', '{"a": 1}', "bad", "", None, "[1, 2]"]
    assert col(spark, stored, O.options_list) == [["Yes", "No"], [], [], [], [], ["1", "2"]]
    assert col(spark, ['["3: Only"]', '["a", "b"]', "bad"], O.single_option) == ["Only", None, None]
    pairs = col(spark, ['["1: Yes", "No (2)", "plain", "3: Maybe (4)"]'], O.option_pairs)[0]
    assert [(p["pos"], p["code"], p["label"]) for p in pairs] == [(0, "1", "Yes"), (1, "2", "No"), (3, "3", "Maybe (4)")]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(X.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="different length"):
        bad.select(X.dot(F.col("a"), F.col("b"))).collect()
    assert col(spark, ["[1, 2]", "", "x", None], lambda c: X.embedding(c, "string")) == [[1.0, 2.0], None, None, None]


def test_survey(spark):
    assert col(spark, ["1980", "x", None], V.age) == ["41", None, None]
    df = spark.createDataFrame(
        [("1", None, None, "EN"), (None, "1", None, "EN"), ("1", "1", None, "FR-CA"), (None, "1", "1", None), (None, None, "1", "EN"), (None, None, None, "EN")],
        "e string, f string, o string, u string",
    )
    got = [r[0] for r in df.select(V.language_profile(F.col("e"), F.col("f"), [F.col("o")], F.col("u"))).collect()]
    assert got == ["English", "French", "French", "English", "Other", "Not specified"]
    assert col(spark, [None, "_drop", "v", "x"], lambda c: V.split_of(c, ["v"], ["_drop"])) == ["drop", "drop", "test", "train"]
    assert col(spark, [" A ", "", None], lambda c: V.riding(c, F.lit("R"))) == ["A (R)", "Inconnu", "Inconnu"]
    assert col(spark, ["Did not vote", "X", None], V.voted) == ["no", "yes", "yes"]


def test_order_is_seeded(spark):
    a, b = (col(spark, ["1", "2", "3"], lambda c, s=s: hashing.order_key(s, c)) for s in (1, 2))
    assert len(set(a)) == 3 and a != b
