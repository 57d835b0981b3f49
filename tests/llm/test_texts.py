"""Answers, defects, overlaps, leaks and residue on fixtures with known truth."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from panelforge.llm import answers, canonical, defects, leaks, overlap, residue
from panelforge.llm.normal import Edits, damerau, fold, repair, words

QUESTIONS = "variable_name string, label string, question string, options string, label_fr string, question_fr string, options_fr string, split string"
SAMPLES = "question string, sample_idx bigint, survey_language string, simulated_response string, collected_at timestamp"
TRUST = '["A great deal of trust (1)", "Not very much trust (2)", "No trust at all (3)", "Don\'t know / Prefer not to say (4)", "Other_TEXT"]'
TRUST_FR = '["Une grande confiance", "Pas beaucoup de confiance", "Aucune confiance", "Je ne sais pas / Préfère ne pas dire", "Autre_TEXT"]'


@pytest.fixture(scope="module")
def questions(spark):
    rows = [
        ("q1", "Trust in Marwick council", "How much do you trust the council of Marwick about the ferry?", TRUST, "Confiance à Marwick", "Quelle confiance avez-vous en la mairie de Marwick?", TRUST_FR, "test"),
        ("q2", "Last vote", "Will you vote?", '["1: Yes", "2: No", "3: Undecided"]', "", "", "", "test"),
        ("q3", "Broken", "Broken list?", "not json", None, None, "", "test"),
    ]
    return spark.createDataFrame(rows, QUESTIONS)


def test_mapping(spark, questions):
    cases = [
        ("q1", "EN", "a great  deal of trust", 0), ("q1", "EN", "A graet deal of trsut", 0), ("q1", "EN", "(3)", 2), ("q1", "EN", "9", -1), ("q1", "EN", "zero trust", 2),
        ("q1", "EN", "Aucune confiance", 2), ("q1", "EN", "Not very mu", 1), ("q1", "EN", "I'm sorry, but I cannot take part in political polls.", -1),
        ("q1", "EN", "Trust in Marwick council", -1), ("q1", "EN", "potatoes", -1), ("q1", "FR-CA", "**Aucune confiance**", 2),
        ("q1", "EN", "No trust at all, because the buses are late.", 2), ("q1", "EN", "Trust in Marwick council: No trust at all", 2), ("q2", "FR-CA", "yeah!", 0), ("q2", "FR-CA", "2", 1),
        ("q3", "EN", "anything", -1), ("gone", "EN", "x", -1), ("q1", "EN", "No trust at all " * 400, -1),
    ]
    skipped = [("q1", "EN", None), ("q1", "EN", " "), ("q1", "EN", "[]"), ("q1", "EN", "Other_TEXT"), ("q1", "EN", "NaN"), ("q1", "EN", "No trust at all (3)"), ("q1", "FR-CA", "Aucune confiance"), ("q2", "FR-CA", "1: Yes")]
    rows = [(q, i, lang, r, None) for i, (q, lang, r, *_) in enumerate(cases + skipped)]
    df = spark.createDataFrame(rows + rows[:3], SAMPLES).withColumn("unit", F.lit("clash"))
    got = {r["sample_idx"]: r["option_pos"] for r in canonical.map_to_entries(df, questions).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}
    assert canonical.map_to_entries(df.limit(0), questions).count() == 0


def test_long_entries_are_mapped():
    long = "The council should keep the ferry between Marwick and Torville running every day of the whole year"
    options = f'["{long}", "The council should sell the ferry", "No opinion"]'
    slip = long.replace("council", "counicl").replace("Torville", "Torvile")
    near = canonical.Repairs({w: {v: 0.8} for w, v in (("counicl", "council"), ("torvile", "torville"))})
    assert len(words(long)) > 14 and canonical.choose(slip, options, None, (), near) == 0
    assert canonical.choose("It depends on what the neighbours think of that this year", options, None, (), near) == -1


MADE = '["Hospital funding", "Road repairs", "School meals", "Lower rents", "Cleaner rivers"]'


def test_plain_answers_of_any_wording(spark):
    """Lists and wordings that stand in no table; most need the repaired words."""
    cases = [
        ("I reckon hospital funding", 0), ("my pick would be road repairs", 1), ("schol meals for me", 2), ("hosptial fundng", 0), ("lower rnets please", 3),
        ("I would go with cleaner rivers", 4), ("raod repiars above all", 1), ("cleanr rivres", 4), ("hospitl funding I reckon", 0), ("skool meels", 2),
        ("the moon", -1), ("none of your business", -1), ("", None),
    ]
    questions = spark.createDataFrame([("m", "Priority", "What first?", MADE, "", "", "", "test")], QUESTIONS)
    df = spark.createDataFrame([("m", i, "EN", r, None) for i, (r, _) in enumerate(cases)], SAMPLES)
    got = {r["sample_idx"]: r["option_pos"] for r in canonical.map_to_entries(df, questions, expressions="").collect()}
    want = {i: p for i, (_, p) in enumerate(cases) if p is not None}
    assert sum(got[i] == p for i, p in want.items()) >= 11 and all(got[i] == -1 for i in (10, 11)) and set(got) == set(want)


def test_most_mappings_need_the_repaired_words():
    """Without the repair table most misspelt answers map to nothing."""
    rng, e = random.Random(8), canonical.entries_of(MADE, None)
    told, bare = 0, 0
    for _ in range(200):
        ws = list(rng.choice(e.entries)[1])
        place = e.exact["".join(ws)]
        i = rng.randrange(len(ws[0]) - 1)
        slip = [ws[0][:i] + ws[0][i + 1] + ws[0][i] + ws[0][i + 2 :], ws[1][:-2] + ws[1][-1]]
        near = {w: n for w in slip if w not in e.idf and (n := canonical.nearby(w, e.idf, [v for v in e.idf if abs(len(v) - len(w)) < 4]))}
        text = f"the {slip[0]} and {slip[1]}"
        told += canonical.choose(text, MADE, None, (), canonical.Repairs(near)) == place
        bare += canonical.choose(text, MADE, None, (), canonical.Repairs()) == place
    assert told > 180 and bare < told / 2


def test_readings():
    assert answers.bare_code("Option 3") == 3 and answers.bare_code("#4") == 4 and answers.bare_code("3 eggs") is None
    assert answers.parse_list('{"a": 1}') == () and answers.parse_list(None) == ()
    assert (["civic", "left"], False) in answers.readings("Honestly? Civic Left")
    assert answers.is_empty("\u200b") and not answers.is_empty("No")


def test_defects(spark, questions):
    cases = [
        ("q1", "EN", "No trust at all (3)", None), ("q1", "EN", "potatoes", None), ("q1", "EN", None, "empty"), ("q1", "EN", "—", "empty"), ("q1", "EN", "null", "empty"),
        ("q1", "EN", "As an AI language model, I cannot take part in political polls.", "refusal"), ("q1", "FR-CA", "Désolée, je dois décliner.", "refusal"),
        ("q1", "EN", "How much do you trust the council of Marwick about the ferry?", "question_copy"), ("q1", "EN", "A great de", "truncated"),
        ("q1", "EN", "No trust at all, mainly because the municipal government never expl", "truncated"), ("q1", "EN", "Aucune confiance", "other_language"),
        ("q1", "FR-CA", "Aucune confiance", None), ("q1", "FR-CA", "No trust at all", "other_language"), ("q1", "EN", "Los autobuses nunca llegan a tiempo.", "other_language"),
        ("q2", "FR-CA", "Undecided", None), ("q1", "EN", "Trust in Marwick council: No trust at all", None), ("q1", "EN", "my answer: no trsut at all", None),
    ]
    rows = [(q, i, lang, r, None) for i, (q, lang, r, _) in enumerate(cases)]
    df = spark.createDataFrame(rows + rows[:2], SAMPLES).withColumn("defect_type", F.lit("clash"))
    # one question is little to train on: the fixture's own questions are made many
    many = questions
    for i in range(30):
        many = many.unionByName(questions.where("variable_name = 'q1'").withColumn("variable_name", F.lit(f"x{i}")))
    more = spark.createDataFrame([(f"x{i}", 0, "EN", "potatoes", None) for i in range(30)], SAMPLES)
    got = defects.broken_pairs({"t": df, "u": more}, many).where("sample_table = 't'").collect()
    assert {r["sample_idx"]: r["defect_type"] for r in got} == {i: c[3] for i, c in enumerate(cases) if c[3]}
    assert len(got) == len({r["sample_idx"] for r in got})


def test_held_out_quality(spark, questions):
    asked = questions.where("variable_name = 'q1'").select(F.col("variable_name").alias("question"), "options", "options_fr", "label", F.col("question").alias("asked"), "label_fr", F.col("question_fr").alias("asked_fr"))
    many = asked
    for i in range(60):
        many = many.unionByName(asked.withColumn("question", F.lit(f"x{i}")))
    model = defects.train(many, defects.Known())
    assert all(f1 > 0.9 for f1 in model["held_out_f1"].values())


LONG = "Suppose that Marwick decided to extend library hours on Sundays since the last municipal budget. Now consider the cost of rent for a family flat in Torville. We are interested in your household, not in seasonal farm workers from Zorgard."


def test_overlaps(spark):
    label = "Support for the Halteville broadband fund in Kelsoney"
    other = LONG.replace("Marwick", "Belmont").replace("Torville", "Quinport").replace("Zorgard", "Ardlac")
    turned = LONG.split(". ")
    turned = ". ".join([turned[1], turned[2].rstrip("."), turned[0]]) + "."
    train = [
        ("a", label, LONG), ("b", "", f"{label} - {LONG}"), ("c", label.upper(), LONG.upper()), ("d", label, turned), ("e", label, LONG.replace("library", "libary").replace("Sundays", "Sundasy")),
        ("f", label, "[ASK ALL] " + LONG), ("g", label, other), ("h", "Stock label", "Short one?"), ("i", None, None), ("j", "", ""),
    ]
    test = [("t1", label, LONG), ("t2", "Stock label", "Short one?"), ("t3", None, "Nothing alike at all here"), ("t4", label, LONG)]
    rows = [(n, a, b, "train") for n, a, b in train] + [(n, a, b, "test") for n, a, b in test] + [("x", label, LONG, "drop"), (None, label, LONG, "train")]
    df = spark.createDataFrame(rows + rows[:2], "variable_name string, label string, question string, split string").withColumn("cls", F.lit(0))
    got = {(r["held_name"], r["corpus_name"]) for r in overlap.overlapping_records(df).collect()}
    assert got == {(t, n) for t in ("t1", "t4") for n in "abcdef"} | {("t2", "h")}
    assert overlap.overlapping_records(df.limit(0)).count() == 0


def test_overlaps_as_many_edits_as_count(spark):
    ws = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    rows = []
    for n in (6, 12, 18, 24, 48, 60, 96, 120):
        k = overlap.edits(n)
        far = [f"x{w}" if i % (n // k) == n // k // 2 and i // (n // k) < k else w for i, w in enumerate(ws[:n])]
        assert sum(a != b for a, b in zip(ws, far)) == k
        rows += [(f"t{n}", "", " ".join(ws[:n]), "test"), (f"r{n}", "", " ".join(far), "train")]
    df = spark.createDataFrame(rows, "variable_name string, label string, question string, split string")
    got = {(r["held_name"], r["corpus_name"]) for r in overlap.overlapping_records(df).collect()}
    assert got == {(f"t{n}", f"r{n}") for n in (6, 12, 18, 24, 48, 60, 96, 120)}


def test_overlaps_of_short_texts(spark):
    ws = [f"word{chr(97 + i)}" for i in range(20)]
    rows = []
    for n, changed in ((8, [4]), (12, [5, 6])):
        own = [f"{w}{n}" for w in ws[:n]]
        rows.append((f"t{n}", "", " ".join(own), "test"))
        rows.append((f"r{n}", "", " ".join(f"x{w}" if i in changed else w for i, w in enumerate(own)), "train"))
    df = spark.createDataFrame(rows, "variable_name string, label string, question string, split string")
    assert {tuple(r) for r in overlap.overlapping_records(df).collect()} == {("t8", "r8"), ("t12", "r12")}


def test_segments_cost_least():
    rng = random.Random(6)
    for _ in range(100):
        size, m = rng.randrange(1, 4), rng.randrange(1, 4)
        cost = [rng.randrange(9) for _ in range(m * size - size + 1 + rng.randrange(4))]
        sets = [c for c in itertools.combinations(range(len(cost)), m) if all(b - a >= size for a, b in zip(c, c[1:]))]
        got = overlap.cheapest(cost, size, m)
        assert tuple(got) in sets and sum(cost[i] for i in got) == min(sum(cost[i] for i in c) for c in sets)


def test_banded():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randrange(9))]
        b = [rng.choice("abc") for _ in range(rng.randrange(9))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        for k in (0, 2, 9):
            found = overlap.banded(a, b, k)
            assert (found is not None) == (row[-1] <= k) and (found is None or len(found) == row[-1])


ITEM = (
    "The parish archivist at Kellutonne had changed their minds twice about an elected sheriff for greater Grinuvane. Grandparents minding infants in Lanzunelle "
    "ranked as their least urgent priority electronic ballots tested at Haldevane arena. Hikers camping below Zorbivane ridge hoped an independent auditor would examine "
    "the abolition of Tamfadale school trustees."
)


def test_leaks(spark):
    ws = ITEM.split()
    noise = "Nothing of this is in any item, whatever one may think of it after a long and dull evening. "
    holds = {
        1: ITEM, 2: noise + " ".join(ws[10:34]) + " " + noise, 3: " ".join(w.upper() for w in ws[:30]), 4: "> " + "\n> ".join(" ".join(ws[i : i + 5]) for i in range(5, 40, 5)),
        5: " ".join("some" if i % 9 == 4 else w for i, w in enumerate(ws)), 6: " ".join(ws[:15]) + " " + " ".join(noise.split()[:9]) + " " + " ".join(ws[15:35]),
        7: noise * 3000 + ITEM, 8: " ".join(w[:-2] + w[-1] if len(w) > 6 and i % 6 == 0 else w for i, w in enumerate(ws)), 20: ITEM.replace("é", "e").replace(",", ""),
        21: " ".join(ws[:16]) + " " + noise * 30 + " ".join(ws[16:40]),
    }
    free = {
        9: None, 10: "", 11: "  ", 12: noise, 13: " ".join(ws[:12]), 14: "The parish archivist at Dorbaville had changed their minds twice about an elected sheriff for greater Marwick.",
        15: " ".join(reversed(ws)),
    }
    docs = spark.createDataFrame([(i, t) for i, t in (holds | free).items()] + [(1, ITEM)], "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    filler = ["Members of the Halteney curling club admitted knowing almost nothing on reopening the quarry that scarred Saumobec after a very long and public debate in town"]
    items = spark.createDataFrame([(1, ITEM), (2, filler[0]), (3, None), (4, "too short"), (1, ITEM)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(docs, items).collect()}
    assert got == {(i, 1) for i in holds}
    assert leaks.leaked_items(docs.limit(0), items).count() == 0
    assert leaks.leaked_items(docs, items.limit(0)).count() == 0


def test_repetitions_follow_the_target_recall():
    texts = [ITEM.lower().split()] * 3
    few, low = leaks.repetitions_for(texts, 0.8, 5, 5)
    many, high = leaks.repetitions_for(texts, 0.97, 5, 5)
    assert few <= many and low >= 0.8 and high >= 0.97
    assert leaks.repetitions_for([["short"]], 0.9, 5, 5)[0] == 1


def test_recall_of_noisy_leaks(spark):
    rng = random.Random(6)
    ws = ITEM.split()
    docs = []
    for i in range(150):
        at, n = rng.randrange(0, 10), rng.randrange(28, 40)
        part = [rng.choice(["some", "each"]) if rng.random() < 0.1 else w for w in ws[at : at + n]]
        docs.append((i, "Before that nothing happened here. " + " ".join(part) + " and nothing after."))
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), items).count()
    assert got >= 0.9 * len(docs)


def test_residue(spark):
    plain = "Respondents mentioned the ferry without being prompted. Trust in the council fell by 12 points. On balance, the letter came from Marwick, unsigned."
    bad = {
        1: "404 Not Found", 2: plain + " Please enable JavaScript to continue.", 3: "Dear {{ first_name }}, thank you. " + plain, 4: "Lorem ipsum dolor sit amet, vestriba colunt.",
        5: "Votre session a expiré. Veuillez vous reconnecter.", 6: "According to [INSERT RIDING NAME], the results were mixed.", 7: plain * 400 + "\nInternal Server Error.",
        8: '{"status": 502, "message": "Bad Gateway"}', 9: "Signed: %(province)s", 10: "La part des indécis était de [À COMPLÉTER].",
    }
    good = {
        20: None, 21: "", 22: " \n", 23: plain, 24: "Brackets such as [laughs] or [pause] mark reactions in this transcript.", 25: "<|endoftext|>",
        26: "The web form in Marwick kept showing a 404 page, so my father gave up and phoned instead.", 27: "Profile:\n- Age: 48\n\nR:",
        28: "Budget lines (in $1,000): {roads: 18, parks: 7, clinics: 12}.", 29: "Access was denied to observers in Marwick, according to the minutes.",
    }
    rows = [(i, t, f"s{i % 3}") for i, t in (bad | good).items()] + [(100 + i, plain, f"s{i % 4}") for i in range(200)] + [(1, bad[1], "s1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("d", F.lit("clash"))
    got = [r[0] for r in residue.with_residue(df).collect()]
    assert sorted(got) == sorted(bad)
    assert residue.with_residue(df.limit(0)).count() == 0


def test_normal_forms():
    assert repair("QuÃ©bec Â½ Québec") == "Québec ½ Québec" and fold("Œuvre ÉTÉ ﬁ") == "oeuvre ete fi"
    assert words("L'hôpital d’Oka, Saint-Jean") == ["lhopital", "doka", "saint", "jean"] and words(None) == []
    assert damerau("teh", "the", 2) == 1 and damerau("", "abc", 5) == 3 and damerau("abc", "xyz", 1) == 2


def test_a_response_is_read_once_for_all_questions(monkeypatch):
    """Words, readings and hits of entries depend on the response and the lists only, not on the question."""
    seen = {"readings": 0, "nearly": 0}
    for name in seen:
        plain = getattr(defects, name)
        monkeypatch.setattr(defects, name, lambda *a, _n=name, _f=plain: (seen.__setitem__(_n, seen[_n] + 1), _f(*a))[1])
    known, text = defects.Known(), "I would rather not discuss the matter of roads, sorry"
    lists = ('["Very happy (1)", "Not happy at all (2)"]', '["Très content (1)", "Pas content (2)"]')
    first = defects.features(text, "EN", defects.Question(*lists, "Roads", "How are the roads?", None, None), known)
    once = dict(seen)
    second = defects.features(text, "EN", defects.Question(*lists, "Snow", "Is there snow?", None, None), known)
    assert once["readings"] == 1 and once["nearly"] > 0 and seen == once
    assert first != second  # the questions still count


def test_bounded_edits_equal_whole_ones():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        whole = Edits(a).to(b, 99)
        assert all(Edits(a).to(b, k) == min(whole, k + 1) for k in range(6))
