"""Top N, components, tokenizer and vectors against brute force and on edge rows."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.llm import bpe, components, forest, topn


def test_top_n_hot_and_cold(spark):
    rng = random.Random(1)
    rows = [(f"g{min(rng.randrange(12), 3)}", f"i{rng.randrange(400)}", rng.choice([0.1, 0.5, 0.9, rng.random()])) for _ in range(6000)]
    rows += [("g9", "x", None), ("g9", "y", float("nan")), (None, "z", 1.0), ("g8", None, 1.0), ("g7", "a", -0.0), ("g7", "b", 0.0), ("g6", "u", float("inf"))]
    df = spark.createDataFrame(rows, "g string, i string, s double").withColumn("rank", F.lit("clash"))
    best = {}
    for g, i, s in rows:
        if g and i and s is not None and s == s:
            best[g, i] = max(s, best.get((g, i), -9))
    want = set()
    for g in {g for g, _ in best}:
        order = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:7]
        want |= {(g, i, r) for r, (_, i) in enumerate(order, 1)}
    for hot in (100, 10**6):
        got = topn.top_n_per_group(df, "g", "i", "s", 7, hot_rows=hot)
        assert {(r["g"], r["i"], r["rank"]) for r in got.collect()} == want
    assert topn.top_n_per_group(df.limit(0), "g", "i", "s").count() == 0


def brute_components(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(110)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(300)] + [("solo", "solo")]
    df = spark.createDataFrame(edges + [(None, "x")], "a string, b string")
    got = {r["node"]: r["component"] for r in components.connected_components(df, "a", "b").collect()}
    assert got == brute_components(edges)
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def test_torn_records(spark):
    rows = [
        ("a_1", "train", "Dom x"), ("A_2", "train", " dom-X "), ("b", "test", "DOM_X"), ("c", "train", None), ("d_1", "train", "e"), ("d_2", "train", "f"),
        ("k", "test", "f"), ("l", "drop", "e"), (None, "train", "e"), ("m", None, "solo"), ("a_1", "train", "Dom x"),
    ]
    df = spark.createDataFrame(rows, "variable_name string, split string, thematic_domain string").withColumn("component", F.lit(1))
    records = components.related_records(df)
    assert {r[0] for r in components.torn_records(records).collect()} == {"a_1", "A_2", "b", "d_1", "d_2", "k"}
    split = components.assign_splits(records)
    per = split.groupBy("component").agg(F.countDistinct("assigned_split").alias("n"))
    assert per.where("n > 1").count() == 0
    many = spark.range(4000).select(F.col("id").cast("string").alias("component"))
    share = {r["assigned_split"]: r["count"] / 4000 for r in components.assign_splits(many).groupBy("assigned_split").count().collect()}
    assert share["train"] == pytest.approx(0.8, abs=0.03) and share["test"] == pytest.approx(0.1, abs=0.02)
    assert components.related_records(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_TOKENIZER), reason="no tokenizer file")
def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    texts = [
        None, "", " ", "  \n\t x", "Hello, it's <|endoftext|> l'été 12345 中文 🙂 ﬁ", "aaaaaaaaaaaaa abababababab", "Don'T WE'LL", "\u200bé", "word " * 20_000,
        "\u200b zero\xa0width ½ № ’s",
    ]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab cé'\n1中") for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(0, None)], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = bpe.encode_documents(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r["doc_id"]]
        assert list(r["ids"]) == (t.encode(text, add_special_tokens=False).ids if text else [])
    assert bpe.encode_documents(df.limit(0)).count() == 0


def brute_nearest(names, x, k):
    x = np.asarray(x, dtype="f4").astype("f8")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    return {n: [names[j] for _, j in sorted((-s[i, j], j) for j in range(len(names)) if j != i)[:k]] for i, n in enumerate(names)}


def test_nearest_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    x = [list(map(float, base[i % 40] + 0.3 * rng.normal(size=8))) for i in range(900)]
    x += [x[0]] * 30 + [[2 * v for v in x[1]]]  # copies, and one of another length
    names = [f"v{i:04d}" for i in range(len(x))]
    rows = list(zip(names, x)) + [(names[0], x[0]), ("zero", [0.0] * 8), ("short", [1.0]), ("none", None), (None, x[3]), ("nan", [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "name string, v array<float>").withColumn("id", F.lit(0))
    want = brute_nearest(names, x, 5)
    exact = forest.nearest_vectors(df, "name", "v", dims=8, candidates=10**9)  # every row ascends to the empty prefix
    got = {}
    for r in exact.collect():
        got.setdefault(r["name"], {})[r["rank"]] = r["neighbor"]
    assert {n: [d[i] for i in sorted(d)] for n, d in got.items()} == want
    rough = {(r["name"], r["neighbor"]) for r in forest.nearest_vectors(df, "name", "v", dims=8, trees=30, candidates=600).collect()}
    truth = {(n, m) for n, ms in want.items() for m in ms}
    assert len(rough & truth) / len(truth) >= 0.9
    tiny = forest.nearest_vectors(df.where("name in ('v0005', 'v0006')"), "name", "v", dims=8).collect()
    assert {(r["name"], r["neighbor"]) for r in tiny} == {("v0005", "v0006"), ("v0006", "v0005")}
    assert forest.nearest_vectors(df.limit(0), "name", "v", dims=8).count() == 0


def test_large_tables_are_routed_to_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = [list(map(float, base[i % 60] + 0.4 * rng.normal(size=16))) for i in range(1500)]
    names = [f"v{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame(list(zip(names, x)), "name string, v array<float>")
    assert forest.group_count(1500, 60, 600, 0.95, 0.73, 400)[1] == 2
    near = forest.nearest_vectors(df, "name", "v", dims=16, trees=60, candidates=600, block=400)
    got = {(r["name"], r["neighbor"]) for r in near.collect()}
    truth = {(n, m) for n, ms in brute_nearest(names, x, 5).items() for m in ms}
    assert len(got & truth) / len(truth) >= 0.9


def test_every_row_is_in_a_block():
    part = np.repeat([1, 2, 4], [950, 30, 200])
    df = pd.DataFrame({"part": part, "id": np.arange(len(part))})
    blocks = list(forest.blocks_of((df.iloc[i : i + 70] for i in range(0, len(df), 70)), 200))
    assert all(len(b) <= 200 and b["part"].nunique() == 1 for b in blocks)
    assert set(pd.concat(blocks)["id"]) == set(df["id"])
    assert sum(len(b) for b in blocks) > len(df)


def test_groups_in_passes(spark, monkeypatch):
    """Groups worked off one after the other give the same rows, and a large table's blocks are sent to one task each."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"v{i:04d}", rng.normal(size=8).tolist()) for i in range(600)], "name string, v array<double>")

    def near():
        return sorted(map(tuple, forest.nearest_vectors(df, "name", "v", dims=8, trees=5, candidates=60, block=200).collect()))

    groups, routing = forest.group_count(600, 5, 60, 0.95, 0.73, 200)
    assert groups > 4
    monkeypatch.setattr(forest, "GROUPS_AT_ONCE", groups)
    whole = near()
    monkeypatch.setattr(forest, "GROUPS_AT_ONCE", 2)
    assert near() == whole and {r[0] for r in whole} == {f"v{i:04d}" for i in range(600)}
    assert forest.slice_count(48_434, 1, 0, 6) == 6 and forest.slice_count(3_400_000, 4 << 6, 6, 6) == 1
