"""Exact nearest candidate questions of stated target questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.vectors import embedding
from panelforge.session import spread


def require_columns(df: DataFrame, names: list[str]) -> None:
    """Raise if a needed column is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def similarity_index(
    questions: DataFrame, target_split: str = "test", candidate_split: str = "train", top_k: int = 5,
    exclude_same_variable: bool = True, dims: int | None = None, block_rows: int = 10_000,
) -> DataFrame:
    """The top_k candidate questions of every target by cosine similarity, ranked from 1.

    Targets are the query set: they come in blocks of block_rows rows, and only a block of that bounded
    size is broadcast. Every task multiplies it with its share of the candidates and keeps top_k per
    target, so k rows per target and task are shuffled, not all pairs. Scores are rounded to 9 decimals;
    ties go to the smaller variable name. A vector without length scores 0. Rows without an embedding are
    left out; with dims, also those of another length, while without it a mixture is an error. Raises if
    top_k < 1 or there is no target or no candidate.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    require_columns(questions, ["variable_name", "split", "thematic_domain", "embedding"])
    kind = dict(questions.dtypes)["embedding"]
    rows = questions.select(
        "variable_name", "split", "thematic_domain", embedding(F.col("embedding"), kind).alias("v")
    ).where("v is not null and variable_name is not null")
    if dims is not None:
        rows = rows.where(F.size("v") == dims)
    targets, candidates = rows.where(F.col("split") == target_split), rows.where(F.col("split") == candidate_split)
    count = targets.count()
    if count == 0:
        raise ValueError(f"no target rows of split {target_split!r}")
    if candidates.isEmpty():
        raise ValueError(f"no candidate rows of split {candidate_split!r}")
    blocks = -(-count // block_rows)
    pool = spread(candidates.select("variable_name", "v"))
    found = None
    for block in range(blocks):
        part = targets.where(F.pmod(F.xxhash64("variable_name"), F.lit(blocks)) == block).select("variable_name", "v").collect()
        names = [r["variable_name"] for r in part]
        if len({len(r["v"]) for r in part}) > 1:
            raise ValueError("target vectors of different length")
        shared = questions.sparkSession.sparkContext.broadcast((names, np.array([r["v"] for r in part], dtype="f8")))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            target_names, x = shared.value
            size = np.linalg.norm(x, axis=1, keepdims=True)
            unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
            own = np.array(target_names, dtype=object)
            for b in batches:
                if b.empty or not len(own):
                    continue
                y = np.stack(b["v"].to_numpy()).astype("f8")
                if y.shape[1] != x.shape[1]:
                    raise ValueError("vectors of different length")
                length = np.linalg.norm(y, axis=1, keepdims=True)
                y = np.divide(y, length, out=np.zeros_like(y), where=length > 0)
                cand = b["variable_name"].to_numpy()
                order = np.argsort(cand, kind="stable")
                y, cand = y[order], cand[order]
                for at in range(0, len(own), 512):
                    s = np.round(unit[at : at + 512] @ y.T, 9)
                    if exclude_same_variable:
                        s[own[at : at + 512, None] == cand[None, :]] = -9
                    k = min(top_k, s.shape[1])
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    score = np.take_along_axis(s, top, 1)
                    keep = score > -9
                    yield pd.DataFrame(
                        {
                            "target_variable_name": np.repeat(own[at : at + 512], k)[keep.ravel()],
                            "neighbor_variable_name": cand[top][keep],
                            "cosine_similarity": score[keep],
                        }
                    )

        near = pool.mapInPandas(
            best, "target_variable_name string, neighbor_variable_name string, cosine_similarity double"
        )
        found = near if found is None else found.unionByName(near)
    order = Window.partitionBy("target_variable_name").orderBy(F.desc("cosine_similarity"), "neighbor_variable_name")
    ranked = found.withColumn("neighbor_rank", F.row_number().over(order).cast("bigint")).where(F.col("neighbor_rank") <= top_k)
    about = rows.select("variable_name", "thematic_domain")
    return (
        ranked.join(about.toDF("target_variable_name", "target_thematic_domain"), "target_variable_name")
        .join(about.toDF("neighbor_variable_name", "neighbor_thematic_domain"), "neighbor_variable_name")
        .select(
            "target_variable_name", F.lit(target_split).alias("target_split"), "target_thematic_domain", "neighbor_rank",
            "neighbor_variable_name", F.lit(candidate_split).alias("neighbor_split"), "neighbor_thematic_domain", "cosine_similarity",
        )
    )
