"""Question embeddings through a pluggable encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.text import best_text, embedding_input
from panelforge.sources.io import guard_column

#: Takes a batch of texts and gives one vector per text.
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(texts: list[str], dims: int = 64) -> np.ndarray:
    """Deterministic stand-in for a sentence encoder: signed counts of hashed words, scaled to length one."""
    out = np.zeros((len(texts), dims), dtype="f4")
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
            out[i, h % dims] += 1 if h >> 63 else -1
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def embed_questions(questions: DataFrame, encoder: Encoder = hashing_encoder, batch: int = 32, force: bool = False) -> DataFrame:
    """questions with embedding (array<float>): the encoder's vector of each question's text and terms.

    An embedding that is already there is an error unless forced. Texts go to the encoder in batches; an
    encoder that loads a model should do so once per process.
    """
    base = guard_column(questions, "embedding", force)
    text = embedding_input(best_text(F.col("label"), F.col("question"), F.col("variable_name")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b.pop("_text").fillna("").tolist()
            parts = [np.asarray(encoder(texts[i : i + batch]), dtype="f4") for i in range(0, len(texts), batch)]
            yield b.assign(embedding=list(np.concatenate(parts)) if parts else [])

    return base.withColumn("_text", text).mapInPandas(encode, f"{schema}, embedding array<float>")
