"""Encoding of texts with a public byte-level BPE tokenizer (problem 7)."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import cut, spread

#: The split pattern and the byte alphabet of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte, by its rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_merges(path: str) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]]]:
    """The id of each byte, and (rank, id) of each mergeable pair of ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    first = [0] * 256
    for char, byte in byte_alphabet().items():
        first[byte] = vocab[char]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return first, merges


def replay(words: list[str], first: list[int], merges: dict) -> list[list[int]]:
    """The ids of all words, by one replay of the merge list over all of them.

    The symbols of all words lie in one array with links to their neighbours. An inverted index from
    pair to the positions where it begins is filled once; pairs are taken in rank order, each is merged
    at all its positions from left to right, and only the two pairs that touch a merged symbol are
    entered anew. A pair made by a merge ranks after it, so one ascending pass is enough.
    """
    sym: list[int] = []
    nxt: list[int] = []
    prv: list[int] = []
    starts = []
    where: dict[tuple[int, int], list[int]] = {}
    for w in words:
        raw = w.encode("utf-8", "replace")
        p = len(sym)
        starts.append(p)
        n = len(raw)
        sym += [first[b] for b in raw]
        prv += [-1, *range(p, p + n - 1)] if n else []
        nxt += [*range(p + 1, p + n), -1] if n else []
    for i, j in enumerate(nxt):
        if j >= 0 and (pair := (sym[i], sym[j])) in merges:
            where.setdefault(pair, []).append(i)
    queue = [(merges[p][0], p) for p in where]
    heapq.heapify(queue)
    while queue:
        _, pair = heapq.heappop(queue)
        spots = where.pop(pair, None)
        if not spots:
            continue
        a, b = pair
        new = merges[pair][1]
        spots.sort()
        for i in spots:
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # a merge to the left took one of the two
            sym[i], sym[j] = new, -1
            k = nxt[i] = nxt[j]
            h = prv[i]
            if k >= 0:
                prv[k] = i
                if (q := (new, sym[k])) in merges:
                    if q not in where:
                        where[q] = []
                        heapq.heappush(queue, (merges[q][0], q))
                    where[q].append(i)
            if h >= 0 and (q := (sym[h], new)) in merges:
                if q not in where:
                    where[q] = []
                    heapq.heappush(queue, (merges[q][0], q))
                where[q].append(h)
    out = []
    for p, w in zip(starts, words):
        ids = []
        if w:
            while p >= 0:
                ids.append(sym[p])
                p = nxt[p]
        out.append(ids)
    return out


def encode_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER
) -> DataFrame:
    """id_col and ids (array<int>) of every row: no special tokens, their strings are ordinary text.

    NULL and empty texts give an empty list; repeated rows stay; texts of any length are encoded whole; an
    empty table gives an empty result.

    Every text is split into words once. A slice of rows (one Arrow batch) keeps its words in a dictionary of
    its own and its texts as places in it. The distinct words of all slices are the corpus's words: the
    merges are replayed over them, by partitions of words (see replay), so each word is merged once, not
    once per task. Their ids go back to the slices that have the word, and a slice's texts are put
    together from its dictionary. Texts move as places of two bytes a word (four in a slice of over
    65,535 words), words as dictionary entries; nothing is broadcast but the merge list (1.5 MB).
    """
    shared = df.sparkSession.sparkContext.broadcast(load_merges(tokenizer))
    kind = df.schema[id_col].dataType.simpleString()

    def split_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, task = regex.compile(SPLIT), TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            known: dict[str, int] = {}
            spots = [
                np.array([known.setdefault(w, len(known)) for w in split.findall(t)] if isinstance(t, str) and t else [], np.int64)
                for t in batch["_text"]
            ]
            wide, piece = len(known) > 65_535, (task << 24) + n
            yield pd.DataFrame(
                {
                    "piece": piece, "_id": batch["_id"], "spots": [x.astype("<u4" if wide else "<u2").tobytes() for x in spots],
                    "wide": wide, "word": None, "place": -1,
                }
            )
            yield pd.DataFrame(
                {"piece": piece, "_id": None, "spots": None, "wide": wide, "word": [w.encode("utf-8", "surrogatepass") for w in known], "place": range(len(known))}
            )

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, merges = shared.value
        for b in batches:
            ws = [bytes(w).decode("utf-8", "surrogatepass") for w in b["word"]]
            yield pd.DataFrame({"word": b["word"], "ids": replay(ws, first, merges)})

    def joined(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("place")
        lengths = words["ids"].map(len).to_numpy(np.int64)
        begins = np.cumsum(lengths) - lengths
        flat = np.concatenate(words["ids"].tolist()).astype("i4") if len(words) else np.zeros(0, "i4")
        out = []
        for spots, wide in zip(texts["spots"], texts["wide"]):
            s = np.frombuffer(spots, "<u4" if wide else "<u2").astype(np.int64)
            n = lengths[s]
            ends = np.cumsum(n)
            out.append(flat[np.repeat(begins[s] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)])
        return pd.DataFrame({"_id": texts["_id"], "ids": out})

    rows = spread(df.selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _text"))
    pieces = cut(rows.mapInPandas(split_texts, f"piece bigint, _id {kind}, spots binary, wide boolean, word binary, place int"))
    texts, entries = pieces.where("place < 0").select("piece", "_id", "spots", "wide"), pieces.where("place >= 0").select("piece", "word", "place")
    ids = entries.select("word").distinct().mapInPandas(encoded, "word binary, ids array<int>")
    known = entries.join(ids, "word").select(F.col("piece").alias("slice"), "place", "ids")
    both = texts.groupBy("piece").cogroup(known.groupBy("slice"))
    return both.applyInPandas(joined, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)
