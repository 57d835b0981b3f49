"""Evaluation texts leaking into a corpus (problem 8)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.normal import Memo, deletions, word_hash, words
from panelforge.llm.sieve import Sieve
from panelforge.session import bounded_sample, cut, spread

WINDOW = 12
#: Neighbouring words of a window that must stand side by side in some item too.
PAIRS = 3
STRETCH = 3 * WINDOW


class Embedding:
    """Random-walk embedding of word windows into Hamming space, and keys of sampled positions.

    A walk of 3 x WINDOW steps copies the word under its pointer at each step; a random bit of (step,
    word) says whether the pointer moves on. Windows within a small edit distance fall into step again
    after a difference, so they agree in most steps. Each repetition has a walk of its own and keeps
    `sample` of the steps; windows that agree in all of them share a key.
    """

    def __init__(self, repetitions: int, sample: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bits = rng.integers(1, 2**63, size=(repetitions, STRETCH), dtype=np.uint64) | np.uint64(1)
        self.mix = rng.integers(1, 2**63, size=(repetitions, STRETCH), dtype=np.uint64) | np.uint64(1)
        reach = STRETCH * 2 // 3  # later steps are often past the window's end
        self.keep = [set(rng.choice(reach, sample, replace=False).tolist()) for _ in range(repetitions)]

    def keys(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """One key per repetition and window; codes: word hashes, begins: where the windows begin."""
        out = np.zeros((len(self.keep), len(begins)), np.uint64)
        for r, kept in enumerate(self.keep):
            at = np.zeros(len(begins), np.int64)
            key = np.full(len(begins), r + 1, np.uint64)
            for j in range(max(kept) + 1):
                word = codes[begins + np.minimum(at, WINDOW - 1)]
                if j in kept:
                    key = (key ^ np.where(at < WINDOW, word, np.uint64(0))) * self.mix[r, j]
                    key ^= key >> np.uint64(29)
                at += ((word * self.bits[r, j]) >> np.uint64(63)).astype(np.int64)
            out[r] = key
        return out


def pair_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each word with the next one."""
    with np.errstate(over="ignore"):
        h = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ codes[1:]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(31))


def item_keys(ws: list[str], embedding: Embedding) -> np.ndarray:
    """The distinct keys of all windows of one item."""
    if len(ws) < WINDOW:
        return np.zeros(0, np.uint64)
    codes = np.array([word_hash(w) for w in ws], np.uint64)
    return np.unique(embedding.keys(codes, np.arange(len(ws) - WINDOW + 1)))


def likely(codes: np.ndarray, begins: np.ndarray, has_pair) -> np.ndarray:
    """The windows in which at least PAIRS words are followed by the next word as in some item."""
    inside = np.concatenate([[0], np.cumsum(has_pair(pair_hashes(codes)))]) if len(codes) > 1 else np.zeros(1, int)
    return begins[inside[begins + WINDOW - 1] - inside[begins] >= PAIRS]


def repetitions_for(texts: list[list[str]], recall: float, sample: int, seed: int, most: int = 32) -> tuple[int, float]:
    """(repetitions, recall reached): the fewest by which stretches of the items are found after edits.

    The trial stretches have 20 words of an item, with two words changed, one put in and one misspelt; they
    go through the same filter and embedding as the documents.
    """
    rng = np.random.default_rng(seed)
    whole = Embedding(most, sample, seed)
    found = np.zeros(most, bool)
    hits, trials = np.zeros(most), 0
    known = {w for ws in texts for w in ws}
    pairs = np.unique(np.concatenate([pair_hashes(np.array([word_hash(w) for w in ws], np.uint64)) for ws in texts if len(ws) > 1] or [np.zeros(0, np.uint64)]))
    has_pair = lambda h: np.isin(h, pairs)
    for ws in texts:
        if len(ws) < 20:
            continue
        codes = np.array([word_hash(w) for w in ws], np.uint64)
        own = whole.keys(codes, np.arange(len(ws) - WINDOW + 1))
        for _ in range(max(1, 400 // len(texts))):
            at = int(rng.integers(len(ws) - 19))
            part = ws[at : at + 20]
            spots = rng.choice(20, 4, replace=False)
            for i in spots[:3]:
                part[i] = f"{part[i]}x" if f"{part[i]}x" not in known else f"{part[i]}xx"
            part.insert(int(spots[3]), "xputinx")
            codes = np.array([word_hash(w) for w in part], np.uint64)
            begins = likely(codes, np.arange(len(part) - WINDOW + 1), has_pair)
            trials += 1
            if len(begins):
                keys = whole.keys(codes, begins)
                found = np.array([np.isin(keys[r], own[r]).any() for r in range(most)])
                hits += np.maximum.accumulate(found)
    if not trials:
        return 1, float("nan")
    reached = hits / trials
    r = int(np.argmax(reached >= recall)) if (reached >= recall).any() else most - 1
    return r + 1, float(reached[r])


def near_forms(item: list[str]) -> dict[str, list[int]]:
    """Where in the item each word stands, also under its forms with one letter less."""
    forms = defaultdict(set)
    for p, w in enumerate(item):
        for f in deletions(w) if len(w) > 4 else {w}:
            forms[f].add(p)
    return {f: sorted(p) for f, p in forms.items()}


forms_of = Memo(deletions, 100_000)


def rare_needed(item: list[str], rare: set[str], least: int = 20) -> int:
    """How many of an item's rare words any text that holds a stretch of it must have, see holds_stretch."""
    return min((-(-len(rare.intersection(item[p : p + least])) // 3) for p in range(len(item) - least + 1)), default=0)


def all_forms(text: list[str]) -> set[str]:
    """The words of a text and, of longer ones, the forms with one letter less."""
    own = set()
    for w in set(text):
        own.update(forms_of(w) if len(w) > 4 else (w,))
    return own


def rare_present(own: set[str], rare_forms: list[set[str]], enough: int) -> bool:
    """True if at least `enough` of the rare words stand in a text of these forms, as they are or one letter off."""
    return not enough or sum(not own.isdisjoint(forms) for forms in rare_forms) >= enough


def holds_stretch(
    text: list[str], item: list[str], near: dict[str, list[int]], rare: set[str], least: int = 20, share: float = 0.7
) -> bool:
    """True if text has a stretch of at least `least` words of item in their order.

    Sparse local alignment over equal words (or words one edit apart): a word counts 1, a word of the
    item that is missing or changed costs 1, foreign words in between cost 0.5 plus a quarter each, 3
    at most. The stretch must keep `share` of its words after costs, and, where it covers rare words of
    the item, a third of them, so that a shared sentence pattern with other names is no leak.
    """
    matches = []
    for i, w in enumerate(text):
        if w is None:
            continue
        spots = set()
        for f in forms_of(w) if len(w) > 4 else (w,):
            spots.update(near.get(f, ()))
        matches += [(i, j) for j in sorted(spots, reverse=True)]
    if len({j for _, j in matches}) < share * least:
        return False
    doc = np.array([i for i, _ in matches])
    pos = np.array([j for _, j in matches])
    score = np.ones(len(matches))
    back = np.full(len(matches), -1)
    for n in range(1, len(matches)):
        lo = 0
        dj = pos[n] - pos[lo:n] - 1
        di = doc[n] - doc[lo:n] - 1
        extra = di - dj
        cost = dj + np.where(extra > 0, np.minimum(3.0, 0.5 + 0.25 * extra), 0.0)
        gain = np.where((dj >= 0) & (di >= 0), score[lo:n] - cost, -1.0)
        if len(gain) and (best := gain.max()) > 0:
            score[n] = 1 + best
            back[n] = lo + int(gain.argmax())
    for n in np.argsort(-score):
        if score[n] < share * least:
            return False
        path, m = [], n
        while m >= 0:
            path.append(m)
            m = back[m]
        first, last = pos[path[-1]], pos[n]
        span = last - first + 1
        if span >= least and score[n] >= share * least:
            covered = {w for w in item[first : last + 1] if w in rare}
            if not covered or len({item[pos[m]] for m in path} & covered) * 3 >= len(covered):
                return True
    return False


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
    item_text: str = "text", recall: float = 0.98, sample: int = 5, seed: int = 5, trial_items: int = 200,
) -> DataFrame:
    """doc_id, item_id of every document that holds a stretch of at least 20 words of an item.

    Case, accents, punctuation, layout and mojibake do not count; single changed words, one-letter
    misspellings and insertions of any length are allowed (see holds_stretch). NULL, empty and blank texts
    hold nothing; an item of fewer than 20 words cannot leak; repeated rows give one result row.

    Windows of 12 words of every document are embedded, if some of their neighbouring words are neighbours in
    an item (see likely), and keyed by sampled steps (see Embedding). The number of repetitions follows from the
    target recall, by trial on stretches of at most trial_items items (see repetitions_for). Documents are
    read once, however many items there are: keys that no item has are sieved out in place (Sieve, bounded
    in size), the others are joined with the keys of the items by a shuffle, and every pair that shares a
    key is verified by exact alignment of the words around the shared windows.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    held = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null and t is not null")
    trial = [words(r["t"]) for r in bounded_sample(held.distinct(), "i", trial_items).collect()]
    repetitions, _ = repetitions_for(trial, recall, sample, seed)
    embedding = Embedding(repetitions, sample, seed)

    def prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ws = [words(t) for t in b["t"]]
            pairs = [pair_hashes(np.array([word_hash(w) for w in x], np.uint64)).view(np.int64) if len(x) > 1 else [] for x in ws]
            keys = [item_keys(x, embedding).view(np.int64) for x in ws]
            yield pd.DataFrame({"i": b["i"], "item": [" ".join(x) for x in ws], "pairs": pairs, "keys": keys})

    known = cut(held.distinct().mapInPandas(prepared, f"i {item_kind}, item string, pairs array<bigint>, keys array<bigint>"))
    common = known.select("i", F.explode(F.array_distinct(F.split("item", " "))).alias("w"))
    rare = common.join(common.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n <= 3"), "w").groupBy("i").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("rare"))
    owners = known.select("i", F.explode("keys").alias("key"))
    has_pair, has_key = Sieve(known.select(F.explode("pairs").alias("h")).distinct(), "h"), Sieve(owners.select("key").distinct(), "key")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                b = batch.iloc[at : at + 500]
                texts = [words(t) for t in b["t"]]
                if len(known) > 1_000_000:
                    known.clear()
                for w in {w for t in texts for w in t}:
                    if w not in known:
                        known[w] = word_hash(w)
                codes = np.array([known[w] for t in texts for w in t], np.uint64)
                ends = np.cumsum([len(t) for t in texts])
                begins = [np.arange(e - len(t), e - WINDOW + 1) for t, e in zip(texts, ends) if len(t) >= WINDOW]
                if not begins:
                    continue
                begins = likely(codes, np.concatenate(begins), lambda h: has_pair(h.view(np.int64)))
                if not len(begins):
                    continue
                hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for keys in embedding.keys(codes, begins):
                    keys = keys.view(np.int64)
                    for h in np.flatnonzero(has_key(keys)):
                        d = int(np.searchsorted(ends, begins[h], "right"))
                        hits[d].append((int(keys[h]), int(begins[h] - ends[d] + len(texts[d]))))
                if hits:
                    yield pd.DataFrame(
                        {
                            "d": b["d"].iloc[list(hits)].to_numpy(), "doc": [" ".join(texts[d]) for d in hits],
                            "keys": [[k for k, _ in x] for x in hits.values()], "places": [[p for _, p in x] for x in hits.values()],
                        }
                    )

    docs = spread(documents.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{doc_text}`").alias("t"))).where(
        "d is not null and t is not null"
    )
    likely_docs = cut(docs.mapInPandas(search, f"d {kind}, doc string, keys array<bigint>, places array<int>").withColumn("row", F.monotonically_increasing_id()))
    places = likely_docs.select("row", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("row", "x.keys", "x.places")
    pairs = (
        places.join(owners, F.col("keys") == F.col("key")).groupBy("row", "i").agg(F.array_sort(F.collect_set("places")).alias("places"))
        .join(likely_docs.select("row", "d", "doc"), "row")
        .join(known.select("i", "item"), "i")
        .join(rare, "i", "left")
    )

    # words travel as one text, not as lists, which cost more to read than to cut up again
    def item_of(text: str, rare: str) -> tuple:
        few, item = set(rare.split()), text.split()
        forms = [deletions(w) if len(w) > 4 else {w} for w in few]
        return item, near_forms(item), few, forms, rare_needed(item, few), {tuple(item[p : p + 20]) for p in range(len(item) - 19)}

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = Memo(item_of, 1000)
        # the pairs of one document come one after the other
        cut_up = Memo(lambda text: (text.split(), all_forms(text.split())), 64)
        for b in batches:
            good = []
            for r in b.itertuples():
                item, near, few, forms, enough, runs = told(r.item, r.rare or "")
                (doc, own), reach, text, last = cut_up(r.doc), 2 * len(item) + 40, [], 0
                if not rare_present(own, forms, enough):
                    good.append(False)
                    continue
                for p in r.places:  # the words around all shared windows, None where others are left out
                    lo, hi = max(last, p - reach), min(len(doc), p + reach)
                    if hi > lo:
                        text += [*([None] if lo > last else []), *doc[lo:hi]]
                        last = hi
                # an unchanged run of 20 words needs no alignment
                if not runs.isdisjoint(tuple(text[p : p + 20]) for p in range(len(text) - 19)):
                    good.append(True)
                    continue
                good.append(holds_stretch(text, item, near, few))
            yield b.loc[good, ["d", "i"]]

    found = pairs.mapInPandas(verified, f"d {kind}, i {item_kind}")
    return found.distinct().select(F.col("d").alias(doc_id), F.col("i").alias(item_id))
