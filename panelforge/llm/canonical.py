"""Mapping typed answers to the entries of their option list (problem 1)."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.answers import (
    bare,
    bare_code,
    copied,
    is_empty,
    parse_list,
    readings,
    sources_of,
)
from panelforge.llm.normal import Edits, Memo, damerau, words
from panelforge.llm.thesaurus import LINES, Rewriter, Thesaurus
from panelforge.session import cut


#: Words without weight of their own in a name.
ARTICLES = frozenset(["the", "a", "an", "le", "la", "les", "l", "de", "du", "des", "d", "of", "or", "ou", "to"])
#: Words that say nothing about which entry is meant, in English and French.
FUNCTION_WORDS = frozenset(
    "a an the of or to and in on at for it its is are was be been i im ill id me my we our you your he she they that this there "
    "would will do does did have has as so just really very much le la les l un une de du des d et ou a au aux en dans sur pour "
    "par ce cest ca il elle on je jai me ma mon mes nous notre vous votre ils elles que qui est sont etait serait y se sa son ses".split()
)
#: How much such a word weighs beside one that the vocabulary of a list lacks and that no other list's answers have.
LITTLE = 0.15
#: What parts an entry that names several things; each of them stands for it.
_EITHER = re.compile(r"\s*/\s*|\s+(?:or|ou)\s+", re.IGNORECASE)


class Entries:
    """The entries of one question in both languages, as weighted words; the parts of `A or B` stand for it too."""

    def __init__(self, lists: tuple[tuple[tuple[int, str, int | None], ...], ...]):
        self.entries: list[tuple[int, tuple[str, ...]]] = []
        self.codes: dict[int, int] = {}
        for found in lists:
            for place, label, code in found:
                for text in (label, *(_EITHER.split(label) if _EITHER.search(label) else ())):
                    ws = tuple(words(text))
                    if ws and (place, ws) not in self.entries:
                        self.entries.append((place, ws))
                if code is not None:
                    self.codes.setdefault(code, place)
        if not self.codes:
            self.codes = {place + 1: place for place, _ in self.entries}
        df = Counter(w for _, ws in self.entries for w in set(ws))
        n = len(self.entries)
        self.idf = {w: math.log(1 + n / c) * (0.3 if w in ARTICLES else 1.0) for w, c in df.items()}
        self.unknown = math.log(1 + n)
        self.norm = [math.sqrt(sum(self.idf[w] ** 2 for w in set(ws))) for _, ws in self.entries]
        self.sets = [frozenset(ws) for _, ws in self.entries]
        self.exact = {}
        for place, ws in self.entries:
            self.exact.setdefault("".join(ws), place)
        self.text = [(place, "".join(ws)) for place, ws in self.entries]
        self.padded = [f" {' '.join(ws)} " for _, ws in self.entries]
        #: by initials, the entries of three words or more that have them, with and without articles
        self.initials: dict[str, list[tuple[int, frozenset[str]]]] = {}
        for place, ws in self.entries:
            for names in {ws, tuple(w for w in ws if w not in ARTICLES)}:
                if len(names) > 2:
                    self.initials.setdefault("".join(w[0] for w in names), []).append((place, frozenset(names)))
        #: all of them in one text, each after a line break, and those of two words or more by their number of words
        self.lines = "".join(f"\n{t}" for _, t in self.text)
        self.of_size: dict[int, list[tuple[str, ...]]] = {}
        for _, ws in self.entries:
            if len(ws) > 1:
                self.of_size.setdefault(len(ws), []).append(ws)
        self.most = max((len(t) * 7 // 6 + 1 for _, t in self.text), default=0)
        self.rewriters: dict[int, Rewriter] = {}

    def rewritten(self, ws: list[str], thesaurus: Thesaurus) -> list[list[str]]:
        """ws with expressions put in words of the entries."""
        if id(thesaurus) not in self.rewriters:
            self.rewriters = {id(thesaurus): thesaurus.within(self.idf)}
        return self.rewriters[id(thesaurus)](ws)

    def soft_tfidf(self, ws: list[str], repairs: "Repairs") -> list[tuple[float, int]]:
        """(score, place) of every entry that shares a word after repair, best first.

        A word of the vocabulary stands for itself. Any other one has the vocabulary words near it with
        their similarity, or none; then it only weighs on the response's length, by its own weight, as
        words said again do.
        """
        links, size = [], 0.0
        for w, times in Counter(ws).items():
            if w in self.idf:
                links.append((self.idf[w], {w: 1.0}))
            elif near := repairs.near.get(w):
                links.append((max(self.idf[v] for v in near), near))
            else:
                links.append((self.unknown * repairs.weight(w), {}))
            size += times * links[-1][0] ** 2
        size = math.sqrt(size) or 1.0
        best: dict[int, float] = {}
        for (place, _), entry, norm in zip(self.entries, self.sets, self.norm):
            total = 0.0
            for weight, near in links:
                # several readings of one word count for the closest of them in this entry
                total += max((weight * self.idf[v] * s for v, s in near.items() if v in entry), default=0.0)
            if total:
                best[place] = max(best.get(place, 0.0), total / (size * norm))
        return sorted(((s, p) for p, s in best.items()), key=lambda x: (-x[0], x[1]))


@Memo
def entries_of(options: str | None, options_fr: str | None) -> Entries:
    return Entries((parse_list(options), parse_list(options_fr)))


class Repairs:
    """What is known of the words of a response that its list's vocabulary lacks."""

    def __init__(self, near: dict[str, dict[str, float]] | None = None, weights: dict[str, float] | None = None):
        self.near, self.weights = near or {}, weights or {}

    def weight(self, word: str) -> float:
        return LITTLE if word in FUNCTION_WORDS or word[0].isdigit() else self.weights.get(word, 1.0)


def carrier_weight(answers: int, holding: int) -> float:
    """The weight of a word that no list has, from the answers with it and those of them that hold a whole entry.

    What mostly stands beside entries is a way of putting an answer and comes out near 0; what is used
    without any says something of its own.
    """
    return (answers - holding + 1) / (answers + 1)


def shortens(short: str, long: str) -> bool:
    """True if short is a beginning of long, or its letters with some left out inside."""
    if short == long or long.startswith(short):
        return True
    if short[0] != long[0] or short[-1] != long[-1] and short[-1] != "t":
        return False
    letters = iter(long)
    return all(c in letters for c in short)


def nearby(word: str, vocabulary: dict[str, float], candidates: list[str]) -> dict[str, float]:
    """The vocabulary words that a word may stand for, with their similarity.

    candidates are those within the edit distance of the join; besides them a word may shorten another.
    """
    near = {}
    for v in candidates:
        d = damerau(word, v, allowed(len(v)))
        if d <= allowed(len(v)):
            near[v] = 1 - d / max(len(v), len(word))
    if not near:
        for v in vocabulary:
            if v in ARTICLES or v.isdigit():
                continue
            if len(word) < len(v) and shortens(word, v) or min(len(word), len(v)) > 3 and word.startswith(v):
                near[v] = 0.9
    return near


def initials(ws: list[str], e: "Entries") -> int | None:
    """The place of the only entry whose initials ws begins with, alone or before more of its words."""
    places = {place for place, names in e.initials.get(ws[0], ()) if len(ws) == 1 or not names.isdisjoint(ws[1:])}
    return places.pop() if len(places) == 1 else None


def misspelt(text: str, e: "Entries") -> int | None:
    """The place of the entry nearest to text by edits, if within a sixth of its letters and no tie."""
    if len(text) > e.most:
        return None
    best: dict[int, int] = {}
    own = None
    for place, entry in e.text:
        k = max(1, len(entry) // 6) if len(entry) > 3 else 0
        if abs(len(entry) - len(text)) > k:
            continue
        own = own or Edits(text)
        d = own.to(entry, k)
        if d <= k:
            best[place] = min(best.get(place, 99), d)
    if not best:
        return None
    low = min(best.values())
    places = [p for p, d in best.items() if d == low]
    return places[0] if len(places) == 1 else None


def prefix_of(text: str, e: Entries) -> int | None:
    """The place of the only entry that begins with text, which breaks off; None if none or several do."""
    if len(text) < 2:
        return None
    places = {place for place, t in e.text if t.startswith(text) and t != text}
    return places.pop() if len(places) == 1 else None


def choose(
    response: str, options: str | None, options_fr: str | None, sources: tuple[str | None, ...],
    repairs: Repairs, accept: float = 0.72, margin: float = 0.04, thesaurus: Thesaurus = Thesaurus(),
) -> int:
    """The place of the entry a response means, or -1.

    An entry as it stands and a bare code need no ranking. Every other reading is repaired word by word
    and ranked against all entries by soft TF-IDF; the best is taken from accept on, if it leads by margin.
    What no reading decides may still be a name's initials, an entry misspelt across its blanks, or the
    beginning of one entry only, unless it repeats the question.
    """
    e = entries_of(options, options_fr)
    if not e.entries:
        return -1
    code = bare_code(bare(response)) if bare(response) else None
    if code is None:
        code = bare_code(response)
    ways = readings(response)
    if code is not None and not any("".join(ws) in e.exact for ws, _ in ways):
        return e.codes.get(code, -1)
    for ws, _ in ways:
        if (place := e.exact.get("".join(ws))) is not None:
            return place
    best = (0.0, -1)
    for trust, ws in [*((1.0, ws) for ws, _ in ways), *((0.97, x) for ws, _ in ways for x in e.rewritten(ws, thesaurus))]:
        scores = e.soft_tfidf(ws, repairs)
        if scores and trust * scores[0][0] >= max(accept, best[0]):
            if len(scores) == 1 or scores[0][0] - scores[1][0] >= margin:
                best = (trust * scores[0][0], scores[0][1])
    if best[1] >= 0:
        return best[1]
    if copied(words(response), sources_of(*sources)):
        return -1
    for find in (lambda ws: initials(ws, e), lambda ws: misspelt("".join(ws), e), lambda ws: prefix_of("".join(ws), e)):
        for ws, _ in ways:
            if (place := find(ws)) is not None:
                return place
    return -1


def allowed(length: int) -> int:
    """Edits by which a word may differ from a vocabulary word of this length."""
    return 1 if length <= 5 else 2 if length <= 10 else 3


def raw_entries(stored: str | None) -> set[str]:
    try:
        found = json.loads(stored) if stored else []
    except ValueError:
        return set()
    return {x for x in found if isinstance(x, str)} if isinstance(found, list) else set()


def open_words(response: str, options: str | None, options_fr: str | None) -> tuple[list[str], bool]:
    """Words of a response that the vocabulary of its list lacks, and whether it holds a whole entry besides them.

    None if the response is settled without them.
    """
    e = entries_of(options, options_fr)
    if is_empty(response) or any("".join(ws) in e.exact for ws, _ in readings(response)):
        return [], False
    ws = words(response)
    line = f" {' '.join(ws)} "
    found = sorted({w for w in ws if w not in e.idf and w not in FUNCTION_WORDS and not w[0].isdigit()})
    return found, bool(found) and any(f" {' '.join(entry)} " in line for _, entry in e.entries)


def map_to_entries(samples: DataFrame, questions: DataFrame, expressions: str = LINES) -> DataFrame:
    """question, sample_idx, option_pos of every key of samples that has to be mapped.

    Left out are empty responses (nothing visible, marks, stand-ins for missing, NULL) and those that are,
    character for character, an entry of the list of their language. option_pos is the place in the stored
    array of the entry meant, in whichever language, or -1. Exact repeats of a row count once; if a key has
    several responses the first by time and text stands. A question without a readable list maps to -1.
    `_TEXT` entries are never meant. Texts of any length are read whole.

    Token-level repair: each distinct word that a list's vocabulary lacks is joined with that vocabulary by
    edit distance, in the JVM, once per list and not once per row; a word may also shorten one of the
    vocabulary. Expressions of the same meaning (`expressions`, see thesaurus.py; "" for none) give further
    readings in words of the vocabulary. The repaired words rank the complete entries by soft TF-IDF (see
    choose). How much a word counts that no list has is learnt from all answers: words that mostly stand
    beside a whole entry only carry it (carrier_weight). Everything runs once per distinct response of a
    question; the result is joined back to the rows. Hot questions and lists are left to the adaptive join.
    """
    thesaurus = Thesaurus(expressions)
    rows = samples.select("question", "sample_idx", "survey_language", "simulated_response", "collected_at")
    keys = (
        rows.where("question is not null and sample_idx is not null and simulated_response is not null")
        .groupBy("question", "sample_idx")
        .agg(
            F.min_by(
                F.struct("survey_language", "simulated_response"), F.struct("collected_at", "simulated_response")
            ).alias("x")
        )
        .select("question", "sample_idx", "x.*")
        .withColumn("unit", F.md5(F.concat_ws("\u0001", "question", "simulated_response")))
    )
    lists = questions.select(
        F.col("variable_name").alias("question"), "options", "options_fr", "label", F.col("question").alias("asked"),
        "label_fr", "question_fr",
    ).dropDuplicates(["question"])
    lists = lists.withColumn(
        "list", F.md5(F.concat_ws("\u0001", F.coalesce("options", F.lit("")), F.coalesce("options_fr", F.lit(""))))
    )
    units = cut(keys.select("unit", "question", F.col("simulated_response").alias("response")).distinct())
    offered = lists.select("question", "list", "options", "options_fr")

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [open_words(*x) for x in zip(b["response"], b["options"], b["options_fr"])]
            yield pd.DataFrame(
                {"unit": b["unit"], "list": b["list"], "words": [x for x, _ in found], "holds": [x for _, x in found]}
            )

    def vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = [sorted(entries_of(*x).idf) for x in zip(b["options"], b["options_fr"])]
            yield pd.DataFrame({"list": b["list"], "vocabulary": known})

    # the vocabulary join, the counts and the rows read these words, so they are written once
    unknown = cut(
        units.join(offered, "question").select("unit", "list", "response", "options", "options_fr")
        .mapInPandas(opened, "unit string, list string, words array<string>, holds boolean")
        .select("unit", "list", "holds", F.explode("words").alias("word"))
    )
    vocab = (
        offered.join(units.select("question").distinct(), "question", "left_semi").select("list", "options", "options_fr").dropDuplicates(["list"])
        .mapInPandas(vocabulary, "list string, vocabulary array<string>")
    )
    counts = unknown.groupBy("word").agg(F.count(F.lit(1)).alias("answers"), F.sum(F.col("holds").cast("bigint")).alias("holding"))
    # a swap of neighbours counts 2 here and 1 in the exact check, so the bound is wider
    bound = lambda v: F.when(F.length(v) <= 5, 2).when(F.length(v) <= 10, 3).otherwise(4)
    met = (
        unknown.select("list", "word").distinct().join(vocab, "list").join(counts, "word")
        .withColumn(
            "candidates",
            F.filter(
                "vocabulary",
                lambda v: (F.abs(F.length(v) - F.length("word")) <= 3)
                & (F.length("word") > 2) & (F.length(v) > 2)
                & (F.levenshtein(F.col("word"), v) <= bound(v)),
            ),
        )
    )

    def repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = [nearby(w, v, c) for w, v, c in zip(b["word"], b["vocabulary"], b["candidates"])]
            weight = [carrier_weight(n, h) for n, h in zip(b["answers"], b["holding"])]
            out = b[["list", "word"]].assign(near=[list(x) for x in near], alike=[list(x.values()) for x in near], weight=weight)
            # a word that is near none and always stands alone weighs 1, as one that is not told
            yield out[[bool(x) or w < 1 for x, w in zip(near, weight)]]

    fixes = (
        unknown.select("unit", "list", "word")
        .join(met.mapInPandas(repaired, "list string, word string, near array<string>, alike array<double>, weight double"), ["list", "word"])
        .groupBy("unit")
        .agg(F.collect_list(F.struct("word", "near", "alike", "weight")).alias("fixes"))
    )

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                told = r.fixes if r.fixes is not None else ()
                repairs = Repairs(
                    {x["word"]: dict(zip(x["near"], x["alike"])) for x in told if len(x["near"])},
                    {x["word"]: x["weight"] for x in told},
                )
                empty = is_empty(r.response)
                place = -1
                if not empty and (r.options or r.options_fr):
                    sources = (r.label, r.asked, r.label_fr, r.question_fr)
                    place = choose(r.response, r.options, r.options_fr, sources, repairs, thesaurus=thesaurus)
                out.append(
                    (
                        r.unit, empty, r.response in raw_entries(r.options), r.response in raw_entries(r.options_fr),
                        bool(r.options_fr and r.options_fr.strip()), place,
                    )
                )
            yield pd.DataFrame(out, columns=["unit", "empty", "in_en", "in_fr", "has_fr", "option_pos"])

    places = (
        units.join(fixes, "unit", "left").join(lists.drop("list"), "question", "left").drop("question")
        .mapInPandas(
            mapped,
            "unit string, empty boolean, in_en boolean, in_fr boolean, has_fr boolean, option_pos bigint",
        )
        .where("not empty")
    )
    french = F.upper(F.coalesce("survey_language", F.lit(""))).startswith("FR") & F.col("has_fr")
    return (
        keys.join(places, "unit")
        .where(~F.when(french, F.col("in_fr")).otherwise(F.col("in_en")))
        .select("question", "sample_idx", "option_pos")
    )
