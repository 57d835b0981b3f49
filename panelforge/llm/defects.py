"""Broken question and response pairs (problem 2)."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import seeds
from panelforge.llm.answers import Sources, bare, bare_code, copied, is_empty, parse_list, readings
from panelforge.llm.canonical import FUNCTION_WORDS, Entries, initials, misspelt, shortens
from panelforge.llm.linear import BITS, Sparse, best_threshold, fit, place
from panelforge.llm.normal import Memo, words
from panelforge.llm.thesaurus import Thesaurus
from panelforge.session import bounded_sample, cut

#: In the order in which they win when their margins are equal.
TYPES = ["empty", "refusal", "question_copy", "truncated", "other_language"]
RANK = {t: i for i, t in enumerate([*TYPES, ""])}
QUESTION_COLUMNS = ["options", "options_fr", "label", "asked", "label_fr", "asked_fr"]


class Recent(dict):
    """A dict of bounded size: it starts anew when it is full."""

    def __init__(self, cap: int = 20_000):
        self.cap = cap

    def room(self) -> None:
        if len(self) > self.cap:
            self.clear()


class Lists:
    """The option lists of a question in both languages; many questions share them."""

    def __init__(self, options: str | None, options_fr: str | None):
        self.of = {"EN": Entries((parse_list(options),)), "FR": Entries((parse_list(options_fr),))}
        en, fr = ({w for _, e in x.entries for w in e} for x in self.of.values())
        self.shared = en & fr
        #: types of responses that can be told from the lists alone, of late, and what entries others hit
        self.judged, self.hits = Recent(), Recent()


lists_of = Memo(Lists, 4096)


class Question:
    """What the features of a pair need of its question."""

    def __init__(self, options, options_fr, label, asked, label_fr, asked_fr):
        self.lists = lists_of(options, options_fr)
        self.sources = {"EN": Sources(label, asked), "FR": Sources(label_fr, asked_fr)}
        self.known = {k: s.known for k, s in self.sources.items()}
        self.shared = (self.known["EN"] & self.known["FR"]) | self.lists.shared
        self.judged = Recent()


question_of = Memo(Question, 2048)


EXPRESSIONS = Thesaurus()


def plainly(ws: list[str], e: Entries) -> bool:
    """True if the words are an entry, or mean one by an expression of the same meaning."""
    if "".join(ws) in e.exact:
        return True
    own = [w for w in ws if w not in FUNCTION_WORDS]
    for x in e.rewritten(ws, EXPRESSIONS):
        new = {w for w in x if w not in FUNCTION_WORDS}
        if "".join(x) in e.exact or own and any(new <= entry and len(new) * 2 > len(entry - FUNCTION_WORDS) for entry in e.sets):
            return True
    return False


def nearly(ws: list[str], e: Entries) -> bool:
    """True if the words are a misspelling or an abbreviation of an entry."""
    text = "".join(ws)
    if misspelt(text, e) is not None:
        return True
    if f"\n{text}" in e.lines:
        return False
    if initials(ws, e) is not None:
        return True
    return any(all(shortens(a, b) for a, b in zip(ws, entry)) for entry in e.of_size.get(len(ws), ()))


def _word_features(word: str, language: str) -> list[int]:
    pad = f"^{word}$"
    found = [f"{language}|{word}", f"w|{word}", *(f"{language}|{pad[i:i + 3]}" for i in range(len(pad) - 2))]
    return [place(f) for f in found]


word_features = Memo(_word_features, 100_000)


mark_place = Memo(lambda language, c: place(f"{language}|mark:{c if ord(c) < 0x250 else hex(ord(c) >> 8)}"))
MASK = (1 << BITS) - 1
code_of = Memo(lambda word: zlib.crc32(word.encode()), 200_000)
places_of = Memo(lambda name, n: [place(f"{name}#{j}") for j in range(n)])
_LETTERS = re.compile(r"[^\W\d_]+")
_LANGUAGES: dict[str, list[str]] = {}
for _name, _frequent in seeds.FREQUENT.items():
    for _word in _frequent:
        _LANGUAGES.setdefault(_word, []).append(_name)
SLOTS = 24


def speaks(ws: list[str]) -> list[str]:
    """The languages whose frequent words are the most among ws, if there are any."""
    told: dict[str, int] = {}
    for w in ws:
        for name in _LANGUAGES.get(w, ()):
            told[name] = told.get(name, 0) + 1
    most = max(told.values(), default=0)
    return [name for name, n in told.items() if n == most and (n > 1 or len(ws) < 6)]


class Known:
    """The words that something follows somewhere in all answers and questions, a word or a mark, as bits (2 MB)."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = np.zeros(1 << (SLOTS - 6), np.int64) if bits is None else bits

    def has(self, word: str) -> bool:
        slot = zlib.crc32(word.encode()) & ((1 << SLOTS) - 1)
        return bool(int(self.bits[slot >> 6]) >> (slot & 63) & 1)

    def add(self, text: str | None) -> None:
        text = (text or "").lower()
        found = _LETTERS.findall(text)
        for word in found[:-1] if text[-1:].isalpha() else found:
            slot = zlib.crc32(word.encode()) & ((1 << SLOTS) - 1)
            self.bits.view(np.uint64)[slot >> 6] |= np.uint64(1 << (slot & 63))


def known_words(texts: DataFrame, column: str) -> Known:
    """Known of all texts; what comes to the driver is bounded by the number of bits."""
    ws = F.split(F.lower(column), "[^\\p{L}]+")  # what follows the last mark is "" or the last word
    rows = texts.select(F.explode(F.slice(ws, 1, F.size(ws) - 1)).alias("w")).where("w <> ''")
    slot = F.crc32(F.col("w").cast("binary")).bitwiseAND((1 << SLOTS) - 1)
    found = (
        rows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("i"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toPandas()
    )
    out = Known()
    out.bits[found["i"].to_numpy().astype(int)] = found["bits"].to_numpy()
    return out


class Reading:
    """What the features of a pair need of its response alone."""

    def __init__(self, response: str | None):
        self.empty = is_empty(response)
        if self.empty:
            return
        self.text = text = response.strip()
        self.words = ws = words(text)
        self.ways = readings(text)
        self.joined = tuple(j for j in ("".join(w) for w, _ in self.ways) if len(j) > 1)
        self.code = bare_code(bare(text)) is not None or bare_code(text) is not None
        self.closed = text.rstrip("\"'»” )*_")[-1:] in ".!?…"
        codes = [code_of(w) for w in ws]
        self.codes = dict(zip(ws, codes))
        self.pairs = [(x * 0x9E3779B1 ^ y) >> 7 & MASK for x, y in zip(codes, codes[1:])]
        self.line = f" {' '.join(ws)} "
        self.last = _LETTERS.findall(text.lower())[-1:] if len(ws) > 1 and not self.closed else []
        self.marks = set() if text.isascii() else {c for c in text if ord(c) > 127}


reading_of = Memo(Reading, 20_000)


def hits_of(r: Reading, own: Entries, foreign: Entries) -> tuple[list[tuple[bool, bool, bool]], bool]:
    """Whether each way of reading a response hits an entry of either list, and whether one does so plainly."""
    hits = [(plainly(w, own), plainly(w, foreign), cut) for w, cut in r.ways]
    plain_hit = any(a or b for a, b, _ in hits)
    if not plain_hit:  # only then the search for misspelt ones
        hits = [(nearly(w, own), nearly(w, foreign), cut) for w, cut in r.ways]
    return hits, plain_hit


def features(response: str | None, language: str, q: Question, known: Known) -> tuple[list[int], bool]:
    """Hashed n-grams of the response, most of them together with the pair's language, and pair features.

    The flag tells whether they come from the response and the lists alone: so for empty responses and for
    those of up to five words that are plainly an entry.
    """
    r = reading_of(response)
    if r.empty:
        return places_of("empty", 6), True
    other = "FR" if language == "EN" else "EN"
    placed: list[int] = []
    strong = lambda name, n=5: placed.extend(places_of(name, n))
    ws, ways, code, closed = r.words, r.ways, r.code, r.closed
    own, foreign = q.lists.of[language], q.lists.of[other]
    if (response, language) not in q.lists.hits:
        q.lists.hits.room()
        q.lists.hits[response, language] = hits_of(r, own, foreign)
    hits, plain_hit = q.lists.hits[response, language]
    alone = plain_hit and len(ws) < 6
    hit_own, hit_other = any(a for a, _, _ in hits), any(b for _, b, _ in hits)
    whole = any((a or b) and not cut for a, b, cut in hits)
    if code:
        strong("code")
    if hit_own:
        strong("entry:own")
    if hit_other and not hit_own:
        strong("entry:other")
    if not hit_own and not hit_other and not code:
        strong("entry:none")
        for e, name in ((own, "own"), (foreign, "other")):
            begun = [j for j in r.joined if f"\n{j}" in e.lines]
            if begun and any(t.startswith(j) and t != j for j in begun for _, t in e.text):
                strong(f"begins:{name}")
    if (hit_own or hit_other) and not whole:
        shortest = min(len(w) for (w, _), (a, b, _) in zip(ways, hits) if a or b)
        strong(f"entry:more:{closed}:{min(len(ws) - shortest, 6) // 2}")
    copies = not alone and (copied(ws, q.sources["EN"]) or copied(ws, q.sources["FR"]))
    if copies:
        strong(f"copy:{whole or hit_own or hit_other}")
    if ws and not alone:
        share = sum(w in q.known["EN"] or w in q.known["FR"] for w in ws) / len(ws)
        strong(f"share:{int(share * 5)}:{min(len(ws), 8) // 4}", 1)
    size = min(len(ws), 24) // 4
    strong(f"closed:{closed}:{size}", 1)
    strong(f"size:{size}", 1)
    if not closed and len(ws) >= 6 and not hit_own and not hit_other and not copies:
        strong("open")
    shared = q.lists.shared if alone else q.shared
    plain = [w for w in ws if w not in shared and not w.isdigit()]
    for w in plain:
        placed += word_features(w, language)
    placed += r.pairs
    codes, tongue = [r.codes[w] for w in plain], code_of(language)
    placed += [(x * 0x85EBCA6B ^ y ^ tongue) >> 7 & MASK for x, y in zip(codes, codes[1:])]
    if len(ws) > 2 and not hit_own and not hit_other:
        placed.append((r.codes[ws[-1]] ^ code_of(f"last:{closed}")) & MASK)
        if ws[-1] in FUNCTION_WORDS:
            strong(f"ends in the middle:{closed}", 3)
    if r.last:
        whole_word = known.has(r.last[0])
        size = min(len(ws), 16) // 4
        strong(f"last word known:{whole_word}:{size}:{hit_own or hit_other}", 4)
    if not alone and ws:
        line = r.line
        for e, name in ((own, "own"), (foreign, "other")):
            for padded in e.padded:
                if (at := line.find(padded)) >= 0:
                    spot = "start" if not at else "end" if line[at + 1 :].count(" ") == padded.count(" ") - 1 else "inside"
                    strong(f"holds:{name}:{spot}:{closed}", 4)
                    break
    shown = [w for w in ws if w not in q.lists.shared]
    for name in speaks(shown):
        strong(f"speaks:{name}:{language}", 8)
    placed += [mark_place(language, c) for c in r.marks]
    return placed, alone


_NAMES = re.compile(r"(?<=[a-z] )[A-Z][\w-]{4,}")
_ELIDED = re.compile(r"\b([Dd]|[Nn]|[Jj]|[Qq]u|[Mm])e (?=[aeiouyhéèêàâîô])")


def misspell(rng: random.Random, text: str) -> str:
    if len(text) < 5:
        return text
    i = rng.randrange(1, len(text) - 2)
    return rng.choice(
        [text[:i] + text[i + 1 :], text[:i] + text[i] + text[i:], text[:i] + text[i + 1] + text[i] + text[i + 2 :]]
    )


def recase(rng: random.Random, text: str) -> str:
    return rng.choice([text, text, text, text.lower(), text.upper(), text.swapcase()])


def made_pairs(row: dict, language: str, rng: random.Random, others: list[dict]) -> list[tuple[str, str]]:
    """(response, type or '') examples for one question and language: usable, and each kind of defect.

    others are further questions; sentences of theirs, whole, cut off or in the other language, are answers
    beside the point.
    """
    other = "FR" if language == "EN" else "EN"
    q_lists = {"EN": parse_list(row["options"]), "FR": parse_list(row["options_fr"])}
    columns = {"EN": ("label", "asked"), "FR": ("label_fr", "asked_fr")}
    texts = {lang: [row[c] for c in cols] for lang, cols in columns.items()}
    # a name from within a sentence of another question, so that names of no list are met
    asked = [r[c] or "" for r in (rng.sample(others, min(5, len(others))) or [row]) for c in columns["EN"]]
    town = {"town": [rng.choice([m for t in asked for m in _NAMES.findall(t)] or ["Springfield"])]}
    own = Entries((q_lists[language],))
    same = {e[1] for e in q_lists["EN"]} & {e[1] for e in q_lists["FR"]}
    out: list[tuple[str, str]] = []

    def say(rules: dict, start: str = "text") -> str:
        text = seeds.made(rng, rules | town, start)
        text = _ELIDED.sub(r"\1'", text) if rules in (seeds.REFUSALS["FR"] | town, seeds.ASIDES["FR"] | town) else text
        return re.sub(r"\s+([.!,])", r"\1", re.sub(r"([,;.])(?=[^\W\d_])", r"\1 ", " ".join(text.split())))

    def refusal(lang: str) -> str:
        rules = seeds.REFUSALS[lang]
        parts = [say(rules, "open"), say(rules, "core")]
        text = " ".join(x for x in parts if x)
        more = say(rules, "more")
        text = text[0].upper() + text[1:] + rng.choice(["", "", ".", "!", f". {more}", f". {more}"])
        return text

    def around(lang: str) -> str:
        return say(seeds.AROUND[lang]).replace("@", "{}")

    def dress(label: str, code: int | None, lang: str) -> str:
        n = code or rng.randrange(1, 8)
        shape = rng.choice(
            ["{}", "{}", "{}", f"{n}: {{}}", f"{n} - {{}}", f"{n}) {{}}", f"{{}} ({n})", f"{{}} [{n}]", "**{}**", '"{}"', "« {} »", "- {}", "{} ", "{}\n", "{}!"] * 2 + [around(lang)] * 12
        )
        return shape.replace("{}", label)

    def some(found, n):
        return rng.sample(list(found), min(n, len(found)))

    def sentences(lang: str, n: int) -> list[str]:
        found = []
        for r in some(others, 3 * n):
            text = rng.choice([r[c] for c in columns[lang]]) or ""
            found += [p.strip() for p in text.split(". ") if len(p) > 30 and not p.rstrip().endswith("?")][:1]
        return found[:n]

    for _, label, code in some(q_lists[language], 4):
        out.append((dress(recase(rng, label), code, language), ""))
        out.append((misspell(rng, recase(rng, label)), ""))
        out += [(around(language).replace("{}", recase(rng, label)), "") for _ in range(2)]
        head = (rng.choice(texts[language]) or "").split(". ")[0]
        if head:
            out.append((f"{head}: {label}", ""))
        reason = rng.choice([", ", ". ", ", "]) + say(seeds.LONG[language])
        out.append((label + reason[: rng.randrange(12, len(reason) - 1)], "truncated"))
        cut = rng.randrange(2, max(3, len(label) - 1))
        if len(label) > 4 and not (plainly(words(label[:cut]), own) or nearly(words(label[:cut]), own)):
            out.append((rng.choice(["", "", "", around(language).split("{}")[0]]) + label[:cut].rstrip(), "truncated"))
    for _, label, code in some([e for e in q_lists[other] if e[1] not in same], 3):
        out.append((dress(recase(rng, label), code, other), "other_language"))
        out.append((label, "other_language"))
    n = rng.randrange(1, 9)
    out += [(rng.choice([f"{n}", f"{n}.", f"({n})", f"#{n}", f"Option {n}", f"{n})"]), "")]
    out += [(recase(rng, say(seeds.ASIDES[language])), "") for _ in range(6)]
    out += [(x + rng.choice([".", ".", ".", ".", ".", ""]), "") for x in sentences(language, 3)]
    out += [(around(rng.choice([language, other])).replace("{}", x), "") for x in some(sorted(same), 3)]  # a name is of both languages
    out += [(say(seeds.ASIDES[language], "sentence"), "") for _ in range(3)]
    out += [(x, "other_language") for x in (say(seeds.ASIDES[other]) for _ in range(5)) if len(x) > 12]
    out += [(x + rng.choice([".", ""]), "other_language") for x in sentences(other, 2)]
    out += [(say(seeds.FOREIGN), "other_language") for _ in range(3)]
    for lang in rng.sample([x for x in seeds.FREQUENT if x != language.lower()], 4):
        # frequent words in any order, so that the language is learnt and not its sentences
        mixed = [*rng.sample(seeds.FREQUENT[lang], rng.randrange(3, 7)), *(w for w in say(seeds.FOREIGN, lang).split() if rng.random() < 0.3)] if lang not in ("en", "fr") else rng.sample(seeds.FREQUENT[lang], 6)
        rng.shuffle(mixed)
        text = " ".join(mixed)
        out.append((text[0].upper() + text[1:] + rng.choice([".", ".", ""]), "other_language"))
    for long in [say(seeds.LONG[language]) for _ in range(3)] + sentences(language, 2):
        out.append((long[: rng.randrange(24, len(long))].rstrip(), "truncated"))
    for lang in (language, language, language, language, other):
        text = refusal(lang)
        out.append((rng.choice([text, text, text, text.lower()]), "refusal"))
    label, asked = texts[language]
    copies = [t for t in (label, asked, f"{label}\n\n{asked}" if label and asked else None) if t]
    if asked:
        copies += asked.split(". ")[:2]
    if label:
        copies.append(f"Question: {label}")
    for c in some(copies, 4):
        out.append((rng.choice([c, c, f'"{c}"', c.upper(), c.lower(), misspell(rng, c)]), "question_copy"))
        if len(c) > 60:
            out.append((c[: rng.randrange(40, len(c))], "question_copy"))
    out.append((rng.choice(seeds.EMPTY), "empty"))
    return out


def train(sample: DataFrame, known: Known, seed: int = 3) -> dict:
    """Weights (one row per type) and calibrated cuts, from the questions of a bounded sample.

    Examples are made from the questions themselves and the grammars of seeds.py: answers truncated, copied,
    swapped for the other language's, and refused. A fifth of the questions is held out, and each type's
    cut is calibrated there.
    """
    rows = sorted((r.asDict() for r in sample.collect()), key=lambda r: r["question"])
    x, y, held = [], [], []
    for r in rows:
        rng = random.Random(seed + place(r["question"]))
        q = Question(*(r[c] for c in QUESTION_COLUMNS))
        for language in ("EN", "FR"):
            if language == "FR" and not (r["options_fr"] or "").strip():
                continue
            for response, kind in made_pairs(r, language, rng, [o for o in rows if o is not r]):
                x.append(features(response, language, q, known)[0])
                y.append(kind)
                held.append(place("held" + r["question"]) % 5 == 0)
    held, y = np.array(held, bool), np.array(y)
    weights, cuts, quality = [], [], {}
    fitted = Sparse([f for f, h in zip(x, held) if not h])
    unseen = Sparse([f for f, h in zip(x, held) if h])
    for kind in TYPES:
        w = fit(fitted, y[~held] == kind)
        cut, f1 = best_threshold(unseen.dot(w), y[held] == kind) if held.sum() >= 200 else (0.0, float("nan"))
        weights.append(w.astype("f4"))
        cuts.append(cut)
        quality[kind] = f1
    return {"weights": np.stack(weights), "cuts": np.array(cuts), "held_out_f1": quality, "rows": len(y)}


def classify(x: list[list[int]], weights: np.ndarray, cuts: np.ndarray) -> list[str]:
    """The type of each row with the largest margin over its cut; '' for none."""
    rows = Sparse(x)
    margins = np.stack([rows.dot(w) - c for w, c in zip(weights, cuts)], axis=1)
    best = margins.argmax(1)
    return [TYPES[b] if m > 0 else "" for b, m in zip(best, margins.max(1))]


def broken_pairs(tables: dict[str, DataFrame], questions: DataFrame, sample_questions: int = 90) -> DataFrame:
    """sample_table, question, sample_idx, defect_type of every defective pair of the named sample tables.

    A table with a survey_language column is judged in French where that begins with FR and the question
    has French options, else in English. NULL responses are empty. Exact repeats give one row; if a key has
    several responses of different types, the first in the order of TYPES stands. A question that is not
    in the table of questions is judged without list and texts. Each key gets at most one type. Only the
    training sample, of at most sample_questions questions, goes to the driver; the weights (5 MB) are
    broadcast. One shuffle brings the rows of a question together with it, so a response that repeats is
    scored once per task; a hot question is split by the adaptive join. Only defective rows go on.
    """
    rows = None
    for name, df in tables.items():
        language = F.upper(F.col("survey_language")).startswith("FR") if "survey_language" in df.columns else F.lit(False)
        part = df.select(
            F.lit(name).alias("sample_table"), "question", "sample_idx", F.coalesce(language, F.lit(False)).alias("french"),
            F.col("simulated_response").alias("response"),
        )
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where("question is not null and sample_idx is not null")
    asked = questions.select(
        F.col("variable_name").alias("question"), "options", "options_fr", "label", F.col("question").alias("asked"),
        "label_fr", F.col("question_fr").alias("asked_fr"),
    )
    named = rows.select("question").distinct().join(asked.select("question").distinct(), "question", "left_semi")
    chosen = bounded_sample(cut(named), "question", sample_questions)
    texts = rows.select("response").unionByName(
        asked.select(F.explode(F.array("label", "asked", "label_fr", "asked_fr", "options", "options_fr")).alias("response"))
    )
    known = known_words(texts, "response")
    model = train(asked.join(F.broadcast(chosen), "question", "left_semi").dropDuplicates(["question"]), known)
    shared = questions.sparkSession.sparkContext.broadcast((model["weights"], model["cuts"], known))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, cuts, seen = shared.value
        for batch in batches:
            for at in range(0, len(batch), 4000):
                b = batch.iloc[at : at + 4000]
                pairs, x, fresh = [], [], []
                for q in {question_of(*text) for text in zip(*(b[c].tolist() for c in QUESTION_COLUMNS))}:
                    q.judged.room()
                    q.lists.judged.room()
                texts = zip(*(b[c].tolist() for c in QUESTION_COLUMNS))
                for text, response, french in zip(texts, b["response"].tolist(), b["french"].tolist()):
                    q = question_of(*text)
                    key = (response, "FR" if french and (text[1] or "").strip() else "EN")
                    pairs.append((q, key))
                    if key not in q.judged and key not in q.lists.judged:
                        row, alone = features(*key, q, seen)
                        known = q.lists.judged if alone else q.judged
                        known[key] = ""
                        fresh.append((known, key))
                        x.append(row)
                if x:
                    for (known, key), kind in zip(fresh, classify(x, weights, cuts)):
                        known[key] = kind
                kinds = [q.judged[k] if k in q.judged else q.lists.judged[k] for q, k in pairs]
                out = b[["sample_table", "question", "sample_idx"]].assign(rank=[RANK[k] for k in kinds])
                yield out[out["rank"] < len(TYPES)]

    index = dict(rows.dtypes)["sample_idx"]
    judged = rows.join(asked, "question", "left").mapInPandas(
        judge, f"sample_table string, question string, sample_idx {index}, rank int"
    )
    types = F.array(*[F.lit(t) for t in TYPES])
    return (
        judged.groupBy("sample_table", "question", "sample_idx").agg(F.min("rank").alias("rank"))
        .select("sample_table", "question", "sample_idx", F.get(types, F.col("rank")).alias("defect_type"))
    )
