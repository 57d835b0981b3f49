"""Template residue, filler and error-page text (problem 9)."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import notices
from panelforge.llm.linear import BITS, Sparse, best_threshold, fit, place
from panelforge.llm.normal import fold
from panelforge.llm.seeds import FOREIGN, FREQUENT, made
from panelforge.session import bounded_sample, spread

#: A line that goes on in small letters is no new segment.
_SEGMENT = re.compile(r"\n+(?![a-zà-ÿ])|(?<=[.!?…])\s+")
_WORD = re.compile(r"[^\W_]+")
_LEAD = re.compile(r"^\s*(?:\w+_\d+ \||[>*-]|[A-Z] ?:|[A-ZÀ-Þ-]{4,} - )\s*")
#: Ways to write a slot of a template: opening and closing marks.
SLOTS = [
    ("{{", "}}"), ("{%", "%}"), ("<%", "%>"), ("<?", "?>"), ("${", "}"), ("#{", "}"), ("{$", "}"), ("$(", ")"),
    ("%(", ")s"), ("[[", "]]"), ("<<", ">>"), ("%%", "%%"), ("__", "__"), ("@@", "@@"), ("{", "}"), ("[", "]"),
    ("<", ">"), ("@", "@"), ("$", "$"),
]
_SIGN = re.compile(r"[{}\[\]<>@$%]|__|TODO|TBD|XXX|[A-Z]_[A-Z]")
_SLOT = [
    (a + b, re.compile(re.escape(a) + r"([^\n{}\[\]<>@%]+?)" + re.escape(b), re.IGNORECASE)) for a, b in SLOTS
] + [
    ("todo", re.compile(r"\b((?:TODO|TBD|FIXME)\b:? ?\w+(?: \w+)?)")),
    ("caps", re.compile(r"\b([A-Z]{3,}(?:_[A-Z]{3,})+)\b")),
    ("xxx", re.compile(r"\b(X{3,} [^\nX]+? X{3,})\b", re.IGNORECASE)),
]
_IDENT = re.compile(r"[=#/$]?\s*[A-Za-z]\w*(?:[ ._:/|-]+\w+)*\s*")
_MARKUP = re.compile(r"/?(?:[biupaq]|br|em|li|ul|ol|td|tr|th|hr|h[1-6]|div|span|strong|table|html|body|head|title)")
_ASKS = re.compile(r"insert|inserer|completer|your |votre |here\b|\bnom d|to be |todo|tbd|fill in|remplir|placeholder")
REASONS = [
    "not found", "forbidden", "unauthorized", "bad request", "bad gateway", "gateway timeout", "request timeout",
    "service unavailable", "service temporarily unavailable", "internal server error", "too many requests", "gone",
    "page introuvable", "page non trouvee", "acces interdit", "acces refuse", "erreur interne",
    "erreur interne du serveur", "service indisponible",
]
_REASON = re.compile(r"\b(?:%s)\b" % "|".join(REASONS))
_DIGIT = re.compile(r"\d")
_TOKEN = re.compile(r"[^\W_]+|\n")
_MASK = (1 << BITS) - 1
_STATUS = re.compile(r"\b[45]\d\d\b")
#: Signs of notices and filler that are certain enough for a weak label, on folded text of one segment.
_CERTAIN = re.compile(
    r"^(?:please |veuillez )?(?:enable|activer|activez) (?:javascript|scripts)\b|\bjavascript (?:is|est) (?:disabled|required|desactive|requis)"
    r"|\blorem ipsum dolor\b|\bpage not found\b|\bpage introuvable\b|\b(\w+)(?: \1){2,}\b"
)


def segments(text: str) -> list[str]:
    """Sentences and lines of a text, without list marks and speaker labels.

    What looks like a template slot in a longer sentence is a segment of its own besides.
    """
    out = [s for s in (_LEAD.sub("", p).strip() for p in _SEGMENT.split(text)) if _WORD.search(s)]
    inner = []
    for s in out:
        if len(s) > 12 and _SIGN.search(s):
            for _, pattern in _SLOT:
                inner += [m.group() for m in pattern.finditer(s)]
    return out + inner


def slots(segment: str) -> list[tuple[str, str]]:
    """(marks, kind of content) of each template slot in a segment; kinds: name, asks, number, other."""
    found, rest = [], segment
    if not _SIGN.search(segment):
        return found
    for marks, pattern in _SLOT:
        for m in pattern.finditer(rest):
            inside = m.group(1).strip()
            if inside.isdigit():
                kind = "number" if marks == "{}" else "other"
            elif marks == "<>" and _MARKUP.fullmatch(inside.lower()):
                kind = "markup"
            elif marks in ("todo", "xxx") or _ASKS.search(fold(inside)):
                kind = "asks"
            elif _IDENT.fullmatch(inside) and (inside.isupper() or re.search(r"[._:/|=-]", inside) or " " not in inside):
                kind = "spoken" if marks in ("[]", "()") and inside.islower() and inside.isalpha() else "name"
            else:
                kind = "other"
            found.append((marks, kind))
        rest = pattern.sub(" ", rest)
    return found


def filled(segment: str, word: str) -> str:
    """segment with a word in place of every template slot."""
    for _, pattern in _SLOT:
        segment = pattern.sub(word.replace("\\", ""), segment)
    return segment


def weak_label(segment: str) -> int:
    """1 for residue by status code and reason, slot, or one of a few certain phrases; 0 for anything else."""
    plain = " ".join(_WORD.findall(fold(segment).replace("'", "").replace("’", "")))
    if (m := _REASON.search(plain)) and (_STATUS.search(plain) or m.group() == plain):
        rest = plain.replace(m.group(), "").split()
        if len(rest) <= len(m.group().split()) + 4:  # the reason and little else
            return 1
    if _CERTAIN.search(plain):
        return 1
    return int(any(kind in ("name", "asks", "number") for _, kind in slots(segment)))


class Words:
    """Hash, ending and language of each word, kept for the last words met."""

    def __init__(self, cap: int = 300_000):
        self.cap = cap
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.code, self.end, self.told = [], [], []

    def ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.at) > self.cap:
            self.clear()
        at = self.at
        for t in tokens:
            if t not in at:
                at[t] = len(at)
                self.code.append(zlib.crc32(t.encode()))
                self.end.append(zlib.crc32(("end" + t[-3:]).encode()) if len(t) > 4 else 0)
                self.told.append(t in _COMMON)
        return np.array([at[t] for t in tokens], np.int64)

    def __getstate__(self):
        return {"cap": self.cap}

    def __setstate__(self, state):
        self.cap = state["cap"]
        self.clear()


_COMMON = {w for ws in FREQUENT.values() for w in ws}


def rows_of(parts: list[str], title: list[bool], alone: list[bool], lexicon: Words) -> Sparse:
    """Hashed word n-grams, word endings, slots, length and title features of all segments, in one go.

    The segments of a batch are folded and cut into words together; n-grams are formed on arrays.
    """
    text = "\n" + _DIGIT.sub("0", fold("\n".join(p.replace("\n", " ") for p in parts))) + "\n"
    ids = lexicon.ids(_TOKEN.findall(text))
    mark = np.uint64(zlib.crc32(b"\n"))
    code = np.array(lexicon.code, np.uint64)[ids]
    end, told = np.array(lexicon.end, np.int64)[ids], np.array(lexicon.told, bool)[ids]
    edge = code == mark
    row = np.cumsum(edge) - 1
    with np.errstate(over="ignore"):
        low = np.uint64(0xFFFFFFFF)
        pair = (code[:-1] * np.uint64(0x9E3779B1) ^ code[1:]) & low
        triple = (pair[:-1] * np.uint64(0x85EBCA6B) ^ code[2:]) & low
    one = ~edge
    two = ~(edge[:-1] & edge[1:])
    three = ~edge[1:-1] & ~(edge[:-2] & edge[2:])
    words_in = np.bincount(row[one], minlength=len(parts))
    common = np.bincount(row[one & told], minlength=len(parts))
    # an edge belongs to the row it opens; the gram that ends with the next edge to the row of its first word
    own2 = np.where(edge[:-1], row[:-1], row[:-1])
    own3 = row[1:-1]
    found_row = [row[one], own2[two], own3[three], row[one & (end != 0)]]
    found = [
        (code[one] & np.uint64(_MASK)).astype(np.int64), (pair[two] >> np.uint64(7) & np.uint64(_MASK)).astype(np.int64),
        (triple[three] >> np.uint64(7) & np.uint64(_MASK)).astype(np.int64), end[one & (end != 0)] & _MASK,
    ]
    length = np.minimum(6, words_in // 3)
    share = np.where(words_in > 3, (4 * common + words_in - 1) // np.maximum(words_in, 1), 9)
    every = np.arange(len(parts))
    for name, value in (("len", length), ("common", share), ("common+len", 16 * share + length)):
        table = np.array([place(f"{name}:{v}") for v in range(160)])
        found_row.append(every)
        found.append(table[value])
    extra_row, extra = [], []
    for i, p in enumerate(parts):
        names = []
        for marks, kind in slots(p):
            names += [f"slot:{kind}:{j}" for j in range(4)] + [f"slot:{marks}:{kind}", "slot:any"]
        if title[i]:
            names.append(f"title:{words_in[i] <= 6}")
        if alone[i]:
            names.append("alone")
        if names or words_in[i] and _STATUS.search(p):
            if _STATUS.search(p):
                names.append(f"status:{words_in[i] <= 10}")
            extra_row += [i] * len(names)
            extra += [place(n) for n in names]
    found_row.append(np.array(extra_row, np.int64))
    found.append(np.array(extra, np.int64))
    return Sparse.joined(np.concatenate(found_row), np.concatenate(found), len(parts))


def seeds(rng: random.Random, without: str | None = None) -> list[tuple[str, int, str]]:
    """(segment, label, family) of made segments: each kind of residue, and sentences that only talk about it."""
    names = ["city_name", "party.label", "WAVE_ID", "leaderText", "user-name", "topic"]
    carriers = ["{}", "Dear {}, thank you.", "Selon {}, le vote est clos.", "We met in {} last week.", "Section: {}", "Bonjour {}, merci de nous lire.", "Hello {}!", "The vote in {} was saved."]
    out = []
    for i, (a, b) in enumerate(SLOTS):
        for j, n in enumerate(names):
            if len(a) == 1 and a in "[<" and n.islower() and n.isalpha():
                continue
            out.append((carriers[(i + j) % len(carriers)].format(a + n + b), 1, "slot"))
    out += [(c.format(x), 0, "plain") for c in carriers[1:] for x in ("Wellesborough", "Saint-Aubert", "Oakridge", "Montcalm", "7 streets", "Port Elgin", "40 %", "the Elgin panel")]
    out += [(c.format("{0} of {1}"), 1, "slot") for c in carriers] + [("{0}", 1, "slot"), ("{1}", 1, "slot")]
    for j, ask in enumerate(["INSERT NAME", "your text here", "À COMPLÉTER", "nom à insérer", "insert quote"]):
        out += [(c.format(m[0] + ask + m[1]), 1, "slot") for c in carriers for m in ("[]", "<>")]
        out.append((carriers[j % 8].format("TODO: add figure"), 1, "slot"))
        out.append((carriers[j].format("XXXX to be confirmed XXXX"), 1, "slot"))
    for k, r in enumerate(REASONS):
        code = 400 + k
        shown = r.title()
        shapes = [
            f"{code} {shown}", f"Error {code}: {r}", f"HTTP {code} {shown}", f"{code} | {shown}", f"{shown} ({code})",
            f'{{"status": {code}, "message": "{shown}"}}', f"Erreur {code} : {shown}", f"<h1>{code}</h1><p>{shown}</p>", f"{shown}.",
        ]
        out += [(x, 1, "status") for x in shapes]
    for family, rules in notices.FAMILIES.items():
        texts = [notices.shaped(rng, made(rng, rules, "text")) for _ in range(200)]
        out += [(x, 1, family) for t in texts for x in {t, max(segments(t), key=len)}]
    out += [(notices.latin(rng), 1, "latin") for _ in range(120)]
    out += [(notices.repeated(rng), 1, "repeated") for _ in range(40)]
    out = [x for x in out if x[2] != without]
    talk = [notices.shaped(rng, made(rng, notices.TALK, "text")) for _ in range(500)]
    plain = ["497 years.", "of 503 dollars.", "404 families from the floodplain.", "de 502 dollars.", "500 children in the town.", "A: [inaudible]", "<|endoftext|>", "<b></b>", "Dear 5 %, thank you for taking part.", "1 234,50 $", "№ 12", "Hello there!"]
    plain += ["Profile:", "Notes:", "Summary", "Age: 48", "Region: North", "R:", "Q:", "Question 4", "Date: 3 May", "Réponse :", "Âge : 52", "Sujet : le budget"]
    talk += [made(rng, FOREIGN | {"town": ["Montcalm", "Oakridge", "Elgin"]}, "text") for _ in range(300)]
    return out + [(x, 0, "talk") for x in talk] + [(x, 0, "plain") for x in plain for _ in range(3)]


def train(documents: DataFrame, sample_docs: int = 4_000, held_out: float = 0.2, without: str | None = None, seed: int = 9) -> dict:
    """Weights and threshold from at most sample_docs documents (lowest hash of the id) and made segments.

    Labels are weak: status codes, slots and a few certain phrases (see weak_label); what other residue looks
    like is learnt from made segments (notices.py). The threshold is calibrated on the documents of held-out
    sources, about held_out of all, that training never saw, and on made segments left aside. A segment
    without weak label that a fit takes for residue without having seen it may be such as no rule knows, so it is left out. without leaves out one family of made segments, to measure how it is found unseen.
    """
    told = documents.where("t is not null").select("d", "t", F.coalesce("s", F.lit("")).alias("s"))
    rows = bounded_sample(told, "d", sample_docs).collect()
    met: dict[tuple[str, bool, bool], list[int]] = {}
    for r in rows:
        own = segments(r["t"])
        unseen = place("host:" + r["s"]) % 1000 < 1000 * held_out
        for i, p in enumerate(own):
            n = met.setdefault((p, i == 0, len(own) == 1), [0, 0])
            n[unseen] += 1
    # what many documents repeat counts by the logarithm of its copies, in training if it can
    keys = [(k, not n[0]) for k, n in met.items() for _ in range((n[0] or n[1]).bit_length())]
    parts, title, alone = ([k[i] for k, _ in keys] for i in range(3))
    held = [h for _, h in keys]
    y = [weak_label(p) for p in parts]
    real = len(parts)
    rng = random.Random(seed)
    # short pieces of ordinary segments are ordinary too
    ordinary = [p.split() for p, label in zip(parts, y) if not label]
    for _ in range(len(ordinary) // 6):
        ws, n = rng.choice(ordinary), rng.randrange(1, 8)
        at = rng.randrange(max(1, len(ws) - n))
        some = ws[at : at + n]
        if rng.random() < 0.2:  # a number that could be a status code is none by itself
            some.insert(rng.randrange(len(some) + 1), str(rng.randrange(400, 600)))
        parts.append(" ".join(some) + rng.choice(["", ".", ":"]))
        title.append(rng.random() < 0.5)
        alone.append(rng.random() < 0.3)
        y.append(0)
        held.append(rng.random() < held_out)
    # and a sentence with a name in place of its slot is one
    for p, label in zip(parts[:real], y[:real]):
        if label and len(p.split()) > 3 and (plain := filled(p, rng.choice(rng.choice(ordinary)) if ordinary else "Elgin")) != p and not weak_label(plain):
            parts.append(plain)
            title.append(False)
            alone.append(False)
            y.append(0)
            held.append(rng.random() < held_out)
    for p, label, _ in seeds(rng, without):
        aside = rng.random() < held_out
        for t, a in ((False, False), (True, False), (True, True)) if label and not aside else ((False, False),):
            parts.append(p)
            title.append(t)
            alone.append(a)
            y.append(label)
            held.append(aside)
    y, held, lexicon = np.array(y), np.array(held, bool), Words()
    x = rows_of(parts, title, alone, lexicon)
    # a segment without weak label may be residue that no rule knows; a fit that has not seen it tells
    half = np.array([zlib.crc32(p.lower().encode()) & 1 for p in parts])
    half[real:] = 2
    doubtful = np.zeros(len(y), bool)
    for fold in (0, 1):
        kept = ~held & (half != fold)
        w = fit(x.rows(kept), y[kept], rounds=60)
        doubtful |= (half == fold) & (y == 0) & (x.dot(w) > 0.25)
    weights = fit(x.rows(~held & ~doubtful), y[~held & ~doubtful])
    scores, calm = x.dot(weights), held & ~doubtful
    cut, f1 = best_threshold(scores[calm], y[calm]) if y[calm].sum() >= 20 else (0.0, float("nan"))
    return {"weights": weights.astype("f4"), "cut": cut, "held_out_f1": f1, "rows": len(y)}


def with_residue(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", sample_docs: int = 4_000
) -> DataFrame:
    """id_col of every document with residue as a part of itself.

    NULL, empty and blank texts have none. Every sentence or line of the whole text is scored by the
    linear classifier (see train); one over the threshold is enough. Repeated rows give one result row.
    Only the training sample, of at most sample_docs documents, goes to the driver; the weights (1 MB)
    are broadcast, and the corpus is read once, without a shuffle but of the found ids.
    """
    host = F.col(f"`{host_col}`").cast("string") if host_col in df.columns else F.lit("")
    docs = df.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("t"), host.alias("s")).where("d is not null")
    model = train(docs, sample_docs)
    shared = df.sparkSession.sparkContext.broadcast((model["weights"], model["cut"]))
    kind = df.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, cut = shared.value
        lexicon = Words()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                b = batch.iloc[at : at + 1000]
                parts, title, alone, owner = [], [], [], []
                for n, text in enumerate(b["t"]):
                    own = segments(text)
                    parts += own
                    title += [i == 0 for i in range(len(own))]
                    alone += [len(own) == 1] * len(own)
                    owner += [n] * len(own)
                if parts:
                    bad = np.unique(np.array(owner)[rows_of(parts, title, alone, lexicon).dot(weights) > cut])
                    yield pd.DataFrame({"d": b["d"].to_numpy()[bad]})

    found = spread(docs.where("t is not null").select("d", "t")).mapInPandas(score, f"d {kind}")
    return found.distinct().select(F.col("d").alias(id_col))
