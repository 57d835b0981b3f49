"""Reading typed answers: option lists, decorations, codes, refusals and copies (problems 1 and 2)."""

from __future__ import annotations

import json
import re

from panelforge.llm.normal import Memo, damerau, fold, words

_CODE_HEAD = re.compile(r"^\s*(\d+)\s*[:.)\]-]\s*(?=[^\s\d])")
_CODE_TAIL = re.compile(r"\s*[(\[](\d+)[)\]]\s*$")
_BARE = re.compile(r"^(?:option|choix|choice|reponse|answer|no|n°|#)?\s*[#(\[]?\s*(\d{1,4})\s*[)\].:]?$")
_EDGE = re.compile(r"^[\s\"'«»“”*_•\-–—>`.!:;,]+|[\s\"'«»“”*_`.!:;,…]+$")
_PAUSE = re.compile(r"[,.;:]\s|\s[-–—]\s")
_VISIBLE = re.compile(r"[^\W_]")
#: Stand-ins for a missing answer, as folded words.
MISSING = {"", "nan", "null", "none", "na", "n a", "nil", "undefined"}
@Memo
def parse_list(stored: str | None) -> tuple[tuple[int, str, int | None], ...]:
    """(place, label, code) of the entries of a stored option list; broken JSON has none.

    `_TEXT` entries are left out; places stay those of the stored array.
    """
    try:
        found = json.loads(stored) if stored else []
    except ValueError:
        return ()
    if not isinstance(found, list):
        return ()
    out = []
    for place, entry in enumerate(found):
        if not isinstance(entry, str) or "_TEXT" in entry:
            continue
        head, tail = _CODE_HEAD.match(entry), _CODE_TAIL.search(entry)
        code = int((head or tail).group(1)) if head or tail else None
        label = entry[head.end() :] if head else entry[: tail.start()] if tail else entry
        out.append((place, label.strip(), code))
    return tuple(out)


def bare(text: str) -> str:
    """Text without blanks, quotes, stars, bullets and closing marks around it."""
    last = None
    while text != last and not (text[:1].isalnum() and text[-1:].isalnum()):
        last = text
        text = _EDGE.sub("", text)
    return text


def is_empty(text: str | None) -> bool:
    """True for no answer at all: nothing visible, mere marks, or a stand-in for missing."""
    if text is None or not _VISIBLE.search(text):
        return True
    return " ".join(words(text)) in MISSING


def bare_code(text: str) -> int | None:
    """The number, if the text is nothing but a code."""
    m = _BARE.match(fold(text).strip())
    return int(m.group(1)) if m else None


def without_code(text: str) -> tuple[str, int | None]:
    """Text without a code before or after it, and the code."""
    m = _CODE_HEAD.match(text)
    if m and _VISIBLE.search(text[m.end() :]):
        return text[m.end() :], int(m.group(1))
    m = _CODE_TAIL.search(text)
    if m and _VISIBLE.search(text[: m.start()]):
        return text[: m.start()], int(m.group(1))
    return text, None


def readings(text: str) -> list[tuple[list[str], bool]]:
    """Ways to read a response as words of an answer, each with whether something was left off its end.

    The whole text comes first, then what follows a colon, equals sign, question mark or comma, and what stands before
    an explanation.
    """
    base, _ = without_code(bare(text))
    base = bare(base)
    base, _ = without_code(base)
    out = [(words(base), False)]
    for mark in (": ", " : ", "= ", "? ", ", "):
        if mark in base:
            rest = bare(base.rsplit(mark, 1)[1])
            rest, _ = without_code(rest)
            out.append((words(rest), False))
    for m in _PAUSE.finditer(base):
        out.append((words(base[: m.start()]), True))
    seen, kept = set(), []
    for ws, cut in out:
        if ws and (key := tuple(ws)) not in seen:
            seen.add(key)
            kept.append((ws, cut))
    return kept


class Sources:
    """Label and question of one question, as folded words."""

    def __init__(self, *texts: str | None):
        self.texts = [" ".join(words(t)) for t in texts]
        there = " ".join(t for t in self.texts if t).split()
        self.padded = [f" {t} " for t in (*self.texts, " ".join(there)) if t]
        self.known = set(there)
        self.grams = set(zip(there, there[1:]))


sources_of = Memo(Sources, 2048)


def copied(ws: list[str], s: Sources) -> bool:
    """True if the words of a response only repeat label or question, wholly or, from three words on, in part.

    A lead `Question:` and a few misspelt words do not matter.
    """
    if len(ws) > 1 and abs(len(ws[0]) - 8) <= 2 and damerau(ws[0], "question", 2) <= 2:
        ws = ws[1:]
    own = " ".join(ws)
    if ws and own in s.texts:
        return True
    if len(ws) < 3:
        return False
    if any(f" {own} " in t or t.startswith(f" {own}") for t in s.padded):
        return True
    if len(ws) < 4:
        return False
    share = sum(w in s.known for w in ws) / len(ws)
    if share < 0.5 or sum(g in s.grams for g in zip(ws, ws[1:])) / (len(ws) - 1) < 0.25:
        return False
    if share < 1:
        known = sorted(s.known)
        ws = [w if w in s.known else next((k for k in known if damerau(w, k, 2) <= min(2, len(k) // 3)), w) for w in ws]
        share = sum(w in s.known for w in ws) / len(ws)
    pairs = sum(g in s.grams for g in zip(ws, ws[1:])) / (len(ws) - 1)
    return share >= 0.85 and pairs >= 0.6
