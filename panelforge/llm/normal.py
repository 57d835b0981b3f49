"""Text normalisation shared by the operators that compare texts."""

from __future__ import annotations

import re
import unicodedata
import zlib

_BROKEN = re.compile("[\u00c2-\u00c5][\u0080-\u00bf\u0152-\u017e\u2013-\u2122]|\u00e2[\u20ac\u0080][\u0080-\u00bf\u0152-\u017e\u2013-\u2122\u02dc]")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_APOSTROPHE = re.compile("['\u2019\u2018\u02bc`\u00b4]")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")


def _repair_one(m: re.Match) -> str:
    raw = bytearray()
    for c in m.group():
        try:
            raw += c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252")
        except UnicodeEncodeError:
            return m.group()
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def repair(text: str) -> str:
    """Text in which UTF-8 sequences once read as a one-byte code are put right; other text stays."""
    return text if text.isascii() else _BROKEN.sub(_repair_one, text)


def fold(text: str) -> str:
    """Lower case without accents, compatibility forms, invisible characters or mojibake."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", repair(text)))
        text = _MARKS.sub("", text.lower()).replace("œ", "oe").replace("æ", "ae")
    return text.lower()


def words(text: str | None) -> list[str]:
    """Folded words; an apostrophe inside a word leaves no trace."""
    if not text:
        return []
    text = fold(text)
    return _WORD.findall(_APOSTROPHE.sub("", text) if _APOSTROPHE.search(text) else text)


def word_hash(word: str) -> int:
    """A 63-bit hash of a word that is the same in every process."""
    raw = word.encode()
    return (zlib.crc32(raw) << 31 ^ zlib.crc32(raw[::-1], 0x9E3779B9)) & 0x7FFFFFFFFFFFFFFF


def deletions(word: str) -> set[str]:
    """The word and every form of it with one character less."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class Edits:
    """Edits (with swaps of neighbours) from one text to others, by bit vectors over its letters."""

    def __init__(self, text: str):
        self.size, self.at = len(text), {}
        for i, c in enumerate(text):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def to(self, other: str, k: int) -> int:
        """The number of edits, or k + 1 if more than k are needed."""
        n = self.size
        if abs(n - len(other)) > k:
            return k + 1
        if not n:
            return len(other)
        full, last = (1 << n) - 1, 1 << (n - 1)
        # over: edits so far less the letters to come, each of which saves one at most
        up, down, same, before, over, find = full, 0, 0, 0, n - len(other), self.at.get
        for c in other:
            here = find(c, 0)
            swap = ((~same & here) << 1) & before
            same = ((((here & up) + up) ^ up) | here | down | swap) & full
            plus, minus = (down | ~(same | up)) & full, same & up
            if not minus & last:
                over += 2 if plus & last else 1
                if over > k:
                    return k + 1
            plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
            up, down = (minus | ~(same | plus)) & full, plus & same
            before = here
        return over


def damerau(a: str, b: str, k: int) -> int:
    """Edits (with swaps of neighbours) from a to b, or k + 1 if more than k are needed."""
    return 0 if a == b else Edits(a).to(b, k) if abs(len(a) - len(b)) <= k else k + 1


class Memo:
    """A function that remembers its last results; travels to Python workers without them."""

    def __init__(self, f, cap: int = 4096):
        self.f, self.cap, self.kept = f, cap, {}

    def __call__(self, *args):
        try:
            return self.kept[args]
        except KeyError:
            if len(self.kept) >= self.cap:
                self.kept.clear()
            self.kept[args] = found = self.f(*args)
            return found

    def __getstate__(self):
        return {"f": self.f, "cap": self.cap, "kept": {}}
