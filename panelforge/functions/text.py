"""Text functions as Column -> Column expressions; all of them stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space in text of any language, as a character class for Java and RE2 alike.
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Texts that stand for a missing answer, and words without content (English and French).
MISSING = ["", "null", "none", "nan"]
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "au", "aux", "avec", "be", "by", "ce", "cet", "cette", "ces",
    "comme", "dans", "de", "des", "do", "does", "du", "elle", "en", "est", "et", "etre", "for", "from", "had",
    "has", "have", "il", "in", "is", "it", "je", "la", "le", "les", "leur", "leurs", "lui", "mais", "me",
    "mes", "moi", "mon", "ne", "ni", "nos", "notre", "nous", "of", "on", "or", "ou", "par", "pas", "pour",
    "qu", "que", "qui", "sa", "sans", "se", "ses", "son", "sont", "sur", "that", "the", "these", "this", "to",
    "un", "une", "vos", "votre", "vous", "what", "which", "who", "whom", "why", "when", "where", "with",
    "would", "you", "your",
]
# Option bullets, and lines and prefixes that are no part of a printed question.
BULLETS = "▢□■;"
TIMING_LINES = ["Timing", "First Click", "Last Click", "Page Submit", "Click Count"]
SKIP_PREFIXES = ["If ", "Note:", "Skip to ", "Project Title:", "Principal Investigator:", "Co-Investigators:"]


def strip(col: Column) -> Column:
    """Text without white space of any kind at either end."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def collapse(col: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(col, f"{WS}+", " ")


def normalize_text(col: Column) -> Column:
    """Stripped text, or NULL if it is missing or stands for missing."""
    text = strip(col)
    return F.when(~F.lower(text).isin(MISSING), text)


def normalize_value(col: Column, filler: str = "Not specified") -> Column:
    """Text for a prompt: NULL, empty and `null` become the filler; other stand-ins stay."""
    text = strip(col)
    return F.when(text.isNull() | F.lower(text).isin("", "null"), filler).otherwise(text)


def parent_var(col: Column) -> Column:
    """Variable name without a trailing `_<digits>`."""
    return F.regexp_replace(col, r"_+[0-9]+$", "")


def pick_lang(french: Column, label: Column, question: Column, label_fr: Column, question_fr: Column) -> Column:
    """Label or question in the wanted language, else in the other; '' if all are missing."""
    en = [normalize_text(c) for c in (label, question)]
    fr = [normalize_text(c) for c in (label_fr, question_fr)]
    return F.when(french, F.coalesce(*fr, *en, F.lit(""))).otherwise(F.coalesce(*en, *fr, F.lit("")))


def pick_raw(label: Column, question: Column) -> Column:
    """Label, else question, else '', stripped; only the empty text counts as missing."""
    return strip(F.coalesce(F.nullif(label, F.lit("")), F.nullif(question, F.lit("")), F.lit("")))


def split_child_label(col: Column) -> tuple[Column, Column]:
    """(parent, child) of a label at its last ` - `; (label, NULL) if one side would be empty."""
    text = strip(F.coalesce(col, F.lit("")))
    pattern = r"(?s)^(.*) - (.*)$"
    parent, child = (strip(F.regexp_extract(text, pattern, i)) for i in (1, 2))
    split = text.rlike(pattern) & (parent != "") & (child != "")
    return F.when(split, parent).otherwise(text), F.when(split, child)


def is_usable_child_label(col: Column) -> Column:
    """True unless a label is missing, one character, or a leftover such as `e (6)`."""
    text = strip(F.coalesce(col, F.lit("")))
    return (
        (F.length(text) >= 2)
        & ~text.rlike(rf"^[A-Za-z]?{WS}*\([0-9]+\)$")
        & ~F.lower(text).isin("e (6)", "dk", "na")
    )


def child_from_parent_question(question: Column, variable: Column) -> Column:
    """The item that a parent question lists before `(variable)`; NULL if there is none of 3 characters."""
    text = strip(F.coalesce(question, F.lit("")))
    marker = F.concat(F.lit("("), variable, F.lit(")"))
    at = F.instr(text, marker)
    before = F.when(at > 0, F.substring(text, F.lit(1), at - 1))
    item = F.regexp_replace(F.regexp_replace(before, f"(?s)^.*[{BULLETS}]", ""), r"^[ \-:\t]+|[ \-:\t]+$", "")
    return F.when(F.length(item) >= 3, item)


def clean_codebook_text(col: Column) -> Column:
    """Text without display notes, piped fields and bracketed notes, with single blanks."""
    text = F.coalesce(col, F.lit(""))
    text = F.regexp_replace(text, r"Display This (Question|Choice):", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\$\{[^}]+\}", ""), r"\[[^\]]+\]", "")
    return F.regexp_replace(collapse(text), r"^[ \-]+|[ \-]+$", "")


def clean_text(col: Column) -> Column:
    """Text without display notes, with single blanks and no loose marks at the ends."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), rf"(?i)display{WS}+this{WS}+choice:?", " ")
    return F.regexp_replace(collapse(text), r"^[ :;\-\n\t]+|[ :;\-\n\t]+$", "")


def _accents() -> tuple[str, str]:
    """Letters that decompose into one base letter and marks, and their base letters, by rule."""
    pairs = {}
    for code in range(0xA0, min(sys.maxunicode, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if unicodedata.category(c) != "Mn")
        if len(parts) > 1 and len(base) == 1:
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


def strip_diacritics(col: Column) -> Column:
    """Text without accents: letters lose their marks, other characters stay."""
    return F.regexp_replace(F.translate(col, *_accents()), r"\p{Mn}+", "")


def content_terms(col: Column) -> Column:
    """Distinct content words in order of first appearance: folded, two characters or more, no stopwords."""
    tokens = F.split(strip_diacritics(F.lower(F.coalesce(col, F.lit("")))), "[^a-z0-9]+")
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t)))


def embedding_input(base: Column, terms: int = 24) -> Column:
    """Text to embed: the base text and its first content terms."""
    found = F.slice(content_terms(base), 1, terms)
    return F.when(F.size(found) > 0, F.concat(base, F.lit("\n\nkey_terms: "), F.array_join(found, " "))).otherwise(base)


def best_text(label: Column, question: Column, fallback: Column) -> Column:
    """Label and question as one text, without repeating one that is part of the other."""
    a, q = clean_text(label), clean_text(question)
    return (
        F.when((a != "") & (q != ""), F.when(F.contains(F.lower(a), F.lower(q)), a)
               .when(F.contains(F.lower(q), F.lower(a)), q).otherwise(F.concat(a, F.lit(". "), q)))
        .when(a != "", a).when(q != "", q).otherwise(strip(F.coalesce(fallback, F.lit(""))))
    )


def compact(col: Column, most: int = 480) -> Column:
    """Text with single blanks, cut to `most` characters with an ellipsis."""
    text = strip(collapse(col))
    cut = F.concat(F.regexp_replace(F.substring(text, 1, most - 3), f"{WS}+$", ""), F.lit("..."))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def heading(line: Column, prefix: str = "(?:cps21|pes21)_") -> tuple[Column, Column, Column]:
    """(is a heading, variable, rest of the line) of a codebook line."""
    pattern = rf"^{WS}*({prefix}[A-Za-z0-9_]+)\b(?:{WS}+(.*\S))?{WS}*$"
    rest = strip(F.regexp_extract(line, pattern, 2))
    found = ~F.contains(line, F.lit("|")) & line.rlike(pattern) & ((rest == "") | rest.rlike(r"""^[\p{Lu}\p{Nd}"'\[(]"""))
    return found, F.regexp_extract(line, pattern, 1), rest


def is_prompt_line(line: Column, prefix: str = "(?:cps21|pes21)_") -> Column:
    """True for a line that belongs to the wording of a question."""
    skip = F.lit(False)
    for p in SKIP_PREFIXES:
        skip = skip | line.startswith(p)
    variable = line.rlike(rf"^{WS}*{prefix}[A-Za-z0-9_]+\b(?:{WS}+.*\S)?{WS}*$")
    return (line != "") & ~line.isin(TIMING_LINES) & ~line.rlike(r"^\p{Nd}+$") & ~variable & ~skip


def clean_generation(prompt: Column, generated: Column) -> Column:
    """First line of a generated answer, without an echo of the prompt."""
    text = strip(generated)
    rest = F.when(text.startswith(prompt), strip(F.substring(text, F.length(prompt) + 1, F.length(text)))).otherwise(text)
    return strip(F.split(rest, "\n")[0])


def extract_answer(text: Column, options: Column) -> Column:
    """First option, in list order, that the text contains; else its first line; NULL for no text."""
    body = strip(text)
    named = F.get(F.filter(options, lambda o: (o != "") & F.contains(body, o)), F.lit(0))
    line = F.nullif(strip(F.split(body, r"\r\n|\r|\n")[0]), F.lit(""))
    return F.when(body != "", F.coalesce(named, line, body))


def training_text(prompt: Column, answer: Column, end: str) -> Column:
    """Prompt and answer joined by white space, with the end mark."""
    gap = F.when(prompt.endswith(" ") | prompt.endswith("\n"), "").otherwise(" ")
    return F.concat(prompt, gap, answer, F.lit(end))


def repair_mojibake(col: Column) -> Column:
    """UTF-8 text once read as Latin-1, put right; text that is not all such stays as it is.

    Only if every character fits one byte and the bytes are valid UTF-8 is anything changed, so correct
    text keeps its accents.
    """
    fits = ~col.rlike(r"[^\x00-\xFF]")
    whole = r"[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}"
    broken = r"\xE0[\x80-\x9F]|\xED[\xA0-\xBF]|\xF0[\x80-\x8F]|\xF4[\x90-\xBF]"
    valid = col.rlike(whole) & ~F.regexp_replace(col, whole, "").rlike(r"[\x80-\xFF]") & ~col.rlike(broken)
    return F.when(fits & valid, F.decode(F.encode(col, "ISO-8859-1"), "UTF-8")).otherwise(col)
