"""Option lists: JSON arrays kept as text, with or without codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.text import MISSING, WS, normalize_text, strip

_HEAD = rf"^{WS}*[0-9]+{WS}*:{WS}*"
_TAIL = rf"{WS}*\([0-9]+\){WS}*$"


def parsed(col: Column) -> Column:
    """The stored list as array<string>; NULL for broken JSON, objects and other values."""
    return F.from_json(col, "array<string>")


def strip_code(col: Column) -> Column:
    """An option without a code before or after it."""
    return strip(F.regexp_replace(strip(F.regexp_replace(strip(col), _HEAD, "")), _TAIL, ""))


def options_list(col: Column) -> Column:
    """Labels in first-seen order: no missing entries, no open `_TEXT` entries, no codes, no repeats."""
    kept = F.filter(
        parsed(col),
        lambda o: o.isNotNull() & ~F.lower(strip(o)).isin(MISSING) & ~F.contains(o, F.lit("_TEXT")),
    )
    labels = F.filter(F.transform(kept, strip_code), lambda o: o != "")
    return F.coalesce(F.array_distinct(labels), F.array().cast("array<string>"))


def options_kept(col: Column) -> Column:
    """Entries as stored, codes and repeats included, without open `_TEXT` entries."""
    kept = F.filter(parsed(col), lambda o: ~F.contains(o, F.lit("_TEXT")))
    return F.coalesce(kept, F.array().cast("array<string>"))


def single_option(col: Column) -> Column:
    """The only entry of a list of one, without a leading code; NULL otherwise."""
    only = F.get(parsed(col), F.lit(0))
    label = normalize_text(F.regexp_replace(only, _HEAD, ""))
    return F.when(F.size(parsed(col)) == 1, label)


def option_pairs(col: Column) -> Column:
    """array<struct<pos, code, label>> of the coded entries: `N: label`, else `label (N)`."""
    head, tail = rf"(?s)^{WS}*([0-9]+){WS}*:{WS}*(.*)$", rf"(?s)^(.*?){WS}*\(([0-9]+)\){WS}*$"

    def pair(o: Column, i: Column) -> Column:
        first = o.rlike(head)
        return F.struct(
            i.cast("bigint").alias("pos"),
            F.when(first, F.regexp_extract(o, head, 1)).otherwise(F.regexp_extract(o, tail, 2)).alias("code"),
            strip(F.when(first, F.regexp_extract(o, head, 2)).otherwise(F.regexp_extract(o, tail, 1))).alias("label"),
        )

    found = F.filter(F.transform(parsed(col), pair), lambda x: (x["code"] != "") & (x["label"] != ""))
    return F.coalesce(found, F.array().cast("array<struct<pos:bigint,code:string,label:string>>"))


def bulleted(options: Column) -> Column:
    """One line `- option` per entry."""
    return F.array_join(F.transform(options, lambda o: F.concat(F.lit("- "), o, F.lit("\n"))), "")


def choices_line(options: Column, french: Column) -> Column:
    """`Choices: a / b` or `Choix: a / b`; NULL if there are none."""
    lead = F.when(french, "Choix: ").otherwise("Choices: ")
    return F.when(F.size(options) > 0, F.concat(lead, F.array_join(options, " / ")))
