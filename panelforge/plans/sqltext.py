"""SQL fragments for the counterparts of the text functions."""

from __future__ import annotations

from panelforge.functions.text import MISSING, STOPWORDS, WS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def norm(x: str) -> str:
    listed = ", ".join(f"'{m}'" for m in MISSING)
    return f"(case when lower({strip(x)}) not in ({listed}) then {strip(x)} end)"


def value(x: str) -> str:
    return f"(case when {x} is null or lower({strip(x)}) in ('', 'null') then 'Not specified' else {strip(x)} end)"


def parent(x: str) -> str:
    return f"regexp_replace({x}, '_+[0-9]+$', '')"


def pick(french: str, p: str = "") -> str:
    en, fr = [norm(f"{p}label"), norm(f"{p}question")], [norm(f"{p}label_fr"), norm(f"{p}question_fr")]
    return f"(case when {french} then coalesce({', '.join(fr + en)}, '') else coalesce({', '.join(en + fr)}, '') end)"


def clean(x: str) -> str:
    text = collapse(f"regexp_replace(coalesce({x}, ''), '(?i)display{WS}+this{WS}+choice:?', ' ', 'g')")
    return rf"regexp_replace({text}, '^[ :;\-\n\t]+|[ :;\-\n\t]+$', '', 'g')"


def clean_codebook(x: str) -> str:
    text = f"regexp_replace(coalesce({x}, ''), 'Display This (Question|Choice):', '', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '\$\{{[^}}]+\}}', '', 'g'), '\[[^\]]+\]', '', 'g')"
    return rf"regexp_replace({collapse(text)}, '^[ \-]+|[ \-]+$', '', 'g')"


def compact(x: str, most: int = 480) -> str:
    text = strip(collapse(x))
    return (
        f"(case when length({text}) <= {most} then {text} "
        f"else regexp_replace(substring({text}, 1, {most - 3}), '{WS}+$', '') || '...' end)"
    )


def terms(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    tokens = f"regexp_split_to_array(strip_accents(lower(coalesce({x}, ''))), '[^a-z0-9]+')"
    kept = f"list_filter({tokens}, lambda t: length(t) >= 2 and not list_contains([{stop}], t))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"


def options(x: str) -> str:
    """Labels without codes, missing and `_TEXT` entries and repeats, as in options_list."""
    stored = f"(case when json_valid({x}) and json_type({x}) = 'ARRAY' then cast(json({x}) as varchar[]) else [] end)"
    listed = ", ".join(f"'{m}'" for m in MISSING)
    kept = f"list_filter({stored}, lambda o: o is not null and lower({strip('o')}) not in ({listed}) and not contains(o, '_TEXT'))"
    bare = f"list_filter(list_transform({kept}, lambda o: {strip_code('o')}), lambda o: o <> '')"
    return f"list_filter({bare}, lambda o, i: list_position({bare}, o) = i)"


def stored_options(x: str) -> str:
    stored = f"(case when json_valid({x}) and json_type({x}) = 'ARRAY' then cast(json({x}) as varchar[]) else [] end)"
    return f"list_filter({stored}, lambda o: not contains(o, '_TEXT'))"


def strip_code(x: str) -> str:
    head = strip(rf"regexp_replace({strip(x)}, '^{WS}*[0-9]+{WS}*:{WS}*', '')")
    return strip(rf"regexp_replace({head}, '{WS}*\([0-9]+\){WS}*$', '')")


def child(x: str) -> str:
    text = strip(f"coalesce({x}, '')")
    a, b = (strip(f"regexp_extract({text}, '(?s)^(.*) - (.*)$', {i})") for i in (1, 2))
    return f"(case when {a} <> '' and {b} <> '' then {b} end)"


def child_parent(x: str) -> str:
    text = strip(f"coalesce({x}, '')")
    a, b = (strip(f"regexp_extract({text}, '(?s)^(.*) - (.*)$', {i})") for i in (1, 2))
    return f"(case when {a} <> '' and {b} <> '' then {a} else {text} end)"


def usable(x: str) -> str:
    text = strip(f"coalesce({x}, '')")
    return rf"(length({text}) >= 2 and not regexp_matches({text}, '^[A-Za-z]?{WS}*\([0-9]+\)$') and lower({text}) not in ('e (6)', 'dk', 'na'))"


def french(x: str = "survey_language") -> str:
    return f"(upper(coalesce({norm(x)}, 'EN')) like 'FR%')"


def key(seed: object, *cols: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"cast({c} as varchar)" for c in cols) + "))"


def draw(seed: object, *cols: str) -> str:
    return f"(('0x' || substring({key(seed, *cols)}, 1, 8))::bigint)"


def position(seed: object, group: list[str], by: list[str]) -> str:
    """Place from 0 in the seeded shuffle of a group."""
    part = f"partition by {', '.join(group)} " if group else ""
    return f"(row_number() over ({part}order by {key(seed, *group, *by)}, {', '.join(by)}) - 1)"
