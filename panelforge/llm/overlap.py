"""Same or near-same records across splits (problem 6)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.normal import _APOSTROPHE, _WORD, fold, repair
from panelforge.llm.sieve import Sieve
from panelforge.session import cut, spread

#: Segment lengths with the fewest words of a text that has room for all its segments of that length, see needed().
SEGMENTS = {1: 0, 2: 8, 3: 18, 4: 24, 6: 44}
#: Survey routing marks: they belong to the layout of a question, not to its words.
ROUTING = re.compile(
    r"\[[^\]]*\]|\([^)]*\)|\$?\{[^}]*\}|<[^>]*>|\bdisplay this (?:question|choice)\b:?", re.IGNORECASE
)
_BREAK = re.compile(r"(?<=[.?!:;])\s+|\s+[-–—]\s+|[\r\n]+")
_CAPITAL = re.compile(r"[A-ZÀ-Þ][^\W\d_]+")


def edits(n: int) -> int:
    """Word edits that two texts of n words may differ by and still be the same record."""
    return max(min(3, n // 6), n // 12)


def most_edits(n: int) -> int:
    """The most edits that same_record allows a text of n words and any other text: the longer one's count too."""
    return max(min(3, n // 5), n // 11)


def needed(n: int) -> int:
    """Disjoint segments of a text of n words of which every same record holds one unchanged.

    An edit spoils one segment at most, and so does each of the two places where a turned text is cut;
    single words cannot be cut.
    """
    return most_edits(n) + (3 if n >= SEGMENTS[2] else 1)


def cheapest(cost: list[int], size: int, m: int) -> list[int]:
    """Places of m disjoint segments of so many words, of the least total cost; cost[i] is that of a segment at i.

    As many as have room if m do not.
    """
    m = min(m, (len(cost) + size - 1) // size)
    # best[i][c]: least cost of c segments that end within the first i words
    best = np.full((len(cost) + size, m + 1), np.inf)
    best[:, 0] = 0
    for i in range(size, len(best)):
        np.minimum(best[i - 1, 1:], best[i - size, :-1] + cost[i - size], out=best[i, 1:])
    out, i = [], len(best) - 1
    while m:
        if best[i, m] < best[i - 1, m]:
            i -= size
            m -= 1
            out.append(i)
        else:
            i -= 1
    return out[::-1]


def record(label: str | None, question: str | None) -> tuple[list[str], list[int], list[str]]:
    """Folded words of label and question, where sentences begin, and the words written as names.

    A text wholly in capitals tells no names.
    """
    out, bounds, names = [], [], set()
    for text in (label, question):
        text = ROUTING.sub(" ", repair(text or ""))
        shown = not text.isupper()
        for part in _BREAK.split(text):
            ws = _WORD.findall(_APOSTROPHE.sub("", fold(part)))
            if ws:
                bounds.append(len(out))
                out += ws
                if shown:
                    names.update(fold(m.group()) for m in _CAPITAL.finditer(part) if part[: m.start()].strip())
    return out, bounds[1:], sorted(names)


def banded(a: list[str], b: list[str], k: int) -> list[tuple[str, str]] | None:
    """The word edits from a to b ('' for a missing word) if k suffice, by a banded table; else None."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return None
    far = k + 1
    rows = [{j: j for j in range(min(m, k) + 1)}]
    for i in range(1, n + 1):
        above, row = rows[-1], {}
        for j in range(max(0, i - k), min(m, i + k) + 1):
            best = above.get(j, far) + 1
            if j:
                best = min(best, above.get(j - 1, far) + (a[i - 1] != b[j - 1]), row.get(j - 1, far) + 1)
            row[j] = best
        if min(row.values()) > k:
            return None
        rows.append(row)
    if rows[n].get(m, far) > k:
        return None
    i, j, found = n, m, []
    while i or j:
        here = rows[i][j]
        if i and j and rows[i - 1].get(j - 1, far) + (a[i - 1] != b[j - 1]) == here:
            if a[i - 1] != b[j - 1]:
                found.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif i and rows[i - 1].get(j, far) + 1 == here:
            found.append((a[i - 1], ""))
            i -= 1
        else:
            found.append(("", b[j - 1]))
            j -= 1
    return found


def alike(x: str, y: str) -> bool:
    """True if two words are one word and its misspelling: at most a third of the letters apart."""
    if not x or not y:
        return False
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1] <= max(1, max(len(x), len(y)) // 3)


def turned(ws: list[str], bounds: list[int]) -> Iterator[list[str]]:
    """ws with the part after one bound turned so that it starts at a later bound."""
    for h in [0, *bounds]:
        for c in bounds:
            if c > h:
                yield ws[:h] + ws[c:] + ws[h:c]


def same_record(a: tuple, b: tuple) -> bool:
    """a, b: words, bounds and names of two records.

    They are the same if a few word edits lead from one to the other, in the given order or after one
    part was turned round at a sentence bound, and no edit puts one name in place of another.
    """
    k = max(edits(len(a[0])), edits(len(b[0])))
    x, y = Counter(a[0]), Counter(b[0])
    if abs(len(a[0]) - len(b[0])) > k or (x - y).total() > k or (y - x).total() > k:
        return False
    found = banded(a[0], b[0], k)
    if found is None:
        for ws in turned(a[0], a[1]):
            if (found := banded(ws, b[0], k)) is not None:
                break
        else:
            for ws in turned(b[0], b[1]):
                if (found := banded(a[0], ws, k)) is not None:
                    break
            else:
                return False
    if not any(x and y and not alike(x, y) for x, y in found):
        return True
    left, right = set(a[2]), set(b[2])
    swaps = [(x, y) for x, y in found if x and y and not alike(x, y)]
    return not any((x in left or not left) and (y in right or not right) and (left or right) for x, y in swaps)


#: One bit of 128 for each word of a text, in two numbers; an edit changes at most one bit of each kind.
MARK = "aggregate(codes, 0L, (bits, x) -> if(x & 64 = {}, bits | shiftleft(1L, cast(x & 63 as int)), bits))"


def spans() -> list[tuple[int, int, int | None, int, int | None]]:
    """(segment length, and which texts it is for: fewest test words, test words it ends below, the same of training)."""
    out, starts = [], [*SEGMENTS.values(), None]
    for length, least, above in zip(SEGMENTS, starts, starts[1:]):
        out.append((length, least, above, least - most_edits(least), above and above + most_edits(above)))
    return out


def shifts(n: int, bounds: list[int], most: int = 64) -> list[int] | None:
    """By how many words a segment of a text of n words may move if a part is turned; None if more than most ways."""
    if len(bounds) * (len(bounds) + 1) // 2 > most:
        return None
    found = {0}
    for h in [0, *bounds]:
        for c in bounds:
            if c > h:
                found |= {h - c, n - c}
    return sorted(found)


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a list column in one array, and where the rows begin and end in it."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]


def window_hashes(codes: np.ndarray, ends: np.ndarray, length: int, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, place, hash) of every substring of so many words of the given rows; codes are the words' hashes."""
    count = np.maximum(np.diff(ends)[rows] - length + 1, 0)
    row = np.repeat(rows, count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = ends[row] + at
    with np.errstate(over="ignore"):
        h = np.full(len(begin), length, np.uint64)
        for j in range(length):
            h = (h ^ codes[begin + j].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return row, at, h.view(np.int64)


def overlapping_records(
    questions: DataFrame, name: str = "variable_name", label: str = "label", question: str = "question",
    split: str = "split", held: str = "test", corpus: str = "train",
) -> DataFrame:
    """held_name, corpus_name of every pair of an evaluation and a training record that are the same.

    Text is label and question together; NULL counts as empty and a record without words matches
    nothing. Equal texts are one class; classes are compared, and at the end every pair of members comes
    out. Repeated rows give no repeated pairs; rows without a name and other splits are left out.

    Of each evaluation text needed(n) disjoint segments are cut, more than the edits and turns that
    same_record accepts can spoil, so that every pair it accepts shares one. Longer texts get longer
    segments (SEGMENTS). Of all cuts the one rarest in training is taken, so stock phrases are used only
    where a text has nothing else. The segments are joined by hash with the training substrings of that
    length; kept are those at an allowed place (as many words away as edits, or moved by a turned part)
    in texts of fitting length whose words' bits (MARK) differ by no more than the edits, and the rest is verified by banded dynamic programming, with sentences
    turned round where needed (see same_record).

    Training substrings never leave their task unless a sieve of bounded size (Sieve) says that a test
    text has them: one pass counts those of all test substrings, one finds those of the chosen segments.
    """
    side = F.when(F.col(f"`{split}`") == held, True).when(F.col(f"`{split}`") == corpus, False)
    raw = questions.select(
        F.col(f"`{name}`").alias("name"),
        F.col(f"`{label}`").alias("a"),
        F.col(f"`{question}`").alias("b"),
        side.alias("held"),
    ).where("name is not null and held is not null")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [record(a, b) for a, b in zip(batch["a"], batch["b"])]
            yield pd.DataFrame(
                {
                    "name": batch["name"],
                    "held": batch["held"],
                    "words": [d[0] for d in done],
                    "bounds": [d[1] for d in done],
                    "names": [d[2] for d in done],
                }
            )

    parsed = cut(
        spread(raw)
        .mapInPandas(parse, "name string, held boolean, words array<string>, bounds array<int>, names array<string>")
        .where(F.size("words") > 0)
        .withColumn("cls", F.unhex(F.md5(F.array_join("words", " "))))
    )
    classes = cut(
        parsed.groupBy("held", "cls")
        .agg(
            F.min("words").alias("words"),
            F.max_by("bounds", F.struct(F.size("bounds"), F.col("bounds"))).alias("bounds"),
            F.max_by("names", F.struct(F.size("names"), F.col("names"))).alias("names"),
        )
        .withColumn("id", F.monotonically_increasing_id())
    )
    coded = classes.select("held", "id", "bounds", F.transform("words", lambda w: F.xxhash64(w)).alias("codes")).withColumn(
        "marks", F.array(*[F.expr(MARK.format(part)) for part in (0, 64)])
    )
    tests, train = coded.where("held").drop("held"), coded.where("not held").drop("held")

    def own_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, ends = flat(b["codes"])
            ids, n = b["id"].to_numpy(), np.diff(ends)
            for length, least, above, _, _ in spans():
                rows = np.flatnonzero((n >= least) & (n < (above or n.max(initial=0) + 1)))
                row, at, h = window_hashes(codes, ends, length, rows)
                yield pa.RecordBatch.from_pydict({"id": ids[row], "at": at.astype("i4"), "hash": h})

    def training_windows(sieve: Sieve, b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, place, hash) of the windows that pass the sieve, by segment length."""
        codes, ends = flat(b["codes"])
        n = np.diff(ends)
        for length, _, _, least, above in spans():
            rows = np.flatnonzero((n >= max(least, length)) & (n < (above or n.max(initial=0) + 1)))
            row, at, h = window_hashes(codes, ends, length, rows)
            keep = sieve(h)
            yield row[keep], at[keep], h[keep]

    here = cut(tests.select("id", "codes").mapInArrow(own_windows, "id bigint, at int, hash bigint"))
    known = Sieve(here, "hash")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [h for _, _, h in training_windows(known, b)]
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"hash": h, "n": n})

    df = train.select("codes").mapInArrow(counted, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("df"))
    ranked = (
        here.join(df, "hash", "left")
        .groupBy("id")
        .agg(F.collect_list(F.struct("at", "hash", F.coalesce("df", F.lit(0)).alias("df"))).alias("found"))
        .join(tests.select("id", "bounds", F.size("codes").alias("size"), "marks"), "id")
    )

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = {least: length for length, least in SEGMENTS.items()}
        for b in batches:
            out = []
            for r in b.itertuples():
                size = lengths[max(least for least in lengths if least <= r.size)]
                cost, hashes = [0] * len(r.found), [0] * len(r.found)
                for x in r.found:
                    cost[x["at"]], hashes[x["at"]] = x["df"], x["hash"]
                moves, k = shifts(r.size, list(r.bounds)), most_edits(r.size)
                out += [(r.id, at, hashes[at], r.size, k, moves, r.marks) for at in cheapest(cost, size, needed(r.size)) if cost[at]]
            yield pd.DataFrame(out, columns=["test", "at", "hash", "size", "k", "moves", "marks"])

    segments = cut(
        ranked.mapInPandas(chosen, "test bigint, at int, hash bigint, size int, k int, moves array<int>, marks array<bigint>")
    )
    wanted = Sieve(segments, "hash")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, bounds, n = b["id"].to_numpy(), b["bounds"].to_pylist(), np.diff(flat(b["codes"])[1])
            marks = flat(b["marks"])[0].reshape(-1, 2)
            moves: dict[int, list[int] | None] = {}
            for row, at, h in training_windows(wanted, b):
                for i in np.unique(row):
                    if i not in moves:
                        moves[i] = shifts(int(n[i]), bounds[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(at.astype("i4")), pa.array(h), pa.array(n[row].astype("i4")),
                     pa.array([moves[i] for i in row], pa.list_(pa.int32())), pa.array(marks[row, 0]), pa.array(marks[row, 1])],
                    ["train", "there", "hash", "other", "turns", "low", "high"],
                )

    there = train.mapInArrow(
        met, "train bigint, there int, hash bigint, other int, turns array<int>, low bigint, high bigint"
    )
    gap, k = F.col("there") - F.col("at"), F.col("k")
    placed = (
        F.col("moves").isNull()
        | F.col("turns").isNull()
        | F.exists("moves", lambda x: F.abs(gap - x) <= k)
        | F.exists("turns", lambda x: F.abs(gap + x) <= k)
    )
    few = F.abs(F.col("size") - F.col("other")) <= k
    ours, theirs = (F.col("marks")[0], F.col("marks")[1]), (F.col("low"), F.col("high"))
    for one, other in ((ours, theirs), (theirs, ours)):
        few &= sum(F.bit_count(x.bitwiseAND(F.bitwise_not(y))) for x, y in zip(one, other)) <= k
    pairs = (
        segments.join(there, "hash").where(few & placed)
        .select("test", "train").distinct()
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [
                same_record((list(r.aw), list(r.ab), list(r.an)), (list(r.bw), list(r.bb), list(r.bn)))
                for r in b.itertuples()
            ]
            yield b.loc[good, ["held_cls", "train_cls"]]

    left = classes.where("held").select(
        F.col("id").alias("test"), F.col("cls").alias("held_cls"), F.col("words").alias("aw"), F.col("bounds").alias("ab"),
        F.col("names").alias("an"),
    )
    right = classes.where("not held").select(
        F.col("id").alias("train"), F.col("cls").alias("train_cls"), F.col("words").alias("bw"), F.col("bounds").alias("bb"),
        F.col("names").alias("bn"),
    )
    same = pairs.join(left, "test").join(right, "train").mapInPandas(verify, "held_cls binary, train_cls binary")
    held_rows = parsed.where("held").select(F.col("cls").alias("held_cls"), F.col("name").alias("held_name")).distinct()
    corpus_rows = parsed.where("not held").select(F.col("cls").alias("train_cls"), F.col("name").alias("corpus_name")).distinct()
    return same.join(held_rows, "held_cls").join(corpus_rows, "train_cls").select("held_name", "corpus_name").distinct()
