"""Problem 5: rows that differ in formatting only.

Method: the characters of each column are streamed through a skip-and-fold
lookup table (white space and punctuation are skipped, letters folded to lower
case) into rolling polynomial hashes; no canonical string is made. The words of
``bag`` columns enter by the sum of their hashes, so their order doesn't count.
A page enters by its labelled parts in any order, or by its numbers in order
where no label stands. Rows with equal hashes are compared with the row of the
smallest id by skipping comparison; rows that a collision brought together are
grouped again by their exact content.

Defined cases: null equals null only; '' and a value of mere punctuation are
equal to each other and to nothing else. A row without id is no copy and has none. Combining
marks, tatweel and digit scripts count.
"""

from __future__ import annotations

import functools
import string
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riwaya.llm import codes as C

SKIP = 0
#: Copies that are compared with their first row by one task, about.
TOGETHER = 50_000
DIGIT_BIT = np.uint32(1 << 24)


@functools.cache
def fold_table() -> np.ndarray:
    """By code point: 0 if skipped, otherwise the folded code point, with DIGIT_BIT set for digits."""
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in (*range(0x3100), *range(0xA000, 0xAC00), *range(0xFE00, 0x10000), *range(0x10000, 0x12000), *range(0x1D400, 0x1E000)):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "P" or kind[0] == "Z" or ch.isspace() or ch in string.punctuation:
            out[c] = SKIP
        elif kind == "Nd":
            out[c] = c | DIGIT_BIT
        elif len(low := ch.lower()) == 1:
            out[c] = ord(low)
    return out


def _runs(folded: np.ndarray, at: np.ndarray, typed: bool) -> np.ndarray:
    """True where a word begins: after what is skipped, at the row's start and, if ``typed``, between digits and others."""
    n = len(folded)
    kept = folded != SKIP
    first = np.zeros(n + 1, bool)
    first[at] = True
    begins = kept.copy()
    begins[1:] &= ~kept[:-1] | first[1:n]
    if typed:
        digit = folded >= DIGIT_BIT
        begins[1:] |= kept[1:] & kept[:-1] & (digit[1:] != digit[:-1])
    return begins


def _sequence(folded: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    kept, kept_at = C.select(folded, at, folded != SKIP)
    return C.row_hash(kept, kept_at, seed).view(np.uint64)


def _words(folded: np.ndarray, at: np.ndarray, seed: int, typed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its first code and the offsets of the rows in words."""
    begins = _runs(folded, at, typed)
    start = np.flatnonzero(begins)
    kept, where = folded[folded != SKIP], np.cumsum(folded != SKIP)
    ends = np.concatenate([where[start] - 1, [len(kept)]])
    h = C.row_hash(kept, ends, seed).view(np.uint64)
    return h, folded[start], np.concatenate([[0], np.cumsum(begins)])[at]


def _bag(folded: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    h, _, words_at = _words(folded, at, seed, typed=False)
    return C.mix(C.segment_sum(C.mix(h, seed + 11), words_at), seed + 12)


def _page(folded: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """Parts of a page: a label with what follows it; parts without label keep their order."""
    h, first, words_at = _words(folded, at, seed, typed=True)
    n = len(h)
    label = first < DIGIT_BIT
    starts = label.copy()
    starts[words_at[:-1][words_at[:-1] < n]] = True
    part = np.flatnonzero(starts)
    size = np.diff(np.concatenate([part, [n]]))
    nth = np.arange(n) - np.repeat(part, size)
    with np.errstate(over="ignore"):
        mixed = C.mix(h, seed + 21) * C.powers(0x9E3779B97F4A7C15 | 1, int(size.max(initial=0)))[nth]
    parts_at = np.concatenate([part, [n]])
    of_part = C.mix(C.segment_sum(mixed, parts_at), seed + 22)
    rows = np.concatenate([[0], np.cumsum(starts)])[words_at]
    return C.mix(C.segment_sum(of_part, rows), seed + 23)


HASHES = {"sequence": _sequence, "bag": _bag, "page": _page, "exact": lambda codes, at, seed: C.row_hash(codes, at, seed).view(np.uint64)}


def content_hash(batch: pa.RecordBatch, rules: dict[str, str], seed: int = 1) -> np.ndarray:
    """64-bit hash of each row by what counts in its columns; ``rules`` is column -> sequence, bag, page or exact."""
    total = np.zeros(batch.num_rows, np.uint64)
    for k, (name, rule) in enumerate(rules.items()):
        column = batch.column(batch.schema.get_field_index(name))
        null = np.asarray(column.is_null())
        codes, at = C.to_codes(column.cast(pa.string()))
        own = HASHES[rule](codes if rule == "exact" else fold_table()[codes], at, seed + k)
        with np.errstate(over="ignore"):
            total = C.mix(total * np.uint64(0x9E3779B97F4A7C15) + np.where(null, np.uint64(k + 1), own), seed + 31)
    return total.view(np.int64)


def _content(value: str | None, rule: str):
    """What counts in a value, for the comparison of two."""
    if value is None or rule == "exact":
        return value
    table = fold_table()
    kept = [int(table[ord(c)]) for c in value]
    if rule == "sequence":
        return tuple(c for c in kept if c != SKIP)
    folded, at = np.array(kept, np.uint32), np.array([0, len(kept)])
    start = np.flatnonzero(_runs(folded, at, rule == "page")) if kept else []
    made = []
    for a, b in zip(start, [*start[1:], len(kept)], strict=True) if len(start) else ():
        made.append(tuple(c for c in kept[a:b] if c != SKIP))
    if rule == "bag":
        return tuple(sorted(made))
    parts: list[list] = []
    for w in made:
        if not parts or w[0] < DIGIT_BIT:
            parts.append([])
        parts[-1].append(w)
    return tuple(sorted(map(tuple, parts)))


def same_content(a: str | None, b: str | None, rule: str) -> bool:
    """Comparison with two pointers that skip what doesn't count; only words in another order need more."""
    if a == b:
        return True
    if a is None or b is None or rule == "exact":
        return False
    table, i, j = fold_table(), 0, 0
    breaks_a = breaks_b = False
    while True:
        while i < len(a) and table[ord(a[i])] == SKIP:
            i, breaks_a = i + 1, True
        while j < len(b) and table[ord(b[j])] == SKIP:
            j, breaks_b = j + 1, True
        if i == len(a) or j == len(b):
            if i == len(a) and j == len(b):
                return True
            break
        if table[ord(a[i])] != table[ord(b[j])] or (rule != "sequence" and i and j and breaks_a != breaks_b):
            break
        i, j, breaks_a, breaks_b = i + 1, j + 1, False, False
    return rule != "sequence" and _content(a, rule) == _content(b, rule)


def hidden_copies(df: DataFrame, id_column: str, rules: dict[str, str], hasher: Callable[[pa.RecordBatch, dict[str, str]], np.ndarray] = content_hash) -> DataFrame:
    """(keep_id, copy_id): each row that isn't the smallest id of its group, with that smallest id.

    Groups are rows with equal content by ``rules``. Copies are counted before
    anything is shuffled by group; a group of any size is one row of the
    aggregate. Texts are fetched only for rows that have a partner.
    """
    names = [f"c{k}" for k in range(len(rules))]
    rows = df.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), *[F.col(c).cast("string").alias(n) for c, n in zip(rules, names, strict=True)])
    ruled = dict(zip(names, rules.values(), strict=True))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hasher(batch, ruled))], names=["id", "key"])

    hashed = rows.mapInArrow(keys, "id long, key long").checkpoint()
    # the row of the smallest id meets its copies in parts, so that one of very many copies isn't in one task
    least = hashed.groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1").select("key", "keep_id", F.ceil(F.col("n") / TOGETHER).alias("parts"))
    pairs = hashed.join(least, "key").filter("id <> keep_id").select("key", "keep_id", F.col("id").alias("copy_id"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    kept = least.select("keep_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    a = kept.join(rows.select(F.col("id").alias("keep_id"), F.struct(*names).alias("a")), "keep_id")
    b = rows.select(F.col("id").alias("copy_id"), F.struct(*names).alias("b"))
    checked = pairs.join(b, "copy_id").join(a, ["keep_id", "part"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(batch.schema.get_field_index("a")), batch.column(batch.schema.get_field_index("b"))
            ok = np.ones(batch.num_rows, bool)
            for k, rule in enumerate(rules.values()):
                x, y = left.field(k), right.field(k)
                for r in np.flatnonzero(~np.asarray(pa.compute.equal(x, y).fill_null(False))):
                    ok[r] &= same_content(x[r].as_py(), y[r].as_py(), rule)
            exact = [None if good else repr([_content(right.field(k)[r].as_py(), rule) for k, rule in enumerate(rules.values())]) for r, good in enumerate(ok)]
            get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([get("key"), get("keep_id"), get("copy_id"), pa.array(exact, pa.string())], names=["key", "keep_id", "copy_id", "exact"])

    checked = checked.mapInArrow(verify, "key long, keep_id long, copy_id long, exact string").checkpoint()
    other = checked.filter("exact is not null").groupBy("key", "exact").agg(F.min("copy_id").alias("keep_id"))
    collided = checked.filter("exact is not null").drop("keep_id").join(other, ["key", "exact"]).filter("copy_id <> keep_id")
    return checked.filter("exact is null").select("keep_id", "copy_id").unionByName(collided.select("keep_id", "copy_id"))


def collapse(df: DataFrame, id_column: str, rules: dict[str, str], copies: str = "copies") -> DataFrame:
    """One row for each group, that of the smallest id, with the number of rows of the group."""
    found = hidden_copies(df, id_column, rules)
    count = found.groupBy(F.col("keep_id").alias("_keep")).agg(F.count("*").alias("_more"))
    kept = df.drop(*[c for c in (copies, "_keep", "_more", "_copy") if c in df.columns]).join(found.select(F.col("copy_id").alias("_copy")), F.col(id_column) == F.col("_copy"), "left_anti")
    return kept.join(count, F.col(id_column) == F.col("_keep"), "left").withColumn(copies, F.coalesce("_more", F.lit(0)) + 1).drop("_keep", "_more")
