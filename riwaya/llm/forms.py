"""Problem 3: one consistent form for texts that look the same in print.

Method: Arrow text is copied to numpy code-point arrays; lookup tables are
gathered over whole batches, one-to-many entries are written by expansion
offsets, marks are put into canonical order and composed with their bases
vectorially. No Python call is made for a single row or character.

What is unified: full-width, half-width and presentation forms; letters with a
separate mark and the composed letter; order of marks; invisible characters;
spaces of another kind; Latin look-alikes of Cyrillic and Greek; and Arabic
look-alikes only in the positions where print shows no difference (keheh and
heh doachashmee joined to a following letter, Farsi yeh by position, Eastern
digits other than 4, 5, 6). What print shows (vowel marks, dots, hamza,
lengthening strokes, punctuation, superscripts, word ligatures) stays.

Defined cases: null stays null, '' stays '', a text of invisible characters
becomes ''; the form of a form is itself.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riwaya.llm import codes as C

# ---- fixed values -------------------------------------------------------
#: Compatibility tags whose characters print like their decomposition.
ALIKE_TAGS = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>")
#: Single characters that print like others.
ALIKE = {
    "․": ".", "‐": "-", "‑": "-", "∶": ":", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "\t": " ",
    "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩",
}
#: Cyrillic and Greek letters beside the Latin letters they look like.
CYRILLIC, CYRILLIC_AS = "АВЕКМНОРСТУХЅІЈаеорсухѕіј", "ABEKMHOPCTYXSIJaeopcyxsij"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"
#: Ranges of characters that print nothing.
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x180B, 0x180E), (0x200B, 0x200B), (0x200E, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
)
#: Arabic letters that join only to the letter before them.
RIGHT_JOINING = "آأؤإاةدذرزوٱٲٳٵٶٷڈډڊڋڌڍڎڏڐڑڒړڔڕږڗژڙۀۃۄۅۆۇۈۉۊۋۍۏےۓەۮۯ"
#: Arabic letters that never join.
NON_JOINING = "ءٴ"
# -------------------------------------------------------------------------

ZWNJ, ZWJ, KEHEH, KAF, FARSI_YEH, YEH, MAKSURA = 0x200C, 0x200D, 0x06A9, 0x0643, 0x06CC, 0x064A, 0x0649
DOACHASHMEE, HEH, HAMZA_ABOVE, YEH_HAMZA = 0x06BE, 0x0647, 0x0654, 0x0626


def _parts(char: str) -> str:
    """Full decomposition of a character by what looks the same."""
    if char in ALIKE:
        return ALIKE[char]
    if 0xFDF0 <= ord(char) <= 0xFDFF:
        return char
    if unicodedata.category(char) == "Zs":
        return " "
    d = unicodedata.decomposition(char).split()
    if not d:
        return char
    if d[0].startswith("<"):
        if d[0] not in ALIKE_TAGS:
            return char
        d = d[1:]
        if d[0] in ("0020", "0640"):  # a free-standing mark
            return char
    return "".join(_parts(chr(int(x, 16))) for x in d)


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """Lookup tables by code point, built once for each Python worker."""
    top = sys.maxunicode + 1
    to = np.arange(top, dtype=np.uint32)
    size = np.ones(top, np.uint8)
    ccc = np.zeros(top, np.uint8)
    join = np.zeros(top, np.uint8)  # 1: joins to the letter before, 2: to the letter after
    start, tail = np.zeros(top, np.int32), []
    looks = dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS, strict=True))
    pairs = []
    for c in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x13000), *range(0x1D000, 0x1F700), 9):
        ch = chr(c)
        if k := unicodedata.combining(ch):
            ccc[c] = k
        parts = _parts(ch)
        out = "".join(looks.get(x, x) for x in parts)
        if out != ch:
            to[c], size[c], start[c] = ord(out[0]), len(out), len(tail)
            tail += [ord(x) for x in out[1:]]
        d = unicodedata.decomposition(ch).split()
        if len(d) == 2 and d[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            pairs.append((int(d[0], 16), int(d[1], 16), c))
    for a, b in INVISIBLE:
        size[a : b + 1] = 0
    for c in range(0x0620, 0x0700):
        if unicodedata.category(chr(c)) == "Lo" and chr(c) not in NON_JOINING:
            join[c] = 1 if chr(c) in RIGHT_JOINING else 3
    join[0x0640] = 3
    pairs += [(MAKSURA, HAMZA_ABOVE, YEH_HAMZA), (FARSI_YEH, HAMZA_ABOVE, YEH_HAMZA)]
    key = np.array([a << 21 | b for a, b, _ in pairs], np.int64)
    order = np.argsort(key)
    return {"to": to, "size": size, "start": start, "tail": np.array(tail, np.uint32), "ccc": ccc, "join": join, "pair": key[order], "made": np.array([c for *_, c in pairs], np.uint32)[order]}


def _expand(codes: np.ndarray, at: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Gather the table's entries; entries of several characters are written at their expansion offsets."""
    size = t["size"][codes].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint32)
    some = size > 0
    out[ends[:-1][some]] = t["to"][codes[some]]
    many = np.flatnonzero(size > 1)
    if len(many):
        rest = size[many] - 1
        nth = np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
        out[np.repeat(ends[many], rest) + 1 + nth] = t["tail"][np.repeat(t["start"][codes[many]], rest) + nth]
    return out, ends[at]


def _neighbours(codes: np.ndarray, at: np.ndarray, passed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the nearest element before and after it in its row that isn't passed over; 0 where none."""
    n = len(codes)
    idx = np.arange(n)
    row = C.row_of(at)
    before = np.maximum.accumulate(np.where(passed, -1, idx)) if n else idx
    before = np.concatenate([[-1], before[:-1]]) if n else idx
    after = np.minimum.accumulate(np.where(passed, n, idx)[::-1])[::-1] if n else idx
    after = np.concatenate([after[1:], [n]]) if n else idx
    ok_b = (before >= at[row]) if n else idx.astype(bool)
    ok_a = (after < at[row + 1]) if n else idx.astype(bool)
    wide = np.concatenate([codes, [0]]).astype(np.uint32)
    return np.where(ok_b, wide[np.where(ok_b, before, n)], 0), np.where(ok_a, wide[np.where(ok_a, after, n)], 0)


def _by_position(codes: np.ndarray, at: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Arabic look-alikes where the shape in print depends on the letters around; joiners that change nothing."""
    if not np.isin(codes, (ZWNJ, ZWJ, KEHEH, FARSI_YEH, DOACHASHMEE)).any():
        return codes, at
    mark = t["ccc"][codes] > 0
    joiner = (codes == ZWNJ) | (codes == ZWJ)
    before, after = _neighbours(codes, at, mark | joiner)
    touches = ((t["join"][before] & 2) > 0) & ((t["join"][after] & 1) > 0)
    keep = ~joiner | ((codes == ZWNJ) & touches) | ((codes == ZWJ) & ~touches & ((t["join"][before] | t["join"][after]) > 0))
    codes, at = C.select(codes, at, keep)
    _, after = _neighbours(codes, at, t["ccc"][codes] > 0)
    joined = ((t["join"][codes] & 2) > 0) & (((t["join"][after] & 1) > 0) | (after == ZWJ))
    out = codes.copy()
    out[(codes == KEHEH) & joined] = KAF
    out[(codes == DOACHASHMEE) & joined] = HEH
    out[codes == FARSI_YEH] = MAKSURA
    out[(codes == FARSI_YEH) & joined] = YEH
    return out, at


def _order_marks(codes: np.ndarray, at: np.ndarray, t: dict) -> np.ndarray:
    """Canonical order: within a run of marks a stable sort by combining class."""
    ccc = t["ccc"][codes]
    wrong = np.flatnonzero((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]))
    if not len(wrong):
        return codes
    first = np.zeros(len(codes), bool)
    first[at[:-1][at[:-1] < len(codes)]] = True
    base = np.cumsum((ccc == 0) | first)
    order = np.lexsort((np.arange(len(codes)), ccc, base))
    return codes[order]


def _compose(codes: np.ndarray, at: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Compose marks with their bases; each round takes the next mark of every base at once."""
    ccc = t["ccc"][codes]
    first = np.zeros(len(codes), bool)
    first[at[:-1][at[:-1] < len(codes)]] = True
    starter = (ccc == 0) | first
    marks = np.flatnonzero(~starter)
    if not len(marks):
        return codes, at
    base = np.maximum.accumulate(np.where(starter, np.arange(len(codes)), 0))[marks]
    out, keep = codes.copy(), np.ones(len(codes), bool)
    last = np.zeros(len(codes), np.uint8)
    round_of = marks - base
    # by rounds: the marks of each round stand together, so a long run of marks costs its own length only
    by_round = np.argsort(round_of, kind="stable")
    ends = np.searchsorted(round_of[by_round], np.arange(1, int(round_of.max()) + 2))
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        m, b = marks[by_round[lo:hi]], base[by_round[lo:hi]]
        want = out[b].astype(np.int64) << 21 | codes[m]
        at_pair = np.minimum(np.searchsorted(t["pair"], want), len(t["pair"]) - 1)
        hit = (t["pair"][at_pair] == want) & (last[b] < ccc[m]) & (t["ccc"][out[b]] == 0)
        out[b[hit]] = t["made"][at_pair[hit]]
        keep[m[hit]] = False
        last[b[~hit]] = ccc[m[~hit]]
    return C.select(out, at, keep)


def consistent(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of all rows of a batch."""
    t = tables()
    codes, at = _expand(codes, at, t)
    codes, at = _by_position(codes, at, t)
    return _compose(_order_marks(codes, at, t), at, t)


def consistent_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``<column>_form`` for each of ``columns``: the text in consistent form.

    Null stays null; all other columns of ``df`` pass through unchanged. A
    clashing ``<column>_form`` that ``df`` already has is replaced.
    """
    names = [f"{c}_form" for c in columns]
    df = df.drop(*names)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.StringType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for c in columns:
                column = batch.column(batch.schema.get_field_index(c))
                null = np.asarray(column.is_null())
                made.append(C.to_arrow(*consistent(*C.to_codes(column)), null))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def form_keys(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """One row (field, id, raw1, raw2, form1, form2) for each non-null value: 128-bit keys of text and form."""
    names = [*columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in names:
                column = batch.column(batch.schema.get_field_index(c))
                ids = batch.column(batch.schema.get_field_index(id_column))
                some = column.is_valid()
                column, ids = column.filter(some), ids.filter(some)
                codes, at = C.to_codes(column)
                form, form_at = consistent(codes, at)
                keys = [C.row_hash(codes, at, 1), C.row_hash(codes, at, 2), C.row_hash(form, form_at, 1), C.row_hash(form, form_at, 2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * len(ids), pa.string()), ids.cast(pa.int64()), *(pa.array(k) for k in keys)],
                    names=["field", "id", "raw1", "raw2", "form1", "form2"],
                )

    return df.select(id_column, *names).mapInArrow(run, "field string, id long, raw1 long, raw2 long, form1 long, form2 long")


#: Members of a class that are expanded into pairs by one task, about.
MEMBERS = 20_000


def lookalike_classes(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(field, unit, rep): the rows whose form stands under several stored values, with the smallest id of their stored value."""
    rows, classes = _classes(form_keys(df.filter(F.col(id_column).isNotNull()), id_column, columns).checkpoint())
    return rows.join(classes.select(*CLASS, "rep"), CLASS).select("field", F.col("id").alias("unit"), "rep")


CLASS = ["field", "form1", "form2", "raw1", "raw2"]


def _classes(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of forms that stand under several stored values, and their classes (equal stored values) with rep, n."""
    classes = keys.groupBy(*CLASS).agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    mixed = classes.groupBy(*CLASS[:3]).agg(F.count("*").alias("values")).filter("values > 1").select(*CLASS[:3])
    return keys.join(mixed, CLASS[:3]), classes.join(mixed, CLASS[:3])


def lookalike_pairs(df: DataFrame, id_column: str, columns: list[str], members: bool = True) -> DataFrame:
    """Pairs (field, unit_a, unit_b) of rows whose values look the same but aren't equal as stored.

    Rows with equal stored values are one class; only different classes of a form
    are paired, then expanded into their rows, a class of many rows in several
    tasks. A group of mere copies, however large, costs one row. With
    ``members=False`` the pairs are those of representatives; their rows are in
    :func:`lookalike_classes`. Keys are made once and kept. Nulls are in no pair,
    rows without id neither; '' pairs with texts that print nothing.
    """
    rows, classes = _classes(form_keys(df.filter(F.col(id_column).isNotNull()), id_column, columns).checkpoint())
    parts = F.ceil(F.col("n") / MEMBERS)
    a = classes.select(*CLASS[:3], F.col("raw1").alias("a1"), F.col("raw2").alias("a2"), F.col("rep").alias("rep_a"), parts.alias("parts_a"))
    b = classes.select(*CLASS[:3], F.col("raw1").alias("b1"), F.col("raw2").alias("b2"), F.col("rep").alias("rep_b"), parts.alias("parts_b"))
    pairs = a.join(b, CLASS[:3]).filter("a1 < b1 or (a1 = b1 and a2 < b2)")
    if not members:
        return pairs.select("field", F.least("rep_a", "rep_b").alias("unit_a"), F.greatest("rep_a", "rep_b").alias("unit_b"))
    # rows know the number of parts of their class; a pair meets each part of both sides
    sized = rows.join(classes.select(*CLASS, parts.alias("parts")), CLASS).select("field", "raw1", "raw2", "id", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    spread = pairs.withColumn("part_a", each("parts_a")).withColumn("part_b", each("parts_b"))
    of = lambda k, name: sized.select("field", F.col("raw1").alias(f"{k}1"), F.col("raw2").alias(f"{k}2"), F.col("part").alias(f"part_{k}"), F.col("id").alias(name))
    both = spread.join(of("a", "x"), ["field", "a1", "a2", "part_a"]).join(of("b", "y"), ["field", "b1", "b2", "part_b"])
    # a repeated row of one id is no partner of itself
    return both.filter("x <> y").select("field", F.least("x", "y").alias("unit_a"), F.greatest("x", "y").alias("unit_b"))
