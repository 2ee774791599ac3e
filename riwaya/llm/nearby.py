"""Problem 4: near-duplicate texts, by the similarity of their bags of words.

Method: each bag becomes a fingerprint of 256 bits in which every word (with the
number of its occurrence) flips one bit. Two fingerprints then differ in at most
as many bits as the bags differ in words, so the similarity bounds the number of
different bits, and searching by different bits loses nothing. Fingerprints are
searched in a Gray-order hierarchical index: sorted by Gray rank, the bits that
all members of a node share are factored into the node, and a whole node is
pruned as soon as the differences accumulated on the way down exceed the bound.

An index over all texts would not prune at this similarity (about 20 of 256 bits
may differ), and pairs of all texts are out of the question. So the root level
of the index is spread by content: a text enters the blocks of its rarest words,
as many as two similar texts can't both avoid (prefix filter); a word that is
too frequent for a block is joined with the next ones. Each block has its own
index. Both steps are exact; the pairs found are verified on the bags.

Texts with equal bags are one until the end. Defined cases: a text without words
(null, empty, only digits or Latin letters) is similar to none; repeated rows
are texts of their own, if their ids differ; rows without id are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riwaya.llm import codes as C
from riwaya.llm.forms import consistent
from riwaya.session import kept

# ---- fixed values -------------------------------------------------------
#: Letters unified in the project's matching form, each group to its first letter.
UNIFIED = ("اأإآٱٲٳ", "يىئی", "هة", "وؤ", "كکگ")
#: Ranges of marks, signs and lengthening strokes that are left out.
LEFT_OUT = ((0x0610, 0x061A), (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06ED), (0x0640, 0x0640), (0x200B, 0x200F), (0x202A, 0x202E), (0xFEFF, 0xFEFF))
LETTERS = (0x0621, 0x064A)
# -------------------------------------------------------------------------

BITS = 256
#: A block is meant to hold so many texts; words expected in more are joined with further ones, up to DEPTH.
BLOCK, DEPTH = 4000, 3
#: Words in fewer than one of so many texts aren't ranked among themselves. Bounds the table of frequencies: it has at most RARE times as many entries as a text has words on average.
RARE = 5000
#: Words in the table of frequencies at most; where texts are so long that RARE would give more, fewer words are ranked.
KNOWN = 2_000_000
#: A block of more texts is cut into cells, and searched by pairs of cells.
LARGE = 4 * BLOCK
#: Rows that are searched at a time, about.
ROWS = 50_000
#: Similarity as a fraction.
UP, DOWN = 7, 10


@functools.cache
def word_table() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the unified letter or 0, and whether the character is left out."""
    letter, out = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    letter[LETTERS[0] : LETTERS[1] + 1] = np.arange(LETTERS[0], LETTERS[1] + 1)
    for group in UNIFIED:
        letter[[ord(c) for c in group]] = ord(group[0])
    for a, b in LEFT_OUT:
        out[a : b + 1], letter[a : b + 1] = True, 0
    return letter, out


def bags(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements (hash of word and number of occurrence) of all rows, sorted within a row, and the offsets of the rows."""
    letter, out = word_table()
    codes, at = consistent(codes, at)
    codes, at = C.select(codes, at, ~out[codes])
    folded = letter[codes]
    begins = folded > 0
    first = np.zeros(len(folded) + 1, bool)
    first[at] = True
    begins[1:] &= (folded[:-1] == 0) | first[1 : len(folded)]
    start = np.flatnonzero(begins)
    kept, where = folded[folded > 0], np.cumsum(folded > 0)
    h = C.row_hash(kept, np.concatenate([where[start] - 1, [len(kept)]]), 1)
    words_at = np.concatenate([[0], np.cumsum(begins)])[at]
    row = C.row_of(words_at)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    idx = np.arange(len(h))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    nth = idx - np.maximum.accumulate(np.where(new, idx, 0)) if len(h) else idx
    with np.errstate(over="ignore"):
        element = C.mix(h.view(np.uint64) + C.mix(nth, 9), 3).view(np.int64)
    return element[np.lexsort((element, row))], words_at


def fingerprints(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity fingerprints, n x 4 words of 64 bits."""
    n = len(at) - 1
    bit = (C.mix(elements.view(np.uint64), 41) % np.uint64(BITS)).astype(np.int64)
    parity = np.bincount(C.row_of(at) * BITS + bit, minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(parity.astype(np.uint8), axis=1).view(">u8").astype(np.uint64)


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the Gray order of all, as n x 4 words."""
    out, carry = np.empty_like(prints), np.zeros(len(prints), np.uint64)
    for k in range(prints.shape[1]):
        w = prints[:, k].copy()
        for s in (1, 2, 4, 8, 16, 32):
            w ^= w >> np.uint64(s)
        w = np.where(carry > 0, ~w, w)
        out[:, k] = w
        carry = w & np.uint64(1)
    return out


def need(total: np.ndarray) -> np.ndarray:
    """Words in common that two bags with ``total`` words in all must have."""
    return -(-UP * total // (UP + DOWN))


def prefix_sizes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of its rarest words a text shows to texts of any size, and to larger ones or equals."""
    return n + (-UP * n // DOWN) + 1, n - need(2 * n) + 1


def block_keys(elements: np.ndarray, at: np.ndarray, heavy: np.ndarray, share: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, index) of the blocks each row enters; ``index``: it may be the smaller text of a pair there.

    ``heavy`` are the sorted elements of known frequency, ``share`` the part of
    all texts that hold them.
    """
    row = C.row_of(at)
    place = np.minimum(np.searchsorted(heavy, elements), max(len(heavy) - 1, 0))
    known = heavy[place] == elements if len(heavy) else np.zeros(len(elements), bool)
    part = np.where(known, share[place] if len(heavy) else 0.0, 1 / RARE)
    order = np.lexsort((elements, np.where(known, part, 0.0), row))
    e, part = elements[order], part[order]
    n = np.diff(at)
    far, near = prefix_sizes(n)
    rank = np.arange(len(e)) - at[:-1][row]
    closed = (part * texts <= BLOCK) | (n[row] == 1)
    single = (rank < far[row]) & closed
    rows, keys, index = [row[single]], [e[single]], [(rank < near[row])[single]]
    for r in np.unique(row[(rank < far[row]) & ~closed]):
        own, shares = e[at[r] : at[r + 1]], part[at[r] : at[r + 1]]
        level = [((i,), shares[i]) for i in range(int(far[r])) if shares[i] * texts > BLOCK]
        for depth in range(1, DEPTH):
            grown = [((*c, j), s * shares[j]) for c, s in level for j in range(c[-1] + 1, min(int(far[r]) + depth, int(n[r])))]
            # texts of four words and more share DEPTH words at least with a similar one, shorter ones all of theirs
            done = [(c, s) for c, s in grown if s * texts <= BLOCK or depth == DEPTH - 1 or len(c) == n[r]]
            level = [(c, s) for c, s in grown if s * texts > BLOCK]
            if done:
                at_ = np.array([c for c, _ in done])
                h = np.zeros(len(done), np.uint64)
                for k in range(at_.shape[1]):
                    with np.errstate(over="ignore"):
                        h = C.mix(h * np.uint64(3) + own[at_[:, k]].view(np.uint64), 50 + k)
                rows.append(np.full(len(done), r))
                keys.append(h.view(np.int64))
                index.append(at_[:, -1] < near[r] + depth)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(index)


FAN = (16, 2)


def _most_different(total: np.ndarray) -> np.ndarray:
    """Bound on the different words of all pairs with up to ``total`` words; it never falls as ``total`` grows."""
    return (DOWN - UP) * total // (UP + DOWN)


def _nodes(start: np.ndarray, size: np.ndarray, fan: int, ones: np.ndarray, any_: np.ndarray, most: np.ndarray) -> tuple:
    """Nodes of up to ``fan`` neighbours in Gray order within each block: first row, end, and what their members share."""
    count = -(-size // fan)
    first = np.repeat(start, count) + fan * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    end = np.minimum(first + fan, np.repeat(start + size, count))
    shared1 = np.bitwise_and.reduceat(ones, first, axis=0)
    shared0 = ~np.bitwise_or.reduceat(any_, first, axis=0)
    return first, end, shared1, shared1 | shared0, np.maximum.reduceat(most, first), np.concatenate([[0], np.cumsum(count)])


def _differ(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(1, dtype=np.int64)


def search_blocks(key: np.ndarray, prints: np.ndarray, n: np.ndarray, index: np.ndarray, budget: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) of rows of one key whose fingerprints differ by what the similarity allows.

    The rows of each key are put in Gray order and searched top-down, all
    queries of many blocks at a time.
    """
    ranks = gray_rank(prints)
    order = np.lexsort((*ranks.T[::-1], key))
    key, prints, n, index = key[order], prints[order], n[order].astype(np.int64), index[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([start, [len(key)]]))
    some = size > 1
    start, size = start[some], size[some]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # rows of blocks with one text only are outside of all nodes; reduceat needs them away
    inside = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    order, prints, n, index = order[inside], prints[inside], n[inside], index[inside]
    start = np.cumsum(size) - size
    levels = [_nodes(start, size, fan, prints, prints, n) for fan in FAN]
    block = np.repeat(np.arange(len(size)), size)
    a_out, b_out = [], []
    # slices of queries whose top nodes fit the budget
    tops = np.diff(levels[0][5])[block]
    cost = np.cumsum(tops * (FAN[0] // FAN[-1]) // 2 + 1)
    lo = 0
    while lo < len(block):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + budget)))
        q = np.repeat(np.arange(lo, hi), tops[lo:hi])
        node = np.repeat(levels[0][5][block[lo:hi]], tops[lo:hi]) + np.arange(len(q)) - np.repeat(np.cumsum(tops[lo:hi]) - tops[lo:hi], tops[lo:hi])
        spent = np.zeros(len(q), np.int64)
        above: np.ndarray | None = None
        for depth, (first, end, ones, mask, most, _) in enumerate(levels):
            own = mask[node] if above is None else mask[node] & ~above
            spent = spent + _differ((prints[q] ^ ones[node]) & own)
            total = n[q] + most[node]
            keep = (spent <= _most_different(total)) & (end[node] > q + 1)
            q, node, spent = q[keep], node[keep], spent[keep]
            above = mask[node]
            if depth + 1 < len(levels):
                below = levels[depth + 1]
                child = np.searchsorted(below[0], first[node])
                count = np.searchsorted(below[0], end[node]) - child
            else:
                child, count = first[node], end[node] - first[node]
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            q, spent, above = np.repeat(q, count), np.repeat(spent, count), np.repeat(above, count, axis=0)
            node = np.repeat(child, count) + nth
        fine = node > q
        q, leaf, spent, above = q[fine], node[fine], spent[fine], above[fine]
        small_q = n[q] <= n[leaf]
        role = np.where(n[q] == n[leaf], index[q] & index[leaf], np.where(small_q, index[q], index[leaf]))
        role &= np.minimum(n[q], n[leaf]) * DOWN >= UP * np.maximum(n[q], n[leaf])
        q, leaf, spent, above = q[role], leaf[role], spent[role], above[role]
        total = n[q] + n[leaf]
        ok = spent + _differ((prints[q] ^ prints[leaf]) & ~above) <= total - 2 * need(total)
        a_out.append(order[q[ok]])
        b_out.append(order[leaf[ok]])
        lo = hi
    return np.concatenate(a_out), np.concatenate(b_out)


def _bag_rows(df: DataFrame, id_column: str, text: str) -> DataFrame:
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, at = C.to_codes(batch.column(1))
            elements, ends = bags(codes, at)
            made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(elements))
            # order matters in these hashes, and elements are sorted within a row
            one, two = (C.segment_sum(C.mix(elements.view(np.uint64), s), ends).view(np.int64) for s in (61, 62))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(one), pa.array(two), made], names=["id", "bag1", "bag2", "bag"])
            yield out.filter(pa.array(np.diff(ends) > 0))

    return df.filter(F.col(id_column).isNotNull()).select(id_column, text).mapInArrow(run, f"id {kind}, bag1 long, bag2 long, bag array<long>")


def equal_bags(df: DataFrame, id_column: str = "id", text: str = "text_ar") -> DataFrame:
    """(unit, rep): each row with words, and the smallest id of those with an equal bag."""
    rows = _bag_rows(df, id_column, text).select("id", "bag1", "bag2").checkpoint()
    least = rows.groupBy("bag1", "bag2").agg(F.min("id").alias("rep"))
    return rows.join(least, ["bag1", "bag2"]).select(F.col("id").alias("unit"), "rep")


def near_pairs(df: DataFrame, id_column: str = "id", text: str = "text_ar", members: bool = True) -> DataFrame:
    """Pairs (unit_a, unit_b), unit_a < unit_b, of rows with similarity 0.7 or more.

    With ``members=False`` the pairs are those of representatives (the smallest
    id of each group of equal bags); their members are in :func:`equal_bags`.
    """
    spark = df.sparkSession
    rows = kept(_bag_rows(df, id_column, text), "bags")
    groups = rows.groupBy("bag1", "bag2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # bags are exchanged by id only; as bits, the other two columns aren't taken for keys of the join
    rep = groups.select(F.col("rep").alias("id"), F.col("bag1").alias("one"), F.col("bag2").alias("two"))
    own = F.col("bag1").bitwiseXOR(F.col("one")).bitwiseOR(F.col("bag2").bitwiseXOR(F.col("two"))) == 0
    reps = kept(rows.join(rep, "id").filter(own).dropDuplicates(["id", "bag1", "bag2"]).select("id", "bag"), "reps")
    number, words = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("bag")), F.lit(0))).first()
    texts = groups.count()
    # a word that is in n of the texts is in the table if n * rare >= all: at most rare times the words of a text
    rare = min(RARE, max(KNOWN * number // max(words, 1), 1))
    often = rows.select(F.explode("bag").alias("e")).groupBy("e").agg(F.count("*").alias("n")).filter(F.col("n") * rare >= number)
    found = often.toArrow().sort_by("e")
    heavy, share = found.column("e").to_numpy(), found.column("n").to_numpy() / max(texts, 1)
    known = spark.sparkContext.broadcast((heavy, np.minimum(share, 1.0)))
    kind = rows.schema["id"].dataType.simpleString()

    def blocks(bag: pa.Array) -> tuple[np.ndarray, ...]:
        elements = bag.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(bag).to_numpy())]).astype(np.int64)
        return (elements, at, *block_keys(elements, at, *known.value, texts))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, at, row, key, index = blocks(batch.column(1))
            raw = np.ascontiguousarray(fingerprints(elements, at)[row]).view(np.uint8)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(row), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(key), pa.array(np.diff(at)[row].astype(np.int32)), pa.array(index), packed], names=["id", "key", "n", "index", "print"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = np.unique(blocks(batch.column(1))[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    entered = reps.mapInArrow(enter, f"id {kind}, key long, n int, index boolean, print binary")
    # no block is above LARGE where even the most frequent word stands in fewer texts
    if max(share.max(initial=0.0), 1 / rare) * texts > LARGE:
        size = reps.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("size")).filter(F.col("size") > LARGE).checkpoint()
        if not size.isEmpty():
            # each row goes to all pairs of its cell with another one
            cell = F.pmod(F.xxhash64("id"), F.col("cells"))
            cut = entered.join(size.select("key", F.ceil(F.col("size") / BLOCK).alias("cells")), "key").withColumn("cell", cell)
            cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).filter("cell <> other")
            cut = cut.withColumn("key", F.xxhash64("key", F.least("cell", "other"), F.greatest("cell", "other"))).select(*entered.columns)
            entered = entered.join(size.select("key"), "key", "left_anti").select(*entered.columns).unionByName(cut)

    def searched(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        column = rows.column("print").cast(pa.binary(32)).combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        raw = np.frombuffer(column.buffers()[1], np.uint64)[column.offset * 4 : (column.offset + len(column)) * 4].reshape(-1, 4)
        a, b = search_blocks(rows.column("key").to_numpy(), raw, rows.column("n").to_numpy(), rows.column("index").to_numpy())
        ids = rows.column("id").to_numpy()
        a, b = ids[a], ids[b]
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        many = 0
        for batch in batches:  # sorted by key; whole blocks are searched as they come
            kept.append(batch)
            many += batch.num_rows
            if many < ROWS:
                continue
            table = pa.Table.from_batches(kept)
            key = table.column("key").to_numpy()
            end = int(np.searchsorted(key, key[-1]))
            if end:
                yield searched(table.slice(0, end))
                kept, many = table.slice(end).to_batches(), many - end
        if many:
            yield searched(pa.Table.from_batches(kept))

    likely = entered.repartition("key").sortWithinPartitions("key").mapInArrow(search, f"a {kind}, b {kind}").distinct()
    sent = reps.repartition("id")  # once for both sides
    left = sent.select(F.col("id").alias("a"), F.col("bag").alias("bag_a"))
    right = sent.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
    common = F.size(F.array_intersect("bag_a", "bag_b"))
    both = likely.join(left, "a").join(right, "b").withColumn("common", common)
    sure = both.filter(F.col("common") * DOWN >= (F.size("bag_a") + F.size("bag_b") - F.col("common")) * UP).select("a", "b")
    if not members:
        return sure.select(F.col("a").alias("unit_a"), F.col("b").alias("unit_b"))
    # members of groups of equal bags: pairs within a group, and between the groups of a verified pair
    member = rows.join(groups.filter("copies > 1").select("bag1", "bag2", "rep"), ["bag1", "bag2"]).select("rep", "id")
    inner = member.join(member.select("rep", F.col("id").alias("other")), "rep").filter("id < other").select(F.col("id").alias("unit_a"), F.col("other").alias("unit_b"))
    of = member.unionByName(groups.filter("copies = 1").select("rep", F.col("rep").alias("id")))
    outer = sure.join(of.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(of.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    return inner.unionByName(outer.select(F.least("x", "y").alias("unit_a"), F.greatest("x", "y").alias("unit_b")))
