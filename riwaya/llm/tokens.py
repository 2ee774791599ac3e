"""Problem 7: encoding a corpus with a public byte-level BPE tokenizer.

Method: texts are cut into pretokens with numpy over code-point arrays, the
distinct pretokens of a batch are laid into zero-padded matrices by length
bucket, and in each round every row merges its leftmost pair of minimum rank;
pairs are looked up in a hash table, rows are compacted after each merge and
leave the matrix when no pair is left. Rows beyond the last bucket merge all
occurrences of their minimum pair in a round where that provably gives the same.

Defined cases: '' and null give an empty list of ids. Strings that look like
special tokens are ordinary text. The vocabulary's file is a parameter.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riwaya.llm import codes as C

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# ---- fixed values -------------------------------------------------------
#: Endings that stay one pretoken with their apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White space by the Unicode property.
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# -------------------------------------------------------------------------

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128, 512)
NONE = np.int32(2**31 - 1)
SLICE_CHARS = 2_000_000


@functools.cache
def classes() -> np.ndarray:
    """By code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for a, b in ((0, 0x3400), (0xA000, 0x33480), (0xE0000, 0xE01F0)):
        for c in range(a, b):
            if (k := unicodedata.category(chr(c))[0]) in "LN":
                out[c] = LETTER if k == "L" else NUMBER
    out[0x3400:0x4DC0] = out[0x4E00:0xA000] = LETTER
    out[list(WHITE)] = SPACE
    return out


def pretokens(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of all pretokens in ``codes``; every row starts one."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    row_start = np.zeros(n + 1, bool)
    row_start[at] = True
    start = row_start[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    is_space = kind == SPACE
    # the last white space before other text stands alone; a plain space goes to the text after it
    follows = np.zeros(n, bool)
    follows[:-1] = ~is_space[1:] & ~row_start[1:n]
    last = is_space & follows
    start |= last
    taken = last & (codes == 0x20)
    after = np.flatnonzero(taken) + 1
    start[after] = False
    # contractions: a lone apostrophe that begins a pretoken
    lone = np.flatnonzero(start & (codes == 0x27))
    if len(lone):
        wide = np.concatenate([codes, np.zeros(3, codes.dtype)])
        end = at[1:][np.searchsorted(at, lone, side="right") - 1]
        done = np.zeros(len(lone), bool)
        for x in CONTRACTIONS:
            hit = ~done & (lone + len(x) < end)
            for k, ch in enumerate(x):
                hit &= wide[lone + 1 + k] == ord(ch)
            done |= hit
            p = lone[hit]
            start[p + 1] = False
            rest = p + 1 + len(x)
            rest = rest[rest < n]
            start[rest] = True
            # a white space after the ending keeps what was decided for it above
            fix = rest[is_space[rest] & ~row_start[rest]]
            start[fix] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Ranks of byte sequences, with a hash table of the pairs that merge."""

    def __init__(self, path: str):
        lines = (x.split() for x in Path(path).read_bytes().splitlines() if x)
        rank = {base64.b64decode(a): int(b) for a, b in lines}
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for token, r in rank.items():
            for k in range(1, len(token)):
                a, b = rank.get(token[:k]), rank.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    made.append(r)
        key, rank_of = np.array(keys, np.int64), np.array(made, np.int32)
        #: Tokens that some pair with a lower rank holds: those are merged one at a time.
        self.delicate = np.zeros(max(rank.values()) + 1, bool)
        for side in (key >> 20, key & 0xFFFFF):
            self.delicate[side[rank_of < side]] = True
        self.bits = 21
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = self.keys[slot[left]] < 0
            first = np.unique(slot[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]], self.ranks[slot[put]] = key[put], rank_of[put]
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, NONE where the pair doesn't merge (a negative id merges with nothing)."""
        key = a.astype(np.int64) << 20 | b
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero((a >= 0).ravel() & (b >= 0).ravel())
        key, flat = key.ravel()[todo], out.ravel()
        slot = self._slot(key)
        while len(todo):
            there = self.keys[slot]
            hit = there == key
            flat[todo[hit]] = self.ranks[slot[hit]]
            more = ~hit & (there >= 0)
            todo, key, slot = todo[more], key[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def _matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a matrix padded with -1; returns the matrix after all merges and the rows' lengths."""
        ids = ids.copy()
        ranks = self.pair(ids[:, :-1], ids[:, 1:])
        active = np.arange(len(ids))
        work = ids
        while True:
            best = ranks.argmin(1)
            rows = np.arange(len(work))
            low = ranks[rows, best]
            going = low < NONE
            if not going.all():
                ids[active[~going], : work.shape[1]] = work[~going]
                ids[active[~going], work.shape[1] :] = -1
                active, work, ranks, best, low = active[going], work[going], ranks[going], best[going], low[going]
                if not len(active):
                    break
                used = max(2, int((work >= 0).sum(1).max()))
                work, ranks = work[:, :used], ranks[:, : used - 1]
                rows = np.arange(len(work))
            col = np.arange(work.shape[1])
            shifted = np.concatenate([work[:, 1:], np.full((len(work), 1), -1, work.dtype)], 1)
            work = np.where(col > best[:, None], shifted, work)
            work[rows, best] = low
            moved = np.concatenate([ranks[:, 1:], np.full((len(work), 1), NONE, ranks.dtype)], 1)
            ranks = np.where(col[:-1] > best[:, None], moved, ranks)
            top = ranks.shape[1]
            here = best < top
            r, b = rows[here], best[here]
            ranks[r, b] = self.pair(work[r, b], work[r, b + 1])
            r, b = rows[best > 0], best[best > 0]
            ranks[r, b - 1] = self.pair(work[r, b - 1], work[r, b])
        return ids, (ids >= 0).sum(1)

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """Merge one long row; all non-overlapping occurrences of the minimum pair at once where that is safe."""
        while len(ids) > 1:
            ranks = self.pair(ids[:-1], ids[1:])
            low = ranks.min()
            if low == NONE:
                break
            hit = np.flatnonzero(ranks == low)
            if self.delicate[low]:
                hit = hit[:1]
            else:  # in a run of overlapping hits every second one, from the left
                run = np.cumsum(np.concatenate([[True], np.diff(hit) > 1]))
                first = np.searchsorted(run, run)
                hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            ids = ids.copy()
            ids[hit] = low
            ids = np.delete(ids, hit + 1)
        return ids

    def merge(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all byte rows and their n + 1 offsets."""
        size = np.diff(at)
        count = np.zeros(len(size), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for top in BUCKETS:
            rows = np.flatnonzero((size > low) & (size <= top))
            low = top
            for k in range(0, len(rows), 1 << 16):
                some = rows[k : k + (1 << 16)]
                pos = at[some, None] + np.arange(max(top, 2))
                inside = np.arange(max(top, 2)) < size[some, None]
                ids = np.where(inside, self.byte[raw[np.where(inside, pos, 0)]], -1).astype(np.int32)
                ids, n = self._matrix(ids)
                count[some] = n
                parts.append((some, ids, n))
        long = [(r, self._long(self.byte[raw[at[r] : at[r + 1]]])) for r in np.flatnonzero(size > low)]
        for r, ids in long:
            count[r] = len(ids)
        ends = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(ends[-1], np.int32)
        for some, ids, n in parts:
            take = np.arange(ids.shape[1]) < n[:, None]
            out[(ends[some, None] + np.arange(ids.shape[1]))[take]] = ids[take]
        for r, ids in long:
            out[ends[r] : ends[r + 1]] = ids
        return out, ends


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _distinct(codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of pretokens that stand for all equal ones, and for each pretoken the place of its stand-in among them."""
    at = np.concatenate([start, [len(codes)]])
    size = np.diff(at)
    pos = np.arange(len(codes)) - np.repeat(start, size)
    with np.errstate(over="ignore"):
        h = C.segment_sum((codes.astype(np.uint64) + np.uint64(0x9E37)) * C.powers(0x2545F4914F6CDD1D, int(size.max(initial=0)))[pos], at)
        h = C.mix(h + size.astype(np.uint64), 5)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    # equal hashes are compared; a pretoken that differs from its stand-in stands for itself
    stand = first[back]
    same = size[stand] == size
    ok = np.flatnonzero(same)
    source = np.repeat(start[stand[ok]] - start[ok], size[ok])
    mine = np.flatnonzero(np.repeat(same, size))
    differ = codes[mine] != codes[mine + source]
    if differ.any() or not same.all():
        bad = ~same
        bad[np.searchsorted(at, mine[differ], side="right") - 1] = True
        more = np.flatnonzero(bad)
        back[more] = len(first) + np.arange(len(more))
        first = np.concatenate([first, more])
    return first, back


def encode(codes: np.ndarray, at: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a batch and the n + 1 offsets of the rows."""
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    start = pretokens(codes, at)
    first, back = _distinct(codes, start)
    ends = np.concatenate([start, [len(codes)]])
    size = ends[first + 1] - ends[first]
    own = np.concatenate([[0], np.cumsum(size)])
    pos = np.repeat(start[first], size) + np.arange(own[-1]) - np.repeat(own[:-1], size)
    raw, raw_at = C.to_bytes(C.to_arrow(codes[pos], own))
    ids, ids_at = vocab.merge(raw, raw_at)
    n = np.diff(ids_at)[back]
    total = np.concatenate([[0], np.cumsum(n)])
    take = np.repeat(ids_at[:-1][back] - total[:-1], n) + np.arange(total[-1])
    return ids[take], total[np.searchsorted(start, at)]


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a batch of about SLICE_CHARS code points; a row is never split."""
    codes, at = C.to_codes(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_CHARS)))
        j = min(j, len(column))
        yield i, codes[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the column ``ids`` (array<int>): the tokens of ``text``; '' and null give []."""
    df = df.drop(*[c for c in df.columns if c == ids and c != text])
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for i, codes, at in _slices(batch.column(batch.schema.get_field_index(text))):
                found, ends = encode(codes, at, vocab)
                made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found))
                part = batch.slice(i, len(at) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*batch.schema.names, ids])

    return df.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", name: str = "n_tokens", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` without ``text`` and with its number of tokens; 0 for '' and null."""
    keep = [f for f in df.schema.fields if f.name not in (text, name)]
    schema = T.StructType([*keep, T.StructField(name, T.LongType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for i, codes, at in _slices(batch.column(batch.schema.get_field_index(text))):
                _, ends = encode(codes, at, vocab)
                part = batch.slice(i, len(at) - 1)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(np.diff(ends))], names=[*names, name])

    return df.select(*names, text).mapInArrow(run, schema)
