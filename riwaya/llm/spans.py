"""Problem 6: long passages that stand verbatim in more than one record.

Method: relative Lempel-Ziv parsing against indexed reference blocks. Every
window of ``LEAST`` characters selects one anchor, the gram of ``GRAM``
characters with the least hash in it, so two records that share a window share
its anchor. The corpus is cut into reference blocks by anchor: a block holds,
for each of its anchors that occurs in two records or more, the surroundings of
all occurrences, aligned at the anchor and indexed by the hashes of their
windows. Each record's surroundings are factored against the block: from the
left, a factor begins at the first window that another record holds and goes on
as long as windows match; where a factor ends, the windows across its boundary
are tried for the next. Factors are compared with their source character by
character. The factors of neighbouring blocks continue each other: those of one
record that lie on one diagonal of one source (equal difference of places) and
touch are one factor, so a factor is as long as the passage itself. The parse is
greedy: of the factors at a place it takes the one that reaches furthest, and
goes on where that ends.

No pair of records is ever formed: within a block windows are sorted, and a
window that a third of all records holds costs one comparison each. An anchor of
more than ``HOT`` occurrences isn't brought into one task: its occurrences are
spread by window, and the windows themselves, not hashes, are grouped.

Defined cases: null and texts below ``LEAST`` characters share nothing; a span
that a record only repeats within itself doesn't count; rows of one id are one
record, also where an id stands over several texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riwaya.llm import codes as C

LEAST, GRAM = 60, 30
SIDE = LEAST - GRAM
WIDTH = LEAST + SIDE
#: Occurrences of an anchor that one task takes.
HOT = 20_000
#: Characters of a record whose surroundings are cut at a time.
SEGMENT = 1 << 16
#: Rows of a block that are factored at a time, about.
ROWS = 20_000
BASE = 0x2545F4914F6CDD1D
SLICE_CHARS = 1_000_000
PAD = np.uint32(0x110000)


def anchors(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors of the rows."""
    n = len(codes)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inverse = C.powers(pow(BASE, -1, 2**64), n)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(codes, 1) * C.powers(BASE, n), dtype=np.uint64)])
        gram = C.mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1], 2)
    # least hash first, then the leftmost; the position rides in the low bits
    low = (gram & np.uint64(2**64 - 2**28)) | np.arange(len(gram), dtype=np.uint64)
    span, width = 1, LEAST - GRAM + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    start = np.arange(len(low))
    inside = start + LEAST <= at[1:][C.row_of(at)[: len(low)]]
    where = np.unique((low[inside] & np.uint64(2**28 - 1)).astype(np.int64))
    return where, gram[where].view(np.int64)


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    codes, at = C.to_codes(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = min(max(i + 1, int(np.searchsorted(at, at[i] + SLICE_CHARS))), batch.num_rows)
        yield batch.slice(i, j - i), codes[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _anchor_rows(records: DataFrame) -> DataFrame:
    """(anchor, rec, own, pos) of all records (rec long, own long, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, codes, at in _slices(batch, 2):
                where, gram = anchors(codes, at)
                row = np.searchsorted(at, where, side="right") - 1
                rec, own = (part.column(k).to_numpy()[row] for k in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(rec), pa.array(own), pa.array((where - at[row]).astype(np.int32))], names=["anchor", "rec", "own", "pos"])

    return records.mapInArrow(run, "anchor long, rec long, own long, pos int")


def _surroundings(spots: DataFrame) -> DataFrame:
    """(anchor, hot, rec, own, pos, piece) with the text around each anchor, from (rec, own, base, text, spots array<struct<anchor, hot, pos>>); ``base`` is where the text begins in its record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, codes, at in _slices(batch, 3):
                spot = part.column(4)
                many = pa.compute.list_value_length(spot).to_numpy()
                flat = spot.flatten()
                row = np.repeat(np.arange(part.num_rows), many)
                pos = flat.field("pos").to_numpy()
                inside = pos - part.column(2).to_numpy()[row]
                lo = np.minimum(np.maximum(at[row] + inside - SIDE, at[row]), at[row + 1])
                hi = np.maximum(np.minimum(at[row] + inside + GRAM + SIDE, at[row + 1]), lo)
                ends = np.concatenate([[0], np.cumsum(hi - lo)])
                take = np.repeat(lo - ends[:-1], hi - lo) + np.arange(ends[-1])
                rec, own = (pa.array(part.column(k).to_numpy()[row]) for k in range(2))
                yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("hot"), rec, own, flat.field("pos"), C.to_arrow(codes[take], ends)], names=["anchor", "hot", "rec", "own", "pos", "piece"])

    return spots.mapInArrow(run, "anchor long, hot boolean, rec long, own long, pos int, piece string")


def _aligned(piece: pa.Array, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Surroundings as rows of WIDTH codes with the anchor at SIDE, and which windows lie within the text."""
    codes, at = C.to_codes(piece)
    size = np.diff(at)
    left = np.minimum(pos, SIDE)
    table = np.full((len(size), WIDTH), PAD, np.uint32)
    column = np.arange(len(codes)) - np.repeat(at[:-1], size) + np.repeat(SIDE - left, size)
    table[C.row_of(at), column] = codes
    first = np.arange(SIDE + 1)
    return table, (first >= (SIDE - left)[:, None]) & (first + LEAST <= (SIDE - left + size)[:, None])


def _window_hashes(table: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Hash of anchor, place and content of each window of each row."""
    with np.errstate(over="ignore"):
        total = np.zeros((len(table), WIDTH + 1), np.uint64)
        np.cumsum(C.mix(table, 3) * C.powers(BASE, WIDTH), axis=1, dtype=np.uint64, out=total[:, 1:])
        h = total[:, LEAST:] - total[:, : SIDE + 1]
        return C.mix(h + C.mix(anchor, 4)[:, None] + C.mix(np.arange(SIDE + 1), 5)[None, :], 6)


def factor_block(anchor: np.ndarray, rec: np.ndarray, pos: np.ndarray, piece: pa.Array) -> tuple[np.ndarray, ...]:
    """Factors (row, start, end, source row, source start) of a reference block; rows are those of the arguments."""
    table, valid = _aligned(piece, pos)
    row, place = np.nonzero(valid)
    key = _window_hashes(table, anchor)[row, place]
    order = np.lexsort((rec[row], key))
    k = key[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([begin, [len(k)]]))
    low, high = np.repeat(order[begin], size), np.repeat(order[begin + size - 1] if len(k) else begin, size)
    source = np.empty(len(k), np.int64)
    source[order] = np.where(rec[row[low]] == rec[row[order]], high, low)
    other = np.flatnonzero(rec[row[source]] != rec[row])
    row, place, source = row[other], place[other], row[source[other]]
    # compare with the source where both are aligned
    pairs, back = np.unique(row * np.int64(len(rec)) + source, return_inverse=True) if len(row) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    equal = np.zeros((len(pairs), WIDTH + 1), np.int16)
    for i in range(0, len(pairs), 1 << 16):
        a, b = np.divmod(pairs[i : i + (1 << 16)], len(rec))
        np.cumsum(table[a] == table[b], axis=1, out=equal[i : i + (1 << 16), 1:])
    same = equal[back, place + LEAST] - equal[back, place] == LEAST
    row, place, source = row[same], place[same], source[same]
    # greedy: neighbouring windows of one source make one factor
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1])
    start = np.flatnonzero(head)
    stop = np.concatenate([start[1:], [len(row)]]) - 1 if len(row) else start
    return row[start], pos[row[start]] - SIDE + place[start], pos[row[stop]] - SIDE + place[stop] + LEAST, source[start], pos[source[start]] - SIDE + place[start]


FACTOR = "rec long, own long, start int, end int, source long, source_own long, source_start int"


def _factor_rows(around: DataFrame) -> DataFrame:
    """Factors of all blocks; rows come sorted by anchor and are factored as they come, some whole anchors at a time."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        get = lambda name: rows.column(name).to_numpy()
        rec, own = get("rec"), get("own")
        row, start, end, source, source_start = factor_block(get("anchor"), rec, get("pos").astype(np.int64), rows.column("piece"))
        columns = ((rec[row], pa.int64()), (own[row], pa.int64()), (start, pa.int32()), (end, pa.int32()), (rec[source], pa.int64()), (own[source], pa.int64()), (source_start, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in columns], names=["rec", "own", "start", "end", "source", "source_own", "source_start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        many = 0
        for batch in batches:
            kept.append(batch)
            many += batch.num_rows
            if many < ROWS:
                continue
            rows = pa.Table.from_batches(kept)
            anchor = rows.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                yield made(rows.slice(0, cut).combine_chunks())
                kept, many = rows.slice(cut).to_batches(), many - cut
        if many:
            yield made(pa.Table.from_batches(kept).combine_chunks())

    return around.mapInArrow(run, FACTOR)


def _hot_factors(around: DataFrame) -> DataFrame:
    """The same for anchors beyond HOT: each window is grouped with its equals, wherever they are."""
    left = F.least("pos", F.lit(SIDE))
    places = F.sequence(F.lit(0), F.length("piece") - LEAST)
    windows = around.filter(F.length("piece") >= LEAST).select("rec", "own", "piece", (F.col("pos") - left).alias("base"), F.explode(places).alias("i"))
    windows = windows.select(F.col("piece").substr(F.col("i") + 1, F.lit(LEAST)).alias("window"), "rec", "own", (F.col("base") + F.col("i")).cast("int").alias("start"))
    spot = F.struct("rec", "own", "start")
    shared = windows.groupBy("window").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).filter("lo.rec <> hi.rec")
    found = windows.join(shared, "window").withColumn("from", F.when(F.col("rec") == F.col("lo.rec"), F.col("hi")).otherwise(F.col("lo")))
    return found.select("rec", "own", "start", (F.col("start") + LEAST).cast("int").alias("end"), F.col("from.rec").alias("source"), F.col("from.own").alias("source_own"), F.col("from.start").alias("source_start"))


def _continued(found: DataFrame) -> DataFrame:
    """Factors that touch on one diagonal of one source are one."""
    line = ["rec", "own", "source", "source_own", "diagonal"]
    on = found.withColumn("diagonal", F.col("start") - F.col("source_start"))
    order = Window.partitionBy(*line).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(reach >= F.col("start"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = on.withColumn("part", part).groupBy(*line, "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.select("rec", "own", "start", "end", "source", "source_own", (F.col("start") - F.col("diagonal")).cast("int").alias("source_start"))


def _greedy(found: DataFrame) -> DataFrame:
    """The factors that a parse from the left takes: at each place the one that reaches furthest.

    A factor is left out exactly if those that begin no later, and the next one
    taken, cover it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, done, best = None, -1, None  # the record, how far it is parsed, and the furthest factor that begins before that
        for batch in batches:
            take: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    if best:
                        take.append(best)
                    key, done, best = row[:2], -1, None
                if best and row[2] > done:  # nothing further begins before the parsed text ends
                    take.append(best)
                    done, best = best[3], None
                if row[3] > (best[3] if best else done):
                    if row[2] > done:
                        take.append(row)
                        done = row[3]
                    else:
                        best = row
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*take, strict=True) if take else [[]] * 7, batch.schema.types, strict=True)], names=batch.schema.names)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(best, batch.schema.types, strict=True)], names=batch.schema.names)

    return found.repartition("rec", "own").sortWithinPartitions("rec", "own", "start", F.desc("end")).mapInArrow(run, FACTOR)


def factors(records: DataFrame, hot: int = HOT) -> DataFrame:
    """The factors (rec, own, start, end, source, source_own, source_start) of records (rec long, text string).

    ``own`` and ``source_own`` tell the texts of a record with several from each other. Neighbouring factors may overlap.
    """
    long = records.filter((F.length("text") >= LEAST) & F.col("rec").isNotNull()).select("rec", F.xxhash64("text").alias("own"), "text")
    seen = _anchor_rows(long).checkpoint()
    shared = seen.groupBy("anchor").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("anchor", (F.col("n") > hot).alias("hot"))
    segment = F.floor(F.col("pos") / SEGMENT).cast("int")
    spots = seen.join(shared, "anchor").groupBy("rec", "own", segment.alias("segment")).agg(F.collect_set(F.struct("anchor", "hot", "pos")).alias("spots"))
    # the text of each segment, with what surroundings take from its neighbours
    parts = long.select("rec", "own", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / SEGMENT).cast("int"))).alias("segment"))
    base = F.greatest(F.col("segment") * SEGMENT - SIDE, F.lit(0))
    parts = parts.select("rec", "own", "segment", base.alias("base"), F.when(F.length("text") <= SEGMENT, F.col("text")).otherwise(F.col("text").substr(base + 1, F.lit(SEGMENT + WIDTH))).alias("text"))
    spots = parts.join(spots, ["rec", "own", "segment"]).select("rec", "own", "base", "text", "spots").checkpoint()
    of = lambda flag: _surroundings(spots.withColumn("spots", F.filter("spots", lambda x: x.hot == F.lit(flag))).filter(F.size("spots") > 0))
    found = _factor_rows(of(False).repartition("anchor").sortWithinPartitions("anchor"))
    if not spots.filter(F.exists("spots", lambda x: x.hot)).isEmpty():
        found = found.unionByName(_hot_factors(of(True)))
    return _greedy(_continued(found))


def shared_text(records: DataFrame, hot: int = HOT, every: bool = False) -> DataFrame:
    """(rec, n_chars, shared_chars, share) for each record with a shared span: how much of it stands in others.

    With ``every`` the other records come out, too, with the share 0, also those without text. Several texts of one
    record are counted together, equal ones once. Rows without rec are left out.
    """
    before = Window.partitionBy("rec", "own").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = factors(records, hot).withColumn("new", new).groupBy("rec").agg(F.sum("new").alias("shared_chars"))
    text = F.coalesce("text", F.lit(""))
    size = records.filter("rec is not null").select("rec", F.length(text).alias("size"), F.xxhash64(text).alias("own")).distinct().groupBy("rec").agg(F.sum("size").alias("n_chars"))
    joined = size.join(covered, "rec", "left" if every else "inner").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    share = F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0))
    return joined.select("rec", "n_chars", "shared_chars", share.alias("share"))
