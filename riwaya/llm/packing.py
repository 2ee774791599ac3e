"""Problem 8: texts measured in tokens into containers of fixed capacity.

Method: mixture-controlled packing. Items are spread over parts of bounded size
by a hash of their id. In each part the items wait in one queue for each source;
deficit round-robin takes from the queues what fills the next window of
containers in the target token proportions, and best-fit decreasing puts the
window's items into its containers. What the sources are owed is carried from
window to window, and from part to part: as every part places all of its items,
the debt at a part's start is the running difference of target and supply over
the parts before it, which Spark's window sums give without a sequential pass.

Containers stay open for ``HOLD`` windows, so gaps are filled by later small
items. Only an item above the capacity is split: into full containers and one
rest, which is packed like any item.

Defined cases: an item of 0 tokens (empty or null text) comes out once with a
null container; a null source is a source of its own. Each id is an item of its
own; rows that repeat an id are items too and come out as often as they come in.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
#: Tokens of a part, about, and containers of a window.
PART_TOKENS = 8_000_000
#: Items of a part at most, about; bounds its memory where items are tiny.
PART_ITEMS = 250_000
WINDOW = 256
HOLD = 8
#: Containers of a part have ids below this; a part has about PART_TOKENS / CAPACITY of them.
PART_IDS = 1 << 24

SCHEMA = "doc_id long, piece int, n_tokens long, start long, container long, place long"


class _Bins:
    """Open containers in order of free space; best fit takes the fullest that has room."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.made = capacity, [], 0
        self.born: dict[int, int] = {}

    def put(self, size: int, window: int) -> tuple[int, int]:
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            room, b = self.free.pop(k)
        else:
            room, b, self.made = self.capacity, self.made, self.made + 1
            self.born[b] = window
        if room > size:
            insort(self.free, (room - size, b))
        return b, self.capacity - room

    def close(self, before: int) -> None:
        if self.free and min(self.born[b] for _, b in self.free) < before:
            self.free = [x for x in self.free if self.born[x[1]] >= before]


def pack_part(sizes: np.ndarray, source: np.ndarray, owed: dict[int, float], share: dict[int, float], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Containers and offsets of a part's items (1 .. capacity tokens each).

    ``source`` numbers the queues; ``owed`` is what each is owed at the start and
    ``share`` its target proportion of tokens.
    """
    order = np.argsort(source, kind="stable")
    queues: dict[int, list[int]] = {}
    for i in order[::-1]:
        queues.setdefault(int(source[i]), []).append(int(i))
    debt = {s: float(owed.get(s, 0.0)) for s in queues}
    bins, window = _Bins(capacity), 0
    box, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    while queues:
        total = sum(share.get(s, 0.0) for s in queues)
        taken: list[int] = []
        for s in list(queues):
            part = share.get(s, 0.0) / total if total > 0 else 1 / len(queues)
            debt[s] += part * WINDOW * capacity
            queue = queues[s]
            while queue and sizes[queue[-1]] <= debt[s]:
                i = queue.pop()
                debt[s] -= sizes[i]
                taken.append(i)
            if not queue:
                del queues[s]
        taken.sort(key=lambda i: (-sizes[i], i))
        for i in taken:
            box[i], at[i] = bins.put(int(sizes[i]), window)
        window += 1
        bins.close(window - HOLD)
    return box, at


def pack(items: DataFrame, mixture: dict[str, float] | None = None, capacity: int = CAPACITY, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Assign items (doc_id long, source string, n_tokens long) to containers.

    Returns one row for each piece: doc_id, piece (0, 1, ...), n_tokens, start
    (the piece's first token in its text), container and place (its first token's
    place in the container). ``mixture`` gives target proportions by source;
    without it the proportions are those of the items themselves. Sources that it
    doesn't name have the weight 0: they are taken when the named ones are used up.
    """
    items = items.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).checkpoint()
    total, number = items.agg(F.sum("n_tokens"), F.count("*")).first()
    parts = max(1, -(-(total or 0) // part_tokens), -(-number // PART_ITEMS))
    placed = items.withColumn("part", F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(parts)).cast("long"))
    supply = placed.groupBy("part", "source").agg(F.sum("n_tokens").alias("tokens"))
    weight = F.col("own") / F.greatest(F.sum("own").over(Window.partitionBy("one")), F.lit(1))
    shares = supply.groupBy("source").agg(F.sum("tokens").alias("own")).withColumn("one", F.lit(1)).withColumn("share", weight)
    if mixture:
        named = F.create_map(*[F.lit(x) for kv in mixture.items() for x in kv])
        shares = shares.withColumn("share", F.coalesce(named[F.col("source")], F.lit(0.0)).cast("double"))
    # totals of parts, one small row each: a running sum over all parts
    whole_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = supply.groupBy("part").agg(F.sum("tokens").alias("all")).withColumn("all_before", F.coalesce(F.sum("all").over(whole_before), F.lit(0)))
    own_before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    due = shares.select(F.col("source").alias("s"), "share")
    owed = (
        supply.withColumn("own_before", own_before)
        .join(of_part, "part")
        .join(due, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("owed", F.col("share") * F.col("all_before") - F.col("own_before"))
        .select("part", F.lit(None).cast("long").alias("doc_id"), "source", F.lit(0).cast("long").alias("n_tokens"), "share", "owed")
    )
    rows = placed.select("part", "doc_id", "source", "n_tokens", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("owed")).unionByName(owed)

    def run(table: pa.Table) -> pa.Table:
        share_of, owed_of = (table.column(c).to_numpy() for c in ("share", "owed"))
        ruled = ~np.isnan(share_of)
        sources = table.column("source").to_pandas().fillna("\0").astype(str).to_numpy()
        number = np.unique(sources, return_inverse=True)[1]
        share = dict(zip(number[ruled].tolist(), share_of[ruled].tolist(), strict=True))
        debts = dict(zip(number[ruled].tolist(), owed_of[ruled].tolist(), strict=True))
        ids = table.column("doc_id").filter(pa.array(~ruled)).combine_chunks()
        n, src = table.column("n_tokens").to_numpy()[~ruled].astype(np.int64), number[~ruled]
        order = np.lexsort((n, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)))
        ids, n, src = ids.take(pa.array(order)), n[order], src[order]
        base = table.column("part")[0].as_py() * PART_IDS
        whole = n // capacity
        rest = n - whole * capacity
        some = np.flatnonzero(rest > 0)
        box, at = pack_part(rest[some], src[some], debts, share, capacity)
        made = int(box.max(initial=-1)) + 1
        which = np.repeat(np.arange(len(n)), whole)
        piece = np.arange(len(which)) - np.repeat(np.cumsum(whole) - whole, whole)
        nothing = np.flatnonzero(n == 0)
        out = {
            "doc_id": ids.take(pa.array(np.concatenate([some, which, nothing]))),
            "piece": np.concatenate([whole[some], piece, np.zeros(len(nothing), np.int64)]).astype(np.int32),
            "n_tokens": np.concatenate([rest[some], np.full(len(which), capacity), np.zeros(len(nothing), np.int64)]),
            "start": np.concatenate([whole[some] * capacity, piece * capacity, np.zeros(len(nothing), np.int64)]),
        }
        container = np.concatenate([base + box, base + made + np.arange(len(which)), np.zeros(len(nothing), np.int64)])
        place = np.concatenate([at, np.zeros(len(which) + len(nothing), np.int64)])
        none = np.zeros(len(container), bool)
        none[len(container) - len(nothing) :] = len(nothing) > 0
        columns = [out.pop("doc_id"), *(pa.array(v) for v in out.values()), pa.array(container, mask=none), pa.array(place, mask=none)]
        return pa.table(columns, names=["doc_id", "piece", "n_tokens", "start", "container", "place"])

    return rows.groupBy("part").applyInArrow(run, SCHEMA)


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each container: pieces, tokens and unused tokens."""
    return (
        packed.filter("container is not null")
        .groupBy("container")
        .agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
        .withColumn("unused", F.lit(capacity) - F.col("tokens"))
    )
