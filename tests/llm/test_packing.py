import random
from collections import defaultdict

import pytest

from riwaya.llm.packing import containers, pack


def check(rows, items, capacity):
    """All invariants; returns the tokens of each container."""
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        if r.container is None:
            assert r.n_tokens == 0
        else:
            filled[r.container].append((r.place, r.n_tokens))
    for doc, _, n in items:
        own = sorted(pieces[doc], key=lambda r: r.start)
        assert sum(r.n_tokens for r in own) == n
        assert len(own) == max(1, -(-n // capacity)), "only items above the capacity are split"
        at = 0
        for k, r in enumerate(own):
            assert (r.start, r.piece) == (at, k)
            at += r.n_tokens
    for parts in filled.values():
        at = 0
        for place, n in sorted(parts):
            assert place == at
            at += n
        assert at <= capacity
    return {c: sum(n for _, n in p) for c, p in filled.items()}


@pytest.mark.parametrize("part_tokens", [10**9, 40_000])
def test_packs_everything_tightly(spark, part_tokens):
    random.seed(3)
    items = [(k, random.choice(["a", "a", "a", "b", None]), min(9000, int(random.paretovariate(1.1) * 60))) for k in range(3000)]
    rows = pack(spark.createDataFrame(items, "doc_id long, source string, n_tokens long"), part_tokens=part_tokens).collect()
    filled = check(rows, items, 2048)
    least = -(-sum(n for *_, n in items) // 2048)
    parts = max(1, -(-sum(n for *_, n in items) // part_tokens))
    assert len(filled) <= least * 1.01 + parts


def test_edges(spark):
    items = [(1, None, 0), (2, "a", 2048), (3, "a", 2049), (4, "b", 5000), (5, "b", 1), (6, "c", 0)]
    df = spark.createDataFrame(items, "doc_id long, source string, n_tokens long")
    check(pack(df).collect(), items, 2048)
    assert pack(df.filter("doc_id < 0")).count() == 0
    assert containers(pack(df)).filter("unused < 0").count() == 0
    nulls = spark.createDataFrame([(None, "a", 3), (None, "a", None), (7, "a", 5), (7, "a", 5)], "doc_id long, source string, n_tokens long")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in pack(nulls).collect())
    assert got == [(0, 0), (0, 3), (7, 5), (7, 5)]


def test_mixture_holds_in_each_stretch(spark):
    """Every window of containers has about the target proportions, though the sources come one after the other."""
    items = [(k, "a" if k < 3000 else "b", 500 + k % 100) for k in range(6000)]
    rows = pack(spark.createDataFrame(items, "doc_id long, source string, n_tokens long"), {"a": 0.5, "b": 0.5}).collect()
    by = defaultdict(lambda: [0, 0])
    for r in rows:
        by[r.container // 512][r.doc_id >= 3000] += r.n_tokens
    whole = [x for x in by.values() if sum(x) > 400 * 2048]
    assert whole and all(0.4 < x[0] / sum(x) < 0.6 for x in whole)
