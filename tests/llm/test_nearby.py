import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riwaya.llm import codes as C
from riwaya.llm import nearby


def similarity(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def texts_with_edits(seed, n, vocabulary, common):
    random.seed(seed)
    letters = "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
    words = ["".join(random.choice(letters) for _ in range(random.randint(2, 7))) for _ in range(vocabulary)]
    draw = lambda: random.choice(words[:5]) if random.random() < common else random.choice(words)
    out = []
    for _ in range(n):
        if out and random.random() < 0.5:
            w = random.choice(out).split()
            for _ in range(random.randint(0, len(w) // 4 + 1)):
                k = random.randrange(len(w) + 1)
                w[k : k + random.randint(0, 1)] = [draw()] if random.random() < 0.6 else []
            random.shuffle(w) if random.random() < 0.3 else None
            out.append(" ".join(w) or draw())
        else:
            out.append(" ".join(draw() for _ in range(random.randint(1, 40))))
    return out


def brute(texts):
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if similarity(texts[i], texts[j]) >= 0.7 - 1e-12}


@pytest.mark.parametrize(("seed", "vocabulary", "common", "block"), [(1, 300, 0.2, 4000), (2, 12, 0.5, 4000), (3, 300, 0.6, 3), (4, 8, 0.5, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, vocabulary, common, block):
    """Also where every word is too frequent for its block, so that words are joined."""
    texts = texts_with_edits(seed, 250, vocabulary, common)
    elements, at = nearby.bags(*C.to_codes(pa.array(texts)))
    monkeypatch.setattr(nearby, "BLOCK", block)
    found, number = np.unique(elements, return_counts=True)
    row, key, index = nearby.block_keys(elements, at, found, number / len(texts), len(texts))
    prints, n = nearby.fingerprints(elements, at), np.diff(at)
    a, b = nearby.search_blocks(key, prints[row], n[row], index, budget=500)
    likely = {(min(x, y), max(x, y)) for x, y in zip(row[a].tolist(), row[b].tolist(), strict=True) if x != y}
    assert brute(texts) <= likely


def test_frame_equals_brute_force(spark):
    texts = texts_with_edits(9, 300, 200, 0.2)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text_ar string").repartition(5)
    assert {tuple(r) for r in nearby.near_pairs(df).collect()} == brute(texts)


def test_gray_rank_orders_codes_by_single_changes():
    """Codes in the order of their rank differ in one bit from one to the next."""
    prints = np.zeros((16, 4), np.uint64)
    prints[:, 3] = np.arange(16)
    order = np.argsort(nearby.gray_rank(prints)[:, 3])
    codes = prints[order, 3].astype(int)
    assert all(bin(int(a ^ b)).count("1") == 1 for a, b in zip(codes[:-1], codes[1:], strict=True))


def test_different_bits_never_exceed_different_words():
    texts = texts_with_edits(5, 80, 60, 0.3)
    elements, at = nearby.bags(*C.to_codes(pa.array(texts)))
    prints = nearby.fingerprints(elements, at)
    for i in range(80):
        for j in range(i):
            x, y = set(elements[at[i] : at[i + 1]].tolist()), set(elements[at[j] : at[j + 1]].tolist())
            assert np.bitwise_count(prints[i] ^ prints[j]).sum() <= len(x ^ y)


def test_edges(spark):
    rows = [(1, "قال الرجل"), (2, "قَالَ، الرجل ١٢ abc"), (3, None), (4, ""), (5, "123"), (6, "الرجل قال"), (None, "قال الرجل"), (7, "رأى الناس"), (8, "رأي الناس"), (9, "كلمه " * 30_000), (10, "كلمة " * 30_000)]
    df = spark.createDataFrame(rows, "id long, text_ar string").withColumnRenamed("id", "id")
    got = {tuple(r) for r in nearby.near_pairs(df).collect()}
    assert got == {(1, 2), (1, 6), (2, 6), (7, 8), (9, 10)}
    assert {tuple(r) for r in nearby.near_pairs(df, members=False).collect()} == set()
    assert nearby.near_pairs(df.filter("id < 0")).count() == 0


@pytest.mark.parametrize(("large", "rows"), [(4, 7), (20, 1_000)])
def test_large_blocks_are_searched_by_cells(spark, monkeypatch, large, rows):
    monkeypatch.setattr(nearby, "LARGE", large)
    monkeypatch.setattr(nearby, "BLOCK", 3)
    monkeypatch.setattr(nearby, "DEPTH", 1)
    monkeypatch.setattr(nearby, "ROWS", rows)
    texts = texts_with_edits(11, 200, 30, 0.4)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text_ar string").repartition(5)
    assert {tuple(r) for r in nearby.near_pairs(df).collect()} == brute(texts)


def test_representatives_and_members_give_all_pairs(spark):
    texts = texts_with_edits(12, 150, 100, 0.2) * 2
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text_ar string")
    rep = {r.unit: r.rep for r in nearby.equal_bags(df).collect()}
    near = {tuple(r) for r in nearby.near_pairs(df, members=False).collect()}
    made = {(a, b) for a in rep for b in rep if a < b and (rep[a] == rep[b] or (min(rep[a], rep[b]), max(rep[a], rep[b])) in near)}
    assert made == {tuple(r) for r in nearby.near_pairs(df).collect()}


def test_bags_are_exchanged_once_for_both_sides(spark):
    texts = texts_with_edits(9, 300, 200, 0.2)
    df = spark.createDataFrame([*enumerate(texts), (7, texts[7]), (900, texts[7])], "id long, text_ar string").repartition(5)
    pairs = nearby.near_pairs(df, members=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan and "bag1" not in plan, "representatives are found once, and sent once"
    assert {tuple(r) for r in nearby.near_pairs(df).collect()} == brute(texts) | {tuple(sorted((x, 900))) for p in [*brute(texts), (7, 7)] if 7 in p for x in [p[0] + p[1] - 7]}
