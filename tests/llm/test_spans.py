import random

import pytest

from riwaya.llm import spans


def brute(texts):
    """Shared characters of each text by all its windows."""
    where = {}
    for k, t in enumerate(texts):
        for i in range(len(t or "") - 59):
            where.setdefault(t[i : i + 60], set()).add(k)
    out = {}
    for k, t in enumerate(texts):
        marked = set()
        for i in range(len(t or "") - 59):
            if len(where[t[i : i + 60]]) > 1:
                marked |= set(range(i, i + 60))
        if marked:
            out[k] = len(marked)
    return out


def make(seed, alphabet, n):
    random.seed(seed)
    piece = lambda size: "".join(random.choice(alphabet) for _ in range(size))
    passages = [piece(random.choice([30, 59, 60, 61, 75, 120, 300])) for _ in range(25)]
    out = []
    for _ in range(n):
        out.append("".join(random.choice(passages) if random.random() < 0.5 else piece(random.randint(0, 60)) for _ in range(random.randint(0, 5))))
    return out


@pytest.mark.parametrize(("seed", "alphabet", "hot"), [(1, "ابتثجحخ دذرزس", 100_000), (2, "ab", 100_000), (3, "ابتثج", 1), (4, "a", 100_000), (5, "ab", 3)])
def test_equals_brute_force(spark, seed, alphabet, hot):
    texts = make(seed, alphabet, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "rec long, text string").repartition(5)
    got = {r.rec: r.shared_chars for r in spans.shared_text(df, hot).collect()}
    assert got == brute(texts)
    for r in spans.factors(df, hot).collect():
        assert r.source != r.rec and r.end - r.start >= 60
        assert texts[r.rec][r.start : r.end] == texts[r.source][r.source_start : r.source_start + r.end - r.start]


def test_edges(spark):
    random.seed(8)
    long = "".join(random.choice("ابتثجحخدذ ") for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, "x" * 59), (4, "x" * 59), (5, "ab" * 60), (6, long), (7, long[100:160]), (8, long[200:259]), (None, long), (9, "q" * 200), (7, long[100:160]), (10, "\U0001f642" * 60), (11, "z" + "\U0001f642" * 60)]
    df = spark.createDataFrame(rows, "rec long, text string").withColumnRenamed("rec", "rec")
    got = {r.rec: (r.shared_chars, r.n_chars) for r in spans.shared_text(df.withColumn("start", df.rec)).collect()}
    assert got == {6: (60, 30_000), 7: (60, 60), 10: (60, 60), 11: (60, 61)}
    assert spans.factors(df.filter("rec < 0")).count() == 0
    two = spark.createDataFrame([(1, long[:500]), (1, long[300:330]), (1, "y" * 70), (2, long[100:200])], "rec long, text string")
    assert {r.rec for r in spans.factors(two).collect()} == {1, 2}


def test_a_long_passage_is_one_factor_and_every_record_can_come_out(spark):
    random.seed(9)
    piece = lambda n: "".join(random.choice("ابتثجحخدذرزسشص ") for _ in range(n))
    passage, other = piece(5_000), piece(70_000)  # beyond one segment, too
    rows = [(1, piece(300) + passage + piece(90)), (2, passage + piece(400)), (3, piece(80)), (4, None), (5, other), (6, piece(10) + other)]
    df = spark.createDataFrame(rows, "rec long, text string")
    for hot in (spans.HOT, 0):
        got = {(r.rec, r.start, r.end, r.source, r.source_start) for r in spans.factors(df, hot).collect()}
        assert got == {(1, 300, 5_300, 2, 0), (2, 0, 5_000, 1, 300), (5, 0, 70_000, 6, 10), (6, 10, 70_010, 5, 0)}
    every = {r.rec: (r.n_chars, r.shared_chars, r.share) for r in spans.shared_text(df, every=True).collect()}
    assert every[3] == (80, 0, 0.0) and every[4] == (0, 0, 0.0) and every[2] == (5_400, 5_000, 5_000 / 5_400) and len(every) == 6
