import random

import numpy as np
import pyarrow as pa
import pytest

from riwaya.llm import copies

RULES = {"u": "exact", "m": "bag", "p": "page", "g": "sequence"}


@pytest.mark.parametrize(
    ("rule", "a", "b", "same"),
    [
        ("sequence", "Hasan Sahih", " HASAN  sahih.", True), ("sequence", "حسن", "«حسن»،", True), ("sequence", "حسن", "حسَن", False), ("sequence", "a b", "b a", False),
        ("bag", "سامر بن زيد", "زيد، سامر بن", True), ("bag", "a a b", "a b b", False), ("bag", "ab c", "a bc", False), ("bag", "a_b", "b - a", True),
        ("page", "ج 7 ص 23", "ص23، ج7", True), ("page", "Vol. 6 p. 609", "P 609 VOL.6", True), ("page", "3/215", "215/3", False), ("page", "3/215", "3215", False),
        ("page", "3/215", "(3 - 215)", True), ("page", "12", "١٢", False), ("page", "ج 7 ص 23", "ج 23 ص 7", False), ("page", "ج 7 ص 23", "7/23", False),
        ("sequence", None, None, True), ("sequence", None, "", False), ("sequence", "", " .", True), ("page", None, None, True),
    ],
)
def test_rules(rule, a, b, same):
    assert copies.same_content(a, b, rule) == same
    batch = pa.RecordBatch.from_arrays([pa.array([a, b], pa.string())], names=["x"])
    one, two = copies.content_hash(batch, {"x": rule})
    assert (one == two) == same


def test_hash_and_comparison_agree_on_random_values():
    random.seed(7)
    values = ["".join(random.choice("aA bB1٢/.،جص") for _ in range(random.randint(0, 7))) for _ in range(400)] + [None]
    for rule in ("sequence", "bag", "page"):
        h = copies.content_hash(pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["x"]), {"x": rule})
        content = [copies._content(v, rule) for v in values]
        for i in range(0, len(values), 3):
            for j in range(len(values)):
                assert (h[i] == h[j]) == (content[i] == content[j]) == copies.same_content(values[i], values[j], rule)


ROWS = [
    (5, 1, "سامر بن زيد", "ج 7 ص 23", "حسن"), (2, 1, "زيد، سامر بن", "ص23، ج7", "حسن."), (9, 1, "سامر بن زيد", "ج 7 ص 23", "حسن"),
    (3, 2, "سامر بن زيد", "ج 7 ص 23", "حسن"), (4, 1, None, None, None), (7, 1, None, None, None), (8, 1, None, "", None), (6, None, "x", "1", "y"), (None, 1, "x", "1", "y"),
]


def test_pairs_and_counts(spark):
    df = spark.createDataFrame(ROWS, "id long, u long, m string, p string, g string").withColumnRenamed("u", "u")
    got = {tuple(r) for r in copies.hidden_copies(df, "id", RULES).collect()}
    assert got == {(2, 5), (2, 9), (4, 7)}
    kept = {r.id: r.copies for r in copies.collapse(df, "id", RULES).collect()}
    assert kept == {2: 3, 3: 1, 4: 2, 8: 1, 6: 1, None: 1}
    assert copies.hidden_copies(df.filter("id < 0"), "id", RULES).count() == 0
    long = spark.createDataFrame([(1, "a" * 100_000), (2, ("a " * 100_000).upper())], "id long, key string")
    assert copies.hidden_copies(long, "id", {"key": "sequence"}).collect()[0].copy_id == 2


def test_collisions_are_told_apart(spark):
    """With a hash that is the same for all rows the comparison alone decides."""
    df = spark.createDataFrame(ROWS[:6], "id long, u long, m string, p string, g string").repartition(3)
    got = {tuple(r) for r in copies.hidden_copies(df, "id", RULES, lambda batch, rules: np.zeros(batch.num_rows, np.int64)).collect()}
    assert got == {(2, 5), (2, 9), (4, 7)}
