import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riwaya.llm import codes as C
from riwaya.llm.forms import consistent, consistent_form, lookalike_classes, lookalike_pairs


def form(*texts):
    return C.to_arrow(*consistent(*C.to_codes(pa.array(texts, pa.string())))).to_pylist()


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("كتاب", "ﻛﺘﺎﺏ"), ("لأمر", "ﻷﻣﺮ"), ("أخ", "أخ"), ("إن", "إن"), ("سؤال", "سؤال"),
        ("حَدَّ", "حَدَّ"), ("يعمل", "یعمل"), ("على", "علی"), ("سكن", "سکن"), ("ههم", "ھهم"), ("a b", "a b"), ("a b", "a b"),
        ("دار", "دا‌ر"), ("قال", "ق​ال"), ("AM12", "ＡМ１２"), ("١٢٣", "۱۲۳"), ("é", "é"), ("(x)", "（x）"), (".", "․"),
    ],
)
def test_alike(a, b):
    x, y = form(a, b)
    assert x == y


@pytest.mark.parametrize(
    ("a", "b"),
    [("كتب", "كَتب"), ("كتاب", "كتـاب"), ("على", "علي"), ("رحمة", "رحمه"), ("ان", "أن"), ("٤", "۴"), ("قال", "قال."), ("x²", "x2"), ("ملك", "ملک"), ("من", "مِن"), ("ب‌ت", "بت")],
)
def test_different(a, b):
    x, y = form(a, b)
    assert x != y


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ابي یكکهھَِّٕٔٓ‌​ ﻻﻛȩ́", max_size=12))
def test_a_form_is_its_own_form_and_composed(text):
    once = form(text)[0]
    assert form(once)[0] == once
    assert unicodedata.normalize("NFC", once) == once


def test_rows_do_not_touch_each_other():
    random.seed(5)
    texts = ["".join(random.choice("ایٔ کá‌") for _ in range(random.randint(0, 6))) for _ in range(200)]
    assert form(*texts) == [form(t)[0] for t in texts]


def test_columns_nulls_clashes_and_long_texts(spark):
    rows = [(1, "ﻛﺘﺎﺏ", "old"), (2, None, None), (3, "", "x"), (4, "یـ" * 50_000, None)]
    df = spark.createDataFrame(rows, "id long, t string, t_form string")
    got = {r.id: r.t_form for r in consistent_form(df, ["t"]).collect()}
    assert got[1] == "كتاب" and got[2] is None and got[3] == "" and len(got[4]) == 100_000
    assert consistent_form(df.filter("id < 0"), ["t"]).count() == 0


def test_pairs(spark):
    rows = [(1, "كتاب", "x"), (2, "ﻛﺘﺎﺏ", "x"), (3, "كتاب", None), (4, None, None), (5, "كتابـ", "​x"), (6, "", "​")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {tuple(r) for r in lookalike_pairs(df, "id", ["a", "b"]).collect()}
    assert got == {("a", 1, 2), ("a", 2, 3), ("b", 1, 5), ("b", 2, 5)}
    assert lookalike_pairs(df.filter("id < 0"), "id", ["a"]).count() == 0


def test_one_variant_in_a_group_of_very_many_copies(spark):
    """The cost is that of the pairs there are, not of all pairs of the group."""
    n = 100_000
    df = spark.range(1, n + 1).selectExpr("id", "case when id = 7 then 'ﻛﺘﺎﺏ' else 'كتاب' end as a", "concat('x', id) as b")
    got = lookalike_pairs(df, "id", ["a", "b"])
    assert got.selectExpr("count(*)", "count(distinct unit_a, unit_b)", "sum(int(unit_a = 7 or unit_b = 7))").first()[:] == (n - 1, n - 1, n - 1)
    assert [tuple(r) for r in lookalike_pairs(df, "id", ["a"], members=False).collect()] == [("a", 1, 7)]
    assert lookalike_classes(df, "id", ["a", "b"]).groupBy("rep").count().orderBy("rep").collect() == [(1, n - 1), (7, 1)]


def test_a_very_long_run_of_marks_takes_no_quadratic_time():
    import time

    text = "ب" + "\u064e\u0651" * 100_000 + "e\u0301"
    began = time.time()
    codes, at = consistent(*C.to_codes(pa.array([text, "e\u0301"])))
    assert C.to_arrow(codes, at).to_pylist()[1] == "é" and time.time() - began < 20
