import pytest
from pyspark.sql import Row

from riwaya.llm.grades import candidates, deletes, dictionary, distance, edits, map_values

REFERENCE = [
    Row(ref_id=1, grade_ar="صحيح", grade_latin="Sahih", abbrev="صح"), Row(ref_id=2, grade_ar="صحيح لغيره", grade_latin="Sahih li-ghayrih", abbrev="صح لغ"), Row(ref_id=3, grade_ar="حسن", grade_latin="Hasan", abbrev="ح"),
    Row(ref_id=5, grade_ar="حسن صحيح", grade_latin="Hasan Sahih", abbrev="ح صح"), Row(ref_id=7, grade_ar="ضعيف", grade_latin="Da'if", abbrev="ض"), Row(ref_id=11, grade_ar="موضوع", grade_latin="Mawdu'", abbrev="وض"), Row(ref_id=25, grade_ar="لا يصح", grade_latin="La yasihh", abbrev="لا ص"),
]


def test_symmetric_deletes_find_all_within_the_distance():
    words = ["abcd", "abd", "acbd", "xbcd", "abcde", "dcba"]
    for a in words:
        for b in words:
            if edits(a, b) <= 1:
                assert deletes(a, 1) & deletes(b, 1)


def test_distances():
    assert edits("صحيح", "صحيخ") == 1 and edits("ab", "ba") == 1 and distance("ab", "ba") < 1
    assert distance("صحيح", "صحيخ") < distance("صحيح", "صحيم")
    assert any(c[2] == 1 for c in candidates("صحيخ", dictionary(REFERENCE)))


@pytest.fixture(scope="module")
def mapped(spark):
    frames = [f"{p}{g}{s}" for p in ("", "خبر ", "هو ") for g in ("صحيح", "حسن", "ضعيف", "موضوع") for s in ("", " من هذا الطريق")]
    values = [*frames, "صححيح", "SAHIH", "[صحيح].", "da'if", "ح", "غير صحيح", "ليس بصحيح", "هو حسن صحيح من هذا الطريق", "حسن وصحيح", "خرجه في موضع آخر", "انظر ص 7", "", "؟", "صحيح‏ لغيره", None, "صحيح"]
    df = spark.createDataFrame([(v, 1) for v in values], "grade string, ref_id int")
    return {r.grade: r.ref_id for r in map_values(df, spark.createDataFrame(REFERENCE)).collect()}


@pytest.mark.parametrize(
    ("value", "ref"),
    [("صحيح", 1), ("صححيح", 1), ("SAHIH", 1), ("[صحيح].", 1), ("da'if", 7), ("ح", 3), ("غير صحيح", 25), ("ليس بصحيح", 25), ("هو حسن صحيح من هذا الطريق", 5), ("حسن وصحيح", 5), ("خرجه في موضع آخر", 0), ("انظر ص 7", 0), ("", 0), ("؟", 0), ("صحيح‏ لغيره", 2), ("خبر ضعيف من هذا الطريق", 7)],
)
def test_values(mapped, value, ref):
    assert mapped[value] == ref


def test_nulls_and_empty(spark, mapped):
    assert None not in mapped
    empty = spark.createDataFrame([], "grade string")
    assert map_values(empty, spark.createDataFrame(REFERENCE)).count() == 0
    none = spark.createDataFrame([], "ref_id int, grade_ar string, grade_latin string, abbrev string")
    assert map_values(spark.createDataFrame([("صحيح",)], "grade string"), none).first().ref_id == 0


def test_frames_hold_in_a_small_table(spark):
    """Words around a phrase are judged one by one, in a table of any size."""
    want = {"إسناده حسن": 3, "ضعيف الإسناد": 7, "وهو اسناده حسن": 3, "قلت: صحيخ": 1, "أفاد زيد: حسن صحيح": 5, "رواه جماعة": 0, "خرّجه في موضع آخر": 0, "انظر صحيح زيد": 0, "انظر ص 7": 0, "انظر ص 8": 0, "غير حسن": 0}
    df = spark.createDataFrame([(v,) for v in want], "grade string")
    assert {r.grade: r.ref_id for r in map_values(df, spark.createDataFrame(REFERENCE)).collect()} == want
    for v in ("إسناده حسن", "ضعيف الإسناد", "أفاد زيد: حسن صحيح"):
        assert map_values(spark.createDataFrame([(v,)], "grade string"), spark.createDataFrame(REFERENCE)).first().ref_id == want[v]


def test_other_expressions_follow_from_the_roots_of_any_list(spark):
    """Another list, whose words stand nowhere in the operator."""
    reference = [Row(ref_id=1, grade_ar="مقبول", grade_latin="Maqbul", abbrev=None), Row(ref_id=2, grade_ar="سقيم", grade_latin="Saqim", abbrev="سق"), Row(ref_id=3, grade_ar="سقيم جدا", grade_latin=None, abbrev=None), Row(ref_id=4, grade_ar="مختلط", grade_latin="", abbrev=None), Row(ref_id=5, grade_ar="لا يقبل", grade_latin="La yuqbal", abbrev=None)]
    want = {"مقبولا": 1, "فيه سقم": 2, "شديد السقم": 3, "وهو فيه اختلاط": 4, "غير مقبول": 5, "ليس بمقبول": 5, "لم يقبل": 5, "سقيمٌ جدًّا": 3, "قبله": 1, "كلام آخر": 0, "فيه كلام": 0}
    df = spark.createDataFrame([(v,) for v in want], "grade string")
    assert {r.grade: r.ref_id for r in map_values(df, spark.createDataFrame(reference, "ref_id int, grade_ar string, grade_latin string, abbrev string")).collect()} == want


def test_a_list_that_is_too_long_to_broadcast_is_refused():
    with pytest.raises(ValueError, match="too long"):
        dictionary(Row(ref_id=k, grade_ar=f"{k:09d}" * 3, grade_latin="", abbrev=None) for k in range(20_000))
