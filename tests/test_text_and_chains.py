import ctypes

import pytest
from pyspark.sql import functions as F

from riwaya.functions import classify, isnad
from riwaya.functions import text as X
from riwaya.operators import search


def value(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("v")).first().v


def test_chain_keeps_marks_and_drops_said(spark):
    text = "حَدَّثَنَا مَالِكٌ، عَنْ نَافِعٍ، عَنِ ابْنِ عُمَرَ قَالَ،"
    assert value(spark, isnad.chain_names(F.col("t")), t=text) == ["مَالِكٌ", "نَافِعٍ", "ابْنِ عُمَرَ"]
    assert value(spark, isnad.chain_verbs(F.col("t")), t=text) == ["حدثنا", "عن", "عن"]
    assert value(spark, isnad.chain_names(F.col("t")), t=None) == []


@pytest.mark.parametrize(
    ("text", "chain", "matn"),
    [("حدثنا مالك، عن نافع، قال كذا", "حدثنا مالك، عن نافع،", "قال كذا"), ("حدثنا مالك", None, "حدثنا مالك"), ("قال، عن نافع", None, "قال، عن نافع"), ("حدثنا مالك، عن نافع", None, "حدثنا مالك، عن نافع"), ("سمعت زيدا،  ", None, "سمعت زيدا،  "), ("", None, "")],
)
def test_split(spark, text, chain, matn):
    a, b = isnad.split_isnad(F.col("t"))
    assert value(spark, F.struct(a.alias("a"), b.alias("b")), t=text) == (chain, matn)


@pytest.mark.parametrize(("grade", "want"), [("حسن صحيح", "mid"), ("ضعيف", "bad"), ("صحيح", "ok"), ("", "na"), (None, "na"), ("حديث منكر", "bad"), ("صَحِيح", "ok")])
def test_grades(spark, grade, want):
    assert value(spark, classify.grade_class(F.col("g")), g=grade) == want


@pytest.mark.parametrize(("grade", "want"), [("صدوق", "mid"), ("ثقة", "ok"), ("صحابي", "ok"), ("متروك", "bad"), ("لين", "bad"), ("x", "na")])
def test_narrators(spark, grade, want):
    assert value(spark, classify.narrator_class(F.col("g")), g=grade) == want


@pytest.mark.parametrize(("text", "want"), [(None, ""), ("", ""), ("تابعي", "تابعي"), ("Companion", "صحابي"), ("3rd Century AH [x]", "من القرن 3 الهجري"), ("10th generation", "الطبقة 10"), ("other", "other")])
def test_generations(spark, text, want):
    assert value(spark, classify.generation_label(F.col("g")), g=text) == want


def test_snippets(spark):
    cut = X.snippet(F.col("t"), F.lit("xy"))
    assert value(spark, cut, t="xy" + "a" * 200) == "xy" + "a" * 90 + "…"
    assert value(spark, cut, t="b" * 45 + "xy") == "b" * 45 + "xy…"
    assert value(spark, cut, t="c" + "b" * 45 + "xy") == "…" + "b" * 45 + "xy…"
    assert value(spark, cut, t="none") is None
    assert value(spark, X.highlight(F.col("t"), F.lit("xy")), t="<xy&xy") == "&lt;<mark>xy</mark>&amp;xy"
    assert value(spark, X.highlight(F.col("t"), F.lit("q")), t='a"') == "a&quot;"


def test_small_functions(spark):
    assert value(spark, X.arabic_digits(F.col("t")), t="2050") == "٢٠٥٠"
    assert value(spark, X.paragraphs(F.col("t")), t=" a \n\n b") == ["a", "b"]
    assert value(spark, X.paragraphs(F.col("t")), t=None) == ["—"]
    assert value(spark, X.last_words(F.col("t")), t="a b") == "a b"
    assert value(spark, X.last_words(F.col("t")), t="1 2 3 4 5 6 7 8 9 10") == "2 3 4 5 6 7 8 9 10"
    assert value(spark, X.quote_url(F.col("t")), t="a b/ش") == "a%20b/%D8%B4"
    assert value(spark, X.page_or_dash(F.col("t")), t=None) == "—"
    assert value(spark, X.method_label(F.col("t")), t="other") == "other"
    assert value(spark, X.escape_html(F.col("t"), apostrophe=True), t="'&<") == "&#x27;&amp;&lt;"


@pytest.mark.parametrize(("ref", "want"), [("2:255", (2, 255)), ("x", (None, None)), ("2", (2, None)), (None, (None, None)), ("2:99999999999", (2, None))])
def test_refs(spark, ref, want):
    a, b = X.parse_ref(F.col("r"))
    assert value(spark, F.struct(a.alias("a"), b.alias("b")), r=ref) == want


@pytest.mark.parametrize(("path", "want"), [("/ayah/2/255", ("ayah", 2, 255)), ("/surah/7", ("surah", 7, None)), ("/ayah/2", None), ("/surah/2/3", None), ("/x", None), (None, None)])
def test_routes(spark, path, want):
    assert value(spark, X.parse_route(F.col("p")), p=path) == want


@pytest.mark.parametrize("key", ["abc", "محمد بن عبد الله", "", "x" * 300])
def test_shard_is_the_32_bit_hash(spark, key):
    h = 0
    for c in key:
        h = ctypes.c_int32(h * 31 + ord(c)).value
    assert value(spark, X.shard(F.col("k")), k=key) == abs(h) % 24


def test_groups_and_pages(spark):
    df = spark.createDataFrame([(k, "b", 0, k, f"s{k}", "same" if k % 2 else f"own{k}") for k in range(6)], "doc int, book string, book_pos int, doc_pos int, snippet string, sig string")
    got = {r.key: (r.snippet, r.first_doc, r.n) for r in search.group_hits(df).collect()}
    assert got["same"] == ("s1", 1, 3) and len(got) == 4
    refs = search.split_refs(spark.createDataFrame([("k", [f"b:{n}" for n in range(95)]), ("l", ["c:1"])], "key string, h array<string>"))
    named = search.narrator_refs(refs, spark.createDataFrame([("b", "ب")], "slug string, ar string")).collect()
    assert len(named) == 91 and {(r.book_name, r.total) for r in named} == {("ب", 95), ("c", 1)}
    assert {(r.page, r.place, r.pages) for r in search.paged(spark.range(31), [F.asc("id")], 15).filter("id in (0, 15, 30)").collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3)}
    rows = spark.range(40)
    assert [r.id for r in search.one_page(rows, [F.asc("id")], 15, 99).collect()] == list(range(30, 40))
    assert [r.id for r in search.one_page(rows, [F.asc("id")], 15, -3).collect()] == list(range(15))
    assert search.one_page(rows.filter("id < 0"), [F.asc("id")], 36, 1, 0).count() == 0


def test_chain_members(spark):
    chains = spark.createDataFrame([(1, 0, "i", "k1"), (1, 1, "i", "none"), (1, 2, "t", "زيد")], "doc int, pos int, kind string, value string")
    index = spark.createDataFrame([("k1", "مالك", "ثقة", "تابعي")], "key string, n string, g string, gen_label string")
    got = [(r.name, r.sub, r.nth, r.last) for r in search.resolve_chain(chains, index).orderBy("nth").collect()]
    assert got == [("مالك", "ثقة — تابعي", 1, False), ("زيد", "", 2, True)]
