import pytest

from riwaya import schemas
from riwaya.operators import page, store

GRADING = "id long, unit_id long, muhaddith string, book string, page string, grade string, url string"
UNIT = "id long, source_id long, kind string, ref_key string, edition string, surah int, text_ar string, text_norm string, locus_ar string, url string, seq int"


def test_units_have_no_grade_column():
    assert "grade" not in schemas.UNIT.fieldNames()
    assert not schemas.UNIT["text_ar"].nullable and not schemas.LINK["evidence_ar"].nullable and not schemas.LINK["method"].nullable


def test_insert_ignore_and_null_pages(spark):
    rows = [(1, 1, "m", "b", None, "g", "u"), (2, 1, "m", "b", None, "g", "u"), (3, 1, "m", "b", "5", "g", "u"), (4, 1, "m", "b", "5", "g", "u")]
    got = store.insert_gradings(spark.createDataFrame(rows, GRADING), ["id"])
    assert {r.id for r in got.collect()} == {1, 2, 3}
    again = store.insert_gradings(spark.createDataFrame(rows, GRADING), ["id"], got)
    assert sorted(r.id for r in again.collect()) == [1, 1, 2, 2, 3]


def test_upsert_units_updates_text_only(spark):
    rows = [(1, 1, "hadith", "b:1", None, 7, "old", "old", "l1", "u1", 0), (9, 1, "hadith", "b:1", "", 8, "new", "new", "l2", "u2", 1)]
    got = store.upsert_units(spark.createDataFrame(rows, UNIT), ["seq"]).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.id, r.surah, r.text_ar, r.locus_ar, r.url, r.edition) == (1, 7, "new", "l2", "u2", "")


def test_unknown_methods_are_rejected_not_lost(spark):
    rows = [(1, 1, 2, "r", "quotation", "e"), (2, 1, 2, "r", "guess", "e"), (3, 1, 2, "r", None, "e"), (4, 1, 2, "r", "naming", None), (5, 1, 99, "r", "manual", "e")]
    df = spark.createDataFrame(rows, "id long, from_unit long, to_unit long, relation string, method string, evidence_ar string")
    good, bad = store.check(df, "link", {"to_unit": spark.createDataFrame([(2,)], "id long")})
    assert {r.id for r in good.collect()} == {1} and {r.id for r in bad.collect()} == {2, 3, 4, 5}


def test_publish_swaps_whole_tables(spark, tmp_path):
    at = str(tmp_path / "t")
    store.publish(spark.createDataFrame([(1,)], "x int"), at)
    store.publish(spark.createDataFrame([(2,), (3,)], "x int"), at)
    assert {r.x for r in spark.read.parquet(at).collect()} == {2, 3}
    assert {p.name for p in tmp_path.iterdir()} == {"t"}


def test_create_tables(spark):
    spark.sql("DROP DATABASE IF EXISTS riwaya_test CASCADE")
    schemas.create_tables(spark, "riwaya_test")
    schemas.create_tables(spark, "riwaya_test")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN riwaya_test").collect()} == {"source", "unit", "link", "grading"}
    spark.sql("DROP DATABASE riwaya_test CASCADE")


@pytest.mark.parametrize(("grades", "disputed"), [(["صحيح", " صحيح "], False), (["صحيح", "ضعيف"], True), (["x"], False)])
def test_disputed(spark, grades, disputed):
    df = spark.createDataFrame([(1, g) for g in grades], "unit_id long, grade string")
    r = page.disputed(df).first()
    assert r.disputed == disputed and r.rulings == len(grades)


@pytest.fixture
def pages(spark):
    units = spark.createDataFrame(
        [(1, 1, "ayah", "2:1", 2, 1, None, None, "", "v"), (2, 1, "tafsir", "2:1", 2, 1, None, None, "e", "t"), (3, 1, "hadith", "b:1", None, None, "b", 1, "", "h1"), (4, 1, "hadith", "a:9", None, None, "a", 9, "", "h2"), (5, 1, "hadith", "a:2", None, None, "a", 2, "", "h3"), (6, 1, "ayah", "2:2", 2, 2, None, None, "", "alone")],
        "id long, source_id long, kind string, ref_key string, surah int, ayah int, book_slug string, hadith_no int, edition string, text_ar string",
    ).selectExpr("*", "'l' AS locus_ar", "'u' AS url")
    sources = spark.createDataFrame([(1, "s")], "id long, name_ar string")
    links = spark.createDataFrame(
        [(1, 1, 2, "ayah_tafsir", "shared_key", False), (2, 1, 3, "ayah_hadith", "quotation", True), (3, 1, 4, "ayah_hadith", "naming", False), (4, 1, 5, "ayah_hadith", "quotation", False)],
        "id long, from_unit long, to_unit long, relation string, method string, ambiguous boolean",
    ).selectExpr("*", "'e' AS evidence_ar", "array('x') AS shared_with")
    gradings = spark.createDataFrame([(1, 3, "z", "صحيح"), (2, 3, "a", "ضعيف")], "id long, unit_id long, muhaddith string, grade string").selectExpr("*", "'b' AS book", "cast(null AS string) AS page", "cast(null AS string) AS explanation", "cast(null AS string) AS rawi", "'u' AS url")
    return {r.id: r for r in page.verse_pages(units, sources, links, gradings, [(2, 1), (2, 2), (3, 3)]).collect()}


def test_page_ranks_and_shows_all_rulings(pages):
    hadiths = pages[1].hadiths
    assert [h.to_unit for h in hadiths] == [5, 4, 3], "unambiguous quotation, naming, ambiguous quotation"
    assert [g.muhaddith for g in hadiths[2].gradings] == ["a", "z"] and hadiths[0].gradings == []
    assert [t.edition for t in pages[1].tafsirs] == ["e"] and pages[6].hadiths == [] and pages[6].tafsirs == []
    assert all(h.locus_ar and h.unit_url and h.source_name and h.evidence_ar for h in hadiths)


def test_moving_between_verses(spark):
    df = spark.createDataFrame([(1, 7), (2, 3), (3, 6)], "n int, verse_count int")
    got = {(r.surah, r.ayah): (r.prev_ref, r.next_ref) for r in page.verse_order(df).collect()}
    assert got[1, 7] == ("1:6", "2:1") and got[2, 1] == ("1:7", "2:2") and got[3, 6] == ("3:5", None) and got[1, 1] == (None, "1:2") and len(got) == 16


def test_report(spark):
    df = spark.createDataFrame([(3, "b: x"), (1, "a: y"), (2, "b: z"), (4, "a")], "seq int, message string")
    assert [(r.place, r.source) for r in store.report_unavailable(df).orderBy("place").collect()] == [(1, "a"), (2, "b")]
