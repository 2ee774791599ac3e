import random

import pytest
from pyspark.sql import functions as F

from riwaya.operators import linking


def longest(item, doc, least):
    w = item.split()
    for n in range(len(w), least - 1, -1):
        for i in range(len(w) - n + 1):
            run = " ".join(w[i : i + n])
            if run in doc:
                return run
    return None


def frames(spark, items, docs):
    return spark.createDataFrame(list(enumerate(items)), "item int, item_text string"), spark.createDataFrame(list(enumerate(docs)), "doc int, doc_text string")


@pytest.mark.parametrize(
    ("item", "doc", "want"),
    [("a b c d", "a b c d e", None), ("a b c d e f", "x a b c d e y", "a b c d e"), ("a b c d e f", "xa b c d ey", "a b c d e"), ("a b c d e f", "a b c d e f", "a b c d e f"), ("", "a b c d e", None), ("a b c d e", "", None)],
)
def test_quotation(spark, item, doc, want):
    i, d = frames(spark, [item], [doc])
    got = linking.find_quotations(i, d).collect()
    assert [(r.quoted, r.quoted_words) for r in got] == ([(want, len(want.split()))] if want else [])


@pytest.mark.parametrize("least", [3, 4, 5])
def test_equals_brute_force_with_parts_of_words(spark, least):
    random.seed(least)
    text = lambda n: " ".join("".join(random.choice("ab") for _ in range(random.randint(1, 2))) for _ in range(n))
    items, docs = [text(random.randint(0, 9)) for _ in range(40)], [text(random.randint(0, 14)) for _ in range(120)]
    i, d = frames(spark, items, docs)
    got = {(r.item, r.doc): r.quoted for r in linking.find_quotations(i, d, least).collect()}
    want = {(a, b): q for a, x in enumerate(items) for b, y in enumerate(docs) if (q := longest(x, y, least))}
    assert got == want and want


def test_least_words(spark):
    i, d = frames(spark, ["a"], ["a"])
    with pytest.raises(ValueError, match="three"):
        linking.find_quotations(i, d, 2)


ITEMS = [(1, "a b c d e x", "1:1", 1, 1), (2, "y a b c d e", "1:2", 1, 2), (3, "p q r s t", "2:1", 2, 1)]
TITLES = "item long, place int, name string, needle string, attested string, title_source string"


def test_shared_phrases_are_flagged_never_chosen(spark):
    items = spark.createDataFrame(ITEMS, "item long, item_text string, ref string, surah int, ayah int")
    docs = spark.createDataFrame([(10, "z a b c d e z"), (11, "p q r s t u")], "doc long, doc_text string")
    got = {(r.item, r.doc): (r.ambiguous, r.shared_with) for r in linking.link_all(items, docs, spark.createDataFrame([], TITLES)).collect()}
    assert got == {(1, 10): (True, ["1:2"]), (2, 10): (True, ["1:1"]), (3, 11): (False, [])}


def test_naming_takes_the_first_title_and_yields_to_quotation(spark):
    items = spark.createDataFrame(ITEMS, "item long, item_text string, ref string, surah int, ayah int")
    docs = spark.createDataFrame([(10, "xverse oney"), (11, "two verse one"), (12, "p q r s t two"), (13, "none")], "doc long, doc_text string")
    titles = spark.createDataFrame([(3, 2, "Two", "two", None, None), (3, 1, "One", "verse one", "att", "src"), (3, 3, "Empty", "", "", "")], TITLES)
    got = {r.doc: (r.method, r.phrase) for r in linking.link_all(items, docs, titles).collect()}
    assert got == {10: ("naming", "One"), 11: ("naming", "One"), 12: ("quotation", "p q r s t")}
    evidence = linking.link_all(items, docs, titles).filter("doc = 11").first().evidence_ar
    assert "«One»" in evidence and "att" in evidence and "src" in evidence


def test_every_link_has_method_and_evidence(spark):
    items = spark.createDataFrame(ITEMS, "item long, item_text string, ref string, surah int, ayah int")
    docs = spark.createDataFrame([(10, "z a b c d e z")], "doc long, doc_text string")
    rows = linking.link_all(items, docs, spark.createDataFrame([], TITLES))
    assert rows.filter(F.col("method").isNull() | F.col("evidence_ar").isNull() | (F.col("evidence_ar") == "")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from riwaya.functions.normalize import normalize
    from riwaya.streaming.incremental import link_stream

    items = spark.createDataFrame([(1, "قال الرجل في السوق ان الخبز", "1:1", 1, 1)], "item long, item_text string, ref string, surah int, ayah int")
    docs = spark.createDataFrame([(10, "وَقَالَ الرجل في السوق إنّ الخبز غال"), (11, "لا شيء")], "id long, text_ar string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    titles = spark.createDataFrame([], TITLES)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    link_stream(stream, items, titles, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = [(r.item, r.doc, r.phrase) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = linking.link_all(items, docs.select(F.col("id").alias("doc"), normalize("text_ar").alias("doc_text")), titles).collect()
    assert got == [(r.item, r.doc, r.phrase) for r in want] and len(got) == 1
