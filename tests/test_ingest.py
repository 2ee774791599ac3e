import json

import pytest

from riwaya.operators import numbering, store
from riwaya.plans import ingest


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return str(path)


VERSES = [(1, 1, "قال الرجل في السوق ان الخبز"), (1, 2, "جاء قال الرجل في السوق ان"), (2, 1, "لا شيء هنا يقال ابدا فيها")]


@pytest.fixture
def landed(tmp_path):
    quran = write(tmp_path / "q.json", {"quran": [{"chapter": s, "verse": a, "text": t} for s, a, t in VERSES]})
    write(tmp_path / "books" / "muslim.json", {"hadiths": [{"idInBook": 1, "arabic": "سمعت قال الرجل في السوق ان كذا"}, {"idInBook": 2, "arabic": "آية السوق"}, {"idInBook": 3, "arabic": "غير ذلك"}, {"idInBook": 4, "arabic": "مذكور باليد"}]})
    titles = write(tmp_path / "t.json", {"titles": {"2:1": [{"name": "آية السوق", "attested_ar": "كذا", "source_ar": "كتاب"}]}})
    manual = write(tmp_path / "m.json", {"2:1": [{"ref": "muslim:4", "evidence_ar": "سبب"}, {"ref": "muslim:99"}]})
    notes = tmp_path / "notes.json"
    notes.write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in [{"edition": "e1", "surah": 1, "ayah": 1, "text": "شرح"}, {"edition": "e2", "surah": 9, "ayah": 9, "text": "x"}, {"edition": "e1", "surah": 1, "ayah": 2, "text": ""}]), encoding="utf-8")
    result = [{"mohdith": "م", "book": "ب", "numberOrPage": p, "grade": "صحيح"} for p in ("5", "5", None, None)]
    rulings = tmp_path / "r.json"
    rulings.write_text("\n".join(json.dumps({"ref_key": k, "url": "u", "body": json.dumps({"ahadith": {"result": result}}, ensure_ascii=False)}, ensure_ascii=False) for k in ("muslim:1", "muslim:3")), encoding="utf-8")
    return ingest.Landed(quran, str(tmp_path / "books"), titles, manual, str(notes), str(rulings), ["شرح e3: no route", "شرح e3: again", "أحكام: gone"])


def test_a_run_from_files_to_tables(spark, landed, tmp_path):
    out = str(tmp_path / "store")
    made = ingest.ingest(spark, landed, out)
    links = {(r.ref, r.to, r.method, r.ambiguous, tuple(r.shared_with or ())) for r in _links(spark, out)}
    assert links == {
        ("1:1", "muslim:1", "quotation", True, ("1:2",)), ("1:2", "muslim:1", "quotation", True, ("1:1",)), ("2:1", "muslim:2", "naming", False, ()),
        ("2:1", "muslim:4", "manual", False, ()), ("1:1", "1:1", "shared_key", False, ()),
    }
    assert {tuple(r) for r in made["report"].collect()} == {("1:1", 1, 1, 1, 3), ("1:2", 0, 1, 1, 3), ("2:1", 0, 2, 2, 0)}
    assert [tuple(r) for r in made["unavailable"].orderBy("place").collect()] == [(1, "شرح e3"), (2, "أحكام")]
    assert "muslim:3" not in {r.ref_key for r in made["unit"].collect()}, "what no verse is linked to is no unit"
    counts = {name: made[name].count() for name in ("source", "unit", "link", "grading")}
    ids = {r.id for r in made["unit"].collect()}
    again = ingest.ingest(spark, landed, out)
    assert counts == {name: again[name].count() for name in counts} and ids == {r.id for r in again["unit"].collect()}, "a second run changes nothing"


def test_disk_does_not_grow_with_links(spark, tmp_path):
    from pathlib import Path

    quran = write(tmp_path / "q.json", {"quran": [{"chapter": 1, "verse": a, "text": f"نص {a}"} for a in range(60)]})
    write(tmp_path / "books" / "muslim.json", {"hadiths": [{"idInBook": k, "arabic": f"في آية السوق رقم {k} وآية الدين"} for k in range(300)]})
    titles = write(tmp_path / "t.json", {"titles": {f"1:{a}": [{"name": "آية الدين", "attested_ar": "كذا" * 40, "source_ar": "كتاب"}, {"name": "آية السوق", "attested_ar": "", "source_ar": ""}] for a in range(60)}})
    manual = write(tmp_path / "m.json", {"1:5": [{"ref": "muslim:7", "evidence_ar": "سبب"}]})
    at = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in at.rglob("*") if p.is_file())
    before = size()
    made = ingest.build(spark, ingest.Landed(quran, str(tmp_path / "books"), titles, manual))
    assert size() - before < 500_000, "18,000 links aren't stored on the way"
    links = made["link"].cache()
    assert links.count() == links.select("id").distinct().count() == 60 * 300 + 1
    assert links.filter("method = 'naming' and evidence_ar like '%آية الدين%'").count() == 60 * 300, "the first title of the list"
    assert {(r.ref_key, r.links, r.hadiths) for r in made["report"].collect()} == {(f"1:{a}", 300 + (a == 5), 300) for a in range(60)}, "a pair linked by hand, too, is one narration"


def _links(spark, out):
    unit, link = store.read_published(spark, f"{out}/unit"), store.read_published(spark, f"{out}/link")
    names = unit.select("id", "ref_key")
    return link.join(names.toDF("from_unit", "ref"), "from_unit").join(names.toDF("to_unit", "to"), "to_unit").collect()


def test_only_the_verses_asked_for(spark, landed):
    made = ingest.build(spark, landed, spark.createDataFrame([(1, 1)], "surah int, ayah int"), ["e2"])
    assert {(r.ref_key, r.tafsirs, r.links) for r in made["report"].collect()} == {("1:1", 0, 1)}
    assert made["link"].first().shared_with == ["1:2"], "all verses are places of a phrase"
    bare = ingest.build(spark, ingest.Landed(landed.quran, landed.books))
    assert bare["grading"].count() == 0 and bare["link"].filter("method <> 'quotation'").count() == 0 and bare["unavailable"].count() == 0


def test_a_failed_swap_keeps_the_old_table(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    store.publish(spark.createDataFrame([(1,)], "x int"), at)
    real, calls = store._rename, []

    def second_fails(files, a, b):
        calls.append((a, b))
        if len(calls) == 2:
            raise OSError("no")
        real(files, a, b)

    monkeypatch.setattr(store, "_rename", second_fails)
    with pytest.raises(OSError, match="no"):
        store.publish(spark.createDataFrame([(2,)], "x int"), at)
    assert [r.x for r in spark.read.parquet(at).collect()] == [1]
    monkeypatch.setattr(store, "_rename", real)
    (tmp_path / "t").rename(tmp_path / "t__old")  # as if the process had ended between the renames
    store.publish(spark.createDataFrame([(3,)], "x int"), at)
    assert [r.x for r in spark.read.parquet(at).collect()] == [3] and {p.name for p in tmp_path.iterdir()} == {"t"}


def test_versions(spark, tmp_path):
    at = str(tmp_path / "v")
    assert store.read_published(spark, at) is None
    for k in range(4):
        assert store.publish_version(spark.createDataFrame([(k,)], "x int"), at) == k + 1
    (tmp_path / "v" / "version=9").mkdir()  # a write that didn't end
    assert store.read_published(spark, at).first().x == 3
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["version=3", "version=4", "version=9"]


def test_numbering_by_stretches(spark):
    rows = [("a", k, k % 7) for k in range(50)] + [("b", None, 1), ("b", 3, 2), (None, 4, 3)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    got = {(r.g, r.x): r.n for r in numbering.numbered(df, "n", ["g"], [numbering.stretch_of(df.x, 10)], [df.x.asc()]).collect()}
    assert got == {("a", k): k + 1 for k in range(50)} | {("b", None): 1, ("b", 3): 2, (None, 4): 1}
    near = {(r.g, r.x): (r._prev, r._next) for r in numbering.beside(df.filter("x is not null"), "g", "x", "y", 10).collect()}
    assert near["a", 10] == (9 % 7, 11 % 7) and near["a", 0][0] is None and near["a", 49] == (48 % 7, None) and near[None, 4] == (None, None)
    assert numbering.numbered(df.filter("x > 99"), "n", [], [], [df.x.asc()]).count() == 0
