import json

import pytest

from riwaya.sources import landing, readers


def write(path, data):
    path.write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_quran_and_books(spark, tmp_path):
    at = write(tmp_path / "q.json", {"quran": [{"chapter": 1, "verse": 1, "text": "بسم"}, {"chapter": 1, "verse": 2, "text": "x"}]})
    assert [(r.surah, r.ayah, r.text_ar) for r in readers.read_quran(spark, at).collect()] == [(1, 1, "بسم"), (1, 2, "x")]
    (tmp_path / "books").mkdir()
    write(tmp_path / "books" / "muslim.json", {"hadiths": [{"idInBook": 1, "arabic": "قَال"}, {"idInBook": None, "arabic": "x"}, {"idInBook": 3, "arabic": ""}, {"idInBook": 4}]})
    write(tmp_path / "books" / "other.json", {"hadiths": [{"idInBook": 7, "arabic": "x"}]})
    got = {(r.book_slug, r.hadith_no, r.text_norm, r.locus_ar) for r in readers.read_hadith_books(spark, str(tmp_path / "books")).collect()}
    assert got == {("muslim", 1, "قال", "صحيح مسلم — حديث رقم 1"), ("other", 7, "", "other — حديث رقم 7")}


def test_surahs_in_both_layouts(spark, tmp_path):
    c = [{"chapter": 1, "arabicname": "أ", "englishname": "A", "name": "a", "revelation": "Mecca", "verses": [{"verse": 1}, {"verse": 2}]}, {"chapter": 2, "arabicname": "ب", "englishname": "B", "name": "b", "revelation": "Madina", "verses": []}]
    want = [(1, "أ", "مكية", 2), (2, "ب", "مدنية", 0)]
    for k, data in enumerate(({"chapters": c}, {"chapters": {"references": c}})):
        rows = readers.read_surahs(spark, write(tmp_path / f"s{k}.json", data)).collect()
        assert [(r.n, r.ar, r.rev, r.verse_count) for r in rows] == want


def test_titles(spark, tmp_path):
    at = write(tmp_path / "t.json", {"titles": {"2:255": [{"name": "آية الكرسي", "attested_ar": "a", "source_ar": "s"}, {"name": "ثانية"}]}})
    got = [(r.ref_key, r.place, r.needle, r.attested) for r in readers.read_titles(spark, at).orderBy("place").collect()]
    assert got == [("2:255", 0, "ايه الكرسي", "a"), ("2:255", 1, "ثانيه", None)]
    assert readers.read_titles(spark, str(tmp_path / "missing.json")).count() == 0


def test_rulings_from_json_and_html(spark):
    listed = {"ahadith": {"result": [{"mohdith": " م ", "book": "ب", "numberOrPage": " ", "grade": "صحيح", "explainGrade": None, "rawi": "ر", "hadith": "ح"}, {"mohdith": "", "grade": "x"}, {"mohdith": "م", "grade": " "}]}}
    html = '<div class="hadith-info"><span>المحدث :</span> م1 <span>المصدر</span> ب1<span>الصفحة أو الرقم: </span> 12<span>خلاصة حكم المحدث : </span> حسن</div>\n</div><div class="hadith-info"><span>المحدث</span> x</div> </div>'
    rows = [(1, json.dumps(listed, ensure_ascii=False)), (2, json.dumps({"ahadith": {"result": html}}, ensure_ascii=False)), (3, "{}"), (4, "not json"), (5, None)]
    got = sorted(tuple(r) for r in readers.parse_rulings(spark.createDataFrame(rows, "id int, body string")).collect())
    assert [(r[0], r[1], r[2], r[3], r[4], r[6]) for r in got] == [(1, "م", "ب", None, "صحيح", "ر"), (2, "م1", "ب1", "12", "حسن", None)]


def test_search_index(spark, tmp_path):
    at = write(tmp_path / "i.json", [[1, 2, "نص", [["من", "صحيح"]], [["t", "زيد"], ["i", "k"]]], [2, 2, "x", [], []]])
    got = readers.read_search_index(spark, at).orderBy("pos").collect()
    assert (got[0].num, got[0].sec, got[0].txt, got[0].grades, got[0].chain) == (1, 2, "نص", [["من", "صحيح"]], [["t", "زيد"], ["i", "k"]]) and got[1].grades == []


def test_manual_links(spark, tmp_path):
    at = write(tmp_path / "m.json", {"2:255": [{"a": 1}, {"a": 2}]})
    assert [(r.ref_key, r.place) for r in readers.read_manual_links(spark, at).orderBy("place").collect()] == [("2:255", 0), ("2:255", 1)]
    assert readers.read_manual_links(spark, str(tmp_path / "none.json")).count() == 0


def test_landing(spark, tmp_path):
    calls = []

    def get(address):
        calls.append(address)
        if "down" in address:
            raise OSError("no route")
        return f"{address} {len(calls)}".encode()

    zone = landing.Zone(tmp_path / "zone", get)
    at = zone.body("u1")
    assert at.read_bytes() == b"u1 1" and zone.body("u1") == at and calls == ["u1"], "what is held isn't asked for again"
    assert zone.body("u1", again=True).read_bytes() == b"u1 2" and zone.body("u1").read_bytes() == b"u1 2", "the newest body counts"
    with pytest.raises(landing.NothingLanded, match="no route"):
        zone.body("down")
    assert zone.body("down", "u2").read_bytes().startswith(b"u2"), "the next mirror answers"
    old = landing.Zone(tmp_path / "zone", lambda address: (_ for _ in ()).throw(OSError("gone")))
    assert old.body("u1", again=True).read_bytes() == b"u1 2", "an older body serves where nothing new is to be had"
    with pytest.raises(landing.NothingLanded):
        zone.body()
    made = zone.fill(["u1", "u3", "u3", "down: x"])
    assert sorted(a.address for a in made) == ["down: x", "u3"] and {a.address for a in made if a.digest} == {"u3"}
    assert [r.message for r in landing.failures(spark, zone).orderBy("message").collect()] == ["down: no route", "down: x: no route"]
    assert landing.failures(spark, landing.Zone(tmp_path / "none")).count() == 0


def test_equal_bodies_are_kept_once(tmp_path):
    zone = landing.Zone(tmp_path, lambda address: b"same")
    zone.fill(["a", "b"])
    assert len(list((tmp_path / "bodies").iterdir())) == 1 and set(zone.held()) == {"a", "b"}
