"""Queries over landed files and published tables: whole tables are written in the external shapes and read back by the readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riwaya import schemas
from riwaya.functions import isnad
from riwaya.functions import text as X
from riwaya.functions.normalize import normalize
from riwaya.operators import linking, store
from riwaya.plans import core_sql as S
from riwaya.plans import ingest
from riwaya.plans.core_queries import Tables, _docs, _titles
from riwaya.session import ensure_checkpoint_dir, shared_folder
from riwaya.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Where a landed book's slug stands in the path.
SLUG = r"book=([^/]+)/"
#: Numbers of a book in one file, about.
PART = 5_000


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _land(rows: DataFrame, name: str, *parts: str) -> str:
    """Write ``rows`` (parts..., body): one file for each document, in folders by its parts."""
    at = shared_folder(rows.sparkSession, name)
    rows.repartition(*parts).write.partitionBy(*parts).option("compression", "gzip").text(at)
    return at


def _verses(t: Tables) -> DataFrame:
    """The first row of each verse."""
    return t.kind("ayah").groupBy("surah", "ayah").agg(F.min_by(F.struct("id", "ref_key", "text_ar"), "id").alias("x")).select("surah", "ayah", "x.*")


def _narrations(t: Tables) -> DataFrame:
    """The first row of each narration that has a number and a text."""
    rows = t.kind("hadith").filter("hadith_no is not null and length(text_ar) > 0")
    return rows.groupBy("book_slug", "hadith_no").agg(F.min_by(F.struct("id", "ref_key", "text_ar"), "id").alias("x")).select("book_slug", "hadith_no", "x.*")


def _land_quran(verses: DataFrame) -> str:
    verse = F.struct(F.col("surah").alias("chapter"), F.col("ayah").alias("verse"), F.col("text_ar").alias("text"))
    files = verses.groupBy(F.col("surah").alias("part")).agg(F.to_json(F.struct(F.collect_list(verse).alias("quran"))).alias("body"))
    return _land(files, "quran", "part")


def _land_books(rows: DataFrame) -> str:
    item = F.struct(F.col("hadith_no").alias("idInBook"), F.col("text_ar").alias("arabic"))
    keyed = rows.select(F.col("book_slug").alias("book"), F.floor(F.col("hadith_no") / PART).alias("part"), item.alias("item"))
    return _land(keyed.groupBy("book", "part").agg(F.to_json(F.struct(F.collect_list("item").alias("hadiths"))).alias("body")), "books", "book", "part")


def _land_map(rows: DataFrame, name: str, wrap: str | None) -> str:
    """Files of one object: ``rows`` (ref_key, place, item) as lists by ref_key, in folders by surah."""
    listed = rows.groupBy("ref_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("items"))
    whole = F.map_from_entries(F.collect_list(F.struct("ref_key", "items")))
    whole = F.struct(whole.alias(wrap)) if wrap else whole
    return _land(listed.groupBy(F.split("ref_key", ":")[0].alias("part")).agg(F.to_json(whole).alias("body")), name, "part")


def _named_verses(t: Tables) -> DataFrame:
    """(ref_key, place, name): titles of verses by ref, in order; those of several rows of a verse one behind the other."""
    titles = _titles(t).join(t.kind("ayah").select(F.col("id").alias("item"), "ref_key"), "item")
    first = titles.groupBy("ref_key", "name").agg(F.min(F.struct("item", "place")).alias("at"))
    place = F.row_number().over(Window.partitionBy("ref_key").orderBy("at")) - 1
    return first.select("ref_key", place.alias("place"), "name")


def _set_by_hand(t: Tables) -> DataFrame:
    """(ref_key, to_ref, evidence_ar) of manual links between a verse and a narration."""
    verse, told = t.kind("ayah").select(F.col("id").alias("from_unit"), "ref_key"), t.kind("hadith").select(F.col("id").alias("to_unit"), F.col("ref_key").alias("to_ref"))
    return t.link.filter("method = 'manual'").join(verse, "from_unit").join(told, "to_unit").select("ref_key", "to_ref", "evidence_ar")


def _land_manual(t: Tables) -> str:
    entry = F.struct(F.col("to_ref").alias("ref"), "evidence_ar")
    return _land_map(_set_by_hand(t).distinct().select("ref_key", F.xxhash64("to_ref", "evidence_ar").alias("place"), entry.alias("item")), "manual", None)


@query
def landed_quran(spark: SparkSession, at: str) -> DataFrame:
    return readers.read_quran(spark, _land_quran(Tables(spark, at).kind("ayah")))


@query
def landed_books(spark: SparkSession, at: str) -> DataFrame:
    """All books of a folder as one corpus."""
    return readers.read_hadith_books(spark, _land_books(Tables(spark, at).kind("hadith")), SLUG)


@query
def landed_titles(spark: SparkSession, at: str) -> DataFrame:
    rows = _named_verses(Tables(spark, at)).select("ref_key", "place", F.struct("name", F.col("ref_key").alias("attested_ar"), F.lit("").alias("source_ar")).alias("item"))
    return readers.read_titles(spark, _land_map(rows, "titles", "titles"))


@query
def stored_manual_links(spark: SparkSession, at: str) -> DataFrame:
    """Links set by hand, read from their file and stored as links."""
    t = Tables(spark, at)
    items = t.kind("ayah").groupBy(F.col("ref_key").alias("ref")).agg(F.min("id").alias("item"))
    corpus = t.kind("hadith").groupBy(F.col("ref_key").alias("ref")).agg(F.min("id").alias("doc"))
    made = ingest.manual_links(readers.read_manual_links(spark, _land_manual(t)), items, corpus).withColumn("id", F.col("from_unit"))
    return store.insert_links(made, ["id"]).select("from_unit", "to_unit", "relation", "method", "evidence_ar", "ambiguous")


@query
def landed_index(spark: SparkSession, at: str) -> DataFrame:
    """The search index of one book; the folders of other books aren't read."""
    chain = F.to_json(F.transform(isnad.chain_names(F.col("text_ar")), lambda x: F.array(F.lit("t"), x)))
    row = F.array(F.col("hadith_no").cast("string"), F.floor(F.col("hadith_no") / 100).cast("string"), normalize("text_ar", "search"), F.lit("[]"), chain)
    rows = Tables(spark, at).kind("hadith").select(F.col("book_slug").alias("book"), F.floor(F.col("hadith_no") / PART).alias("part"), row.alias("row"))
    index = readers.read_search_index(spark, _land(rows.groupBy("book", "part").agg(F.to_json(F.collect_list("row")).alias("body")), "index", "book", "part"), [S.SCOPE])
    return index.select("book", "num", "sec", "txt", F.size("grades").alias("grades"), F.array_join(F.transform("chain", lambda x: F.concat_ws(" ", x)), "|").alias("chain"))


@query
def ingested(spark: SparkSession, at: str) -> DataFrame:
    """The report of a whole run: verses, narrations, titles, manual links, commentaries and rulings are landed, linked and published."""
    t = Tables(spark, at)
    titles = _named_verses(t).select("ref_key", "place", F.struct("name", F.lit("").alias("attested_ar"), F.lit("").alias("source_ar")).alias("item"))
    commentaries = shared_folder(spark, "commentaries")
    t.kind("tafsir").select("edition", "surah", "ayah", F.col("text_ar").alias("text"), "url").write.option("compression", "gzip").json(commentaries)
    ruling = F.struct(F.col("muhaddith").alias("mohdith"), "book", F.col("page").alias("numberOrPage"), "grade", F.col("explanation").alias("explainGrade"), "rawi")
    answers = t.grading.join(t.kind("hadith").select(F.col("id").alias("unit_id"), "ref_key"), "unit_id")
    rulings = shared_folder(spark, "rulings")
    answers.select("ref_key", "url", F.to_json(F.struct(F.struct(F.array(ruling).alias("result")).alias("ahadith"))).alias("body")).write.option("compression", "gzip").json(rulings)
    landed = ingest.Landed(_land_quran(_verses(t)), _land_books(_narrations(t)), _land_map(titles, "titles", "titles"), _land_manual(t), commentaries, rulings, ["x: no route"], SLUG)
    return ingest.ingest(spark, landed, shared_folder(spark, "store"))["report"]


@query
def published_units(spark: SparkSession, at: str) -> DataFrame:
    """Units published twice; the second version is what readers see."""
    t, out = Tables(spark, at), shared_folder(spark, "units")
    store.publish_version(t.kind("ayah").select("id", "kind", "ref_key"), out)
    store.publish_version(t.unit.select("id", "kind", "ref_key"), out)
    return store.read_published(spark, out)


@query
def stored_tables(spark: SparkSession, at: str) -> DataFrame:
    """Units in a table that was created by its schema, counted by partition."""
    name = "riwaya_" + shared_folder(spark, "x")[-12:]
    schemas.create_tables(spark, name)
    columns = [c for c in schemas.TABLES["unit"].names if c != "kind"]
    Tables(spark, at).unit.select(*columns, "kind").write.insertInto(f"{name}.unit")
    ensure_checkpoint_dir(spark)
    found = spark.table(f"{name}.unit").groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("ref_key").alias("refs")).checkpoint()
    spark.sql(f"DROP DATABASE {name} CASCADE")
    return found


@query
def checked_units(spark: SparkSession, at: str) -> DataFrame:
    """Documents as a checked load of units takes them: unknown kinds and missing texts or keys are rejected, not lost."""
    d = Tables(spark, at).documents
    kind = F.when(F.col("kind") == "commentary", "tafsir").when(F.col("kind") == "report", "hadith").otherwise(F.col("kind"))
    rows = d.select(F.col("doc_id").alias("id"), kind.alias("kind"), "ref_key", F.col("text").alias("text_ar"), F.col("text").alias("text_norm"), F.col("source").alias("locus_ar"), F.col("source").alias("url"))
    good, bad = store.check(rows, "unit")
    return good.select("id", F.lit(True).alias("stored")).unionByName(bad.select("id", F.lit(False).alias("stored")))


@query
def chain_verbs(spark: SparkSession, at: str) -> DataFrame:
    verbs = isnad.chain_verbs(F.col("text_ar"))
    return Tables(spark, at).kind("hadith").select("id", F.posexplode(verbs).alias("place", "verb"))


@query
def first_filled(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).documents.select("doc_id", X.first_filled(F.col("ref_key"), F.col("lang"), F.col("source")).alias("shown"))


@query
def ambiguous_passages(spark: SparkSession, at: str) -> DataFrame:
    """Phrases that narrations share with verses or commentaries, and the other places that hold them."""
    t = Tables(spark, at)
    items = t.unit.filter("kind in ('ayah', 'tafsir')").select(F.col("id").alias("item"), normalize("text_ar").alias("item_text"), F.col("ref_key").alias("ref"), "surah", "ayah")
    ensure_checkpoint_dir(spark)
    quotes = linking.find_quotations(items.select("item", "item_text"), _docs(t)).checkpoint()
    return linking.other_places(quotes, items).select("item", "quoted", F.array_join("also", ",").alias("also"), X.quotation_evidence(F.col("quoted"), F.size(F.split("quoted", " ")), F.col("also")).alias("evidence"))


_FIRST_VERSES = "verses AS (SELECT surah, ayah, min(id) AS id FROM unit WHERE kind = 'ayah' GROUP BY 1, 2)"
_FIRST_TOLD = "told AS (SELECT book_slug, hadith_no, min(id) AS id FROM unit WHERE kind = 'hadith' AND hadith_no IS NOT NULL AND length(text_ar) > 0 GROUP BY 1, 2)"
_NAMED = f"""named AS (SELECT ref_key, name, row_number() OVER (PARTITION BY ref_key ORDER BY min((item, place))) - 1 AS place
FROM (SELECT item, name, row_number() OVER (PARTITION BY item ORDER BY id) AS place FROM (SELECT from_unit AS item, regexp_extract(evidence_ar, '«(.*?)»', 1) AS name, min(id) AS id FROM link WHERE method = 'naming' GROUP BY 1, 2)) n
JOIN unit u ON u.id = n.item AND u.kind = 'ayah' GROUP BY 1, 2)"""
_MANUAL = "by_hand AS (SELECT f.ref_key, t.ref_key AS to_ref, min(l.evidence_ar) AS why FROM link l JOIN unit f ON f.id = l.from_unit AND f.kind = 'ayah' JOIN unit t ON t.id = l.to_unit AND t.kind = 'hadith' WHERE l.method = 'manual' GROUP BY 1, 2)"
_BOOK = "CASE book_slug " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in readers.BOOK_NAMES.items()) + " ELSE book_slug END"

SQL: dict[str, str] = {
    "landed_quran": "SELECT surah, ayah, text_ar FROM unit WHERE kind = 'ayah'",
    "landed_books": f"SELECT book_slug, hadith_no, text_ar, {S.norm('text_ar')} AS text_norm, {_BOOK} || ' — حديث رقم ' || hadith_no AS locus_ar FROM unit WHERE kind = 'hadith' AND hadith_no IS NOT NULL AND length(text_ar) > 0",
    "landed_titles": f"WITH {_NAMED} SELECT ref_key, place::INT AS place, name, {S.norm('name')} AS needle, ref_key AS attested, '' AS title_source FROM named",
    "stored_manual_links": f"""WITH {_MANUAL}, f AS (SELECT ref_key, min(id) AS id FROM unit WHERE kind = 'ayah' GROUP BY 1), t AS (SELECT ref_key, min(id) AS id FROM unit WHERE kind = 'hadith' GROUP BY 1)
SELECT f.id AS from_unit, t.id AS to_unit, 'ayah_hadith' AS relation, 'manual' AS method, why AS evidence_ar, false AS ambiguous FROM by_hand b JOIN f USING (ref_key) JOIN t ON t.ref_key = b.to_ref""",
    "landed_index": f"""WITH {S.CHAIN} SELECT book_slug AS book, hadith_no AS num, floor(hadith_no / 100)::INT AS sec, {S.norm('text_ar', 'search')} AS txt, 0 AS grades,
array_to_string(list_transform(names, lambda x: 't ' || x), '|') AS chain FROM unit JOIN cut USING (id) WHERE book_slug = '{S.SCOPE}'""",
    "ingested": f"""WITH {_FIRST_VERSES}, {_FIRST_TOLD}, {_NAMED}, {_MANUAL}, {S.ITEMS.replace("WHERE kind = 'ayah'", "JOIN verses USING (id) WHERE kind = 'ayah'").replace('surah, ayah', 'unit.surah, unit.ayah')},
{S.DOCS.replace("WHERE kind = 'hadith'", "JOIN told USING (id) WHERE kind = 'hadith'")}, {S.QUOTES},
titles AS (SELECT item, {S.norm('name')} AS needle FROM named JOIN items ON ref = ref_key), names AS (SELECT DISTINCT item, doc FROM titles JOIN docs ON needle <> '' AND contains(doc_text, needle)),
hand AS (SELECT i.item, u.id AS doc FROM by_hand b JOIN items i ON i.ref = b.ref_key JOIN unit u ON u.ref_key = b.to_ref JOIN told USING (id)),
found AS (SELECT item, doc, 'q' AS m FROM quotes UNION ALL SELECT * , 'n' FROM (SELECT item, doc FROM names EXCEPT SELECT item, doc FROM quotes) UNION ALL SELECT item, doc, 'm' FROM hand),
linked AS (SELECT item, count(*) AS links, count(DISTINCT doc) AS hadiths FROM found GROUP BY 1),
ruled AS (SELECT DISTINCT r.ref_key, {S.white_trim('muhaddith')} AS m, {S.white_trim('book')} AS b, {S.filled('page')} AS p, {S.white_trim('grade')} AS g, CASE WHEN {S.filled('page')} IS NULL THEN ({S.filled('explanation')}, {S.filled('rawi')}, x.id) END AS o
FROM grading x JOIN unit r ON r.id = x.unit_id AND r.kind = 'hadith' WHERE {S.white_trim('muhaddith')} <> '' AND {S.white_trim('grade')} <> ''), n AS (SELECT ref_key, count(*) AS n FROM ruled GROUP BY 1),
grades AS (SELECT item, sum(n) AS gradings FROM (SELECT DISTINCT item, doc FROM found) f JOIN unit u ON u.id = f.doc JOIN n USING (ref_key) GROUP BY 1),
notes AS (SELECT surah, ayah, count(DISTINCT edition) AS tafsirs FROM unit WHERE kind = 'tafsir' AND length(text_ar) > 0 GROUP BY 1, 2)
SELECT i.ref AS ref_key, coalesce(tafsirs, 0) AS tafsirs, coalesce(links, 0) AS links, coalesce(hadiths, 0) AS hadiths, coalesce(gradings, 0)::BIGINT AS gradings
FROM items i LEFT JOIN linked l USING (item) LEFT JOIN grades g USING (item) LEFT JOIN notes USING (surah, ayah)""",
    "published_units": "SELECT id, kind, ref_key FROM unit",
    "stored_tables": "SELECT kind, count(*) AS n, count(DISTINCT ref_key) AS refs FROM unit GROUP BY 1",
    "checked_units": "SELECT doc_id AS id, kind IN ('commentary', 'report') AND ref_key IS NOT NULL AND text IS NOT NULL AS stored FROM documents",
    "chain_verbs": f"""WITH v AS (SELECT id, list_transform(regexp_extract_all(regexp_replace(text_ar, '{isnad.TAIL}', ''), '{S.java(isnad.VERB)}'), lambda x: {S.white_trim(f"regexp_replace(x, '{isnad.STRIPPED}', '', 'g')")}) AS v FROM unit WHERE kind = 'hadith')
SELECT id, (i - 1)::INT AS place, v[i] AS verb FROM v, range(1, len(v) + 1) t(i)""",
    "first_filled": "SELECT doc_id, coalesce(nullif(ref_key, ''), nullif(lang, ''), nullif(source, '')) AS shown FROM documents",
    "ambiguous_passages": f"""WITH {S.ITEMS.replace("kind = 'ayah'", "kind IN ('ayah', 'tafsir')")}, {S.DOCS}, {S.QUOTES}, {S.ALSO} SELECT item, quoted, also,
'{S._Q1}' || len(string_split(quoted, ' ')) || '{S._Q2}' || quoted || '{X.QUOTED.split("%s")[1]}{X.ALSO_BEFORE}' || listed || '{X.ALSO_AFTER}' AS evidence FROM also""",
}
