"""From landed files to published tables: verses, commentaries, narrations, their links, the rulings on them, and a report.

Everything is one declared plan for all verses that are asked for; nothing is
done verse by verse. Tables are published as versions, so a run that fails
changes nothing, and a run over the same files gives the same ids.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riwaya.functions import text as X
from riwaya.functions.normalize import normalize
from riwaya.operators import linking, store
from riwaya.schemas import KEYS, TABLES
from riwaya.session import kept, removed
from riwaya.sources import readers

#: What a commentary file holds for a verse.
COMMENTARY = "edition string, surah int, ayah int, text string, url string"
#: An answer of the rulings' search, by the unit it was asked for.
ANSWER = "ref_key string, url string, body string"


@dataclass
class Landed:
    """Where the landed files are. What is None isn't there."""

    quran: str
    books: str
    titles: str | None = None
    manual: str | None = None
    commentaries: str | None = None
    rulings: str | None = None
    failures: list[str] = field(default_factory=list)
    slug: str = r"([^/]+)\.json$"


#: Ids of the sources that a run registers, by key.
SOURCE_IDS = {"quran": 1, "tafsir": 2, "hadith": 3, "rulings": 4}


def key_id(*columns: Column) -> Column:
    """A positive id that follows from a row's key."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(2**63 - 1))


def _unit_id(source: str, kind: str, ref: Column, edition: Column) -> Column:
    return key_id(F.lit(SOURCE_IDS[source]), F.lit(kind), ref, edition)


def _unit(rows: DataFrame, source: str, kind: str, **columns: Column) -> DataFrame:
    none = {f.name: F.lit(None).cast(f.dataType) for f in TABLES["unit"]}
    given = none | {"source_id": F.lit(SOURCE_IDS[source]).cast("long"), "kind": F.lit(kind), "edition": F.lit("")} | columns
    given["id"] = _unit_id(source, kind, given["ref_key"], given["edition"])
    given["text_norm"] = normalize(given["text_ar"])
    return rows.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in TABLES["unit"]])


def _ref() -> Column:
    return F.concat_ws(":", "surah", "ayah")


def _once(df: DataFrame, table: str) -> DataFrame:
    return df.dropDuplicates(KEYS[table])


def build(spark: SparkSession, landed: Landed, verses: DataFrame | None = None, editions: list[str] | None = None, base_url: str = "", folders: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables source, unit, link and grading, and the report, for ``verses`` (surah, ayah); for all where none are given.

    A narration becomes a unit only if a verse is linked to it. Links set by hand
    lead to narrations ("slug:number"), too. A source that is named in
    ``landed.failures`` ("name: reason") is reported, and nothing stands for it.

    All tables are distinct by key. Links aren't stored here, and nothing of
    their number is exchanged: they are very many where titles are frequent.
    ``folders`` gets the folders that the tables rest on, by name; links and the
    report don't rest on "corpus" and "linked".
    """
    folders = {} if folders is None else folders
    quran = readers.read_quran(spark, landed.quran).dropDuplicates(["surah", "ayah"])
    asked = quran if verses is None else quran.join(verses.select("surah", "ayah").distinct(), ["surah", "ayah"], "left_semi")
    url = lambda *parts: F.concat(F.lit(base_url), *parts)
    verse_units = _unit(asked, "quran", "ayah", ref_key=_ref(), surah=F.col("surah"), ayah=F.col("ayah"), text_ar=F.col("text_ar"), locus_ar=_ref(), url=url(F.lit("quran/"), _ref()))
    corpus = readers.read_hadith_books(spark, landed.books, landed.slug).withColumn("ref", F.concat_ws(":", "book_slug", "hadith_no")).dropDuplicates(["ref"])
    corpus = kept(corpus.withColumns({"doc": _unit_id("hadith", "hadith", F.col("ref"), F.lit("")), "url": url(F.lit("hadith/"), F.col("ref"))}), "corpus", folders)

    # verses against narrations
    places = quran.select(_unit_id("quran", "ayah", _ref(), F.lit("")).alias("item"), normalize("text_ar").alias("item_text"), _ref().alias("ref"), "surah", "ayah")
    items = places.join(verse_units.select(F.col("id").alias("item")), "item", "left_semi")
    titles = readers.read_titles(spark, landed.titles) if landed.titles else spark.createDataFrame([], "ref_key string, place int, name string, needle string, attested string, title_source string")
    titles = kept(titles.join(items.select(F.col("ref").alias("ref_key"), "item"), "ref_key").drop("ref_key"), "titles_read", folders)
    quotes, named = linking.find_links(items, corpus.select("doc", F.col("text_norm").alias("doc_text"), "url"), titles, places=places, folders=folders)
    linked = quotes.select("doc").unionByName(named.select("doc"))
    found = linking.merge_links(quotes, named, titles)
    links = found.select(F.col("item").alias("from_unit"), F.col("doc").alias("to_unit"), F.lit("ayah_hadith").alias("relation"), "method", "evidence_ar", "ambiguous", "shared_with", "url")
    by_hand = None
    if landed.manual:
        by_hand = kept(manual_links(readers.read_manual_links(spark, landed.manual), items, corpus).join(corpus.select(F.col("doc").alias("to_unit"), "url"), "to_unit"), "by_hand", folders)
        links, linked = links.unionByName(by_hand), linked.unionByName(by_hand.select(F.col("to_unit").alias("doc")))
    linked = kept(corpus.join(linked.distinct(), "doc", "left_semi"), "linked", folders)
    units = verse_units.unionByName(_unit(linked, "hadith", "hadith", ref_key=F.col("ref"), book_slug=F.col("book_slug"), hadith_no=F.col("hadith_no"), text_ar=F.col("text_ar"), locus_ar=F.col("locus_ar"), url=F.col("url")))

    # commentaries by shared key
    notes = None
    if landed.commentaries:
        c = spark.read.schema(COMMENTARY).json(landed.commentaries).filter("length(text) > 0").withColumn("edition", F.coalesce("edition", F.lit("")))
        c = (c.filter(F.col("edition").isin(editions)) if editions else c).join(asked.select("surah", "ayah"), ["surah", "ayah"], "left_semi")
        locus = F.concat(readers.lookup(readers.EDITION_NAMES, F.col("edition")), F.lit(" — عند "), _ref())
        made = kept(_once(_unit(c, "tafsir", "tafsir", ref_key=_ref(), surah=F.col("surah"), ayah=F.col("ayah"), edition=F.col("edition"), text_ar=F.col("text"), locus_ar=locus, url=F.coalesce("url", F.lit(""))), "unit"), "commentaries_read", folders)
        units = units.unionByName(made)
        notes = linking.shared_key_links(verse_units, made).join(made.select(F.col("id").alias("to_unit"), "url"), "to_unit")
        notes = notes.withColumns({"ambiguous": F.lit(False), "shared_with": F.lit(None).cast("array<string>")})
        links = links.unionByName(notes.select(*links.columns))
    # each part of the links has a pair of units once, and parts differ by relation or method
    links = links.withColumn("id", key_id(*[F.col(c) for c in KEYS["link"]])).select(*TABLES["link"].names)

    # rulings on linked narrations; one without a page never conflicts, so its place in the answer makes its id
    if landed.rulings:
        answers = spark.read.schema(ANSWER).json(landed.rulings)
        rows = readers.parse_rulings(answers).join(linked.select(F.col("doc").alias("unit_id"), F.col("ref").alias("ref_key")), "ref_key").drop("ref_key")
        rows = rows.withColumns({"source_id": F.lit(SOURCE_IDS["rulings"]).cast("long"), "id": key_id(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("unit_id", "muhaddith", "book", "page", "grade", "explanation", "rawi")])})
        gradings = kept(store.insert_gradings(rows.select(*TABLES["grading"].names), ["id"]), "gradings", folders)
    else:
        gradings = spark.createDataFrame([], TABLES["grading"])
    ruled = gradings.groupBy(F.col("unit_id").alias("doc")).agg(F.count("*").alias("n"))
    # rulings are counted by narration before it is brought to its verses
    told = _told(quotes.select("item", "doc").join(ruled, "doc", "left"), True).unionByName(_told(linking.naming_only(named.join(ruled, "doc", "left"), titles), True))
    if by_hand is not None:
        pairs = by_hand.select(F.col("from_unit").alias("item"), F.col("to_unit").alias("doc"))
        known = pairs.join(quotes.select("item", "doc"), ["item", "doc"]).unionByName(
            pairs.join(named.select("doc", F.explode("needles").alias("needle")), "doc").join(titles.select("item", "needle"), ["item", "needle"]).select("item", "doc")
        )
        known = known.distinct().withColumn("known", F.lit(True))
        rest = pairs.join(known, ["item", "doc"], "left").join(ruled, "doc", "left")
        told = told.unionByName(_told(rest, F.col("known").isNull()))
    sources = spark.createDataFrame([(i, k, k, base_url, "", None) for k, i in SOURCE_IDS.items()], TABLES["source"])
    lost = spark.createDataFrame(list(enumerate(landed.failures)), "seq long, message string")
    return {"source": sources, "unit": units, "link": links, "grading": gradings, "report": report(verse_units, told, notes), "unavailable": store.report_unavailable(lost)}


def _told(rows: DataFrame, first: Column | bool) -> DataFrame:
    """(from_unit, first, n) of links between a verse and a narration: whether no other link has the same two, and the narration's rulings."""
    return rows.select(F.col("item").alias("from_unit"), F.lit(first).alias("first") if isinstance(first, bool) else first.alias("first"), F.coalesce("n", F.lit(0)).alias("n"))


def manual_links(entries: DataFrame, items: DataFrame, corpus: DataFrame) -> DataFrame:
    """Links set by hand (ref_key, place, entry): each entry names a narration as ``ref`` and why as ``evidence_ar``. Entries about unknown ones are left out."""
    e = entries.select("ref_key", F.get_json_object("entry", "$.ref").alias("ref"), X.first_filled(F.get_json_object("entry", "$.evidence_ar"), F.get_json_object("entry", "$.note")).alias("why"))
    on = e.join(items.select(F.col("ref").alias("ref_key"), "item"), "ref_key").join(corpus.select("ref", "doc"), "ref")
    return on.groupBy(F.col("item").alias("from_unit"), F.col("doc").alias("to_unit")).agg(F.min("why").alias("why")).select(
        "from_unit", "to_unit", F.lit("ayah_hadith").alias("relation"), F.lit("manual").alias("method"), F.coalesce("why", F.lit("")).alias("evidence_ar"), F.lit(False).alias("ambiguous"), F.lit(None).cast("array<string>").alias("shared_with")
    )


def report(verses: DataFrame, told: DataFrame, notes: DataFrame | None) -> DataFrame:
    """(ref_key, tafsirs, links, hadiths, gradings) of each verse, from its links to narrations (from_unit, first, n) and to commentaries."""
    own = told.groupBy("from_unit").agg(F.count("*").alias("links"), F.count_if("first").alias("hadiths"), F.sum(F.when(F.col("first"), F.col("n"))).alias("gradings"))
    joined = verses.select(F.col("id").alias("from_unit"), "ref_key").join(own, "from_unit", "left")
    joined = joined.withColumn("tafsirs", F.lit(0).cast("long")) if notes is None else joined.join(notes.groupBy("from_unit").agg(F.count("*").alias("tafsirs")), "from_unit", "left")
    return joined.select("ref_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tafsirs", "links", "hadiths", "gradings")])


def ingest(spark: SparkSession, landed: Landed, out: str, verses: DataFrame | None = None, editions: list[str] | None = None, base_url: str = "") -> dict[str, DataFrame]:
    """Build the tables, merge them into those published under ``out``, publish the result, and return it with the report.

    Units and sources are updated, links and rulings that are there stay as they are.
    """
    folders: dict[str, str] = {}
    made = build(spark, landed, verses, editions, base_url, folders)
    for name in ("source", "unit", "grading", "link"):
        if name == "link":
            removed(spark, folders, "corpus", "linked")
        fresh, old = made[name], store.read_published(spark, f"{out}/{name}")
        # fresh rows are distinct by key, so the first version takes them as they are
        if old is not None and name in ("source", "unit"):
            rows = old.withColumn("seq", F.lit(0)).unionByName(fresh.withColumn("seq", F.lit(1)))
            fresh = store.upsert_sources(rows, ["seq"]) if name == "source" else store.upsert_units(rows, ["seq"])
        elif old is not None:
            # a ruling without a page never conflicts with another one, but it is the same if all of it is equal
            fresh = store.insert_or_ignore(fresh.join(old.select("id"), "id", "left_anti"), KEYS[name], ["id"], old)
        store.publish_version(fresh.select(*TABLES[name].names), f"{out}/{name}")
    told = kept(made["report"], "report")
    removed(spark, folders)
    return {name: store.read_published(spark, f"{out}/{name}") for name in TABLES} | {"report": told, "unavailable": made["unavailable"]}
