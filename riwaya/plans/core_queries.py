"""Queries of the engine's own operators over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riwaya.functions import classify, isnad
from riwaya.functions import text as X
from riwaya.functions.normalize import normalize, tokens
from riwaya.operators import linking, page, search, store
from riwaya.operators.numbering import stretch_of
from riwaya.plans import core_sql
from riwaya.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NEEDLE = core_sql.NEEDLE


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


class Tables:
    """The tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, at: str):
        self._spark, self._at = spark, at

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._at}/{name}.parquet")

    def kind(self, name: str) -> DataFrame:
        return self.unit.filter(F.col("kind") == name)


def _items(t: Tables) -> DataFrame:
    """Verses as (item, item_text, ref, surah, ayah) in matching form."""
    return t.kind("ayah").select(F.col("id").alias("item"), normalize("text_ar").alias("item_text"), F.col("ref_key").alias("ref"), "surah", "ayah")


def _docs(t: Tables) -> DataFrame:
    return t.kind("hadith").select(F.col("id").alias("doc"), normalize("text_ar").alias("doc_text"))


def _titles(t: Tables) -> DataFrame:
    """Names of verses that naming links state, first stated first."""
    named = t.link.filter("method = 'naming'").select(F.col("from_unit").alias("item"), "id", F.regexp_extract("evidence_ar", "«(.*?)»", 1).alias("name"))
    first = named.groupBy("item", "name").agg(F.min("id").alias("id"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("id"))
    return first.select("item", place.alias("place"), "name", normalize("name").alias("needle"), F.lit("").alias("attested"), F.lit("").alias("title_source"))


def _search_docs(t: Tables) -> DataFrame:
    return t.kind("hadith").select(F.col("id").alias("doc"), F.col("book_slug").alias("book"), F.col("book_slug").alias("book_pos"), F.col("id").alias("doc_pos"), normalize("text_ar", "search").alias("txt"))


# ---- normalisation ------------------------------------------------------


@query
def norm_link_units(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).unit.select("id", normalize("text_ar").alias("norm"))


@query
def norm_search_units(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).unit.select("id", normalize("text_ar", "search").alias("norm"))


@query
def norm_latin_docs(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).documents.select("doc_id", normalize("text", "latin").alias("norm"))


@query
def tokens_count(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).unit.select("id", F.size(tokens("text_ar")).alias("n_tokens"))


@query
def word_windows(spark: SparkSession, at: str) -> DataFrame:
    w = linking.windows(tokens("text_ar"), linking.MIN_WORDS)
    return Tables(spark, at).kind("ayah").select("id", F.posexplode(w).alias("place", "run"))


@query
def probe_tail9(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).kind("hadith").select("id", X.last_words(normalize("text_ar")).alias("probe"))


# ---- linking ------------------------------------------------------------


@query
def quotation_links(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    return linking.in_order(linking.find_quotations(_items(t).select("item", "item_text"), _docs(t)))


@query
def ambiguous_links(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    quotes = linking.find_quotations(_items(t).select("item", "item_text"), _docs(t))
    return linking.other_places(quotes, _items(t)).select("item", "quoted", F.array_join("also", ",").alias("also"))


@query
def naming_links(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    return linking.find_by_name(_titles(t), _docs(t)).select("item", "doc", "named")


@query
def merged_links(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    found = linking.link_all(_items(t), _docs(t), _titles(t))
    return found.select("item", "doc", "method", "phrase", "ambiguous", F.coalesce(X.join_shared(F.col("shared_with")), F.lit("")).alias("shared_with"), "evidence_ar")


@query
def shared_key_links(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    return linking.shared_key_links(t.kind("ayah"), t.kind("tafsir"))


@query
def ingest_report(spark: SparkSession, at: str) -> DataFrame:
    """Counts of attempts for each verse, as a link build reports them."""
    t = Tables(spark, at)
    linked = t.link.groupBy("from_unit").agg(F.count_if(F.col("relation") == "ayah_tafsir").alias("tafsirs"), F.count_if(F.col("relation") == "ayah_hadith").alias("links"), F.count_distinct(F.when(F.col("relation") == "ayah_hadith", F.col("to_unit"))).alias("hadiths"))
    ruled = t.link.filter("relation = 'ayah_hadith'").select("from_unit", F.col("to_unit").alias("unit_id")).distinct().join(t.grading.select("unit_id"), "unit_id").groupBy("from_unit").agg(F.count("*").alias("gradings"))
    return linked.join(ruled, "from_unit", "left").withColumn("gradings", F.coalesce("gradings", F.lit(0)))


# ---- pages --------------------------------------------------------------


@query
def page_hadiths(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    return page.ranked_hadiths(t.link, t.unit, t.sources).select("from_unit", "place", "id", "to_unit", "source_name", "method", "ambiguous")


@query
def page_tafsirs(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    order = Window.partitionBy("from_unit").orderBy("edition", "to_unit", "id")
    return page.linked_units(t.link, t.unit, t.sources).filter("kind = 'tafsir'").select("from_unit", F.row_number().over(order).alias("place"), "to_unit", "edition", "source_name")


@query
def page_rulings(spark: SparkSession, at: str) -> DataFrame:
    """The rulings on each narration of each verse's page, in order; a narration without rulings stays."""
    t = Tables(spark, at)
    hadiths = page.ranked_hadiths(t.link, t.unit, t.sources).select("from_unit", "place", "to_unit")
    rulings = page.rulings_in_order(t.grading).select(F.col("unit_id").alias("to_unit"), "ruling_place", F.col("id").alias("ruling"))
    return hadiths.join(rulings, "to_unit", "left")


@query
def page_counts(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    return page.page_counts(t.unit, t.sources, t.link)


@query
def nested_pages(spark: SparkSession, at: str) -> DataFrame:
    """The nested pages of some verses, with what stands on them counted."""
    t = Tables(spark, at)
    pages = page.verse_pages(t.unit, t.sources, t.link, t.grading, core_sql.VERSES)
    return pages.select("id", "surah", "ayah", F.size("tafsirs").alias("tafsirs"), F.size("hadiths").alias("hadiths"), F.aggregate("hadiths", F.lit(0), lambda n, h: n + F.size(h.gradings)).alias("gradings"))


@query
def disputed_flag(spark: SparkSession, at: str) -> DataFrame:
    return page.disputed(Tables(spark, at).grading)


@query
def ruling_urls(spark: SparkSession, at: str) -> DataFrame:
    return page.ruling_urls(Tables(spark, at).grading)


@query
def distinct_built(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).kind("ayah").select("surah").distinct()


@query
def unbuilt_refs(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    verses = t.surahs.select(F.col("n").alias("surah"), F.explode(F.sequence(F.lit(1), F.col("verse_count"))).alias("ayah"))
    return verses.join(t.kind("ayah").select("surah", "ayah"), ["surah", "ayah"], "left_anti")


@query
def verse_lookup(spark: SparkSession, at: str) -> DataFrame:
    """The first row of each verse."""
    t = Tables(spark, at)
    first = t.kind("ayah").groupBy("surah", "ayah").agg(F.min_by(F.struct("id", "source_id", "url"), "id").alias("x")).select("surah", "ayah", "x.*")
    return first.join(t.sources.select(F.col("id").alias("source_id"), "name_ar"), "source_id").select("surah", "ayah", "id", "name_ar", "url")


@query
def verse_order(spark: SparkSession, at: str) -> DataFrame:
    return page.verse_order(Tables(spark, at).surahs)


@query
def valid_refs(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    surah, ayah = X.parse_ref(F.col("ref_key"))
    refs = t.documents.filter("ref_key is not null").select("doc_id", surah.alias("surah"), ayah.alias("ayah"))
    return page.valid_ref(refs, t.surahs).select("doc_id", "surah", "ayah", "valid")


@query
def clamped_refs(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    surah, ayah = X.parse_ref(F.col("ref_key"))
    refs = t.documents.filter("ref_key is not null").select("doc_id", surah.alias("surah"), (ayah + 10).alias("asked"))
    return refs.join(t.surahs.select(F.col("n").alias("surah"), "verse_count"), "surah").select("doc_id", page.clamp(F.col("asked"), F.col("verse_count")).alias("ayah"))


@query
def neighbours_in_book(spark: SparkSession, at: str) -> DataFrame:
    rows = Tables(spark, at).kind("hadith").select("id", "book_slug", "hadith_no")
    return page.neighbours(rows, "book_slug", "id", "hadith_no")


# ---- stores -------------------------------------------------------------


@query
def upsert_sources(spark: SparkSession, at: str) -> DataFrame:
    """All sources loaded twice, the second time under another name."""
    s = Tables(spark, at).sources.select("id", F.col("source_key").alias("key"), "name_ar", "homepage", "pinned_ref")
    again = s.withColumns({"id": F.col("id") + 100, "name_ar": F.concat("name_ar", F.lit(" ٢"))})
    return store.upsert_sources(s.withColumn("seq", F.lit(0)).unionByName(again.withColumn("seq", F.lit(1))), ["seq"])


@query
def upsert_units(spark: SparkSession, at: str) -> DataFrame:
    return store.upsert_units(Tables(spark, at).unit, ["ingested_at", "id"]).select("source_id", "kind", "ref_key", "edition", "id", "surah", "ayah", "book_slug", "hadith_no", "text_ar", "url")


@query
def insert_links(spark: SparkSession, at: str) -> DataFrame:
    return store.insert_links(Tables(spark, at).link, ["ingested_at", "id"]).select("id", "from_unit", "to_unit", "relation", "method", "evidence_ar")


@query
def insert_gradings(spark: SparkSession, at: str) -> DataFrame:
    return store.insert_gradings(Tables(spark, at).grading, ["ingested_at", "id"]).select("id", "unit_id", "muhaddith", "book", "page", "grade")


@query
def reingest_links(spark: SparkSession, at: str) -> DataFrame:
    """A second load of links into a store that holds the quotations."""
    t = Tables(spark, at)
    old = store.insert_links(t.link.filter("method = 'quotation'"), ["ingested_at", "id"])
    return store.insert_links(t.link, ["ingested_at", "id"], old).select("id", "from_unit", "to_unit", "relation", "method")


@query
def check_rejects(spark: SparkSession, at: str) -> DataFrame:
    """Links as a checked load takes them if only narrations are stored: the rest is rejected, not lost."""
    t = Tables(spark, at)
    good, bad = store.check(t.link, "link", {"to_unit": t.kind("hadith").select("id")})
    return good.select("id", F.lit(True).alias("stored")).unionByName(bad.select("id", F.lit(False).alias("stored")))


@query
def unavailable_report(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    return store.report_unavailable(t.unit.select(F.col("id").alias("seq"), F.concat_ws(":", "book_slug", "edition", "ref_key").alias("message")))


# ---- search -------------------------------------------------------------


@query
def search_top(spark: SparkSession, at: str) -> DataFrame:
    return search.text_hits(_search_docs(Tables(spark, at)), NEEDLE).select("doc", "book", "snippet", "sig")


@query
def search_all(spark: SparkSession, at: str) -> DataFrame:
    return search.text_hits(_search_docs(Tables(spark, at)), NEEDLE, None).select("doc", "book", "snippet", "sig")


@query
def search_scoped(spark: SparkSession, at: str) -> DataFrame:
    return search.text_hits(_search_docs(Tables(spark, at)), NEEDLE, None, core_sql.SCOPE).select("doc", "snippet")


@query
def search_groups(spark: SparkSession, at: str) -> DataFrame:
    return search.group_hits(search.text_hits(_search_docs(Tables(spark, at)), NEEDLE, None))


@query
def search_members(spark: SparkSession, at: str) -> DataFrame:
    return search.grouped(search.text_hits(_search_docs(Tables(spark, at)), NEEDLE, None)).select("doc", "key")


@query
def search_statistics(spark: SparkSession, at: str) -> DataFrame:
    return search.hit_statistics(search.text_hits(_search_docs(Tables(spark, at)), NEEDLE, None))


@query
def quick_hits(spark: SparkSession, at: str) -> DataFrame:
    """Surahs, then commentaries, then each book followed by its sections."""
    t = Tables(spark, at)
    surahs = t.surahs.select(F.col("n").alias("pos"), F.lit("سورة").alias("kind"), F.concat(F.lit("سورة "), "ar").alias("title"), F.concat("rev", F.lit(" · "), X.arabic_digits(F.col("verse_count")), F.lit(" آية")).alias("sub"), F.concat(F.lit("tafsir.html#/"), "n").alias("href"), F.array("ar").alias("haystack"))
    editions = t.kind("tafsir").select("edition").distinct()
    editions = editions.select(F.row_number().over(Window.orderBy("edition")).alias("pos"), F.lit("تفسير").alias("kind"), F.concat(F.lit("تفسير في "), "edition").alias("title"), F.lit("").alias("sub"), F.concat(F.lit("tafsir.html#/1/"), "edition", F.lit("/1")).alias("href"), F.array(F.concat(F.lit("تفسير في "), "edition")).alias("haystack"))
    books = t.books.withColumn("nth", F.row_number().over(Window.orderBy("slug")))
    own = books.select((F.col("nth") * 1_000_000).alias("pos"), F.lit("كتاب").alias("kind"), F.col("ar").alias("title"), F.coalesce("author", F.lit("")).alias("sub"), F.concat(F.lit("hadith.html#/"), "slug").alias("href"), F.array("ar", F.coalesce("author", F.lit(""))).alias("haystack"))
    title = F.concat(F.lit("باب في "), X.arabic_digits(F.col("section")))
    parts = _sections(t).join(books, F.col("book") == F.col("slug")).select((F.col("nth") * 1_000_000 + F.col("section") + 1).alias("pos"), F.lit("باب").alias("kind"), title.alias("title"), F.col("ar").alias("sub"), F.concat(F.lit("hadith.html#/"), "slug", F.lit("/"), "section", F.lit("/1")).alias("href"), F.array(title).alias("haystack"))
    return search.quick_hits([surahs, editions, own.unionByName(parts)], core_sql.QUICK).select("kind", "title", "sub", "href")


@query
def section_page(spark: SparkSession, at: str) -> DataFrame:
    """The pages of one section of a book, with previews."""
    t = Tables(spark, at)
    rows = t.kind("hadith").filter((F.col("book_slug") == core_sql.SCOPE) & (F.floor(F.col("hadith_no") / 1000) == 1))
    return search.paged(rows.select("id", X.preview(F.col("text_ar")).alias("preview")), [F.col("id")], 15, coarse=[stretch_of(F.col("id"))])


@query
def other_commentaries(spark: SparkSession, at: str) -> DataFrame:
    """For each commentary the others on its verse."""
    c = Tables(spark, at).kind("tafsir").select("id", "surah", "ayah", "edition")
    o = c.select(F.col("id").alias("other"), "surah", "ayah", F.col("edition").alias("other_edition"))
    return c.join(o, ["surah", "ayah"]).filter("edition <> other_edition").select("id", "other")


@query
def verses_with_commentary(spark: SparkSession, at: str) -> DataFrame:
    """Each verse beside its commentary in one edition."""
    t = Tables(spark, at)
    edition = t.kind("tafsir").filter(F.col("edition") == core_sql.EDITION).select("surah", "ayah", F.col("text_ar").alias("commentary"))
    return t.kind("ayah").select("id", "surah", "ayah", "text_ar").join(edition, ["surah", "ayah"])


@query
def routes(spark: SparkSession, at: str) -> DataFrame:
    """Paths of verses and surahs read back."""
    path = F.concat(F.lit("/ayah/"), F.replace("ref_key", F.lit(":"), F.lit("/")))
    rows = Tables(spark, at).documents.filter("ref_key is not null").select("doc_id", X.parse_route(path).alias("r"))
    return rows.select("doc_id", "r.kind", "r.surah", "r.ayah")


@query
def highlighted(spark: SparkSession, at: str) -> DataFrame:
    hits = search.text_hits(_search_docs(Tables(spark, at)), NEEDLE, None)
    return hits.select("doc", X.highlight(F.col("snippet"), F.lit(NEEDLE)).alias("html"))


@query
def escaped_docs(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).documents.select("doc_id", X.escape_html(F.col("text")).alias("js"), X.escape_html(F.col("text"), apostrophe=True).alias("py"))


@query
def previews(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).kind("hadith").select("id", X.preview(F.col("text_ar")).alias("preview"))


@query
def arabic_numbers(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).orders.select("o_orderkey", X.arabic_digits(F.col("o_orderkey")).alias("digits"))


@query
def paragraph_rows(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).documents.select("doc_id", F.posexplode(X.paragraphs(F.col("text"))).alias("place", "paragraph"))


@query
def paging_15(spark: SparkSession, at: str) -> DataFrame:
    rows = Tables(spark, at).kind("hadith").select("id", "book_slug")
    return search.paged(rows, [F.col("id")], 15, ["book_slug"], coarse=[stretch_of(F.col("id"))])


def _narrators(t: Tables) -> DataFrame:
    return t.grading.filter("rawi is not null").groupBy(F.col("rawi").alias("key")).agg(F.count("*").alias("c"))


@query
def narrators_page_2(spark: SparkSession, at: str) -> DataFrame:
    return search.one_page(_narrators(Tables(spark, at)), [F.desc("c"), F.asc("key")], 36, 2, 0)


@query
def narrators_top60(spark: SparkSession, at: str) -> DataFrame:
    return search.top(_narrators(Tables(spark, at)), [F.desc("c"), F.asc("key")])


def _sections(t: Tables) -> DataFrame:
    """Sections of a hundred numbers of a book."""
    return t.kind("hadith").groupBy(F.col("book_slug").alias("book"), F.floor(F.col("hadith_no") / 100).cast("int").alias("section")).agg(F.count("*").alias("texts"))


@query
def catalogue_totals(spark: SparkSession, at: str) -> DataFrame:
    return search.catalogue_totals(_sections(Tables(spark, at)))


@query
def section_names(spark: SparkSession, at: str) -> DataFrame:
    """Narrations with the name of their section; only larger sections have one."""
    t = Tables(spark, at)
    named = _sections(t).filter("texts > 2").withColumn("name", F.concat_ws(" ", "book", "section"))
    rows = t.kind("hadith").select("id", F.col("book_slug").alias("book"), F.floor(F.col("hadith_no") / 100).cast("int").alias("section"))
    return search.with_section(rows, named).select("id", "section_name")


@query
def picked_books(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    chosen = spark.createDataFrame(core_sql.PICKS, "pos int, book string, section int")
    return search.picks(chosen, _sections(t).withColumn("texts", F.col("texts"))).select("pos", "book", "section", "texts")


@query
def narrator_refs(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    heard = t.grading.filter("rawi is not null").select(F.col("rawi").alias("key"), "unit_id").join(t.kind("hadith").select(F.col("id").alias("unit_id"), F.col("book_slug").alias("book"), F.col("hadith_no").alias("number")), "unit_id")
    return search.narrator_refs(heard.select("key", "book", "number").distinct(), t.books.filter("author is not null"))


@query
def ruling_facts(spark: SparkSession, at: str) -> DataFrame:
    return search.facts(Tables(spark, at).grading, "id", {"rawi": "الراوي", "page": "الصفحة", "explanation": "الشرح"})


# ---- chains and classes -------------------------------------------------


@query
def split_chains(spark: SparkSession, at: str) -> DataFrame:
    chain, matn = isnad.split_isnad(F.col("text_ar"))
    return Tables(spark, at).unit.select("id", chain.alias("isnad"), matn.alias("matn"))


@query
def chain_names(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).kind("hadith").select("id", F.posexplode(isnad.chain_names(F.col("text_ar"))).alias("place", "name"))


@query
def chain_members(spark: SparkSession, at: str) -> DataFrame:
    """Members of chains: the first by the index of narrators, the others as they stand."""
    t = Tables(spark, at)
    links = t.kind("hadith").select(F.col("id").alias("doc"), F.posexplode(isnad.chain_names(F.col("text_ar"))).alias("pos", "value"))
    links = links.withColumn("kind", F.when(F.col("pos") == 0, "i").otherwise("t"))
    index = t.grading.filter("rawi is not null").groupBy(F.col("rawi").alias("key")).agg(F.min("grade").alias("g")).select("key", F.col("key").alias("n"), "g", F.lit("").alias("gen_label"))
    return search.resolve_chain(links, index)


@query
def grade_classes(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).grading.select("id", classify.grade_class(F.col("grade")).alias("class"))


@query
def narrator_classes(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).grading.select("id", classify.narrator_class(F.col("grade")).alias("class"))


@query
def generation_labels(spark: SparkSession, at: str) -> DataFrame:
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(core_sql.GENERATIONS)], "pos int, gen string")
    return rows.select("pos", classify.generation_label(F.col("gen")).alias("label"))


@query
def method_labels(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).link.select("id", X.method_label(F.col("method")).alias("label"))


@query
def shared_with_text(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).link.select("id", X.join_shared(F.col("shared_with")).alias("shared_with"))


@query
def ref_parts(spark: SparkSession, at: str) -> DataFrame:
    surah, ayah = X.parse_ref(F.col("ref_key"))
    t = Tables(spark, at)
    return t.unit.filter("kind <> 'hadith'").select("id", surah.alias("s"), ayah.alias("a"))


@query
def page_dashes(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).grading.select("id", X.page_or_dash(F.col("page")).alias("page"))


# ---- sources ------------------------------------------------------------


@query
def hadith_scan(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    rows = t.unit.filter("hadith_no is not null and length(text_ar) > 0").join(t.books.select(F.col("slug").alias("book_slug"), "ar"), "book_slug", "left")
    return rows.select("id", F.format_string("%s — حديث رقم %d", F.coalesce("ar", "book_slug"), "hadith_no").alias("locus_ar"))


@query
def surah_metadata(spark: SparkSession, at: str) -> DataFrame:
    t = Tables(spark, at)
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("n").alias("chapter"), F.col("ar").alias("arabicname"), F.when(F.col("rev") == "مكية", "Meccan").otherwise("Medinan").alias("revelation"), F.transform(F.sequence(F.lit(1), F.col("verse_count")), lambda i: i.cast("string")).alias("verses"))).alias("references")).alias("chapters")))
    rows = t.surahs.select(F.explode(readers.parse_chapters(body)).alias("c"))
    rev = F.when(F.lower("c.revelation").startswith("mecc"), "مكية").otherwise("مدنية")
    return rows.select(F.col("c.chapter").alias("n"), F.col("c.arabicname").alias("ar"), rev.alias("rev"), F.size("c.verses").alias("verse_count"))


@query
def json_rulings(spark: SparkSession, at: str) -> DataFrame:
    """Rulings read back from the JSON answers of a search, one answer for each unit."""
    g = Tables(spark, at).grading
    item = F.struct(F.concat(F.lit(" "), "muhaddith").alias("mohdith"), "book", F.col("page").alias("numberOrPage"), "grade", F.col("explanation").alias("explainGrade"), "rawi", F.lit("").alias("hadith"))
    answers = g.select("id", F.to_json(F.struct(F.struct(F.array(item).alias("result")).alias("ahadith"))).alias("body"))
    return readers.parse_rulings(answers)


@query
def html_rulings(spark: SparkSession, at: str) -> DataFrame:
    """The same from answers that hold HTML."""
    g = Tables(spark, at).grading
    part = lambda label, c: F.concat(F.lit(f'<span class="t">{label} : </span> '), X.escape_html(F.coalesce(c, F.lit("")), apostrophe=False), F.lit(" "))
    fields = [part(x, F.col(c)) for x, c in zip(readers.HTML_LABELS, ("muhaddith", "book", "page", "grade", "rawi"), strict=True)]
    html = F.concat(F.lit('<div class="hadith-info"><div>'), *fields, F.lit("<br></div> </div>"))
    answers = g.select("id", F.to_json(F.struct(F.struct(html.alias("result")).alias("ahadith"))).alias("body"))
    return readers.parse_rulings(answers).select("id", "muhaddith", "page", "grade", "rawi")


@query
def json_events(spark: SparkSession, at: str) -> DataFrame:
    e = Tables(spark, at).events
    return e.select("event_id", F.from_json("props", "k int").getField("k").alias("k")).filter("k is not null")


@query
def cache_keys(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).unit.select("url").distinct().select("url", X.cache_key(F.col("url")).alias("key"))


@query
def quoted_urls(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).grading.select("id", X.quote_url(F.col("muhaddith")).alias("quoted"))


@query
def mirrors(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).books.select("slug", readers.first_available(F.col("author"), F.col("ar")).alias("answer"))


@query
def shards(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).grading.select("muhaddith").distinct().select("muhaddith", X.shard(F.col("muhaddith")).alias("shard"))


@query
def edition_names(spark: SparkSession, at: str) -> DataFrame:
    return Tables(spark, at).kind("tafsir").select("id", F.concat(readers.lookup(readers.EDITION_NAMES, F.col("edition")), F.lit(" — عند "), "ref_key").alias("locus_ar"))


SQL = {k: v for k, v in core_sql.SQL.items() if k in QUERIES}

