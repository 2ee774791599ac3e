"""Readers of landed JSON and HTML files. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riwaya import schemas as S
from riwaya.functions.normalize import normalize
from riwaya.functions.text import trim_white

# ---- fixed values -------------------------------------------------------
BOOK_NAMES = {
    "bukhari": "صحيح البخاري", "muslim": "صحيح مسلم", "abudawud": "سنن أبي داود", "tirmidhi": "جامع الترمذي", "nasai": "سنن النسائي",
    "ibnmajah": "سنن ابن ماجه", "malik": "موطأ مالك", "ahmed": "مسند أحمد", "darimi": "سنن الدارمي",
}
EDITION_NAMES = {
    "ar-tafsir-ibn-kathir": "تفسير ابن كثير", "ar-tafsir-as-saadi": "تيسير الكريم الرحمن — السعدي", "ar-tafsir-al-tabari": "جامع البيان — الطبري",
    "ar-tafsir-muyassar": "التفسير الميسّر", "ar-tafseer-al-qurtubi": "الجامع لأحكام القرآن — القرطبي",
}
#: Labels of a ruling in HTML, in the order of muhaddith, book, page, grade, rawi.
HTML_LABELS = ("المحدث", "المصدر", "الصفحة أو الرقم", "خلاصة حكم المحدث", "الراوي")
#: Where a ruling begins and ends in HTML.
HTML_OPEN, HTML_CLOSE = '<div class="hadith-info">', r"</div>\s*</div>"
# -------------------------------------------------------------------------


def lookup(names: dict[str, str], c: Column) -> Column:
    """The name of a code, or the code."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c], c)


def read_quran(spark: SparkSession, path: str) -> DataFrame:
    """(surah, ayah, text_ar) of a whole dump."""
    raw = spark.read.schema(S.QURAN_JSON).json(path, multiLine=True)
    return raw.select(F.explode("quran").alias("v")).select(F.col("v.chapter").alias("surah"), F.col("v.verse").alias("ayah"), F.col("v.text").alias("text_ar"))


def read_hadith_books(spark: SparkSession, path: str, slug: str = r"([^/]+)\.json$") -> DataFrame:
    """(book_slug, hadith_no, text_ar, text_norm, locus_ar) of all books in a folder; rows without number or text are left out.

    ``slug`` finds a book's slug in the path of its file.
    """
    raw = spark.read.schema(S.HADITH_BOOK_JSON).option("recursiveFileLookup", "true").json(path, multiLine=True).withColumn("book_slug", F.regexp_extract(F.input_file_name(), slug, 1))
    rows = raw.select("book_slug", F.explode("hadiths").alias("h")).filter("h.idInBook is not null and length(h.arabic) > 0")
    text = F.col("h.arabic")
    return rows.select("book_slug", F.col("h.idInBook").alias("hadith_no"), text.alias("text_ar"), normalize(text).alias("text_norm"), F.format_string("%s — حديث رقم %d", lookup(BOOK_NAMES, F.col("book_slug")), F.col("h.idInBook")).alias("locus_ar"))


def parse_chapters(raw: Column) -> Column:
    """Chapters of the surah file, which holds them as a list or under ``references``."""
    inner = F.get_json_object(raw, "$.chapters")
    nested = F.get_json_object(inner, "$.references")
    return F.from_json(F.coalesce(nested, inner), f"array<{S.CHAPTER}>")


def read_surahs(spark: SparkSession, path: str) -> DataFrame:
    """(n, ar, en, rev, verse_count); revelation is Meccan by prefix, otherwise Medinan."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(parse_chapters(F.col("value"))).alias("c"))
    rev = F.when(F.lower("c.revelation").startswith("mecc"), "مكية").otherwise("مدنية")
    return rows.select(F.col("c.chapter").alias("n"), F.col("c.arabicname").alias("ar"), F.col("c.englishname").alias("en"), rev.alias("rev"), F.size("c.verses").alias("verse_count"))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """(ref_key, place, name, needle, attested, title_source); a missing file gives no rows."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:  # the file is optional
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "ref_key string, place int, name string, needle string, attested string, title_source string")
    titles = F.from_json(F.get_json_object("value", "$.titles"), S.TITLES_JSON)
    rows = raw.select(F.explode(titles).alias("ref_key", "t")).select("ref_key", F.posexplode("t").alias("place", "t"))
    return rows.select("ref_key", "place", F.col("t.name").alias("name"), normalize(F.col("t.name")).alias("needle"), F.col("t.attested_ar").alias("attested"), F.col("t.source_ar").alias("title_source"))


def read_manual_links(spark: SparkSession, path: str) -> DataFrame:
    """(ref_key, place, entry) of links set by hand, each entry as JSON; a missing file gives no rows."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:  # the file is optional
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "ref_key string, place int, entry string")
    rows = raw.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("ref_key", "e"))
    return rows.select("ref_key", F.posexplode("e").alias("place", "entry"))


def _filled(c: Column) -> Column:
    return F.when(trim_white(c) != "", trim_white(c))


def parse_rulings(answers: DataFrame, column: str = "body") -> DataFrame:
    """Rulings of answers that hold a JSON list or HTML: (…, muhaddith, book, page, grade, explanation, rawi).

    Values are trimmed; empty page, explanation and rawi are null; rulings without
    scholar or grade are left out. All other columns of ``answers`` stay.
    """
    result = F.get_json_object(column, "$.ahadith.result")
    listed = F.from_json(result, f"array<{S.RULING}>")

    def of_html(block: Column) -> Column:
        # each span opens a field: its label, the end of the span, and the value up to the next tag
        fields = F.filter(F.split(block, "<span[^>]*>"), lambda x, i: i > 0)
        label = lambda x: F.regexp_replace(trim_white(F.substring_index(x, "</span>", 1)), r"[\s:]+$", "")
        value = lambda x: trim_white(F.substring_index(F.get(F.split(x, "</span>"), F.lit(1)), "<", 1))
        pick = lambda name: F.coalesce(F.get(F.transform(F.filter(fields, lambda x: label(x) == name), value), F.lit(0)), F.lit(""))
        m, k, p, g, r = map(pick, HTML_LABELS)
        return F.struct(m.alias("mohdith"), k.alias("book"), p.alias("numberOrPage"), g.alias("grade"), F.lit("").alias("explainGrade"), r.alias("rawi"), F.lit("").alias("hadith"))

    # a block counts once it is closed
    closed = F.filter(F.split(result, HTML_OPEN), lambda b, i: (i > 0) & b.rlike(HTML_CLOSE))
    blocks = F.transform(closed, lambda b: F.split(b, HTML_CLOSE, 2)[0])

    items = F.when(F.trim(result).startswith("["), listed).otherwise(F.transform(blocks, of_html))
    rows = answers.select(*[c for c in answers.columns if c != column], F.explode(items).alias("r"))
    rows = rows.select(
        *[c for c in answers.columns if c != column],
        trim_white(F.coalesce("r.mohdith", F.lit(""))).alias("muhaddith"), trim_white(F.coalesce("r.book", F.lit(""))).alias("book"), _filled(F.col("r.numberOrPage")).alias("page"),
        trim_white(F.coalesce("r.grade", F.lit(""))).alias("grade"), _filled(F.col("r.explainGrade")).alias("explanation"), _filled(F.col("r.rawi")).alias("rawi"),
    )
    return rows.filter("muhaddith <> '' and grade <> ''")


def read_search_index(spark: SparkSession, path: str, books: list[str] | None = None) -> DataFrame:
    """(pos, num, sec, txt, grades, chain) of a positional index file, an array of arrays; pos is the place in its file.

    Where ``path`` holds a folder ``book=<slug>`` for each book, the book comes
    out, too, and with ``books`` no other folders are read.
    """
    at = lambda k: F.get("r", F.lit(k))
    raw = spark.read.text(path, wholetext=True)
    own = ["book"] if "book" in raw.columns else []
    if books is not None:
        raw = raw.filter(F.col("book").isin(books))
    rows = raw.select(*own, F.posexplode(F.from_json("value", "array<array<string>>")).alias("pos", "r"))
    return rows.select(*own, "pos", at(0).try_cast("int").alias("num"), at(1).try_cast("int").alias("sec"), at(2).alias("txt"), F.from_json(at(3), "array<array<string>>").alias("grades"), F.from_json(at(4), "array<array<string>>").alias("chain"))


def first_available(*candidates: Column) -> Column:
    """The first mirror that answered with something."""
    return F.coalesce(*[F.when(c != "", c) for c in candidates])
