"""The page of a verse: its commentaries and narrations, ranked, with their rulings; and moving between verses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riwaya.functions.text import trim_white
from riwaya.operators.numbering import beside, numbered, stretch_of

METHOD_RANK = {"quotation": 0, "naming": 1, "manual": 2}


def method_rank(c: Column) -> Column:
    out = F.lit(9)
    for name, k in METHOD_RANK.items():
        out = F.when(c == name, k).otherwise(out)
    return out


def linked_units(links: DataFrame, units: DataFrame, sources: DataFrame) -> DataFrame:
    """Links with the unit they lead to and its source's name."""
    u = units.select(F.col("id").alias("to_unit"), "source_id", "kind", "ref_key", "book_slug", "hadith_no", "edition", "text_ar", "locus_ar", F.col("url").alias("unit_url"))
    s = sources.select(F.col("id").alias("source_id"), F.col("name_ar").alias("source_name"))
    return links.join(u, "to_unit").join(s, "source_id")


def ranked_hadiths(links: DataFrame, units: DataFrame, sources: DataFrame) -> DataFrame:
    """Narrations of each verse with their place: unambiguous first, then by method, book and number.

    A verse may have a great share of all links, so its narrations are numbered by stretches of equal method, book and range of numbers.
    """
    rows = linked_units(links, units, sources).filter("kind = 'hadith'")
    number = F.coalesce("hadith_no", F.lit(0))
    coarse = [F.col("ambiguous"), method_rank(F.col("method")), F.col("book_slug"), stretch_of(number, 100)]
    return numbered(rows, "place", ["from_unit"], coarse, [number, F.col("id")])


def rulings_in_order(gradings: DataFrame) -> DataFrame:
    """Rulings with their place (``ruling_place``) among those on their unit, by scholar and id."""
    order = Window.partitionBy("unit_id").orderBy("muhaddith", "id")
    return gradings.withColumn("ruling_place", F.row_number().over(order))


def page_counts(units: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """(id, source_name, tafsirs, hadiths) of each verse; counts only, so a verse with any number of links is one small row."""
    kinds = links.select("from_unit", F.col("to_unit").alias("u")).join(units.select(F.col("id").alias("u"), F.col("kind").alias("linked")), "u")
    n = kinds.groupBy(F.col("from_unit").alias("id")).agg(F.count_if(F.col("linked") == "tafsir").alias("tafsirs"), F.count_if(F.col("linked") == "hadith").alias("hadiths"))
    verse = units.filter("kind = 'ayah'").select("id", "source_id").join(sources.select(F.col("id").alias("source_id"), F.col("name_ar").alias("source_name")), "source_id")
    return verse.join(n, "id", "left").select("id", "source_name", F.coalesce("tafsirs", F.lit(0)).alias("tafsirs"), F.coalesce("hadiths", F.lit(0)).alias("hadiths"))


def verse_pages(units: DataFrame, sources: DataFrame, links: DataFrame, gradings: DataFrame, verses: list[tuple[int, int]]) -> DataFrame:
    """The pages of the given verses (surah, ayah), nested: commentaries, ranked narrations, their rulings ([] where none).

    A page is one row with everything on it, so it is made for the verses that are
    asked for. For all verses use the flat forms: :func:`ranked_hadiths`,
    :func:`rulings_in_order`, :func:`page_counts`.
    """
    asked = F.lit(False)
    for surah, ayah in verses:
        asked = asked | ((F.col("surah") == surah) & (F.col("ayah") == ayah))
    verse = units.filter((F.col("kind") == "ayah") & asked)
    own = links.join(verse.select(F.col("id").alias("from_unit")), "from_unit", "left_semi")
    hadiths = ranked_hadiths(own, units, sources)
    item = F.struct("muhaddith", "id", "book", "page", "grade", "explanation", "rawi", "url")
    rulings = gradings.join(hadiths.select(F.col("to_unit").alias("unit_id")), "unit_id", "left_semi").groupBy("unit_id").agg(F.array_sort(F.collect_list(item)).alias("gradings"))
    hadiths = hadiths.join(rulings, hadiths.to_unit == F.col("unit_id"), "left").withColumn("gradings", F.coalesce("gradings", F.array()))
    item = F.struct("place", "to_unit", "source_name", "book_slug", "hadith_no", "text_ar", "locus_ar", "unit_url", "method", "evidence_ar", "ambiguous", "shared_with", "gradings")
    h = hadiths.groupBy("from_unit").agg(F.array_sort(F.collect_list(item)).alias("hadiths"))
    t = linked_units(own, units, sources).filter("kind = 'tafsir'").groupBy("from_unit").agg(F.array_sort(F.collect_list(F.struct("edition", "to_unit", "source_name", "text_ar", "locus_ar", "unit_url"))).alias("tafsirs"))
    verse = verse.join(sources.select(F.col("id").alias("source_id"), F.col("name_ar").alias("source_name")), "source_id")
    joined = verse.join(t, F.col("id") == t.from_unit, "left").drop("from_unit").join(h, F.col("id") == h.from_unit, "left").drop("from_unit")
    return joined.withColumns({"tafsirs": F.coalesce("tafsirs", F.array()), "hadiths": F.coalesce("hadiths", F.array())})


def disputed(gradings: DataFrame) -> DataFrame:
    """(unit_id, rulings, grades, disputed): disputed where the trimmed grades differ."""
    return gradings.groupBy("unit_id").agg(F.count("*").alias("rulings"), F.count_distinct(trim_white(F.col("grade"))).alias("grades")).withColumn("disputed", F.col("grades") > 1)


def ruling_urls(gradings: DataFrame) -> DataFrame:
    """Distinct (unit_id, url)."""
    return gradings.select("unit_id", "url").distinct()


def verse_order(surahs: DataFrame) -> DataFrame:
    """Every verse with the next and the previous one, across surahs. ``surahs`` is (n, verse_count)."""
    verse = surahs.select(F.col("n").alias("surah"), F.explode(F.sequence(F.lit(1), F.col("verse_count"))).alias("ayah"))
    # neighbours follow from the lengths of the surahs; no global sort of verses is needed
    length = surahs.select(F.col("n").alias("surah"), "verse_count", F.lag("verse_count").over(Window.orderBy("n")).alias("before"), F.lead("n").over(Window.orderBy("n")).alias("follow"))
    j = verse.join(length, "surah")
    inside, first = F.col("ayah") < F.col("verse_count"), F.col("ayah") == 1
    return j.select(
        "surah", "ayah",
        F.when(inside, F.concat_ws(":", "surah", F.col("ayah") + 1)).when(F.col("follow").isNotNull(), F.concat(F.col("follow").cast("string"), F.lit(":1"))).alias("next_ref"),
        F.when(~first, F.concat_ws(":", "surah", F.col("ayah") - 1)).when(F.col("before").isNotNull(), F.concat_ws(":", F.col("surah") - 1, "before")).alias("prev_ref"),
    )


def neighbours(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Previous and next value in index order within a group; a value of 0 counts as none. The order has no equals."""
    none = lambda c: F.when(F.col(c) != 0, F.col(c))
    return beside(rows, group, order, value).withColumns({"prev": none("_prev"), "next": none("_next")}).drop("_prev", "_next")


def clamp(value: Column, most: Column) -> Column:
    return F.greatest(F.lit(1), F.least(value, most))


def valid_ref(refs: DataFrame, surahs: DataFrame) -> DataFrame:
    """(surah, ayah, valid): the verse exists; an unknown surah has none."""
    known = refs.join(surahs.select(F.col("n").alias("surah"), "verse_count"), "surah", "left")
    return known.withColumn("valid", F.col("ayah").between(F.lit(1), F.coalesce("verse_count", F.lit(0)))).drop("verse_count")
