"""Search over titles and texts, grouping of equal hits, paging, catalogues and narrators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riwaya.functions import text as X
from riwaya.functions.normalize import normalize
from riwaya.operators.numbering import numbered


def text_hits(docs: DataFrame, needle: str, limit: int | None = 60, scope: str | None = None) -> DataFrame:
    """Hits of a needle in matching form: (doc, book, snippet, sig, pos). ``docs`` is (doc, book, book_pos, doc_pos, txt).

    The first ``limit`` in the order of books and texts, as the search page
    shows them; None for all. A needle below two characters hits nothing.
    """
    hits = docs.filter(F.lit(len(needle) >= 2) & F.contains("txt", F.lit(needle)))
    if scope:
        hits = hits.filter(F.col("book") == scope)
    n = F.lit(needle)
    hits = hits.select("doc", "book", "book_pos", "doc_pos", X.snippet(F.col("txt"), n).alias("snippet"), X.signature(F.col("txt"), n).alias("sig"))
    hits = hits.orderBy("book_pos", "doc_pos").limit(limit) if limit else hits
    return hits


def _group_key() -> Column:
    return F.substring(F.coalesce(F.when(F.col("sig") != "", F.col("sig")), F.col("snippet")), 1, 60)


def grouped(hits: DataFrame) -> DataFrame:
    """Hits with the key of their group: the text after the match."""
    return hits.withColumn("key", _group_key())


def group_hits(hits: DataFrame) -> DataFrame:
    """(key, snippet, first_doc, n): groups of hits with equal text after the match, with the first hit's snippet.

    Members are the rows of :func:`grouped`; they aren't gathered, as a group may be any size.
    """
    first = F.min(F.struct("book_pos", "doc_pos", "doc", "snippet")).alias("x")
    return grouped(hits).groupBy("key").agg(first, F.count("*").alias("n")).select("key", "x.snippet", F.col("x.doc").alias("first_doc"), "n")


def hit_statistics(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count_distinct(_group_key()).alias("groups"), F.count("*").alias("hits"))


def quick_hits(branches: list[DataFrame], needle: str, limit: int = 40) -> DataFrame:
    """Titles that hold the needle: branch after branch, each in its order. A branch has (pos, kind, title, sub, href, haystack array)."""
    parts = []
    for k, df in enumerate(branches):
        hit = F.exists("haystack", lambda x: F.contains(normalize(x, "search"), F.lit(needle)))
        parts.append(df.filter(F.lit(needle != "") & hit).select(F.lit(k).alias("branch"), F.col("pos").cast("long").alias("pos"), "kind", "title", "sub", "href"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("branch", "pos").limit(limit)


def paged(rows: DataFrame, order: list[Column], size: int, group: list[str] | None = None, least_pages: int = 1, coarse: list[Column] | None = None) -> DataFrame:
    """Rows with page (from 1), place on the page and the number of pages of their group.

    ``coarse`` are columns that come first in the order and cut a group into
    stretches (see :func:`numbered`); without them a group is one stretch.
    """
    group = group or []
    total = rows.groupBy(*group).agg(F.count("*").alias("_total"))
    out = numbered(rows, "_n", group, coarse or [], order)
    out = out.join(total, group) if group else out.withColumn("_total", total.scalar())
    out = out.withColumn("pages", F.greatest(F.lit(least_pages), F.ceil(F.col("_total") / size)).cast("int"))
    return out.withColumn("page", F.ceil(F.col("_n") / size).cast("int")).withColumn("place", ((F.col("_n") - 1) % size + 1).cast("int")).drop("_n", "_total")


def one_page(rows: DataFrame, order: list[Column], size: int, page: int, least_pages: int = 1) -> DataFrame:
    """The rows of a page; the number is clamped to the pages there are.

    Only as many rows are sorted as stand up to the page.
    """
    total = rows.count()
    pages = max(least_pages, -(-total // size))
    at = min(max(1, page), pages)
    return rows.orderBy(*order).offset(max(0, (at - 1) * size)).limit(size)


def catalogue_totals(sections: DataFrame) -> DataFrame:
    """Books, texts and sections in all; ``sections`` is (book, section, texts)."""
    return sections.agg(F.count_distinct("book").alias("books"), F.sum("texts").alias("texts"), F.count("*").alias("sections"))


def with_section(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """Hits with the name of their section, '' where it has none."""
    return hits.join(sections.select("book", "section", F.col("name").alias("section_name")), ["book", "section"], "left").withColumn("section_name", F.coalesce("section_name", F.lit("")))


def picks(chosen: DataFrame, sections: DataFrame) -> DataFrame:
    """Chosen (pos, book, section) that exist, in the order of the choice."""
    return chosen.join(sections, ["book", "section"]).orderBy("pos")


def resolve_chain(chains: DataFrame, narrators: DataFrame) -> DataFrame:
    """Chain members with their names: kind 'i' by key, dropped if unknown; kind 't' as it stands. In order, the last one marked.

    ``chains`` is (doc, pos, kind, value), ``narrators`` (key, n, g, gen_label).
    """
    j = chains.join(narrators, (F.col("kind") == "i") & (F.col("value") == F.col("key")), "left").filter((F.col("kind") == "t") | F.col("key").isNotNull())
    named = j.select("doc", "pos", F.when(F.col("kind") == "i", F.col("n")).otherwise(F.col("value")).alias("name"), F.when(F.col("kind") == "i", X.join_filled(" — ", F.col("g"), F.col("gen_label"))).otherwise("").alias("sub"))
    w = Window.partitionBy("doc")
    return named.withColumn("nth", F.row_number().over(w.orderBy("pos"))).withColumn("last", F.col("nth") == F.count("*").over(w)).drop("pos")


def narrator_refs(refs: DataFrame, books: DataFrame, most: int = 90) -> DataFrame:
    """The first ``most`` references (key, book, number) of each narrator with the book's name, or its slug; ``total`` counts all."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy("book", "number"))
    total = refs.groupBy("key").agg(F.count("*").alias("total"))
    first = refs.withColumn("pos", nth).filter(F.col("pos") <= most).withColumn("pos", F.col("pos") - 1)
    named = first.join(books.select(F.col("slug").alias("book"), "ar"), "book", "left")
    return named.join(total, "key").select("key", "pos", "number", F.coalesce("ar", "book").alias("book_name"), "total")


def split_refs(narrators: DataFrame) -> DataFrame:
    """(key, book, number) of narrators (key, h array<"book:number">)."""
    return narrators.select("key", F.explode("h").alias("ref")).select("key", F.split("ref", ":")[0].alias("book"), F.get(F.split("ref", ":"), F.lit(1)).try_cast("int").alias("number"))


def top(rows: DataFrame, order: list[Column], k: int = 60) -> DataFrame:
    """The first k rows; a top-k needs no total sort."""
    return rows.orderBy(*order).limit(k)


def facts(rows: DataFrame, key: str, labelled: dict[str, str]) -> DataFrame:
    """(key, pos, label, value): the facts of a row that aren't empty."""
    items = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(label).alias("label"), F.col(c).cast("string").alias("value")) for k, (c, label) in enumerate(labelled.items())])
    return rows.select(key, F.explode(F.filter(items, lambda x: x.value.isNotNull() & (x.value != ""))).alias("x")).select(key, "x.*")
