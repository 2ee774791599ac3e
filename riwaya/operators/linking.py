"""Links between verses and other units: quotation, naming, shared key, and what they rest on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riwaya.functions import text as X
from riwaya.functions.normalize import tokens_of
from riwaya.session import ensure_checkpoint_dir, kept
from riwaya.sources.readers import EDITION_NAMES, lookup

MIN_WORDS = 5
#: Titles that are sent to all tasks at most.
TITLES = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: a column used inside a lambda is computed for each element."""
    return F.transform(F.array(value), body)[0]


def windows(words: Column, n: int) -> Column:
    """All runs of n words, from the left; [] for shorter texts."""
    none = F.array().cast("array<string>")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(none))


def _interior(items: DataFrame, least: int) -> DataFrame:
    """(item, pos, probe, gram): each window of ``least`` words, its place, and the hash of the words strictly inside it."""
    probe = F.posexplode(windows(tokens_of(F.col("item_text")), least)).alias("pos", "probe")
    return items.select("item", probe).withColumn("gram", F.xxhash64(F.array_join(F.slice(F.split("probe", " "), 2, least - 2), " ")))


def _hits(items: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """(item, pos, doc, doc_text): the window of ``least`` words at a place of the item stands in the document as a substring.

    The first and last word of a window may be parts of words of the document,
    the words between are whole words: their hashes are joined, and the window
    is then looked for in the text. Documents enter the join by number and hash
    only; texts are fetched for the candidates.
    """
    if least < 3:
        raise ValueError("windows of three words at least")
    inside = F.explode(F.array_distinct(F.transform(windows(tokens_of(F.col("doc_text")), least - 2), lambda g: F.xxhash64(g))))
    candidates = docs.select("doc", inside.alias("gram")).join(_interior(items, least), "gram").select("item", "pos", "probe", "doc")
    return candidates.join(docs, "doc").filter(F.contains("doc_text", "probe")).select("item", "pos", "doc", "doc_text")


def containing(items: DataFrame, docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(item, doc, doc_text): some window of ``least`` words of the item stands in the document as a substring."""
    return _hits(items, docs, least).groupBy("item", "doc").agg(F.any_value("doc_text").alias("doc_text"))


def find_quotations(items: DataFrame, docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(item, doc, quoted, quoted_words): the longest window of the item in the document, the leftmost of equals.

    ``items`` is (item, item_text), ``docs`` (doc, doc_text), both in matching
    form. All windows of ``least`` words within a quoted one are quoted, too; so
    only runs of quoted windows are tried, the longest first, and none after the
    first that stands in the document.
    """
    pairs = _hits(items, docs, least).groupBy("item", "doc").agg(F.array_sort(F.collect_set("pos")).alias("at"), F.any_value("doc_text").alias("doc_text"))
    # (words, place) of each run of neighbouring places, by length and place
    at = F.col("at")
    ends = lambda a, i: F.transform(F.filter(F.slice(at, i + 1, F.size(at)), lambda b, k: b - a == k), lambda b: F.struct((a - b - least).alias("less"), a.alias("first")))
    runs = F.array_sort(F.flatten(F.transform(at, ends)))
    words = tokens_of(F.col("item_text"))
    tried = pairs.withColumn("runs", runs).join(items.select("item", words.alias("words")), "item")
    run = lambda r: F.array_join(F.slice(F.col("words"), r["first"] + 1, -r["less"]), " ")
    none = F.lit(None).cast("string")
    quoted = F.aggregate("runs", none, lambda got, r: F.coalesce(got, let(run(r), lambda w: F.when(F.contains(F.col("doc_text"), w), w))))
    return tried.select("item", "doc", quoted.alias("quoted")).withColumn("quoted_words", F.size(F.split("quoted", " ")))


def other_places(quotes: DataFrame, items: DataFrame) -> DataFrame:
    """(item, quoted, also): refs of the other items that hold a quoted phrase, in order. ``items`` has (item, item_text, ref, surah, ayah)."""
    phrases = quotes.select("quoted").distinct()
    # a phrase is an item of its own here; its windows lead to the candidates
    keyed = phrases.select(F.col("quoted").alias("item"), F.col("quoted").alias("item_text"))
    where = containing(keyed, items.select(F.col("item").alias("doc"), F.col("item_text").alias("doc_text")))
    place = items.select(F.col("item").alias("doc"), "ref", "surah", "ayah")
    sure = where.filter(F.contains("doc_text", "item")).join(place, "doc").select(F.col("item").alias("quoted"), F.col("doc").alias("other"), "ref", "surah", "ayah")
    found = quotes.select("item", "quoted").distinct().join(sure, "quoted").filter("item <> other")
    also = F.transform(F.array_sort(F.collect_list(F.struct("surah", "ayah", "ref", "other"))), lambda x: x.ref)
    return found.groupBy("item", "quoted").agg(also.alias("also"))


def named_docs(titles: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, needles): the needles of titles that stand in each document; further columns of ``docs`` stay.

    A title stands anywhere, also within words: its first word ends a word of the
    document, its last word begins one, those between are whole words, and a
    single word is any part of one. So these parts of the *vocabulary* are joined
    with the titles' words by equality; each title takes its rarest word to the
    documents, where the whole title is looked for. One row for each document:
    pairs with the items of a title, which may be very many, aren't made here.
    """
    titles = titles.filter("needle <> ''")
    words = F.split("needle", " ")
    n = F.size(words)
    slots = titles.select("needle").distinct().select("needle", n.alias("n"), F.posexplode(words).alias("slot", "part"))
    way = F.when(F.col("n") == 1, "part").when(F.col("slot") == 0, "end").when(F.col("slot") == F.col("n") - 1, "begin").otherwise("whole")
    slots = slots.select("needle", "slot", "part", way.alias("way"))
    inside = docs.select("doc", F.explode(F.array_distinct(tokens_of(F.col("doc_text")))).alias("word"))
    vocabulary = inside.groupBy("word").agg(F.count("*").alias("df"))
    size = F.length("word")
    cut = lambda way, parts: F.transform(parts, lambda x: F.struct(F.lit(way).alias("way"), x.alias("part")))
    from_to = lambda i, j: F.substring(F.col("word"), i, j - i + 1)
    all_parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(i, size), lambda j: from_to(i, j)))))
    ends = F.transform(F.sequence(F.lit(1), size), lambda i: from_to(i, size))
    begins = F.transform(F.sequence(F.lit(1), size), lambda j: from_to(F.lit(1), j))
    keyed = vocabulary.select("word", "df", F.explode(F.concat(cut("part", all_parts), cut("end", ends), cut("begin", begins), cut("whole", F.array("word")))).alias("x")).select("word", "df", "x.*")
    matched = slots.join(keyed, ["way", "part"]).select("needle", "slot", "word", "df")
    rarest = matched.groupBy("needle", "slot").agg(F.sum("df").alias("docs")).groupBy("needle").agg(F.min_by("slot", F.struct("docs", "slot")).alias("slot"))
    able = matched.join(rarest, ["needle", "slot"]).select("needle", "word").join(inside, "word").groupBy("doc").agg(F.collect_set("needle").alias("needles"))
    hits = able.join(docs, "doc").withColumn("needles", F.filter("needles", lambda x: F.contains(F.col("doc_text"), x))).filter(F.size("needles") > 0)
    return hits.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("needles"))).alias("needles"), *[F.any_value(c).alias(c) for c in docs.columns if c not in ("doc", "doc_text")])


def naming_pairs(named: DataFrame, titles: DataFrame) -> DataFrame:
    """Each of :func:`named_docs` with each item that has a title there, and the first such title, in list order, with its evidence.

    That a title is the first one is seen from the needles of its document, so
    pairs are neither sorted nor exchanged. Up to ``TITLES`` titles are sent to
    the documents; more are joined by needle.
    """
    own = titles.filter("needle <> ''").groupBy("item", "needle").agg(F.min(F.struct("place", "name", "attested", "title_source")).alias("x"))
    listed = own.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("x.*", "needle"))).alias("all"))
    at = listed.select("item", "all", F.posexplode("all").alias("k", "t"))
    evidence = X.naming_evidence(F.col("t.name"), F.col("t.attested"), F.col("t.title_source"))
    first = at.select("item", "t.needle", F.col("t.name").alias("named"), "t.attested", "t.title_source", evidence.alias("evidence_ar"), F.transform(F.slice("all", 1, F.col("k")), lambda t: t["needle"]).alias("before"))
    first = F.broadcast(first) if titles.count() <= TITLES else first
    pairs = named.withColumn("needle", F.explode("needles")).join(first, "needle")
    return pairs.filter(~F.arrays_overlap("before", "needles")).drop("needle", "needles", "before")


def find_by_name(titles: DataFrame, docs: DataFrame) -> DataFrame:
    """(item, doc, named, attested, title_source): the first title, in list order, that stands in the document.

    ``titles`` is (item, place, name, needle, attested, title_source).
    """
    return naming_pairs(named_docs(titles, docs), titles).select("item", "doc", "named", "attested", "title_source")


def find_links(items: DataFrame, docs: DataFrame, titles: DataFrame, least: int = MIN_WORDS, places: DataFrame | None = None, folders: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What links rest on: quotations with ``also`` (other places of the phrase), and :func:`named_docs` with ``quoted`` (items that the document quotes).

    Further columns of ``docs`` stay in both. Quotations are found once; where
    ``folders`` is given, all is kept, see :func:`riwaya.session.kept`.
    """
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)
    text = docs.select("doc", "doc_text")
    quotes = find_quotations(items.select("item", "item_text"), text, least).checkpoint()
    also = other_places(quotes, items if places is None else places)
    marked = quotes.join(also, ["item", "quoted"], "left").withColumn("also", F.coalesce("also", F.array().cast("array<string>")))
    if docs.columns != text.columns:
        marked = marked.join(docs.drop("doc_text"), "doc")
    quoted = quotes.groupBy("doc").agg(F.collect_set("item").alias("quoted"))
    named = named_docs(titles, docs).join(quoted, "doc", "left").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (marked, named) if folders is None else (kept(marked, "quotes", folders), kept(named, "named", folders))


def naming_only(named: DataFrame, titles: DataFrame) -> DataFrame:
    """:func:`naming_pairs` without those whose document quotes the item."""
    return naming_pairs(named, titles).filter(F.col("quoted").isNull() | ~F.array_contains("quoted", F.col("item"))).drop("quoted")


def merge_links(quotes: DataFrame, named: DataFrame, titles: DataFrame) -> DataFrame:
    """The links that :func:`find_links` found: quotations, and namings where the document isn't quoted already."""
    more = [c for c in named.columns if c not in ("doc", "needles", "quoted")]
    q = quotes.select("item", "doc", F.lit("quotation").alias("method"), F.col("quoted").alias("phrase"), F.col("also").alias("shared_with"), X.quotation_evidence(F.col("quoted"), F.col("quoted_words"), F.col("also")).alias("evidence_ar"), *more)
    n = naming_only(named, titles).select("item", "doc", F.lit("naming").alias("method"), F.col("named").alias("phrase"), F.array().cast("array<string>").alias("shared_with"), "evidence_ar", *more)
    return q.unionByName(n).withColumn("ambiguous", F.size("shared_with") > 0)


def link_all(items: DataFrame, docs: DataFrame, titles: DataFrame, least: int = MIN_WORDS, places: DataFrame | None = None) -> DataFrame:
    """The links of all items: found, checked for ambiguity, merged.

    A phrase is ambiguous if others of ``places`` hold it, which are the items
    where nothing else is given. Quotations are found once and kept.
    """
    return merge_links(*find_links(items, docs.select("doc", "doc_text"), titles, least, places), titles)


def shared_key_links(verses: DataFrame, commentaries: DataFrame, editions: list[str] | None = None) -> DataFrame:
    """(from_unit, to_unit, relation, method, evidence_ar) by equal surah and ayah."""
    c = commentaries.filter(F.col("edition").isin(editions)) if editions else commentaries
    c = c.select(F.col("id").alias("to_unit"), "surah", "ayah", "edition")
    joined = verses.select(F.col("id").alias("from_unit"), "surah", "ayah").join(c, ["surah", "ayah"])
    evidence = F.format_string(X.SHARED_KEY, lookup(EDITION_NAMES, F.col("edition")), "surah", "ayah")
    return joined.select("from_unit", "to_unit", F.lit("ayah_tafsir").alias("relation"), F.lit("shared_key").alias("method"), evidence.alias("evidence_ar"))


def in_order(quotes: DataFrame) -> DataFrame:
    """Place of each quotation of an item: more words first, then in corpus order."""
    rank = Window.partitionBy("item").orderBy(F.desc("quoted_words"), "doc")
    return quotes.withColumn("place", F.row_number().over(rank))
