"""The queries of this subpackage over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riwaya.functions.normalize import sql_normalize


def _read(spark: SparkSession, at: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{at}/{table}.parquet")
    return df.select(*columns) if columns else df


def _names(spark: SparkSession, at: str) -> DataFrame:
    fields = ("muhaddith", "rawi", "book")
    rows = _read(spark, at, "grading", *fields)
    listed = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("name")) for c in fields])
    return rows.select(F.explode(listed).alias("x")).select("x.*")


def _rulings(spark: SparkSession, at: str) -> DataFrame:
    """Where scholars' names stand: rows with equal unit, book, page and grade state one ruling."""
    g = _read(spark, at, "grading", "muhaddith", "unit_id", "book", "page", "grade")
    return g.select(F.lit("muhaddith").alias("field"), F.col("muhaddith").alias("name"), F.xxhash64("unit_id", "book", F.coalesce("page", F.lit("")), "grade").alias("key"))


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    from riwaya.llm.names import variant_pairs
    from riwaya.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return variant_pairs(_names(spark, at), _rulings(spark, at))


def p1_entities(spark: SparkSession, at: str) -> DataFrame:
    from riwaya.llm.names import resolve
    from riwaya.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return resolve(_names(spark, at), _rulings(spark, at))


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    from riwaya.llm.grades import map_values
    from riwaya.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return map_values(_read(spark, at, "grading", "grade"), _read(spark, at, "grade_ref")).select("grade", "ref_id")


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    from riwaya.llm.nearby import near_pairs
    from riwaya.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return near_pairs(_read(spark, at, "unit", "id", "kind", "text_ar").filter("kind = 'hadith'"))


#: What makes two rulings the same.
RULING = {"unit_id": "exact", "book": "exact", "muhaddith": "bag", "page": "page", "grade": "sequence"}


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    from riwaya.llm.copies import hidden_copies
    from riwaya.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return hidden_copies(_read(spark, at, "grading", "id", *RULING), "id", RULING)


def p5_rulings(spark: SparkSession, at: str) -> DataFrame:
    from riwaya.llm.copies import collapse
    from riwaya.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return collapse(_read(spark, at, "grading", "id", *RULING), "id", RULING)


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    from riwaya.llm.forms import lookalike_pairs
    from riwaya.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return lookalike_pairs(_read(spark, at, "unit", "id", "text_ar", "text_norm"), "id", ["text_ar", "text_norm"])


def p3_forms(spark: SparkSession, at: str) -> DataFrame:
    from riwaya.llm.forms import consistent_form

    return consistent_form(_read(spark, at, "unit", "id", "text_ar", "text_norm"), ["text_ar", "text_norm"]).select("id", "text_ar_form", "text_norm_form")


def _records(spark: SparkSession, at: str) -> DataFrame:
    """Units and links under one number: twice the id, plus one for a link."""
    unit = _read(spark, at, "unit").select((F.col("id") * 2).alias("rec"), F.col("text_ar").alias("text"))
    link = _read(spark, at, "link").select((F.col("id") * 2 + 1).alias("rec"), F.col("evidence_ar").alias("text"))
    return unit.unionByName(link)


def _named(df: DataFrame) -> DataFrame:
    rec = F.when(F.pmod("rec", F.lit(2)) == 0, F.lit("unit")).otherwise(F.lit("link"))
    return df.select(rec.alias("rec"), F.floor(F.col("rec") / 2).cast("long").alias("rec_id"), *[c for c in df.columns if c != "rec"])


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    from riwaya.llm.spans import factors
    from riwaya.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return _named(factors(_records(spark, at)).select("rec").distinct())


def p6_shares(spark: SparkSession, at: str) -> DataFrame:
    from riwaya.llm.spans import shared_text
    from riwaya.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return _named(shared_text(_records(spark, at), every=True))


def p7_ids(spark: SparkSession, at: str) -> DataFrame:
    from riwaya.llm.tokens import encode_texts

    return encode_texts(_read(spark, at, "documents", "doc_id", "text")).select("doc_id", "ids")


def p8_containers(spark: SparkSession, at: str) -> DataFrame:
    from riwaya.llm.packing import pack
    from riwaya.llm.tokens import count_tokens
    from riwaya.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return pack(count_tokens(_read(spark, at, "documents", "doc_id", "source", "text")))


def _repaired(spark: SparkSession, at: str) -> DataFrame:
    from riwaya.llm.mojibake import repair
    from riwaya.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return repair(_read(spark, at, "documents", "doc_id", "text", "source"))


def p9_found(spark: SparkSession, at: str) -> DataFrame:
    return _repaired(spark, at).filter("found").select(F.col("id").alias("doc_id"))


def p9_restored(spark: SparkSession, at: str) -> DataFrame:
    return _repaired(spark, at).filter("found").select(F.col("id").alias("doc_id"), "whole", "restored")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_forms": p3_forms,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_rulings": p5_rulings,
    "p6_found": p6_found,
    "p6_shares": p6_shares,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

#: Problem 4's form of a text in SQL: what isn't seen and look-alikes go before the project's matching form.
_PLAIN = sql_normalize("translate(regexp_replace(text_ar, '[\u00AD\u061C\u2060-\u206F]', '', 'g'), 'ھ', 'ه')")
_CLEAN = "regexp_replace(lower({}), '[\\p{{P}}\\p{{Z}}\\s$+<=>^`|~]+', ' ', 'g')"

#: The rows of the same ruling in SQL: f (id, keep_id, copies).
_SAME_RULING = f"""WITH g AS (SELECT id, unit_id, book, list_sort(list_filter(string_split({_CLEAN.format("muhaddith")}, ' '), lambda x: x <> '')) AS m, {_CLEAN.format("page")} AS p, replace({_CLEAN.format("grade")}, ' ', '') AS r FROM grading),
k AS (SELECT id, unit_id, book, m, r, CASE WHEN regexp_matches(p, '\\p{{L}}') THEN list_sort(list_transform(regexp_extract_all(p, '\\p{{L}}+ *\\p{{N}}*'), lambda x: replace(x, ' ', ''))) ELSE regexp_extract_all(p, '\\p{{N}}+') END AS p FROM g),
f AS (SELECT id, min(id) OVER w AS keep_id, count(*) OVER w AS copies FROM k WINDOW w AS (PARTITION BY unit_id, book, m, p, r))"""

SQL: dict[str, str] = {
    "p4_found": f"""WITH d AS (SELECT id, string_split({_PLAIN}, ' ') AS w FROM unit WHERE kind = 'hadith'),
e AS (SELECT id, x, row_number() OVER (PARTITION BY id, x) AS n FROM (SELECT id, unnest(w) AS x FROM d) WHERE x <> ''), s AS (SELECT id, count(*) AS k FROM e GROUP BY 1),
c AS (SELECT a.id AS unit_a, b.id AS unit_b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.n = b.n AND a.id < b.id GROUP BY 1, 2)
SELECT unit_a, unit_b FROM c JOIN s x ON x.id = unit_a JOIN s y ON y.id = unit_b WHERE common * 10 >= (x.k + y.k - common) * 7""",
    "p5_found": f"""{_SAME_RULING}
SELECT keep_id, id AS copy_id FROM f WHERE id <> keep_id""",
    "p5_rulings": f"""{_SAME_RULING}
SELECT g.id, g.unit_id, g.book, g.muhaddith, g.page, g.grade, copies FROM f JOIN grading g USING (id) WHERE g.id = keep_id""",
    "p6_found": """WITH r AS (SELECT 'unit' AS rec, id AS rec_id, text_ar AS t FROM unit UNION ALL SELECT 'link', id, evidence_ar FROM link),
w AS (SELECT rec, rec_id, substr(t, i, 60) AS s FROM r, range(1, length(t) - 58) q(i)), g AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT (rec, rec_id)) > 1)
SELECT DISTINCT rec, rec_id FROM w SEMI JOIN g USING (s)""",
    "p6_shares": """WITH r AS (SELECT 'unit' AS rec, id AS rec_id, coalesce(text_ar, '') AS t FROM unit UNION ALL SELECT 'link', id, coalesce(evidence_ar, '') FROM link),
w AS (SELECT rec, rec_id, i, substr(t, i, 60) AS s FROM r, range(1, length(t) - 58) q(i)), g AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT (rec, rec_id)) > 1),
c AS (SELECT rec, rec_id, least(60, i - lag(i, 1, -99) OVER (PARTITION BY rec, rec_id ORDER BY i)) AS fresh FROM w SEMI JOIN g USING (s)),
n AS (SELECT rec, rec_id, sum(fresh) AS shared FROM c GROUP BY 1, 2)
SELECT rec, rec_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(coalesce(shared, 0) AS BIGINT) AS shared_chars, CASE WHEN length(t) > 0 THEN coalesce(shared, 0) / length(t) ELSE 0.0 END AS share
FROM r LEFT JOIN n USING (rec, rec_id)""",
}
