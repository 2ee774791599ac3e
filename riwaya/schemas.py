"""Schemas of the persistent tables and of the external JSON shapes."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _table(spec: str) -> T.StructType:
    """A schema from "name type [not null], ..."; made here because Spark's own parser needs a session."""
    fields = (x.split(maxsplit=2) for x in spec.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind], not rest) for name, kind, *rest in fields])


SOURCE = _table("id long not null, key string not null, name_ar string not null, homepage string not null, pinned_ref string not null, fetched_at timestamp")
UNIT = _table(
    "id long not null, source_id long not null, kind string not null, ref_key string not null, surah int, ayah int, book_slug string, hadith_no int,"
     " edition string, text_ar string not null, text_norm string not null, locus_ar string not null, url string not null"
)
LINK = _table(
    "id long not null, from_unit long not null, to_unit long not null, relation string not null, method string not null, evidence_ar string not null,"
    " ambiguous boolean not null, shared_with array<string>, url string"
)
GRADING = _table(
    "id long not null, unit_id long not null, source_id long not null, muhaddith string not null, book string not null, page string,"
    " grade string not null, explanation string, rawi string, url string not null"
)
TABLES = {"source": SOURCE, "unit": UNIT, "link": LINK, "grading": GRADING}

#: Keys that the stores keep unique.
KEYS = {
    "source": ["key"],
    "unit": ["source_id", "kind", "ref_key", "edition"],
    "link": ["from_unit", "to_unit", "relation", "method"],
    "grading": ["unit_id", "muhaddith", "book", "page", "grade"],
}
KINDS = ("ayah", "tafsir", "hadith")
METHODS = ("shared_key", "quotation", "naming", "manual")

QURAN_JSON = "quran array<struct<chapter int, verse int, text string>>"
HADITH_BOOK_JSON = "hadiths array<struct<idInBook int, arabic string>>"
CHAPTER = "struct<chapter int, arabicname string, englishname string, name string, revelation string, verses array<string>>"
RULING = "struct<mohdith string, book string, numberOrPage string, grade string, explainGrade string, rawi string, hadith string>"
TITLES_JSON = "map<string, array<struct<name string, attested_ar string, source_ar string>>>"


def create_tables(spark: SparkSession, database: str) -> None:
    """Create the tables that aren't there yet; units are partitioned by kind."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in TABLES.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL") for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet" + (" PARTITIONED BY (kind)" if name == "unit" else ""))
