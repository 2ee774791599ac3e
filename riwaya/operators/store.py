"""Writes: upserts, inserts that ignore what is there, checks, and publishing as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riwaya.schemas import KEYS, KINDS, METHODS


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; nulls of a key are equal."""
    rank = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r")


def upsert_sources(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row for each key with the last values and the first id."""
    values = [c for c in rows.columns if c not in ("id", "key", *order)]
    newest = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy("key").agg(F.min("id").alias("id"), newest.alias("x")).select("id", "key", "x.*")


#: How versions are written: texts and ids repeat in links, so their dictionaries may be large.
WRITTEN = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}
UPDATED = ("text_ar", "text_norm", "locus_ar", "url")


def upsert_units(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row for each unit key: text, locus and url of the last row, everything else of the first.

    A null edition counts as ''.
    """
    rows = rows.withColumn("edition", F.coalesce("edition", F.lit("")))
    key = KEYS["unit"]
    kept = [c for c in rows.columns if c not in (*key, *UPDATED)]
    at = F.struct(*order)
    agg = rows.groupBy(*key).agg(F.min_by(F.struct(*kept), at).alias("old"), F.max_by(F.struct(*UPDATED), at).alias("new"))
    return agg.select(*key, "old.*", "new.*").select(*rows.columns)


def insert_or_ignore(new: DataFrame, key: list[str], order: list[str], old: DataFrame | None = None) -> DataFrame:
    """``old`` and the first new row of each key that isn't there; a key with a null never conflicts."""
    whole = None
    for c in key:
        whole = F.col(c).isNotNull() if whole is None else whole & F.col(c).isNotNull()
    loose = new.filter(~whole)
    rank = Window.partitionBy(*key).orderBy(*order)
    first = new.filter(whole).withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r")
    if old is None:
        return first.unionByName(loose)
    return old.unionByName(first.join(old.select(*key), key, "left_anti").select(*new.columns)).unionByName(loose)


def insert_links(new: DataFrame, order: list[str], old: DataFrame | None = None) -> DataFrame:
    return insert_or_ignore(new, KEYS["link"], order, old)


def insert_gradings(new: DataFrame, order: list[str], old: DataFrame | None = None) -> DataFrame:
    return insert_or_ignore(new, KEYS["grading"], order, old)


def _bad(df: DataFrame, kind: str) -> Column:
    required = {"unit": ["kind", "ref_key", "text_ar", "text_norm", "locus_ar", "url"], "link": ["relation", "method", "evidence_ar"], "grading": ["muhaddith", "book", "grade", "url"]}[kind]
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    if kind == "unit":
        bad = bad | ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    if kind == "link":
        bad = bad | ~F.coalesce(F.col("method").isin(*METHODS), F.lit(False))
    return bad


def check(df: DataFrame, kind: str, parents: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) rows by the table's rules; ``parents`` maps a column to the (id) it must be found in."""
    flagged = df.withColumn("_bad", _bad(df, kind))
    for column, ids in (parents or {}).items():
        known = ids.select(F.col("id").alias("_id")).distinct().withColumn("_known", F.lit(True))
        flagged = flagged.join(known, F.col(column) == F.col("_id"), "left").withColumn("_bad", F.col("_bad") | F.col("_known").isNull()).drop("_id", "_known")
    return flagged.filter("not _bad").drop("_bad"), flagged.filter("_bad").drop("_bad")


def _files(spark: SparkSession, path: str):
    """The file system of a path and a maker of paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _rename(files, a, b) -> None:
    if not files.rename(a, b):
        raise OSError(f"{a} can't be renamed to {b}")


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write beside the table, then put the new one in the old one's place; the old one stays if that fails.

    A plain path can't change its content at once: for a moment between two
    renames no table is there. Where readers mustn't notice, use
    :func:`publish_version`.
    """
    files, make = _files(df.sparkSession, path)
    new, now, old = make(path + "__new"), make(path), make(path + "__old")
    if files.exists(old):  # an earlier run ended between the renames, or before it could clean up
        if files.exists(now):
            files.delete(old, True)
        else:
            _rename(files, old, now)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path + "__new")
    if files.exists(now):
        _rename(files, now, old)
    try:
        _rename(files, new, now)
    except Exception:
        if files.exists(old) and not files.exists(now):
            _rename(files, old, now)
        raise
    files.delete(old, True)


def _versions(files, make, path: str) -> list[int]:
    """Versions that are complete: the file that ends a write is there."""
    if not files.exists(make(path)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(make(path))]
    at = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(k for k in at if files.exists(make(f"{path}/version={k}/_SUCCESS")))


def publish_version(df: DataFrame, path: str, keep: int = 2, partition_by: list[str] | None = None) -> int:
    """Write the table as a new version under ``path``, and drop all but the last ``keep``.

    A version counts from the moment its last file is written, so a reader sees
    the old or the new table, never a part, and a failed write changes nothing.
    """
    files, make = _files(df.sparkSession, path)
    n = max(_versions(files, make, path), default=0) + 1
    writer = df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").options(**WRITTEN)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/version={n}")
    for k in _versions(files, make, path)[:-keep]:
        files.delete(make(f"{path}/version={k}"), True)
    return n


def read_published(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version under ``path``; None if there is none."""
    files, make = _files(spark, path)
    n = max(_versions(files, make, path), default=None)
    return None if n is None else spark.read.parquet(f"{path}/version={n}")


def report_unavailable(failures: DataFrame) -> DataFrame:
    """(place, source): sources that failed, by the text before the first colon, in the order first seen. ``failures`` is (seq, message)."""
    named = failures.withColumn("source", F.split("message", ":")[0])
    first = named.groupBy("source").agg(F.min("seq").alias("seq"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("seq"))).select("place", "source")
