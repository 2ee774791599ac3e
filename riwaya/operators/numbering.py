"""Numbering rows of large groups in order, without bringing a group into one task.

The rows of a group are cut into stretches by columns that come first in their
order, ending with a number that is cut into ranges. Rows are numbered within
their stretch; what stands before a stretch is a running sum over the sizes of
stretches, one small row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in a stretch.
WIDTH = 10_000


def stretch_of(number: Column, width: int = WIDTH) -> Column:
    """The range that a number falls into; null for null."""
    return F.floor(number / width)


def numbered(rows: DataFrame, name: str, group: list[str], coarse: list[Column], fine: list[Column]) -> DataFrame:
    """``rows`` with the place ``name`` (from 1) of each in its group, by ``coarse`` and then ``fine``, ascending, nulls first.

    ``coarse`` makes the stretches: rows with equal values are one. ``rows`` must
    give the same rows each time it is computed.
    """
    keys = [f"_s{k}" for k in range(len(coarse))]
    cut = rows.withColumns(dict(zip(keys, coarse, strict=True)))
    whole = [*group, *keys]
    size = cut.groupBy(*whole).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*[F.asc_nulls_first(k) for k in keys])
    before = size.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = cut.withColumn("_i", F.row_number().over(Window.partitionBy(*whole).orderBy(*fine)))
    mine, theirs = inside.alias("mine"), before.alias("theirs")
    equal = F.lit(True)
    for k in whole:
        equal = equal & F.col(f"mine.{k}").eqNullSafe(F.col(f"theirs.{k}"))
    joined = mine.join(theirs, equal)
    return joined.select(*[F.col(f"mine.{c}") for c in rows.columns], (F.col("theirs._before") + F.col("mine._i")).cast("int").alias(name))


def beside(rows: DataFrame, group: str, order: str, value: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``_prev`` and ``_next``: the value of the row before and behind in the group, by a number that no two rows share."""
    cut = rows.withColumn("_s", stretch_of(F.col(order), width))
    at = F.struct(order, value)
    ends = cut.groupBy(group, "_s").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    line = Window.partitionBy(group).orderBy("_s")
    ends = ends.select(group, "_s", F.lag("last").over(line).alias("_last"), F.lead("first").over(line).alias("_first"))
    inside = Window.partitionBy(group, "_s").orderBy(order)
    own = cut.withColumns({"_before": F.lag(at).over(inside), "_behind": F.lead(at).over(inside)})
    mine, theirs = own.alias("mine"), ends.alias("theirs")
    joined = mine.join(theirs, F.col(f"mine.{group}").eqNullSafe(F.col(f"theirs.{group}")) & F.col("mine._s").eqNullSafe(F.col("theirs._s")))
    prev, follow = F.coalesce("mine._before", "theirs._last"), F.coalesce("mine._behind", "theirs._first")
    return joined.select(*[F.col(f"mine.{c}") for c in rows.columns], prev.getField(value).alias("_prev"), follow.getField(value).alias("_next"))
