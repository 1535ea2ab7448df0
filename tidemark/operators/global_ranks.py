"""Ranks along a whole table without a window in one task (WIN4, WIN5, WIN11,
FCT3).

The rows are laid out in ranges of (value, tie) and written once
(``stats.ordered_ranges``); a range numbers its own rows and the ranges' sizes are
prefixed.  What a range cannot see alone is a group of equal values that began
in an earlier one.  Only the first and the last value of a range can be such a
group, so a table with two rows a range has the place where each of them begins,
and the number of distinct values is corrected by those that go on across a border.  A
value in 90 % of the rows spreads over as many ranges as its rows need, since ``tie``
is part of the layout.

Order: ascending or descending with nulls last, as in the windows that these
replace.  Nulls are equal to each other.  The tables of borders are joined by
range, two rows each; their prefix windows see one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir


def _ordered(c: str, desc: bool) -> Column:
    return F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last()


def ranked(df: DataFrame, value: str, tie: Sequence[str], desc: bool = False,
           ntile: int | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with ``row_number`` (by value and ``tie``), ``rank``,
    ``dense_rank``, ``percent_rank`` (null values included, as in SQL) and, for
    ``ntile`` buckets, ``ntile`` by row number (larger buckets first).  ``tie`` should
    make rows unique; rows that agree in it are numbered in any order.  Runs jobs."""
    ensure_checkpoint_dir(df.sparkSession)
    order = [_ordered(value, desc), *[_ordered(t, False) for t in tie]]
    laid = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    laid = laid.withColumn("_rid", F.spark_partition_id()).checkpoint(eager=True)
    here = Window.partitionBy("_rid").orderBy(*order)
    by_value = Window.partitionBy("_rid").orderBy(_ordered(value, desc))
    laid = (laid.withColumn("_row", F.row_number().over(here))
            .withColumn("_rank", F.rank().over(by_value))
            .withColumn("_dense", F.dense_rank().over(by_value)))
    # a range: its rows, its distinct values, its first and last value and where the last begins
    v = F.struct(F.col(value).alias("v"))
    ranges = laid.groupBy("_rid").agg(
        F.count(F.lit(1)).alias("n"), F.max("_dense").alias("d"),
        F.min_by(v, "_row").alias("first"), F.max_by(v, "_row").alias("last"),
        F.max("_rank").alias("last_rank"))
    along = Window.orderBy("_rid")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # goes on: the first value is the last one of the range before
    goes_on = F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(along)), F.lit(False))
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "goes_on", goes_on & (F.row_number().over(along) > 1))
    ranges = ranges.withColumn("dense_offset", F.coalesce(F.sum("d").over(before), F.lit(0))
                               - F.sum(F.col("goes_on").cast("long")).over(along))
    # the last value begins here unless the range has no other value and goes on
    begins = F.when(~(F.col("goes_on") & (F.col("d") == 1)), F.col("offset") + F.col("last_rank"))
    ranges = ranges.withColumn("carried", F.last(begins, ignorenulls=True).over(before))
    total = ranges.agg(F.sum("n")).scalar()
    borders = ranges.select("_rid", "offset", "dense_offset", "goes_on", "carried")
    out = laid.join(borders, "_rid")
    row = F.col("offset") + F.col("_row")
    rank = F.when(F.col("goes_on") & (F.col("_dense") == 1), F.col("carried")).otherwise(
        F.col("offset") + F.col("_rank"))
    columns = {"row_number": row.cast("long"), "rank": rank.cast("long"),
               "dense_rank": (F.col("dense_offset") + F.col("_dense")).cast("long"),
               "percent_rank": F.coalesce(F.try_divide((rank - 1).cast("double"), total - 1), F.lit(0.0))}
    if ntile:
        small, larger = F.floor(total / ntile), total % ntile
        in_larger = larger * (small + 1)
        columns["ntile"] = F.when(row <= in_larger, F.ceil(row / (small + 1))).otherwise(
            larger + F.ceil(F.try_divide(row - in_larger, small))).cast("long")
    return out.withColumns(columns).drop("_rid", "_row", "_rank", "_dense", "offset",
                                         "dense_offset", "goes_on", "carried")


def ordered_levels(df: DataFrame, f: str, key: Column, desc: bool = False,
                   partitions: int | None = None) -> DataFrame:
    """FCT3 for a factor with any number of levels: (``f``, ``key``,
    ``<f>_order``), the levels numbered by an aggregate, ties by name."""
    levels = df.groupBy(f).agg(key.alias("key"))
    return ranked(levels, "key", [f], desc, partitions=partitions).select(
        f, "key", F.col("row_number").alias(f"{f}_order"))
