"""Categorical operators (FCT1-FCT5) without a factor type.

A factor becomes a string column plus, when the level order matters, an
explicit ``<name>_order`` integer.  Lumping computes the kept levels with one
aggregate over the (small) level set and joins them back; Spark's AQE turns
that join into a broadcast at runtime because the level table is tiny.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "Other"


def kept_levels(df: DataFrame, f: str, n: int, w: str | None = None,
                with_ties: bool = True) -> DataFrame:
    """Per level of ``f``: ``_keep`` is true when its total weight (row count
    if ``w`` is None) ranks in the top ``n``, or when only one level would be
    lumped (such a level is kept, the usual ``fct_lump`` rule).
    ``with_ties=True`` keeps every level tied at the cut; otherwise ties are
    broken by level name.  The windows run on the level table (one row per
    category)."""
    weight = F.sum(w) if w else F.count(F.lit(1))
    totals = df.groupBy(f).agg(weight.alias("_w"))
    order = [F.col("_w").desc_nulls_last()]
    if with_ties:
        r = F.rank().over(Window.orderBy(*order))
    else:
        r = F.row_number().over(Window.orderBy(*order, F.col(f).asc_nulls_last()))
    ranked = totals.withColumn("_r", r)
    over = F.sum((F.col("_r") > n).cast("int")).over(Window.partitionBy())
    return ranked.select(f, ((over <= 1) | (F.col("_r") <= n)).alias("_keep"))


def lump(df: DataFrame, f: str, n: int, w: str | None = None, out: str | None = None,
         other: str = OTHER, with_ties: bool = True) -> DataFrame:
    """FCT1/FCT2: keep the ``n`` heaviest levels, the rest become ``other``.

    A lump that would contain a single level is not made (that level is kept).
    The kept-level table is joined back; AQE broadcasts it (one row per level).
    """
    out = out or f
    joined = df.join(kept_levels(df, f, n, w, with_ties), f, "left")
    lumped = (F.when(F.col("_keep") | F.col(f).isNull(), F.col(f)).otherwise(F.lit(other)))
    return joined.withColumn(out, lumped).drop("_keep")


def level_order(df: DataFrame, f: str, x: str, fn: str = "median",
                out: str | None = None, desc: bool = False) -> DataFrame:
    """FCT3: order the levels of ``f`` by ``fn(x)`` (median, sum, mean, max, min);
    ties broken by level name.  Adds ``<f>_order`` (1 = first level)."""
    aggs = {"median": F.median, "sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}
    by = df.groupBy(f).agg(aggs[fn](x).alias("_key"))
    k = F.col("_key").desc_nulls_last() if desc else F.col("_key").asc_nulls_last()
    by = by.withColumn(out or f"{f}_order",
                       F.row_number().over(Window.orderBy(k, F.col(f).asc_nulls_last()))
                       .cast("long")).drop("_key")
    return df.join(by, f, "left")


def recode(c: Column | str, mapping: dict, default=None, keep_unmatched: bool = False
           ) -> Column:
    """FCT5: ``case_match``; unmatched -> ``default`` (NULL) or the input."""
    c = F.col(c) if isinstance(c, str) else c
    expr = None
    for src, dst in mapping.items():
        cond = c.isin(list(src)) if isinstance(src, tuple) else (c == src)
        expr = F.when(cond, F.lit(dst)) if expr is None else expr.when(cond, F.lit(dst))
    fallback = c if keep_unmatched else F.lit(default)
    return expr.otherwise(fallback) if expr is not None else fallback


def bool_level_order(c: Column | str, true_first: bool = True) -> Column:
    """FCT4: explicit order of a boolean level."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c, F.lit(1 if true_first else 2)).otherwise(F.lit(2 if true_first else 1))
