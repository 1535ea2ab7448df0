"""Ranks, shares, top-n and sorts (WIN1-WIN12, TOP1-TOP5, SRT1-2, SMP1).

Scale rules used throughout:

* Totals over a whole table are scalar subqueries (``DataFrame.scalar()``):
  Spark runs a partial + final aggregate and substitutes one value — no join,
  no single-partition window.
* Windows with ``partitionBy`` run on aggregated (mart-grain) tables, where a
  partition is one country or one medium.
* ntile and percent_rank are taken over ranges (``global_ranks``); the
  unpartitioned windows that are left (running share, row ids) see only aggregated
  tables bounded by mediums, channels or path lengths.  ``top_n`` finds the
  n-th value with ``orderBy().limit()`` (TakeOrderedAndProject: per-partition
  top-n, then a merge of n rows per partition) and filters on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import col, ratio
from tidemark.operators.global_ranks import ranked


def _desc(c) -> Column:
    return col(c).desc_nulls_last()


def _asc(c) -> Column:
    return col(c).asc_nulls_last()


# --- shares -------------------------------------------------------------------

def share_of_total(df: DataFrame, value: str, out: str | None = None) -> DataFrame:
    """WIN6: ``value / sum(value)`` over the whole table (scalar subquery)."""
    total = df.select(F.sum(value)).scalar()
    return df.withColumn(out or f"{value}_share", ratio(F.col(value), total))


def share_within(df: DataFrame, value: str, by: str | Sequence[str],
                 out: str | None = None) -> DataFrame:
    """WIN7: ``value / sum(value)`` within a group (window on an aggregated table)."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by))
    return df.withColumn(out or f"{value}_share", ratio(F.col(value), F.sum(value).over(w)))


def group_total(df: DataFrame, value: str, by: str | Sequence[str], out: str) -> DataFrame:
    """WIN8: group total repeated on every row."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by))
    return df.withColumn(out, F.sum(value).over(w))


def running_total(df: DataFrame, value: str, order: str | Sequence[str], out: str) -> DataFrame:
    """WIN9: running sum along ``order`` (apply to grouped, small tables)."""
    order = [order] if isinstance(order, str) else list(order)
    w = Window.orderBy(*[_asc(o) for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


# --- ranks --------------------------------------------------------------------

def dense_rank_within(df: DataFrame, metrics: Sequence[str], by: str | Sequence[str],
                      suffix: str = "_rank") -> DataFrame:
    """WIN1-WIN3: descending dense rank of each metric within a group."""
    part = [by] if isinstance(by, str) else list(by)
    return df.withColumns({
        f"{m}{suffix}": F.dense_rank().over(
            Window.partitionBy(*part).orderBy(_desc(m))).cast("long")
        for m in metrics
    })


def ntile_of(df: DataFrame, value: str, n: int, tie: str, out: str) -> DataFrame:
    """WIN4: ``ntile(value, n)`` ascending with a unique tie-breaker, over ranges
    (``global_ranks``).

    Bucket sizes follow the SQL standard: larger buckets come first."""
    ranks = ranked(df, value, [tie], ntile=n)
    return ranks.select(*df.columns, F.col("ntile").alias(out))


def percent_rank_desc(df: DataFrame, value: str, out: str, tie: Sequence[str] = ()) -> DataFrame:
    """WIN5: ``percent_rank(desc(value))`` over the table, over ranges; ``tie``
    spreads equal values over them."""
    ranks = ranked(df, value, list(tie), desc=True)
    return ranks.select(*df.columns, F.col("percent_rank").alias(out))


def row_number_by(df: DataFrame, order: Sequence, out: str = "row_id") -> DataFrame:
    """WIN11: 1-based row id along a named order."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))


# --- top-n --------------------------------------------------------------------

def top_n(df: DataFrame, value: str, n: int, with_ties: bool = True,
          tie: str | Sequence[str] | None = None) -> DataFrame:
    """TOP1: the ``n`` rows with the largest ``value``; ties at the cut kept.

    Plan: ``orderBy(desc).limit(n)`` (TakeOrderedAndProject, n rows per task)
    gives the n-th largest value as a scalar subquery, then a plain filter —
    one pass, no global sort or window over the input.
    """
    if not with_ties:
        ties = [tie] if isinstance(tie, str) else list(tie or [])
        return df.orderBy(_desc(value), *[_asc(t) for t in ties]).limit(n)
    cut = (df.filter(F.col(value).isNotNull()).orderBy(_desc(value)).limit(n)
           .select(F.min(value)).scalar())
    return df.filter(F.col(value) >= cut)


def top_n_per_group(df: DataFrame, value: str, n: int, by: str | Sequence[str],
                    with_ties: bool = True, tie: str | Sequence[str] | None = None
                    ) -> DataFrame:
    """TOP2/TOP3: ``slice_max`` per group; ``rank`` keeps ties, ``row_number``
    with a named tie-breaker does not."""
    part = [by] if isinstance(by, str) else list(by)
    ties = [tie] if isinstance(tie, str) else list(tie or [])
    order = [_desc(value)] + [_asc(t) for t in ties]
    fn = F.rank() if with_ties else F.row_number()
    return (df.withColumn("_r", fn.over(Window.partitionBy(*part).orderBy(*order)))
            .filter(F.col("_r") <= n).drop("_r"))


def head_sorted(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """TOP4/TOP5/SRT1: sort then first ``n`` rows (reverse the order for tail)."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, by: Sequence, seed: int = 42) -> DataFrame:
    """SMP1: ``n`` random rows (the limit is the feature): the first by the md5
    of the seed and the columns ``by``.  The sample depends on the rows and the
    seed only, not on their layout; rows that agree in ``by`` come together."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(c).cast("string"), F.lit(""))
                                               for c in by])
    return df.orderBy(F.md5(text), *by).limit(n)


def rank_one_tally(df: DataFrame, rank_col: str, key: str) -> DataFrame:
    """WIN10: rows ranked 1, counted by ``key``, sorted by count."""
    return (df.filter(F.col(rank_col) == 1).groupBy(key).count()
            .withColumnRenamed("count", "n").orderBy(F.desc("n"), key))
