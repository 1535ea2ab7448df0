"""Quantiles and distinct counts from sketches that merge (AGG3, AGG5, AGG8,
AGG10, AGG12, AGG15).

A sketch of each cell (country x medium) is kept; a roll-up to countries,
mediums or anything coarser merges sketches and never reads the facts again.
No task holds a group's values: a KLL sketch of parameter k has about 3 k
values whatever the group's size, a theta sketch at most 2^lg hashes.

Bounds (published for these sketches):

* KLL: the rank of a returned quantile is off by at most ``2.296 / k^0.9723`` of
  the group with 99 % confidence; ``kll_error`` gives twice that, beyond
  which one answer in about 10^6 falls.  Groups of up to k values are exact.
* Theta: the standard error of a union of n is n / sqrt(2^lg - 1); of a difference or
  intersection it is of the union's size.  ``theta_error`` gives five of them.
  Up to 2^lg distinct values the counts are exact.  The hashes have a fixed seed, so equal
  inputs give equal counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KLL_K = 800
THETA_LG = 12


# --- quantiles -----------------------------------------------------------------

def kll_error(k: int = KLL_K) -> float:
    """Twice the rank error of 99 % confidence, as a share of the group."""
    return 2 * 2.296 / k ** 0.9723


def _usable(value: str) -> Column:
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v), v)  # a null stays null


def value_sketches(df: DataFrame, value: str, by: Sequence[str], k: int = KLL_K) -> DataFrame:
    """(``by``..., n, sketch): a KLL sketch of each group's values that are
    neither null nor NaN, n of them."""
    v = _usable(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"),
                               F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merge_value_sketches(sketches: DataFrame, by: Sequence[str], k: int = KLL_K) -> DataFrame:
    """The same for coarser groups, from the sketches alone."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double(
        "sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(``by``..., n, q): an array with a value for each of ``probs``; null for a
    group without values."""
    grid = F.array(*[F.lit(float(p)) for p in probs])
    q = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", grid))
    return sketches.select(*by, "n", q.alias("q"))


def quantiles_within_bound(df: DataFrame, value: str, by: Sequence[str], quantiles: DataFrame,
                           probs: Sequence[float], k: int = KLL_K) -> DataFrame:
    """(``by``..., within_bound): whether the true ranks of all quantiles of a
    group are within ``kll_error`` of what was asked.  One pass over the
    values, with partial sums; the sketches are not asked about themselves."""
    v, q = _usable(value), F.col("q")
    counts = df.filter(v.isNotNull()).join(quantiles, list(by)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(v < q[i]).alias(f"_lt{i}") for i in range(len(probs))],
        *[F.count_if(v <= q[i]).alias(f"_le{i}") for i in range(len(probs))])
    fits = F.lit(True)
    for i, p in enumerate(probs):
        slack = kll_error(k) * F.col("_n")
        fits = fits & (F.col(f"_lt{i}") - slack <= p * F.col("_n")) & (
            p * F.col("_n") <= F.col(f"_le{i}") + slack)
    return counts.select(*by, fits.alias("within_bound"))


# --- distinct counts -----------------------------------------------------------

def theta_error(union: Column, lg: int = THETA_LG) -> Column:
    """Five standard errors of a count, difference or intersection of sets whose
    union has that many values; 0 while the sketch is exact."""
    return F.when(union <= 2 ** lg, F.lit(0.0)).otherwise(5 * union / (2 ** lg - 1) ** 0.5)


def key_sketches(df: DataFrame, keys: dict[str, Column], by: Sequence[str],
                 lg: int = THETA_LG) -> DataFrame:
    """(``by``..., a theta sketch for each entry of ``keys``); null keys do not
    count, so ``F.when(condition, key)`` sketches a subset."""
    return df.groupBy(*by).agg(*[F.theta_sketch_agg(c, F.lit(lg)).alias(name)
                                 for name, c in keys.items()])


def merge_key_sketches(sketches: DataFrame, names: Sequence[str], by: Sequence[str],
                       lg: int = THETA_LG) -> DataFrame:
    """Unions of the sketches for coarser groups."""
    return sketches.groupBy(*by).agg(*[F.theta_union_agg(n, F.lit(lg)).alias(n) for n in names])


def estimate(sketch: Column) -> Column:
    return F.theta_sketch_estimate(sketch).cast("long")


def agrees(exact: Column, sketch: Column, union: Column, lg: int = THETA_LG) -> Column:
    """Whether a sketched count is within its bound of the exact one; ``union``
    is the exact size of the union of the sets involved."""
    return F.abs(exact - estimate(sketch)) <= theta_error(union, lg)
