"""Stratified bootstrap (MK21) as a generated Spark plan.

Nothing is materialised per resample.  Draws are generated lazily with
``explode(sequence(...))``, indexed by an integer hash (identical in SQL), joined
to the numbered rows and averaged per (resample, stratum):

    strata sizes --explode b, slice--> (stratum, b, slice)   SLICE draws each
                 --repartition--> spread the slices over tasks
                 --explode i--> (stratum, b, i, idx)         one row per draw
                 --join (stratum, idx)--> value              rows: the sample
                 --groupBy(b, stratum): sum, count--         partial in-task

No task expands more than its share of the slices, whatever the size of a
stratum.  The join has no hint: the numbered sample is a written table, so
Spark knows its bytes and broadcasts it or shuffles by (stratum, row).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import with_resample_index
from tidemark.operators.stats import ordered_prefix
from tidemark.session import ensure_checkpoint_dir

SLICE = 10_000


def number_rows(df: DataFrame, stratum: str, order: Sequence[str]) -> DataFrame:
    """0-based row number within each stratum along a unique ``order``: a running
    count over ranges of the rows, so that no task holds a stratum."""
    key = F.struct(*order)
    numbered = ordered_prefix(df.withColumns({"_key": key, "_one": F.lit(1)}), "_key", "_one",
                              [stratum])
    return numbered.withColumn("_row", F.col("cum_start").cast("long")).drop(
        "_key", "_one", "cum_start", "cum_end")


def stratum_sizes(rows: DataFrame, stratum: str) -> DataFrame:
    """(stratum, n_s, s) with s = 1-based stratum number by name."""
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.withColumn(
        "_s", F.row_number().over(Window.orderBy(F.col(stratum).asc_nulls_last())).cast("long"))


def bootstrap_means(df: DataFrame, stratum: str, value: str, order: Sequence[str],
                    resamples: int = 10_000, seed: int = 0,
                    partitions: int | None = None) -> DataFrame:
    """Mean of ``value`` per (resample ``boot_id``, stratum) over ``resamples``
    stratified resamples drawn with replacement (each stratum keeps its size).

    ``order`` must make the row numbering within a stratum unique so the draw
    is reproducible.  ``partitions``: tasks of the draws (by default Spark's
    shuffle partitions).  Runs jobs when called (the numbering)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/sample-{uuid.uuid4().hex}"
    numbered = number_rows(df.select(stratum, value, *order), stratum, order)
    numbered.select(stratum, "_row", value).write.parquet(path)
    rows = spark.read.schema(numbered.select(stratum, "_row", value).schema).parquet(path)
    sizes = stratum_sizes(rows, stratum)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = (sizes.select(stratum, "_n", "_s",
                           F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("boot_id"))
              .withColumn("_slice", F.explode(F.sequence(
                  F.lit(0), F.floor((F.col("_n") - 1) / SLICE))))
              .repartition(parts, "boot_id", "_slice"))
    draws = slices.withColumn("_i", F.explode(F.sequence(
        F.col("_slice") * SLICE, F.least(F.col("_n"), (F.col("_slice") + 1) * SLICE) - 1)))
    draws = with_resample_index(draws, "boot_id", "_i", "_s", "_n", seed=seed)
    return (draws.select("boot_id", stratum, "_row").join(rows, [stratum, "_row"])
            .groupBy("boot_id", stratum).agg(F.avg(value).alias(f"mean_{value}")))


def bootstrap_percentiles(means: DataFrame, stratum: str, value: str,
                          probs: Sequence[float] = (0.05, 0.5, 0.95),
                          prefix: str = "boot_mean_") -> DataFrame:
    """Percentiles of the resample means per stratum, one column per prob
    (``boot_mean_05`` ...)."""
    arr = F.array(*[F.lit(float(p)) for p in probs])
    q = means.groupBy(stratum).agg(F.percentile(value, arr).alias("_q"))
    return q.select(stratum, *[
        F.col("_q")[k].alias(f"{prefix}{int(round(p * 100)):02d}")
        for k, p in enumerate(probs)])


def replicates_not_greater(means: DataFrame, stratum: str, value: str, first: str,
                           second: str) -> DataFrame:
    """Share of the resamples in which the mean of ``first`` is not above that of
    ``second`` (the bootstrap's own one-sided test)."""
    pick = lambda g: F.max(F.when(F.col(stratum) == g, F.col(value)))
    pairs = (means.filter(F.col(stratum).isin(first, second)).groupBy("boot_id")
             .agg((pick(first) - pick(second)).alias("d")).filter("d is not null"))
    return pairs.agg(F.count(F.lit(1)).alias("n"),
                     F.avg((F.col("d") <= 0).cast("double")).alias("share_not_greater"))
