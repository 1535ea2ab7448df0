"""Heavy levels of a factor with many levels (FCT1, FCT2, AGG6).

``kept_levels`` ranks a table with a row for every level.  Here each task keeps a
bounded number of Space-Saving counters in its mergeable form: for each kept
level a lower bound of its weight and an excess over the summary's ``floor``,
which no level outside the summary can pass.  Summaries merge by sums (bounds
add up, floors add up) and are cut to size again, ``FAN`` at a time, so no task sees
more than ``FAN`` summaries.  The levels that are left are the candidates; one
exact pass gives their weights.

If the n-th exact weight is above the floor, no other level can be among the n
heaviest, ties included: the lump is proven and equal to the exact one.  Where
the weights are too flat for that, the exact way is taken (``factors.kept_levels``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.factors import OTHER, kept_levels
from tidemark.session import ensure_checkpoint_dir

COUNTERS = 2048
FAN = 32
#: room for the rounding of sums of doubles, as a share of the floor
SLACK = 1e-9


def _summary(counters: int):
    """Batches of (level, weight) to a task's rows (part, level, low, excess,
    floor); the row of the floor alone has ``level_row`` false."""
    def cut(total: dict, floor: float) -> tuple[dict, float]:
        """The heaviest ``counters`` levels; the others' most joins the floor."""
        if len(total) <= counters:
            return total, floor
        order = sorted(total.items(), key=lambda kv: -kv[1][1])
        least = order[counters][1][1]
        return {k: (low, excess - least) for k, (low, excess) in order[:counters]
                if excess > least}, floor + least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str | None, tuple[float, float]] = {}
        floor = 0.0
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by("level").aggregate([("weight", "sum")])
            for level, w in zip(sums["level"].to_pylist(), sums["weight_sum"].to_pylist()):
                low, excess = total.get(level, (0.0, 0.0))
                total[level] = (low + (w or 0.0), excess + (w or 0.0))
            if len(total) > 4 * counters:
                total, floor = cut(total, floor)
        total, floor = cut(total, floor)
        part = TaskContext.get().partitionId()
        rows = [(part, True, k, low, excess, 0.0) for k, (low, excess) in total.items()]
        rows.append((part, False, None, 0.0, 0.0, floor))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.string(),
                                                         pa.float64(), pa.float64(), pa.float64()))],
            names=["part", "level_row", "level", "low", "excess", "floor"])

    return run


def _merged(summaries: DataFrame, counters: int) -> DataFrame:
    """Summaries of one part number as one, cut to size again."""
    sums = summaries.groupBy("part", "level_row", "level").agg(
        F.sum("low").alias("low"), F.sum("excess").alias("excess"), F.sum("floor").alias("floor"))
    order = Window.partitionBy("part", "level_row").orderBy(F.col("excess").desc(), "level")
    ranked = sums.withColumn("_r", F.row_number().over(order))
    cut = F.coalesce(F.max(F.when(F.col("level_row") & (F.col("_r") == counters + 1), F.col("excess")))
                     .over(Window.partitionBy("part")), F.lit(0.0))
    return (ranked.withColumn("_cut", cut)
            .filter(~F.col("level_row") | (F.col("_r") <= counters) & (F.col("excess") > F.col("_cut")))
            .select("part", "level_row", "level", "low",
                    F.when(F.col("level_row"), F.col("excess") - F.col("_cut")).otherwise(0.0).alias("excess"),
                    F.when(F.col("level_row"), 0.0).otherwise(F.col("floor") + F.col("_cut")).alias("floor")))


def heavy_candidates(df: DataFrame, f: str, w: str | None = None,
                     counters: int = COUNTERS) -> tuple[DataFrame, float]:
    """(level, low, high), at most ``counters`` rows, and the floor that the
    weight of every other level is at most.  Weights must not be negative.  Runs
    a job for each round of merges."""
    ensure_checkpoint_dir(df.sparkSession)
    weight = F.coalesce(F.col(w).cast("double"), F.lit(0.0)) if w else F.lit(1.0)
    rows = df.select(F.col(f).cast("string").alias("level"), weight.alias("weight")).mapInArrow(
        _summary(counters), "part long, level_row boolean, level string, low double, "
        "excess double, floor double").checkpoint(eager=True)
    while True:
        parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
        rows = _merged(rows.withColumn("part", F.expr(f"part div {FAN}")), counters).checkpoint(eager=True)
        if parts <= FAN:
            break
    floor = rows.filter(~F.col("level_row")).agg(F.sum("floor")).first()[0] or 0.0
    return (rows.filter("level_row").select("level", "low", (F.col("excess") + floor).alias("high")),
            floor * (1 + SLACK))


def heavy_levels(df: DataFrame, f: str, n: int, w: str | None = None, with_ties: bool = True,
                 counters: int = COUNTERS) -> tuple[DataFrame, bool]:
    """(``f``, ``_keep``) of ``kept_levels``, and whether the counters proved
    it.  Proven: only candidates are in the table, every other level is lumped.
    Runs jobs."""
    if counters < n + 2:
        raise ValueError("counters must be at least n + 2")
    exact = kept_levels(df, f, n, w, with_ties)
    if w and df.filter(F.col(w) < 0).limit(1).count():
        return exact, False
    found, floor = heavy_candidates(df, f, w, counters)
    # at most ``counters`` rows: a broadcast of a bounded size
    mine = F.broadcast(found.select(F.col("level").alias("_level")))
    weight = F.sum(w) if w else F.count(F.lit(1))
    totals = df.join(mine, F.col(f).cast("string").eqNullSafe(F.col("_level"))).groupBy(f).agg(
        weight.alias("_w")).checkpoint(eager=True)
    top = totals.orderBy(F.col("_w").desc_nulls_last()).limit(n + 2).select("_w").collect()
    # nothing was cut: all levels are candidates; else the n-th weight must pass the
    # floor, and two more levels make sure that the lump has more than one
    proven = floor == 0.0 or (len(top) == n + 2 and top[n - 1][0] is not None and top[n - 1][0] > floor)
    if not proven:
        return exact, False
    order = [F.col("_w").desc_nulls_last()] + ([] if with_ties else [F.col(f).asc_nulls_last()])
    ranked = totals.withColumn("_r", (F.rank() if with_ties else F.row_number()).over(
        Window.orderBy(*order)))
    single = F.lit(False)
    if floor == 0.0:
        single = ranked.filter(F.col("_r") > n).agg(F.count(F.lit(1))).scalar() <= 1
    return ranked.select(f, (single | (F.col("_r") <= n)).alias("_keep")), True


def lump_heavy(df: DataFrame, f: str, n: int, w: str | None = None, out: str | None = None,
               other: str = OTHER, with_ties: bool = True, counters: int = COUNTERS) -> DataFrame:
    """FCT1/FCT2 with the result of ``factors.lump``; a null level stays null."""
    out = out or f
    levels, proven = heavy_levels(df, f, n, w, with_ties, counters)
    kept = levels.filter("_keep and " + f"`{f}` is not null").select(F.col(f).alias("_kept"))
    kept = F.broadcast(kept) if proven else kept
    joined = df.join(kept, F.col(f) == F.col("_kept"), "left")
    return joined.withColumn(out, F.when(F.col("_kept").isNotNull() | F.col(f).isNull(), F.col(f))
                             .otherwise(F.lit(other))).drop("_kept")
