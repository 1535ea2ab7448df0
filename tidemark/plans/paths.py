"""Conversion-path preparation, profiling and model comparison (CP1-CP11,
CP16-CP22).

Path tables can be large (one row per exported journey).  Everything here is
row-local expressions, ``explode`` + ``groupBy`` with partial aggregation, or a
window over an already aggregated table; totals are scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import bin_center, cents, ratio, split_amount
from tidemark.operators.attribution import (CONVERSION, heuristic_models,
                                            markov_model, touches, transition_matrix)
from tidemark.operators.ranking import (head_sorted, row_number_by, running_total, sample_rows,
                                        share_of_total, top_n, top_n_per_group)
from tidemark.operators.stats import ecdf, histogram, prob_grid, quantile_grid, summary


def parse_paths(raw: DataFrame) -> DataFrame:
    """CP1: ``value`` text -> ``currency`` + numeric ``value``; conversions to
    integers."""
    currency, amount = split_amount("value")
    return raw.select("medium_path", F.col("conversions").cast("long").alias("conversions"),
                      currency.alias("currency"), amount.alias("value"))


def currency_counts(parsed: DataFrame) -> DataFrame:
    """CP1: rows per currency."""
    return parsed.groupBy("currency").agg(F.count(F.lit(1)).alias("n"))


def value_summary(parsed: DataFrame) -> DataFrame:
    """CP2: min / quartiles / mean / max of the path value."""
    return summary(parsed, "value")


def value_tail_quantiles(parsed: DataFrame) -> DataFrame:
    """CP2: quantiles .90, .91, ..., 1.00 of the value."""
    return quantile_grid(parsed, ["value"], prob_grid(0.9, 1.0, 0.01))


def value_ecdf(parsed: DataFrame) -> DataFrame:
    """CP2: empirical CDF of the value."""
    return ecdf(parsed, "value")


def top_paths_by_value(parsed: DataFrame, n: int = 10) -> DataFrame:
    """CP3: the ``n`` most valuable path rows (ties kept)."""
    return top_n(parsed, "value", n)


def pair_density(parsed: DataFrame, conv_width: float = 1.0, value_width: float = 500.0,
                 log10: bool = False) -> DataFrame:
    """CP4: counts on a 2-D grid of (conversions, value) bins, linear or log10
    (zeros have no logarithm and leave the log grid)."""
    x, y = F.col("conversions").cast("double"), F.col("value")
    if log10:
        x = F.when(x > 0, F.log10(x))
        y = F.when(y > 0, F.log10(y))
    d = parsed.select(x.alias("x"), y.alias("y")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    return d.groupBy(bin_center("x", conv_width).alias("conversions_bin"),
                     bin_center("y", value_width).alias("value_bin")).agg(
        F.count(F.lit(1)).alias("n"))


def zero_value_audit(parsed: DataFrame) -> DataFrame:
    """CP5: rows and conversions with zero value versus the rest, as shares."""
    g = parsed.groupBy((F.col("value") == 0).alias("is_zero_value")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("conversions").cast("long").alias("conversions"))
    g = share_of_total(g, "n", "perc_rows")
    return share_of_total(g, "conversions", "perc_conversions")


def drop_zero_value(parsed: DataFrame) -> DataFrame:
    """CP5: keep paths with a positive value."""
    return parsed.filter(F.col("value") > 0)


def medium_vocabulary(parsed: DataFrame) -> DataFrame:
    """CP6: the sorted distinct touches over all paths."""
    return (parsed.select(F.explode(touches("medium_path")).alias("medium")).distinct()
            .orderBy("medium"))


def path_features(parsed: DataFrame) -> DataFrame:
    """CP7: path length and first touch."""
    a = touches("medium_path")
    return parsed.withColumns({"path_length": F.size(a).cast("long"),
                               "first_touchpoint_medium": F.element_at(a, 1)})


def path_length_histogram(feat: DataFrame, lo: float | None = None,
                          hi: float | None = None) -> DataFrame:
    """CP8: rows per path length (bin width 1), optionally within [lo, hi]."""
    return histogram(feat, "path_length", 1.0, lo=lo, hi=hi)


def path_length_quantiles(feat: DataFrame) -> DataFrame:
    """CP8: quantiles .50, .55, ..., 1 of the path length."""
    return quantile_grid(feat, ["path_length"], prob_grid(0.5, 1.0, 0.05))


def value_by_length(feat: DataFrame, max_length: int | None = None) -> DataFrame:
    """CP9: value per path length, its share and the running share (the
    running window runs on the per-length table)."""
    g = feat.groupBy("path_length").agg(F.sum("value").alias("value"))
    g = share_of_total(g, "value", "perc")
    g = running_total(g, "perc", "path_length", "cumul")
    if max_length is not None:
        g = g.filter(F.col("path_length") <= max_length)
    return g


def first_touch_frequency(feat: DataFrame) -> DataFrame:
    """CP10: paths per first touch and share, most frequent first."""
    g = feat.groupBy("first_touchpoint_medium").agg(F.count(F.lit(1)).alias("n"))
    return share_of_total(g, "n", "perc").orderBy(F.desc("n"), "first_touchpoint_medium")


def duplicate_paths(parsed: DataFrame) -> DataFrame:
    """CP11: number of rows that repeat an earlier path, and the distinct count."""
    return parsed.agg(F.count(F.lit(1)).alias("n_rows"),
                      F.count_distinct("medium_path").alias("n_distinct")).select(
        "n_rows", "n_distinct", (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicated"))


def merge_paths(parsed: DataFrame) -> DataFrame:
    """CP11: one row per distinct path with summed conversions and value
    (money kept in cents)."""
    return parsed.groupBy("medium_path").agg(
        F.sum("conversions").cast("long").alias("conversions"), cents(F.sum("value")).alias("value"))


def clean_paths(raw: DataFrame) -> DataFrame:
    """CP1 -> CP5 -> CP11: the model input (distinct paths, value > 0)."""
    return merge_paths(drop_zero_value(parse_paths(raw)))


def model_comparison(paths: DataFrame, n: int = 6, model: DataFrame | None = None) -> DataFrame:
    """CP16: Markov and heuristic conversions for the top ``n`` channels by
    Markov conversions, long form (channel_name, model, value), with the
    channels' display order (``channel_order``).  ``model`` reuses a computed
    ``markov_model``."""
    markov = (model if model is not None else markov_model(paths)).select(
        "channel_name", F.col("total_conversions").alias("markov_conversions"))
    heur = heuristic_models(paths)
    heur = heur.withColumnsRenamed({c: c.replace("touch_", "", 1) for c in heur.columns
                                    if c != "channel_name"})
    top = top_n(markov, "markov_conversions", n).select("channel_name")
    both = markov.join(heur, "channel_name", "left").join(top, "channel_name", "left_semi")
    conv_cols = [c for c in both.columns if c.endswith("conversions")]
    both = both.select("channel_name", *conv_cols).withColumnsRenamed(
        {c: c.replace("_conversions", "", 1) for c in conv_cols})
    long = both.unpivot("channel_name", [c.replace("_conversions", "", 1) for c in conv_cols],
                        "model", "value")
    # FCT3: channels ordered by their summed credit over the models, largest first
    from tidemark.operators.factors import level_order
    return level_order(long, "channel_name", "value", "sum", out="channel_order", desc=True)


def top_transitions(paths: DataFrame, n_channels: int = 11, n_targets: int = 4,
                    model: DataFrame | None = None) -> DataFrame:
    """CP17: for the top channels by Markov conversions, their ``n_targets``
    most likely next states (no ties).  ``model`` reuses a computed
    ``markov_model``."""
    tm = transition_matrix(paths)
    model = model if model is not None else markov_model(paths)
    top = top_n(model.select("channel_name", "total_conversions"), "total_conversions", n_channels)
    kept = tm.join(top, tm["channel_from"] == top["channel_name"], "left_semi")
    return top_n_per_group(kept, "transition_probability", n_targets, "channel_from",
                           with_ties=False, tie="channel_to")


def subnetwork(tm: DataFrame, nodes: Sequence[str], classes: dict[str, str] | None = None
               ) -> tuple[DataFrame, DataFrame]:
    """CP18/CP19 helper: edges with both ends in ``nodes`` and their node list
    (optionally classed)."""
    e = tm.filter(F.col("channel_from").isin(*nodes) & F.col("channel_to").isin(*nodes))
    v = (e.select(F.col("channel_from").alias("name"))
         .union(e.select(F.col("channel_to").alias("name"))).distinct())
    if classes:
        expr = None
        for k, c in classes.items():
            expr = (F.when(F.col("name") == k, F.lit(c)) if expr is None
                    else expr.when(F.col("name") == k, F.lit(c)))
        v = v.withColumn("class", expr)
    return e, v


def strong_edges(tm: DataFrame, min_probability: float) -> tuple[DataFrame, DataFrame]:
    """CP19: edges above a probability and the nodes they touch."""
    e = tm.filter(F.col("transition_probability") > min_probability)
    v = (e.select(F.col("channel_from").alias("name"))
         .union(e.select(F.col("channel_to").alias("name"))).distinct())
    return e, v


def conversion_odds(tm: DataFrame) -> DataFrame:
    """CP20: "1 in N" paths convert right after a touch of the channel."""
    return tm.filter(F.col("channel_to") == CONVERSION).select(
        "channel_from", "transition_probability",
        ratio(F.lit(1.0), F.col("transition_probability")).alias("one_in_n"))


def path_search(parsed: DataFrame, fragment: str) -> DataFrame:
    """CP22: paths containing a medium substring (literal match)."""
    return parsed.filter(F.col("medium_path").contains(fragment))


def channel_index(result: DataFrame) -> DataFrame:
    """WIN11: 1-based channel index by name (the index<->name dictionary of a
    model result)."""
    return row_number_by(result.select("channel_name"), ["channel_name"], "channel_index")


def touches_long(paths: DataFrame) -> DataFrame:
    """RSH4: the ragged touch list kept long — (path, 1-based position, medium)."""
    return paths.select("medium_path", F.posexplode(touches("medium_path")).alias("pos", "medium")
                        ).select("medium_path", (F.col("pos") + 1).cast("long").alias("position"),
                                 "medium")


def tail_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """TOP5: the last ``n`` rows of ``df`` sorted descending by ``order`` —
    i.e. the first ``n`` in ascending order (TakeOrderedAndProject)."""
    return head_sorted(df, [F.col(c).asc_nulls_last() for c in order], n)


def sample_paths(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """SMP1: ``n`` random path rows (the limit is the sampling feature)."""
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    return sample_rows(df, n, ["medium_path", "conversions", "currency", cents], seed)


def odds_vs_best(tm: DataFrame) -> DataFrame:
    """CP20 comparison: each channel's "1 in N" against the best converting
    channel (ratio of the two N; 1 for the best)."""
    odds = conversion_odds(tm)
    best = odds.select(F.min("one_in_n")).scalar()
    return odds.withColumn("ratio_to_best", ratio(F.col("one_in_n"), best))
