"""Medium profiles and comparisons on the country x medium mart (MK15-MK33).

``cm`` is the cleaned mart of ``marts.country_medium_mart`` (low-volume cells
dropped); ``bc`` is the filtered country mart (without suffixes).  Every
operator here is a handful of aggregates and windows over a table whose size
is bounded by countries x mediums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio
from tidemark.operators.factors import level_order, lump, recode
from tidemark.operators.columns import matching, relocate
from tidemark.operators.ranking import (dense_rank_within, rank_one_tally, row_number_by,
                                        share_of_total, share_within, top_n, top_n_per_group)
from tidemark.operators.stats import fit_line, histogram
from tidemark.operators.resample import bootstrap_means, bootstrap_percentiles
from tidemark.operators.stats import welch_pairs, welch_t

NOT_SET = "(not set)"
# fixed values: labels folded into "unknown" by the scripts
UNKNOWN_LABELS = ("(none)", "(not set)")
UNKNOWN = "unknown"
METRICS = ("sessions", "users", "new_users", "transactions", "revenue")


def top_countries(bc: DataFrame, metric: str, n: int) -> DataFrame:
    """Top-``n`` countries by a country total (ties kept) as a key list."""
    return top_n(bc.select("country", metric), metric, n).select("country")


def unknown_recode(df: DataFrame, col: str = "medium") -> DataFrame:
    """MK24: fold ``(none)``/``(not set)`` into ``unknown``."""
    return df.withColumn(col, recode(col, {UNKNOWN_LABELS: UNKNOWN}, keep_unmatched=True))


def profile(cm: DataFrame, bc: DataFrame, metric: str, n_countries: int = 20,
            n_mediums: int = 6, share: bool = False, unknown: bool = False) -> DataFrame:
    """MK15/MK16/MK24: top countries by ``metric`` (taken before "(not set)"
    is dropped, Q10), mediums lumped to ``n_mediums`` by the metric (or its
    share), then summed per (country, lumped medium) — the stacked bar.

    A summed share is computed as ``sum(metric) / country total`` (one row's
    country total is the group's): the same number as the sum of the cell
    shares, without the rounding of a long float sum."""
    value = f"{metric}_share" if share else metric
    d = (cm.join(top_countries(bc, metric, n_countries), "country", "left_semi")
         .filter(F.col("country") != NOT_SET))
    if unknown:
        d = unknown_recode(d)
    d = lump(d.select("country", "medium", value, metric, f"{metric}_country"), "medium",
             n_mediums, w=value)
    if share:
        return d.groupBy("country", "medium").agg(
            ratio(F.sum(metric), F.max(f"{metric}_country")).alias(value))
    return d.groupBy("country", "medium").agg(F.sum(value).alias(value))


def median_share_table(cm: DataFrame, bc: DataFrame, metrics: Sequence[str] = METRICS,
                       n_countries: int = 20, n_mediums: int = 20) -> DataFrame:
    """MK17: per medium, the median of each metric's country share over the
    top countries of that metric; each metric keeps its top mediums (ties
    kept) and the table keeps the first metric's mediums (Q14).

    One plan for all metrics: the country totals and the cell shares are
    unpivoted to (metric, ...) rows, the top countries and top mediums are
    ranks within each metric, and the medians are pivoted back to columns."""
    metrics = list(metrics)
    tops = (bc.select("country", *metrics).unpivot("country", metrics, "metric", "total")
            .filter(F.col("total").isNotNull())
            .withColumn("_r", F.rank().over(Window.partitionBy("metric")
                                            .orderBy(F.col("total").desc())))
            .filter(F.col("_r") <= n_countries).select("metric", "country"))
    shares = (cm.select("country", "medium", *[F.col(f"{m}_share").alias(m) for m in metrics])
              .unpivot(["country", "medium"], metrics, "metric", "share"))
    med = (shares.join(tops, ["metric", "country"], "left_semi")
           .groupBy("metric", "medium").agg(F.median("share").alias("median")))
    med = (med.filter(F.col("median").isNotNull())
           .withColumn("_r", F.rank().over(Window.partitionBy("metric")
                                           .orderBy(F.col("median").desc())))
           .filter(F.col("_r") <= n_mediums))
    wide = med.groupBy("medium").pivot("metric", metrics).agg(F.first("median"))
    wide = wide.filter(F.col(metrics[0]).isNotNull())
    return wide.select("medium", *[F.col(m).alias(f"median_{m}_share") for m in metrics])


def classify_mediums(cm: DataFrame, classes: DataFrame) -> DataFrame:
    """MK18: mediums labelled free/paid; unlisted mediums are dropped."""
    return cm.join(classes, "medium", "inner")


def free_vs_paid(cm: DataFrame, bc: DataFrame, classes: DataFrame,
                 n_countries: int = 150) -> DataFrame:
    """MK19: sessions and mean conversion rate per (country, class) over the
    top countries by revenue, with each class's share of the country's
    classed sessions."""
    d = classify_mediums(cm.join(top_countries(bc, "revenue", n_countries), "country",
                                 "left_semi"), classes)
    g = d.groupBy("country", F.col("class").alias("medium")).agg(
        F.sum("sessions").cast("long").alias("sessions"),
        F.avg("ecommerce_conversion_rate").alias("mean_conv_rate"))
    return share_within(g, "sessions", "country", "perc_sessions")


def good_converting_low_paid(fvp: DataFrame, min_free_sessions, max_paid_sessions
                             ) -> DataFrame:
    """MK20: wide (free, paid) per country; much free traffic, little paid
    traffic, best free conversion first.  A country without paid rows has a
    NULL paid side and is dropped by the filter, as in the reference."""
    wide = (fvp.filter(F.col("country") != NOT_SET)
            .groupBy("country").pivot("medium", ["free", "paid"])
            .agg(F.first("sessions").alias("sessions"),
                 F.first("mean_conv_rate").alias("mean_conv_rate")))
    wide = wide.withColumnsRenamed({f"{c}_{v}": f"{v}_{c}" for c in ("free", "paid")
                                    for v in ("sessions", "mean_conv_rate")})
    return (wide.filter((F.col("sessions_free") > min_free_sessions)
                        & (F.col("sessions_paid") < max_paid_sessions))
            .orderBy(F.col("mean_conv_rate_free").desc_nulls_last(), "country"))


def revenue_per_transaction_rows(cm: DataFrame, n_mediums: int = 7) -> DataFrame:
    """MK21 input: cells with revenue and transactions, rev/tx, mediums
    lumped to ``n_mediums`` by summed rev/tx (``cell_medium`` keeps the
    original, so (country, cell_medium) identifies a row)."""
    d = (cm.filter((F.col("revenue") > 0) & (F.col("transactions") > 0))
         .select("country", "medium", F.col("medium").alias("cell_medium"), "revenue",
                 "transactions")
         .withColumn("revenue_per_transaction", ratio("revenue", "transactions")))
    return lump(d, "medium", n_mediums, w="revenue_per_transaction")


def revenue_per_transaction_means(cm: DataFrame, resamples: int = 10_000,
                                  seed: int = 0) -> DataFrame:
    """MK21/MK22 input: bootstrap means of rev/tx per (resample, medium),
    stratified by medium."""
    return bootstrap_means(revenue_per_transaction_rows(cm), "medium",
                           "revenue_per_transaction", ["country", "cell_medium"],
                           resamples, seed)


def bootstrap_revenue_per_transaction(cm: DataFrame, resamples: int = 10_000,
                                      seed: int = 0, means: DataFrame | None = None
                                      ) -> DataFrame:
    """MK21: 5/50/95 percentiles of the bootstrap means of rev/tx per medium
    (stratified by medium, ``resamples`` resamples; ``means`` reuses a
    computed ``revenue_per_transaction_means``)."""
    if means is None:
        means = revenue_per_transaction_means(cm, resamples, seed)
    return bootstrap_percentiles(means, "medium", "mean_revenue_per_transaction")


def bootstrap_welch(cm: DataFrame, resamples: int = 10_000, seed: int = 0,
                    first: str | None = None, second: str | None = None,
                    means: DataFrame | None = None) -> DataFrame:
    """MK22: Welch test on the bootstrap means of two mediums; by default the
    two mediums with the largest summed rev/tx (chosen inside the plan)."""
    if means is None:
        means = revenue_per_transaction_means(cm, resamples, seed)
    if not (first and second):
        top = top_n(revenue_per_transaction_rows(cm).groupBy("medium").agg(
            F.sum("revenue_per_transaction").alias("w")), "w", 2, with_ties=False, tie="medium")
        ranked = row_number_by(top, [F.col("w").desc_nulls_last(), "medium"], "r")
        first, second = (ranked.filter(F.col("r") == r).select("medium").scalar() for r in (1, 2))
    return welch_t(means, "medium", "mean_revenue_per_transaction", first, second)


def welch_all_mediums(cm: DataFrame, n_mediums: int = 7) -> DataFrame:
    """MK22 on the cells themselves: rev/tx of every two lumped mediums, with a
    cell as one observation (so df is of the size of the sample, not of the
    number of resamples)."""
    return welch_pairs(revenue_per_transaction_rows(cm, n_mediums), "medium",
                       "revenue_per_transaction")


def share_distribution(cm: DataFrame, bc: DataFrame, metric: str, n_countries: int = 200,
                       n_mediums: int = 6, width: float = 0.015) -> DataFrame:
    """MK23: histogram (bin width ``width``) of a metric's country share per
    lumped medium over the top countries."""
    d = cm.join(top_countries(bc, metric, n_countries), "country", "left_semi")
    d = lump(d.select("country", "medium", metric, f"{metric}_share"), "medium",
             n_mediums, w=metric)
    return histogram(d, f"{metric}_share", width, by=["medium"])


def median_revenue_share(cm: DataFrame, bc: DataFrame, n_countries: int = 50,
                         n_mediums: int = 7) -> DataFrame:
    """MK25: median revenue share by lumped medium ("unknown" recode first)."""
    d = unknown_recode(cm.join(top_countries(bc, "revenue", n_countries), "country",
                               "left_semi"))
    d = lump(d, "medium", n_mediums, w="revenue")
    return d.groupBy("medium").agg(F.median("revenue_share").alias("median_revenue_share"))


def big_cells(cm: DataFrame, min_revenue, min_transactions) -> DataFrame:
    """Row filter of the scripts: ``revenue > r AND transactions > t``."""
    return cm.filter((F.col("revenue") > min_revenue) & (F.col("transactions") > min_transactions))


def rpt_ranks(cells: DataFrame, n_mediums: int = 6) -> DataFrame:
    """MK26: rev/tx, its dense rank within the country, mediums lumped by
    summed rev/tx into ``medium_lumped``."""
    d = cells.select("country", "medium", "revenue", "transactions").withColumn(
        "revenue_per_transaction", ratio("revenue", "transactions"))
    d = dense_rank_within(d, ["revenue_per_transaction"], "country")
    return lump(d, "medium", n_mediums, w="revenue_per_transaction", out="medium_lumped").orderBy(
        "country", "revenue_per_transaction_rank", "medium")


def rpt_winners(cells: DataFrame, n_mediums: int = 6) -> DataFrame:
    """MK27: lumped mediums ranked first on rev/tx in a country, with share."""
    r = rpt_ranks(cells, n_mediums)
    t = rank_one_tally(r, "revenue_per_transaction_rank", "medium_lumped")
    return (share_of_total(t, "n", "perc").withColumnRenamed("medium_lumped", "medium")
            .orderBy(F.desc("n"), "medium"))


def rpt_spread(cells: DataFrame, n_mediums: int = 6) -> DataFrame:
    """MK28: median and IQR of rev/tx per lumped medium."""
    r = rpt_ranks(cells, n_mediums)
    q = F.percentile("revenue_per_transaction", F.array(F.lit(0.25), F.lit(0.75)))
    return r.groupBy(F.col("medium_lumped").alias("medium")).agg(
        F.median("revenue_per_transaction").alias("median_revenue_per_transaction"),
        q.alias("_q")).select(
        "medium", "median_revenue_per_transaction",
        (F.col("_q")[1] - F.col("_q")[0]).alias("iqr_revenue_per_transaction")).orderBy(
        F.col("median_revenue_per_transaction").desc_nulls_last(), "medium")


def share_fit(cells: DataFrame, n_mediums: int = 7) -> DataFrame:
    """MK29: per lumped medium, the line revenue_share ~ new_users_share and
    their correlation."""
    d = lump(unknown_recode(cells), "medium", n_mediums, w="revenue")
    return fit_line(d, "revenue_share", "new_users_share", by=["medium"]).withColumnRenamed(
        "correlation", "revenue_new_users_share_corr")


def top_medium_tally(cells: DataFrame, metric: str, n_mediums: int = 7,
                     by_mart_rank: bool = False) -> DataFrame:
    """MK30: lumped (by ``metric``) medium with the largest ``metric_share``
    in each country (ties kept), counted.

    ``by_mart_rank`` keeps the rank that the mart gave among all mediums of
    the country instead: a country whose best medium is not in ``cells`` has
    no winner then (the users variant of the scripts)."""
    d = lump(unknown_recode(cells), "medium", n_mediums, w=metric)
    if by_mart_rank:
        best = d.filter(F.col(f"{metric}_channel_within_country_rank") == 1)
    else:
        best = top_n_per_group(d, f"{metric}_share", 1, "country")
    return best.groupBy("medium").agg(F.count(F.lit(1)).alias("n"))


def monetisation_ratio(cells: DataFrame) -> DataFrame:
    """MK31: revenue share over users share, kept above 1, largest first."""
    d = cells.select("country", "medium", "users_share", "revenue_share").withColumn(
        "revenue_to_users_share_ratio", ratio("revenue_share", "users_share"))
    return d.filter(F.col("revenue_to_users_share_ratio") > 1).orderBy(
        F.col("revenue_to_users_share_ratio").desc_nulls_last(), "country", "medium")


def best_converting_tally(cells: DataFrame) -> DataFrame:
    """MK32: medium ranked first on conversion rate per country, counted."""
    d = dense_rank_within(cells.select("country", "medium", "ecommerce_conversion_rate"),
                          ["ecommerce_conversion_rate"], "country", suffix="_within_country_rank")
    return rank_one_tally(d, "ecommerce_conversion_rate_within_country_rank", "medium")


def potential_funnel(cells: DataFrame, visitors: int = 10_000) -> DataFrame:
    """MK33: revenue of ``visitors`` visitors at the cell's conversion rate and
    rev/tx, with dense ranks within the country of every revenue column; the
    visitors stand in front of the conversion rate."""
    d = cells.select("country", "medium", "ecommerce_conversion_rate", "revenue",
                     "transactions").withColumn(
        "revenue_per_transaction", ratio("revenue", "transactions"))
    d = relocate(d.withColumn("n_potential_incoming_visitors", F.lit(visitors)),
                 "n_potential_incoming_visitors", "ecommerce_conversion_rate")
    d = d.withColumn("potential_revenue", F.col("n_potential_incoming_visitors")
                     * F.col("ecommerce_conversion_rate") * F.col("revenue_per_transaction"))
    return dense_rank_within(d, matching(d, contains="revenue"), "country")


def funnel_what_if(cells: DataFrame, visitors: int = 10_000,
                   country: str | None = None) -> DataFrame:
    """MK33: cells whose potential rank beats their revenue rank."""
    d = potential_funnel(cells, visitors)
    if country:
        d = d.filter(F.col("country") == country)
    return d.select("country", "medium", *matching(d, ends_with="_rank")).filter(
        F.col("potential_revenue_rank") < F.col("revenue_rank"))


def mediums_levels(cm: DataFrame, metric: str = "revenue") -> DataFrame:
    """FCT3 on the mart: medium level order by the sum of ``metric``."""
    return level_order(cm.select("medium", metric), "medium", metric, "sum",
                       desc=True).select("medium", "medium_order").distinct()
