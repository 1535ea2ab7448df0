"""Candidate markets on the country mart (MK4-MK11, MK34, MK35).

Inputs are country-grain tables (one row per country), so the unpartitioned
windows here (ntile, percent_rank) sort at most a few hundred rows; averages
used as row baselines are scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import int_trunc, ratio
from tidemark.operators.joins import left_join_all
from tidemark.operators.ranking import head_sorted, ntile_of, percent_rank_desc, top_n
from tidemark.operators.stats import prob_grid, quantile_grid

NOT_SET = "(not set)"
PROFILE = ("users", "new_users", "transactions", "revenue", "sessions")


def metric_quantiles(mart: DataFrame, metrics: Sequence[str] = ("users", "transactions", "revenue"),
                     probs: Sequence[float] | None = None) -> DataFrame:
    """MK4: quantiles 0, .05, ..., 1 of the key metrics."""
    return quantile_grid(mart, metrics, probs or prob_grid(0, 1, 0.05))


def revenue_tiers(mart: DataFrame, n: int = 7) -> DataFrame:
    """MK5: ``ntile(revenue, n)`` (ties broken by country name)."""
    return ntile_of(mart.select("country", "revenue"), "revenue", n, "country",
                    "revenue_ntile")


def unmatched_countries(mart: DataFrame, geography: DataFrame) -> DataFrame:
    """MK5/JN9: countries of the mart that the geography list does not know."""
    return mart.select("country").join(geography.select("country"), "country", "left_anti")


def top_drivers(mart: DataFrame, metric: str, n: int = 30) -> DataFrame:
    """MK6: the ``n`` countries with the largest ``metric`` (ties kept)."""
    return top_n(mart.select("country", metric), metric, n)


def head_of_market(mart: DataFrame, n: int = 12) -> DataFrame:
    """MK7: largest markets by revenue, users, conversion rate, transactions."""
    order = [F.col(c).desc_nulls_last() for c in
             ("revenue", "users", "ecommerce_conversion_rate", "transactions")]
    return head_sorted(mart.filter(F.col("country") != NOT_SET), [*order, "country"], n)


def _conversion_view(mart: DataFrame, min_transactions) -> DataFrame:
    """Shared part of MK8/MK9: countries above a transaction floor, the
    truncated distance of revenue per transaction to its (unweighted) mean
    over those countries (Q5, Q6), and the conversion rate rounded to the
    percent-text precision it is ranked on (Q3)."""
    base = mart.filter((F.col("country") != NOT_SET) & (F.col("transactions") > min_transactions))
    mean_rpt = base.select(F.avg("revenue_per_transaction")).scalar()
    return base.select(
        "country",
        F.round("ecommerce_conversion_rate", 4).alias("ecommerce_conversion_rate"),
        int_trunc("revenue_per_transaction").alias("revenue_per_transaction"),
        int_trunc(F.col("revenue_per_transaction") - mean_rpt)
        .alias("diff_to_mean_revenue_per_transaction"),
        "users", "new_users", "transactions", "revenue", "sessions")


def high_conversion_high_value(mart: DataFrame, min_transactions) -> DataFrame:
    """MK8: better conversion than half of the countries and revenue per
    transaction above the mean."""
    v = _conversion_view(mart, min_transactions)
    v = percent_rank_desc(v, "ecommerce_conversion_rate", "_pr", ["country"])
    v = v.withColumns({
        "is_top_converting_country": F.col("_pr") <= 0.5,
        "is_rev_per_trans_higher_than_avg": F.col("diff_to_mean_revenue_per_transaction") > 0,
    }).drop("_pr")
    return v.filter(F.col("is_top_converting_country")
                    & F.col("is_rev_per_trans_higher_than_avg")).orderBy(
        F.desc("ecommerce_conversion_rate"), F.desc("revenue_per_transaction"), "country")


def low_conversion_high_traffic(mart: DataFrame, min_transactions, n: int = 3) -> DataFrame:
    """MK9: bottom quarter by conversion rate, the ``n`` with most users."""
    v = _conversion_view(mart, min_transactions)
    v = percent_rank_desc(v, "ecommerce_conversion_rate", "_pr", ["country"])
    v = v.withColumns({
        "is_bottom_converting_country": F.col("_pr") >= 0.75,
        "is_rev_per_trans_higher_than_avg": F.col("diff_to_mean_revenue_per_transaction") > 0,
    }).drop("_pr")
    return (v.filter(F.col("is_bottom_converting_country"))
            .orderBy(F.col("users").desc_nulls_last(), "country").limit(n))


def market_penetration(mart: DataFrame, population: DataFrame, tourists: DataFrame,
                       n: int = 30, matched_only: bool = True) -> DataFrame:
    """MK10: transactions as customers for the top ``n`` countries, compared
    with the number of tourists: ``customers_share`` and ``1 in N``.

    Numbers are rounded half-to-even to whole units as in the reference; the
    share stays numeric at the precision of its percent text (Q4)."""
    cust = top_n(mart.filter(F.col("country") != NOT_SET)
                 .select("country", "transactions", "revenue", "revenue_per_transaction"),
                 "transactions", n).withColumnRenamed("transactions", "customers")
    pen = (left_join_all([cust, population, tourists], "country")
           .withColumn("_share", ratio("customers", "tourists")))
    pen = pen.select(
        "country", "customers", F.bround("population", 0).cast("long").alias("population"),
        F.bround("tourists", 0).alias("tourists"),
        F.floor(ratio(F.lit(1.0), F.col("_share"))).cast("long").alias("one_in_n_tourists_has_transacted"),
        F.round("_share", 5).alias("customers_share"),
        F.bround("revenue", 0).alias("revenue"),
        F.bround("revenue_per_transaction", 0).alias("revenue_per_transaction"))
    if matched_only:
        pen = pen.filter(F.col("one_in_n_tourists_has_transacted").isNotNull()).drop("population")
    return pen.orderBy(F.col("customers_share").desc_nulls_last(), "country")


def uplift_columns(current_revenue, revenue_per_customer, tourists, target_share):
    """MK11 what-if as column expressions: potential customers at the target
    share, the revenue they would bring, its increase and the uplift."""
    potential_customers = F.floor(target_share * tourists)
    potential_revenue = revenue_per_customer * potential_customers
    increase = potential_revenue - current_revenue
    return {
        "potential_customers": potential_customers.cast("long"),
        "potential_revenue": potential_revenue,
        "revenue_increase": increase,
        "revenue_uplift": ratio(increase, current_revenue),
    }


def uplift(penetration: DataFrame, pairs: DataFrame) -> DataFrame:
    """MK11: for each (country, peer) pair where the peer has the higher
    penetration, the revenue if the country reached the peer's share."""
    me = penetration.select("country", "customers", "tourists", "customers_share",
                            "revenue", "revenue_per_transaction")
    peer = penetration.select(F.col("country").alias("peer_country"),
                              F.col("customers_share").alias("target_share"))
    j = pairs.join(me, "country").join(peer, "peer_country").filter(
        F.col("target_share") > F.col("customers_share"))
    return j.withColumns(uplift_columns(F.col("revenue"), F.col("revenue_per_transaction"),
                                        F.col("tourists"), F.col("target_share")))


def one_country(df: DataFrame, country: str) -> DataFrame:
    """MK35: one country's rows, largest revenue first."""
    order = [F.col("revenue").desc_nulls_last(), *(c for c in ("medium",) if c in df.columns)]
    return df.filter(F.col("country") == country).orderBy(*order)


def candidate_score(lists: dict[str, DataFrame]) -> DataFrame:
    """MK34: distinct union of the candidate lists, one flag column per list
    (left joins on country), ``total_score`` = number of lists naming the country."""
    names = list(lists)
    allc = None
    for df in lists.values():
        c = df.select("country")
        allc = c if allc is None else allc.union(c)
    out = left_join_all([allc.distinct(), *(
        df.select("country", F.lit(True).alias(name)).distinct() for name, df in lists.items())],
        "country")
    score = sum((F.coalesce(F.col(n).cast("int"), F.lit(0)) for n in names), F.lit(0))
    return out.withColumn("total_score", score.cast("long")).orderBy(
        F.desc("total_score"), "country")


def literal_list(spark: SparkSession, countries: Sequence[str]) -> DataFrame:
    """SRC4: a list written out in the analysis, as a table of countries."""
    values = F.explode(F.array(*map(F.lit, countries)) if countries
                       else F.array().cast("array<string>"))
    return spark.range(1).select(values.alias("country"))
