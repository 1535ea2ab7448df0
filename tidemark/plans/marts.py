"""Country mart (MK1-MK3) and country x medium mart (MK12-MK14).

Both marts aggregate the acquisition table once; every later analysis reads
them.  Their size is bounded by countries x mediums, so the windows applied to
them (ranks within a country) and the join between them stay small whatever
the size of the fact tables they were built from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import cents, ratio
from tidemark.operators.columns import rename_with
from tidemark.operators.ranking import dense_rank_within, share_of_total

VOLUME = ("users", "new_users", "sessions", "transactions", "revenue")
RATES = ("bounce_rate", "pages_session", "avg_session_duration", "ecommerce_conversion_rate")


def country_mart(mc: DataFrame, rate_agg: str = "mean") -> DataFrame:
    """MK1: per country, sums of the volume metrics, mean (or median) of the
    rates, ``revenue_per_transaction`` and ``new_users_share``.  Revenue is
    money and is kept in cents."""
    agg = {"mean": F.avg, "median": F.median}[rate_agg]
    by = mc.groupBy("country").agg(
        *[F.sum(c).alias(c) for c in VOLUME[:-1]],
        cents(F.sum("revenue")).alias("revenue"),
        *[agg(c).alias(c) for c in RATES],
    )
    by = by.select("country", *[F.col(c).cast("long").alias(c) for c in VOLUME[:-1]],
                   "revenue", *RATES)
    return by.withColumns({
        "revenue_per_transaction": ratio("revenue", "transactions"),
        "new_users_share": ratio("new_users", "users"),
    })


def keep_rule(revenue, users, transactions, combine: str = "and",
              strict: bool = True) -> Column:
    """MK3 predicate: ``revenue > r AND/OR users > u AND/OR transactions > t``
    (``strict=False`` uses ``>=``).  Thresholds may be numbers or Columns."""
    cmp = (lambda c, v: F.col(c) > v) if strict else (lambda c, v: F.col(c) >= v)
    parts = [cmp("revenue", revenue), cmp("users", users), cmp("transactions", transactions)]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if combine == "and" else (out | p)
    return out


def low_volume_rule(revenue, users, transactions) -> Column:
    """MK2 flag: ``revenue <= r OR users <= u OR transactions <= t``."""
    return ((F.col("revenue") <= revenue) | (F.col("users") <= users)
            | (F.col("transactions") <= transactions))


def low_volume_impact(mart: DataFrame, revenue, users, transactions) -> DataFrame:
    """MK2: countries and revenue on each side of the low-volume flag, with
    shares of the totals (rounded to 3 digits as in the reference table)."""
    flagged = mart.withColumn("too_low_volume", low_volume_rule(revenue, users, transactions))
    g = flagged.groupBy("too_low_volume").agg(
        F.count(F.lit(1)).alias("n_countries"), F.sum("revenue").alias("revenue"))
    g = share_of_total(g, "revenue", "perc_revenue")
    g = share_of_total(g, "n_countries", "perc_countries")
    return g.withColumns({"perc_revenue": F.round("perc_revenue", 3),
                          "perc_countries": F.round("perc_countries", 3)})


def with_suffix(df: DataFrame, suffix: str, keep: Sequence[str] = ("country",)) -> DataFrame:
    """PRJ7: rename every column but ``keep`` to ``<name><suffix>``."""
    return rename_with(df, lambda c: f"{c}{suffix}", exclude=tuple(keep))


def country_medium_mart(mc: DataFrame, by_country: DataFrame) -> DataFrame:
    """MK12: cells of the kept countries with shares of the country totals
    and dense ranks of the mediums within the country.

    ``by_country`` is the (filtered) country mart; its columns get the
    ``_country`` suffix.  The inner join doubles as the country filter; the
    country side is one row per country, so AQE broadcasts it at runtime."""
    bc = with_suffix(by_country, "_country")
    cm = mc.join(bc, "country", "inner")
    cm = cm.withColumns({f"{m}_share": ratio(m, f"{m}_country") for m in
                         ("revenue", "users", "new_users", "sessions", "transactions")})
    return dense_rank_within(cm, VOLUME, "country", suffix="_channel_within_country_rank")


def low_volume_medium_rule(revenue, users, transactions) -> Column:
    """MK13 flag: ``revenue < r AND users < u AND transactions < t``."""
    return ((F.col("revenue") < revenue) & (F.col("users") < users)
            & (F.col("transactions") < transactions))


def flag_low_volume_mediums(cm: DataFrame, revenue, users, transactions) -> DataFrame:
    return cm.withColumn("is_low_volume_medium",
                         low_volume_medium_rule(revenue, users, transactions))


def low_volume_medium_counts(cm_flagged: DataFrame) -> DataFrame:
    """MK13: rows per flag value and their share (rounded to 3)."""
    g = cm_flagged.groupBy("is_low_volume_medium").agg(F.count(F.lit(1)).alias("n"))
    g = share_of_total(g, "n", "perc")
    return g.withColumn("perc", F.round("perc", 3))


def drop_low_volume_mediums(cm_flagged: DataFrame) -> DataFrame:
    return cm_flagged.filter(~F.col("is_low_volume_medium")).drop("is_low_volume_medium")


def mediums_per_country(cm_flagged: DataFrame, n: int = 20) -> DataFrame:
    """MK14: distinct mediums per (country, flag), the country total repeated,
    countries lumped to the ``n`` largest totals (ties broken by name — the
    reference breaks them at random), "Other" dropped.

    The lump weight counts a country's total once per flag value (Q13)."""
    from tidemark.operators.factors import lump
    from tidemark.operators.ranking import group_total
    g = cm_flagged.groupBy("country", "is_low_volume_medium").agg(
        F.count_distinct("medium").alias("n_mediums"))
    g = group_total(g, "n_mediums", "country", "n_mediums_total")
    g = g.withColumn("n_mediums", F.col("n_mediums").cast("long")).withColumn(
        "n_mediums_total", F.col("n_mediums_total").cast("long"))
    lumped = lump(g, "country", n, w="n_mediums_total", out="country_lumped",
                  with_ties=False)
    return lumped.filter(F.col("country_lumped") != "Other").drop("country_lumped")
