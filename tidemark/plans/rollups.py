"""Roll-ups of the mart's cells from sketches (AGG3, AGG5, AGG8, AGG12, AGG15), each
beside its exact counterpart and a flag that says whether the sketch is within
its published bound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import sketches as sk
from tidemark.operators.stats import exact_quantiles
from tidemark.plans.mediums import rpt_ranks, unknown_recode
from tidemark.operators.factors import lump

CELL = ("country", "medium")
QUARTILES = (0.25, 0.5, 0.75)


def quartiles_with_sketch(rows: DataFrame, value: str, by: str, sketches: DataFrame,
                          k: int = sk.KLL_K) -> DataFrame:
    """(``by``, n, q25, median, q75, within_bound): exact quartiles, and whether
    those of the merged ``sketches`` have true ranks within the bound."""
    exact = exact_quantiles(rows, value, QUARTILES, by=[by])
    pick = lambda p, name: F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
    exact = exact.groupBy(by).agg(*[pick(p, c) for p, c in zip(QUARTILES, ("q25", "median", "q75"))])
    merged = sk.sketch_quantiles(sk.merge_value_sketches(sketches, [by], k), [by], QUARTILES)
    flags = sk.quantiles_within_bound(rows, value, [by], merged, QUARTILES, k)
    return merged.select(by, "n").join(exact, by).join(flags, by)


def order_value_quartiles(orders: DataFrame, by: str, sketches: DataFrame) -> DataFrame:
    """Quartiles of the order value by country or medium; the cells' sketches
    are merged, the orders are read for the exact side only."""
    return quartiles_with_sketch(orders, "value", by, sketches)


def rpt_spread_sketched(cells: DataFrame, n_mediums: int = 6) -> DataFrame:
    """MK28: median and IQR of rev/tx per lumped medium, and the flag of sketches
    kept by medium and merged up to the lumped ones."""
    rows = rpt_ranks(cells, n_mediums).select("medium", "medium_lumped", "revenue_per_transaction")
    by_medium = sk.value_sketches(rows, "revenue_per_transaction", ["medium", "medium_lumped"])
    out = quartiles_with_sketch(rows, "revenue_per_transaction", "medium_lumped", by_medium)
    return out.select(F.col("medium_lumped").alias("medium"), "n",
                      F.col("median").alias("median_revenue_per_transaction"),
                      (F.col("q75") - F.col("q25")).alias("iqr_revenue_per_transaction"), "within_bound")


def median_share_sketched(cm: DataFrame, top: DataFrame, n_mediums: int = 7) -> DataFrame:
    """MK25: median revenue share by lumped medium over the countries of ``top``."""
    rows = lump(unknown_recode(cm.join(top, "country", "left_semi")).select(
        "country", "medium", "revenue", "revenue_share"), "medium", n_mediums, w="revenue")
    by_cell = sk.value_sketches(rows, "revenue_share", ["country", "medium"])
    return quartiles_with_sketch(rows, "revenue_share", "medium", by_cell).select(
        "medium", "n", F.col("median").alias("median_revenue_share"), "within_bound")


def user_sketches(customers: DataFrame) -> DataFrame:
    """A cell's users and new users as theta sketches, to be kept with the mart."""
    return sk.key_sketches(customers, {
        "users": F.col("o_custkey"), "new": F.when(F.col("is_new"), F.col("o_custkey"))}, CELL)


def users_by(customers: DataFrame, sketches: DataFrame, by: str) -> DataFrame:
    """Users, new users and returning users (users whose first order is
    elsewhere) of a roll-up; a user of several cells counts once."""
    exact = customers.groupBy(by, "o_custkey").agg(F.max("is_new").alias("is_new")).groupBy(by).agg(
        F.count(F.lit(1)).alias("users"), F.count_if("is_new").alias("new_users"))
    merged = sk.merge_key_sketches(sketches, ["users", "new"], [by]).select(
        by, F.col("users").alias("_users"), F.col("new").alias("_new"))
    returning = F.col("users") - F.col("new_users")
    fits: Sequence[Column] = [
        sk.agrees(F.col("users"), F.col("_users"), F.col("users")),
        sk.agrees(F.col("new_users"), F.col("_new"), F.col("new_users")),
        sk.agrees(returning, F.theta_difference("_users", "_new"), F.col("users"))]
    return exact.join(merged, by).select(by, "users", "new_users", returning.alias("returning_users"),
                                         (fits[0] & fits[1] & fits[2]).alias("within_bound"))


def class_overlap(customers: DataFrame, sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """One row: users of free mediums, of paid ones, of either and of both."""
    one = customers.join(classes, "medium").groupBy("o_custkey").agg(
        F.max(F.col("class") == "free").alias("free"), F.max(F.col("class") == "paid").alias("paid"))
    exact = one.agg(F.count_if("free").alias("free"), F.count_if("paid").alias("paid"),
                    F.count(F.lit(1)).alias("either"), F.count_if(F.col("free") & F.col("paid")).alias("both"))
    by_class = sk.merge_key_sketches(sketches.join(classes, "medium"), ["users"], ["class"])
    side = lambda c: F.max(F.when(F.col("class") == c, F.col("users"))).alias(f"_{c}")
    sets = by_class.agg(side("free"), side("paid"))
    either = F.theta_union("_free", "_paid")
    row = exact.select("*", sets.select("_free").scalar().alias("_free"),
                       sets.select("_paid").scalar().alias("_paid"))
    return row.select("free", "paid", "either", "both", (
        sk.agrees(F.col("free"), F.col("_free"), F.col("free"))
        & sk.agrees(F.col("paid"), F.col("_paid"), F.col("paid"))
        & sk.agrees(F.col("either"), either, F.col("either"))
        & sk.agrees(F.col("both"), F.theta_intersection("_free", "_paid"), F.col("either"))).alias("within_bound"))
