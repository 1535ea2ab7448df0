"""Registered queries: roll-ups from sketches, heavy levels, ranks over ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import register, shared
from tidemark.catalog_marts import cells, cm, country_or, lump_sql, msql, top_sql
from tidemark.catalog_paths import parsed, psql
from tidemark.operators import sketches as sk
from tidemark.operators.global_ranks import ordered_levels, ranked
from tidemark.operators.heavy import lump_heavy
from tidemark.plans import rollups
from tidemark.plans.mediums import top_countries
from tidemark.sources import testdata as td
from tidemark.sources.files import read_table


# --- sketches of the cells, kept like the marts ----------------------------------

def order_sketches(spark, sf):
    return shared(spark, sf, "order_value_sketches", lambda: sk.value_sketches(
        td.order_cells(spark, sf), "value", rollups.CELL))


def customers(spark, sf):
    return shared(spark, sf, "customer_cells", lambda: td.customer_cells(spark, sf))


def user_sketches(spark, sf):
    return shared(spark, sf, "user_sketches", lambda: rollups.user_sketches(customers(spark, sf)))


_QUARTILES = ("count(*) AS n, quantile_cont({v}, 0.25) AS q25, quantile_cont({v}, 0.5) AS median, "
              "quantile_cont({v}, 0.75) AS q75, true AS within_bound")

for _by in ("country", "medium"):
    register(f"agg12_order_value_by_{_by}", msql(
        f"SELECT {_by}, {_QUARTILES.format(v='o_totalprice')} FROM mc_rows GROUP BY {_by}"),
        {"q25": 4, "median": 4, "q75": 4})(
        lambda spark, sf, by=_by: rollups.order_value_quartiles(
            td.order_cells(spark, sf), by, order_sketches(spark, sf)))

    register(f"agg08_users_by_{_by}", msql(f"""
SELECT {_by}, count(DISTINCT o_custkey) AS users,
       count(DISTINCT CASE WHEN rn = 1 THEN o_custkey END) AS new_users,
       count(DISTINCT o_custkey) - count(DISTINCT CASE WHEN rn = 1 THEN o_custkey END) AS returning_users,
       true AS within_bound
FROM mc_rows GROUP BY {_by}"""))(
        lambda spark, sf, by=_by: rollups.users_by(customers(spark, sf), user_sketches(spark, sf), by))

register("agg08_free_paid_overlap", msql("""
SELECT CAST(count_if(free) AS BIGINT) AS free, CAST(count_if(paid) AS BIGINT) AS paid,
       count(*) AS either, CAST(count_if(free AND paid) AS BIGINT) AS both, true AS within_bound
FROM (SELECT o_custkey, bool_or(class = 'free') AS free, bool_or(class = 'paid') AS paid
      FROM mc_rows JOIN medium_class USING (medium) GROUP BY o_custkey)"""))(
    lambda spark, sf: rollups.class_overlap(
        customers(spark, sf), user_sketches(spark, sf),
        td.medium_class(customers(spark, sf).select("medium").distinct())))

register("agg15_rpt_spread_sketched", msql("""
SELECT medium, count(*) AS n, median(revenue_per_transaction) AS median_revenue_per_transaction,
       quantile_cont(revenue_per_transaction, 0.75) - quantile_cont(revenue_per_transaction, 0.25)
         AS iqr_revenue_per_transaction, true AS within_bound
FROM rl GROUP BY medium""", """
rl_in AS (SELECT medium, revenue / nullif(CAST(transactions AS DOUBLE), 0) AS revenue_per_transaction
          FROM cells)""", lump_sql("rl", "rl_in", "medium", 6, "revenue_per_transaction")),
    {"median_revenue_per_transaction": 4, "iqr_revenue_per_transaction": 4})(
    lambda spark, sf: rollups.rpt_spread_sketched(cells(spark, sf)))

register("agg12_median_share_sketched", msql("""
SELECT medium, count(*) AS n, median(revenue_share) AS median_revenue_share, true AS within_bound
FROM mrs GROUP BY medium""", f"""
mrs_in AS (
  SELECT country, CASE WHEN medium IN ('(none)', '(not set)') THEN 'unknown' ELSE medium END AS medium,
         revenue, revenue_share FROM cm
  WHERE country IN ({top_sql("country_or", "revenue", 50, "country")}))""",
    lump_sql("mrs", "mrs_in", "medium", 7, "revenue")), {"median_revenue_share": 6})(
    lambda spark, sf: rollups.median_share_sketched(
        cm(spark, sf), top_countries(country_or(spark, sf), "revenue", 50)))


# --- heavy levels -----------------------------------------------------------------

HEAVY_COUNTERS = 512

register("fct1_heavy_paths", psql("""
SELECT medium_path, count(*) AS n, CAST(sum(conversions) AS BIGINT) AS conversions
FROM hp GROUP BY medium_path""", lump_sql("hp", "(SELECT medium_path, conversions FROM cp_parsed)",
                                          "medium_path", 20, "conversions")))(
    lambda spark, sf: lump_heavy(parsed(spark, sf).select("medium_path", "conversions"), "medium_path", 20,
                                 "conversions", counters=HEAVY_COUNTERS).groupBy("medium_path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("conversions").cast("long").alias("conversions")))

# flat weights: the counters cannot prove the lump, the exact way is taken
register("fct2_heavy_parts", "WITH " + lump_sql("hp", """
(SELECT CAST(l_partkey AS VARCHAR) AS part, l_quantity FROM lineitem)""", "part", 10, "l_quantity",
    ties=False).strip() + """
SELECT part, count(*) AS n, sum(l_quantity) AS quantity FROM hp GROUP BY part""")(
    lambda spark, sf: lump_heavy(
        read_table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("part"), "l_quantity"),
        "part", 10, "l_quantity", with_ties=False, counters=HEAVY_COUNTERS).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")))


# --- ranks over ranges ------------------------------------------------------------

register("win_customer_ranks", """
WITH c AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)
SELECT o_custkey, n_orders,
       row_number() OVER (ORDER BY n_orders DESC NULLS LAST, o_custkey ASC NULLS LAST) AS row_number,
       rank() OVER (ORDER BY n_orders DESC NULLS LAST) AS rank,
       dense_rank() OVER (ORDER BY n_orders DESC NULLS LAST) AS dense_rank,
       percent_rank() OVER (ORDER BY n_orders DESC NULLS LAST) AS percent_rank,
       ntile(10) OVER (ORDER BY n_orders DESC NULLS LAST, o_custkey ASC NULLS LAST) AS ntile
FROM c""", {"percent_rank": 8})(
    lambda spark, sf: ranked(read_table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders")), "n_orders", ["o_custkey"], desc=True, ntile=10))

register("fct3_part_order", """
SELECT l_partkey, sum(l_quantity) AS quantity,
       row_number() OVER (ORDER BY sum(l_quantity) DESC NULLS LAST, l_partkey ASC NULLS LAST) AS l_partkey_order
FROM lineitem GROUP BY l_partkey""")(
    lambda spark, sf: ordered_levels(read_table(spark, sf, "lineitem"), "l_partkey", F.sum("l_quantity"),
                                     desc=True).withColumnRenamed("key", "quantity"))
