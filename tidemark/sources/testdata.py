"""Input builders over the shared test tables.

The analyses consume two exports — country x medium acquisition metrics and
conversion paths — that are derived here from the TPC-H-ish tables (orders,
customer, nation, lineitem) and the ``events`` stream.  Every builder exists
twice: as a lazy Spark plan and as a DuckDB SQL CTE used by the oracle checks.
The two must describe the same relation.

Scale notes
-----------
* ``medium_country``: lineitem (the largest table) is pre-aggregated per order
  with a partial + final hash aggregate before it meets orders, so only one row
  per order crosses the join.  Orders are folded to (cell, customer) rows; the
  customer's first order is the smallest of these rows' first orders.
* ``conversion_paths_raw``: each user's events are cut into journeys at every
  purchase.  The events are laid out in ranges of (user, ts, event_id), which
  follow the data, so one user with a third of all events spreads over many
  ranges and a burst in one second does too.  Purchases are numbered inside a
  range and prefixed over the ranges.  What follows a user's last purchase (all
  events of a user who never buys) is dropped before touches are assembled with
  ``collect_list`` + ``array_sort`` on (ts, event_id): the output row *is* the
  journey, so the group is the unit of output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import cents, ratio
from tidemark.sources.files import read_table
from tidemark.session import ensure_checkpoint_dir

# --- fixed values of the test-table mapping (FIXTURES.md §2) -----------------
NOT_SET = "(not set)"
NONE = "(none)"
COUNTRY_RECODE = {"NATION_0": NOT_SET}
MEDIUM_RECODE = {"MACHINERY/5": NONE, "MACHINERY/4": NOT_SET}
FREE_SEGMENTS = ("FURNITURE", "HOUSEHOLD")
PAID_SEGMENTS = ("AUTOMOBILE", "BUILDING")
ORDERS_AT_K1 = 15000  # orders at sf0.01; thresholds scale with count(orders)/15000
# -----------------------------------------------------------------------------


def _recode(col, mapping: dict[str, str]):
    expr = None
    for src, dst in mapping.items():
        expr = (F.when(col == src, F.lit(dst)) if expr is None
                else expr.when(col == src, F.lit(dst)))
    return expr.otherwise(col) if expr is not None else col


def medium_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country x medium acquisition metrics (one row per cell)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    # one row per order from lineitem; the day difference needs o_orderdate,
    # so it is summed after the join from per-line ship dates pre-aggregated
    # as (sum of ship day numbers, line count).
    day_no = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date"))
    lines = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").alias("qty"),
        F.sum(day_no.cast("long")).alias("ship_days"),
    )
    o_day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    enriched = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            _recode(F.col("n_name"), COUNTRY_RECODE).alias("country"),
            _recode(F.concat_ws("/", "c_mktsegment", F.substring("o_orderpriority", 1, 1)),
                    MEDIUM_RECODE).alias("medium"),
            "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice",
            F.coalesce("n_lines", F.lit(0)).alias("n"),
            F.coalesce("qty", F.lit(0.0)).alias("q"),
            (F.col("ship_days") / F.col("n_lines") - o_day).alias("dd"),
        )
    )
    done = F.col("o_orderstatus") == "F"
    # two-level aggregate instead of two DISTINCT counts (which would make
    # Spark expand every order row once per distinct aggregate before the
    # shuffle): first per (cell, customer), then per cell.  Every measure is
    # a sum or count, so both levels fold map-side and a hot customer or cell
    # is pre-aggregated inside each task.
    per_customer = enriched.groupBy("country", "medium", "o_custkey").agg(
        F.min(F.struct("o_orderdate", "o_orderkey")).alias("earliest"),
        F.count(F.lit(1)).alias("orders"),
        F.sum("n").alias("n"),
        F.sum(F.when(done, F.lit(1)).otherwise(F.lit(0))).alias("tx"),
        F.sum(F.when(done, F.col("o_totalprice"))).alias("rev"),
        F.sum((F.col("n") <= 1).cast("int")).alias("bounces"),
        F.sum("q").alias("q"),
        F.sum("dd").alias("dd_sum"),
        F.count("dd").alias("dd_n"),
    )
    # a customer has one row for each cell: the first order is in one of them
    mine = Window.partitionBy("o_custkey")
    per_customer = per_customer.withColumn(
        "first", (F.col("earliest") == F.min("earliest").over(mine)).cast("int"))
    agg = per_customer.groupBy("country", "medium").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("first").alias("new_users"),
        F.sum("n").cast("long").alias("sessions"),
        F.sum("tx").cast("long").alias("transactions"),
        cents(F.coalesce(F.sum("rev"), F.lit(0.0))).alias("revenue"),
        ratio(F.sum("bounces"), F.sum("orders")).alias("bounce_rate"),
        ratio(F.sum("q"), F.sum("n")).alias("pages_session"),
        ratio(F.sum("dd_sum"), F.sum("dd_n")).alias("avg_session_duration"),
        ratio(F.sum("tx"), F.sum("n")).alias("ecommerce_conversion_rate"),
    )
    return agg.select(
        "country", "medium",
        F.col("users").cast("long").alias("users"),
        F.col("new_users").cast("long").alias("new_users"),
        "sessions", "transactions", "revenue", "bounce_rate", "pages_session",
        "avg_session_duration", "ecommerce_conversion_rate",
    )


MEDIUM_COUNTRY_SQL = """
mc_lines AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty,
         avg(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS ship_day
  FROM lineitem GROUP BY l_orderkey),
mc_orders AS (
  SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders o),
mc_rows AS (
  SELECT CASE WHEN n_name = 'NATION_0' THEN '(not set)' ELSE n_name END AS country,
         CASE c_mktsegment || '/' || substr(o_orderpriority, 1, 1)
              WHEN 'MACHINERY/5' THEN '(none)' WHEN 'MACHINERY/4' THEN '(not set)'
              ELSE c_mktsegment || '/' || substr(o_orderpriority, 1, 1) END AS medium,
         o_custkey, rn, o_orderstatus, o_totalprice,
         coalesce(n_lines, 0) AS n, coalesce(qty, 0.0) AS q,
         ship_day - date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS dd
  FROM mc_orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN mc_lines ON o_orderkey = l_orderkey),
medium_country AS (
  SELECT country, medium,
         CAST(count(DISTINCT o_custkey) AS BIGINT) AS users,
         CAST(count(DISTINCT CASE WHEN rn = 1 THEN o_custkey END) AS BIGINT) AS new_users,
         CAST(sum(n) AS BIGINT) AS sessions,
         CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS BIGINT) AS transactions,
         floor(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0.0) * 100.0 + 0.5) / 100.0 AS revenue,
         avg(CASE WHEN n <= 1 THEN 1.0 ELSE 0.0 END) AS bounce_rate,
         sum(q) / nullif(CAST(sum(n) AS DOUBLE), 0) AS pages_session,
         avg(dd) AS avg_session_duration,
         CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS DOUBLE)
           / nullif(CAST(sum(n) AS DOUBLE), 0) AS ecommerce_conversion_rate
  FROM mc_rows GROUP BY country, medium)
"""


def conversion_paths_raw(spark: SparkSession, sf_dir: str,
                         ranges: int | None = None) -> DataFrame:
    """Raw conversion-path export: medium_path, conversions (double), value text.

    The narrow events are written once, laid out in ranges (``ranges`` of them,
    else as many as Spark's shuffle has partitions); runs a job when called."""
    ensure_checkpoint_dir(spark)
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props")
    is_p = F.col("event_type") == "purchase"
    k = F.get_json_object("props", "$.k").cast("long")
    ev = ev.select("user_id", "ts", "event_id", "value", is_p.alias("is_p"),
                   F.concat(F.col("event_type"), F.lit("-"), (k % 3).cast("string"))
                   .alias("channel"))
    order = ["user_id", "ts", "event_id"]
    laid = ev.repartitionByRange(ranges, *order) if ranges else ev.repartitionByRange(*order)
    # the range id is a physical partition id: written with the rows, so that
    # both uses below read the same one
    ev = laid.withColumn("part", F.spark_partition_id()).checkpoint(eager=True)
    purchases = ev.groupBy("user_id", "part").agg(F.sum(F.col("is_p").cast("long")).alias("bp"))
    whole = Window.partitionBy("user_id")
    prior = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = purchases.select("user_id", "part", F.sum("bp").over(whole).alias("total"),
                               F.coalesce(F.sum("bp").over(prior), F.lit(0)).alias("off"))
    before = (Window.partitionBy("user_id", "part").orderBy("ts", "event_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    tagged = (ev.join(offsets.filter("total > 0"), ["user_id", "part"])
              .withColumn("j", F.col("off") + F.coalesce(
                  F.sum(F.col("is_p").cast("int")).over(before), F.lit(0)))
              .filter("j < total"))
    journeys = tagged.groupBy("user_id", "j").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_p"), F.struct(
            "ts", "event_id", "channel")))).alias("touches"),
        F.max(F.when(F.col("is_p"), F.col("event_id"))).alias("pid"),
        F.max(F.when(F.col("is_p"), F.col("value"))).alias("pval"))
    path = F.array_join(F.transform("touches", lambda t: t["channel"]), " > ")
    amount = F.round(F.greatest(F.col("pval") - 1, F.lit(0.0)) * 100, 2)
    return journeys.select(
        F.when(F.size("touches") > 0, path).otherwise(F.lit(NONE)).alias("medium_path"),
        F.when(F.col("pid") % 17 == 0, F.lit(3.0)).otherwise(F.lit(1.0)).alias("conversions"),
        F.concat(F.lit("EUR "), F.format_number(amount, 2)).alias("value"),
    )


CONVERSION_PATHS_RAW_SQL = """
cp_ev AS (
  SELECT user_id, ts, event_id, value, event_type = 'purchase' AS is_p,
         event_type || '-' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS VARCHAR) AS channel
  FROM events),
cp_tag AS (
  SELECT *, coalesce(sum(CASE WHEN is_p THEN 1 ELSE 0 END) OVER (
           PARTITION BY user_id ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS j
  FROM cp_ev),
cp_grp AS (
  SELECT user_id, j,
         string_agg(CASE WHEN NOT is_p THEN channel END, ' > ' ORDER BY ts, event_id) AS path,
         max(CASE WHEN is_p THEN event_id END) AS pid,
         max(CASE WHEN is_p THEN value END) AS pval,
         bool_or(is_p) AS has_p
  FROM cp_tag GROUP BY user_id, j),
conversion_paths_raw AS (
  SELECT coalesce(path, '(none)') AS medium_path,
         CAST(CASE WHEN pid % 17 = 0 THEN 3 ELSE 1 END AS DOUBLE) AS conversions,
         'EUR ' || format('{:,.2f}', round(greatest(pval - 1, 0) * 100, 2)) AS value
  FROM cp_grp WHERE has_p)
"""


ORDER_SCALE_SQL = "(SELECT count(*) / 15000.0 FROM orders)"


# --- dimensions (FIXTURES.md §2, "Dimensions") -------------------------------

def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their cell: country, medium, o_custkey, o_orderkey,
    o_orderdate, value."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(_recode(F.col("n_name"), COUNTRY_RECODE).alias("country"),
                    _recode(F.concat_ws("/", "c_mktsegment", F.substring("o_orderpriority", 1, 1)),
                            MEDIUM_RECODE).alias("medium"),
                    "o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("value")))


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer of a cell: country, medium, o_custkey, is_new
    (the customer's first order is in the cell)."""
    rows = order_cells(spark, sf_dir).groupBy("country", "medium", "o_custkey").agg(
        F.min(F.struct("o_orderdate", "o_orderkey")).alias("earliest"))
    mine = Window.partitionBy("o_custkey")  # at most one row for each of the customer's cells
    return rows.select("country", "medium", "o_custkey",
                       (F.col("earliest") == F.min("earliest").over(mine)).alias("is_new"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    customers = read_table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n_customers"))
    return (nation.join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
            .select("n_nationkey", "n_regionkey",
                    _recode(F.col("n_name"), COUNTRY_RECODE).alias("country"),
                    F.coalesce("n_customers", F.lit(0)).cast("long").alias("n_customers")))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: (country, population) with population = 1000 x customers."""
    return _nations(spark, sf_dir).select(
        "country", (F.col("n_customers") * 1000).alias("population"))


# fixed values: the one tourism slice the analysis reads
TOURISM_SLICE = {"duration": "1 night or over", "c_dest": "All countries of the world",
                 "unit": "Number", "time": "2021-01-01"}


def geo_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code dictionary of the tourism fact: (geo code, country label)."""
    return _nations(spark, sf_dir).select(
        F.format_string("G%02d", F.col("n_nationkey")).alias("geo"), "country")


def tourism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6 input: a small coded fact (geo, duration, c_dest, unit, time,
    values) with several slices; only nations outside region 0 appear, so the
    analysis's left join has misses.  The analysed slice holds 100 x
    customers; ``geo`` is a code resolved through ``geo_codes``."""
    slices = F.array(*[
        F.struct(F.lit(d).alias("duration"), F.lit(t).alias("time"), F.lit(m).alias("mult"))
        for d, t, m in (("1 night or over", "2021-01-01", 100.0),
                        ("1 night or over", "2020-01-01", 90.0),
                        ("4 nights or over", "2021-01-01", 40.0))])
    nat = _nations(spark, sf_dir).filter(F.col("n_regionkey") != 0)
    ex = nat.select("n_nationkey", "n_customers", F.explode(slices).alias("s"))
    return ex.select(
        F.format_string("G%02d", F.col("n_nationkey")).alias("geo"),
        F.col("s.duration").alias("duration"),
        F.lit("All countries of the world").alias("c_dest"), F.lit("Number").alias("unit"),
        F.to_date(F.col("s.time")).alias("time"),
        (F.col("n_customers") * F.col("s.mult")).alias("values"))


def tourists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6: the analysed slice as (country, tourists).  The slice filter is
    applied to the fact (it reaches the scan of a stored fact as pushed
    predicates) and the codes are replaced by labels through the dictionary."""
    t = tourism(spark, sf_dir)
    s = TOURISM_SLICE
    labels = geo_codes(spark, sf_dir)
    return (t.filter((F.col("duration") == s["duration"]) & (F.col("c_dest") == s["c_dest"])
                     & (F.col("unit") == s["unit"]) & (F.col("time") == F.to_date(F.lit(s["time"]))))
            .join(labels, "geo")
            .select("country", F.col("values").alias("tourists")))


def medium_class(mediums: DataFrame) -> DataFrame:
    """(medium, class) for the mediums present in ``mediums`` (any table with
    a ``medium`` column, e.g. the mart): segments FURNITURE/HOUSEHOLD are
    free, AUTOMOBILE/BUILDING paid, the rest unclassed.  Built from the
    already-aggregated mart, so no fact table is scanned for it."""
    seg = F.substring_index(F.col("medium"), "/", 1)
    return (mediums.select("medium").distinct()
            .filter(seg.isin(*FREE_SEGMENTS, *PAID_SEGMENTS))
            .select("medium", F.when(seg.isin(*FREE_SEGMENTS), F.lit("free"))
                    .otherwise(F.lit("paid")).alias("class")))


def peer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, peer_country): each nation with the next nation key in its region."""
    nat = _nations(spark, sf_dir)
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return (nat.withColumn("peer_country", F.lead("country").over(w))
            .filter(F.col("peer_country").isNotNull()).select("country", "peer_country"))


DIMENSIONS_SQL = """
dim_nations AS (
  SELECT n_nationkey, n_regionkey,
         CASE WHEN n_name = 'NATION_0' THEN '(not set)' ELSE n_name END AS country,
         CAST(coalesce(nc, 0) AS BIGINT) AS n_customers
  FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY 1) c
    ON n_nationkey = c_nationkey),
population AS (SELECT country, n_customers * 1000 AS population FROM dim_nations),
tourists AS (SELECT country, CAST(n_customers * 100 AS DOUBLE) AS tourists FROM dim_nations WHERE n_regionkey <> 0),
medium_class AS (
  SELECT medium, CASE WHEN split_part(medium, '/', 1) IN ('FURNITURE', 'HOUSEHOLD') THEN 'free' ELSE 'paid' END AS class
  FROM (SELECT DISTINCT medium FROM medium_country)
  WHERE split_part(medium, '/', 1) IN ('FURNITURE', 'HOUSEHOLD', 'AUTOMOBILE', 'BUILDING')),
peer_pairs AS (
  SELECT country, peer_country FROM (
    SELECT country, lead(country) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS peer_country
    FROM dim_nations) WHERE peer_country IS NOT NULL)
"""
