"""Registered country / country x medium queries (MK1-MK35) with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import K_SQL, k_scale, register, shared
from tidemark.plans import markets as mk
from tidemark.plans import marts
from tidemark.plans import mediums as md
from tidemark.sources import testdata as td
from tidemark.sources.files import read_table
from tidemark.operators.resample import replicates_not_greater
from tidemark.operators.stats import exact_quantiles, prob_grid

# --- thresholds at k = 1 -------------
KEEP = dict(revenue=45e6, users=230, transactions=185)
MIN_TX_CONVERSION_VIEW = 150
LOW_MEDIUM = dict(revenue=1.2e6, users=9, transactions=6)
FREE_MIN_SESSIONS, PAID_MAX_SESSIONS = 950, 1000
CELL_MIN_REVENUE, CELL_MIN_TX = 1e6, 5
# -------------------------------------------------------------------------------

RATES = ("bounce_rate", "pages_session", "avg_session_duration", "ecommerce_conversion_rate")
MART_DIGITS = {"revenue": 2, **{r: 6 for r in RATES}, "revenue_per_transaction": 4,
               "new_users_share": 6}
CM_DIGITS = {**{c: d for c, d in MART_DIGITS.items()
                if c not in ("revenue_per_transaction", "new_users_share")}, **{f"{c}_country": d for c, d in MART_DIGITS.items()},
             **{f"{m}_share": 6 for m in ("revenue", "users", "new_users", "sessions",
                                          "transactions")}}


# --- Spark inputs ----------------------------------------------------------------

def mc(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "medium_country", lambda: td.medium_country(spark, sf))


def country_all(spark, sf):
    return shared(spark, sf, "country_all", lambda: marts.country_mart(mc(spark, sf)))


def country_and(spark, sf):
    k = k_scale(spark, sf)
    return shared(spark, sf, "country_and", lambda: country_all(spark, sf).filter(
        marts.keep_rule(KEEP["revenue"] * k, KEEP["users"] * k, KEEP["transactions"] * k,
                        "and")))


def country_or(spark, sf):
    k = k_scale(spark, sf)
    return shared(spark, sf, "country_or", lambda: country_all(spark, sf).filter(
        marts.keep_rule(KEEP["revenue"] * k, KEEP["users"] * k, KEEP["transactions"] * k,
                        "or")))


def cm_full(spark, sf):
    return marts.country_medium_mart(mc(spark, sf), country_or(spark, sf))


def cm_flag(spark, sf):
    k = k_scale(spark, sf)
    return shared(spark, sf, "cm_flag", lambda: marts.flag_low_volume_mediums(
        cm_full(spark, sf), LOW_MEDIUM["revenue"] * k, LOW_MEDIUM["users"] * k,
        LOW_MEDIUM["transactions"] * k))


def cm(spark, sf):
    return marts.drop_low_volume_mediums(cm_flag(spark, sf))


def cells(spark, sf):
    k = k_scale(spark, sf)
    return md.big_cells(cm(spark, sf), CELL_MIN_REVENUE * k, CELL_MIN_TX * k)


# --- SQL inputs ------------------------------------------------------------------

_VOL = ("users", "new_users", "sessions", "transactions")
_ALL_MART = (*_VOL, "revenue", *RATES, "revenue_per_transaction", "new_users_share")
_SHARES = ("revenue", "users", "new_users", "sessions", "transactions")

MART_SQL = f"""
country_all AS (
  SELECT country,
         {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _VOL)},
         floor(sum(revenue) * 100.0 + 0.5) / 100.0 AS revenue,
         {", ".join(f"avg({r}) AS {r}" for r in RATES)},
         (floor(sum(revenue) * 100.0 + 0.5) / 100.0) / nullif(CAST(sum(transactions) AS DOUBLE), 0) AS revenue_per_transaction,
         CAST(sum(new_users) AS DOUBLE) / nullif(CAST(sum(users) AS DOUBLE), 0) AS new_users_share
  FROM medium_country GROUP BY country),
country_and AS (
  SELECT * FROM country_all WHERE revenue > {KEEP['revenue']} * {K_SQL}
     AND users > {KEEP['users']} * {K_SQL} AND transactions > {KEEP['transactions']} * {K_SQL}),
country_or AS (
  SELECT * FROM country_all WHERE revenue > {KEEP['revenue']} * {K_SQL}
     OR users > {KEEP['users']} * {K_SQL} OR transactions > {KEEP['transactions']} * {K_SQL}),
cm_full AS (
  SELECT m.*,
         {", ".join(f"b.{c} AS {c}_country" for c in _ALL_MART)},
         {", ".join(f"CAST(m.{c} AS DOUBLE) / nullif(CAST(b.{c} AS DOUBLE), 0) AS {c}_share" for c in _SHARES)},
         {", ".join(f"dense_rank() OVER (PARTITION BY m.country ORDER BY m.{c} DESC NULLS LAST) AS {c}_channel_within_country_rank" for c in ("users", "new_users", "sessions", "transactions", "revenue"))}
  FROM medium_country m JOIN country_or b ON m.country = b.country),
cm_flag AS (
  SELECT *, (revenue < {LOW_MEDIUM['revenue']} * {K_SQL} AND users < {LOW_MEDIUM['users']} * {K_SQL}
             AND transactions < {LOW_MEDIUM['transactions']} * {K_SQL}) AS is_low_volume_medium
  FROM cm_full),
cm AS (SELECT * EXCLUDE (is_low_volume_medium) FROM cm_flag WHERE NOT is_low_volume_medium),
cells AS (SELECT * FROM cm WHERE revenue > {CELL_MIN_REVENUE} * {K_SQL} AND transactions > {CELL_MIN_TX} * {K_SQL})
"""


def msql(body: str, *extra: str) -> str:
    from tidemark.sources.testdata import DIMENSIONS_SQL, MEDIUM_COUNTRY_SQL
    parts = [MEDIUM_COUNTRY_SQL.strip().rstrip(","), DIMENSIONS_SQL.strip().rstrip(","),
             MART_SQL.strip().rstrip(",")] + [e.strip().rstrip(",") for e in extra]
    return "WITH " + ",\n".join(parts) + "\n" + body


def top_sql(table: str, metric: str, n: int, cols: str = "*") -> str:
    """slice_max with ties kept, in SQL."""
    return (f"SELECT {cols} FROM {table} WHERE {metric} >= (SELECT min({metric}) FROM "
            f"(SELECT {metric} FROM {table} WHERE {metric} IS NOT NULL "
            f"ORDER BY {metric} DESC LIMIT {n}))")


def lump_sql(name: str, table: str, f: str, n: int, w: str | None, out: str | None = None,
             ties: bool = True) -> str:
    """fct_lump(f, n, w) as CTEs; the last CTE ``name`` has ``out`` (= f)."""
    out = out or f
    weight = f"sum({w})" if w else "count(*)"
    rank = (f"rank() OVER (ORDER BY tw DESC NULLS LAST)" if ties else
            f"row_number() OVER (ORDER BY tw DESC NULLS LAST, {f} ASC NULLS LAST)")
    return f"""
{name}_lv AS (SELECT {f}, {weight} AS tw FROM {table} GROUP BY {f}),
{name}_rk AS (SELECT {f}, {rank} AS r FROM {name}_lv),
{name} AS (
  SELECT t.* {"EXCLUDE (" + f + ")" if out == f else ""},
         CASE WHEN (SELECT count(*) FROM {name}_rk WHERE r > {n}) <= 1 OR rk.r <= {n}
                   OR t.{f} IS NULL THEN t.{f} ELSE 'Other' END AS {out}
  FROM {table} t LEFT JOIN {name}_rk rk ON t.{f} = rk.{f})
"""


# ==================================================================================
# MK1-MK3 country mart
# ==================================================================================

@register("mk01_country_mart", msql("SELECT * FROM country_all"), MART_DIGITS)
def q_mk01(spark, sf):
    return country_all(spark, sf)


@register("mk01_country_mart_median", msql(
    f"""SELECT country, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _VOL)},
       floor(sum(revenue) * 100.0 + 0.5) / 100.0 AS revenue, {", ".join(f"median({r}) AS {r}" for r in RATES)},
       (floor(sum(revenue) * 100.0 + 0.5) / 100.0) / nullif(CAST(sum(transactions) AS DOUBLE), 0) AS revenue_per_transaction,
       CAST(sum(new_users) AS DOUBLE) / nullif(CAST(sum(users) AS DOUBLE), 0) AS new_users_share
    FROM medium_country GROUP BY country"""), MART_DIGITS)
def q_mk01_median(spark, sf):
    return marts.country_mart(mc(spark, sf), rate_agg="median")


@register("mk02_low_volume_impact", msql(f"""
SELECT too_low_volume, n_countries, revenue,
       round(revenue / sum(revenue) OVER (), 3) AS perc_revenue,
       round(n_countries / sum(n_countries) OVER (), 3) AS perc_countries
FROM (SELECT (revenue <= {KEEP['revenue']} * {K_SQL} OR users <= {KEEP['users']} * {K_SQL}
              OR transactions <= {KEEP['transactions']} * {K_SQL}) AS too_low_volume,
             count(*) AS n_countries, sum(revenue) AS revenue
      FROM country_all GROUP BY 1)"""), {"revenue": 2})
def q_mk02(spark, sf):
    k = k_scale(spark, sf)
    return marts.low_volume_impact(country_all(spark, sf), KEEP["revenue"] * k,
                                   KEEP["users"] * k, KEEP["transactions"] * k)


@register("mk03_keep_and", msql("SELECT * FROM country_and"), MART_DIGITS)
def q_mk03_and(spark, sf):
    return country_and(spark, sf)


@register("mk03_keep_or", msql("SELECT * FROM country_or"), MART_DIGITS)
def q_mk03_or(spark, sf):
    return country_or(spark, sf)


# ==================================================================================
# MK4-MK11, MK34, MK35 candidate markets (country document: AND-kept mart)
# ==================================================================================

def _grid_sql(table: str, metrics, probs) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{m}' AS metric, CAST({p!r} AS DOUBLE) AS prob, "
        f"quantile_cont(CAST({m} AS DOUBLE), {p!r}) AS value FROM {table}"
        for m in metrics for p in probs)


@register("mk04_quantile_grid", msql(_grid_sql("country_all", ("users", "transactions", "revenue"),
                                               prob_grid(0, 1, 0.05))),
          {"prob": 6, "value": 4})
def q_mk04(spark, sf):
    return mk.metric_quantiles(country_all(spark, sf))


@register("mk05_revenue_tiers", msql(
    "SELECT country, revenue, ntile(7) OVER (ORDER BY revenue ASC NULLS LAST, country ASC NULLS LAST)"
    " AS revenue_ntile FROM country_and"), {"revenue": 2})
def q_mk05(spark, sf):
    return mk.revenue_tiers(country_and(spark, sf))


@register("mk05_geo_unmatched", msql(
    "SELECT country FROM country_all WHERE country NOT IN (SELECT n_name FROM nation)"))
def q_mk05_geo(spark, sf):
    geo = read_table(spark, sf, "nation").select(F.col("n_name").alias("country"))
    return mk.unmatched_countries(country_all(spark, sf), geo)


for _m, _d in (("users", None), ("new_users", None), ("transactions", None),
               ("revenue", 2), ("ecommerce_conversion_rate", 6)):
    register(f"mk06_top_drivers_{_m}",
             msql(top_sql("country_and", _m, 30, f"country, {_m}")),
             {_m: _d} if _d else None)(
        (lambda m: lambda spark, sf: mk.top_drivers(country_and(spark, sf), m))(_m))


@register("mk07_head_of_market", msql(
    "SELECT * FROM country_and WHERE country <> '(not set)' ORDER BY revenue DESC NULLS LAST,"
    " users DESC NULLS LAST, ecommerce_conversion_rate DESC NULLS LAST,"
    " transactions DESC NULLS LAST, country LIMIT 12"), MART_DIGITS)
def q_mk07(spark, sf):
    return mk.head_of_market(country_and(spark, sf))


_CONV_VIEW_SQL = f"""
conv_view AS (
  SELECT country, round(ecommerce_conversion_rate, 4) AS ecommerce_conversion_rate,
         CAST(trunc(revenue_per_transaction) AS BIGINT) AS revenue_per_transaction,
         CAST(trunc(revenue_per_transaction - avg(revenue_per_transaction) OVER ()) AS BIGINT)
           AS diff_to_mean_revenue_per_transaction,
         users, new_users, transactions, revenue, sessions
  FROM country_and
  WHERE country <> '(not set)' AND transactions > {MIN_TX_CONVERSION_VIEW} * {K_SQL}),
conv_ranked AS (
  SELECT *, percent_rank() OVER (ORDER BY ecommerce_conversion_rate DESC NULLS LAST) AS pr
  FROM conv_view)
"""


@register("mk08_high_conv_high_value", msql("""
SELECT * EXCLUDE (pr), pr <= 0.5 AS is_top_converting_country,
       diff_to_mean_revenue_per_transaction > 0 AS is_rev_per_trans_higher_than_avg
FROM conv_ranked WHERE pr <= 0.5 AND diff_to_mean_revenue_per_transaction > 0""", _CONV_VIEW_SQL),
          {"revenue": 2, "ecommerce_conversion_rate": 6})
def q_mk08(spark, sf):
    return mk.high_conversion_high_value(country_and(spark, sf),
                                         MIN_TX_CONVERSION_VIEW * k_scale(spark, sf))


@register("mk09_low_conv_high_traffic", msql("""
SELECT * EXCLUDE (pr), pr >= 0.75 AS is_bottom_converting_country,
       diff_to_mean_revenue_per_transaction > 0 AS is_rev_per_trans_higher_than_avg
FROM conv_ranked WHERE pr >= 0.75 ORDER BY users DESC NULLS LAST, country LIMIT 3""",
                                          _CONV_VIEW_SQL),
          {"revenue": 2, "ecommerce_conversion_rate": 6})
def q_mk09(spark, sf):
    return mk.low_conversion_high_traffic(country_and(spark, sf),
                                          MIN_TX_CONVERSION_VIEW * k_scale(spark, sf))


_PEN_SQL = f"""
pen_cust AS ({top_sql("(SELECT * FROM country_and WHERE country <> '(not set)')", "transactions", 30,
                      "country, transactions AS customers, revenue, revenue_per_transaction")}),
penetration AS (
  SELECT c.country, c.customers, round_even(t.tourists, 0) AS tourists,
         CAST(floor(1.0 / nullif(c.customers / t.tourists, 0)) AS BIGINT) AS one_in_n_tourists_has_transacted,
         round(c.customers / t.tourists, 5) AS customers_share,
         round_even(c.revenue, 0) AS revenue,
         round_even(c.revenue_per_transaction, 0) AS revenue_per_transaction
  FROM pen_cust c LEFT JOIN population p ON c.country = p.country
       LEFT JOIN tourists t ON c.country = t.country
  WHERE t.tourists IS NOT NULL)
"""


def penetration(spark, sf):
    return mk.market_penetration(country_and(spark, sf), td.population(spark, sf),
                                 td.tourists(spark, sf))


@register("mk10_market_penetration", msql("SELECT * FROM penetration", _PEN_SQL),
          {"customers_share": 6})
def q_mk10(spark, sf):
    return penetration(spark, sf)


@register("mk10_penetration_all", msql(f"""
SELECT c.country, c.customers, CAST(p.population AS BIGINT) AS population,
       round_even(t.tourists, 0) AS tourists,
       CAST(floor(1.0 / nullif(c.customers / t.tourists, 0)) AS BIGINT) AS one_in_n_tourists_has_transacted,
       round(c.customers / t.tourists, 5) AS customers_share,
       round_even(c.revenue, 0) AS revenue,
       round_even(c.revenue_per_transaction, 0) AS revenue_per_transaction
FROM pen_cust c LEFT JOIN population p ON c.country = p.country
     LEFT JOIN tourists t ON c.country = t.country""", _PEN_SQL), {"customers_share": 6})
def q_mk10_all(spark, sf):
    """MK10 before the matched-only cut, with the population."""
    return mk.market_penetration(country_and(spark, sf), td.population(spark, sf),
                                 td.tourists(spark, sf), matched_only=False)


_UPLIFT_SQL = """
uplift AS (
  SELECT pp.peer_country, pp.country, me.customers, me.tourists, me.customers_share, me.revenue,
         me.revenue_per_transaction, peer.customers_share AS target_share,
         CAST(floor(peer.customers_share * me.tourists) AS BIGINT) AS potential_customers,
         me.revenue_per_transaction * floor(peer.customers_share * me.tourists) AS potential_revenue,
         me.revenue_per_transaction * floor(peer.customers_share * me.tourists) - me.revenue AS revenue_increase,
         (me.revenue_per_transaction * floor(peer.customers_share * me.tourists) - me.revenue)
           / nullif(me.revenue, 0) AS revenue_uplift
  FROM peer_pairs pp JOIN penetration me ON pp.country = me.country
       JOIN penetration peer ON pp.peer_country = peer.country
  WHERE peer.customers_share > me.customers_share)
"""


def uplift_df(spark, sf):
    return mk.uplift(penetration(spark, sf), td.peer_pairs(spark, sf))


@register("mk11_uplift", msql("SELECT * FROM uplift", _PEN_SQL, _UPLIFT_SQL),
          {"customers_share": 6, "target_share": 6, "potential_revenue": 2,
           "revenue_increase": 2, "revenue_uplift": 6})
def q_mk11(spark, sf):
    return uplift_df(spark, sf)


@register("mk35_one_country", msql(
    "SELECT * FROM medium_country WHERE country = 'NATION_1' ORDER BY revenue DESC"),
          {"revenue": 2, **{r: 6 for r in RATES}})
def q_mk35(spark, sf):
    return mk.one_country(mc(spark, sf), "NATION_1")


# ==================================================================================
# MK12-MK14 country x medium mart
# ==================================================================================

@register("mk12_country_medium_mart", msql("SELECT * FROM cm_full"), CM_DIGITS)
def q_mk12(spark, sf):
    return cm_full(spark, sf)


@register("mk13_low_volume_mediums", msql("""
SELECT is_low_volume_medium, n, round(n / sum(n) OVER (), 3) AS perc
FROM (SELECT is_low_volume_medium, count(*) AS n FROM cm_flag GROUP BY 1)"""))
def q_mk13(spark, sf):
    return marts.low_volume_medium_counts(cm_flag(spark, sf))


@register("mk13_clean_mart", msql("SELECT * FROM cm"), CM_DIGITS)
def q_mk13_clean(spark, sf):
    return cm(spark, sf)


@register("mk14_mediums_per_country", msql("""
SELECT country, is_low_volume_medium, n_mediums, n_mediums_total FROM mpc_l
WHERE country_lumped <> 'Other'""", """
mpc AS (
  SELECT country, is_low_volume_medium, n_mediums,
         CAST(sum(n_mediums) OVER (PARTITION BY country) AS BIGINT) AS n_mediums_total
  FROM (SELECT country, is_low_volume_medium, count(DISTINCT medium) AS n_mediums
        FROM cm_flag GROUP BY 1, 2))""", lump_sql("mpc_l", "mpc", "country", 20, "n_mediums_total",
                                                   out="country_lumped", ties=False)))
def q_mk14(spark, sf):
    return marts.mediums_per_country(cm_flag(spark, sf))


@register("mk14_flag_order", msql("""
SELECT country, is_low_volume_medium, n_mediums, n_mediums_total,
       CASE WHEN is_low_volume_medium THEN 1 ELSE 2 END AS flag_order
FROM mpc_l WHERE country_lumped <> 'Other'""", """
mpc AS (
  SELECT country, is_low_volume_medium, n_mediums,
         CAST(sum(n_mediums) OVER (PARTITION BY country) AS BIGINT) AS n_mediums_total
  FROM (SELECT country, is_low_volume_medium, count(DISTINCT medium) AS n_mediums
        FROM cm_flag GROUP BY 1, 2))""", lump_sql("mpc_l", "mpc", "country", 20, "n_mediums_total",
                                                   out="country_lumped", ties=False)))
def q_mk14_order(spark, sf):
    """FCT4: the flag as an ordered level, TRUE first."""
    from tidemark.operators.factors import bool_level_order
    return marts.mediums_per_country(cm_flag(spark, sf)).withColumn(
        "flag_order", bool_level_order("is_low_volume_medium"))


# ==================================================================================
# MK15-MK33 medium profiles (country x medium document: OR-kept country mart)
# ==================================================================================

def _profile_sql(metric: str, share: bool, n_countries=20, n_mediums=6, unknown=False) -> str:
    value = f"{metric}_share" if share else metric
    med = ("CASE WHEN medium IN ('(none)', '(not set)') THEN 'unknown' ELSE medium END"
           if unknown else "medium")
    base = f"""
pf_base AS (
  SELECT country, {med} AS medium, {value}{f", {metric}, {metric}_country" if share else ""} FROM cm
  WHERE country IN ({top_sql("country_or", metric, n_countries, "country")})
    AND country <> '(not set)')"""
    agg = (f"CAST(sum({metric}) AS DOUBLE) / nullif(CAST(max({metric}_country) AS DOUBLE), 0)"
           if share else f"sum({value})" if metric == "revenue" else f"CAST(sum({value}) AS BIGINT)")
    return msql(f"SELECT country, medium, {agg} AS {value} FROM pf GROUP BY country, medium",
                base, lump_sql("pf", "pf_base", "medium", n_mediums, value))


for _m in md.METRICS:
    register(f"mk15_profile_abs_{_m}", _profile_sql(_m, False),
             {"revenue": 2} if _m == "revenue" else None)(
        (lambda m: lambda spark, sf: md.profile(cm(spark, sf), country_or(spark, sf), m))(_m))
    register(f"mk16_profile_share_{_m}", _profile_sql(_m, True), {f"{_m}_share": 6})(
        (lambda m: lambda spark, sf: md.profile(cm(spark, sf), country_or(spark, sf), m,
                                                share=True))(_m))

register("mk24_unknown_profile_revenue", _profile_sql("revenue", False, n_mediums=5, unknown=True),
         {"revenue": 2})(
    lambda spark, sf: md.profile(cm(spark, sf), country_or(spark, sf), "revenue", n_mediums=5,
                                 unknown=True))
register("mk24_unknown_profile_revenue_share",
         _profile_sql("revenue", True, n_mediums=6, unknown=True), {"revenue_share": 6})(
    lambda spark, sf: md.profile(cm(spark, sf), country_or(spark, sf), "revenue", n_mediums=6,
                                 share=True, unknown=True))


def _median_table_sql() -> str:
    ctes = []
    for m in md.METRICS:
        ctes.append(f"""
med_{m}_all AS (
  SELECT medium, median({m}_share) AS median_{m}_share FROM cm
  WHERE country IN ({top_sql("country_or", m, 20, "country")}) GROUP BY medium),
med_{m} AS ({top_sql(f"med_{m}_all", f"median_{m}_share", 20)})""")
    first = md.METRICS[0]
    joins = " ".join(f"LEFT JOIN med_{m} USING (medium)" for m in md.METRICS[1:])
    return msql(f"SELECT * FROM med_{first} {joins}", *ctes)


@register("mk17_median_share_table", _median_table_sql(),
          {f"median_{m}_share": 6 for m in md.METRICS})
def q_mk17(spark, sf):
    return md.median_share_table(cm(spark, sf), country_or(spark, sf))


@register("mk18_free_paid_classes", msql(
    "SELECT cm.country, cm.medium, mc2.class FROM cm JOIN medium_class mc2 ON cm.medium = mc2.medium"))
def q_mk18(spark, sf):
    return md.classify_mediums(cm(spark, sf), td.medium_class(mc(spark, sf))).select(
        "country", "medium", "class")


_FVP_SQL = f"""
fvp AS (
  SELECT country, medium, sessions, mean_conv_rate,
         sessions / nullif(CAST(sum(sessions) OVER (PARTITION BY country) AS DOUBLE), 0) AS perc_sessions
  FROM (SELECT cm.country, c.class AS medium, CAST(sum(cm.sessions) AS BIGINT) AS sessions,
               avg(cm.ecommerce_conversion_rate) AS mean_conv_rate
        FROM cm JOIN medium_class c ON cm.medium = c.medium
        WHERE cm.country IN ({top_sql("country_or", "revenue", 150, "country")})
        GROUP BY 1, 2))
"""


def fvp(spark, sf):
    return md.free_vs_paid(cm(spark, sf), country_or(spark, sf), td.medium_class(mc(spark, sf)))


@register("mk19_free_vs_paid", msql("SELECT * FROM fvp", _FVP_SQL),
          {"mean_conv_rate": 6, "perc_sessions": 6})
def q_mk19(spark, sf):
    return fvp(spark, sf)


_GOOD_SQL = f"""
good_conv AS (
  SELECT * FROM (
    SELECT country,
           max(CASE WHEN medium = 'free' THEN sessions END) AS sessions_free,
           max(CASE WHEN medium = 'paid' THEN sessions END) AS sessions_paid,
           max(CASE WHEN medium = 'free' THEN mean_conv_rate END) AS mean_conv_rate_free,
           max(CASE WHEN medium = 'paid' THEN mean_conv_rate END) AS mean_conv_rate_paid
    FROM fvp WHERE country <> '(not set)' GROUP BY country)
  WHERE sessions_free > {FREE_MIN_SESSIONS} * {K_SQL} AND sessions_paid < {PAID_MAX_SESSIONS} * {K_SQL})
"""


def good_conv(spark, sf):
    k = k_scale(spark, sf)
    return md.good_converting_low_paid(fvp(spark, sf), FREE_MIN_SESSIONS * k,
                                       PAID_MAX_SESSIONS * k)


@register("mk20_good_conv_low_paid", msql("SELECT * FROM good_conv", _FVP_SQL, _GOOD_SQL),
          {"mean_conv_rate_free": 6, "mean_conv_rate_paid": 6})
def q_mk20(spark, sf):
    return good_conv(spark, sf)


# --- MK21 bootstrap: the integer hash written out in SQL -------------------------

def _bootstrap_ctes(resamples: int = 10_000, seed: int = 0) -> list[str]:
    """The stratified bootstrap in SQL: same numbering, same integer hash."""
    from tidemark.functions import scalar as s
    p = s.HASH_P
    return ["""
bs_in AS (
  SELECT country, medium, medium AS cell_medium, revenue, transactions,
         revenue / nullif(CAST(transactions AS DOUBLE), 0) AS revenue_per_transaction
  FROM cm WHERE revenue > 0 AND transactions > 0)""",
            lump_sql("bs_l", "bs_in", "medium", 7, "revenue_per_transaction"), f"""
bs_rows AS (
  SELECT medium, revenue_per_transaction,
         row_number() OVER (PARTITION BY medium ORDER BY country ASC NULLS LAST,
                            cell_medium ASC NULLS LAST) - 1 AS rn
  FROM bs_l),
bs_sizes AS (
  SELECT medium, n, row_number() OVER (ORDER BY medium ASC NULLS LAST) AS s
  FROM (SELECT medium, count(*) AS n FROM bs_rows GROUP BY medium)),
bs_draw AS (
  SELECT medium, b, i, n, s FROM bs_sizes,
         range(0, {resamples}) r1(b), LATERAL (SELECT unnest(range(0, n)) AS i)),
bs_h1 AS (SELECT medium, b, i, n, s, (b * {s.HASH_A} + i * {s.HASH_B} + s * {s.HASH_C} + {s.HASH_D + seed % p * s.HASH_S % p}) % {p} AS x FROM bs_draw),
bs_h2 AS (SELECT medium, b, i, n, s, (x * x + b) % {p} AS x FROM bs_h1),
bs_h3 AS (SELECT medium, b, i, n, s, (x * {s.HASH_E} + i) % {p} AS x FROM bs_h2),
bs_h4 AS (SELECT medium, b, i, n, s, (x * x + s) % {p} AS x FROM bs_h3),
bs_idx AS (SELECT medium, b, ((x * {s.HASH_F} + {s.HASH_G}) % {p}) % n AS rn FROM bs_h4),
bs_means AS (
  SELECT d.b, d.medium, avg(r.revenue_per_transaction) AS m
  FROM bs_idx d JOIN bs_rows r ON d.medium = r.medium AND d.rn = r.rn
  GROUP BY d.b, d.medium)
"""]


def _bootstrap_sql() -> str:
    return msql("""
SELECT medium,
       quantile_cont(m, 0.05) AS boot_mean_05,
       quantile_cont(m, 0.5) AS boot_mean_50,
       quantile_cont(m, 0.95) AS boot_mean_95
FROM bs_means GROUP BY medium""", *_bootstrap_ctes())


def _tail_sql(table: str, points: int = 20_000) -> str:
    """``table`` (group_1, group_2, ..., t, df) with p_value and log10_p, by
    integration: with s = sqrt(df) tan(a) the density of Student's t is
    proportional to cos(a)^(df - 1), so the tail is a ratio of two integrals
    and needs no gamma function.  Simpson's rule on a grid that is denser where the tail
    begins (a = begin + width w^3); the height at the beginning is kept as a logarithm."""
    return f"""
tail_grid AS (SELECT i / {points}.0 AS w, CASE WHEN i IN (0, {points}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c
              FROM range({points + 1}) r(i)),
tail_from AS MATERIALIZED (
  SELECT DISTINCT df, unnest([0, atan(abs(t) / sqrt(df))]) AS a FROM {table} WHERE df > 0),
tail_ln AS MATERIALIZED (
  SELECT df, a, (df - 1) * ln(cos(a)) + ln(sum(c * exp((df - 1) * (
           ln(cos(a + (pi() / 2 - a) * w * w * w)) - ln(cos(a)))) * (pi() / 2 - a) * w * w / {points})) AS v
  FROM tail_from, tail_grid GROUP BY df, a),
tail_p AS (
  SELECT q.*, (top.v - whole.v - ln(2)) / ln(10) AS l
  FROM {table} q LEFT JOIN tail_ln top ON top.df = q.df AND top.a = atan(abs(q.t) / sqrt(q.df))
                 LEFT JOIN tail_ln whole ON whole.df = q.df AND whole.a = 0),
tailed AS (
  SELECT * EXCLUDE (l), CASE WHEN t >= 0 THEN 10 ^ l ELSE 1 - 10 ^ l END AS p_value,
         CASE WHEN t >= 0 THEN l ELSE log10(1 - 10 ^ l) END AS log10_p FROM tail_p)"""


_WELCH_SQL = """
tests AS MATERIALIZED (
  SELECT medium1 AS group_1, medium2 AS group_2, n1 AS n_1, n2 AS n_2, m1 AS mean_1, m2 AS mean_2,
         (m1 - m2) / sqrt(nullif(v1 / n1 + v2 / n2, 0)) AS t,
         (v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)) AS df
  FROM wt)"""


def _welch_select(*stats: str) -> str:
    """The tests of the rows of ``wt``, which the last CTE makes."""
    return msql("SELECT * FROM tailed", *_bootstrap_ctes(), *stats, _WELCH_SQL, _tail_sql("tests"))


WELCH_DIGITS = {"mean_1": 4, "mean_2": 4, "t": 6, "df": 4, "p_value": 8, "log10_p": 5}

_TOP_TWO_SQL = """
wt_order AS (
  SELECT medium, row_number() OVER (ORDER BY w DESC NULLS LAST, medium ASC NULLS LAST) AS r
  FROM (SELECT medium, sum(revenue_per_transaction) AS w FROM bs_l GROUP BY medium)),
wt_stats AS (
  SELECT s.medium, o.r, count(*) AS n, avg(s.m) AS m, var_samp(s.m) AS v
  FROM bs_means s JOIN wt_order o ON s.medium = o.medium WHERE o.r <= 2
  GROUP BY s.medium, o.r),
wt AS (
  SELECT max(CASE WHEN r = 1 THEN medium END) AS medium1, max(CASE WHEN r = 1 THEN n END) AS n1,
         max(CASE WHEN r = 1 THEN m END) AS m1, max(CASE WHEN r = 1 THEN v END) AS v1,
         max(CASE WHEN r = 2 THEN medium END) AS medium2, max(CASE WHEN r = 2 THEN n END) AS n2,
         max(CASE WHEN r = 2 THEN m END) AS m2, max(CASE WHEN r = 2 THEN v END) AS v2
  FROM wt_stats)"""


def boot_means(spark, sf):
    """The 10,000 stratified resample means, computed once and shared by the
    percentile view (MK21) and the t test (MK22)."""
    return shared(spark, sf, "bootstrap_means",
                  lambda: md.revenue_per_transaction_means(cm(spark, sf)))


@register("mk21_bootstrap_rev_per_tx", _bootstrap_sql(),
          {"boot_mean_05": 4, "boot_mean_50": 4, "boot_mean_95": 4})
def q_mk21(spark, sf):
    return md.bootstrap_revenue_per_transaction(cm(spark, sf), means=boot_means(spark, sf))


register("mk22_welch_bootstrap", _welch_select(_TOP_TWO_SQL),
         WELCH_DIGITS)(
    lambda spark, sf: md.bootstrap_welch(cm(spark, sf), means=boot_means(spark, sf)))


# fixed values: two mediums that the test tables keep through the lumping
WELCH_PAIR = ("BUILDING/2", "MACHINERY/3")
_PAIR_SQL = f"""
wt AS (
  SELECT a.medium AS medium1, a.n AS n1, a.m AS m1, a.v AS v1,
         b.medium AS medium2, b.n AS n2, b.m AS m2, b.v AS v2
  FROM wt_all a JOIN wt_all b ON a.medium = '{WELCH_PAIR[0]}' AND b.medium = '{WELCH_PAIR[1]}')"""
_ALL_SQL = """
wt_all AS (SELECT medium, count(*) AS n, avg(m) AS m, var_samp(m) AS v FROM bs_means GROUP BY medium)"""

_CELL_PAIRS_SQL = """
wt_all AS MATERIALIZED (
  SELECT medium, count(*) AS n, avg(revenue_per_transaction) AS m,
         var_samp(revenue_per_transaction) AS v FROM bs_l GROUP BY medium),
wt AS (
  SELECT a.medium AS medium1, a.n AS n1, a.m AS m1, a.v AS v1,
         b.medium AS medium2, b.n AS n2, b.m AS m2, b.v AS v2
  FROM wt_all a JOIN wt_all b ON a.m > b.m OR (a.m = b.m AND a.medium < b.medium))"""

register("mk22_welch_cells", _welch_select(_CELL_PAIRS_SQL), WELCH_DIGITS)(
    lambda spark, sf: md.welch_all_mediums(cm(spark, sf)))

register("mk22_welch_named", _welch_select(_ALL_SQL, _PAIR_SQL),
         WELCH_DIGITS)(
    lambda spark, sf: md.bootstrap_welch(cm(spark, sf), first=WELCH_PAIR[0], second=WELCH_PAIR[1],
                                         means=boot_means(spark, sf)))

register("mk22_replicates_not_greater", msql(f"""
SELECT count(*) AS n, avg(CASE WHEN a.m - b.m <= 0 THEN 1.0 ELSE 0.0 END) AS share_not_greater
FROM bs_means a JOIN bs_means b ON a.b = b.b
WHERE a.medium = '{WELCH_PAIR[0]}' AND b.medium = '{WELCH_PAIR[1]}'""", *_bootstrap_ctes()),
         {"share_not_greater": 6})(
    lambda spark, sf: replicates_not_greater(boot_means(spark, sf), "medium",
                                             "mean_revenue_per_transaction", *WELCH_PAIR))

BOOT_PROBS = (0.05, 0.5, 0.95)
register("mk21_bootstrap_long", msql("\nUNION ALL\n".join(
    f"SELECT medium, CAST({q!r} AS DOUBLE) AS prob, quantile_cont(m, {q!r}) AS value "
    f"FROM bs_means GROUP BY medium" for q in BOOT_PROBS), *_bootstrap_ctes()),
         {"prob": 6, "value": 4})(
    lambda spark, sf: exact_quantiles(boot_means(spark, sf), "mean_revenue_per_transaction",
                                      BOOT_PROBS, by=["medium"]))


def _share_dist_sql(metric: str) -> str:
    return msql(f"""
SELECT medium, floor(({metric}_share + 0.0075) / 0.015) * 0.015 AS bin, count(*) AS n
FROM sd WHERE {metric}_share IS NOT NULL GROUP BY 1, 2""", f"""
sd_in AS (SELECT country, medium, {metric}, {metric}_share FROM cm
          WHERE country IN ({top_sql("country_or", metric, 200, "country")}))""",
                lump_sql("sd", "sd_in", "medium", 6, metric))


for _m in ("users", "new_users", "revenue"):
    register(f"mk23_share_distribution_{_m}", _share_dist_sql(_m), {"bin": 6})(
        (lambda m: lambda spark, sf: md.share_distribution(cm(spark, sf), country_or(spark, sf),
                                                           m))(_m))


@register("mk25_median_revenue_share", msql(
    "SELECT medium, median(revenue_share) AS median_revenue_share FROM mrs GROUP BY medium", f"""
mrs_in AS (
  SELECT country, CASE WHEN medium IN ('(none)', '(not set)') THEN 'unknown' ELSE medium END AS medium,
         revenue, revenue_share FROM cm
  WHERE country IN ({top_sql("country_or", "revenue", 50, "country")}))""",
    lump_sql("mrs", "mrs_in", "medium", 7, "revenue")), {"median_revenue_share": 6})
def q_mk25(spark, sf):
    return md.median_revenue_share(cm(spark, sf), country_or(spark, sf))


_RPT_SQL = """
rpt_in AS (
  SELECT country, medium, revenue, transactions,
         revenue / nullif(CAST(transactions AS DOUBLE), 0) AS revenue_per_transaction,
         dense_rank() OVER (PARTITION BY country ORDER BY
           revenue / nullif(CAST(transactions AS DOUBLE), 0) DESC NULLS LAST) AS revenue_per_transaction_rank
  FROM cells)
""" + "," + lump_sql("rpt", "rpt_in", "medium", 6, "revenue_per_transaction", out="medium_lumped")


@register("mk26_rpt_ranks", msql("SELECT * FROM rpt", _RPT_SQL),
          {"revenue": 2, "revenue_per_transaction": 4})
def q_mk26(spark, sf):
    return md.rpt_ranks(cells(spark, sf))


@register("mk27_rpt_winners", msql("""
SELECT medium, n, n / sum(n) OVER () AS perc FROM (
  SELECT medium_lumped AS medium, count(*) AS n FROM rpt
  WHERE revenue_per_transaction_rank = 1 GROUP BY 1)""", _RPT_SQL), {"perc": 6})
def q_mk27(spark, sf):
    return md.rpt_winners(cells(spark, sf))


@register("mk28_rpt_spread", msql("""
SELECT medium_lumped AS medium, median(revenue_per_transaction) AS median_revenue_per_transaction,
       quantile_cont(revenue_per_transaction, 0.75) - quantile_cont(revenue_per_transaction, 0.25)
         AS iqr_revenue_per_transaction
FROM rpt GROUP BY 1""", _RPT_SQL),
          {"median_revenue_per_transaction": 4, "iqr_revenue_per_transaction": 4})
def q_mk28(spark, sf):
    return md.rpt_spread(cells(spark, sf))


_UNK_CELLS = """
unk_cells AS (
  SELECT * REPLACE (CASE WHEN medium IN ('(none)', '(not set)') THEN 'unknown' ELSE medium END AS medium)
  FROM cells)
"""


@register("mk29_share_fit", msql("""
SELECT medium, count(*) AS n, regr_slope(revenue_share, new_users_share) AS slope,
       regr_intercept(revenue_share, new_users_share) AS intercept,
       regr_r2(revenue_share, new_users_share) AS r2,
       corr(revenue_share, new_users_share) AS revenue_new_users_share_corr
FROM sfit GROUP BY medium""", _UNK_CELLS, lump_sql("sfit", "unk_cells", "medium", 7, "revenue")),
          {"slope": 6, "intercept": 6, "r2": 6, "revenue_new_users_share_corr": 6})
def q_mk29(spark, sf):
    return md.share_fit(cells(spark, sf))


def _top_medium_sql(metric: str) -> str:
    return msql(f"""
SELECT medium, count(*) AS n FROM (
  SELECT medium, rank() OVER (PARTITION BY country ORDER BY {metric}_share DESC NULLS LAST) AS r
  FROM tm) WHERE r <= 1 GROUP BY medium""", _UNK_CELLS, lump_sql("tm", "unk_cells", "medium", 7, metric))


register("mk30_top_medium_new_users_share", _top_medium_sql("new_users"))(
    lambda spark, sf: md.top_medium_tally(cells(spark, sf), "new_users"))

# the users variant keeps the mart's rank over all mediums of the country
register("mk30_top_medium_users_share", msql("""
SELECT medium, count(*) AS n FROM tm
WHERE users_channel_within_country_rank = 1 GROUP BY medium""",
    _UNK_CELLS, lump_sql("tm", "unk_cells", "medium", 7, "users")))(
    lambda spark, sf: md.top_medium_tally(cells(spark, sf), "users", by_mart_rank=True))


@register("mk31_monetisation_ratio", msql("""
SELECT * FROM (SELECT country, medium, users_share, revenue_share,
                      revenue_share / nullif(users_share, 0) AS revenue_to_users_share_ratio FROM cells)
WHERE revenue_to_users_share_ratio > 1 ORDER BY revenue_to_users_share_ratio DESC"""),
          {"users_share": 6, "revenue_share": 6, "revenue_to_users_share_ratio": 6})
def q_mk31(spark, sf):
    return md.monetisation_ratio(cells(spark, sf))


@register("mk32_best_converting_tally", msql("""
SELECT medium, count(*) AS n FROM (
  SELECT medium, dense_rank() OVER (PARTITION BY country ORDER BY ecommerce_conversion_rate DESC NULLS LAST) AS r
  FROM cells) WHERE r = 1 GROUP BY medium"""))
def q_mk32(spark, sf):
    return md.best_converting_tally(cells(spark, sf))


@register("mk33_funnel_what_if", msql("""
SELECT country, medium, revenue_rank, revenue_per_transaction_rank, potential_revenue_rank FROM (
  SELECT country, medium,
         dense_rank() OVER (PARTITION BY country ORDER BY revenue DESC NULLS LAST) AS revenue_rank,
         dense_rank() OVER (PARTITION BY country ORDER BY rpt DESC NULLS LAST) AS revenue_per_transaction_rank,
         dense_rank() OVER (PARTITION BY country ORDER BY pot DESC NULLS LAST) AS potential_revenue_rank
  FROM (SELECT *, revenue / nullif(CAST(transactions AS DOUBLE), 0) AS rpt,
               10000 * ecommerce_conversion_rate * (revenue / nullif(CAST(transactions AS DOUBLE), 0)) AS pot
        FROM cells))
WHERE potential_revenue_rank < revenue_rank"""))
def q_mk33(spark, sf):
    return md.funnel_what_if(cells(spark, sf))


@register("mk33_potential_funnel", msql("""
SELECT country, medium, 10000 AS n_potential_incoming_visitors, ecommerce_conversion_rate, revenue,
       transactions, rpt AS revenue_per_transaction, pot AS potential_revenue,
       dense_rank() OVER (PARTITION BY country ORDER BY revenue DESC NULLS LAST) AS revenue_rank,
       dense_rank() OVER (PARTITION BY country ORDER BY rpt DESC NULLS LAST) AS revenue_per_transaction_rank,
       dense_rank() OVER (PARTITION BY country ORDER BY pot DESC NULLS LAST) AS potential_revenue_rank
FROM (SELECT *, revenue / nullif(CAST(transactions AS DOUBLE), 0) AS rpt,
             10000 * ecommerce_conversion_rate * (revenue / nullif(CAST(transactions AS DOUBLE), 0)) AS pot
      FROM cells)"""),
          {"ecommerce_conversion_rate": 6, "revenue": 2, "revenue_per_transaction": 4,
           "potential_revenue": 2})
def q_mk33_all(spark, sf):
    """MK33 before the filter; PRJ5 puts the visitors before the rate."""
    return md.potential_funnel(cells(spark, sf))


# --- MK34 candidate score over three derived lists --------------------------------

@register("mk34_candidate_score", msql("""
SELECT a.country, h.f AS good_conversion_and_high_value, g.f AS good_converting_low_free_traffic,
       s.f AS potential_marketing_scaling,
       CAST(coalesce(CAST(h.f AS INT), 0) + coalesce(CAST(g.f AS INT), 0)
            + coalesce(CAST(s.f AS INT), 0) AS BIGINT) AS total_score
FROM (SELECT country FROM hv UNION SELECT country FROM good_conv UNION SELECT country FROM uplift) a
LEFT JOIN (SELECT DISTINCT country, TRUE AS f FROM hv) h ON a.country = h.country
LEFT JOIN (SELECT DISTINCT country, TRUE AS f FROM good_conv) g ON a.country = g.country
LEFT JOIN (SELECT DISTINCT country, TRUE AS f FROM uplift) s ON a.country = s.country""",
    _CONV_VIEW_SQL, "hv AS (SELECT * FROM conv_ranked WHERE pr <= 0.5 AND diff_to_mean_revenue_per_transaction > 0)",
    _FVP_SQL, _GOOD_SQL, _PEN_SQL, _UPLIFT_SQL))
def q_mk34(spark, sf):
    return mk.candidate_score({
        "good_conversion_and_high_value": q_mk08(spark, sf),
        "good_converting_low_free_traffic": good_conv(spark, sf),
        "potential_marketing_scaling": uplift_df(spark, sf),
    })


# fixed values: written-out lists over the test tables' countries
LITERAL_LISTS = {
    "good_conversion_and_high_value": ("NATION_1", "NATION_4", "NATION_9"),
    "good_converting_low_free_traffic": ("NATION_4", "NATION_17"),
    "potential_marketing_scaling": ("NATION_4", "NATION_9", "NATION_99"),
}


def _literal_sql() -> str:
    lists = [f"l{k} AS (SELECT unnest([{', '.join(repr(c) for c in v)}]) AS country)"
             for k, v in enumerate(LITERAL_LISTS.values())]
    flags = ", ".join(f"l{k}.country IS NOT NULL OR NULL AS {n}" for k, n in enumerate(LITERAL_LISTS))
    score = " + ".join(f"CAST(l{k}.country IS NOT NULL AS INT)" for k in range(3))
    return msql(f"""
SELECT a.country, {flags}, CAST({score} AS BIGINT) AS total_score, m.users, m.revenue
FROM (SELECT country FROM l0 UNION SELECT country FROM l1 UNION SELECT country FROM l2) a
LEFT JOIN l0 ON a.country = l0.country LEFT JOIN l1 ON a.country = l1.country
LEFT JOIN l2 ON a.country = l2.country LEFT JOIN country_all m ON a.country = m.country""", *lists)


@register("mk34_literal_lists", _literal_sql(), {"revenue": 2})
def q_mk34_literal(spark, sf):
    """SRC4/MK34: candidate lists written out in the analysis, joined to the mart."""
    scored = mk.candidate_score({n: mk.literal_list(spark, v) for n, v in LITERAL_LISTS.items()})
    return scored.join(country_all(spark, sf).select("country", "users", "revenue"), "country",
                       "left").orderBy(F.desc("total_score"), "country")


# ==================================================================================
# primitives not exercised by the analyses above
# ==================================================================================

@register("mk03_low_volume_list", msql(f"""
SELECT country, users, new_users, sessions, transactions, revenue FROM country_all
WHERE revenue <= {KEEP['revenue']} * {K_SQL} OR users <= {KEEP['users']} * {K_SQL}
   OR transactions <= {KEEP['transactions']} * {K_SQL}
ORDER BY revenue DESC"""), {"revenue": 2})
def q_mk03_list(spark, sf):
    """MK3 list of dropped countries: OR filter, column range users:revenue."""
    from tidemark.operators.columns import select_range
    k = k_scale(spark, sf)
    low = country_all(spark, sf).filter(marts.low_volume_rule(
        KEEP["revenue"] * k, KEEP["users"] * k, KEEP["transactions"] * k))
    return select_range(low, "users", "revenue", "country").orderBy(F.col("revenue").desc(), "country")


@register("mk00_n_countries", msql(
    "SELECT count(DISTINCT country) AS n_countries, count(DISTINCT medium) AS n_mediums FROM medium_country"))
def q_mk00_n(spark, sf):
    """AGG8: number of distinct countries (and mediums)."""
    return mc(spark, sf).agg(F.count_distinct("country").alias("n_countries"),
                             F.count_distinct("medium").alias("n_mediums"))


@register("mk25_revenue_share_hist_30", msql("""
SELECT medium, lo + floor((revenue_share - lo) / w + 0.5) * w AS bin, count(*) AS n
FROM (SELECT *, (SELECT min(revenue_share) FROM hb WHERE revenue_share IS NOT NULL) AS lo,
             ((SELECT max(revenue_share) FROM hb WHERE revenue_share IS NOT NULL)
              - (SELECT min(revenue_share) FROM hb WHERE revenue_share IS NOT NULL)) / 29.0 AS w
      FROM hb WHERE revenue_share IS NOT NULL)
GROUP BY 1, 2""", f"""
hb_in AS (
  SELECT country, CASE WHEN medium IN ('(none)', '(not set)') THEN 'unknown' ELSE medium END AS medium,
         revenue, revenue_share FROM cm
  WHERE country IN ({top_sql("country_or", "revenue", 50, "country")}))""",
    lump_sql("hb", "hb_in", "medium", 7, "revenue")), {"bin": 6})
def q_mk25_hist(spark, sf):
    """AGG20: 30-bin histogram of the revenue share per lumped medium."""
    from tidemark.operators.factors import lump
    from tidemark.operators.stats import histogram_bins
    d = md.unknown_recode(cm(spark, sf).join(md.top_countries(country_or(spark, sf), "revenue", 50),
                                             "country", "left_semi"))
    d = lump(d, "medium", 7, w="revenue")
    return histogram_bins(d, "revenue_share", 30, by=["medium"])


@register("mk26_rpt_histogram", msql("""
SELECT medium_lumped AS medium, floor((revenue_per_transaction + 12.5) / 25.0) * 25.0 AS bin, count(*) AS n
FROM rpt WHERE revenue_per_transaction IS NOT NULL GROUP BY 1, 2""", _RPT_SQL), {"bin": 4})
def q_mk26_hist(spark, sf):
    """MK26: histogram (bin width 25) of rev/tx per lumped medium."""
    from tidemark.operators.stats import histogram
    r = md.rpt_ranks(cells(spark, sf)).withColumn("medium", F.col("medium_lumped"))
    return histogram(r, "revenue_per_transaction", 25.0, by=["medium"])


@register("mk15_medium_order_revenue", msql("""
SELECT medium, row_number() OVER (ORDER BY s DESC NULLS LAST, medium ASC NULLS LAST) AS medium_order
FROM (SELECT medium, sum(revenue) AS s FROM cm GROUP BY medium)"""))
def q_mk15_order(spark, sf):
    """FCT3: medium level order by summed revenue (largest first)."""
    return md.mediums_levels(cm(spark, sf), "revenue")


@register("src6_tourism_slice", msql("SELECT * FROM tourists"))
def q_src6(spark, sf):
    """SRC6: one slice of the tourism fact, filtered on four dimensions."""
    return td.tourists(spark, sf)


@register("mk08_display", msql("""
SELECT country, format('{:,.2f}', ecommerce_conversion_rate * 100) || '%' AS ecommerce_conversion_rate_text,
       format('{:,.0f}', revenue) || '€' AS revenue_text
FROM conv_ranked WHERE pr <= 0.5 AND diff_to_mean_revenue_per_transaction > 0""", _CONV_VIEW_SQL))
def q_mk08_display(spark, sf):
    """STR6/STR7: the MK8 list as display text (percent and thousands)."""
    from tidemark.functions.scalar import number_text, percent_text
    hv = q_mk08(spark, sf)
    return hv.select("country",
                     percent_text("ecommerce_conversion_rate", 2).alias("ecommerce_conversion_rate_text"),
                     number_text("revenue", 0, suffix="€").alias("revenue_text"))


@register("mk15_medium_order_max_sessions", msql("""
SELECT medium, row_number() OVER (ORDER BY k ASC NULLS LAST, medium ASC NULLS LAST) AS medium_order
FROM (SELECT medium, max(sessions) AS k FROM cm GROUP BY medium)"""))
def q_mk15_order_max(spark, sf):
    """FCT3: medium levels ordered by their largest cell sessions (ascending)."""
    from tidemark.operators.factors import level_order
    return level_order(cm(spark, sf).select("medium", "sessions"), "medium", "sessions", "max",
                       out="medium_order").select("medium", "medium_order").distinct()


@register("mk23_medium_order_median_users", msql("""
SELECT medium, row_number() OVER (ORDER BY k ASC NULLS LAST, medium ASC NULLS LAST) AS medium_order
FROM (SELECT medium, median(users) AS k FROM cm GROUP BY medium)"""))
def q_mk23_order_median(spark, sf):
    """FCT3 default: medium levels ordered by the median of users (ascending)."""
    from tidemark.operators.factors import level_order
    return level_order(cm(spark, sf).select("medium", "users"), "medium", "users", "median",
                       out="medium_order").select("medium", "medium_order").distinct()
