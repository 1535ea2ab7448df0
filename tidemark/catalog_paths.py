"""Registered conversion-path queries (CP1-CP22) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import register, shared
from tidemark.catalog_marts import mc
from tidemark.operators import attribution as at
from tidemark.operators.stats import prob_grid
from tidemark.plans import paths as pp
from tidemark.sources import testdata as td

# fixed values: the node list and classes of the sub-network view (CP18) and the
# search fragment (CP22), chosen among the channels of the test tables
SUBNET_NODES = ("(start)", "(conversion)", "(none)", "click-0", "click-1", "view-0",
                "view-1", "signup-0")
SUBNET_CLASSES = {"(start)": "start", "(conversion)": "conversion", "(none)": "free",
                  "view-0": "free", "view-1": "free", "signup-0": "free",
                  "click-0": "paid", "click-1": "paid"}
SEARCH_FRAGMENT = "signup-1"
MARKOV_STEPS = 200


def raw(spark, sf):
    return shared(spark, sf, "conversion_paths_raw", lambda: td.conversion_paths_raw(spark, sf))


def parsed(spark, sf):
    return shared(spark, sf, "conversion_paths_parsed", lambda: pp.parse_paths(raw(spark, sf)))


def nonzero(spark, sf):
    return pp.drop_zero_value(parsed(spark, sf))


def clean(spark, sf):
    return shared(spark, sf, "conversion_paths", lambda: pp.merge_paths(nonzero(spark, sf)))


def model(spark, sf):
    """The Markov model (a row for each channel), solved once."""
    return shared(spark, sf, "markov_model", lambda: at.markov_model(clean(spark, sf)))


PATHS_SQL = """
cp_parsed AS (
  SELECT medium_path, CAST(trunc(conversions) AS BIGINT) AS conversions,
         CASE WHEN strpos(value, ' ') > 0 THEN substr(value, 1, strpos(value, ' ') - 1) ELSE value END
           AS currency,
         TRY_CAST(replace(CASE WHEN strpos(value, ' ') > 0 THEN substr(value, strpos(value, ' ') + 1) END,
                          ',', '') AS DOUBLE) AS value
  FROM conversion_paths_raw),
cp_nz AS (SELECT * FROM cp_parsed WHERE value > 0),
cp_clean AS (
  SELECT medium_path, CAST(sum(conversions) AS BIGINT) AS conversions,
         floor(sum(value) * 100.0 + 0.5) / 100.0 AS value
  FROM cp_nz GROUP BY medium_path),
cp_feat AS (
  SELECT *, CAST(len(string_split(medium_path, ' > ')) AS BIGINT) AS path_length,
         string_split(medium_path, ' > ')[1] AS first_touchpoint_medium
  FROM cp_nz),
cp_states AS (
  SELECT conversions AS w, ['(start)'] || string_split(medium_path, ' > ') || ['(conversion)'] AS s
  FROM cp_clean),
cp_edges AS (
  SELECT channel_from, channel_to, weight,
         weight / sum(weight) OVER (PARTITION BY channel_from) AS transition_probability
  FROM (SELECT s[i] AS channel_from, s[i + 1] AS channel_to, CAST(sum(w) AS BIGINT) AS weight
        FROM (SELECT w, s, unnest(range(1, len(s))) AS i FROM cp_states)
        GROUP BY 1, 2))
"""

MARKOV_SQL = f"""
mk_v AS (
  SELECT string_split(medium_path, ' > ')[-1] AS channel,
         sum(value) / sum(conversions) AS v
  FROM cp_clean GROUP BY 1),
mk_exit AS (
  SELECT e.channel_from AS node, e.transition_probability AS pc,
         e.transition_probability * coalesce(v.v, 0.0) AS pv
  FROM cp_edges e LEFT JOIN mk_v v ON e.channel_from = v.channel
  WHERE e.channel_to = '(conversion)'),
mk_move AS (
  SELECT channel_from, channel_to, transition_probability AS p FROM cp_edges
  WHERE channel_to <> '(conversion)'),
mk_scen AS (
  SELECT DISTINCT channel_from AS removed FROM cp_edges WHERE channel_from <> '(start)'
  UNION ALL SELECT '<full>'),
walk(step, removed, node, m) AS (
  SELECT 0, removed, '(start)', CAST(1.0 AS DOUBLE) FROM mk_scen
  UNION ALL
  SELECT w.step + 1, w.removed, mv.channel_to, sum(w.m * mv.p)
  FROM walk w JOIN mk_move mv ON w.node = mv.channel_from
  WHERE w.step < {MARKOV_STEPS} AND mv.channel_to <> w.removed
  GROUP BY w.step + 1, w.removed, mv.channel_to),
mk_abs AS (
  SELECT w.removed, sum(w.m * x.pc) AS c, sum(w.m * x.pv) AS e
  FROM walk w JOIN mk_exit x ON w.node = x.node GROUP BY w.removed),
mk_re AS (
  SELECT a.removed AS channel_name, 1 - a.c / f.c AS removal_effects_conversion,
         1 - a.e / f.e AS removal_effects_conversion_value
  FROM mk_abs a, (SELECT c, e FROM mk_abs WHERE removed = '<full>') f
  WHERE a.removed <> '<full>'),
mk_result AS (
  SELECT channel_name, removal_effects_conversion, removal_effects_conversion_value,
         (SELECT sum(conversions) FROM cp_clean) * removal_effects_conversion
           / sum(removal_effects_conversion) OVER () AS total_conversions,
         (SELECT sum(value) FROM cp_clean) * removal_effects_conversion_value
           / sum(removal_effects_conversion_value) OVER () AS total_conversion_value
  FROM mk_re)
"""

HEUR_SQL = """
heur AS (
  SELECT channel_name,
         sum(CASE WHEN pos = 1 THEN c ELSE 0.0 END) AS first_touch_conversions,
         sum(CASE WHEN pos = 1 THEN v ELSE 0.0 END) AS first_touch_value,
         sum(CASE WHEN pos = n THEN c ELSE 0.0 END) AS last_touch_conversions,
         sum(CASE WHEN pos = n THEN v ELSE 0.0 END) AS last_touch_value,
         sum(c / n) AS linear_touch_conversions,
         sum(v / n) AS linear_touch_value
  FROM (SELECT CAST(conversions AS DOUBLE) AS c, value AS v, len(a) AS n,
               unnest(a) AS channel_name, generate_subscripts(a, 1) AS pos
        FROM (SELECT *, string_split(medium_path, ' > ') AS a FROM cp_clean))
  GROUP BY channel_name)
"""


def psql(body: str, *extra: str, recursive: bool = False) -> str:
    parts = [td.CONVERSION_PATHS_RAW_SQL, PATHS_SQL, *extra]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n" + body


def _top_sql(table: str, metric: str, n: int, cols: str = "*") -> str:
    return (f"SELECT {cols} FROM {table} WHERE {metric} >= (SELECT min({metric}) FROM "
            f"(SELECT {metric} FROM {table} WHERE {metric} IS NOT NULL "
            f"ORDER BY {metric} DESC LIMIT {n}))")


# --- inputs ------------------------------------------------------------------------

register("cp00_conversion_paths_raw", psql("SELECT * FROM conversion_paths_raw"))(raw)

register("mk00_medium_country", "WITH " + td.MEDIUM_COUNTRY_SQL.strip() + "\nSELECT * FROM medium_country",
         {"revenue": 2, "bounce_rate": 6, "pages_session": 6, "avg_session_duration": 6,
          "ecommerce_conversion_rate": 6})(mc)

# --- CP1-CP11 ----------------------------------------------------------------------

register("cp01_parse_value", psql("SELECT * FROM cp_parsed"), {"value": 2})(parsed)
register("cp01_currency_count", psql(
    "SELECT currency, count(*) AS n FROM cp_parsed GROUP BY currency"))(
    lambda spark, sf: pp.currency_counts(parsed(spark, sf)))

register("cp02_value_summary", psql("""
SELECT min(value) AS min, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
       avg(value) AS mean, quantile_cont(value, 0.75) AS q3, max(value) AS max
FROM cp_parsed WHERE value IS NOT NULL"""),
         {c: 4 for c in ("min", "q1", "median", "mean", "q3", "max")})(
    lambda spark, sf: pp.value_summary(parsed(spark, sf)))

register("cp02_value_tail_quantiles", psql("\nUNION ALL\n".join(
    f"SELECT 'value' AS metric, CAST({p!r} AS DOUBLE) AS prob, quantile_cont(value, {p!r}) AS value "
    f"FROM cp_parsed WHERE value IS NOT NULL" for p in prob_grid(0.9, 1.0, 0.01))),
         {"prob": 6, "value": 4})(lambda spark, sf: pp.value_tail_quantiles(parsed(spark, sf)))

register("cp02_value_ecdf", psql("""
SELECT value, n, sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 / sum(n) OVER () AS ecdf
FROM (SELECT value, count(*) AS n FROM cp_parsed WHERE value IS NOT NULL GROUP BY value)"""),
         {"value": 2, "ecdf": 6})(lambda spark, sf: pp.value_ecdf(parsed(spark, sf)))

register("cp03_top_paths_by_value", psql(_top_sql("cp_parsed", "value", 10)), {"value": 2})(
    lambda spark, sf: pp.top_paths_by_value(parsed(spark, sf)))


def _density_sql(cw: float, vw: float, log: bool) -> str:
    x = "CASE WHEN conversions > 0 THEN log10(CAST(conversions AS DOUBLE)) END" if log else \
        "CAST(conversions AS DOUBLE)"
    y = "CASE WHEN value > 0 THEN log10(value) END" if log else "value"
    return psql(f"""
SELECT floor((x + {cw / 2}) / {cw}) * {cw} AS conversions_bin,
       floor((y + {vw / 2}) / {vw}) * {vw} AS value_bin, count(*) AS n
FROM (SELECT {x} AS x, {y} AS y FROM cp_parsed) WHERE x IS NOT NULL AND y IS NOT NULL
GROUP BY 1, 2""")


register("cp04_pair_density", _density_sql(1.0, 500.0, False),
         {"conversions_bin": 6, "value_bin": 6})(
    lambda spark, sf: pp.pair_density(parsed(spark, sf), 1.0, 500.0))
register("cp04_pair_density_log10", _density_sql(0.1, 0.1, True),
         {"conversions_bin": 6, "value_bin": 6})(
    lambda spark, sf: pp.pair_density(parsed(spark, sf), 0.1, 0.1, log10=True))

register("cp05_zero_value_audit", psql("""
SELECT is_zero_value, n, conversions, n / sum(n) OVER () AS perc_rows,
       conversions / sum(conversions) OVER () AS perc_conversions
FROM (SELECT value = 0 AS is_zero_value, count(*) AS n, CAST(sum(conversions) AS BIGINT) AS conversions
      FROM cp_parsed GROUP BY 1)"""), {"perc_rows": 6, "perc_conversions": 6})(
    lambda spark, sf: pp.zero_value_audit(parsed(spark, sf)))

register("cp06_medium_vocabulary", psql(
    "SELECT DISTINCT unnest(string_split(medium_path, ' > ')) AS medium FROM cp_parsed"))(
    lambda spark, sf: pp.medium_vocabulary(parsed(spark, sf)))

register("cp07_path_features", psql("SELECT * FROM cp_feat"), {"value": 2})(
    lambda spark, sf: pp.path_features(nonzero(spark, sf)))

register("cp08_path_length_hist", psql(
    "SELECT CAST(path_length AS DOUBLE) AS bin, count(*) AS n FROM cp_feat GROUP BY 1"))(
    lambda spark, sf: pp.path_length_histogram(pp.path_features(nonzero(spark, sf))))
register("cp08_path_length_hist_0_50", psql(
    "SELECT CAST(path_length AS DOUBLE) AS bin, count(*) AS n FROM cp_feat "
    "WHERE path_length BETWEEN 0 AND 50 GROUP BY 1"))(
    lambda spark, sf: pp.path_length_histogram(pp.path_features(nonzero(spark, sf)), 0, 50))
register("cp08_path_length_quantiles", psql("\nUNION ALL\n".join(
    f"SELECT 'path_length' AS metric, CAST({p!r} AS DOUBLE) AS prob, "
    f"quantile_cont(CAST(path_length AS DOUBLE), {p!r}) AS value FROM cp_feat"
    for p in prob_grid(0.5, 1.0, 0.05))), {"prob": 6, "value": 6})(
    lambda spark, sf: pp.path_length_quantiles(pp.path_features(nonzero(spark, sf))))


def _vbl_sql(max_len: int | None) -> str:
    where = f"WHERE path_length <= {max_len}" if max_len else ""
    return psql(f"""
SELECT * FROM (
  SELECT path_length, value, perc,
         sum(perc) OVER (ORDER BY path_length ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS cumul
  FROM (SELECT path_length, value, value / sum(value) OVER () AS perc
        FROM (SELECT path_length, sum(value) AS value FROM cp_feat GROUP BY 1))) {where}""")


register("cp09_value_by_length", _vbl_sql(None),
         {"value": 2, "perc": 6, "cumul": 6})(
    lambda spark, sf: pp.value_by_length(pp.path_features(nonzero(spark, sf))))
register("cp09_value_by_length_15", _vbl_sql(15),
         {"value": 2, "perc": 6, "cumul": 6})(
    lambda spark, sf: pp.value_by_length(pp.path_features(nonzero(spark, sf)), 15))

register("cp10_first_touch", psql("""
SELECT first_touchpoint_medium, n, n / sum(n) OVER () AS perc
FROM (SELECT first_touchpoint_medium, count(*) AS n FROM cp_feat GROUP BY 1)"""), {"perc": 6})(
    lambda spark, sf: pp.first_touch_frequency(pp.path_features(nonzero(spark, sf))))

register("cp11_duplicates", psql("""
SELECT count(*) AS n_rows, count(DISTINCT medium_path) AS n_distinct,
       count(*) - count(DISTINCT medium_path) AS n_duplicated FROM cp_nz"""))(
    lambda spark, sf: pp.duplicate_paths(nonzero(spark, sf)))
register("cp11_merge", psql("SELECT * FROM cp_clean"), {"value": 2})(clean)

# --- CP12-CP22 attribution ---------------------------------------------------------

register("cp12_transitions", psql("SELECT * FROM cp_edges"), {"transition_probability": 6})(
    lambda spark, sf: at.transition_matrix(clean(spark, sf)))

register("cp13_markov", psql(
    "SELECT channel_name, total_conversions, total_conversion_value FROM mk_result",
    MARKOV_SQL, recursive=True), {"total_conversions": 4, "total_conversion_value": 2})(
    lambda spark, sf: model(spark, sf).select(
        "channel_name", "total_conversions", "total_conversion_value"))

register("cp14_removal_effects", psql("""
SELECT channel_name, removal_effects_conversion, removal_effects_conversion_value FROM mk_result
WHERE removal_effects_conversion_value > 0 ORDER BY removal_effects_conversion_value DESC""",
    MARKOV_SQL, recursive=True),
         {"removal_effects_conversion": 6, "removal_effects_conversion_value": 6})(
    lambda spark, sf: model(spark, sf)
    .select("channel_name", "removal_effects_conversion", "removal_effects_conversion_value")
    .filter(F.col("removal_effects_conversion_value") > 0)
    .orderBy(F.col("removal_effects_conversion_value").desc(), "channel_name"))

_HEUR_DIGITS = {f"{m}_touch_{k}": (4 if k == "conversions" else 2)
                for m in ("first", "last", "linear") for k in ("conversions", "value")}
register("cp15_heuristics", psql("SELECT * FROM heur", HEUR_SQL), _HEUR_DIGITS)(
    lambda spark, sf: at.heuristic_models(clean(spark, sf)))

register("cp16_model_comparison", psql("""
SELECT channel_name, model, value,
       dense_rank() OVER (ORDER BY chan_total DESC NULLS LAST, channel_name ASC NULLS LAST) AS channel_order
FROM (SELECT *, sum(value) OVER (PARTITION BY channel_name) AS chan_total FROM (
  SELECT channel_name, model, value FROM (
    SELECT m.channel_name, m.total_conversions AS markov, h.first_touch_conversions AS first,
           h.last_touch_conversions AS last, h.linear_touch_conversions AS linear
    FROM mk_result m LEFT JOIN heur h ON m.channel_name = h.channel_name
    WHERE m.channel_name IN (SELECT channel_name FROM mk_top6))
  UNPIVOT (value FOR model IN (markov, first, last, linear))))""", MARKOV_SQL, HEUR_SQL,
    "mk_top6 AS (" + _top_sql("mk_result", "total_conversions", 6, "channel_name") + ")",
    recursive=True), {"value": 4})(
    lambda spark, sf: pp.model_comparison(clean(spark, sf), model=model(spark, sf)))

register("cp17_top_transitions", psql("""
SELECT channel_from, channel_to, weight, transition_probability FROM (
  SELECT *, row_number() OVER (PARTITION BY channel_from ORDER BY transition_probability DESC,
                               channel_to ASC) AS r
  FROM cp_edges WHERE channel_from IN (SELECT channel_name FROM mk_top11)) WHERE r <= 4""",
    MARKOV_SQL, "mk_top11 AS (" + _top_sql("mk_result", "total_conversions", 11, "channel_name") + ")",
    recursive=True), {"transition_probability": 6})(
    lambda spark, sf: pp.top_transitions(clean(spark, sf), model=model(spark, sf)))

_NODES_SQL = ", ".join(f"'{n}'" for n in SUBNET_NODES)
_CLASS_SQL = " ".join(f"WHEN name = '{k}' THEN '{v}'" for k, v in SUBNET_CLASSES.items())

register("cp18_subnetwork_edges", psql(
    f"SELECT * FROM cp_edges WHERE channel_from IN ({_NODES_SQL}) AND channel_to IN ({_NODES_SQL})"),
    {"transition_probability": 6})(
    lambda spark, sf: pp.subnetwork(at.transition_matrix(clean(spark, sf)), SUBNET_NODES)[0])
register("cp18_subnetwork_nodes", psql(f"""
SELECT name, CASE {_CLASS_SQL} END AS class FROM (
  SELECT channel_from AS name FROM sub UNION SELECT channel_to FROM sub)""",
    f"sub AS (SELECT * FROM cp_edges WHERE channel_from IN ({_NODES_SQL}) AND channel_to IN ({_NODES_SQL}))"))(
    lambda spark, sf: pp.subnetwork(at.transition_matrix(clean(spark, sf)), SUBNET_NODES,
                                    SUBNET_CLASSES)[1])

for _p, _tag in ((0.7, "07"), (0.1, "01")):
    register(f"cp19_strong_edges_{_tag}", psql(
        f"SELECT * FROM cp_edges WHERE transition_probability > {_p}"),
        {"transition_probability": 6})(
        (lambda p: lambda spark, sf: pp.strong_edges(
            at.transition_matrix(clean(spark, sf)), p)[0])(_p))
    register(f"cp19_strong_nodes_{_tag}", psql(f"""
SELECT channel_from AS name FROM cp_edges WHERE transition_probability > {_p}
UNION SELECT channel_to FROM cp_edges WHERE transition_probability > {_p}"""))(
        (lambda p: lambda spark, sf: pp.strong_edges(
            at.transition_matrix(clean(spark, sf)), p)[1])(_p))

register("cp20_conversion_odds", psql("""
SELECT channel_from, transition_probability, 1.0 / nullif(transition_probability, 0) AS one_in_n
FROM cp_edges WHERE channel_to = '(conversion)'"""),
         {"transition_probability": 6, "one_in_n": 6})(
    lambda spark, sf: pp.conversion_odds(at.transition_matrix(clean(spark, sf))))

register("cp21_order2_transitions", psql("""
SELECT channel_from, channel_to, weight,
       weight / sum(weight) OVER (PARTITION BY channel_from) AS transition_probability
FROM (SELECT s[i] AS channel_from, s[i + 1] AS channel_to, CAST(sum(w) AS BIGINT) AS weight
      FROM (SELECT w, s, unnest(range(1, len(s))) AS i FROM (
              SELECT w, ['(start)'] || list_transform(range(1, len(e)),
                       lambda j: e[j] || ',' || e[j + 1]) || ['(conversion)'] AS s
              FROM (SELECT conversions AS w, ['(start)'] || string_split(medium_path, ' > ') AS e
                    FROM cp_clean)))
      GROUP BY 1, 2)"""), {"transition_probability": 6})(
    lambda spark, sf: at.transition_matrix(clean(spark, sf), order=2))

register("cp22_path_search", psql(
    f"SELECT * FROM cp_parsed WHERE contains(medium_path, '{SEARCH_FRAGMENT}')"), {"value": 2})(
    lambda spark, sf: pp.path_search(parsed(spark, sf), SEARCH_FRAGMENT))


# --- primitives not exercised above --------------------------------------------------

register("cp13_channel_index", psql(
    "SELECT channel_name, row_number() OVER (ORDER BY channel_name) AS channel_index FROM mk_result",
    MARKOV_SQL, recursive=True))(
    lambda spark, sf: pp.channel_index(model(spark, sf)))

register("cp06_path_touches_long", psql("""
SELECT medium_path, CAST(generate_subscripts(a, 1) AS BIGINT) AS position, unnest(a) AS medium
FROM (SELECT medium_path, string_split(medium_path, ' > ') AS a FROM cp_clean)"""))(
    lambda spark, sf: pp.touches_long(clean(spark, sf)))

register("cp22_path_search_tail", psql(f"""
SELECT * FROM (SELECT * FROM cp_parsed WHERE contains(medium_path, '{SEARCH_FRAGMENT}'))
ORDER BY value ASC NULLS LAST, medium_path ASC, conversions ASC LIMIT 5"""), {"value": 2})(
    lambda spark, sf: pp.tail_rows(pp.path_search(parsed(spark, sf), SEARCH_FRAGMENT),
                                   ["value", "medium_path", "conversions"], 5))

# SMP1: the seeded sample is ordered by a text hash, which SQL can repeat
register("cp01_sample_rows", psql("""
SELECT medium_path, conversions, currency, value FROM (
  SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM cp_parsed)
ORDER BY md5('7|' || coalesce(medium_path, '') || '|' || coalesce(CAST(conversions AS VARCHAR), '')
             || '|' || coalesce(currency, '') || '|' || coalesce(CAST(cents AS VARCHAR), '')),
         medium_path, conversions, currency, cents
LIMIT 10"""), {"value": 2})(
    lambda spark, sf: pp.sample_paths(parsed(spark, sf), 10, seed=7))

register("cp20_odds_vs_best", psql("""
SELECT channel_from, transition_probability, one_in_n,
       one_in_n / nullif(min(one_in_n) OVER (), 0) AS ratio_to_best
FROM (SELECT channel_from, transition_probability, 1.0 / nullif(transition_probability, 0) AS one_in_n
      FROM cp_edges WHERE channel_to = '(conversion)')"""),
         {"transition_probability": 6, "one_in_n": 6, "ratio_to_best": 6})(
    lambda spark, sf: pp.odds_vs_best(at.transition_matrix(clean(spark, sf))))
