"""Registered queries: exports that are written and read again, dictionaries as
values, nested results, names that nearly match."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog import REGISTRY, register
from tidemark.catalog_marts import (
    BOOT_PROBS, MART_DIGITS, _bootstrap_ctes, boot_means, country_all, good_conv, msql, q_mk08, uplift_df)
from tidemark.catalog_paths import clean, psql
from tidemark.operators import attribution as at
from tidemark.operators.dictionaries import dictionary, inverted, lookup
from tidemark.operators.names import reconcile
from tidemark.operators.nested import attach, fold, nest, unnest
from tidemark.operators.ranking import row_number_by
from tidemark.operators.stats import exact_quantiles
from tidemark.plans import markets as mk
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import exports as ex
from tidemark.sources.files import read_table


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"


# --- SRC1-SRC3: an export with a preamble and damaged rows -----------------------

# fixed values: a preamble of six lines, one of them like a row
PREAMBLE = ("# ----------------------------------------", "# Acquisition report", "",
            "NATION_0,1,2,3,4", "20220101-20221231", "")
EXPORT = {"country": "string", "users": "long", "sessions": "long", "transactions": "long", "revenue": "double"}


def country_export(spark, sf):
    """The country mart as text files with a preamble and, between the rows,
    damaged ones: a word for a number, a row cut short, a line break in quotes."""
    mart = country_all(spark, sf).select(*EXPORT)
    word = mart.filter("length(country) % 2 = 0").select(F.expr("concat(country, ',n/a,', sessions, ',1,2.5')"))
    short = mart.filter("users % 3 = 0").select(F.expr("concat(country, ',', users)"))
    broken = mart.filter("sessions % 2 = 0").select(F.explode(F.expr(
        """array(concat('"', country), concat('and more",', users, ',1,1,1.5'))""")))
    path = _folder(spark)
    lines = ex.csv_lines(mart).union(word).union(short).union(broken).union(mart.limit(1).select(F.lit("  ")))
    ex.write_with_preamble(lines, ["Country", "Users", "Sessions", "Transactions", "Revenue"], path, PREAMBLE)
    return ex.read_export(spark, path, ", ".join(f"{c} {t}" for c, t in EXPORT.items()), len(PREAMBLE))


register("src1_export_rows", msql(f"SELECT {', '.join(EXPORT)} FROM country_all"),
         {"revenue": MART_DIGITS["revenue"]})(lambda spark, sf: ex.sound_rows(country_export(spark, sf)))

register("src1_export_quarantine", msql("""
SELECT country || ',n/a,' || sessions || ',1,2.5' AS raw FROM country_all WHERE length(country) % 2 = 0
UNION ALL SELECT country || ',' || users FROM country_all WHERE users % 3 = 0
UNION ALL SELECT '"' || country FROM country_all WHERE sessions % 2 = 0
UNION ALL SELECT 'and more",' || users || ',1,1,1.5' FROM country_all WHERE sessions % 2 = 0"""))(
    lambda spark, sf: ex.quarantine(country_export(spark, sf)).select("raw"))


# --- SNK1-SNK2: lists handed over by committed exports ----------------------------

@register("snk1_committed_lists", REGISTRY["mk34_candidate_score"].sql)
def q_committed_lists(spark, sf):
    """MK34 from three lists that were exported and read again.  Each export
    has an older version, and data of a write that broke off before its manifest."""
    lists = {"good_conversion_and_high_value": (q_mk08(spark, sf), "csv"),
             "good_converting_low_free_traffic": (good_conv(spark, sf), "parquet"),
             "potential_marketing_scaling": (uplift_df(spark, sf), "csv")}
    read = {}
    for name, (df, kind) in lists.items():
        folder, countries = _folder(spark), df.select("country").distinct()
        ex.commit(country_all(spark, sf).select("country"), folder, kind)
        ex.commit(countries, folder, kind)
        country_all(spark, sf).select("country").write.parquet(f"{folder}/data/broken-off")
        read[name] = ex.read_committed(spark, folder)
    return mk.candidate_score(read)


# --- JN8, RSH6: the transition matrix by channel number ----------------------------

LABELS = (at.START, at.CONVERSION)


def _numbered(spark, sf):
    """The transition matrix with numbers for channels, and the dictionary."""
    edges = at.transition_matrix(clean(spark, sf))
    names = edges.select(F.col("channel_from").alias("name")).union(edges.select("channel_to")).distinct()
    numbers = dictionary(row_number_by(names.filter(~F.col("name").isin(*LABELS)), ["name"], "id"), "name", "id")
    return edges.withColumns({c: lookup(numbers, F.col(c), *LABELS) for c in ("channel_from", "channel_to")}), numbers


register("jn8_transitions_by_number", psql("""
SELECT coalesce(CAST(f.id AS VARCHAR), channel_from) AS channel_from,
       coalesce(CAST(t.id AS VARCHAR), channel_to) AS channel_to, transition_probability
FROM cp_edges LEFT JOIN ids f ON f.name = channel_from LEFT JOIN ids t ON t.name = channel_to""", """
ids AS (SELECT name, row_number() OVER (ORDER BY name) AS id
        FROM (SELECT channel_from AS name FROM cp_edges UNION SELECT channel_to FROM cp_edges)
        WHERE name NOT IN ('(start)', '(conversion)'))"""), {"transition_probability": 6})(
    lambda spark, sf: _numbered(spark, sf)[0].select("channel_from", "channel_to", "transition_probability"))


@register("jn8_transitions_named", REGISTRY["cp12_transitions"].sql, {"transition_probability": 6})
def q_named(spark, sf):
    """By number and back to names: the matrix of CP12."""
    edges, numbers = _numbered(spark, sf)
    names = inverted(numbers)
    back = {c: F.coalesce(F.when(F.col(c).isin(*LABELS), F.col(c)),
                          F.try_element_at(names, F.expr(f"try_cast({c} AS bigint)")))
            for c in ("channel_from", "channel_to")}
    return edges.withColumns(back)


# --- RSH5: bootstrap splits and results as nested columns --------------------------

MEAN = "mean_revenue_per_transaction"


def nested_bootstrap(spark, sf):
    """A row for each medium: its resample means (``splits``) and their
    percentiles (``results``)."""
    means = boot_means(spark, sf)
    return attach(nest(means, ["medium"], "splits", ["boot_id"]),
                  nest(exact_quantiles(means, MEAN, BOOT_PROBS, by=["medium"]), ["medium"], "results", ["prob"]),
                  ["medium"])


register("rsh5_results_unnested", REGISTRY["mk21_bootstrap_long"].sql, REGISTRY["mk21_bootstrap_long"].digits)(
    lambda spark, sf: unnest(nested_bootstrap(spark, sf).drop("splits"), "results"))

register("rsh5_splits_folded", msql("""
SELECT medium, CAST(count(*) AS BIGINT) AS n_splits, avg(m) AS mean_of_splits FROM bs_means GROUP BY medium""",
    *_bootstrap_ctes()), {"mean_of_splits": 4})(
    lambda spark, sf: nested_bootstrap(spark, sf).select(
        "medium", F.size("splits").cast("long").alias("n_splits"),
        (fold("splits", MEAN) / F.size("splits")).alias("mean_of_splits")))


# --- JN9: a misspelt country list -------------------------------------------------

# a made-up name of 12 letters for each nation, and how the other list writes it
_TITLE = "translate(substr(md5(n_name), 1, 12), '0123456789', 'ghijklmnop')"
_SPELT = f"""CASE n_nationkey % 6 WHEN 0 THEN {_TITLE} WHEN 1 THEN upper({_TITLE})
    WHEN 2 THEN translate({_TITLE}, 'aeionc', 'áèïôñç')
    WHEN 3 THEN concat(substr({_TITLE}, 1, 3), substr({_TITLE}, 5))
    WHEN 4 THEN concat(substr({_TITLE}, 1, 5), 'x', substr({_TITLE}, 6, 4), 'y', substr({_TITLE}, 11))
    ELSE concat('unheard of ', n_nationkey) END"""
_HOW = "CASE n_nationkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'collation' WHEN 2 THEN 'collation' WHEN 3 THEN 'edits' WHEN 4 THEN 'edits' END"


@register("jn9_reconciled_names", f"""
SELECT name, CASE WHEN how IS NULL THEN NULL ELSE title END AS target, how,
       CAST(CASE how WHEN 'edits' THEN levenshtein(name, title) WHEN 'exact' THEN 0 WHEN 'collation' THEN 0 END
            AS INTEGER) AS distance
FROM (SELECT {_TITLE} AS title, {_SPELT} AS name, {_HOW} AS how FROM nation)""")
def q_reconciled(spark, sf):
    """Every spelling with the nation that it stands for; the expected partner
    follows from how each name was misspelt."""
    nation = read_table(spark, sf, "nation")
    return reconcile(nation.select(F.expr(_SPELT).alias("name")), nation.select(F.expr(_TITLE).alias("title")),
                     "name", "title")
