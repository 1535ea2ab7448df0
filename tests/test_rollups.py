"""Sketches within their bounds, heavy levels, ranks over ranges: against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import heavy
from tidemark.operators import sketches as sk
from tidemark.operators.factors import kept_levels, lump
from tidemark.operators.global_ranks import ordered_levels, ranked
from tidemark.operators.ranking import ntile_of, percent_rank_desc


def _bits(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- quantile sketches -------------------------------------------------------------

def test_merged_kll_is_within_its_bound(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 11).cast("string").alias("cell"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"),
        F.when(F.col("id") % 1000 == 0, None).when(F.col("id") % 1000 == 1, float("nan"))
        .otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double")).alias("v"))
    k, probs = 200, (0.0, 0.1, 0.5, 0.99, 1.0)
    cells = sk.value_sketches(rows, "v", ["cell", "g"], k)
    merged = sk.merge_value_sketches(cells, ["g"], k)
    q = sk.sketch_quantiles(merged, ["g"], probs)
    usable = Counter(r["g"] for r in rows.filter("v is not null and not isnan(v)").select("g").collect())
    assert {r["g"]: r["n"] for r in q.collect()} == usable
    assert all(r["within_bound"] for r in sk.quantiles_within_bound(rows, "v", ["g"], q, probs, k).collect())
    # the flag can be false: the same values shifted by a tenth of the range
    off = q.withColumn("q", F.transform("q", lambda x: x + 500))
    assert not any(r["within_bound"] for r in sk.quantiles_within_bound(rows, "v", ["g"], off, probs, k).collect())


def test_kll_of_few_values_is_exact_and_empty_groups_are_null(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", None), ("void", None),
                                  ("void", float("nan")), (None, 7.0)], "g string, v double")
    s = sk.value_sketches(rows, "v", ["g"])
    got = {r["g"]: (r["n"], r["q"]) for r in sk.sketch_quantiles(s, ["g"], [0.5]).collect()}
    assert got == {"a": (3, [2.0]), "void": (0, None), None: (1, [7.0])}
    assert sk.value_sketches(rows.limit(0), "v", ["g"]).count() == 0
    assert sk.kll_error(800) < sk.kll_error(200) < 0.03


def test_theta_counts(spark):
    rows = spark.range(40_000).select((F.col("id") % 4).alias("cell"), (F.col("id") % 9000).alias("k"),
                                      (F.col("id") % 2).alias("g"), (F.col("id") < 6000).alias("sub"))
    s = sk.key_sketches(rows, {"all": F.col("k"), "sub": F.when(F.col("sub"), F.col("k"))}, ["cell", "g"])
    m = sk.merge_key_sketches(s, ["all", "sub"], ["g"])
    exact = rows.groupBy("g").agg(F.countDistinct("k").alias("n"),
                                  F.countDistinct(F.when(F.col("sub"), F.col("k"))).alias("m"))
    r = exact.join(m, "g").select(
        "n", "m", sk.agrees(F.col("n"), F.col("all"), F.col("n")).alias("a"),
        sk.agrees(F.col("n") - F.col("m"), F.theta_difference("all", "sub"), F.col("n")).alias("d"),
        sk.agrees(F.col("m"), F.theta_intersection("all", "sub"), F.col("n")).alias("i"),
        sk.agrees(F.col("n") * 2, F.col("all"), F.col("n")).alias("wrong"), sk.estimate(F.col("sub")).alias("sub"))
    for row in r.collect():
        assert row["a"] and row["d"] and row["i"] and not row["wrong"]
        assert row["m"] == row["sub"] == 3000  # under 2^12 distinct keys: exact


# --- heavy levels ------------------------------------------------------------------

def _factor(spark, kind, n=20_000):
    rng = random.Random(kind)
    rows = []
    for i in range(n):
        if kind == "hot":      # Zipf: few levels have most of the weight, many have little
            level = f"z{int(rng.paretovariate(0.9)) % 5000}"
        elif kind == "flat":
            level = f"f{rng.randrange(4000)}"
        else:                  # one level with a third of all rows, ties at the cut
            level = "top" if i % 3 == 0 else f"t{i % 12}" if i % 3 == 1 else f"u{i}"
        rows.append((None if i % 997 == 0 else level, float(rng.randrange(5)) if i % 50 else None, "clash"))
    return spark.createDataFrame(rows, "f string, w double, level string").repartition(7)


@pytest.mark.parametrize("kind", ["hot", "flat", "ties"])
@pytest.mark.parametrize("w,ties", [(None, True), ("w", True), ("w", False)])
def test_lump_heavy_is_lump(spark, kind, w, ties, monkeypatch):
    monkeypatch.setattr(heavy, "FAN", 3)
    df = _factor(spark, kind)
    got = heavy.lump_heavy(df, "f", 9, w, with_ties=ties, counters=64)
    assert got.columns == df.columns
    assert _bits(got.groupBy("f").count()) == _bits(lump(df, "f", 9, w, with_ties=ties).groupBy("f").count())


def test_which_lumps_are_proven(spark):
    assert heavy.heavy_levels(_factor(spark, "hot"), "f", 5, counters=256)[1]
    assert not heavy.heavy_levels(_factor(spark, "flat"), "f", 5, counters=64)[1]
    df = _factor(spark, "hot")
    levels, floor = heavy.heavy_candidates(df, "f", "w", 64)
    exact = {r["f"]: r["w"] or 0.0 for r in df.groupBy("f").agg(F.sum("w").alias("w")).collect()}
    found = {r["level"]: (r["low"], r["high"]) for r in levels.collect()}
    assert 0 < floor and len(found) <= 64
    assert all(low - 1e-6 <= exact[x] <= high + 1e-6 for x, (low, high) in found.items())
    assert all(v <= floor for x, v in exact.items() if x not in found)


def test_heavy_edges(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0), (None, 9.0)], "f string, w double")
    for n in (1, 2, 3, 5):  # a lump of one level is not made
        for ties in (True, False):
            assert _bits(heavy.heavy_levels(df, "f", n, "w", ties)[0]) == _bits(
                kept_levels(df, "f", n, "w", ties))
    assert heavy.lump_heavy(df.limit(0), "f", 2).count() == 0
    negative = df.union(spark.createDataFrame([("d", -3.0)], df.schema))
    levels, proven = heavy.heavy_levels(negative, "f", 2, "w")
    assert not proven and _bits(levels) == _bits(kept_levels(negative, "f", 2, "w"))
    with pytest.raises(ValueError):
        heavy.heavy_levels(df, "f", 5, counters=6)


# --- ranks over ranges -------------------------------------------------------------

def _values(kind, n=900):
    rng = random.Random(kind)
    return [(i, None if i % 41 == 0 else 5 if kind == "hot" and i % 10 else rng.randrange(40)) for i in range(n)]


@pytest.mark.parametrize("kind", ["hot", "mixed"])
@pytest.mark.parametrize("desc", [True, False])
@pytest.mark.parametrize("partitions", [None, 1, 13, 200])
def test_ranked_is_the_window(spark, kind, desc, partitions):
    df = spark.createDataFrame(_values(kind), "id long, v int").repartition(5)
    v = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_last()
    w, full = Window.orderBy(v), Window.orderBy(v, "id")
    want = df.select("id", "v", F.row_number().over(full).alias("row_number"), F.rank().over(w).alias("rank"),
                     F.dense_rank().over(w).alias("dense_rank"), F.percent_rank().over(w).alias("percent_rank"),
                     F.ntile(7).over(full).alias("ntile"))
    got = ranked(df, "v", ["id"], desc, ntile=7, partitions=partitions)
    assert got.columns == want.columns
    assert _bits(got) == _bits(want)


def test_ranked_edges(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, v double")
    assert _bits(ranked(df, "v", ["id"], ntile=3)) == [(1, 2.0, 1, 1, 1, 0.0, 1)]
    assert ranked(df.limit(0), "v", ["id"], ntile=3).collect() == []
    same = spark.range(50).select("id", F.lit(1).alias("v"))
    got = ranked(same, "v", ["id"], partitions=9, ntile=60).collect()
    assert {r["rank"] for r in got} == {r["dense_rank"] for r in got} == {1}
    assert sorted(r["ntile"] for r in got) == list(range(1, 51))
    assert sorted(r["row_number"] for r in got) == list(range(1, 51))


def test_wrappers(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 3.0), ("d", None)], "c string, v double")
    assert _bits(ntile_of(df, "v", 3, "c", "t")) == [("a", 1.0, 1), ("b", 1.0, 1), ("c", 3.0, 2), ("d", None, 3)]
    assert _bits(percent_rank_desc(df, "v", "p", ["c"])) == [
        ("a", 1.0, 1 / 3), ("b", 1.0, 1 / 3), ("c", 3.0, 0.0), ("d", None, 1.0)]
    rows = spark.createDataFrame([("x", 1), ("y", 5), ("x", 3), (None, 9), ("z", 4)], "f string, v int")
    assert _bits(ordered_levels(rows, "f", F.sum("v"))) == [
        ("x", 4, 1), ("y", 5, 3), ("z", 4, 2), (None, 9, 4)]
