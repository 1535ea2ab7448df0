"""Student's tail against numerical integration; Welch tests against plain ones."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.student import log10_tail, log_gamma, upper_tail
from tidemark.operators.stats import welch_pairs, welch_t


def log10_tail_plain(t: float, df: float, n: int = 200_001) -> float:
    """log10 P(T > t), t >= 0: Simpson's rule on cos(a)^(df - 1)."""
    def log_integral(begin: float) -> float:
        w, width = np.linspace(0, 1, n), math.pi / 2 - begin
        a = begin + width * w ** 3
        f = np.exp((df - 1) * (np.log(np.cos(a)) - math.log(math.cos(begin)))) * 3 * width * w ** 2
        s = (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) / (3 * (n - 1))
        return math.log(s) + (df - 1) * math.log(math.cos(begin))
    return (log_integral(math.atan(t / math.sqrt(df))) - log_integral(0.0) - math.log(2)) / math.log(10)


def test_upper_tail(spark):
    rows = [(float(t), float(df)) for df in (1, 2, 2.5, 3, 10, 37.7, 200, 5000, 19_998, 10 ** 6)
            for t in (1e-3, 0.3, 1, 1.9, 4, 12, 60, 300)]
    got = spark.createDataFrame(rows, "t double, df double").select(
        "t", "df", upper_tail(F.col("t"), F.col("df")).alias("p"),
        upper_tail(-F.col("t"), F.col("df")).alias("mirror"),
        log10_tail(F.col("t"), F.col("df")).alias("log10_p")).collect()
    for r in got:
        want = log10_tail_plain(r["t"], r["df"])
        assert r["p"] == pytest.approx(10 ** want, abs=1e-10), r
        assert r["mirror"] == pytest.approx(1 - 10 ** want, abs=1e-10), r
        assert r["log10_p"] == pytest.approx(want, rel=1e-8, abs=1e-9), r


def test_known_tails_and_edges(spark):
    # df 1: 1/2 - atan(t)/pi; df 2: (1 - t / sqrt(t^2 + 2)) / 2
    rows = [(t, 1.0, 0.5 - math.atan(t) / math.pi) for t in (-7.0, -1.0, 0.0, 0.5, 30.0)]
    rows += [(t, 2.0, (1 - t / math.sqrt(t * t + 2)) / 2) for t in (-3.0, 0.0, 0.1, 8.0)]
    rows += [(float("inf"), 5.0, 0.0), (float("-inf"), 5.0, 1.0), (None, 5.0, None), (1.0, None, None),
             (1.0, 0.0, None), (1.0, -2.0, None), (float("nan"), 3.0, None), (1e200, 4.0, 0.0), (1e-200, 4.0, 0.5)]
    got = spark.createDataFrame(rows, "t double, df double, want double").select(
        upper_tail(F.col("t"), F.col("df")).alias("p"), "want").collect()
    for r in got:
        assert r["p"] == (None if r["want"] is None else pytest.approx(r["want"], abs=1e-12)), r


def test_log_gamma(spark):
    zs = [0.01, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 123.4, 10_000.5]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", log_gamma(F.col("z")).alias("g"))
    for r in got.collect():
        assert r["g"] == pytest.approx(math.lgamma(r["z"]), rel=1e-12, abs=1e-11)


GROUPS = {"a": [1.0, 2.0, 4.0], "b": [1.5, 0.5, 0.7, 0.9], "c": [3.0, 3.0, 3.0], "one": [9.0], "void": [None]}


def _plain(x, y):
    se = [statistics.variance(v) / len(v) for v in (x, y)]
    t = (statistics.mean(x) - statistics.mean(y)) / math.sqrt(sum(se))
    df = sum(se) ** 2 / sum(s * s / (len(v) - 1) for s, v in zip(se, (x, y)))
    p = 10 ** log10_tail_plain(abs(t), df)
    return t, df, p if t >= 0 else 1 - p


def test_welch(spark):
    df = spark.createDataFrame([(g, v) for g, vs in GROUPS.items() for v in vs] + [(None, 5.0)],
                               "medium string, v double")
    for one, two in (("a", "b"), ("b", "a"), ("c", "b")):
        r = welch_t(df, "medium", "v", one, two).first()
        assert (r["t"], r["df"], r["p_value"]) == pytest.approx(_plain(GROUPS[one], GROUPS[two]), rel=1e-9)
    pairs = {(r["group_1"], r["group_2"]): r for r in welch_pairs(df, "medium", "v").collect()}
    # by falling mean; "void" has no values and null is no group
    assert set(pairs) == {("one", "c"), ("one", "a"), ("one", "b"), ("c", "a"), ("c", "b"), ("a", "b")}
    assert pairs["a", "b"]["p_value"] == pytest.approx(_plain(GROUPS["a"], GROUPS["b"])[2], rel=1e-9)
    assert pairs["one", "a"]["p_value"] is None and pairs["one", "a"]["n_1"] == 1
    assert welch_pairs(df.limit(0), "medium", "v").collect() == []


def test_no_variance(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    r = welch_t(df, "g", "v", "b", "a").first()
    assert r["t"] is None and r["p_value"] is None and r["mean_1"] == 2.0
