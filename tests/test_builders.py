"""Input builders and sinks against brute force on small fixtures."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.sources import testdata as td
from tidemark.sources.files import write_csv, write_parquet


def _events():
    rows = []
    eid = 0
    t0 = dt.datetime(2024, 1, 1)
    # user 1 is "hot": many events over several days, several purchases
    plan = {1: ["view", "click", "purchase", "view", "signup", "error", "purchase", "click"] * 6,
            2: ["purchase", "view", "purchase"],
            3: ["view", "click"]}
    for user, kinds in plan.items():
        for j, kind in enumerate(kinds):
            rows.append((eid, t0 + dt.timedelta(hours=7 * j + user), user, kind,
                         float(10 + (eid % 7)), f'{{"k": {eid * 13 % 100}}}'))
            eid += 1
    return pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])


def _brute(ev: pd.DataFrame):
    out = []
    for _, g in ev.sort_values(["user_id", "ts", "event_id"]).groupby("user_id"):
        touches = []
        for r in g.itertuples():
            if r.event_type == "purchase":
                path = " > ".join(touches) if touches else "(none)"
                conv = 3.0 if r.event_id % 17 == 0 else 1.0
                amount = round(max(r.value - 1, 0) * 100, 2)
                out.append((path, conv, f"EUR {amount:,.2f}"))
                touches = []
            else:
                k = int(r.props.split(":")[1].strip(" }"))
                touches.append(f"{r.event_type}-{k % 3}")
    return sorted(out)


def test_conversion_paths_builder_matches_brute_force(spark, tmp_path):
    ev = _events()
    d = tmp_path / "sf"
    d.mkdir()
    spark.createDataFrame(ev).write.parquet(str(d / "events.parquet"))
    for ranges in (None, 1, 3, 40):
        got = sorted(tuple(r) for r in td.conversion_paths_raw(spark, str(d), ranges).collect())
        assert got == _brute(ev)


def test_hot_users_without_purchases_and_bursts(spark, tmp_path):
    """A user who never buys, a tail after the last purchase, and a burst of
    events in one second: nothing that is not in a journey is assembled."""
    ev = _events()
    t0 = dt.datetime(2024, 3, 1)
    rows, eid = [], int(ev["event_id"].max()) + 1
    for k in range(400):
        rows.append((eid + k, t0, 9, "view" if k % 50 else "purchase", float(k), f'{{"k": {k}}}'))
    for k in range(300):
        rows.append((eid + 400 + k, t0 + dt.timedelta(seconds=k // 100), 8, "click", 1.0, '{"k": 1}'))
    ev = pd.concat([ev, pd.DataFrame(rows, columns=ev.columns)], ignore_index=True)
    d = tmp_path / "sf"
    d.mkdir()
    spark.createDataFrame(ev).write.parquet(str(d / "events.parquet"))
    paths = td.conversion_paths_raw(spark, str(d), 16)
    assert sorted(tuple(r) for r in paths.collect()) == _brute(ev)
    plan = paths._jdf.queryExecution().optimizedPlan().toString()
    # the filter on journeys with a purchase stands below the collect
    assert plan.index("collect_list") < plan.index("< total")


def test_country_shares_sum_to_one_before_dropping(spark):
    from tidemark import catalog_marts as cmk
    sf = "/root/testdata/sf0.01"
    sums = (cmk.cm_full(spark, sf).groupBy("country")
            .agg(*[F.sum(f"{m}_share").alias(m) for m in ("revenue", "users", "sessions", "transactions")])
            .collect())
    for r in sums:
        for m in ("revenue", "sessions", "transactions"):
            assert getattr(r, m) == pytest.approx(1.0)
        assert r.users >= 1.0 - 1e-9  # a user can appear under several mediums
    clean = (cmk.cm(spark, sf).groupBy("country").agg(F.sum("revenue_share").alias("s")).collect())
    assert all(r.s <= 1 + 1e-9 for r in clean)


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Spain", "cpc", 3), ("Croatia", "(none)", 1)],
                               "country string, medium string, users long")
    write_parquet(df, str(tmp_path / "p"), partition_by=["medium"])
    back = spark.read.parquet(str(tmp_path / "p")).select("country", "medium", "users")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).schema(df.schema).csv(str(tmp_path / "c"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("key", ["cp14_removal_effects", "mk17_median_share_table",
                                 "cp02_value_tail_quantiles"])
def test_results_invariant_under_partition_count(spark, key):
    import __spark_entry__ as entry
    from tidemark import catalog
    sf = "/root/testdata/sf0.001"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for parts in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            catalog.forget(spark, sf)       # else the second run reads the first one's tables
            out.append(sorted(tuple(r) for r in entry.queries()[key](spark, sf).collect()))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
