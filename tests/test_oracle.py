"""Registered queries against their DuckDB oracles (the driver's gate).

Every registered query with SQL is checked at sf0.01.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, digest, spark_types  # noqa: E402

SF = "/root/testdata/sf0.01"
KEYS = sorted(k for k in entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(entry.oracle_sql()[key])
    assert spark_types(df) == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    res = duck.execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_query_has_a_name_and_runs_on_smoke_data(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    missing = set(entry.queries()) - set(entry.oracle_sql())
    # only training-data operators that SQL cannot say lack an oracle
    assert all(k == "pipeline" or k.startswith("op") for k in missing)
