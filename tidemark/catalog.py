"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB
oracle per operator of SURVEY §2.

Each entry reads the given test tables through the input builders of
``tidemark.sources.testdata``.  Doubles are rounded to a fixed number of
decimals on both sides (``digits``) — the Spark side with ``round``, the SQL
side with an outer ``SELECT * REPLACE`` — so value hashes do not depend on the
summation order.  Thresholds that the analyses state in absolute units are
scaled by ``k = count(orders) / 15000`` (a scalar subquery on both sides).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import testdata as td
from tidemark.sources.files import read_table


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    digits: dict[str, int] = field(default_factory=dict)


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None, digits: dict[str, int] | None = None):
    def deco(fn):
        REGISTRY[key] = Entry(fn, sql, digits or {})
        return fn
    return deco


def _round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    # floor(x * 10^d + 0.5) / 10^d: plain IEEE arithmetic, bit-identical in
    # both engines (Spark's ``round`` goes through a decimal string instead)
    return df.withColumns({
        c: F.floor(F.col(c).cast("double") * float(10 ** d) + 0.5).cast("double")
        / float(10 ** d) + F.lit(0.0)
        for c, d in digits.items() if c in df.columns})


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(e: Entry):
        return lambda spark, sf_dir: _round(e.fn(spark, sf_dir), e.digits)
    return {k: wrap(e) for k, e in REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    out = {}
    for k, e in REGISTRY.items():
        if e.sql is None:
            continue
        body = e.sql.strip().rstrip(";")
        if e.digits:
            rep = ", ".join(
                f"floor(CAST({c} AS DOUBLE) * CAST({10 ** d} AS DOUBLE) + 0.5) / CAST({10 ** d} AS DOUBLE)"
                f" + 0.0 AS {c}" for c, d in e.digits.items())
            body = f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) AS q"
        out[k] = body
    return out


# --- shared inputs -------------------------------------------------------------

def k_scale(spark: SparkSession, sf_dir: str) -> Column:
    """k = count(orders) / 15000 as a scalar subquery (no driver action)."""
    return read_table(spark, sf_dir, "orders").select(
        F.count(F.lit(1)) / F.lit(float(td.ORDERS_AT_K1))).scalar()


K_SQL = "(SELECT count(*) / 15000.0 FROM orders)"

def _state(spark: SparkSession, sf_dir: str) -> str:
    """What the folder holds now: names, sizes and times of its tables, in one
    listing.  (A session without a JVM of its own has ``forget`` only.)"""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect
        return ""
    path = sc._jvm.org.apache.hadoop.fs.Path(sf_dir)
    system = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not system.exists(path):
        return ""
    # access times change when a table is read
    return re.sub(r"access_time=\d+", "", " ".join(sorted(s.toString() for s in system.listStatus(path))))


def shared(spark: SparkSession, sf_dir: str, name: str,
           build: Callable[[], DataFrame]) -> DataFrame:
    """Build a derived table once per session and folder and reuse it.

    The marts and the cleaned path table feed dozens of analyses; each is
    written once with ``checkpoint()`` into the session's checkpoint folder
    (shared storage on a cluster), so later plans read the stored rows instead
    of re-aggregating the fact tables, and a lost executor costs no rebuild.
    The tables belong to the session object and to the folder as it is: after
    one of its tables was rewritten they are built again (``_state``), and ``forget``
    drops them.
    """
    folder = sf_dir.rstrip("/")
    kept = spark.__dict__.setdefault("_tidemark_shared", {})
    states = spark.__dict__.setdefault("_tidemark_states", {})
    state = _state(spark, folder)
    if states.get(folder, state) != state:
        forget(spark, folder)
    states[folder] = state
    key = (folder, name)
    if key not in kept:
        ensure_checkpoint_dir(spark)
        kept[key] = build().checkpoint(eager=True)
    return kept[key]


def forget(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Drop the session's shared tables (of one folder)."""
    kept = spark.__dict__.get("_tidemark_shared", {})
    for key in [k for k in kept if sf_dir is None or k[0] == sf_dir.rstrip("/")]:
        del kept[key]


from tidemark.catalog_marts import *  # noqa: E402,F401,F403
from tidemark.catalog_paths import *  # noqa: E402,F401,F403
from tidemark.catalog_rollups import *  # noqa: E402,F401,F403
from tidemark.catalog_exports import *  # noqa: E402,F401,F403
