"""Readers and writers (SRC1-SRC3, SRC5, SNK1-SNK2).

All readers take explicit schemas where the caller has one; inference stays an
option for ad-hoc exploration.  Nothing here collects data to the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


# --- fixed values: schemas of the shared test tables the analyses read -------
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}
# ------------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder.  Known tables are read with
    their declared schema (no inference job over the footers); column
    pruning and predicate pushdown happen at this scan."""
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _normaliser():
    def snake_case(name: str) -> str:
        """Header normaliser in the spirit of ``clean_names``: lower snake case,
        non-alphanumerics collapsed to ``_``, ``%`` spelled ``percent``, leading
        digits prefixed with ``x``."""
        s = name.strip().replace("%", "_percent_").replace("#", "_number_")
        s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
        s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
        s = re.sub(r"_+", "_", s)
        if not s:
            s = "x"
        if s[0].isdigit():
            s = "x" + s
        return s

    return snake_case


# made by a function, so that workers get it by value and need not have this package
snake_case = _normaliser()


def clean_names(df: DataFrame) -> DataFrame:
    """SRC3: normalise every header; duplicates get ``_2``, ``_3`` suffixes."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        base = snake_case(c)
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*out)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             comment: str | None = None, clean: bool = True) -> DataFrame:
    """SRC1/SRC2: CSV scan with a header row.

    ``comment='#'`` drops a preamble of ``#`` lines (and blank lines, which
    Spark's CSV reader skips anyway) before the header; this replaces a fixed
    "skip n lines" that Spark's reader does not have.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path)
    return clean_names(df) if clean else df


def read_csv_skip(spark: SparkSession, path: str, skip: int,
                  schema: StructType | str) -> DataFrame:
    """SRC1 for a preamble that is not ``#``-marked: the sound rows after the
    first ``skip`` lines and the header line of every file, told by their place in the
    file (``exports.read_export``, which also gives the damaged rows)."""
    from tidemark.sources.exports import read_export, sound_rows
    return sound_rows(read_export(spark, path, schema, skip, check_header=False))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1: header CSV folder (one file per partition)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """SNK2: columnar hand-over between analyses."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
