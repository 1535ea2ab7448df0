"""Column-expression helpers (STR*, MTH*, LGC1, DAT1 and the safe ratio).

Everything returns a ``Column`` built from ``pyspark.sql.functions`` so it stays
inside whole-stage codegen; there is no Python UDF in this module.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Q1: ``num / den`` as double, NULL when ``den`` is 0 or NULL.

    Spark 4 runs with ANSI on, where ``x / 0`` raises; the reference's R code
    yields Inf/NaN, which Spark would then sort as large numbers (Q19).  NULL
    keeps filters and ranks well-defined.
    """
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def cents(x: ColumnOrName) -> Column:
    """Money kept in cents: ``floor(x * 100 + 0.5) / 100`` (plain IEEE
    arithmetic, so every engine returns the same double for the same sum)."""
    return F.floor(col(x).cast("double") * 100.0 + 0.5).cast("double") / 100.0


CENTS_SQL = "floor(CAST({x} AS DOUBLE) * 100.0 + 0.5) / 100.0"


def percent_text(x: ColumnOrName, digits: int = 2) -> Column:
    """STR6: fraction -> ``"12.34%"`` (display only; never sort on it)."""
    return F.concat(F.format_number(col(x) * 100, digits), F.lit("%"))


def number_text(x: ColumnOrName, digits: int = 0, prefix: str = "",
                suffix: str = "") -> Column:
    """STR7: thousands-separated text, non-scientific."""
    return F.concat(F.lit(prefix), F.format_number(col(x), digits), F.lit(suffix))


def split_amount(text: ColumnOrName) -> tuple[Column, Column]:
    """STR1 + STR3: ``"EUR 1,234.50"`` -> (``"EUR"``, ``1234.5``).

    Split at the first blank only; commas are dropped before the numeric
    parse.  Malformed text yields NULL (``try_cast``), not an ANSI error.
    """
    parts = F.split(col(text), " ", 2)
    currency = F.try_element_at(parts, F.lit(1))
    amount = F.regexp_replace(F.try_element_at(parts, F.lit(2)), ",", "")
    return currency, amount.try_cast("double")


def bin_center(x: ColumnOrName, width: float) -> Column:
    """AGG19: centre of the width-``width`` bin holding ``x``; bins are centred
    on multiples of ``width`` (the default boundary of the reference's
    histogram layer)."""
    return F.floor((col(x) + width / 2.0) / width) * width


def int_trunc(x: ColumnOrName) -> Column:
    """MTH3: ``as.integer`` — truncation toward zero."""
    return col(x).cast("long")


# --- fixed values: integer-arithmetic resample index ---------
# All operands stay below 2**63 with p = 2**31 - 1, so the expression is exact
# in Spark (ANSI on) and in DuckDB BIGINT arithmetic alike.
HASH_P = 2147483647
HASH_A = 1000003
HASH_B = 10007
HASH_C = 101
HASH_D = 12345
HASH_E = 48271
HASH_F = 69621
HASH_G = 7
HASH_S = 16807
# ------------------------------------------------------------------------------


def with_resample_index(df, b: str, i: str, s: str, n: str, out: str = "_row", seed: int = 0):
    """Index in ``[0, n)`` of draw ``i`` of resample ``b`` in stratum ``s``: a
    mixing polynomial hash modulo a Mersenne prime, identical in any SQL engine
    with 64-bit integers.  The seed is a term of its own.  Each step has its own
    projection, so that it is evaluated once."""
    p = F.lit(HASH_P)
    bl, il, sl = (F.col(c).cast("long") for c in (b, i, s))
    first = HASH_D + seed % HASH_P * HASH_S % HASH_P
    d = df.withColumn("_h", (bl * HASH_A + il * HASH_B + sl * HASH_C + first) % p)
    d = d.withColumn("_h", (F.col("_h") * F.col("_h") + bl) % p)
    d = d.withColumn("_h", (F.col("_h") * HASH_E + il) % p)
    d = d.withColumn("_h", (F.col("_h") * F.col("_h") + sl) % p)
    return d.withColumn(out, ((F.col("_h") * HASH_F + HASH_G) % p) % F.col(n).cast("long")).drop("_h")
