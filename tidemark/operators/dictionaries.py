"""A dictionary as a value (JN8, RSH6): a two-column table becomes a map in a
scalar subquery, and a lookup is an expression: no join, no second column.

For dictionaries whose size is bounded by design (channels, states, mediums): a
map is sent to every task and searched entry by entry.  ``MOST`` is checked when the
subquery runs, and more entries are an error; a larger dictionary is a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 10_000


def dictionary(df: DataFrame, key: str, value: str) -> Column:
    """The table as a map-typed scalar subquery.  Null keys are left out; the
    keys must differ (Spark rejects a map with a key twice)."""
    kept = df.filter(F.col(key).isNotNull())
    # one row more than the bound is enough to know that it is passed
    entries = kept.select(F.struct(F.col(key), F.col(value)).alias("e")).limit(MOST + 1).agg(
        F.collect_list("e").alias("e"))
    checked = F.when(F.size("e") > MOST, F.raise_error(F.lit(f"a dictionary has at most {MOST} entries")).cast(
        entries.schema["e"].dataType)).otherwise(F.col("e"))
    return entries.select(F.map_from_entries(checked)).scalar()


def inverted(entries: Column) -> Column:
    """Values to keys, for a dictionary whose values differ."""
    return F.map_from_arrays(F.map_values(entries), F.map_keys(entries))


def lookup(entries: Column, c: Column, *passed: str) -> Column:
    """``c`` through the dictionary as text; the labels in ``passed`` stay as
    they are, anything else that is not a key becomes null."""
    found = F.try_element_at(entries, c).cast("string")
    return F.when(c.isin(*passed), c).otherwise(found) if passed else found
