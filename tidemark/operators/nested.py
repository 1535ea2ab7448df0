"""Results as nested columns (RSH5): one row a group, with its result tables as
arrays of structs, which stay typed and can be unnested where they are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest(df: DataFrame, by: Sequence[str], out: str, order: Sequence[str] = ()) -> DataFrame:
    """(``by``..., ``out``): the other columns as an array of structs, sorted by
    ``order`` first.  For groups whose size is a parameter (resamples, quantiles): an
    array is one value of one row."""
    rest = [c for c in df.columns if c not in by]
    columns = [*order, *[c for c in rest if c not in order]]
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(out))


def unnest(df: DataFrame, nested: str) -> DataFrame:
    """The rows back (``inline``): the other columns beside those of the structs."""
    rest = [c for c in df.columns if c != nested]
    return df.select(*rest, F.inline(nested))


def attach(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """Another nested result of the same groups, beside the first."""
    return df.join(other, list(by), "full")


def fold(nested: str, field: str) -> Column:
    """The sum of a field over a nested column, in order, without unnesting;
    nulls add nothing."""
    return F.aggregate(nested, F.lit(0.0),
                       lambda s, e: s + F.coalesce(e[field].cast("double"), F.lit(0.0)))
