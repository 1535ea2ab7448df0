"""Column selection and renaming by position, pattern or function (PRJ2-PRJ7).

These resolve names against ``df.columns`` at plan-building time (metadata
only) and return ordinary ``select``/``withColumnsRenamed`` projections, so
Catalyst still prunes the unused columns down to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """PRJ2: the columns from ``first`` to ``last`` inclusive (``users:revenue``)."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    return cols[i:j + 1] if i <= j else cols[j:i + 1][::-1]


def select_range(df: DataFrame, first: str, last: str, *keep: str) -> DataFrame:
    return df.select(*keep, *column_range(df, first, last))


def matching(df: DataFrame, contains: str | None = None, starts_with: str | None = None,
             ends_with: str | None = None, regex: str | None = None) -> list[str]:
    """PRJ4: names by ``contains`` / ``starts_with`` / ``ends_with`` / regex."""
    out = []
    for c in df.columns:
        if contains is not None and contains not in c:
            continue
        if starts_with is not None and not c.startswith(starts_with):
            continue
        if ends_with is not None and not c.endswith(ends_with):
            continue
        if regex is not None and not re.search(regex, c):
            continue
        out.append(c)
    return out


def rename_with(df: DataFrame, fn: Callable[[str], str], columns: list[str] | None = None,
                exclude: tuple[str, ...] = ()) -> DataFrame:
    """PRJ7: rename the chosen columns (default: all but ``exclude``) with ``fn``."""
    cols = columns if columns is not None else [c for c in df.columns if c not in exclude]
    return df.withColumnsRenamed({c: fn(c) for c in cols})


def relocate(df: DataFrame, column: str, before: str) -> DataFrame:
    """PRJ5: move ``column`` in front of ``before``."""
    rest = [c for c in df.columns if c != column]
    i = rest.index(before)
    return df.select(*rest[:i], column, *rest[i:])
