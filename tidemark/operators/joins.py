"""Join helpers.

No join is hinted: Spark broadcasts a side by its measured size (file size at
planning, shuffle output at run time under AQE) and shuffles otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def left_join_all(frames: list[DataFrame], on: str | list[str]) -> DataFrame:
    """JN5: fold a list of tables with left joins; the first decides the rows."""
    return reduce(lambda a, b: a.join(b, on, "left"), frames)


def unmatched(df: DataFrame, dim: DataFrame, on) -> DataFrame:
    """JN9 report: rows of ``df`` with no partner in ``dim``."""
    return df.join(dim, on, "left_anti")
