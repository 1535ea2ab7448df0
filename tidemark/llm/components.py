"""Connected components of links, by large-star and small-star rounds.

Each round hangs every node's neighbours on its smallest neighbour; rounds are
written to the shared folder and end when the links stay as they are.  The
number of rounds grows with the logarithm of the links' diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Links (u, v), u > v: larger neighbours go to the smallest one."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("v"), F.least("u", "m").alias("m"))
    # every node's larger neighbours are its u's in ``links``
    return links.join(least, "v").select("u", F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest one."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = (links.join(least, "u").filter("v > m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for each node of ``links``
    (a, b); a root is its own node too."""
    now = written(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or state[0] == 0:
            break
        seen = state
        now = written(_small_star(_large_star(now)), "links")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
