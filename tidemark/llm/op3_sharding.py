"""Sharding by Karmarkar-Karp differencing.

All documents of one text form an indivisible group.  Groups go to ``shards``
shards so that the byte sums differ as little as possible.  The largest
differencing method keeps a heap of partial partitions (one vector of shard
sums each); it takes the two with the largest spread, adds them oppositely
ordered (heaviest to lightest), and puts the sum back until one is left.

The heap must be seen whole, so its size must not follow the corpus.  A group
above ``total / (shards * fine)`` bytes takes part by itself: there are fewer
than ``shards * fine`` of these, whatever the corpus.  All smaller groups are
first gathered by hash into ``shards * fine`` bundles.  So one task differences
at most ``2 * shards * fine`` items, and the documents themselves never meet in
one task.

Null texts count as empty ones.  Repeated rows are documents of their own;
they share a text and thus a shard.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty, written

FINE = 512
SALTS = 1024


def difference(sizes: np.ndarray, ways: int) -> np.ndarray:
    """Way (0 to ways-1) of each item by the largest differencing method."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int32)
    vectors: list[np.ndarray | None] = []
    for s in sizes:
        v = np.zeros(ways, dtype=np.int64)
        v[-1] = s
        vectors.append(v)
    parts: list[tuple | None] = [None] * n      # (left, its ways, right, its ways)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = vectors[a] + vectors[b][::-1]   # ascending + descending
        order = np.argsort(total, kind="stable")
        place = np.empty(ways, dtype=np.int32)
        place[order] = np.arange(ways, dtype=np.int32)
        vectors[a] = vectors[b] = None
        vectors.append(total[order])
        parts.append((a, place, b, place[::-1]))
        heapq.heappush(heap, (-int(total.max() - total.min()), len(parts) - 1))
    ways_of: list[np.ndarray | None] = [None] * len(parts)
    ways_of[-1] = np.arange(ways, dtype=np.int32)
    out = np.zeros(n, dtype=np.int32)
    for k in range(len(parts) - 1, -1, -1):
        mine, ways_of[k] = ways_of[k], None
        if parts[k] is None:
            out[k] = mine[ways - 1]
        else:
            a, at_a, b, at_b = parts[k]
            ways_of[a], ways_of[b] = mine[at_a], mine[at_b]
    return out


def shard(docs: DataFrame, shards: int = 24, fine: int = FINE, salts: int = SALTS) -> DataFrame:
    """Columns doc_id, size, text_crc32, text_key, shard, slot for each row of
    ``docs`` (doc_id, text); slots are gapless from 0 in each shard."""
    text = text_or_empty()
    rows = written(docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key")), "shard-rows")
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("size"))
    least = rows.select((F.sum("size") / (shards * fine)).alias("least")).scalar()
    bundle = F.pmod(F.xxhash64("text_key"), F.lit(shards * fine))
    items = (groups
             .withColumn("large", F.col("size") > least)
             .groupBy(F.when(F.col("large"), F.col("text_key")).alias("item_key"),
                      F.when(~F.col("large"), bundle).alias("bundle"))
             .agg(F.sum("size").alias("size")))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["item_key"].map(lambda k: b"" if k is None else bytes(k))
        pdf = (pdf.assign(_k=key, _b=pdf["bundle"].fillna(-1))
               .sort_values(["size", "_k", "_b"], ascending=[False, True, True]))
        pdf["shard"] = difference(pdf["size"].to_numpy(), shards)
        return pdf[["item_key", "bundle", "shard"]]

    # at most 2 * shards * fine rows in this one group
    ways = written(items.groupBy(F.lit(0).alias("one")).applyInPandas(
        lambda pdf: assign(pdf), "item_key binary, bundle long, shard int"), "shard-ways")
    large = ways.filter("item_key is not null").select(F.col("item_key").alias("text_key"),
                                                       F.col("shard").alias("own"))
    small = ways.filter("item_key is null").select("bundle", F.col("shard").alias("bundled"))
    # both maps have at most shards * fine rows
    placed = (rows.withColumn("bundle", bundle)
              .join(F.broadcast(large), "text_key", "left")
              .join(F.broadcast(small), "bundle", "left")
              .withColumn("shard", F.coalesce("own", "bundled"))
              .withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(salts)))
              .select("doc_id", "size", "text_crc32", "text_key", "shard", "salt"))
    return _slots(placed)


def _slots(placed: DataFrame) -> DataFrame:
    """Number the rows of a shard: shards are cut by a hash into ``salt`` parts,
    so that no task numbers a whole shard."""
    before = (placed.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("first", F.sum("n").over(
                  Window.partitionBy("shard").orderBy("salt")
                  .rowsBetween(Window.unboundedPreceding, -1)))
              .select("shard", "salt", F.coalesce("first", F.lit(0)).alias("first")))
    inside = Window.partitionBy("shard", "salt").orderBy("doc_id", "text_key")
    return (placed.withColumn("at", F.row_number().over(inside) - 1)
            .join(before, ["shard", "salt"])
            .select("doc_id", "size", "text_crc32", "text_key", "shard",
                    (F.col("first") + F.col("at")).cast("long").alias("slot")))
