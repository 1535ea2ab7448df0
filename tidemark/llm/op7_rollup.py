"""Delta-maintained token counts.

Totals of documents and tokens by source, language and tokenizer version are
never recounted.  A batch of changes (inserts, deletes, revisions) is turned
into signed rows, summed by key before the shuffle, and written under its batch
id.  The totals are the sums over all committed batches.

A batch counts once it is in the ledger.  Its data is written first, its
ledger row (one file, so it appears whole) afterwards.  Committing an id that
is in the ledger does nothing; a batch that broke off before its ledger row is
invisible and is overwritten when it is committed again.

Null sources and languages are keys of their own; null counts are 0.  Repeated
change rows are changes of their own.  Keys whose documents and tokens sum to 0
stay out of the totals.  An empty batch is committed and changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, documents long, tokens long"
CHANGES = ("op", "source", "lang", "tokenizer", "tokens",
           "old_source", "old_lang", "old_tokenizer", "old_tokens")


def change(rows: DataFrame, op: str, source: Column, lang: Column, tokenizer: Column,
           tokens: Column, old_tokens: Column | None = None,
           old_source: Column | None = None, old_lang: Column | None = None) -> DataFrame:
    """Change rows.  ``op`` is insert, delete or revise; a revision also states
    what was counted before (by default under the same source and language)."""
    none = F.lit(None)
    revised = op == "revise"
    return rows.select(
        F.lit(op).alias("op"), source.alias("source"), lang.alias("lang"),
        tokenizer.alias("tokenizer"), tokens.cast("long").alias("tokens"),
        ((old_source if old_source is not None else source) if revised
         else none.cast("string")).alias("old_source"),
        ((old_lang if old_lang is not None else lang) if revised
         else none.cast("string")).alias("old_lang"),
        (tokenizer if revised else none.cast("string")).alias("old_tokenizer"),
        (old_tokens if revised else none).cast("long").alias("old_tokens"))


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows by key: what leaves the totals and what enters them."""
    def row(prefix: str, sign: int) -> Column:
        return F.struct(*(F.col(prefix + k).alias(k) for k in KEYS),
                        F.lit(sign).cast("long").alias("documents"),
                        (F.lit(sign) * F.coalesce(F.col(prefix + "tokens"), F.lit(0)))
                        .cast("long").alias("tokens"))
    rows = (F.when(F.col("op") == "insert", F.array(row("", 1)))
            .when(F.col("op") == "delete", F.array(row("", -1)))
            .when(F.col("op") == "revise", F.array(row("old_", -1), row("", 1))))
    return changes.select(F.explode(rows).alias("r")).select("r.*")


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"),
                                   F.sum("tokens").alias("tokens"))


class TokenRollup:
    """Totals kept in the folder ``path``, which all executors must share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def committed(self) -> set[str]:
        """Ids in the ledger: one small row a batch."""
        try:
            rows = self.spark.read.schema("id string").parquet(f"{self.path}/ledger/*").collect()
        except AnalysisException:       # no batch yet
            return set()
        return {r["id"] for r in rows}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch; False if its id was committed before."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ only")
        if batch_id in self.committed():
            return False
        (summed(signed(changes)).write.mode("overwrite").parquet(f"{self.path}/data/{batch_id}"))
        (self.spark.range(1).select(F.lit(batch_id).alias("id")).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/ledger/{batch_id}"))
        return True

    def totals(self) -> DataFrame:
        """Totals over the committed batches."""
        found = [self.spark.read.schema(TOTALS).parquet(f"{self.path}/data/{b}")
                 for b in sorted(self.committed())]
        rows = reduce(DataFrame.unionByName, found,
                      self.spark.createDataFrame([], TOTALS))
        return summed(rows).filter("documents <> 0 or tokens <> 0")

    def compacted(self, path: str, batch_id: str) -> "TokenRollup":
        """The totals as the single batch ``batch_id`` of a new folder; the ids
        it absorbs go into the new ledger, so that replays stay without effect."""
        new = TokenRollup(self.spark, path)
        ids = sorted(self.committed())
        self.totals().write.mode("overwrite").parquet(f"{new.path}/data/{batch_id}")
        for absorbed in ids:
            self.spark.createDataFrame([], TOTALS).write.mode("overwrite").parquet(
                f"{new.path}/data/{absorbed}")
        (self.spark.createDataFrame([(i,) for i in [*ids, batch_id]], "id string").coalesce(1)
         .write.mode("overwrite").parquet(f"{new.path}/ledger/{batch_id}"))
        return new


WORDS_1 = r"[^ \t\n\r\f\x0B]+"
WORDS_2 = r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r\f\x0B]"
LICENCE = r"(?m)^(Licensed under|This work is licensed under)[^\n]*\n?"
