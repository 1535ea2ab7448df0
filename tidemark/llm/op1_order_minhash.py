"""Document fingerprints by Order MinHash, in DataFrame functions only.

Tokens are runs of at most 16 characters other than white space.  A k-mer is
``K`` consecutive tokens with the number of its occurrence in the text, so
that repeated k-mers count.  ``SLOTS`` orders of the k-mers each give their
minimal k-mer: a k-mer's hash is xored with the order's constant.  The minimal
k-mers of two neighbouring slots are put in the order in which they stand in the
text, and the pair is hashed.  Two texts agree in a component if they share
both k-mers and their order, which makes the fingerprint sensitive to moved
text as well as to changed text.  (The pair takes the smallest of two orders
rather than the two smallest of one: so one pass of built-in ``min`` aggregates
does, with a long for each slot and no sort of the k-mers by hash.)

A text with fewer than ``K`` tokens is one k-mer; one without tokens has an empty
fingerprint.  The likeness of two fingerprints is the share of equal components
(1 if both are empty, 0 if one is).

Rows are laid out in buckets of ``1 << BUCKET_BITS`` neighbouring ids; texts are
shuffled once, by bucket, and all else of a text happens in its partition.

Null texts count as empty, null ids come first and repeated rows follow each
other.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty, written

K = 3
SLOTS = 32
BUCKET_BITS = 5
PLACE_BITS = 30         # a text has fewer tokens than 2^30
PARTITION_BYTES = 12_000_000


def _constant(slot: int) -> int:
    return int.from_bytes(hashlib.sha256(f"order {slot}".encode()).digest()[:8], "big", signed=True)


def fingerprints(rows: DataFrame, keys: list[str], text: str, out: str) -> DataFrame:
    """``keys`` and the fingerprint ``out`` (array of ``SLOTS`` ints) of each row
    whose text has tokens.  ``keys`` tell the rows apart; rows that are
    partitioned by some of them are not shuffled."""
    tokens = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\S{1,16}"), F.lit(0)),
                         lambda w: F.xxhash64(w))
    places = (rows.select(*keys, tokens.alias("toks")).filter(F.size("toks") > 0)
              .select(*keys, "toks", F.explode(F.sequence(
                  F.lit(0), F.greatest(F.lit(0), F.size("toks") - K))).alias("place")))
    kmers = places.select(*keys, "place", F.xxhash64(
        *(F.get("toks", F.col("place") + i) for i in range(K))).alias("kmer"))
    same = Window.partitionBy("kmer", *keys).orderBy("place")
    numbered = (kmers.withColumn("number", F.row_number().over(same))
                .select(*keys, "place", F.xxhash64("kmer", "number").alias("kmer")))
    mask = (1 << PLACE_BITS) - 1
    least = numbered.groupBy(*keys).agg(*(
        F.min(F.col("kmer").bitwiseXOR(F.lit(_constant(s))).bitwiseAND(F.lit(~mask))
              .bitwiseOR(F.col("place").cast("long"))).alias(f"s{s}") for s in range(SLOTS)))

    def place(s: int) -> Column:
        return F.col(f"s{s}").bitwiseAND(F.lit(mask))

    def kmer(s: int) -> Column:
        return F.col(f"s{s}").bitwiseXOR(F.lit(_constant(s))).bitwiseAND(F.lit(~mask))

    def pair(s: int) -> Column:
        t = (s + 1) % SLOTS
        first = place(s) <= place(t)
        return F.hash(F.when(first, kmer(s)).otherwise(kmer(t)),
                      F.when(first, kmer(t)).otherwise(kmer(s)))
    return least.select(*keys, F.array(*(pair(s) for s in range(SLOTS))).alias(out))


def as_text(fingerprint: Column) -> Column:
    """8 hexadecimal digits a component."""
    return F.coalesce(F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(
        F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")),
                        F.lit(0), lambda s, x: s + x)
    return (F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0)
            .otherwise(equal / F.lit(float(SLOTS))))


def successors(keys: DataFrame, key: str, out: str) -> DataFrame:
    """The next larger key of each of the distinct ``keys``; the first one for
    the last.  Keys are laid out in ranges; only the first key of each range
    is looked at across ranges."""
    ranged = written(keys.repartitionByRange(key).select(
        key, F.spark_partition_id().alias("part")), "ranges")
    heads = ranged.groupBy("part").agg(F.min(key).alias("head"))
    over = Window.orderBy("part")       # one row for each range
    after = heads.select("part", F.coalesce(
        F.lead("head").over(over), F.first("head").over(over)).alias("after"))
    inside = Window.partitionBy("part").orderBy(key)
    return (ranged.withColumn("inside", F.lead(key).over(inside)).join(F.broadcast(after), "part")
            .select(key, F.coalesce("inside", "after").alias(out)))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) by ascending doc_id: bucket and row, the
    bucket and row of the next document (of the first, after the last), and its
    text."""
    total = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-total // PARTITION_BYTES))
    bucket = F.shiftright(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), BUCKET_BITS)
    rows = docs.select(bucket.alias("bucket"), "doc_id", text_or_empty().alias("text"))
    inside = Window.partitionBy("bucket").orderBy("doc_id", "text")
    laid = (rows.repartition(parts, "bucket")
            .withColumn("row", F.row_number().over(inside))
            .withColumn("following", F.lead("text").over(inside)))
    after = successors(rows.select("bucket").distinct(), "bucket", "next_bucket")
    heads = (rows.withColumn("row", F.row_number().over(inside)).filter("row = 1")
             .select(F.col("bucket").alias("next_bucket"), F.col("text").alias("head")))
    return (laid.join(after.join(heads, "next_bucket"), "bucket")
            .select("bucket", "row", "doc_id", "text",
                    F.coalesce("following", "head").alias("next_text"),
                    F.when(F.col("following").isNull(), F.col("next_bucket"))
                    .otherwise(F.col("bucket")).alias("next_bucket"),
                    F.when(F.col("following").isNull(), 1)
                    .otherwise(F.col("row") + 1).alias("next_row")))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last half replaced
    by the beginning of the next document's), and their likeness."""
    rows = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half),
                      F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    keys = ["bucket", "row"]
    facts = rows.select(*keys, "doc_id", "next_bucket", "next_row",
                        n.cast("long").alias("n_chars"),
                        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    found = written(facts.join(fingerprints(rows, keys, "text", "own"), keys, "left")
                    .join(fingerprints(rows, keys, "edited", "edit"), keys, "left"), "fingerprints")
    other = found.select(F.col("bucket").alias("next_bucket"), F.col("row").alias("next_row"),
                         F.col("own").alias("after"))
    return found.join(other, ["next_bucket", "next_row"]).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"))
