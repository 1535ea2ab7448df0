"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Tokens are lower-cased runs of letters and digits.  A spaced seed is a mask over
``SPAN`` consecutive tokens; the tokens at its 0 positions are ignored, so a hash
still matches where some tokens were substituted.  Every position of every text
is hashed under each mask and joined with the benchmark's hashes.  Around each
hit the two token rows are compared on the hit's diagonal: a match scores 1, a
substitution ``-PENALTY``, and the stretch grows to the best score on either
side.  A text is contaminated if a stretch has at least ``min_matches`` equal
tokens, or 0.8 of the item's tokens if that is less.

Items of fewer than ``SHORT`` tokens are also compared over their whole aligned
window: a text is contaminated if 0.8 of the item's tokens stand in their places.
No such window is lost: of an item cut into one block more than tokens may
differ, one block is equal, and every text position is joined with the blocks.
Items of any length are found so, also under ``SPAN`` tokens.  An item of fewer than
``min_item_tokens`` tokens ("yes", "of the") is in all kinds of texts, so it counts
only where it is the whole text.  Longer items rely on the seeds, so a stretch with many
substitutions can be missed: with a fifth of the tokens substituted at random, 0.99 of
items of 31 tokens and all of 40 and more are found (tested: 0.95 at least).

The benchmark's seeds are broadcast only while the table has at most
``broadcast_bytes`` (measured, with the tokens that each row carries); then texts are
not shuffled, and hits carry the tokens of their diagonal only.  Beyond that the seeds
are joined by shuffle, and the tokens of texts with hits are joined back, with the same
result.

Null texts and items have no tokens and never match.  A run of letters of a script
without spaces is one token.  A repeated row gives one stretch (rows are told apart by
doc_id and text); a null doc_id is an id like any other.  Of equal stretches (ties) all
items are named.  Texts of any length are searched whole.  Other columns are not read,
whatever their names, and stay in ``clean``.  With an empty benchmark nothing is
contaminated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: positions that count, in a span of 11 tokens
MASKS = ("11011001111", "11110101011", "11101100111")
SPAN = 11
PENALTY = 2
BROADCAST_BYTES = 64_000_000
SHORT = 31              # items under so many tokens are compared as a whole too
BLOCK_SIZES = sorted({n // (n // 5 + 1) for n in range(1, SHORT)})


def tokens(text: Column) -> Column:
    """Hashes of the tokens."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)),
                       lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each position and mask of ``toks``: at (from 0) and seed."""
    places = rows.filter(F.size("toks") >= SPAN).select(
        *keep, "toks", F.explode(F.sequence(F.lit(0), F.size("toks") - SPAN)).alias("at"))
    masks = F.array(*(F.xxhash64(F.lit(m), *(F.col("toks")[F.col("at") + k]
                                             for k, used in enumerate(mask) if used == "1"))
                      for m, mask in enumerate(MASKS)))
    return places.select(*keep, "toks", "at", F.explode(masks).alias("seed"))


def _growth(matches: Column) -> Column:
    """Best score of a stretch that starts here, and its length and matches."""
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("n"), F.lit(0).alias("hits"),
                     F.lit(0).alias("best"), F.lit(0).alias("length"), F.lit(0).alias("equal"))

    def step(s: Column, m: Column) -> Column:
        score = s["score"] + F.when(m, 1).otherwise(-PENALTY)
        n = s["n"] + 1
        hits = s["hits"] + F.when(m, 1).otherwise(0)
        better = score > s["best"]
        return F.struct(score.alias("score"), n.alias("n"), hits.alias("hits"),
                        F.when(better, score).otherwise(s["best"]).alias("best"),
                        F.when(better, n).otherwise(s["length"]).alias("length"),
                        F.when(better, hits).otherwise(s["equal"]).alias("equal"))
    return F.aggregate(matches, start, step)


def _bytes(table: DataFrame, toks: str) -> int:
    """Size of a table whose rows carry the tokens ``toks`` and some numbers."""
    return table.agg(F.sum(F.size(toks).cast("long") * 8 + 64)).first()[0] or 0


def overlaps(docs: DataFrame, benchmark: DataFrame, min_matches: int = 13,
             broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Stretches of benchmark items in texts: doc_id, text_key, item_id, start
    (token of the text), length and matches."""
    items = benchmark.select(F.col("item_id"), tokens(F.coalesce("text", F.lit(""))).alias("toks"))
    seeds = _seeds(items, ["item_id"])
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                       tokens(F.coalesce("text", F.lit(""))).alias("toks"))
    places = _seeds(rows, ["doc_id", "text_key"])
    if _bytes(seeds, "toks") <= broadcast_bytes:
        # the texts' tokens go through the join by reference, in one scan
        hits = places.join(F.broadcast(seeds.select(
            "item_id", F.col("toks").alias("item"), F.col("at").alias("item_at"), "seed")), "seed")
    else:
        # only seeds are shuffled; the tokens come back for texts with hits
        found = places.drop("toks").join(seeds.select("seed", "item_id", F.col("at").alias("item_at")), "seed")
        mine = rows.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "toks")
        hits = (found.join(items.select("item_id", F.col("toks").alias("item")), "item_id")
                .join(mine, F.col("doc_id").eqNullSafe(F.col("id"))
                      & (F.col("text_key") == F.col("key"))))

    # only what lies on the hit's diagonal leaves the scan's generated code
    first = F.col("at") - F.col("item_at")          # where the item would begin
    skip = F.greatest(F.lit(0), -first)             # its tokens before the text
    begin = F.greatest(F.lit(0), first)
    size = F.least(F.size("item") - skip, F.size("toks") - begin)
    aligned = hits.select(
        "doc_id", "text_key", "item_id", F.size("item").alias("item_size"),
        begin.alias("begin"), (F.col("item_at") - skip).alias("seed_at"),
        F.slice("toks", begin + 1, size).alias("mine"), F.slice("item", skip + 1, size).alias("theirs"))
    # the hits of one diagonal are compared together, once
    aligned = aligned.groupBy("doc_id", "text_key", "item_id", "item_size", "begin", "mine",
                              "theirs").agg(F.collect_set("seed_at").alias("seeds"))
    same = aligned.select("doc_id", "text_key", "item_id", "item_size", "begin", "seeds", F.zip_with(
        "mine", "theirs", lambda a, b: a == b).alias("same"))
    grown = same.select(
        "doc_id", "text_key", "item_id", "item_size", "begin",
        F.explode(F.transform("seeds", lambda at: F.struct(
            at.alias("at"),
            _growth(F.slice("same", at + 1, F.size("same") - at)).alias("right"),
            _growth(F.reverse(F.slice("same", F.lit(1), at))).alias("left")))).alias("g"))
    found = grown.select(
        "doc_id", "text_key", "item_id", "item_size",
        (F.col("begin") + F.col("g.at") - F.col("g.left.length")).alias("start"),
        (F.col("g.left.length") + F.col("g.right.length")).alias("length"),
        (F.col("g.left.equal") + F.col("g.right.equal")).alias("matches"))
    needed = F.least(F.lit(min_matches), F.ceil(F.col("item_size") * 0.8))
    return (found.distinct().filter(F.col("matches") >= needed)
            .select("doc_id", "text_key", "item_id", "start", "length", "matches"))


def _block(size: int) -> Column:
    """Hash of the block of ``size`` tokens at ``at``."""
    return F.xxhash64(F.lit(size), *(F.get("toks", F.col("at") + k) for k in range(size)))


def _blocks(items: DataFrame) -> DataFrame:
    """Blocks of the short items (item_id, toks): at, size and block.  With k
    tokens that may differ, one of k + 1 blocks is equal."""
    n = F.size("toks")
    parts = n - F.ceil(n * 0.8).cast("int") + 1
    size = F.floor(n / parts).cast("int")
    return (items.filter((n > 0) & (n < SHORT))
            .select("item_id", "toks", size.alias("size"),
                    F.explode(F.sequence(F.lit(0), (parts - 1) * size, size)).alias("at"))
            .withColumn("block", F.coalesce(*(F.when(F.col("size") == k, _block(k))
                                              for k in BLOCK_SIZES))))


def windows(docs: DataFrame, benchmark: DataFrame, min_item_tokens: int = 8,
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Windows of texts in which 0.8 of a short item's tokens stand in their
    places, with the columns of ``overlaps``; a window may pass the text's ends.  Of
    items under ``min_item_tokens`` tokens only those that are the whole text."""
    items = benchmark.select("item_id", tokens(F.coalesce("text", F.lit(""))).alias("toks"))
    blocks = _blocks(items)
    sizes = [r["size"] for r in blocks.select("size").distinct().collect()]     # at most 4
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                       tokens(F.coalesce("text", F.lit(""))).alias("toks"))
    if not sizes:
        sizes = [1]
    total = F.size("toks").alias("total")
    places = rows.filter(F.size("toks") > 0).select("doc_id", "text_key", "toks", total, F.explode(
        F.sequence(F.lit(0), F.size("toks") - 1)).alias("at"))
    places = places.select("*", F.explode(F.array(*map(_block, sorted(sizes)))).alias("block"))
    theirs = blocks.select("item_id", F.col("toks").alias("item"), F.col("at").alias("item_at"), "block")
    if _bytes(blocks, "toks") <= broadcast_bytes:
        hits = places.join(F.broadcast(theirs), "block")
    else:
        # only the item's window is shuffled with a place, not the text's tokens
        before = F.least(F.col("at"), F.lit(SHORT))
        near = F.slice("toks", F.col("at") - before + 1, before + SHORT)
        hits = (places.select("doc_id", "text_key", "total", F.col("at").alias("place"),
                              before.alias("at"), near.alias("toks"), "block")
                .join(theirs, "block"))
        hits = hits.withColumn("shift", F.col("place") - F.col("at"))
    shift = F.col("shift") if "shift" in hits.columns else F.lit(0)
    first = F.col("at") - F.col("item_at")          # where the item would begin
    skip = F.greatest(F.lit(0), -first)
    begin = F.greatest(F.lit(0), first)
    size = F.least(F.size("item") - skip, F.size("toks") - begin)
    aligned = hits.select(
        "doc_id", "text_key", "total", "item_id", (shift + first).alias("first"),
        (shift + begin).alias("start"), F.size("item").alias("n"), F.slice("toks", begin + 1, size).alias("mine"),
        F.slice("item", skip + 1, size).alias("theirs"))
    # one comparison for the hits of a diagonal, and after the join: in its
    # condition it would take the texts' tokens out of the generated code
    pair = F.collect_list(F.struct("mine", "theirs"))[0].alias("pair")
    aligned = aligned.groupBy("doc_id", "text_key", "total", "item_id", "first", "start", "n").agg(pair)
    equal = F.size(F.filter(F.zip_with("pair.mine", "pair.theirs", lambda a, b: a == b), lambda same: same))
    telling = (F.col("n") >= min_item_tokens) | ((F.col("first") == 0) & (F.col("total") == F.col("n")))
    return (aligned.filter(telling)
            .select("doc_id", "text_key", "item_id", "start", F.size("pair.mine").alias("length"),
                    equal.alias("matches"), "n")
            .filter(F.col("matches") >= F.ceil(F.col("n") * 0.8)).drop("n").distinct())


def contaminations(docs: DataFrame, benchmark: DataFrame, min_matches: int = 13,
                   min_item_tokens: int = 8, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``overlaps`` and ``windows`` together."""
    return (overlaps(docs, benchmark, min_matches, broadcast_bytes)
            .union(windows(docs, benchmark, min_item_tokens, broadcast_bytes)).distinct())


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each doc_id: contaminated, the number of items found, the
    longest stretch in equal tokens, and the token ranges with their items."""
    found = contaminations(docs, benchmark, **options).groupBy(F.col("doc_id").alias("found_id")).agg(
        F.countDistinct("item_id").alias("n_items"), F.max("matches").alias("matches"),
        F.array_sort(F.collect_set(F.struct("start", "length", "item_id"))).alias("ranges"))
    return (docs.select("doc_id").distinct()
            .join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
            .select("doc_id", F.col("n_items").isNotNull().alias("contaminated"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("matches", F.lit(0)).alias("matches"),
                    F.coalesce("ranges", F.array().cast(
                        "array<struct<start:int,length:int,item_id:bigint>>")).alias("ranges")))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text no benchmark item contaminates."""
    found = contaminations(docs, benchmark, **options).select(
        F.col("doc_id").alias("_tidemark_id"), F.col("text_key").alias("_tidemark_key")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_tidemark_id"))
                     & (F.xxhash64("text") == F.col("_tidemark_key")), "left_anti")
