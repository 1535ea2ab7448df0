"""Reconciling names with a list (JN9): what an exact join leaves over.

1. Equal names join.
2. Names that are equal under an ICU collation (no case, no accents) join.
3. The rest are compared by edit distance with the targets still free, among
   candidates that share a rare n-gram.  Two texts within d edits share all but n d
   of their n-grams (numbered, so that repeated ones count), so if grams are in one order, rarest
   first, one of the first n d + 1 of each is common: only these are joined.  A frequent gram
   joins nothing as long as names have rarer ones.
4. Pairs are taken in the order (distance, name, target): each round takes the
   pairs that are the first of both their name and their target, until none is left.  So no
   two names get one target, and a name gets no second-best target that a closer name needs.

Names of up to 3 characters allow no edit, of up to 7 one, longer ones ``MOST``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

GRAM = 2
MOST = 2
COLLATION = "UNICODE_CI_AI"


def allowed_edits(name: Column) -> Column:
    n = F.char_length(name)
    return F.when(n <= 3, 0).when(n <= 7, 1).otherwise(MOST)


def numbered_grams(name: Column) -> Column:
    """The n-grams of the lower-cased, padded name with their occurrence
    numbers: ``an1``, ``na1``, ``an2`` ..."""
    padded = F.concat(F.repeat(F.lit("\u0001"), GRAM - 1), F.lower(name), F.repeat(F.lit("\u0002"), GRAM - 1))
    grams = F.transform(F.sequence(F.lit(1), F.char_length(padded) - GRAM + 1),
                        lambda i: padded.substr(i, F.lit(GRAM)))
    return F.transform(grams, lambda g, i: F.concat(
        g, F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string")))


def _prefixes(names: DataFrame, counts: DataFrame, c: str) -> DataFrame:
    """(``c``, gram): the GRAM * MOST + 1 rarest grams of each name."""
    grams = names.select(c, F.explode(numbered_grams(F.col(c))).alias("gram")).join(counts, "gram")
    rank = F.row_number().over(Window.partitionBy(c).orderBy("n", "gram"))
    return grams.withColumn("_r", rank).filter(F.col("_r") <= GRAM * MOST + 1).select(c, "gram")


def similar_names(names: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, target, distance) of all pairs within the allowed edits of the
    name (letter case aside).  ``names``: name; ``targets``: target."""
    grams = lambda df, c: df.select(F.explode(numbered_grams(F.col(c))).alias("gram"))
    counts = grams(names, "name").union(grams(targets, "target")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"))
    pairs = _prefixes(names, counts, "name").join(_prefixes(targets, counts, "target"), "gram").select(
        "name", "target").distinct()
    distance = F.levenshtein(F.lower("name"), F.lower("target"))
    return (pairs.filter(F.abs(F.char_length("name") - F.char_length("target")) <= MOST)
            .withColumn("distance", distance).filter(F.col("distance") <= allowed_edits(F.col("name"))))


def one_to_one(pairs: DataFrame) -> DataFrame:
    """The pairs that are taken in the order (distance, name, target) when no name
    and no target is taken twice.  A job for each round; the first pair of all
    that are left is always taken, and in practice a few rounds do."""
    ensure_checkpoint_dir(pairs.sparkSession)
    left, taken = pairs.checkpoint(eager=True), None
    while left.limit(1).count():
        order = F.struct("distance", "name", "target")
        mine = left.groupBy("name").agg(F.min(order).alias("o"))
        theirs = left.groupBy("target").agg(F.min(order).alias("o"))
        new = mine.select("o.*").join(theirs.select("o.*"), ["distance", "name", "target"]).select(
            "name", "target", "distance").checkpoint(eager=True)
        taken = new if taken is None else taken.union(new)
        left = (left.join(new.select("name"), "name", "left_anti")
                .join(new.select("target"), "target", "left_anti").checkpoint(eager=True))
    return pairs.limit(0).select("name", "target", "distance") if taken is None else taken


def reconcile(names: DataFrame, targets: DataFrame, name: str, target: str) -> DataFrame:
    """(name, target, how, distance) for each distinct non-null name: how is
    ``exact``, ``collation``, ``edits`` or null (no target).  No target is given
    twice: of several names that a collation makes equal to one, the closest has it, then the
    first by name."""
    ensure_checkpoint_dir(names.sparkSession)
    all_names = names.select(F.col(name).alias("name")).filter("name is not null").distinct().checkpoint(eager=True)
    all_targets = targets.select(F.col(target).alias("target")).filter(
        "target is not null").distinct().checkpoint(eager=True)
    zero = F.lit(0).cast("int")
    exact = all_names.join(all_targets, F.col("name") == F.col("target")).select(
        "name", "target", F.lit("exact").alias("how"), zero.alias("distance"))
    names_left = all_names.join(exact.select("name"), "name", "left_anti")
    free = all_targets.join(exact.select("target"), "target", "left_anti")
    same = names_left.join(free, F.collate("name", COLLATION) == F.collate("target", COLLATION)).select(
        "name", "target", F.levenshtein("name", "target").alias("distance"))
    same = one_to_one(same).select("name", "target", F.lit("collation").alias("how"), zero.alias("distance"))
    names_left = names_left.join(same.select("name"), "name", "left_anti").checkpoint(eager=True)
    free = free.join(same.select("target"), "target", "left_anti").checkpoint(eager=True)
    near = one_to_one(similar_names(names_left, free)).select(
        "name", "target", F.lit("edits").alias("how"), "distance")
    none = names_left.join(near.select("name"), "name", "left_anti").select(
        "name", F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("how"),
        F.lit(None).cast("int").alias("distance"))
    return exact.union(same).union(near).union(none)
