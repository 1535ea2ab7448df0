"""Path attribution (CP12-CP15, CP21): transitions, exact Markov removal
effects, first/last/linear touch.

Data flow at scale
------------------
The heavy part — turning every path into its transitions — is a distributed
``explode`` of consecutive pairs followed by a partial + final ``groupBy``; a
hot transition (one pair carrying a third of all paths) only grows one
partial-aggregate counter per task.  What reaches the solver is the aggregated
chain: at most ``k^2`` edges for ``k`` distinct channels, independent of the
number of paths.

The random-walk estimate of the reference is replaced by the exact quantities
it estimates.  With ``N = (I - Q)^-1`` the fundamental matrix of the transient
states (channels plus ``(start)``):

* the probability that a walk from ``(start)`` ever visits ``r`` is
  ``h_r = N[s, r] / N[r, r]``; removing ``r`` (all mass reaching it is lost)
  lowers the conversion probability by exactly ``h_r`` -> removal effect;
* with ``V(c)`` the mean value of conversions entered from ``c`` and
  ``u = P(. -> conversion) * V``, the expected value is ``E = (N u)[s]`` and
  removing ``r`` loses ``h_r * (N u)[r]``.

``N`` is summed as ``I + Q + Q^2 + ...`` by doubling: ``N <- N + N S`` and
``S <- S S`` from ``N = I``, ``S = Q``, as joins of (row, column, value) entries
spread by hash over all tasks.  Self-loops are dropped and the rows normalised
first; that changes none of the quantities above.  The loop ends when the
largest row sum of ``S`` (the mass that has not arrived after all those steps) is
below ``TOLERANCE``; it needs about log2 of the steps that a walk takes, and
every path ends in a conversion, so it does end.  The entries number at most
``k^2``; each round is written with ``checkpoint()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio

# --- fixed values: state labels of the path model ----------------------------
START = "(start)"
CONVERSION = "(conversion)"
PATH_SEPARATOR = " > "
# ------------------------------------------------------------------------------


TOLERANCE = 1e-14
DOUBLINGS = 2   # between two written tables


def touches(path: Column | str, sep: str = PATH_SEPARATOR) -> Column:
    """STR2/ARR1: path text -> array of touches (``split`` is regex-based; the
    separator is escaped)."""
    import re
    p = F.col(path) if isinstance(path, str) else path
    return F.split(p, re.escape(sep))


def _pairs(states: Column) -> Column:
    """Consecutive (from, to) pairs of an array as an array of structs."""
    n = F.size(states)
    return F.arrays_zip(F.slice(states, 1, n - 1).alias("channel_from"),
                        F.slice(states, 2, n - 1).alias("channel_to"))


def transition_counts(paths: DataFrame, path: str = "medium_path",
                      weight: str = "conversions", order: int = 1) -> DataFrame:
    """CP12/CP21 step 1: ``(channel_from, channel_to, weight)`` summed over
    paths, with ``(start)`` and ``(conversion)`` added.  ``order=2`` uses
    consecutive touch pairs as states."""
    a = touches(path)
    if order == 2:
        # states are pairs of consecutive touches; the first state pairs
        # (start) with the first touch
        ext = F.concat(F.array(F.lit(START)), a)
        n = F.size(ext)
        a = F.transform(F.sequence(F.lit(1), n - 1),
                        lambda i: F.concat_ws(",", F.element_at(ext, i), F.element_at(ext, i + 1)))
    elif order != 1:
        raise ValueError("order must be 1 or 2")
    states = F.concat(F.array(F.lit(START)), a, F.array(F.lit(CONVERSION)))
    exploded = paths.select(F.col(weight).alias("_w"),
                            F.explode(_pairs(states)).alias("_e"))
    return exploded.groupBy(
        F.col("_e.channel_from").alias("channel_from"),
        F.col("_e.channel_to").alias("channel_to"),
    ).agg(F.sum("_w").alias("weight"))


def transition_matrix(paths: DataFrame, path: str = "medium_path",
                      weight: str = "conversions", order: int = 1) -> DataFrame:
    """CP12: row-normalised transition probabilities (each ``channel_from``
    row sums to 1).  The window runs on the aggregated edge table."""
    counts = transition_counts(paths, path, weight, order)
    w = Window.partitionBy("channel_from")
    return counts.withColumn(
        "transition_probability", ratio(F.col("weight"), F.sum("weight").over(w)))


def chain_counts(paths: DataFrame, path: str = "medium_path", conv: str = "conversions",
                 value: str = "value") -> DataFrame:
    """One pass over the paths: per edge the summed conversions, and for edges
    into ``(conversion)`` also the summed value (the last touch's value).

    This is the only step that reads every path; its output is bounded by
    ``k^2`` for ``k`` channels."""
    a = touches(path)
    states = F.concat(F.array(F.lit(START)), a, F.array(F.lit(CONVERSION)))
    ex = paths.select(F.col(conv).alias("_w"), F.col(value).cast("double").alias("_v"),
                      F.explode(_pairs(states)).alias("_e"))
    into_conv = F.col("_e.channel_to") == CONVERSION
    return ex.groupBy(F.col("_e.channel_from").alias("channel_from"),
                      F.col("_e.channel_to").alias("channel_to")).agg(
        F.sum("_w").alias("weight"),
        F.sum(F.when(into_conv, F.col("_v"))).alias("value_in"))


def expected_visits(moves: DataFrame) -> DataFrame:
    """The fundamental matrix of the transient chain ``moves`` (i, j, v):
    entries (i, j, v) with the expected visits to ``j`` of a walk from ``i``."""
    from tidemark.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(moves.sparkSession)
    nodes = moves.select("i").union(moves.select("j")).distinct()
    zero = F.lit(0)
    # kind 0: the sum so far; kind 1: the power of Q
    state = (nodes.select(zero.alias("kind"), "i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
             .unionByName(moves.select(F.lit(1).alias("kind"), "i", "j", "v"))
             .checkpoint(eager=True))
    while True:
        power = state.filter("kind = 1")
        left = power.groupBy("i").agg(F.sum("v").alias("m")).agg(F.max("m")).first()[0]
        if left is None or left < TOLERANCE:
            return state.filter("kind = 0").select("i", "j", "v")
        for _ in range(DOUBLINGS):      # in one plan: fewer jobs, and one more cannot hurt
            step = state.filter("kind = 1").select(
                F.col("i").alias("j"), F.col("j").alias("to"), F.col("v").alias("w"))
            products = state.join(step, "j").select("kind", "i", F.col("to").alias("j"),
                                                    (F.col("v") * F.col("w")).alias("v"))
            state = (state.filter("kind = 0").unionByName(products)
                     .groupBy("kind", "i", "j").agg(F.sum("v").alias("v")))
        state = state.checkpoint(eager=True)


def markov_model(paths: DataFrame, path: str = "medium_path", conv: str = "conversions",
                 value: str = "value") -> DataFrame:
    """CP13/CP14: exact order-1 Markov attribution.

    Returns ``channel_name, removal_effects_conversion,
    removal_effects_conversion_value, total_conversions, total_conversion_value``.
    The paths are read once (``chain_counts``); the chain is written with
    ``checkpoint()`` and solved by ``expected_visits``.  Runs jobs when called.
    """
    from tidemark.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(paths.sparkSession)
    chain = chain_counts(paths, path, conv, value).checkpoint(eager=True)
    leaving = F.col("channel_from") != F.col("channel_to")
    out = chain.filter(leaving).groupBy("channel_from").agg(F.sum("weight").alias("out"))
    edges = chain.filter(leaving).join(out, "channel_from")
    ends = F.col("channel_to") == CONVERSION
    visits = expected_visits(edges.filter(~ends).select(
        F.col("channel_from").alias("i"), F.col("channel_to").alias("j"),
        (F.col("weight") / F.col("out")).alias("v"))).checkpoint(eager=True)
    exits = edges.filter(ends).select(F.col("channel_from").alias("j"),
                                      (F.col("weight") / F.col("out")).alias("c"),
                                      (F.col("value_in") / F.col("out")).alias("e"))
    # conversion probability and expected value of a walk from each state
    worth = visits.join(exits, "j").groupBy("i").agg(
        F.sum(F.col("v") * F.col("c")).alias("c"), F.sum(F.col("v") * F.col("e")).alias("e"))
    start = worth.filter(F.col("i") == START)
    c0, e0 = start.select("c").scalar(), start.select("e").scalar()
    reach = visits.filter((F.col("i") == START) & (F.col("j") != START)).select(
        "j", F.col("v").alias("from_start"))
    again = visits.filter(F.col("i") == F.col("j")).select("j", F.col("v").alias("again"))
    share = F.coalesce(F.col("from_start") / F.col("again"), F.lit(0.0))
    effects = (again.filter(F.col("j") != START).join(reach, "j", "left")
               .join(worth.withColumnRenamed("i", "j"), "j", "left")
               .select(F.col("j").alias("channel_name"),
                       F.coalesce(ratio(share * F.col("c"), c0), F.lit(0.0))
                       .alias("removal_effects_conversion"),
                       F.coalesce(ratio(share * F.col("e"), e0), F.lit(0.0))
                       .alias("removal_effects_conversion_value"))
               .checkpoint(eager=True))
    total = chain.filter(ends).select(F.sum("weight")).scalar()
    total_value = chain.filter(ends).select(F.sum("value_in")).scalar()

    def credit(effect: str, total: Column) -> Column:
        whole = effects.select(F.sum(effect)).scalar()
        return F.coalesce(ratio(total * F.col(effect), whole), F.lit(0.0))
    return effects.select(
        "*", credit("removal_effects_conversion", total).alias("total_conversions"),
        credit("removal_effects_conversion_value", total_value).alias("total_conversion_value"))


def heuristic_models(paths: DataFrame, path: str = "medium_path",
                     conv: str = "conversions", value: str = "value") -> DataFrame:
    """CP15: first-, last- and linear-touch credit per channel, one explode and
    one aggregate.  Repeated touches are credited again in the linear model.
    Each model's totals equal the input totals."""
    a = touches(path)
    ex = paths.select(F.col(conv).cast("double").alias("_c"), F.col(value).alias("_v"),
                      F.size(a).alias("_n"), F.posexplode(a).alias("_pos", "channel_name"))
    first = F.col("_pos") == 0
    last = F.col("_pos") == F.col("_n") - 1
    zero = F.lit(0.0)
    return ex.groupBy("channel_name").agg(
        F.sum(F.when(first, F.col("_c")).otherwise(zero)).alias("first_touch_conversions"),
        F.sum(F.when(first, F.col("_v")).otherwise(zero)).alias("first_touch_value"),
        F.sum(F.when(last, F.col("_c")).otherwise(zero)).alias("last_touch_conversions"),
        F.sum(F.when(last, F.col("_v")).otherwise(zero)).alias("last_touch_value"),
        F.sum(F.col("_c") / F.col("_n")).alias("linear_touch_conversions"),
        F.sum(F.col("_v") / F.col("_n")).alias("linear_touch_value"),
    )
