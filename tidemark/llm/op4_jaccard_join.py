"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set are its distinct shingles of five words.  Two sets of n and m
shingles have Jaccard similarity 0.8 or more only if they share T =
ceil(0.8 (n + m) / 1.8) shingles: the second document must occur in T of the first one's
inverted lists.  DivideSkip sets the T - 1 longest lists aside: whoever occurs T
times occurs in a short list too.  The short lists are merged and counted, the long ones
are probed by binary search for those that the merge has found.

1. Documents with the same words form a class; one set speaks for all.
2. All sets put their shingles in one order in which frequent shingles come
   last (a bounded list of the most frequent ones, found by counting), so that
   the first n - ceil(0.8 n) + 1 lists are the short ones.  Only these are built.  With c
   common short lists the overlap is at most c + max(ceil(0.8 n), ceil(0.8 m)) - 1;
   classes that can't reach the required overlap with that are left.
3. Step A: every class tries its best partners among the leaders of its lists,
   a few times; the whole sets are compared.
4. Step B: what can still link across the components of step A.  Classes are
   dealt into blocks by their hash; a task gets two blocks and searches them twice
   (``Index.occurrences``): first in the short lists, for the classes that have
   a candidate at all, then in the whole sets of these.  Only links leave a task, and of
   them only those that join two components.

A link inside a component cannot change the components, so these come out
whole.  Lists with equal members are merged once, with their number.

Skew: exact copies are one class.  A list that the count found longer than
``SPLIT`` is split by a hash of the class; in step A a list with over ``LONG``
classes meets its leaders in parts; in step B a list is spread over all blocks.  A task
holds two blocks: at most about ``BLOCK_ROWS`` rows of short lists or ``BLOCK_SHINGLES``
shingles each.  A class goes to the tasks in which it has a partner, so a group of
near copies that stay apart is sent to each pair of its blocks: its cost grows with the
square of its size (in counted entries, not in rows), as nothing short of comparing
can tell that they are apart.

Cases: null and empty texts have no words: they link with nothing and are their
own component.  With fewer than five words the whole sequence is the one
shingle.  Repeated rows are one class.  A null doc_id is never the smallest of a
component with another one.  Texts of any length are hashed in pieces of ``PIECE``
bytes; a set is one array.  Ties: leaders and partners of equal rank go by their
hash.  Other columns are not read, whatever their names.  Words, shingles and classes
are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, written
from tidemark.llm.components import components

SHINGLE = 5
FREQUENT = 16           # a frequent shingle is in so many short lists at least
FREQUENT_ROWS = 200_000  # bound of the list of frequent shingles
SPLIT = 20_000
BROADCAST_ROWS = 200_000
TURNS = 2               # step A: so often, each class tries so many partners
TRIES = 2
KEEP_CLASSES = 300_000
LONG, PARTS = 256, 16   # a list with more classes is joined in so many parts
LEAST_BLOCKS = 8        # step B: blocks of classes, more if they would have
BLOCK_ROWS = 1_000_000  # more rows of short lists or
BLOCK_SHINGLES = 4_000_000  # more shingles than these
PIECE = 1 << 18         # bytes of text that are hashed at a time

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[65:91] += np.uint64(32)


def _odd(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big") | 1


_BASE, _STEP = _odd("byte"), _odd("position")
_FACTORS = [np.uint64(_odd(f"word {i}")) for i in range(SHINGLE)]
_LENGTH = np.uint64(_odd("length"))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(31)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64, kept up to ``PIECE`` of them."""
    size = max(n, PIECE + 1) if n <= PIECE + 1 else n
    found = _POWERS.get((base, size))
    if found is None:
        found = np.full(size, base, np.uint64)
        found[0] = 1
        np.cumprod(found, out=found)
        if size == PIECE + 1:
            _POWERS[base, size] = found
    return found[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = h ^ (h >> _SHIFT)
        h = h * _MIX
    return h ^ (h >> _SHIFT)


def _piece_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and beginnings of the lower-cased (A-Z) words between ASCII white
    space: differences of running sums of byte * base**place, moved to place 0."""
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    running = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_FOLD[b] * _powers(_BASE, len(b)), out=running[1:])
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(b) + 1)
    h = (running[end] - running[start]) * inverse[start]
    return _mixed(h + (end - start).astype(np.uint64) * _LENGTH), start


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one
    more entry at the end).  A piece ends between two texts, or between two words of a
    text longer than ``PIECE``; a longer word is one piece."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(data) + 1, np.int64)
    at = 0
    while at < len(data):
        size, stop = len(data[at]), at + 1
        if size > PIECE:
            for piece in _cut(data[at]):
                hashes.append(_piece_words(piece)[0])
                counts[at + 1] += len(hashes[-1])
        else:
            while stop < len(data) and size + 1 + len(data[stop]) <= PIECE:
                size += 1 + len(data[stop])
                stop += 1
            found, start = _piece_words(b"\n".join(data[at:stop]))
            hashes.append(found)
            begins = np.cumsum([0] + [len(d) + 1 for d in data[at:stop]])
            counts[at + 1:stop + 1] = np.diff(np.searchsorted(start, begins))
        at = stop
    return np.concatenate(hashes), np.cumsum(counts)


def _cut(data: bytes) -> Iterator[bytes]:
    """Pieces of about ``PIECE`` bytes that end at white space."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def shingled(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(class, sorted distinct shingle hashes) of each text."""
    h, begins = word_hashes(texts)
    last = max(len(h) - SHINGLE + 1, 0)
    grams = np.zeros(last, np.uint64)
    for i, f in enumerate(_FACTORS):
        grams += h[i:last + i] * f
    grams = _mixed(grams).view(np.int64)
    for start, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
        n = end - start
        name = (h[start:end] * _powers(_STEP, n)).sum(keepdims=True, dtype=np.uint64)
        cls = int(_mixed(name + np.array([n], np.uint64) * _LENGTH).view(np.int64)[0])
        if n >= SHINGLE:
            mine = np.sort(grams[start:end - SHINGLE + 1])
            yield cls, mine[np.concatenate([[True], mine[1:] != mine[:-1]])]
        elif n:
            one = (h[start:end] * np.array(_FACTORS[:n])).sum(keepdims=True, dtype=np.uint64)
            yield cls, _mixed(one + np.uint64(n)).view(np.int64)
        else:
            yield cls, np.zeros(0, np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def short(n: int) -> int:
    """Number of short lists of a set of n shingles: n - T + 1."""
    return n + (-80 * n // 100) + 1


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, cls, n for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in _slices(batches):
            ids, sizes = [], []
            for cls, mine in shingled(batch["text"].to_pylist()):
                ids.append(cls)
                sizes.append(len(mine))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(ids, pa.int64()),
                 pa.array(sizes, pa.int64())], names=["doc_id", "text_key", "cls", "n"])
        give_back()

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        scan, f"doc_id {kind}, text_key long, cls long, n long")


def postings(docs: DataFrame, frequent: np.ndarray, lengths: np.ndarray) -> DataFrame:
    """The short lists: shingle, salt, cls, n.  ``frequent``: sorted shingles
    that come last in the order; ``lengths``: their lists' lengths.  ``salt`` is
    the part of a list that is split, else -1."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        seen: set[int] = set()
        for batch in _slices(batches):
            keys, owners, sizes, salts = [], [], [], []
            for cls, mine in shingled(batch.column(0).to_pylist()):
                n = len(mine)
                if not n or cls in seen:
                    continue
                if len(seen) >= KEEP_CLASSES:
                    seen.clear()
                seen.add(cls)
                salt = np.full(n, -1, dtype=np.int32)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, mine), len(frequent) - 1)
                    often = frequent[at] == mine
                    parts = 1 + lengths[at[often]] // SPLIT
                    salt[often] = np.where(parts > 1, abs(cls) % parts, -1)
                    order = np.argsort(often, kind="stable")[:short(n)]
                else:
                    order = np.arange(short(n))
                keys.append(mine[order])
                salts.append(salt[order])
                owners.append(cls)
                sizes.append(n)
            if not keys:
                continue
            each = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.concatenate(salts)),
                 pa.array(np.repeat(np.array(owners, np.int64), each)),
                 pa.array(np.repeat(np.array(sizes, np.int64), each))],
                names=["shingle", "salt", "cls", "n"])
        give_back()

    return docs.select("text").mapInArrow(scan, "shingle long, salt int, cls long, n long")


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles among the short lists in plain hash order, at most
    ``FREQUENT_ROWS`` of them, and their counts.  They only set the order of the
    lists: any order gives the same links."""
    nothing = np.zeros(0, np.int64)
    counts = written(postings(docs, nothing, nothing).groupBy("shingle")
                     .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT), "frequent")
    room, least = FREQUENT_ROWS, None
    # the numbers of shingles by powers of two of their count: a few rows
    steps = counts.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count(F.lit(1)).alias("rows"))
    for r in sorted(steps.collect(), key=lambda r: -r["step"]):
        room -= r["rows"]
        if room < 0:
            break
        least = 1 << r["step"]
    if least is None:
        return nothing, nothing
    rows = counts.filter(F.col("n") >= least).toPandas().sort_values("shingle")
    return rows["shingle"].to_numpy(), rows["n"].to_numpy()


def _lists(docs: DataFrame) -> DataFrame:
    """Short lists of two classes or more: list, times (lists with the same
    members), k (members), lo and hi (their sizes), cls, n."""
    frequent, lengths = _frequent(docs)
    part = Window.partitionBy("shingle", "salt")
    once = Window.partitionBy("shingle", "salt", "cls").orderBy("n")
    shared = written(
        postings(docs, frequent, lengths).repartition("shingle", "salt")
        .withColumn("copy", F.row_number().over(once)).filter("copy = 1")
        .withColumns({"k": F.count(F.lit(1)).over(part), "x": F.bit_xor("cls").over(part),
                      "y": F.bit_xor(F.xxhash64("cls")).over(part),
                      "lo": F.min("n").over(part), "hi": F.max("n").over(part)})
        .filter("k > 1 or salt >= 0").drop("copy"), "postings")
    # of the lists with the same members one stays; x and y tell members
    members = Window.partitionBy("k", "x", "y")
    columns = ("list", "times", "k", "lo", "hi", "cls", "n")
    whole = (shared.filter("salt < 0")
             .withColumns({"list": F.min("shingle").over(members),
                           "times": (F.count(F.lit(1)).over(members) / F.col("k")).cast("long")})
             .filter("shingle = list").select(*columns))
    # lists that were split come together as rows, not in a task
    split = shared.filter("salt >= 0").select(F.col("shingle").alias("list"), "cls", "n").distinct()
    facts = split.groupBy("list").agg(F.lit(1).cast("long").alias("times"), F.count(F.lit(1)).alias("k"),
                                      F.min("n").alias("lo"), F.max("n").alias("hi")).filter("k > 1")
    return whole.unionByName(split.join(facts, "list").select(*columns))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, grams of the classes in ``wanted`` (cls, doc_id): the documents in
    ``doc_id`` speak for their classes."""
    ids = wanted.select(F.col("doc_id").alias("_id"))
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = list(shingled(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in found], pa.int64()),
                 pa.array([g for _, g in found], pa.list_(pa.int64()))], names=["cls", "grams"])
        give_back()

    return written(
        docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        .select("text").mapInArrow(scan, "cls long, grams array<long>")
        .join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")


def _needed(n: Column, m: Column) -> Column:
    """Short lists that sets of n and m shingles must share, at least."""
    both = F.ceil((n + m) * 80 / 180)
    return both - F.greatest(F.ceil(n * 80 / 100), F.ceil(m * 80 / 100)) + 1


def _viable(lists: DataFrame) -> DataFrame:
    """The rows of ``lists`` whose class shares enough lists to link with some
    member of the list, with ``most`` (its lists) and ``least`` (those that it
    must share).  The need is largest for a partner of its own size, so the
    smallest and the largest partner in the list decide; 1 is for rounding."""
    n = F.col("n")
    lo = F.greatest("lo", F.ceil(n * 80 / 100))
    hi = F.least("hi", F.floor(n * 100 / 80))
    return (lists.withColumn("most", F.sum("times").over(Window.partitionBy("cls")))
            .withColumn("least", F.least(_needed(n, lo), _needed(n, hi)) - 1)
            .filter("most >= least").select("list", "times", "k", "cls", "n", "most", "least"))


def _can_link(a: str, b: str) -> Column:
    """By size and by the number of lists: ``n`` and ``most`` with these ends."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    return ((100 * n >= 80 * m) & (100 * m >= 80 * n)
            & (F.least(f"most{a}", f"most{b}") >= _needed(n, m)))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The links (a, b) among ``pairs`` (a, b): whole sets are compared."""
    wanted = written(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
                     .join(reps, "cls"), "wanted")
    sets = _sets(docs, wanted)
    mine = sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga"))
    other = sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    either = F.size("ga") + F.size("gb") - both
    return written(pairs.join(mine, "a").join(other, "b")
                   .filter(100 * both >= 80 * either).select("a", "b"), "verified")


def _rooted(lists: DataFrame, links: DataFrame | None) -> DataFrame:
    """``lists`` with the component of each class so far."""
    if links is None:
        return lists.withColumn("root", F.col("cls"))
    root = components(links).select(F.col("node").alias("cls"), "root")
    return lists.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _leaders(rooted: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each class and its ``TRIES`` best partners: those among
    the leaders of its lists, one of each size band and another each turn, with
    which it shares most lists.  The first leader is the class with the least of its own
    (short lists that no other class is in) for its size: what links with a class of
    the group at all most likely links with it."""
    banded = rooted.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))))
    # a long list meets its leaders in parts
    parts = F.when(F.col("k") > LONG, PARTS).otherwise(1).cast("long")
    banded = banded.withColumn("part", F.pmod(F.xxhash64("cls"), parts))
    own = F.col("n") - F.ceil(F.col("n") * 80 / 100) + 1 - F.col("most")
    first = F.floor(100 * own / F.col("n")) if turn == 0 else F.lit(0)
    leader = F.min(F.struct(first, F.xxhash64("cls", F.lit(turn)), "cls", "n", "most", "root")).alias("o")
    leaders = banded.groupBy("list", "band").agg(leader, F.max(parts).alias("parts")).select(
        "list", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.col("o.cls").alias("leader"), F.col("o.n").alias("n2"),
        F.col("o.most").alias("most2"), F.col("o.root").alias("root2"))
    best = Window.partitionBy("cls").orderBy(F.desc("score"), "leader")
    return (banded.withColumnsRenamed({"n": "n1", "most": "most1"}).join(leaders, ["list", "band", "part"])
            .filter((F.col("root") != F.col("root2")) & _can_link("1", "2"))
            .groupBy("cls", "leader").agg(
                F.sum("times").alias("score"),
                F.first(_needed(F.col("n1"), F.col("n2"))).alias("needed"))
            .filter("2 * score >= needed")      # the rest is for step B
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TRIES)
            .select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b"))
            .distinct())


# --- step B: blocks of classes --------------------------------------------------------

class Index:
    """Inverted lists of some classes, which are numbered by size: ``keys`` has
    list * size + class for every entry, ascending, so that a list is a sorted
    run and a class is probed in it by binary search."""

    def __init__(self, n: np.ndarray, root: np.ndarray, values: np.ndarray, at: np.ndarray,
                 times: np.ndarray | None = None, most: np.ndarray | None = None) -> None:
        order = np.argsort(n, kind="stable")
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        self.order, self.n, self.root = order, n[order], root[order]
        self.most = None if most is None else most[order]
        owner = place[np.repeat(np.arange(len(n)), np.diff(at))]
        sort = np.lexsort((owner, values))
        values, self.member = values[sort], owner[sort]
        fresh = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else at[:0]
        self.value = values[fresh]
        self.begin = np.append(fresh, len(values))
        self.times = np.ones(len(fresh), np.int64) if times is None else times[sort][fresh]
        lists = np.repeat(np.arange(len(fresh)), np.diff(self.begin))
        self.keys = lists * max(len(n), 1) + self.member

    def lists(self, values: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.value, values), max(len(self.value) - 1, 0))
        return at[self.value[at] == values] if len(self.value) else at[:0]

    def _entries(self, lists: np.ndarray) -> np.ndarray:
        size = self.begin[lists + 1] - self.begin[lists]
        skip = np.repeat(self.begin[lists] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return skip + np.arange(int(size.sum()))

    def occurrences(self, lists: np.ndarray, least: int, low: int, high: int,
                    unlike: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes from ``low`` to ``high`` of another root than ``unlike`` that
        can occur ``least`` times in ``lists``, and how often they do.

        The longest lists, ``least - 1`` occurrences together, are set aside: who
        occurs often enough is in a short one.  The short lists, sorted runs, are
        merged by a stable sort, which merges runs; equal neighbours are counted.  The
        long lists are probed by binary search for these candidates, or merged
        too, whichever touches less."""
        size = self.begin[lists + 1] - self.begin[lists]
        lists = lists[np.argsort(size, kind="stable")]
        times = self.times[lists]
        after = times[::-1].cumsum()[::-1]
        cut = int(np.searchsorted(-after, -(least - 1)))
        near = self._entries(lists[:cut])
        found = self.member[near]
        weight = np.repeat(times[:cut], self.begin[lists[:cut] + 1] - self.begin[lists[:cut]])
        keep = (found >= low) & (found < high)
        found, weight = found[keep], weight[keep]
        keep = self.root[found] != unlike
        found, weight = found[keep], weight[keep]
        if not len(found):
            return found, weight
        sort = np.argsort(found, kind="stable")
        found, weight = found[sort], weight[sort]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        found, count = found[first], np.add.reduceat(weight, first)
        # with all long lists a candidate gets so many at most
        keep = count + int(times[cut:].sum()) >= least
        found, count = found[keep], count[keep]
        long = lists[cut:]
        touched = int((self.begin[long + 1] - self.begin[long]).sum())
        if len(found) * len(long) * 8 <= touched:
            wanted = long[:, None] * len(self.n) + found[None, :]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            count = count + ((self.keys[at] == wanted) * times[cut:, None]).sum(0)
        else:
            entries = self._entries(long)
            more = np.bincount(self.member[entries], np.repeat(
                times[cut:], self.begin[long + 1] - self.begin[long]), len(self.n))
            count = count + more[found].astype(np.int64)
        return found, count


def _rows_of(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and where each row's begin."""
    lists = table.column(column).combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), at


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """Queries and members of a task: the classes of its two blocks, or twice
    those of the one."""
    own = table.column("own").to_numpy()
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    if x == y:
        return table, table, True
    return table.filter(pa.array(own == x)), table.filter(pa.array(own == y)), False


def _window(index: Index, n: int, after: int) -> tuple[int, int]:
    """The members whose size allows a link with n shingles, beyond ``after``."""
    low = int(np.searchsorted(index.n, -(-80 * n // 100)))
    return max(low, after), int(np.searchsorted(index.n, 100 * n // 80, side="right"))


def _both(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """The overlap that sets of n and m shingles need."""
    return -(-80 * (n + m) // 180)


def _candidates(table: pa.Table) -> pa.Table:
    """Classes of a task that share enough short lists with another one."""
    give_back()
    queries, members, same = _sides(table)
    n, root, most, cls = (members.column(c).to_numpy() for c in ("n", "root", "most", "cls"))
    values, at = _rows_of(members, "lists")
    index = Index(n, root, values, at, _rows_of(members, "times")[0], most)
    named = np.empty(len(n), np.int64)
    named[index.order] = np.arange(len(n))
    qn, qroot, qmost, qcls = (queries.column(c).to_numpy() for c in ("n", "root", "most", "cls"))
    values, at = _rows_of(queries, "lists")
    chosen, mine = np.zeros(len(n), bool), np.zeros(len(qn), bool)
    for i in range(len(qn)):
        low, high = _window(index, qn[i], named[i] + 1 if same else 0)
        if low >= high:
            continue
        m = index.n[low:high]
        need = _both(qn[i], m) - np.maximum(-(-80 * qn[i] // 100), -(-80 * m // 100)) + 1
        least = max(int(need.min()) - 1, 1)   # 1 for rounding
        lists = index.lists(values[at[i]:at[i + 1]])
        if index.times[lists].sum() < least:
            continue
        found, count = index.occurrences(lists, least, low, high, qroot[i])
        ok = np.minimum(np.minimum(count, index.most[found]), qmost[i]) >= need[found - low] - 1
        if ok.any():
            chosen[found[ok]] = mine[i] = True
    if same:
        mine[index.order[chosen]] = True
        ids = qcls[mine]
    else:
        ids = np.concatenate([qcls[mine], cls[index.order[chosen]]])
    return pa.table({"x": np.full(len(ids), table.column("x")[0].as_py(), np.int32),
                     "y": np.full(len(ids), table.column("y")[0].as_py(), np.int32), "cls": ids})


class _Roots(dict):
    """Union-find over the components that a task sees."""

    def __missing__(self, root: int) -> int:
        return root

    def find(self, root: int) -> int:
        while self[root] != root:
            self[root] = root = self[self[root]]
        return root

    def joins(self, one: int, other: int) -> bool:
        one, other = self.find(one), self.find(other)
        if one != other:
            self[max(one, other)] = min(one, other)
        return one != other


def _linked(table: pa.Table) -> pa.Table:
    """Links between the classes of a task, by their whole sets: those that join
    two components, as the others cannot change them."""
    give_back()
    queries, members, same = _sides(table)
    n, root, cls = (members.column(c).to_numpy() for c in ("n", "root", "cls"))
    index = Index(n, root, *_rows_of(members, "grams"))
    named = np.empty(len(n), np.int64)
    named[index.order] = np.arange(len(n))
    qn, qroot, qcls = (queries.column(c).to_numpy() for c in ("n", "root", "cls"))
    values, at = _rows_of(queries, "grams")
    roots = _Roots()
    ends: list[int] = []
    others: list[int] = []
    for i in range(len(qn)):
        low, high = _window(index, qn[i], named[i] + 1 if same else 0)
        if low >= high:
            continue
        least = int(_both(qn[i], index.n[low]))
        lists = index.lists(values[at[i]:at[i + 1]])
        if len(lists) < least:
            continue
        found, count = index.occurrences(lists, least, low, high, qroot[i])
        found = found[100 * count >= 80 * (qn[i] + index.n[found] - count)]
        for j, r in zip(found.tolist(), index.root[found].tolist()):
            if roots.joins(int(qroot[i]), r):
                ends.append(int(qcls[i]))
                others.append(int(cls[index.order[j]]))
    a, b = np.array(ends, np.int64), np.array(others, np.int64)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _tasks(mixed: DataFrame, blocks: int) -> DataFrame:
    """(x, y, own, cls, n, most, root): each class in the tasks, pairs of blocks, in
    which some list of its brings it together with another class."""
    own = F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int")
    dealt = mixed.withColumn("own", own)
    there = (dealt.groupBy("list", "own").agg(F.count(F.lit(1)).alias("here"))
             .groupBy("list").agg(F.collect_list(F.struct(F.col("own").alias("block"), "here")).alias("there")))
    return (dealt.join(there, "list")
            .select("cls", "n", "most", "root", "own", F.explode("there").alias("t"))
            .filter("t.block <> own or t.here > 1")
            .select(F.least("own", "t.block").alias("x"), F.greatest("own", "t.block").alias("y"),
                    "own", "cls", "n", "most", "root").distinct())


def _across(rooted: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The links across components that the short lists allow.

    Classes are dealt into blocks by their hash, and a task gets two blocks, so
    a list of any length is spread over them and no pair of classes leaves a task but
    for a link.  A first search in the short lists finds the classes that can link,
    the second one compares the whole sets of these."""
    several = rooted.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter(
        "lo <> hi").select("list")
    mixed = written(rooted.join(several, "list"), "mixed")
    blocks = max(LEAST_BLOCKS, -(-mixed.count() // BLOCK_ROWS))
    sets = mixed.groupBy("cls").agg(F.collect_list("list").alias("lists"), F.collect_list("times").alias("times"))
    chosen = written(
        _tasks(mixed, blocks).join(sets, "cls").groupBy("x", "y").applyInArrow(
            _candidates, "x int, y int, cls long"), "chosen")
    facts = mixed.groupBy("cls").agg(F.first("n").alias("n"), F.first("root").alias("root"))
    wanted = written(chosen.select("cls").distinct().join(facts, "cls").join(reps, "cls"), "wanted")
    # whole sets are larger than lists: more blocks, of which each is in one of the first
    total = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finer = max(1, -(-total // (BLOCK_SHINGLES * blocks)))
    fine = F.pmod(F.xxhash64("cls"), F.lit(blocks * finer)).cast("int")
    whole = _sets(docs, wanted.select("cls", "doc_id")).join(wanted.select("cls", "n", "root"), "cls").withColumn(
        "own", fine)
    sides = chosen.withColumn("other", F.when(F.col("x") == F.pmod(F.xxhash64("cls"), F.lit(blocks)), F.col("y"))
                              .otherwise(F.col("x")))
    # a block's finer blocks have its number modulo ``blocks``
    routes = sides.select("cls", F.explode(F.sequence(
        F.col("other"), F.lit(blocks * finer - 1), F.lit(blocks))).alias("other"))
    dealt = routes.join(whole, "cls").select(
        F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        "own", "cls", "n", "root", "grams")
    return written(dealt.groupBy("x", "y").applyInArrow(_linked, "a long, b long").distinct(), "across")


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between classes that connect what similarity connects.
    ``reps``: cls and the doc_id that speaks for it."""
    lists = written(_viable(_lists(docs)), "viable")
    found, tried = None, None
    for turn in range(TURNS):
        pairs = _leaders(_rooted(lists, found), turn)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        new = _verified(pairs, docs, reps)
        found = new if found is None else found.union(new)
    return found.union(_across(written(_rooted(lists, found), "rooted"), docs, reps))


def _joined(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, root for each row of ``docs``.
    ``root`` is the component itself, a class; unlike its smallest doc_id no
    other component has it.  It is null for rows without words."""
    docs = docs.select("doc_id", "text")
    rows = written(classes(docs), "classes")
    reps = written(rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "reps")
    root = components(links(docs, reps)).select(F.col("node").alias("cls"), "root")
    rooted = written(reps.join(root, "cls", "left")
                     .select("cls", "doc_id", F.coalesce("root", "cls").alias("root")), "roots")
    least = written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    of = written(rooted.join(least, "root").select("cls", "component_id", "root"), "of")
    return (rows.filter("n > 0").join(of, "cls")
            .select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", "root")
            .unionByName(rows.filter("n = 0").select(
                "doc_id", "text_key", F.col("n").alias("n_shingles"),
                F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id for each row of ``docs``."""
    return _joined(docs).drop("root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component stays: the
    one with the smallest doc_id, of several texts under it the one with the
    smallest hash.  Rows without words all stay.  Components are told apart by their
root: several can have a null or the same component_id."""
    joined = written(_joined(docs), "joined")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    stay = (joined.filter("n_shingles > 0").groupBy("root").agg(F.min(order).alias("o"))
            .select(F.col("o.doc_id").alias("_tidemark_id"), F.col("o.text_key").alias("_tidemark_key")))
    wordless = joined.filter("n_shingles = 0").select(
        F.col("doc_id").alias("_tidemark_id"), F.col("text_key").alias("_tidemark_key")).distinct()
    names = docs.columns
    keyed = docs.withColumn("_tidemark_key_of", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_tidemark_id")) & (F.col("_tidemark_key_of") == F.col("_tidemark_key"))
    return (keyed.join(stay, same, "left_semi").dropDuplicates(["doc_id", "_tidemark_key_of"]).select(*names)
            .unionByName(keyed.join(wordless, same, "left_semi").select(*names)))
