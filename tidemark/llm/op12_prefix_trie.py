"""Prefix trie of conversations: ternary search trees by range shard.

1. **Dictionary.**  Distinct turns (role and text, told apart by 128 bits of
   SHA-256) get a 64-bit code each.  Turns get their codes by ``join_spread``, so
   that a turn with a third of all rows fills no task.
2. **Sequences.**  A conversation becomes one row of codes and lengths.
3. **Range shards.**  Sequences are dealt into ranges of (codes, conv_id).  The id
   splits a sequence that many conversations share, in ascending ids.
4. **Trees.**  A task puts its distinct sequences into a ternary search tree,
   the median first and then the medians of both halves, so that siblings are
   balanced; a traversal with its own stack adds up members, leaves and savings.
5. **Boundary nodes.**  Only a prefix of a shard's first or last sequence can
   be in other shards too: at most two paths a shard.  They carry what the shard's
   other nodes add to them, and are merged by ``FAN`` neighbouring shards at a time; inside
   a merged group all but its own first and last path are finished.  The ids
   that end in such a node are chunks in shard order, hence ascending, and are
   hashed in one pass over them, a chunk at a time.

Bounds: a shard has about ``shard_turns`` turns; a merge sees at most
2 * ``FAN`` paths.  One conversation is one row of 12 bytes a turn, so a
conversation of ten million turns is a row of 120 MB (its text is never in it).
A hash over all ids of one node cannot be split, by its definition; it streams.
Written tables stand between the steps, so a lost executor costs its tasks only.

Cases: null turns come first; rows of one conversation with equal turns are
ordered by the digest of role and text, repeated rows are turns of their own; a
null role or text is empty; rows with a null conv_id belong to no conversation
and are left out; turns of any length count by their code points; an empty table has no
nodes; a conversation without turns is a member of the root.  Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import importable, join_spread, written

SHARD_TURNS = 100_000
#: shards or groups merged at a time
FAN = 16
#: ids in one chunk of a boundary node's ends
CHUNK = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE, PART, ENDS = 0, 1, 2
ROW = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("chars", pa.int64()), ("ends_sha256", pa.string()),
    ("on_first", pa.bool_()), ("on_last", pa.bool_()), ("chunk", pa.int32()), ("ends", pa.binary())])
ROW_DDL = ("kind int, shard long, key binary, parent_key binary, conv_id long, depth long, "
           "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
           "chars long, ends_sha256 string, on_first boolean, on_last boolean, chunk int, ends binary")


class TernaryTree:
    """Sequences of codes.  Node 0 is the root; ``equal`` leads to the tree of a
    node's children, ``low`` and ``high`` to siblings with other codes."""

    def __init__(self) -> None:
        self.code, self.chars, self.parent = [0], [0], [-1]
        self.low, self.equal, self.high = [0], [0], [0]

    def _new(self, code: int, chars: int, parent: int) -> int:
        self.code.append(code)
        self.chars.append(chars)
        self.parent.append(parent)
        self.low.append(0)
        self.equal.append(0)
        self.high.append(0)
        return len(self.code) - 1

    def insert(self, codes: list[int], chars: list[int]) -> int:
        """The node of the whole sequence."""
        node = 0
        for c, n in zip(codes, chars, strict=True):
            links, at = self.equal, node
            while links[at]:
                at = links[at]
                if c == self.code[at]:
                    break
                links = self.low if c < self.code[at] else self.high
            else:
                links[at] = self._new(c, n, node)
                at = links[at]
            node = at
        return node

    def order(self) -> Iterator[int]:
        """All nodes, each after its parent."""
        stack = [0]
        while stack:
            node = stack.pop()
            yield node
            siblings = [self.equal[node]]
            while siblings:
                at = siblings.pop()
                if at:
                    stack.append(at)
                    siblings += (self.low[at], self.high[at])


def medians(n: int) -> Iterator[int]:
    """0 to n - 1: the median, then the medians of both halves, and so on."""
    halves = [(0, n)]
    while halves:
        start, end = halves.pop()
        if start < end:
            mid = (start + end) // 2
            yield mid
            halves += ((start, mid), (mid + 1, end))


def path_key(parent_key: bytes, code: int) -> bytes:
    return hashlib.blake2b(parent_key + code.to_bytes(8, "big", signed=True), digest_size=16).digest()


def hashed(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def shard_rows(shard: int, sequences: list[tuple[list[int], list[int]]],
               members: list[list[int]]) -> Iterator[dict]:
    """The rows of one shard: its own nodes whole, its boundary nodes in part.

    ``sequences`` are distinct and ascending (codes, lengths), ``members`` the
    conversations of each, ascending."""
    tree = TernaryTree()
    ends: dict[int, list[int]] = {}
    for i in medians(len(sequences)):
        ends[tree.insert(*sequences[i])] = members[i]
    order = list(tree.order())
    n = len(order)
    first_path, last_path = (_path(tree, codes) for codes, _ in (sequences[0], sequences[-1]))
    on_first, on_last = set(first_path), set(last_path)
    keys = {0: b""}
    for path in (first_path, last_path):
        for node in path[1:]:
            keys[node] = path_key(keys[tree.parent[node]], tree.code[node])
    count, least = [0] * n, [0] * n
    children, leaves, saved, depth = [0] * n, [0] * n, [0] * n, [0] * n
    for node in order[1:]:
        depth[node] = depth[tree.parent[node]] + 1
    for node in reversed(order):
        own = ends.get(node)
        if own:
            count[node] += len(own)
            least[node] = min(least[node], own[0]) if count[node] > len(own) else own[0]
        up, shared = tree.parent[node], node in keys
        if not shared:
            leaves[node] = leaves[node] or 1
            saved[node] += (count[node] - 1) * tree.chars[node]
        if up >= 0:
            least[up] = min(least[up], least[node]) if count[up] else least[node]
            count[up] += count[node]
            if not shared:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    for node in order:
        up = tree.parent[node]
        row = {"shard": shard, "conv_id": least[node], "depth": depth[node], "n_convs": count[node],
               "n_children": children[node], "n_leaves": leaves[node], "saved_tokens": saved[node]}
        if up in keys:
            row["parent_key"] = keys[up]
        if node not in keys:
            own = ends.get(node)
            yield row | {"kind": NODE, "parent_conv_id": None if up in keys else least[up],
                         "ends_sha256": hashed(own) if own else NO_ENDS}
            continue
        yield row | {"kind": PART, "key": keys[node], "chars": tree.chars[node],
                     "on_first": node in on_first, "on_last": node in on_last}
        own = ends.get(node, [])
        for k in range(0, len(own), CHUNK):
            yield {"kind": ENDS, "shard": shard, "key": keys[node], "chunk": k // CHUNK,
                   "ends": ",".join(map(str, own[k:k + CHUNK])).encode()}


def _path(tree: TernaryTree, codes: list[int]) -> list[int]:
    """The nodes of a sequence that is in the tree, from the root."""
    path = [0]
    for c in codes:
        at = tree.equal[path[-1]]
        while tree.code[at] != c:
            at = tree.low[at] if c < tree.code[at] else tree.high[at]
        path.append(at)
    return path


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) == 4096:
            yield pa.RecordBatch.from_pylist(some, ROW)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, ROW)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's rows (conv_id, codes, chars), ascending, to those of ROW."""
    sequences: list[tuple[list[int], list[int]]] = []
    members: list[list[int]] = []
    for batch in batches:
        for conv, codes, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not sequences or sequences[-1][0] != codes:
                sequences.append((codes, chars))
                members.append([])
            members[-1].append(conv)
    if sequences:
        yield from _batches(shard_rows(TaskContext.get().partitionId(), sequences, members))


def merged(rows: list[dict], group: int, last_round: bool) -> Iterator[dict]:
    """Boundary nodes of neighbouring shards as those of one group: ``NODE``
    where the group finishes them, ``PART`` on its own first and last path."""
    first, last = min(r["shard"] for r in rows), max(r["shard"] for r in rows)
    nodes: dict[bytes, dict] = {}
    for r in rows:
        here = {"on_first": r["on_first"] and r["shard"] == first,
                "on_last": r["on_last"] and r["shard"] == last}
        node = nodes.get(r["key"])
        if node is None:
            nodes[r["key"]] = r | here
            continue
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            node[c] += r[c]
        node["conv_id"] = min(node["conv_id"], r["conv_id"])
        for c in here:
            node[c] |= here[c]
    for node in sorted(nodes.values(), key=lambda r: -r["depth"]):
        node["shard"] = group
        if not last_round and (node["on_first"] or node["on_last"]):
            yield node
            continue
        node["kind"] = NODE
        node["n_leaves"] = node["n_leaves"] or 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["chars"]
        if node["depth"]:
            up = nodes[node["parent_key"]]
            up["n_children"] += 1
            up["n_leaves"] += node["n_leaves"]
            up["saved_tokens"] += node["saved_tokens"]
        yield node


def _merge(last_round: bool) -> Callable[[pa.Table], pa.Table]:
    def merge(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        rows = table.drop_columns(["group"]).to_pylist()
        return pa.Table.from_pylist(list(merged(rows, group, last_round)), ROW)
    return merge


def merge_boundaries(parts: DataFrame, shards: int, fan: int = FAN) -> DataFrame:
    """The finished boundary nodes of all shards."""
    finished = []
    while True:
        groups = -(-shards // fan)
        last_round = groups <= 1

        done = written(parts.withColumn("group", F.expr(f"shard div {fan}")).groupBy("group")
                       .applyInArrow(_merge(last_round), ROW_DDL), "trie-merge")
        finished.append(done.filter(F.col("kind") == NODE))
        parts, shards = done.filter(F.col("kind") == PART), groups
        if last_round:
            out = finished[0]
            for more in finished[1:]:
                out = out.union(more)
            return out


def _ends_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) rows, those of a key together and in order, to its hash."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for k, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k == key:
                state.update(b"," + ends)
            else:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ends)
        yield _hash_batch(done)
    yield _hash_batch([] if key is None else [(key, state.hexdigest())])


def _hash_batch(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.string())],
        names=["key", "ends_sha256"])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key (128 bits of the turn's digest), chars; written."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return written(conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.substring(key, 1, 32)).alias("key"), F.length(text).alias("chars")), "turns")


def sequences(coded: DataFrame) -> DataFrame:
    """conv_id, codes, chars: a conversation's turns in order."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "key", "code", "chars")))
    return coded.groupBy("conv_id").agg(ordered.alias("t")).select(
        "conv_id", F.col("t.code").alias("codes"), F.col("t.chars").alias("chars"))


def encode(rows: DataFrame) -> DataFrame:
    """The turns with their codes: numbers of the distinct turns."""
    codes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(
        "key", F.monotonically_increasing_id().alias("code")), "turn-codes")
    return join_spread(rows, codes, "key")


def rebuilt(own: DataFrame, most: int = 6, block: int = 100) -> DataFrame:
    """conv_id, codes, chars: the first h turns of the block's first
    conversation, then the conversation's own turns after its first h."""
    first = own.filter(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("base"), F.slice("codes", 1, most).alias("base_codes"),
        F.slice("chars", 1, most).alias("base_chars"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")

    def joined(c: str) -> Column:
        head = F.slice(F.coalesce(F.col(f"base_{c}"), F.slice(c, 1, 0)), F.lit(1), h)
        return F.concat(head, F.slice(c, h + 1, F.size(c))).alias(c)

    return (own.withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
            .join(first, "base", "left").select("conv_id", joined("codes"), joined("chars")))


def trie(sequence: DataFrame, shard_turns: int = SHARD_TURNS, fan: int = FAN) -> DataFrame:
    """The nodes of (conv_id, codes, chars) rows, one row a conversation."""
    importable(sequence.sparkSession)
    sequence = written(sequence.select("conv_id", "codes", "chars"), "sequences")
    size = sequence.agg(F.coalesce(F.sum(F.size("codes") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_turns))
    dealt = sequence.repartitionByRange(shards, "codes", "conv_id")
    rows = written(dealt.sortWithinPartitions("codes", "conv_id").mapInArrow(_grow, ROW_DDL),
                   "trie-shards")
    parts = rows.filter(F.col("kind") == PART)
    shards = 1 + (parts.agg(F.max("shard")).first()[0] or 0)
    boundary = written(merge_boundaries(parts, shards, fan), "trie-boundary")
    names = boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named"))
    # a shard's own nodes under its boundary nodes: by shard, so the root's children spread
    known = join_spread(parts.select("shard", F.col("key").alias("parent_key")), names, "parent_key")
    own = rows.filter(F.col("kind") == NODE)
    columns = ["conv_id", "depth", F.coalesce("parent_conv_id", "named").alias("parent_conv_id"),
               "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = own.filter("parent_key is null").withColumn("named", F.lit(None).cast("long"))
    under = own.filter("parent_key is not null").join(known, ["shard", "parent_key"], "left")
    ends = (rows.filter(F.col("kind") == ENDS).repartition("key")
            .sortWithinPartitions("key", "shard", "chunk").select("key", "ends")
            .mapInArrow(_ends_hashes, "key binary, ends_sha256 string"))
    top = (join_spread(boundary.drop("ends_sha256").withColumn(
        "parent_key", F.coalesce("parent_key", F.lit(b"-"))), names, "parent_key")
        .join(ends, "key", "left"))
    return (inner.unionByName(under.select(*inner.columns)).select(*columns, "ends_sha256")
            .unionByName(top.select(*columns, F.coalesce("ends_sha256", F.lit(NO_ENDS))
                                    .alias("ends_sha256"))))


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, fan: int = FAN) -> DataFrame:
    """The trie's nodes of the rebuilt conversations, a row each: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(rebuilt(sequences(encode(turns(conversations)))), shard_turns, fan)
