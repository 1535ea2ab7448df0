import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import op12_prefix_trie as op
from tidemark.llm import queries

SCHEMA = ("conv_id long, turn long, role string, text string, depth long, key string, codes string, "
          "n_convs long, shard long")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256"]


def _plain(rows):
    """Every prefix of every rebuilt conversation in dictionaries."""
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, who in members.items():
        gain = (len(who) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += gain
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if rebuilt[c] == path)
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who),
                    children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _random(seed, n, copies):
    """Conversations over few turns, negative ids, gaps, ties, nulls, hot copies."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 900), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            role, text = rng.choice([None, "u", "a"]), rng.choice(["", "x", "é" * 3, None, "y"])
            rows.append((c, rng.choice([None, t, t]), role, text))
    for c in range(2000, 2000 + copies):  # one conversation, many times
        rows += [(c, t, "u", f"hot {t}") for t in range(7)]
    rows += rng.sample(rows, 20) + [(None, 0, "u", "nobody"), (3000, None, None, None)]
    rows += [(4000, t, "u", f"long {t}") for t in range(400)] + [(4001, 0, "a", "z" * 100_000)]
    return [(*r, 1, "clash", "clash", 5, 6) for r in rows]


def _run(spark, rows, **how):
    got = op.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), **how)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("shard_turns,fan", [(100_000, 16), (60, 2), (150, 3), (1, 4)])
def test_against_dictionaries(spark, shard_turns, fan):
    rows = _random(shard_turns, 120, 90)
    assert _run(spark, rows, shard_turns=shard_turns, fan=fan) == _plain(rows)


def test_copies_span_shards_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 7)
    rows = [(c, t, "u", f"t{t}", 0, "", "", 0, 0) for c in range(100, 400) for t in range(6)]
    assert _run(spark, rows, shard_turns=90, fan=2) == _plain(rows)


def test_empty_and_single(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(None, 1, "u", "x", 0, "", "", 0, 0)]) == []
    one = [(5, None, None, None, 0, "", "", 0, 0)]  # h = 3: no turn is left, a member of the root
    assert _run(spark, one) == _plain(one)
    assert len(_plain(one)) == 1


def test_tree_is_balanced():
    tree = op.TernaryTree()
    for i in op.medians(1023):
        tree.insert([i, 0], [1, 1])
    depth, level = {tree.equal[0]: 1}, [tree.equal[0]]
    while level:
        at = level.pop()
        for x in (tree.low[at], tree.high[at]):
            if x:
                depth[x] = depth[at] + 1
                level.append(x)
    assert len(depth) == 1023 and max(depth.values()) == 10
    assert sorted(op.medians(100)) == list(range(100))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_ternary_trie(spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == _plain(rows)
