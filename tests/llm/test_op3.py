import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import op3_sharding as op


def _check(docs, shards=24, **options):
    rows = op.shard(docs, shards, **options).collect()
    want = sorted(str((r["doc_id"], len((r["text"] or "").encode()) + 8,
                       zlib.crc32((r["text"] or "").encode()))) for r in docs.collect())
    assert want == sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in rows)
    slots, sums, shard_of = {}, [0] * shards, {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        sums[r["shard"]] += r["size"]
        assert shard_of.setdefault(bytes(r["text_key"]), r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sums


def test_bytes_law(edge, small):
    _check(edge)
    sums = _check(small)
    assert max(sums) - min(sums) < 2000
    sums = _check(small, shards=3)
    assert max(sums) - min(sums) <= 3
    # bundles: small groups are gathered by a hash, large ones stay by themselves
    sums = _check(small, shards=3, fine=8, salts=4)
    assert max(sums) - min(sums) < 0.02 * sum(sums)


def test_empty(empty):
    assert op.shard(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**12), max_size=60), st.integers(1, 9))
def test_difference_is_a_partition(sizes, ways):
    got = op.difference(np.array(sizes, dtype=np.int64), ways)
    assert len(got) == len(sizes) and all(0 <= g < ways for g in got)


@pytest.mark.parametrize("seed", range(5))
def test_two_ways_against_all_partitions(seed):
    sizes = np.random.default_rng(seed).integers(1, 1000, 12)
    got = op.difference(sizes, 2)
    spread = abs(int(sizes[got == 0].sum() - sizes[got == 1].sum()))
    best = min(abs(int(np.dot(sizes, s))) for s in itertools.product((1, -1), repeat=len(sizes)))
    assert best <= spread <= 100


def test_differencing_by_hand():
    # 8-7=1, 6-5=1, 4; 4-1=3, 3-1=2: the known result of the method, spread 2
    sizes = np.array([8, 7, 6, 5, 4])
    got = op.difference(sizes, 2)
    assert abs(sizes[got == 0].sum() - sizes[got == 1].sum()) == 2
