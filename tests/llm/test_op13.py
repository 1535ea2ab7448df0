import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import op13_clusters as op
from tidemark.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance long, c int, n int, _q string"


def _plain(rows, k=16, rounds=3, dims=64, scale=64):
    kept = []
    for vec_id, x, *_ in rows:
        if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x):
            x = np.array(x, np.float32).astype(np.float64)
            kept.append((vec_id, [max(-op.MOST, min(op.MOST, math.floor(scale * v))) for v in x]))
    named = sorted(kept, key=lambda r: (hashlib.sha256(
        f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in named[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids))
                for _, q in kept]

    for _ in range(rounds):
        who = assign()
        for j in range(len(centroids)):
            mine = [q for (_, q), (_, w) in zip(kept, who) if w == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    who = assign()
    total = sum(d for d, _ in who)
    each = {j: sum(d for d, w in who if w == j) for j in range(len(centroids))}
    return sorted([(i, j, d, each[j], total, tuple(centroids[j]))
                   for (i, _), (d, j) in zip(kept, who)], key=str)


def _rows(seed, n, dims=64, spread=0.05):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [v + rng.gauss(0, spread) for v in c]))
    hot = rows[3][1]
    rows += [(n + i, hot) for i in range(n // 2)]           # one vector, a third of all rows
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, rows[2][1])]
    rows += [(7000, None), (7001, []), (7002, [0.0] * (dims - 1)), (7003, [0.0] * (dims - 1) + [None]),
             (7004, [float("nan")] + [0.0] * (dims - 1)), (7005, [float("inf")] + [0.0] * (dims - 1)),
             (7006, [0.0] * dims), (7007, [3e38] + [-3e38] * (dims - 1)), (7008, [-0.001] * dims)]
    return [(i, x, 1, 99, 98, 97, 96, "clash") for i, x in rows]


def _run(spark, rows, **how):
    got = op.cluster(spark.createDataFrame(rows, SCHEMA).repartition(4), **how)
    return sorted([(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"],
                    tuple(r["centroid"])) for r in got.collect()], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_distances(spark, seed):
    rows = _rows(seed, 150)
    assert _run(spark, rows) == _plain(rows)


def test_ties_and_few_vectors(spark):
    """Vectors on a small grid: many equal distances; then fewer than k."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 1.0]) / 64 for _ in range(4)], 0, 0, 0, 0, 0, "") for i in range(80)]
    assert _run(spark, rows, dims=4, k=6) == _plain(rows, k=6, dims=4)
    assert _run(spark, rows[:3], dims=4) == _plain(rows[:3], dims=4)
    assert _run(spark, rows, dims=4, k=5, n_pivots=1, rounds=0) == _plain(rows, k=5, dims=4, rounds=0)


def test_empty(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(1, None, 0, 0, 0, 0, 0, "")]) == []


def test_bounds_leave_centroids_out():
    """The pivots spare exact distances and never the nearest centroid."""
    rng = np.random.default_rng(3)
    centroids = rng.integers(-60, 60, (16, 64))
    points = (centroids[rng.integers(0, 16, 2000)] + rng.integers(-6, 7, (2000, 64))).astype(np.int64)
    pivots = op.far_apart(centroids, 8)
    who, d, exact = op.nearest(points, op.roots(points, pivots), centroids, op.roots(centroids, pivots))
    every = ((points[:, None] - centroids[None]) ** 2).sum(2)
    assert (every.argmin(1) == who).all() and (every.min(1) == d).all()
    assert exact.mean() < 4


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op13_laesa_clusters(spark, sf)
    plain = {r[0]: (*r[1:5], hashlib.sha256(",".join(map(str, r[5])).encode()).hexdigest()) for r in _plain(rows)}
    assert {r["vec_id"]: tuple(r)[1:] for r in got.collect()} == plain
    assert got.filter(F.col("distance") < 0).count() == 0
