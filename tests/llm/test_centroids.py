"""Centroid clustering against a plain version in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from strataspark.llm import op11_centroids as op
from tests.conftest import DATA


def plain(rows, dim, k, rounds):
    """{place in rows: (cluster, distance)} and the centroids."""
    kept = [(i, d, [math.floor(1024 * float(x)) for x in v]) for i, (d, v) in enumerate(rows) if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[1] is None, hashlib.sha256(f"3:{r[1]}".encode()).hexdigest(), r[2]))[:k]
    c = [r[2] for r in first]
    d2 = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x: min(range(len(c)), key=lambda j: (d2(x, c[j]), j))
    for _ in range(rounds):
        to = [near(x) for *_, x in kept]
        for j in range(len(c)):
            if mine := [x for (*_, x), t in zip(kept, to, strict=True) if t == j]:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((d if d is not None else -1, t := near(x), d2(x, c[t])) for _, d, x in kept), c


def test_oracle(spark, same):
    same(op.query(spark, DATA), op.ORACLE)


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e5, 1e12])
def test_intervals_hold_the_exact_scores(scale):
    rng = np.random.default_rng(int(math.log10(scale)) + 9)
    x = np.floor(rng.normal(size=(200, 64)) * 1024 * scale)
    c = op.Centroids([[int(v) for v in row] for row in np.floor(rng.normal(size=(8, 64)) * 1024 * scale)])
    low, high = op.intervals(x, c)
    for i in range(len(x)):
        for j, row in enumerate(c.rows):
            s = sum(b * b - 2 * int(a) * b for a, b in zip(x[i], row, strict=True))
            assert low[i, j] <= s <= high[i, j]


def test_near_ties_are_decided_exactly():
    rng = np.random.default_rng(3)
    base = [int(v) for v in np.floor(rng.normal(size=64) * 2**20)]
    c = op.Centroids([[b + (j == i) for i, b in enumerate(base)] for j in range(8)] + [list(base)])
    x = np.array([[b + int(d) for b, d in zip(base, row, strict=True)] for row in rng.integers(-2, 3, (300, 64))], float)
    found, recomputed = op.nearest(x, c)
    want = [min(range(9), key=lambda j: (sum((int(a) - b) ** 2 for a, b in zip(row, c.rows[j], strict=True)), j)) for row in x]
    assert found.tolist() == want and recomputed > 300


def test_few_are_recomputed_where_centroids_differ():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(4000, 64)) * 1024)
    c = op.Centroids([[int(v) for v in row] for row in x[:8]])
    assert op.nearest(x, c)[1] < 100


def test_against_plain(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 4))
    rows = [(i, [float(v) for v in centres[i % 5] + rng.normal(size=4) / 8]) for i in range(300)]
    rows += [(7, [0.25] * 4), (7, [0.25] * 4), (None, [0.1, 0.2, 0.3, 0.4]), (900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan")] * 4), (905, [float("inf")] * 4), (906, [1e30, 0.0, 0.0, -1e30]), (907, [1e8, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 cluster", "2 v").repartition(7)
    want, c = plain(rows, 4, 8, 10)
    for parts in (df, df.coalesce(1)):
        got = op.cluster(parts, dim=4).collect()
        assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in got) == [(i, k, d if d < 2**63 else None) for i, k, d in want]
        assert {(r.cluster, r.centroid_sha256) for r in got} == {(k, hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for _, k, _ in want}
        own = {k: sum(d for _, t, d in want if t == k) for _, k, _ in want}
        assert all(r.cluster_inertia == (own[r.cluster] if own[r.cluster] < 2**63 else None) for r in got)


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert op.cluster(spark.createDataFrame([], schema)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert op.cluster(spark.createDataFrame([], schema)).count() == 0
    assert op.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0
    got = op.cluster(spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], schema)).collect()
    assert sorted((r.vec_id, r.distance, r.inertia) for r in got) == [(1, 0, 0), (2, 0, 0)]
