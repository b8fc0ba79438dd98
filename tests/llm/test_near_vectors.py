"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from strataspark.llm import op12_near_vectors as op
from tests.conftest import DATA


def plain(rows, threshold=0.95):
    """[(vec_id, n_links, component_id, kept)] by all pairs."""
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    ids = np.array([i for i, _ in rows])
    label = ids.copy()
    while True:
        after = np.array([min([label[i], *label[link[i]]]) for i in range(len(ids))])
        if (after == label).all():
            return sorted((int(i), int(m.sum()), int(c), bool(i == c)) for i, m, c in zip(ids, link, label, strict=True))
        label = after


def groups(rng, n, dim, noise, members):
    """Groups of vectors around centres, and strangers."""
    rows = [rng.normal(size=dim) for _ in range(n)]
    for size, far in zip(members, noise, strict=True):
        centre = rng.normal(size=dim)
        rows += [centre + far * rng.normal(size=dim) for _ in range(size)]
    rows = [np.float32(v) * np.float32(rng.choice([0.5, 1, 3])) for v in rows]
    rows += [rows[3], rows[3], rows[-1], rows[-1] * np.float32(2)]
    order = rng.permutation(len(rows))
    return [(int(7 * i), [float(c) for c in rows[j]]) for i, j in enumerate(order)]


@pytest.mark.parametrize("dim", [16, 64, 100])
def test_against_all_pairs(spark, dim, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 20)
    monkeypatch.setattr(op, "BIN", 50)
    rng = np.random.default_rng(dim)
    rows = groups(rng, 200, dim, [0.01, 0.1, 0.2, 0.25, 0.3], [90, 60, 60, 50, 40])
    got = op.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_chains_over_borders(spark):
    """Vectors on an arc, a few degrees apart: each links with its neighbours, all are one component."""
    rng = np.random.default_rng(2)
    a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    angles = np.deg2rad(np.arange(0, 120, 4.0))
    rows = [(int(i), [float(v) for v in np.cos(t) * a + np.sin(t) * b]) for i, t in zip(rng.permutation(len(angles)), angles, strict=True)]
    got = op.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == plain(rows)
    assert {r.component_id for r in got} == {0}


def test_oracle(spark, same):
    same(op.query(spark, DATA), op.ORACLE)


def test_plan_grows_with_the_table():
    (k, tables), (more, many) = op.plan(10_000, 64, 0.95), op.plan(10**10, 64, 0.95)
    assert k < more <= op.MOST_CODES and tables < many < 200


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label int, n int, `key` int, digest int, _id int"
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 0.0]), (10, [1e200, 1e200]), (11, [1.0, 1.0]), (None, [1.0, 1.001]), (12, [-1.0, -1.0]), (13, [1.0, -1.0]), (13, [5.0, 5.0]), (13, None)]
    got = op.near_vectors(spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], schema)).collect()
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    least = -(2**63)
    assert len(got) == len(rows) and sum(r.vec_id == 13 for r in got) == 3
    for i in (1, 2, 3, 4, 5, 6, 9, 12, 13):
        assert by[i] == (0, i, True)
    for i in (7, 8, 10, 11):
        assert by[i] == (4, least, False)
    assert by[None] == (4, least, True)
    assert op.near_vectors(spark.createDataFrame([], schema)).collect() == []
