"""op1's recall and how much it verifies, with production parameters, in 64 dimensions."""

import os
from pathlib import Path

import numpy as np
import pytest

from strataspark.llm import op1_projected_ann as op1
from strataspark.llm import vectors


def table(spark, x):
    return vectors.vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), "vec_id", "embedding", zero=False)


def recall(got, x):
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hit += (s[g.vec_id] >= np.sort(s)[-20] - 1e-9).sum()
        assert np.allclose(g.score, s[g.vec_id])
    return hit / (20 * got.query_id.nunique())


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 64))
    near = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 64)) * 0.25  # vectors with neighbours
    far = rng.normal(size=(6000, 64))  # none is much nearer than another
    return {name: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) for name, x in (("near", near), ("far", far))}


@pytest.mark.parametrize("name,most", [("near", 0.25), ("far", 0.7)])
def test_op1_verifies_a_part_and_finds_nine_in_ten(spark, clouds, name, most):
    x = clouds[name]
    t = table(spark, x)
    got = op1.search_ann(t, t.where("vec_id % 20 = 0")).toPandas()
    assert len(got) == 300 * 20 and recall(got, x.astype(float)) >= 0.9
    share = got.groupby("query_id").verified.first().mean() / len(x)
    assert share <= most


def test_op1_stops_only_where_the_test_holds():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 8))
    pv, q = v[:, :4], v[:3]
    quantile = op1.chi2_quantile(0.9, 4)
    most2 = (v * v).sum(1).max()
    scores, bound = op1.nearest_first(q, q[:, :4], np.arange(3), np.full(3, -np.inf), v, pv, np.arange(500), 5, most2, quantile)
    for i in range(3):
        seen = scores[i] > -np.inf
        assert np.allclose(scores[i][seen], v[seen] @ q[i]) and not seen[i]
        assert np.isclose(bound[i], np.sort(scores[i])[-5])
        apart = ((pv - q[i, :4]) ** 2).sum(1)
        rest = ~seen & (np.arange(500) != i)
        assert not rest.any() or apart[rest].min() > quantile * (most2 + q[i] @ q[i] - 2 * bound[i])


def test_op1_equal_vectors_go_by_id(spark):
    x = np.repeat(np.eye(64)[:2], 1500, axis=0).astype(np.float32)
    got = op1.search_ann(table(spark, x), table(spark, x).where("vec_id = 2900")).orderBy("rank").toPandas()
    assert got.vec_id.tolist() == list(range(1500, 1520)) and (got.score == 1.0).all()


def test_op2_prunes_nothing_that_reaches_theta():
    from strataspark.llm import op2_topk as op2

    rng = np.random.default_rng(8)
    v = np.floor(rng.normal(size=(800, 12)) * 90) * rng.uniform(0.2, 3, size=(800, 1)).round()
    q = np.concatenate([v[:30], np.zeros((1, 12))])
    norms = np.sqrt((v * v).sum(1))
    products = q @ v.T
    theta = np.concatenate([np.sort(products[:30])[:, -5], [0.0]])
    keep = op2.survivors(q, theta, v, norms, v / np.where(norms > 0, norms, 1)[:, None])
    assert keep[products >= theta[:, None]].all() and keep[:30].mean() < 0.5


def test_op1_in_small_pieces_finds_the_same(spark, clouds, monkeypatch):
    t = table(spark, np.repeat(clouds["far"][:900], 2, axis=0))
    run = lambda: sorted(map(tuple, op1.search_ann(t, t.where("vec_id % 20 = 0"), leaf=16, sample=900).collect()))
    whole = run()
    for name, n in (("AT_ONCE", 50), ("DEALT", 200), ("SUMMED", 7), ("QUERY_BLOCK", 9)):
        monkeypatch.setattr(op1, name, n)
    assert run() == whole and len(whole) == 90 * 20


def test_op1_deals_queries_out_in_pieces(spark, clouds):
    """Each query goes to most of 512 leaves: as one batch its copies would take 500 MB."""
    t = table(spark, clouds["far"][:5000])

    def workers():
        for p in os.listdir("/proc"):
            try:
                if p.isdigit() and b"pyspark" in Path(f"/proc/{p}/cmdline").read_bytes() and b"daemon" in Path(f"/proc/{p}/cmdline").read_bytes():
                    yield Path(f"/proc/{p}")
            except OSError:
                pass

    for p in workers():  # from now on the peak counts anew
        (p / "clear_refs").write_text("5")
    assert op1.search_ann(t, t.where("vec_id % 5 < 2").coalesce(1), leaf=8, sample=5000).count() == 2000 * 20
    peaks = [int(line.split()[1]) / 1024 for p in workers() for line in (p / "status").read_text().splitlines() if line.startswith("VmHWM")]
    assert peaks and max(peaks) < 450, peaks
