"""The bootstrap's draws and intervals against theory, and hashes of very large keys."""

import numpy as np
from pyspark.sql import functions as F

from strataspark.functions.columns import key_hash
from strataspark.operators import metrics as M
from strataspark.operators import prep as P
from strataspark.operators.ordered import running_sum


def test_draws_are_poisson_and_independent():
    w = M.poisson_weights(np.arange(2000), 1000, 42)
    assert abs((w > 0).mean() - (1 - np.exp(-1))) < 0.002  # 63 % of different rows
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01
    rounds, rows = np.corrcoef(w[:, :40].T), np.corrcoef(w[:40])
    for c in (rounds, rows):
        assert np.abs(c[~np.eye(40, dtype=bool)]).max() < 0.15
    assert abs(w.sum(0).std() - np.sqrt(2000)) < 5


def test_bootstrap_equals_plain_python(spark):
    rng = np.random.default_rng(3)
    score, label = np.round(rng.normal(size=700), 1), rng.integers(0, 2, 700)  # many ties
    df = spark.createDataFrame([(i, int(y), float(s), float(-s)) for i, (y, s) in enumerate(zip(label, score, strict=True))], "idx long, label int, a double, b double")
    got = M.bootstrap_auc(df, ["a", "b"], "label", 30).orderBy("round").collect()
    w = M.poisson_weights(np.arange(700), 30, 42)
    for r in got:
        x = w[:, r["round"]]
        wins = (score[:, None] > score[None]) + 0.5 * (score[:, None] == score[None])
        p, n = x * label, x * (1 - label)
        want = (p[:, None] * n[None] * wins).sum() / (p.sum() * n.sum())
        assert abs(r.a - want) < 1e-9 and abs(r.b - (1 - want)) < 1e-9
    assert len(got) == 30


def test_interval_is_as_wide_as_the_error(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(0, 2, 2000)
    score = rng.normal(size=2000) + label * 0.8
    df = spark.createDataFrame([(i, int(y), float(s)) for i, (y, s) in enumerate(zip(label, score, strict=True))], "idx long, label int, a double")
    se = M.auc_gap_error(df, "a", None, "label", "idx").first()
    r = M.interval(M.bootstrap_auc(df, ["a"], "label", 1000), F.col("a")).first()
    assert abs((r.high - r.low) / (2 * 1.96 * se.se) - 1) < 0.12 and abs(r["mean"] - se.gap) < 0.15 * se.se


def test_rounds_with_one_class_are_left_out(spark):
    df = spark.createDataFrame([(0, 1, 0.5)] + [(k, 0, k / 10) for k in range(1, 6)], "idx long, label int, a double")
    n = M.bootstrap_auc(df, ["a"], "label", 200).count()
    assert 90 < n < 160  # the one positive row is drawn in 63 % of rounds


def test_hashes_of_large_keys(spark):
    m = 2**31 - 1
    keys = [0, 5, m, m + 5, 9_000_000_000_000, 2**62]
    df = spark.createDataFrame([(k, "x") for k in keys], "k long, c string")
    assert [r[0] for r in df.select(key_hash("k")).collect()] == [(k % m * 1103515245 + 12345) % m for k in keys]
    parts = P.stratified_split(df, "k", "c", 0.5).collect()
    assert sorted(r.part for r in parts) == ["test"] * 3 + ["train"] * 3  # keys with equal hashes go by key
    assert sorted(r.place for r in P.seeded_places(df, "k", "place").collect()) == [1, 2, 3, 4, 5, 6]


def test_running_sums_over_many_ranges(spark):
    df = spark.range(5000).withColumn("one", F.lit(1)).withColumn("h", F.xxhash64("id") % 1000)
    got = running_sum(df, "h", {"one": "rank"}, ranges=300, tie="id").toPandas().sort_values(["h", "id"])
    assert got["rank"].tolist() == list(range(1, 5001))
