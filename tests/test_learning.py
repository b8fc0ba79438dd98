"""Learners: how often a search fits, in how many tasks, and what a machine's features are."""

import numpy as np
from pyspark.sql import functions as F

from strataspark import checkpoints
from strataspark.operators import models as L

FEATURES = ["f1", "f2"]


def rows(spark, n=600):
    k = F.col("id")
    x = spark.range(0, n, 1, 1).select("id", (k * 7919 % 101 / 101.0).alias("f1"), (k * 31 % 97 / 97.0).alias("f2"), (k % 3).alias("fold"), (F.expr("id div 3") % 2).alias("inner"))
    return x.withColumn("label", (F.col("f1") + F.col("f2") * 0.5 + (k % 7) / 20.0 > 0.9).cast("int"))


def test_a_nested_search_fits_each_candidate_once_for_each_inner_fold(spark):
    fits = []

    def fit(train, depth):
        fits.append(depth)
        return L.fit_forest(train, FEATURES, "label", trees=2, depth=depth)

    x = rows(spark)
    out = L.nested_fit(x, 3, 2, "id", [{"depth": 1}, {"depth": 3}], fit, "label")
    assert len(fits) == 3 * 2 * 2 + 3
    got = out.collect()
    assert sorted(r.id for r in got) == list(range(600)) and all(r.outer_fold == r.id % 3 for r in got)
    assert all(r.prediction == int(r.score >= r.threshold) for r in got)
    assert len({r.threshold for r in got}) == len({(r.outer_fold, r.threshold) for r in got}) <= 3
    assert spark.conf.get(checkpoints.CLEAN, "false") == "false"


def test_rows_of_one_split_go_to_tasks_by_key_alone(spark, monkeypatch):
    monkeypatch.setattr(L, "TASK_ROWS", 100)
    parts = lambda x: sorted(map(tuple, L.spread(x, "id").select("id").rdd.map(lambda r: r.id).glom().collect()))
    assert parts(rows(spark)) == parts(rows(spark).repartition(5)) and len(parts(rows(spark))) == 6


def test_a_kernel_machine_learns_one_split_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(L, "TASK_ROWS", 100)
    seen, svc = [], L.LinearSVC

    def recorded(**kw):
        class Seen:
            def fit(self, x):
                seen.append(x.rdd.getNumPartitions())
                return svc(**kw).fit(x)

        return Seen()

    monkeypatch.setattr(L, "LinearSVC", recorded)
    L.KernelMachine(FEATURES).fit(rows(spark), "label")
    assert seen == [6]


def test_a_kernel_machine_scores_each_row_once_by_its_formula(spark):
    calls = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: (calls.add(1), v)[1], "double").asNondeterministic()
    x = rows(spark)
    m = L.KernelMachine(FEATURES, gamma=1.0).fit(x, "label")
    got = m.transform(x.withColumn("f1", counted("f1"))).where("score IS NOT NULL").select("id", "margin", "score").toPandas().sort_values("id")
    assert calls.value == 600
    rng = np.random.default_rng(42)
    w, b = rng.normal(0, np.sqrt(2.0), (32, 2)), rng.uniform(0, 2 * np.pi, 32)
    z = np.cos(x.orderBy("id").toPandas()[FEATURES].to_numpy() @ w.T + b) * np.sqrt(2 / 32)
    margin = z @ m.machine.coefficients.toArray() + m.machine.intercept
    assert np.allclose(got["margin"], margin, atol=1e-9)
    assert np.allclose(got["score"], 1 / (1 + np.exp(-(margin * m.scale.coefficients[0] + m.scale.intercept))), atol=1e-9)
