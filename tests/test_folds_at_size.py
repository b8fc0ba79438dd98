"""Fold preparation at size: medians by enclosing quantiles, folds joined once, rounding without decimals."""

import random

import pytest
from pyspark.sql import functions as F

from strataspark.functions import columns as C
from strataspark.operators import prep as P


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 40, 1001, 30_000])
def test_medians_of_folds_are_exact(spark, n):
    k = F.col("id")
    x = spark.range(0, n, 1, 3).select((k % 2).cast("int").alias("fold"), (k * 7919 % 10_007 / 3.0 - 900).alias("a"), F.when(k % 5 != 0, k % 4 * 1.0).alias("tied"), F.lit(2.5).alias("same"), F.lit(None).cast("double").alias("none"))
    cols = ["a", "tied", "same", "none"]
    want = {r.fold: [r[c] for c in cols] for r in x.groupBy("fold").agg(*[F.median(c).alias(c) for c in cols]).collect()}
    assert P.fold_medians(x, cols) == want


def test_medians_outside_their_quantiles_are_exact_too(spark, monkeypatch):
    monkeypatch.setattr(P, "AROUND", -0.3)
    x = spark.range(0, 2000).select(F.lit(0).alias("fold"), F.sqrt("id").alias("a"))
    assert P.fold_medians(x, ["a"]) == {0: [x.agg(F.median("a")).first()[0]]}


def test_folds_are_joined_with_the_rows_once(spark):
    df = spark.range(60).select("id", (F.col("id") * 7 % 13 * 1.0).alias("u"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("kind"))
    folds = df.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("fold")).select("fold", "id", F.when(F.col("id") % 2 == F.col("fold"), "test").otherwise("train").alias("role"))
    rows, _ = P.fold_prepare(df, folds, "id", ["u"], [], ["kind"], least=2)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan and "role" in plan
    got = {(r.fold, r.id): r.features for r in rows.collect()}
    assert len(got) == 120 and set(got[0, 0]) == {"u", "kind=c1", "kind=c2"}


def test_fast_rounding_is_rounding(spark):
    rng = random.Random(7)
    v = [0.0, -0.0, 1.00005, -1.00005, 2.675, 1e300, -1e15, 0.00005, -0.00004, float("nan"), float("inf"), None, 12345.67895, 0.49999999] + [rng.uniform(-10, 10) for _ in range(4000)] + [rng.randrange(-(10**6), 10**6) / 2e4 for _ in range(4000)]
    x = spark.createDataFrame([(i, a) for i, a in enumerate(v)], "i int, v double").select("i", C.rnd("v", 4).alias("a"), C.rnd_fast("v", 4).alias("b"))
    assert x.where("NOT (a <=> b)").count() == 0
    assert all(str(r.a) == str(r.b) for r in x.collect())
