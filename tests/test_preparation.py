"""Neighbours for over-sampling, moments of folds, Shapley values by paths, repeated rows and nulls in spatial joins, inventories of folders."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark import lifecycle
from strataspark.operators import models as L
from strataspark.operators import prep as P
from strataspark.operators import spatial as S
from strataspark.sources import tables as Src


def brute(rows, k):
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, me in enumerate(ids):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        o = np.lexsort((ids, d))
        out[int(me)] = [(int(ids[j]), round(float(d[j]), 9)) for j in o if ids[j] != me][:k]
    return out


@pytest.mark.parametrize("kind", ["clusters", "even", "ties"])
def test_neighbours_equal_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(P, "PIVOT_ROWS", 40)
    monkeypatch.setattr(P, "BLOCK", 64)
    rng = np.random.default_rng(8)
    n = 1500
    if kind == "clusters":
        x = rng.normal(size=(60, 6))[rng.integers(0, 60, n)] * 10 + rng.normal(size=(n, 6)) * 0.2
    elif kind == "even":
        x = rng.uniform(size=(n, 3))
    else:
        x = rng.integers(0, 4, (n, 3)).astype(float)
    rows = [(int(3 * i - 700), [float(c) for c in v]) for i, v in enumerate(x)]
    count = spark.sparkContext.accumulator(0)
    got = {}
    for r in P.vector_neighbours(spark.createDataFrame(rows, "id long, v array<double>"), 5, count).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.nid, round(r.dist, 9)))
    assert got == brute(rows, 5)
    if kind == "clusters":
        assert count.value < n * n / 10


def test_few_rows_have_few_neighbours(spark):
    got = P.vector_neighbours(spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [1.0])], "id long, v array<double>"), 5).orderBy("id", "rank").collect()
    assert [(r.id, r.nid) for r in got] == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    assert P.vector_neighbours(spark.createDataFrame([], "id long, v array<double>"), 5).collect() == []


def test_synthetic_ids_differ_and_do_not_overflow(spark):
    df = spark.createDataFrame([(10**16 + i, [float(i)], int(i < 2)) for i in range(2602)] + [(-5, [0.5], 0)], "id long, v array<double>, y int")
    out = P.smote(df, "y", 1)
    got = out.collect()
    assert len(got) == 5202 and len({r.id for r in got}) == 5202
    assert all(0 <= r.v[0] <= 1 for r in got if r.y == 1) and min(r.id for r in got) == -5 - 2599


def test_moments_of_many_levels(spark):
    rng = np.random.default_rng(1)
    level = rng.integers(0, 100, 6000)
    df = spark.createDataFrame([(i, float(rng.normal() + 1e6), f"l{level[i]:02d}") for i in range(6000)], "id long, u double, kind string")
    folds = df.select(F.lit(0).alias("fold"), "id", F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("role"))
    rows, gone = P.fold_prepare(df, folds, "id", ["u"], [], ["kind"], least=10)
    assert gone.where("why = 'constant'").isEmpty()
    got = rows.where("role = 'train'").select(F.explode("features").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    assert len(got) == 100
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-6 for r in got)


def expected(t, x, known, node=0):
    """A tree's value for rows of which only some features are known."""
    if t["left"][node] < 0:
        return np.full(len(x), t["value"][node])
    a, b, f = int(t["left"][node]), int(t["right"][node]), int(t["feature"][node])
    left, right = expected(t, x, known, a), expected(t, x, known, b)
    if f in known:
        return np.where(x[:, f] <= t["at"][node], left, right)
    return (left * t["n"][a] + right * t["n"][b]) / (t["n"][a] + t["n"][b])


@pytest.mark.parametrize("m", [4, 7, 10])
def test_shapley_values_equal_those_of_subsets(spark, tmp_path, m):
    rng = np.random.default_rng(m)
    x = rng.integers(0, 6, (400, m)).astype(float)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 8 + rng.normal(size=400)).astype(int)
    names = [f"f{i}" for i in range(m)]
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(400)], ["id", *names, "label"])
    model = L.fit_forest(df, names, "label", trees=3, depth=6)
    got = sorted(L.tree_shap(model, df.limit(60), names, "id", str(tmp_path / "a")).collect(), key=lambda r: r.id)
    trees = L._trees(model, str(tmp_path / "b"), spark)
    rows = x[[r.id for r in got]]
    value = lambda s: sum(expected(t, rows, s) for t in trees) / len(trees)
    subsets = {frozenset(s): None for k in range(m + 1) for s in combinations(range(m), k)}
    subsets = {s: value(s) for s in subsets}
    want = np.zeros(rows.shape)
    for s, v in subsets.items():
        for i in set(range(m)) - s:
            want[:, i] += factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m) * (subsets[s | {i}] - v)
    assert np.abs(np.array([r.phi for r in got]) - want).max() < 1e-9
    assert np.abs(np.array([r.prediction for r in got]) - subsets[frozenset(range(m))]).max() < 1e-12
    assert abs(got[0].base - subsets[frozenset()][0]) < 1e-12


def test_first_polygon_keeps_repeated_rows(spark):
    square = [(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 4.0, 4.0), (4.0, 4.0, 0.0, 4.0), (0.0, 4.0, 0.0, 0.0)]
    polygons = spark.createDataFrame([(p, square) for p in (3, 1)], "pid long, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 9.0, 9.0), (2, 9.0, 9.0), (3, None, 1.0), (None, 2.0, 2.0)], "id long, x double, y double")
    got = S.first_polygon(points, polygons, 3.0)
    assert got.columns == ["id", "x", "y", "pid"]
    assert sorted(map(str, got.select("id", "pid").collect())) == sorted(map(str, spark.createDataFrame([(1, 1), (1, 1), (2, None), (2, None), (3, None), (None, 1)], "id long, pid long").collect()))


def test_nulls_are_alike_on_both_ways_to_rectangles(spark):
    points = spark.createDataFrame([(1, 0.0, None), (2, None, None), (3, 0.0, 0.0)], "id long, x double, y double")
    rects = spark.createDataFrame([(3.0, 4.0, 5.0, 6.0), (30.0, 4.0, 50.0, 6.0), (None, 0.0, 1.0, 1.0)], "xmin double, ymin double, xmax double, ymax double")
    for most in (10_000, 0):
        assert {r.id: r.rect_dist for r in S.nearest_rect(points, rects, most).collect()} == {1: None, 2: None, 3: 5.0}


def test_inventory_of_folders_with_equal_file_names(spark, tmp_path):
    for part, text in (("p=1", "a"), ("p=2", "b"), ("p=2/q=1", "c")):
        (tmp_path / "t" / part).mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / part / "part-0.txt").write_text(text)
    files = Src.file_inventory(spark, str(tmp_path / "t"))
    assert {r.name for r in files.collect()} == {"p=1/part-0.txt", "p=2/part-0.txt", "p=2/q=1/part-0.txt"}
    assert Src.inventory_faults(files, files).isEmpty()
    recorded = spark.createDataFrame([("m", r.name, r.sha256, r.bytes) for r in files.collect()], "product string, name string, sha256 string, bytes long")
    assert lifecycle.verified_products(recorded, files).count() == 1
    (tmp_path / "t" / "p=1" / "part-0.txt").unlink()
    left = Src.file_inventory(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in Src.inventory_faults(left, recorded.drop("product")).collect()] == [("p=1/part-0.txt", "missing")]
    assert lifecycle.verified_products(recorded, left).isEmpty()
    assert [r.name for r in Src.file_inventory(spark, str(tmp_path / "t" / "p=2" / "part-0.txt")).collect()] == ["part-0.txt"]


def test_held_out_rows_change_nothing_that_nested_validation_fits(spark):
    from pyspark.ml.classification import LogisticRegression

    from strataspark.operators import nested as N

    rng = np.random.default_rng(2)
    rows = [(i, float(rng.uniform(0, 9000)), float(rng.uniform(0, 9000)), int(rng.random() < 0.4), float(rng.normal()), "ab"[int(rng.integers(2))]) for i in range(160)]
    x = spark.createDataFrame([(*r[:4], r[4] + 2 * r[3], r[5]) for r in rows], "id long, x double, y double, label int, u double, kind string")
    fold = (F.col("x") > 4500).cast("int")
    splits = N.nested_splits(x, "id", [("spatial", fold, 300.0)], 2, (F.col("y") > 4500).cast("int"), 2, 300.0)
    learners = {"linear": (lambda t, c: LogisticRegression(labelCol="label", regParam=c, maxIter=8).fit(t), [{"c": 0.1}, {"c": 2.0}])}
    out = []
    for data in (x, x.withColumns({"u": F.when(fold == 0, 1e4 - F.col("id")).otherwise(F.col("u")), "kind": F.when(fold == 0, "new").otherwise(F.col("kind"))})):
        told, receipts = N.nested_spatial(splits, data, "id", "label", ["u"], [], ["kind"], learners, least=2)
        assert receipts.where("not origin_ok").isEmpty() and told.count() == 160
        out.append(tuple(receipts.where("outer_fold = 0").first()))
    assert out[0] == out[1]  # the test rows of fold 0 differ, what was fitted doesn't


def test_publication_looks_at_its_inputs_again(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(4).coalesce(1).write.parquet(source)
    recorded = Src.file_inventory(spark, source).collect()
    recorded = spark.createDataFrame(recorded, "name string, sha256 string, bytes long")
    lifecycle.publish(spark.read.parquet(source), str(tmp_path / "a"), inputs=(source, recorded))
    spark.range(1).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(ValueError, match="inputs differ"):
        lifecycle.publish(spark.range(4), str(tmp_path / "b"), inputs=(source, recorded))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "in"]


def test_nested_validation_of_a_buffer_that_leaves_nothing(spark):
    from pyspark.ml.classification import LogisticRegression

    from strataspark.operators import nested as N

    x = spark.range(80).selectExpr("id", "cast(id as double) AS x", "0d AS y", "cast(id % 3 = 0 as int) AS label", "id % 3 + id % 7 * 0.5d AS u", "'a' AS kind")
    splits = N.nested_splits(x, "id", [("spatial", F.col("id") % 2, 500.0), ("random", F.col("id") % 2, 0.0)], 2, F.expr("id div 2") % 2, 2, 0.0)
    learners = {"linear": (lambda t, c: LogisticRegression(labelCol="label", regParam=c, maxIter=5).fit(t), [{"c": 0.1}])}
    told, receipts = N.nested_spatial(splits, x, "id", "label", ["u"], [], ["kind"], learners, least=2)
    got = {(r.protocol, r.n_oof, r.threshold is None, r.candidate is None, r.origin_ok) for r in receipts.collect()}
    assert got == {("spatial", 0, True, True, True), ("random", 40, False, False, True)}
    assert {(r.protocol, r.n, r.k) for r in told.groupBy("protocol").agg(F.count("*").alias("n"), F.count("score").alias("k")).collect()} == {("spatial", 80, 0), ("random", 80, 80)}


def test_neighbours_travel_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "VISITS", 64)
    monkeypatch.setattr(P, "SPREADS", 64)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 6))
    got = P.vector_neighbours(spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(v)], "id long, v array<double>"), 3).collect()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert len(got) == 1800 and all(r.nid == int(d[r.id].argsort()[r["rank"] - 1]) for r in got)


def test_neighbours_without_structure_travel_to_packs_not_to_cells(spark, monkeypatch):
    monkeypatch.setattr(P, "PIVOT_ROWS", 8)
    monkeypatch.setattr(P, "BLOCK", 250)
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._gateway.jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, none, sc._gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    v = np.random.default_rng(6).normal(size=(1000, 24))
    before = written()
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(v)]
    got = P.vector_neighbours(spark.createDataFrame(rows, "id long, v array<double>"), 3).collect()
    told = {i: [(r.nid, round(r.dist, 9)) for r in sorted(got, key=lambda r: r["rank"]) if r.id == i] for i in range(0, 1000, 50)}
    want = brute(rows, 3)
    assert len(got) == 3000 and all(told[i] == want[i] for i in told)
    assert written() - before < 40_000  # each row meets most of 125 cells


def test_packs_hold_every_pivot_once():
    x = np.random.default_rng(2).normal(size=(90, 3))
    rows = np.r_[np.full(88, 10), 500, 0]
    packs = P._packs(x, rows, 60)
    assert sorted(np.concatenate(packs)) == list(range(90)) and all(len(p) == 1 or rows[p].sum() <= 60 for p in packs) and len(packs) < 40
    assert len(P._packs(np.zeros((5, 2)), np.full(5, 3), 6)) == 3
