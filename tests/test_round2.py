"""Sources, fold preparation, variance inflation and clipping on small made-up rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import prep as P
from strataspark.operators import raster as R
from strataspark.operators import spatial as S
from strataspark.sources.tables import confined, read_geojson


def test_inflation_is_infinite_only_for_columns_that_others_give():
    a = np.array([[1, 0.1, 0.2], [0.1, 1, 1], [0.2, 1, 1]])
    a[0, 1] = a[1, 0] = a[0, 2] = a[2, 0] = 0.2
    v = P.vif(a)
    assert np.isclose(v[0], 1 / (1 - 0.04)) and np.isinf(v[1:]).all()
    left, gone = P.prune_matrix(a, ["a", "b", "twin"])
    assert left == ["a", "twin"] and gone[0][0] == "b"
    assert np.isinf(P.vif(np.array([[1, np.nan], [np.nan, 1]]))).all()


def test_fold_preparation_learns_from_train_rows_alone(spark):
    rows = [(i, float(i % 7) if i % 5 else None, float(i * 40 % 360), "ab"[i % 2] if i % 6 else None, 1e6 if i % 3 == 0 else float(i % 11)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, u double, angle double, kind string, wild double")
    folds = df.select("id", F.lit(0).alias("fold"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("role"))
    got, gone = P.fold_prepare(df, folds, "id", ["u", "wild"], ["angle"], ["kind"], least=3)
    assert got.count() == 90 and gone.count() == 0
    train = [r.features for r in got.where("role = 'train'").collect()]
    for name in ("u", "wild", "angle_sin", "angle_cos"):
        v = np.array([f[name] for f in train])
        assert abs(v.mean()) < 1e-9 and abs(v.std() - 1) < 1e-9  # the test rows' 1e6 is never seen
    assert sum(n.startswith("kind=") for n in train[0]) == 1
    labels = df.select("id", (F.col("id") % 9 == 1).cast("int").alias("y"))
    balanced = P.fold_smote(got, "id", labels, "y", 1, 0, k=3)
    n = {r.y: r["count"] for r in balanced.groupBy("y").count().collect()}
    assert n[0] == n[1] == 50 and balanced.where("id % 3 = 0 AND id >= 0").count() == 0


def test_fold_preparation_says_what_has_no_value(spark):
    df = spark.createDataFrame([(i, None, float("nan") if i % 2 else 1.0) for i in range(6)], "id long, u double, w double")
    folds = df.select("id", F.lit(0).alias("fold"), F.lit("train").alias("role"))
    with pytest.raises(ValueError, match="u of fold 0"):
        P.fold_prepare(df, folds, "id", ["u", "w"], [], [])


def test_geojson(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    shapes = [
        ("a", "Polygon", [square, hole]), ("b", "MultiPolygon", [[square], [[[x + 10, y] for x, y in square]]]), ("c", "LineString", [[0, 0], [3, 4], [3, 5]]), ("d", "Point", [7.5, 8, 100]),
        ("e", "MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3], [4, 4]]]), ("f", "LineString", []),
    ]
    features = [{"type": "Feature", "id": k, "properties": {"name": k.upper(), "n": 3}, "geometry": {"type": t, "coordinates": c}} for k, t, c in shapes] + [{"type": "Feature", "properties": None, "geometry": None}]
    (tmp_path / "whole.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "rows.jsonl").write_text("\n".join(map(json.dumps, features)) + "\n\n")
    for name, lines in (("whole.geojson", False), ("rows.jsonl", True)):
        got = read_geojson(spark, str(tmp_path / name), lines)
        by = {r.fid: r for r in got.collect()}
        assert len(by) == 7 and by["a"].properties == {"name": "A", "n": "3"}
        assert {k: len(by[k].edges) for k in "abcdef"} == {"a": 8, "b": 8, "c": 2, "d": 1, "e": 3, "f": 0}
        assert tuple(by["d"].edges[0]) == (7.5, 8.0, 7.5, 8.0)
        held = S.in_polygons(spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 11.0, 1.0)], "id long, x double, y double"), got.where("kind LIKE '%Polygon'").withColumnRenamed("fid", "pid"), 5.0, "inner")
        assert sorted((r.id, r.pid) for r in held.collect()) == [(1, "a"), (1, "b"), (2, "b"), (3, "b")]


def test_paths_stay_under_their_root():
    assert confined("/data/", "runs/a-1.parquet") == "/data/runs/a-1.parquet"
    for bad in ("../x", "/etc", "a//b", "a/../b", "", ".hidden"):
        with pytest.raises(ValueError):
            confined("/data", bad)


@pytest.mark.parametrize("turn", [1, -1])
def test_clipping_in_either_turn(spark, turn):
    ring = [(0, 0), (4, 0), (4, 4), (0, 4)][::turn]
    edges = [tuple(map(float, a + b)) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    poly = spark.createDataFrame([(1, edges)], "pid int, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    lines = spark.createDataFrame([(1, -2.0, 2.0, 6.0, 2.0), (2, 1.0, 1.0, 3.0, 3.0), (3, -1.0, -1.0, -1.0, 5.0), (4, 5.0, 3.0, 3.0, 5.0), (5, 2.0, 2.0, 2.0, 9.0), (6, 2.0, 2.0, 2.0, 2.0)], "id int, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: (r.x1, r.y1, r.x2, r.y2) for r in S.clip_to_convex(lines, poly, 3.0).collect()}
    assert got == {1: (0, 2, 4, 2), 2: (1, 1, 3, 3), 5: (2, 2, 2, 4), 6: (2, 2, 2, 2)}


def test_nearest_rectangle_on_a_grid_and_without_any(spark):
    import random

    rng = random.Random(3)
    rects = [(x := rng.uniform(0, 100), y := rng.uniform(0, 100), x + rng.uniform(0, 9), y + rng.uniform(0, 2)) for _ in range(60)]
    points = [(i, rng.uniform(-300, 400), rng.uniform(-50, 150)) for i in range(200)]
    p, r = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(rects, "xmin double, ymin double, xmax double, ymax double")
    a, b = ({x.id: x.rect_dist for x in S.nearest_rect(p, r, n).collect()} for n in (0, 1000))
    assert len(a) == 200 and all(abs(a[k] - b[k]) < 1e-9 for k in b)
    assert [x.rect_dist for x in S.nearest_rect(p.limit(1), r.limit(0)).collect()] == [None]


def test_a_raster_of_many_tiles_has_neighbours_across_them(spark):
    """Rows and columns that count over the whole raster, with the raster's name as key, know no tile edges."""
    cells = spark.range(144).select(F.lit("r").alias("tile"), F.expr("int(id div 12)").alias("row"), F.expr("int(id % 12)").alias("col"), (F.expr("id div 12") * 2.0).alias("value"))
    n = R.neighbourhood(cells)
    assert n.where("n00 IS NULL").count() == 23 and n.select(R.slope_degrees(1.0).alias("s")).where("s IS NOT NULL").count() == 100
    aspects = {round(r.a, 6) for r in n.select(R.aspect_degrees().alias("a")).where("a IS NOT NULL").collect()}
    assert aspects == {0.0}  # it falls to the north, where rows are fewer
    with pytest.raises(ValueError, match="unknown way"):
        R.resample(cells, (0, 0, 1), (0, 0, 1, 1, 1), "cubic")
