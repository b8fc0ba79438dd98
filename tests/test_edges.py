"""Edge cases stated in numbers."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspark import lifecycle as V
from strataspark.contract import ORDER_CONTRACT
from strataspark.functions import columns as C
from strataspark.operators import folds as K
from strataspark.operators import graph
from strataspark.operators import metrics as M
from strataspark.operators import prep as P
from strataspark.operators import raster as R
from strataspark.operators import spatial as S
from strataspark.operators import tables as Tb
from strataspark.sources import tables as Src
from strataspark.streaming.windows import score_windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_zone_edges_go_up(spark):
    df = spark.createDataFrame([(0.2,), (0.8,), (1.0,), (0.19,), (None,)], "s double")
    assert [r[0] for r in df.select(C.zone("s")).collect()] == [2, 5, 5, 1, 0]


def test_circular_flat(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (90.0,)], "a double")
    s, c = C.circular("a")
    assert [(r[0], round(r[1], 9)) for r in df.select(s, c).collect()] == [(0, 0), (0, 0), (1, 0)]


def test_decimals(spark):
    df = spark.createDataFrame([(78.35,), (78.3508,), (78.0,)], "x double")
    assert [r[0] for r in df.select(C.decimals("x")).collect()] == [2, 4, 0]


def test_missing_and_number(spark):
    df = spark.createDataFrame([(-9999.0, "1.5"), (float("nan"), "x"), (2.0, None)], "x double, t string")
    assert [tuple(r) for r in df.select(C.missing("x"), C.number("t")).collect()] == [(None, 1.5), (None, None), (2.0, None)]


def test_buffer_boundary_is_removed(spark):
    pts = spark.createDataFrame([(1, 12000.0, 5000.0), (2, 12001.0, 5000.0), (3, 5000.0, 5000.0)], "id long, x double, y double")
    rect = spark.createDataFrame([(0.0, 0.0, 10000.0, 10000.0)], "xmin double, ymin double, xmax double, ymax double")
    held = spark.createDataFrame([(5000.0, 5000.0)], "sx double, sy double")
    assert rows(S.outside_buffers(pts, rect, held, 2000.0, 10000.0).select("id")) == [(2,)]
    assert S.outside_buffers(pts, rect, held, 0.0, 10000.0).count() == 3


def test_straddling_cell_has_one_block(spark):
    df = spark.createDataFrame([(189999.0, 5.0), (190001.0, 5.0)], "x double, y double")
    assert len(set(S.block_ids(df, 10_000, 4000.0).select("bx", "by").collect())) == 1


def test_nearest_far_away(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 1e6)], "id long, x double, y double")
    sites = spark.createDataFrame([(7, 3.0, 4.0), (8, 3.0, 4.0), (9, 100.0, 0.0)], "sid long, sx double, sy double")
    got = [(r.id, r["rank"], r.sid) for r in S.nearest(pts, sites, 2).orderBy("id", "rank").collect()]
    assert got == [(1, 1, 7), (1, 2, 8), (2, 1, 7), (2, 2, 8)] or got[:2] == [(1, 1, 7), (1, 2, 8)]


def test_thinning_equals_one_by_one(spark):
    import random

    rnd = random.Random(3)
    pts = [(i, rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(300)]
    kept = []
    for i, x, y in pts:
        if all((x - a) ** 2 + (y - b) ** 2 >= 64 for _, a, b in kept):
            kept.append((i, x, y))
    got = S.thin(spark.createDataFrame(pts, "id long, x double, y double"), 8.0).select("id").collect()
    assert sorted(r.id for r in got) == [i for i, _, _ in kept]


def test_linked_events(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (5, "b"), (6, ""), (7, None), (8, " ")], "g long, e string")
    assert dict(rows(graph.linked_groups(df, "g", "e"))) == {1: 1, 2: 1, 5: 1, 6: 6, 7: 7, 8: 8}


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = dict(rows(graph.components(e, "a", "b")))
    assert {got[i] for i in range(201)} == {0} and got[501] == 500


def test_out_of_fold_threshold(spark):
    df = spark.createDataFrame([(0, 0, 0.1, "v"), (1, 0, 0.2, "v"), (2, 1, 0.7, "v"), (3, 1, 0.9, "v")], "id long, y int, s double, o string")
    assert M.youden_out_of_fold(df, "s", "y", "id", "o", "v").first().threshold == 0.7
    with pytest.raises(ValueError):
        M.youden_out_of_fold(df.union(df), "s", "y", "id", "o", "v")
    with pytest.raises(ValueError):
        M.youden_out_of_fold(df.withColumn("o", F.lit("x")), "s", "y", "id", "o", "v")


def test_youden_without_skill_is_infinite(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.1)], "y int, s double")
    r = M.youden(df, "s", "y").first()
    assert math.isinf(r.threshold) and r.j == 0


def test_metrics_with_nothing_to_divide(spark):
    df = spark.createDataFrame([(0, 0.1)], "y int, s double")
    r = M.confusion(df, F.col("s") >= 0.5, "y").first()
    assert (r.precision, r.recall, r.f1, r.specificity) == (0, 0, 0, 1)
    assert M.auc(df, "s", "y").first().auc is None


def test_rare_class_edge_and_reference_tie(spark):
    df = spark.createDataFrame([("a",)] * 49 + [("b",)] * 50 + [("c",)] * 50, "k string")
    assert dict(rows(P.merge_rare(df, "k").groupBy("k").count())) == {"Other": 49, "b": 50, "c": 50}
    assert P.reference_level(df, "k").first().reference == "b"


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "x", None), (2.0, None, None), (3.0, "y", None), (4.0, "x", None), (None, "y", None)], "n double, c string, e string")
    got = P.impute_categories(P.impute_numbers(df, ["n"]), ["c", "e"])
    assert [r.n for r in got.collect()][-1] == 2.5 and [r.c for r in got.collect()][1] == "x" and got.first().e == "Unknown"
    with pytest.raises(ValueError):
        P.impute_numbers(df.withColumn("n", F.lit(None).cast("double")), ["n"])


def test_held_out_rows_teach_nothing(spark):
    df = spark.createDataFrame([(i, float(i), "a" if i % 2 else "b") for i in range(20)], "k long, x double, c string")
    folds = df.select(F.lit(0).alias("fold"), "k", F.when(F.col("k") < 15, "train").otherwise("test").alias("role"))
    a = P.fold_transform(df, folds, "k", ["x"], "c", 3).where("role = 'train'")
    b = P.fold_transform(df.withColumn("x", F.when(F.col("k") < 15, F.col("x")).otherwise(1e6)), folds, "k", ["x"], "c", 3).where("role = 'train'")
    assert rows(a) == rows(b)


def test_smote_counts(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 11)], int(i < 40)) for i in range(160)], "id long, v array<double>, y int")
    out = P.smote(df, "y", 1)
    assert dict(rows(out.groupBy("y").count())) == {0: 120, 1: 120}
    assert out.select("id").distinct().count() == 240


def test_vif_of_equal_columns_is_infinite(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), float(i * i % 7)) for i in range(30)], "a double, b double, c double")
    left, gone = P.prune_vif(df, ["a", "b", "c"])
    assert len(left) == 2 and "c" in left and math.isinf(gone[0][1])


def test_split_has_exact_shares(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1000)], "k long, y int")
    got = dict(((r.y, r.part), r["count"]) for r in P.stratified_split(df, "k", "y").groupBy("y", "part").count().collect())
    assert got == {(0, "test"): 225, (0, "train"): 525, (1, "test"): 75, (1, "train"): 175}


def test_overlapping_zones_raise(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "cell long, z string")
    with pytest.raises(ValueError):
        R.require_partition(R.coverage(m, ["cell"], "z"))


def test_sub_window():
    assert R.sub_window((0.0, 240.0), (30.0, 210.0), 30.0) == (1, 1)
    with pytest.raises(ValueError):
        R.sub_window((0.0, 240.0), (31.0, 210.0), 30.0)


def test_folds_keep_groups_whole_and_even(spark):
    df = spark.createDataFrame([(g, int((g + i) % 2)) for g in range(40) for i in range(6)], "g long, y int")
    f = df.join(K.group_folds(df, "g", "y", 5), "g")
    assert f.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 12


def test_partition_faults_are_seen(spark):
    u = spark.range(6).withColumnRenamed("id", "k")
    m = K.memberships(u.withColumn("fold", (F.col("k") % 2).cast("int")), "k", 2)
    assert {tuple(r)[1:] for r in K.partition_faults(m, u, "k").collect()} == {(0, 0, 0)}
    bad = m.where("NOT (outer_fold = 0 AND k = 1)").union(m.where("outer_fold = 0 AND k = 2"))
    assert [tuple(r) for r in K.partition_faults(bad, u, "k").orderBy("outer_fold").collect()][0] == (0, 1, 1, 0)
    assert K.coverage_faults(m, "k").isEmpty()


def test_keep_first_and_conflicts(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "a", 3), (2, "b", 4), (3, None, 5)], "k long, v string, o long")
    assert rows(Tb.keep_first(df, ["k"], ["v"], ["o"]).select("k", "o")) == [(1, 1), (3, 5)]


def test_mode_tie_goes_to_the_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, None)], "k long, v string")
    assert rows(Tb.mode_by(df, ["k"], "v")) == [(1, "a", 2)]


def test_contract_and_csv(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    Src.write_csv(spark.createDataFrame([(1, "2.5", "z"), (2, "bad", "z")], "a long, b string, extra string"), str(tmp_path / "c"))
    assert rows(Src.read_csv(spark, str(tmp_path / "c"), schema)) == [(1, 2.5), (2, None)]
    with pytest.raises(ValueError):
        Src.contract(spark.range(1), ORDER_CONTRACT)
    assert Src.normalized_names(spark.range(1).toDF("Dist Roads 1"), ["dist_roads"]).columns == ["dist_roads"]


def test_legend(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"0": "none", "1": "clay", "x": "skip"}')
    assert rows(Src.json_legend(spark, str(tmp_path / "l.json"), {0: "rock"})) == [(0, "rock"), (1, "clay")]


def test_raster_window_reads_its_tiles(spark, tmp_path):
    cells = spark.range(64 * 64).select((F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"), F.col("id").alias("v"))
    path = str(tmp_path / "r")
    Src.write_raster(cells, path, 16)
    w = Src.read_window(spark, path, 10, 5, 10, 3, 16)
    assert w.count() == 30 and "PartitionFilters: [isnotnull(tile_row" in w._jdf.queryExecution().toString()


def test_publish(spark, tmp_path):
    path = str(tmp_path / "p")
    V.publish(spark.range(5), path)
    with pytest.raises(FileExistsError):
        V.publish(spark.range(5), path)
    with pytest.raises(ValueError):
        V.publish(spark.range(5), path + "2", lambda df: df.where("id > 3"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["p"]


def test_line_ends_and_settings_in_fingerprints(spark):
    t = spark.createDataFrame([("a\r\nb", "a\nb")], "x string, y string").select(C.text_hash("x"), C.text_hash("y")).first()
    assert t[0] == t[1]
    f = spark.createDataFrame([("a", "1", 1)], "name string, sha256 string, bytes long")
    assert V.fingerprint(f, {"s": "1"}).first() == V.fingerprint(f, {"s": "1"}).first() != V.fingerprint(f, {"s": "2"}).first()


def test_windows_are_scored_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = T.StructType([T.StructField("row", T.LongType())])
    spark.range(10).withColumnRenamed("id", "row").write.parquet(src)
    score = lambda b: b.withColumn("score", F.col("row") / 10)
    score_windows(spark, src, out, ck, schema, score)
    score_windows(spark, src, out, ck, schema, score)
    spark.range(10, 15).withColumnRenamed("id", "row").write.mode("append").parquet(src)
    score_windows(spark, src, out, ck, schema, score)
    assert sorted(r.row for r in spark.read.parquet(out).select("row").collect()) == list(range(15))


def test_verified_products(spark):
    man = spark.createDataFrame([("p", "a", "1", 1), ("p", "b", "2", 1), ("q", "a", "1", 1)], "product string, name string, sha256 string, bytes long")
    files = spark.createDataFrame([("a", "1", 1)], "name string, sha256 string, bytes long")
    assert rows(V.verified_products(man, files)) == [("q",)]


def test_synthetic_terrain(spark):
    from strataspark.operators.synthetic import pool, terrain

    t = terrain(spark, positives=100, negatives=200, n=5000, missing={"soil_type": 0.2})
    assert rows(t.groupBy("label").count()) == [(0, 200), (1, 100)] and 30 < t.where("soil_type IS NULL").count() < 90
    assert pool(spark, 1000).where("slope < 1 AND aspect <> -1").isEmpty()
    assert rows(terrain(spark, 20, 20, 2000).select("id")) == rows(terrain(spark, 20, 20, 2000).repartition(3).select("id"))


def test_header_faults(spark):
    from strataspark.operators.quality import header_faults

    cells = spark.createDataFrame([(0,)] * 4 + [(1,)] * 6 + [(2,)] * 4, "zone int")
    good = [(0, 4, 0.0036, None), (1, 6, 0.0054, 0.6), (2, 4, 0.0036, 0.4)]
    kind = "zone int, cells long, area_km2 double, share double"
    assert header_faults(spark.createDataFrame(good, kind), cells).isEmpty()
    assert rows(header_faults(spark.createDataFrame([good[0], (1, 5, 0.0054, 0.6), (2, 4, 0.0036, 0.5)], kind), cells)) == [(1, "cells"), (2, "share")]
    assert {r.zone for r in header_faults(spark.createDataFrame(good[:2], kind), cells).collect()} == {2}


def test_saved_models_keep_their_contract(spark, tmp_path):
    from strataspark.operators import models as L

    df = spark.createDataFrame([(float(i), float(i % 5), int(i > 20)) for i in range(40)], "a double, b double, label int")
    L.save_checked(L.fit_forest(df, ["a", "b"], "label", trees=2, depth=2), str(tmp_path / "m"), ["a", "b"], spark)
    assert L.score(L.load_checked(spark, str(tmp_path / "m"), ["a", "b"]), df).count() == 40
    with pytest.raises(ValueError):
        L.load_checked(spark, str(tmp_path / "m"), ["b", "a"])


def test_reports_and_sections(spark, tmp_path):
    Src.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "place int, line string"), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a", "b"]
    Src.merge_section(str(tmp_path / "m.json"), "x", {"k": 1})
    doc = Src.merge_section(str(tmp_path / "m.json"), "y", {"k": 2})
    assert doc["x"]["k"] == 1 and doc["y"]["k"] == 2 and "written" in doc["y"]


def test_inventory_and_checked_writes(spark, tmp_path):
    Src.write_checked(spark.range(5), str(tmp_path / "w"), "id")
    with pytest.raises(ValueError):
        Src.write_checked(spark.range(5).union(spark.range(1)), str(tmp_path / "v"), "id")
    files = Src.file_inventory(spark, str(tmp_path / "w"))
    assert Src.inventory_faults(files, files).isEmpty()


def test_rates_and_projection():
    assert M.projection(1000, 100.0, 4.0, 8000.0) == {"seconds": 10.0, "cells_at_once": 500.0}


def test_thinning_goes_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 16)
    monkeypatch.setattr(S, "MAX_STRETCH", 200)
    pts = [(i, float(i * 37 % 101) / 4, float(i * 53 % 103) / 4) for i in range(1500)]
    kept = []
    for i, x, y in pts:
        if all((x - a) ** 2 + (y - b) ** 2 >= 9 for _, a, b in kept):
            kept.append((i, x, y))
    got = S.thin(spark.createDataFrame(pts, "id long, x double, y double"), 3.0).orderBy("id").collect()
    assert [r.id for r in got] == [k[0] for k in kept]


def test_covered_places_meet_no_rectangle(spark):
    rects = spark.createDataFrame([(float(i % 20), float(i % 15), 40.0 + i % 20, 30.0 + i % 15) for i in range(300)] + [(90.0, 90.0, 90.0, 95.0)], "xmin double, ymin double, xmax double, ymax double")
    places = [(float(x), float(y)) for x in range(-2, 110, 6) for y in range(-2, 110, 6)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places * 2)] + [(9999, None, 1.0)], "id long, x double, y double")
    a, b = ({r.id: r.rect_dist for r in S.nearest_rect(points, rects, n).collect()} for n in (0, 10_000))
    assert a == b and a[9999] is None
    left, done = S._uncovered(points.select("x", "y").na.drop().distinct(), rects)
    assert left.count() + done.count() == len(places) and done.count() > 50


def test_nearest_makes_no_rows_of_candidates(spark, monkeypatch):
    monkeypatch.setattr(S, "SITES", 4)
    sites = [(i, float(i % 5), float(i % 3)) for i in range(60)]
    pts = [(i, i % 6 + 0.25, i % 4 + 0.5) for i in range(50)]
    got = S.nearest(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(sites, "sid long, sx double, sy double"), 3, exclude_self=True).orderBy("id", "rank").collect()
    want = [(i, s) for i, x, y in pts for _, s in sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, s) for s, a, b in sites if s != i)[:3]]
    assert [(r.id, r.sid) for r in got] == want


def test_many_rectangles_are_not_compared_with_every_point(spark):
    inf = float("inf")
    rects = [(float(i % 50 * 20), float(i // 50 * 30), float(i % 50 * 20 + 4), float(i // 50 * 30 + 2)) for i in range(2000)] + [(1200.0, -inf, inf, -50.0)]
    places = [(1.0, 1.0), (-300.0, 7.0), (510.5, 611.0), (5000.0, 5000.0), (1300.0, -80.0), (1100.0, -90.0), (inf, 3.0), (None, 3.0), (float("nan"), 3.0)]
    got = S.nearest_rect(spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, x double, y double"), spark.createDataFrame(rects, "xmin double, ymin double, xmax double, ymax double"))
    assert "_rects" not in got._jdf.queryExecution().toString()
    told = {r.id: r.rect_dist for r in got.collect()}
    for i, (x, y) in enumerate(places[:6]):
        assert abs(told[i] - min(max(a - x, x - c, 0) ** 2 + max(b - y, y - d, 0) ** 2 for a, b, c, d in rects) ** 0.5) < 1e-9
    assert told[6] == inf and told[7] is None and told[8] != told[8]
