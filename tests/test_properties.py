"""Running sums, ranks and components against plain Python on generated tables."""

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataspark.functions import columns as C
from strataspark.operators import graph
from strataspark.operators import metrics as M
from strataspark.operators import ordered as O
from strataspark.operators import quality as Q
from strataspark.operators import spatial as S
from strataspark.operators import tables as T
from strataspark.skew import skew_join

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
numbers = st.lists(st.tuples(st.integers(0, 3), st.integers(-1000, 1000), st.integers(-5, 5)), min_size=1, max_size=60, unique_by=lambda t: t[:2])


@few
@given(numbers)
def test_running_sums(spark, data):
    df = spark.createDataFrame(data, "g long, o long, v long")
    got = {(r.g, r.o): r.s for r in O.running_sum(df, "o", {"v": "s"}, by=["g"], ranges=7).collect()}
    down = {(r.g, r.o): r.s for r in O.running_sum(df, "o", {"v": "s"}, descending=True, by=["g"], ranges=7).collect()}
    assert got == {(g, o): sum(v for a, b, v in data if a == g and b <= o) for g, o, _ in data}
    assert down == {(g, o): sum(v for a, b, v in data if a == g and b >= o) for g, o, _ in data}


@few
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=60))
def test_auc_counts_pairs(spark, data):
    df = spark.createDataFrame([(y, s / 6) for y, s in data], "y int, s double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    got = M.auc(df, "s", "y").first().auc
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
    assert got is None if want is None else abs(got - want) < 1e-12


@few
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_components(spark, edges):
    comp = {n: n for e in edges for n in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    alone = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: c for n, c in comp.items() if n not in alone}


@few
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=1, max_size=25), st.lists(st.tuples(st.integers(-60, 60), st.integers(-60, 60)), min_size=1, max_size=12))
def test_nearest(spark, pts, sites):
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    s = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(sites)], "sid long, sx double, sy double")
    got = {r.id: r.dist for r in S.nearest(p, s).collect()}
    assert len(got) == len(pts)
    for i, (x, y) in enumerate(pts):
        assert abs(got[i] - min(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for a, b in sites)) < 1e-9
    far = {r.id for r in S.beyond(p, s, 10.0).collect()}
    assert far == {i for i, (x, y) in enumerate(pts) if all((x - a) ** 2 + (y - b) ** 2 > 100 for a, b in sites)}


def test_dense_ids_and_tops(spark):
    df = spark.createDataFrame([(7,), (3,), (7,), (10,)], "k long")
    assert sorted((r.k, r.g) for r in O.dense_ids(df, "k", "g").collect()) == [(3, 0), (7, 1), (7, 1), (10, 2)]
    assert [r.k for r in O.top(df, 2, F.desc("k")).collect()] == [10, 7]
    assert [r.id for r in S.draw_limit(spark.range(9), 3).collect()] == [0, 1, 2]
    assert sorted(tuple(r) for r in T.first_per_key(df.withColumn("m", F.col("k") % 2), ["m"], [F.desc("k")]).collect()) == [(7, 1), (10, 0)]


def test_small_functions(spark):
    row = spark.range(1).select(C.hex_rgb(F.lit("#1aFF00")).alias("c"), C.slug(F.lit(" A-b  C! ")).alias("s"), C.ascii_fold(F.lit("Éàßœñ")).alias("a"), C.half_even(F.lit(2.5), 0).alias("h")).first()
    assert row.c == [26, 255, 0] and row.s == "a_b_c" and row.a == "Ean" and row.h == 2.0
    assert Q.first_difference(["a", "b"], ["a", "b"]) == -1 and Q.first_difference(["a", "b"], ["a", "c", "d"]) == 1 and Q.first_difference(["a"], ["a", "b"]) == 1


def test_frequent_keys_are_joined_once(spark):
    big = spark.createDataFrame([(i % 50 if i % 3 else 7, i) for i in range(3000)], "k long, v long")
    n = defaultdict(int)
    for r in big.collect():
        n[r.k] += 1
    small = spark.createDataFrame([(k, c, f"x{k}") for k, c in n.items() if k != 9], "k long, n long, x string")
    got = skew_join(big, small, "k", "n", 3000, "left", share=10)
    assert got.count() == 3000 and got.where("x IS NULL").count() == n[9] and got.where("k <> 9 AND x <> concat('x', k)").isEmpty()
    assert skew_join(big, small, "k", "n", 3000, share=10).count() == 3000 - n[9]
