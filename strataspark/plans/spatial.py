"""Queries on points, rectangles, polygons and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions import columns as C
from strataspark.operators import graph
from strataspark.operators import spatial as S
from strataspark.plans.registry import query, table
from strataspark.plans.samples import POINTS, SITES, points, sites

#: Polygons as rings; the second ring of the first is a hole.
RINGS = {
    1: [[(5000, 5000), (45000, 5000), (45000, 60000), (5000, 60000)], [(15000, 20000), (30000, 20000), (30000, 40000), (15000, 40000)]],
    2: [[(45000, 5000), (95000, 5000), (80000, 90000), (45000, 60000)]],
    3: [[(30000, 50000), (70000, 50000), (50000, 99000)]],
}
EDGES = [(pid, *a, *b) for pid, rings in RINGS.items() for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
EDGES_SQL = f"edges AS (SELECT * FROM (VALUES {', '.join(str(e) for e in EDGES)}) AS t(pid, x1, y1, x2, y2))"
IN_SQL = "hits AS (SELECT id, pid FROM points, edges WHERE y1 <> y2 AND (y1 > y) <> (y2 > y) AND x < (x2 - x1)::DOUBLE * (y - y1) / (y2 - y1) + x1 GROUP BY id, pid HAVING count(*) % 2 = 1)"
SQUARE = 20_000.0


def polygons(spark):
    e = spark.createDataFrame([(p, *map(float, r)) for p, *r in EDGES], "pid int, x1 double, y1 double, x2 double, y2 double")
    return e.groupBy("pid").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))


@query(f"""WITH {POINTS}, {SITES}, r AS (SELECT id, sid, sqrt(((x - sx) * (x - sx) + (y - sy) * (y - sy))::DOUBLE) AS dist, row_number() OVER (PARTITION BY id ORDER BY (x - sx) * (x - sx) + (y - sy) * (y - sy), sid) AS k FROM points, sites)
SELECT id, sid, round(dist, 4) AS dist FROM r WHERE k = 1""")
def knn_nearest(spark, d):
    return S.nearest(points(spark, d), sites(spark, d)).select("id", "sid", C.rnd("dist", 4).alias("dist"))


@query(f"""WITH {SITES}, r AS (SELECT a.sid AS id, b.sid, sqrt(((a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy))::DOUBLE) AS dist, row_number() OVER (PARTITION BY a.sid ORDER BY (a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy), b.sid) AS k FROM sites a JOIN sites b ON a.sid <> b.sid)
SELECT id, k::INT AS rank, sid, round(dist, 4) AS dist FROM r WHERE k <= 2""")
def knn_self(spark, d):
    s = sites(spark, d)
    return S.nearest(s.toDF("id", "x", "y"), s, k=2, exclude_self=True).select("id", "rank", "sid", C.rnd("dist", 4).alias("dist"))


@query(f"WITH {POINTS}, {SITES} SELECT id, x, y FROM points WHERE NOT EXISTS (SELECT 1 FROM sites WHERE (x - sx) * (x - sx) + (y - sy) * (y - sy) <= 3000 * 3000)")
def radius_anti(spark, d):
    return S.beyond(points(spark, d).select("id", "x", "y"), sites(spark, d), 3000.0)


RECTS_SQL = "rects AS (SELECT s_suppkey * 6101 % 100000 AS xmin, s_suppkey * 9973 % 100000 AS ymin, s_suppkey * 6101 % 100000 + 4000 AS xmax, s_suppkey * 9973 % 100000 + 2000 AS ymax FROM supplier)"


def rects(spark, d):
    return sites(spark, d).select(F.col("sx").alias("xmin"), F.col("sy").alias("ymin"), (F.col("sx") + 4000).alias("xmax"), (F.col("sy") + 2000).alias("ymax"))


@query(f"""WITH {POINTS}, {RECTS_SQL} SELECT id, round(min(sqrt(power(greatest(xmin - x, x - xmax, 0), 2) + power(greatest(ymin - y, y - ymax, 0), 2))), 4) AS dist FROM points, rects GROUP BY id""")
def rect_distance(spark, d):
    return S.nearest_rect(points(spark, d), rects(spark, d)).select("id", C.rnd("rect_dist", 4).alias("dist"))


@query(f"""WITH {POINTS}, {RECTS_SQL} SELECT id, round(min(sqrt(power(greatest(xmin - x, x - xmax, 0), 2) + power(greatest(ymin - y, y - ymax, 0), 2))), 4) AS dist FROM points, rects GROUP BY id""")
def rect_distance_on_grid(spark, d):
    """The same by squares, as for more rectangles than may be broadcast."""
    return S.nearest_rect(points(spark, d), rects(spark, d), at_once=0).select("id", C.rnd("rect_dist", 4).alias("dist"))


#: Lines from customers' figures, and where they enter and leave the convex polygon 2; its ring runs with the inside on the left.
LINES_SQL = """l AS (SELECT c_custkey AS id, (c_custkey * 7919 % 100000)::DOUBLE AS x1, (c_custkey * 104729 % 100000)::DOUBLE AS y1, (c_custkey * 6101 % 100000)::DOUBLE AS x2, (c_custkey * 9973 % 100000)::DOUBLE AS y2 FROM customer),
e AS (SELECT x1 AS px, y1 AS py, x2 AS qx, y2 AS qy FROM edges WHERE pid = 2), s AS (SELECT l.*, (qx - px) * (y1 - py) - (qy - py) * (x1 - px) AS a, (qx - px) * (y2 - py) - (qy - py) * (x2 - px) AS b FROM l, e),
t AS (SELECT id, x1, y1, x2, y2, max(CASE WHEN a < 0 AND b > 0 THEN a / (a - b) WHEN a < 0 OR (a = 0 AND b < 0) THEN 2 ELSE 0 END) AS i, min(CASE WHEN a > 0 AND b < 0 THEN a / (a - b) ELSE 1 END) AS o FROM s GROUP BY ALL)"""


@query(f"""WITH {EDGES_SQL}, {LINES_SQL} SELECT id, round(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) * (o - i), 3) AS inside FROM t WHERE i < o""")
def lines_clipped(spark, d):
    k = F.col("c_custkey")
    lines = table(spark, d, "customer").select(k.alias("id"), *[(k * m % 100_000).cast("double").alias(n) for n, m in (("x1", 7919), ("y1", 104729), ("x2", 6101), ("y2", 9973))])
    part = S.clip_to_convex(lines, polygons(spark).where("pid = 2"), SQUARE)
    return part.select("id", C.rnd(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 3).alias("inside"))


@query(f"""WITH {POINTS}, {SITES}, {RECTS_SQL} SELECT id FROM points WHERE NOT EXISTS (SELECT 1 FROM rects WHERE sqrt(power(greatest(xmin - x, x - xmax, 0), 2) + power(greatest(ymin - y, y - ymax, 0), 2)) <= 2000)
AND NOT EXISTS (SELECT 1 FROM sites WHERE (x - sx) * (x - sx) + (y - sy) * (y - sy) <= 2000 * 2000)""")
def buffer_exclusion(spark, d):
    return S.outside_buffers(points(spark, d), rects(spark, d), sites(spark, d), 2000.0, 5000.0).select("id")


@query(f"WITH {POINTS}, {EDGES_SQL}, {IN_SQL} SELECT id, pid FROM hits")
def point_in_polygon(spark, d):
    return S.in_polygons(points(spark, d), polygons(spark), SQUARE, "inner").select("id", "pid")


@query(f"WITH {POINTS}, {EDGES_SQL}, {IN_SQL} SELECT points.id, min(pid) AS pid FROM points LEFT JOIN hits ON points.id = hits.id GROUP BY 1")
def first_polygon_match(spark, d):
    return S.first_polygon(points(spark, d), polygons(spark), SQUARE).select("id", "pid")


@query(f"""WITH {POINTS}, {EDGES_SQL}, {IN_SQL}, k AS (SELECT points.id, count(pid) AS k FROM points LEFT JOIN hits ON points.id = hits.id GROUP BY 1)
SELECT count(*) AS cells, count_if(k = 1)::BIGINT AS assigned, count_if(k = 0)::BIGINT AS unassigned, count_if(k > 1)::BIGINT AS multiply_assigned FROM k""")
def zone_coverage(spark, d):
    from strataspark.operators.raster import coverage

    return coverage(S.in_polygons(points(spark, d), polygons(spark), SQUARE), ["id"], "pid")


@query(f"""WITH {POINTS} SELECT id, floor((floor(x / 30.0::DOUBLE) + 0.5::DOUBLE) * 30 / 10000)::BIGINT AS bx, floor((floor(y / 30.0::DOUBLE) + 0.5::DOUBLE) * 30 / 10000)::BIGINT AS by, floor((100000 - y) / 30.0::DOUBLE)::BIGINT AS row, floor(x / 30.0::DOUBLE)::BIGINT AS col FROM points""")
def block_assign(spark, d):
    row, column = C.cell_of("x", "y", 0.0, 100000.0)
    return S.block_ids(points(spark, d), 10_000, 30.0).select("id", "bx", "by", row.alias("row"), column.alias("col"))


@query(f"""WITH {POINTS}, b AS (SELECT *, floor((floor(x / 30.0::DOUBLE) + 0.5::DOUBLE) * 30 / 10000)::BIGINT AS bx, floor((floor(y / 30.0::DOUBLE) + 0.5::DOUBLE) * 30 / 10000)::BIGINT AS "by" FROM points)
SELECT bx, "by", least(bx * 10000.0::DOUBLE, min(x)) AS xmin, least("by" * 10000.0::DOUBLE, min(y)) AS ymin, greatest((bx + 1) * 10000.0::DOUBLE, max(x)) AS xmax, greatest(("by" + 1) * 10000.0::DOUBLE, max(y)) AS ymax, count(*) AS n FROM b GROUP BY bx, "by" """)
def block_rects(spark, d):
    return S.block_rects(S.block_ids(points(spark, d), 10_000, 30.0), 10_000)


@query(f"""WITH {POINTS}, g AS (SELECT i, j, count(id) AS n FROM (SELECT unnest(range(20)) AS i), (SELECT unnest(range(20)) AS j) LEFT JOIN points ON floor(x / 5000) = i AND floor(y / 5000) = j GROUP BY ALL)
SELECT count(*)::INT AS quadrats, count_if(n = 0)::BIGINT AS empty, round(avg(n), 6) AS mean, round(var_samp(n), 6) AS variance, round(var_samp(n) / avg(n), 6) AS ratio FROM g""")
def quadrat_dispersion(spark, d):
    return S.dispersion(points(spark, d), 5000.0, 20, 20)


@query(f"""WITH {POINTS} SELECT coalesce(sum(c - 1), 0)::BIGINT AS shared FROM (SELECT count(*) AS c FROM points GROUP BY floor(x / 900), floor(y / 900))""")
def shared_cells(spark, d):
    p = points(spark, d)
    return p.groupBy(C.grid_index("x", 0.0, 900.0), C.grid_index("y", 0.0, 900.0)).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("shared"))


@query("""WITH RECURSIVE k AS (SELECT DISTINCT o_custkey AS c, 'e' || floor(o_totalprice)::BIGINT AS e FROM orders WHERE o_orderkey % 60 <> 0), n AS (SELECT DISTINCT a.c AS a, b.c AS b FROM k a JOIN k b ON a.e = b.e),
r AS (SELECT DISTINCT a AS node, a AS root FROM n UNION SELECT b, root FROM r JOIN n ON a = node), c AS (SELECT node, min(root) AS linked FROM r GROUP BY 1)
SELECT o_custkey, coalesce(linked, o_custkey) AS linked FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN c ON node = o_custkey""")
def linked_components(spark, d):
    event = F.when(F.col("o_orderkey") % 60 == 0, " ").otherwise(F.concat(F.lit("e"), F.floor(F.col("o_totalprice")).cast("string")))
    return graph.linked_groups(table(spark, d, "orders").select("o_custkey", event.alias("event")), "o_custkey", "event")


@query(f"""WITH RECURSIVE {POINTS}, o AS (SELECT id, x, y, row_number() OVER (ORDER BY id) AS k FROM points),
t AS (SELECT 0::BIGINT AS k, []::STRUCT(id BIGINT, x BIGINT, y BIGINT)[] AS kept
UNION ALL SELECT o.k, CASE WHEN len(list_filter(kept, lambda p: (p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) < 4000 * 4000)) = 0 THEN list_append(kept, {{'id': o.id, 'x': o.x, 'y': o.y}}) ELSE kept END FROM t JOIN o ON o.k = t.k + 1)
SELECT p.id, p.x, p.y FROM (SELECT unnest(kept) AS p FROM t WHERE k = (SELECT count(*) FROM points))""")
def spacing_thinned(spark, d):
    return S.thin(points(spark, d), 4000.0).select("id", "x", "y")


@query(f"""WITH {POINTS}, {SITES}, {EDGES_SQL}, {IN_SQL}, near AS (SELECT id FROM points WHERE EXISTS (SELECT 1 FROM sites WHERE (x - sx) * (x - sx) + (y - sy) * (y - sy) <= 1500 * 1500))
SELECT CASE WHEN id NOT IN (SELECT id FROM hits) THEN 'outside' WHEN id IN (SELECT id FROM near) THEN 'near a site' WHEN "group" = 5 THEN 'water' ELSE 'accepted' END AS reason, count(*) AS n FROM points GROUP BY 1""")
def rejection_counts(spark, d):
    p = points(spark, d)
    inside = S.in_polygons(p, polygons(spark), SQUARE, "inner").select("id").distinct().withColumn("in", F.lit(True))
    far = S.beyond(p, sites(spark, d), 1500.0).select("id").withColumn("far", F.lit(True))
    x = p.join(inside, "id", "left").join(far, "id", "left")
    return S.rejection_cascade(x, [("outside", F.col("in").isNull()), ("near a site", F.col("far").isNull()), ("water", F.col("group") == 5)]).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT n_name AS class, round(sum(sqrt(((c_custkey * 31 % 1000) * (c_custkey * 31 % 1000) + (c_custkey * 57 % 1000) * (c_custkey * 57 % 1000))::DOUBLE)) / 1000, 4) AS km FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC")
def length_by_class(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("class")).agg(C.rnd(F.sum(F.hypot(k * 31 % 1000, k * 57 % 1000)) / 1000, 4).alias("km")).orderBy(F.desc("km"))


@query("SELECT i AS id, round((i * 1103515245 + 1) % 2147483647 / 2147483647.0::DOUBLE * 100000, 4) AS x, round((i * 811297697 + 2) % 2147483647 / 2147483647.0::DOUBLE * 100000, 4) AS y FROM (SELECT unnest(range(20000)) AS i)")
def random_points(spark, d):
    return spark.range(20_000).select("id", C.rnd(C.uniform("id", 1) * 100_000, 4).alias("x"), C.rnd(C.uniform("id", 2, 811297697) * 100_000, 4).alias("y"))


@query(f"WITH {POINTS} SELECT id FROM points WHERE floor(x / 30)::BIGINT % 7 = 0 AND floor(y / 30)::BIGINT % 7 = 0")
def systematic_sample(spark, d):
    return points(spark, d).where((C.grid_index("x", 0.0, 30.0) % 7 == 0) & (C.grid_index("y", 0.0, 30.0) % 7 == 0)).select("id")


@query(f"""WITH {POINTS}, p AS (SELECT * FROM points WHERE "group" <> 5), w AS (SELECT DISTINCT floor(x / 30)::BIGINT AS i, floor(y / 30)::BIGINT AS j FROM points WHERE "group" = 5)
SELECT id FROM p WHERE EXISTS (SELECT 1 FROM w WHERE power(greatest(i * 30 - x, x - (i + 1) * 30, 0), 2) + power(greatest(j * 30 - y, y - (j + 1) * 30, 0), 2) < 1000 * 1000)""")
def class_edge_within(spark, d):
    p = points(spark, d)
    water = p.where("group = 5").select(C.grid_index("x", 0.0, 30.0).alias("i"), C.grid_index("y", 0.0, 30.0).alias("j")).distinct()
    squares = water.select((F.col("i") * 30).cast("double").alias("xmin"), (F.col("j") * 30).cast("double").alias("ymin"), ((F.col("i") + 1) * 30).cast("double").alias("xmax"), ((F.col("j") + 1) * 30).cast("double").alias("ymax"))
    dry = p.where("group <> 5")
    far = S.outside_buffers(dry, squares, dry.select(F.lit(-1e9).alias("sx"), F.lit(-1e9).alias("sy")).limit(1), 1000.0 * (1 - 1e-12), 1000.0)
    return dry.join(far, "id", "left_anti").select("id")
