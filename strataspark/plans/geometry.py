"""Queries on polygons' areas and insides, clips, burnt lines, filled surfaces and the projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions import columns as C
from strataspark.operators import geometry as G
from strataspark.operators import projection as P
from strataspark.operators import raster as R
from strataspark.operators import spatial as S
from strataspark.plans.registry import query, table
from strataspark.plans.samples import CELLS, cells
from strataspark.plans.spatial import EDGES_SQL, SQUARE, polygons

#: Parcels: a box with a hole in its left half, leaning by half of its height; boxes lean alike, so areas are those of upright ones.
LEAN = 0.5


def _box_sql(name: str, source: str, key: str, a: int, b: int) -> str:
    return f"{name} AS (SELECT {key} AS pid, ({key} * {a} % 20000)::DOUBLE AS x, ({key} * {b} % 20000)::DOUBLE AS y, (400 + {key} * 37 % 900)::DOUBLE AS w, (400 + {key} * 53 % 900)::DOUBLE AS h FROM {source})"


def _boxes(spark, d, source: str, key: str, a: int, b: int):
    k = F.col(key)
    x, y, w, h = (c.cast("double") for c in (k * a % 20000, k * b % 20000, 400 + k * 37 % 900, 400 + k * 53 % 900))
    box = table(spark, d, source).select(k.alias("pid"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    corner = lambda u, v: F.struct((F.col("x") + F.col("w") * u + LEAN * (F.col("y") + F.col("h") * v)).alias("px"), (F.col("y") + F.col("h") * v).alias("py"))
    edges = []
    for ring in (((0, 0), (1, 0), (1, 1), (0, 1)), ((0.25, 0.25), (0.5, 0.25), (0.5, 0.75), (0.25, 0.75))):
        for (u, v), (s, t) in zip(ring, [*ring[1:], ring[0]], strict=True):
            p, q = corner(u, v), corner(s, t)
            edges.append(F.struct(p["px"].alias("x1"), p["py"].alias("y1"), q["px"].alias("x2"), q["py"].alias("y2")))
    return box.select("pid", F.array(*edges).alias("edges"))


LOTS, PLOTS = ("supplier", "s_suppkey", 6101, 9973), ("customer", "c_custkey", 7919, 10007)


def _overlap(p: str, q: str) -> str:
    """What two boxes (x, y, w, h as SQL) share."""
    (x, y, w, h), (u, v, s, t) = p, q
    return f"(greatest(0, least({x} + {w}, {u} + {s}) - greatest({x}, {u})) * greatest(0, least({y} + {h}, {v} + {t}) - greatest({y}, {v})))"


_WHOLE = lambda a: (f"{a}.x", f"{a}.y", f"{a}.w", f"{a}.h")
_HOLE = lambda a: (f"({a}.x + {a}.w / 4)", f"({a}.y + {a}.h / 4)", f"({a}.w / 4)", f"({a}.h / 2)")
_BOTH = f"{_overlap(_WHOLE('a'), _WHOLE('b'))} - {_overlap(_HOLE('a'), _WHOLE('b'))} - {_overlap(_WHOLE('a'), _HOLE('b'))} + {_overlap(_HOLE('a'), _HOLE('b'))}"


@query(f"""WITH {_box_sql('a', *LOTS)}, {_box_sql('b', *PLOTS)}, s AS (SELECT a.pid, b.pid AS other, {_BOTH} AS shared, a.w * a.h * 7 / 8 AS p, b.w * b.h * 7 / 8 AS q FROM a, b)
SELECT pid, other, round(16 * shared)::BIGINT AS shared, round(16 * (p + q - shared))::BIGINT AS either, round(16 * (p - shared))::BIGINT AS only, round(16 * (p + q - 2 * shared))::BIGINT AS differ FROM s WHERE shared > 0.01""")
def overlay_areas(spark, d):
    """In sixteenths of a square metre, of which all these areas are whole numbers."""
    got = G.overlay_areas(_boxes(spark, d, *LOTS), _boxes(spark, d, *PLOTS), 500.0).where("shared > 0.01")
    return got.select("pid", "other", *(F.round(F.col(c) * 16).cast("long").alias(c) for c in ("shared", "either", "only", "differ")))


@query(f"WITH {_box_sql('b', *PLOTS)} SELECT pid, round(w * h * 7 / 8, 3) AS area FROM b")
def polygon_areas(spark, d):
    return G.areas(_boxes(spark, d, *PLOTS), 700.0).select("pid", C.rnd("area", 3).alias("area"))


@query(f"WITH {_box_sql('b', *PLOTS)} SELECT pid, round(x + w * 0.75::DOUBLE + 0.5::DOUBLE * (y + h / 2), 4) AS x, round(y + h / 2, 4) AS y FROM b")
def interior_points(spark, d):
    return G.interior_points(_boxes(spark, d, *PLOTS)).select("pid", C.rnd("x", 4).alias("x"), C.rnd("y", 4).alias("y"))


@query("SELECT s_suppkey AS pid, 5 + s_suppkey % 20 AS points, 5 + s_suppkey % 20 AS inside, 1::BIGINT AS first, 5 + s_suppkey % 20 AS last FROM supplier")
def random_points_in_polygons(spark, d):
    """As many as each polygon asks for, all of them inside it, numbered from 1."""
    lots = _boxes(spark, d, *LOTS)
    got = G.random_points_in(lots.withColumn("quota", 5 + F.col("pid") % 20), "quota").withColumnRenamed("pid", "own")
    held = got.join(lots, F.col("own") == F.col("pid")).select("own", "n", S.inside(F.col("x"), F.col("y"), F.col("edges")).cast("int").alias("inside"))
    return held.groupBy(F.col("own").alias("pid")).agg(F.count("*").alias("points"), F.sum("inside").alias("inside"), F.min("n").alias("first"), F.max("n").alias("last"))


#: Lines cut where they cross a polygon's edges; a piece counts if its middle is inside.
CLIP_SQL = """l AS (SELECT c_custkey AS id, (c_custkey * 7919 % 100000)::DOUBLE AS ux, (c_custkey * 104729 % 100000)::DOUBLE AS uy, (c_custkey * 6101 % 100000)::DOUBLE AS vx, (c_custkey * 9973 % 100000)::DOUBLE AS vy FROM customer),
x AS (SELECT id, pid, ((x1 - ux) * (y2 - y1) - (y1 - uy) * (x2 - x1)) / nullif((vx - ux) * (y2 - y1) - (vy - uy) * (x2 - x1), 0) AS t FROM l, edges
  WHERE ((vx - ux) * (y1 - uy) - (vy - uy) * (x1 - ux)) * ((vx - ux) * (y2 - uy) - (vy - uy) * (x2 - ux)) <= 0),
c AS (SELECT DISTINCT id, pid, t FROM x WHERE t > 0 AND t < 1 UNION SELECT id, pid, unnest([0.0::DOUBLE, 1.0::DOUBLE]) FROM l, (SELECT DISTINCT pid FROM edges)),
p AS (SELECT id, pid, t, lead(t) OVER (PARTITION BY id, pid ORDER BY t) AS u FROM c), m AS (SELECT p.*, ux + (vx - ux) * (t + u) / 2 AS mx, uy + (vy - uy) * (t + u) / 2 AS my, sqrt(power(vx - ux, 2) + power(vy - uy, 2)) AS len FROM p JOIN l USING (id) WHERE u IS NOT NULL),
i AS (SELECT m.id, m.pid, t, u, len FROM m JOIN edges e ON e.pid = m.pid AND (y1 > my) <> (y2 > my) AND mx < (x2 - x1)::DOUBLE * (my - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query(f"WITH {EDGES_SQL}, {CLIP_SQL} SELECT id, pid, round(sum((u - t) * len), 2) AS inside FROM i GROUP BY id, pid")
def lines_clipped_anywhere(spark, d):
    k = F.col("c_custkey")
    lines = table(spark, d, "customer").select(k.alias("id"), *[(k * m % 100_000).cast("double").alias(n) for n, m in (("x1", 7919), ("y1", 104729), ("x2", 6101), ("y2", 9973))])
    part = G.clip_lines(lines, polygons(spark), SQUARE)
    return part.groupBy("id", "pid").agg(C.rnd(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 2).alias("inside"))


@query("""WITH s AS (SELECT c_custkey AS id, (c_custkey * 37 % 3000) + 0.25::DOUBLE AS x1, (c_custkey * 53 % 3000) + 0.25::DOUBLE AS y1, (c_custkey * 71 % 3000) + 0.75::DOUBLE AS x2, (c_custkey * 97 % 3000) + 0.5::DOUBLE AS y2 FROM customer),
r AS (SELECT *, unnest(range(floor((3000 - greatest(y1, y2)) / 30)::BIGINT, floor((3000 - least(y1, y2)) / 30)::BIGINT + 1)) AS row FROM s), c AS (SELECT *, unnest(range(floor(least(x1, x2) / 30)::BIGINT, floor(greatest(x1, x2) / 30)::BIGINT + 1)) AS col FROM r),
t AS (SELECT *, (col * 30 - x1) / (x2 - x1) AS a, (col * 30 + 30 - x1) / (x2 - x1) AS b, (3000 - row * 30 - 30 - y1) / (y2 - y1) AS e, (3000 - row * 30 - y1) / (y2 - y1) AS f FROM c)
SELECT id, row, col FROM t WHERE greatest(0, least(a, b), least(e, f)) < least(1, greatest(a, b), greatest(e, f))""")
def burnt_lines(spark, d):
    k = F.col("c_custkey")
    lines = table(spark, d, "customer").select(k.alias("id"), *[(k * m % 3000 + F.lit(add)).alias(n) for n, m, add in (("x1", 37, 0.25), ("y1", 53, 0.25), ("x2", 71, 0.75), ("y2", 97, 0.5))])
    return R.burn_lines(lines, 0.0, 3000.0, 30.0)


def _fill_sql(rise: str, steps: int = 40) -> str:
    """Spill heights by relaxing all cells so many times; 8 x 8 cells need fewer."""
    return f"""f AS (SELECT 0 AS n, tile, row, col, value AS z, CASE WHEN row IN (0, 7) OR col IN (0, 7) THEN value ELSE 'inf'::DOUBLE END AS h FROM raw
UNION ALL SELECT n + 1, tile, row, col, z, h FROM (SELECT a.n, a.tile, a.row, a.col, a.z, least(a.h, greatest(a.z, min(b.h) + {rise})) AS h FROM f a JOIN f b ON a.tile = b.tile AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col)
  WHERE a.n < {steps} GROUP BY a.n, a.tile, a.row, a.col, a.z, a.h))"""


RAW = CELLS.replace("cells AS", "raw AS", 1)


@query(f"WITH RECURSIVE {RAW}, {_fill_sql('0.0::DOUBLE')} SELECT tile, row::INT AS row, col::INT AS col, round(h, 6) AS filled FROM f WHERE n = 40")
def filled_pits(spark, d):
    return R.fill_pits(cells(spark, d), side=8).select("tile", "row", F.col("col").cast("int").alias("col"), C.rnd("filled").alias("filled"))


@query(f"WITH RECURSIVE {RAW}, {_fill_sql('0.001::DOUBLE')}, e AS (SELECT tile, row, col, h FROM f WHERE n = 40) SELECT count(*) AS cells, count_if(row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.tile = e.tile AND abs(o.row - e.row) <= 1 AND abs(o.col - e.col) <= 1 AND o.h < e.h))::BIGINT AS stuck, count(*) AS drained FROM e")
def drained_tiles(spark, d):
    """Cells; those inside without a lower neighbour once pits are filled; and what leaves over the edges, which is all."""
    from strataspark.checkpoints import cut

    filled = cut(R.fill_pits(cells(spark, d), 0.001, side=8).select("tile", "row", "col", F.col("filled").alias("value")))
    edge = F.col("row").isin(0, 7) | F.col("col").isin(0, 7)
    lower = F.least(*[F.col(f"n{k}") for k in R.AROUND]) < F.col("value")
    around = R.neighbourhood(filled).withColumn("lower", F.coalesce(lower, F.lit(False)))
    ends = R.flow(filled).join(around.select("tile", "row", "col", "lower"), ["tile", "row", "col"])
    return ends.agg(F.count("*").alias("cells"), F.count_if(~edge & ~F.col("lower")).alias("stuck"), F.sum(F.when(edge & ~F.col("lower"), F.col("acc"))).alias("drained"))


def _forward_sql(lon: str, lat: str) -> str:
    xi = " + ".join(["xi", *(f"{a!r}::DOUBLE * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(P.ALPHA, 1))])
    eta = " + ".join(["eta", *(f"{a!r}::DOUBLE * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(P.ALPHA, 1))])
    return f"""g AS (SELECT *, radians({lat}) AS phi, radians({lon} - 75) AS lam FROM q), t AS (SELECT *, sinh(atanh(sin(phi)) - {P._E!r}::DOUBLE * atanh({P._E!r}::DOUBLE * sin(phi))) AS t FROM g),
u AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM t), v AS (SELECT *, {P.SCALE * P._A!r}::DOUBLE * ({xi}) AS north, 500000 + {P.SCALE * P._A!r}::DOUBLE * ({eta}) AS east FROM u)"""


@query(f"WITH q AS (SELECT c_custkey AS id, 70 + (c_custkey * 7919 % 10007) / 1000.0::DOUBLE AS lon, 8 + (c_custkey * 104729 % 28001) / 1000.0::DOUBLE AS lat FROM customer), {_forward_sql('lon', 'lat')} SELECT id, round(east, 3) AS east, round(north, 3) AS north, round(lon, 8) AS lon, round(lat, 8) AS lat FROM v")
def projected_points(spark, d):
    """UTM coordinates (zone 43) and back again: to a millimetre."""
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), (70 + (k * 7919 % 10007) / F.lit(1000.0)).alias("lon"), (8 + (k * 104729 % 28001) / F.lit(1000.0)).alias("lat"))
    e, n = P.project(F.col("lon"), F.col("lat"), P.zone_meridian(43))
    there = p.select("id", e.alias("east"), n.alias("north"))
    lon, lat = P.unproject(F.col("east"), F.col("north"), P.zone_meridian(43))
    return there.select("id", C.rnd("east", 3).alias("east"), C.rnd("north", 3).alias("north"), C.rnd(lon, 8).alias("lon"), C.rnd(lat, 8).alias("lat"))


@query(None)
def simplified_rings(spark, d):
    """Customers of a nation as a ring around their middle, thinned; vertices before and after."""
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(F.col("c_nationkey").alias("pid"), (k * 7919 % 100_000).cast("double").alias("x"), (k * 104729 % 100_000).cast("double").alias("y"))
    rings = p.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct(F.atan2(F.col("y") - 50_000, F.col("x") - 50_000).alias("a"), "x", "y"))).alias("r"))
    points = F.transform("r", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    closed = rings.select("pid", F.concat(points, F.slice(points, 1, 1)).alias("points"))
    out = G.simplify_rings(closed.withColumn("before", F.size("points") - 1), 5e7)
    return out.select("pid", "before", (F.size("points") - 1).alias("after"), (F.element_at("points", 1) == F.element_at("points", -1)).alias("closed"))
