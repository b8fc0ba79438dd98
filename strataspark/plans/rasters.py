"""Queries on rasters: the 64 components of each embedding are an 8 x 8 tile."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions import columns as C
from strataspark.operators import raster as R
from strataspark.plans.registry import query
from strataspark.plans.samples import CELLS, SCORED, ZONE, cells, scored

#: Neighbours in SQL, by self join.
NB = "nb AS (SELECT a.tile, a.row, a.col, a.value, " + ", ".join(f"max(b.value) FILTER (b.row = a.row + {r - 1} AND b.col = a.col + {c - 1}) AS n{r}{c}" for r in range(3) for c in range(3)) + " FROM cells a JOIN cells b ON a.tile = b.tile AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL)"


@query(f"WITH {CELLS}, {NB} SELECT tile, row, col, round(sqrt(" + " + ".join(f"coalesce(power(n{k} - n11, 2), 0)" for k in R.AROUND) + "), 6) AS tri FROM nb")
def tile_focal_tri(spark, d):
    return R.neighbourhood(cells(spark, d)).select("tile", "row", "col", C.rnd(R.ruggedness()).alias("tri"))


@query(f"""WITH {CELLS}, {NB} SELECT tile, row, col, round(degrees(atan(sqrt(power(((n02 + 2 * n12 + n22) - (n00 + 2 * n10 + n20)) / 8, 2) + power(((n20 + 2 * n21 + n22) - (n00 + 2 * n01 + n02)) / 8, 2)))), 5) AS slope FROM nb WHERE row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6""")
def tile_slope(spark, d):
    return R.neighbourhood(cells(spark, d)).select("tile", "row", "col", C.rnd(R.slope_degrees(1.0), 5).alias("slope")).where("slope IS NOT NULL")


@query(f"""WITH {CELLS}, {NB}, g AS (SELECT tile, row, col, (n02 + 2 * n12 + n22) - (n00 + 2 * n10 + n20) AS dx, (n20 + 2 * n21 + n22) - (n00 + 2 * n01 + n02) AS dy FROM nb WHERE row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6), a AS (SELECT *, degrees(atan2(-dx, dy)) AS d FROM g)
SELECT tile, row, col, round(CASE WHEN dx = 0 AND dy = 0 THEN -1 WHEN d < 0 THEN d + 360 ELSE d END, 4) AS aspect FROM a""")
def tile_aspect(spark, d):
    return R.neighbourhood(cells(spark, d)).select("tile", "row", "col", C.rnd(R.aspect_degrees(), 4).alias("aspect")).where("aspect IS NOT NULL")


#: Cells of a grid of 5 x 5 over each tile, and where their centres lie in cells of the tile.
GRID = "grid AS (SELECT tile, r::INT AS row, c::INT AS col, (r + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE AS y, (c + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE AS x FROM (SELECT DISTINCT tile FROM cells), (SELECT unnest(range(5)) AS r), (SELECT unnest(range(5)) AS c))"
TO = (0.0, 8.0, 1.6, 5, 5)


@query(f"""WITH {CELLS}, {GRID}, w AS (SELECT g.tile, g.row, g.col, c.value, (1 - abs(y - c.row)) * (1 - abs(x - c.col)) AS w FROM grid g JOIN cells c ON c.tile = g.tile AND abs(y - c.row) < 1 AND abs(x - c.col) < 1 WHERE NOT (c.row = 3 AND c.col = 3))
SELECT tile, row, col, round(sum(value * w) / sum(w), 6) AS value FROM w GROUP BY ALL""")
def tile_bilinear(spark, d):
    known = cells(spark, d).where("NOT (row = 3 AND col = 3)")
    return R.resample(known, (0.0, 8.0, 1.0), TO).select("tile", "row", "col", C.rnd("value").alias("value"))


@query(f"WITH {CELLS}, {GRID} SELECT g.tile, g.row, g.col, round(c.value, 6) AS value FROM grid g JOIN cells c ON c.tile = g.tile AND c.row = floor(y + 0.5)::INT AND c.col = floor(x + 0.5)::INT")
def tile_nearest(spark, d):
    return R.resample(cells(spark, d), (0.0, 8.0, 1.0), TO, "nearest").select("tile", "row", "col", C.rnd("value").alias("value"))


@query(f"""WITH {CELLS}, c AS (SELECT tile, floor((row + 0.5::DOUBLE) / 1.6::DOUBLE)::INT AS row, floor((col + 0.5::DOUBLE) / 1.6::DOUBLE)::INT AS col, floor(value * 10)::BIGINT AS v, count(*) AS n FROM cells GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tile, row, col ORDER BY n DESC, v) AS k FROM c)
SELECT tile, row, col, v AS value FROM r WHERE k = 1""")
def tile_mode(spark, d):
    return R.resample(cells(spark, d).withColumn("value", F.floor(F.col("value") * 10).cast("long")), (0.0, 8.0, 1.0), TO, "mode")


@query(f"""WITH {CELLS}, {NB}, t AS (SELECT *, (n10 + n12) / 2 - n11 AS d, (n01 + n21) / 2 - n11 AS e, (-n00 + n02 + n20 - n22) / 4 AS f, (n12 - n10) / 2 AS g, (n01 - n21) / 2 AS h FROM nb WHERE row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6)
SELECT tile, row, col, round(100 * -2 * (d * g * g + e * h * h + f * g * h) / (g * g + h * h), 3) AS curvature FROM t WHERE g * g + h * h > 1e-4""")
def tile_curvature(spark, d):
    g, h = (F.col("n12") - F.col("n10")) / 2, (F.col("n01") - F.col("n21")) / 2
    return R.neighbourhood(cells(spark, d)).where("row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6").where(g * g + h * h > 1e-4).select("tile", "row", "col", C.rnd(R.profile_curvature(1.0) * 100, 3).alias("curvature"))


@query(f"WITH {CELLS}, t AS (SELECT tile, row, col FROM cells WHERE value > 0.2) SELECT a.tile, a.row, a.col, round(min(sqrt((power(a.row - t.row, 2) + power(a.col - t.col, 2))::DOUBLE)) * 30, 4) AS dist FROM cells a LEFT JOIN t ON a.tile = t.tile GROUP BY ALL")
def tile_proximity(spark, d):
    return R.proximity(cells(spark, d), F.col("value") > 0.2, 30.0).select("tile", "row", "col", C.rnd("dist", 4).alias("dist"))


@query(f"""WITH {CELLS}, c AS (SELECT tile, row // 2 AS row, col // 2 AS col, floor(value * 10)::BIGINT AS v, count(*) AS n FROM cells GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tile, row, col ORDER BY n DESC, v) AS k FROM c) SELECT tile, row, col, v AS value FROM r WHERE k = 1""")
def tile_majority(spark, d):
    return R.majority(cells(spark, d).withColumn("value", F.floor(F.col("value") * 10).cast("long")), 2)


@query(f"WITH {CELLS} SELECT tile, ((row - 1) // 3)::INT AS row, ((col - 1) // 3)::INT AS col, round(value, 6) AS value FROM cells WHERE row >= 1 AND col >= 1 AND (row - 1) % 3 = 0 AND (col - 1) % 3 = 0")
def tile_stride(spark, d):
    return R.stride(cells(spark, d), 3, 1, 1).select("tile", "row", "col", C.rnd("value").alias("value"))


@query(f"WITH {CELLS} SELECT band, row, col, round(avg(value), 5) AS mean, count(*) AS n FROM cells GROUP BY ALL")
def tile_mean_stack(spark, d):
    return cells(spark, d).groupBy("band", "row", "col").agg(C.rnd(F.avg("value"), 5).alias("mean"), F.count("value").alias("n"))


@query(f"""WITH {CELLS}, c AS (SELECT band, CASE WHEN tile % 9 = 0 AND row = 0 THEN NULL WHEN band = 3 THEN 0.0 ELSE value END AS value FROM cells)
SELECT band, count(*) AS cells, round(min(value), 6) AS min, round(max(value), 6) AS max, round(100 * avg((value IS NULL)::INT::DOUBLE), 4) AS pct_missing, count_if(value < -0.4 OR value > 0.4) > 0 AS out_of_range, min(value) = max(value) AS constant, coalesce(avg((value = 0)::INT::DOUBLE) > 0.5, false) AS mostly_zero FROM c GROUP BY band""")
def band_audit(spark, d):
    c = cells(spark, d).withColumn("value", F.when((F.col("tile") % 9 == 0) & (F.col("row") == 0), None).when(F.col("band") == 3, 0.0).otherwise(F.col("value")))
    return R.band_audit(c, "band", -0.4, 0.4)


@query(f"WITH {CELLS}, c AS (SELECT * FROM cells WHERE NOT (tile % 10 = 4 AND row = 7)) SELECT tile, count(*) AS n, count(*) = 64 AS aligned FROM c GROUP BY 1")
def grid_alignment(spark, d):
    return R.alignment(cells(spark, d).where("NOT (tile % 10 = 4 AND row = 7)"), "tile")


@query(f"""WITH {CELLS}, s AS (SELECT a.value AS a, CASE WHEN b.row = 0 THEN -9999 ELSE b.value END AS b FROM cells a JOIN cells b ON a.tile + 1 = b.tile AND a.row = b.row AND a.col = b.col WHERE a.tile % 2 = 0)
SELECT count(*) AS cells, count_if(b <> -9999)::BIGINT AS readable, count_if(b <> -9999 AND a < -0.1)::BIGINT AS water, count_if(b <> -9999 AND a >= -0.1)::BIGINT AS scorable FROM s""")
def readable_mask(spark, d):
    c = cells(spark, d).withColumn("stack", F.expr("tile div 2"))
    a = c.where("tile % 2 = 0").select("stack", "row", "col", "value")
    b = c.where("tile % 2 = 1").select("stack", "row", "col", F.when(F.col("row") == 0, -9999.0).otherwise(F.col("value")).alias("value"))
    return R.mask_counts(R.stack({"a": a, "b": b}, ["stack", "row", "col"]), ["a", "b"], -9999.0, F.col("a") < -0.1)


@query(f"WITH {CELLS}, p AS (SELECT c_custkey AS id, c_custkey % 500 AS tile, (c_custkey * 37 % 240)::DOUBLE AS x, (c_custkey * 53 % 240)::DOUBLE AS y FROM customer) SELECT id, round(value, 6) AS value FROM p LEFT JOIN cells ON cells.tile = p.tile AND row = floor((240 - y) / 30)::BIGINT AND col = floor(x / 30)::BIGINT")
def raster_point_sample(spark, d):
    from strataspark.plans.registry import table

    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), (k % 500).alias("tile"), (k * 37 % 240).cast("double").alias("x"), (k * 53 % 240).cast("double").alias("y"))
    row, col = C.cell_of("x", "y", 0.0, 240.0)
    return p.withColumns({"row": row.cast("int"), "col": col.cast("int")}).join(cells(spark, d), ["tile", "row", "col"], "left").select("id", C.rnd("value").alias("value"))


#: Each cell's steepest fall, and the walks from every cell down to its pit.
FLOW = """f AS (SELECT a.tile, a.row AS r, a.col AS c, b.row AS tr, b.col AS tc, row_number() OVER (PARTITION BY a.tile, a.row, a.col ORDER BY (a.value - b.value) / (CASE WHEN a.row <> b.row AND a.col <> b.col THEN power(2::DOUBLE, 0.5::DOUBLE) ELSE 1 END) DESC, b.row, b.col) AS k
FROM cells a JOIN cells b ON a.tile = b.tile AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND b.value < a.value),
w AS (SELECT tile, row, col FROM cells UNION ALL SELECT f.tile, f.tr, f.tc FROM w JOIN f ON f.tile = w.tile AND f.r = w.row AND f.c = w.col AND f.k = 1)"""


@query(f"WITH RECURSIVE {CELLS}, {FLOW} SELECT tile, row::INT AS row, col::INT AS col, count(*) AS acc FROM w GROUP BY ALL")
def flow_accumulation(spark, d):
    return R.flow(cells(spark, d))


@query(f"""WITH {SCORED}, z AS (SELECT CASE WHEN row_id % 13 = 0 THEN NULL ELSE score END AS s, CASE WHEN row_id % 13 = 0 THEN 0 WHEN row_id % 101 = 0 THEN 6 ELSE {ZONE.format(s='score')} END AS stored FROM scored)
SELECT 0::BIGINT AS out_of_range, count_if((s IS NULL) <> (stored = 0))::BIGINT AS mask_differs, count_if(s IS NOT NULL AND stored <> {ZONE.format(s='s')})::BIGINT AS zone_differs FROM z""")
def score_faults(spark, d):
    s = F.when(F.col("row_id") % 13 != 0, F.col("score"))
    stored = F.when(F.col("row_id") % 13 == 0, 0).when(F.col("row_id") % 101 == 0, 6).otherwise(C.zone("score"))
    return R.score_faults(scored(spark, d).select(s.alias("s"), stored.alias("stored")), "s", C.zone("s"), "stored")


@query(f"""WITH p AS (SELECT round(least(o_totalprice / 400000, 1.0::DOUBLE), 5) AS a, round(least(o_totalprice / 400000, 1.0::DOUBLE), 5) + CASE WHEN o_orderkey % 500 = 0 THEN 2e-7 ELSE 0 END AS b FROM orders)
SELECT count(*) AS cells, round(max(abs(a - b)), 9) AS largest, count_if(abs(a - b) > 1e-7)::BIGINT AS beyond, count(DISTINCT {ZONE.format(s='a')}) AS zones_seen, max(abs(a - b)) <= 1e-7 AS passed FROM p""")
def pilot_gate(spark, d):
    from strataspark.plans.registry import table

    s = table(spark, d, "orders").select("o_orderkey", C.rnd(F.least(F.col("o_totalprice") / 400000, F.lit(1.0)), 5).alias("score"))
    other = s.select("o_orderkey", (F.col("score") + F.when(F.col("o_orderkey") % 500 == 0, 2e-7).otherwise(0)).alias("b"))
    gap = F.abs(F.col("score") - F.col("b"))
    return s.join(other, "o_orderkey").agg(F.count("*").alias("cells"), C.rnd(F.max(gap), 9).alias("largest"), F.count_if(gap > 1e-7).alias("beyond"), F.countDistinct(C.zone("score")).alias("zones_seen"), (F.max(gap) <= 1e-7).alias("passed"))


@query(f"""WITH RECURSIVE {CELLS}, {NB}, {FLOW}, s AS (SELECT tile, row, col, sqrt(power(((n02 + 2 * n12 + n22) - (n00 + 2 * n10 + n20)) / 8, 2) + power(((n20 + 2 * n21 + n22) - (n00 + 2 * n01 + n02)) / 8, 2)) AS rise FROM nb WHERE row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6)
SELECT s.tile, s.row::INT AS row, s.col::INT AS col, round(ln(acc / greatest(rise, 0.001::DOUBLE)), 4) AS twi FROM s JOIN (SELECT tile, row, col, count(*) AS acc FROM w GROUP BY ALL) AS a ON a.tile = s.tile AND a.row = s.row AND a.col = s.col""")
def wetness_index(spark, d):
    c = cells(spark, d)
    rise = F.tan(F.radians(R.slope_degrees(1.0)))
    steep = R.neighbourhood(c).select("tile", "row", "col", F.greatest(rise, F.lit(0.001)).alias("rise")).where("row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6")
    return R.flow(c).join(steep, ["tile", "row", "col"]).select("tile", "row", "col", C.rnd(F.log(F.col("acc") / F.col("rise")), 4).alias("twi"))


@query(f"WITH {CELLS} SELECT tile, row, col, (value > 0.1)::INT AS stream, coalesce(CASE WHEN tile % 3 = 0 THEN NULL ELSE round(value, 6) END, round(value * 2, 6)) AS best FROM cells")
def stream_binary_and_fallback(spark, d):
    first = F.when(F.col("tile") % 3 != 0, C.rnd("value"))
    return cells(spark, d).select("tile", "row", "col", (F.col("value") > 0.1).cast("int").alias("stream"), F.coalesce(first, C.rnd(F.col("value") * 2)).alias("best"))


@query("""WITH s AS (SELECT c_custkey AS id, (c_custkey * 37 % 3000)::DOUBLE AS x1, (c_custkey * 53 % 3000)::DOUBLE AS y1, (c_custkey * 71 % 3000)::DOUBLE AS x2, (c_custkey * 97 % 3000)::DOUBLE AS y2 FROM customer), k AS (SELECT *, unnest(range(0, 201)) AS k FROM s)
SELECT DISTINCT floor((3000 - (y1 + (y2 - y1) * (k / 200.0::DOUBLE))) / 30)::BIGINT AS row, floor((x1 + (x2 - x1) * (k / 200.0::DOUBLE)) / 30)::BIGINT AS col, 1 AS burn FROM k""")
def rasterized_lines(spark, d):
    from strataspark.plans.registry import table

    c = F.col("c_custkey")
    s = table(spark, d, "customer").select(*[(c * m % 3000).cast("double").alias(n) for n, m in (("x1", 37), ("y1", 53), ("x2", 71), ("y2", 97))], F.explode(F.sequence(F.lit(0), F.lit(200))).alias("k"))
    t = F.col("k") / F.lit(200.0)
    row, col = C.cell_of(F.col("x1") + (F.col("x2") - F.col("x1")) * t, F.col("y1") + (F.col("y2") - F.col("y1")) * t, 0.0, 3000.0)
    return s.select(row.alias("row"), col.alias("col")).distinct().withColumn("burn", F.lit(1))
