"""Point, cell and score tables derived from the star schema by whole-number arithmetic, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.columns import rnd, sigmoid
from strataspark.plans.registry import table

SPAN = 100_000


def points(spark: SparkSession, d: str) -> DataFrame:
    """Customers as points (id, x, y, label) in a square of SPAN metres."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (k * 7919 % SPAN).alias("x"), (k * 104729 % SPAN).alias("y"), (k % 3 == 0).cast("int").alias("label"), F.col("c_nationkey").alias("group"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as points (sid, sx, sy)."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("sid"), (k * 6101 % SPAN).alias("sx"), (k * 9973 % SPAN).alias("sy"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Line items as predictions: row_id, label (returned or not), score, quantity."""
    q, disc, tax = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax"))
    x = (q - F.lit(25.0)) / F.lit(10.0) + (disc - F.lit(0.05)) * F.lit(20.0) - (tax - F.lit(0.04)) * F.lit(10.0)
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        rnd(sigmoid(x), 5).alias("score"), q.alias("quantity"), F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("partkey"), F.col("l_extendedprice").alias("price"), disc.alias("discount"), tax.alias("tax"),
    )


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 x 8 rasters: tile, row, col, value."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("tile"), "label", F.posexplode("embedding").alias("p", "v"))
    return e.select("tile", F.col("label").alias("band"), F.expr("p div 8").cast("int").alias("row"), (F.col("p") % 8).alias("col"), F.col("v").cast("double").alias("value"))


POINTS = f"points AS (SELECT c_custkey AS id, c_custkey * 7919 % {SPAN} AS x, c_custkey * 104729 % {SPAN} AS y, (c_custkey % 3 = 0)::INT AS label, c_nationkey AS \"group\" FROM customer)"
SITES = f"sites AS (SELECT s_suppkey AS sid, s_suppkey * 6101 % {SPAN} AS sx, s_suppkey * 9973 % {SPAN} AS sy FROM supplier)"
SCORED = """scored AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, (l_returnflag = 'R')::INT AS label,
  round(1.0::DOUBLE / (1.0::DOUBLE + exp(-((l_quantity - 25.0::DOUBLE) / 10.0::DOUBLE + (l_discount - 0.05::DOUBLE) * 20.0::DOUBLE - (l_tax - 0.04::DOUBLE) * 10.0::DOUBLE))), 5) AS score,
  l_quantity AS quantity, l_suppkey AS suppkey, l_partkey AS partkey, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem)"""
CELLS = """cells AS (SELECT tile, band, (p - 1) // 8 AS row, (p - 1) % 8 AS col, v::DOUBLE AS value FROM
  (SELECT vec_id AS tile, label AS band, unnest(range(1, 65)) AS p, unnest(embedding) AS v FROM embeddings))"""
#: Zone of a score column s.
ZONE = "(CASE WHEN {s} IS NULL THEN 0 ELSE 1 + ({s}::FLOAT::DOUBLE >= 0.2::DOUBLE)::INT + ({s}::FLOAT::DOUBLE >= 0.4::DOUBLE)::INT + ({s}::FLOAT::DOUBLE >= 0.6::DOUBLE)::INT + ({s}::FLOAT::DOUBLE >= 0.8::DOUBLE)::INT END)"
