"""A synthetic terrain table, every value from hashes of the row number, so that it is the same on any number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.columns import bump, clip, independent_uniform, rnd
from strataspark.operators.ordered import running_sum
from strataspark.operators.prep import bisect_intercept

SOILS, COVERS = ("Cambisol", "Leptosol", "Luvisol", "Regosol"), ("Tree cover", "Grassland", "Cropland", "Bare", "Water")


def pool(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n rows over four belts of height, with slope, aspect, rainfall, distances, soil and cover."""
    u = lambda k: independent_uniform("id", seed + 101 * k)
    belt = F.floor(u(1) * 4).cast("int")
    slope = clip(8 + belt * 7 + (u(2) - 0.5) * 30, 0.0, 75.0)
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.floor(u(k) * len(names)) + 1).cast("int"))
    x = spark.range(n).select("id", belt.alias("belt"), rnd(slope, 2).alias("slope"), rnd(400 + belt * 900 + u(3) * 900, 1).alias("elevation"), rnd(u(4) * 360, 1).alias("_aspect"), rnd(2200 - belt * 350 + (u(5) - 0.5) * 600, 1).alias("rainfall"), rnd(u(6) * 3000, 1).alias("dist_roads"), rnd(u(7) * 1500, 1).alias("dist_streams"), pick(SOILS, 8).alias("soil_type"), pick(COVERS, 9).alias("lulc"))
    return x.withColumn("aspect", F.when(F.col("slope") < 1, -1.0).otherwise(F.col("_aspect"))).drop("_aspect")


def risk_logit():
    """What makes a row likelier: middling slopes, rain, nearness to roads and streams."""
    return 3.0 * bump("slope", 35.0, 12.0) + F.col("rainfall") / 1000.0 - F.col("dist_roads") / 900.0 - F.col("dist_streams") / 700.0 + F.when(F.col("lulc") == "Tree cover", -0.8).otherwise(0.0)


def terrain(spark: SparkSession, positives: int = 1200, negatives: int = 2400, n: int = 60_000, prevalence: float = 0.1, missing: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """A labelled sample of the pool: labels by weighted coins whose intercept gives the prevalence, rows by hash order within the classes, some values taken away.

    missing: share of nulls by column."""
    x = pool(spark, n, seed)
    a = bisect_intercept(x, risk_logit(), prevalence)
    p = 1.0 / (1.0 + F.exp(-(risk_logit() + F.lit(a))))
    x = x.withColumn("label", (independent_uniform("id", seed + 5003) < p).cast("int")).withColumns({"_h": F.xxhash64(F.lit(seed + 7001), "id"), "_one": F.lit(1)})
    x = running_sum(x, "_h", {"_one": "_rank"}, by=["label"]).where(F.col("_rank") <= F.when(F.col("label") == 1, positives).otherwise(negatives)).drop("_h", "_one", "_rank")
    for k, (c, share) in enumerate((missing or {"rainfall": 0.005, "soil_type": 0.015}).items()):
        x = x.withColumn(c, F.when(independent_uniform("id", seed + 9001 + 77 * k) >= share, F.col(c)))
    return x
