"""Running sums and ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the order column is cut into for a running sum: at least, at most, and rows for each in between.
MIN_RANGES, MAX_RANGES, RANGE_ROWS = 64, 1024, 200_000


def range_edges(df: DataFrame, order: str, ranges: int | None = None) -> list[float]:
    """Approximate quantiles that cut a numeric column into ranges, as many as the rows ask for; one job gives both."""
    head = df.agg(F.count(order).alias("n"), F.approx_percentile(F.col(order).cast("double"), [k / MAX_RANGES for k in range(1, MAX_RANGES)], 10 * MAX_RANGES).alias("q")).first()
    wanted = ranges or min(MAX_RANGES, max(MIN_RANGES, head.n // RANGE_ROWS))
    return sorted({head.q[k * MAX_RANGES // wanted - 1] for k in range(1, wanted)}) if head.n else []


def running_sum(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, by: list[str] | None = None, ranges: int | None = None, tie: str | None = None) -> DataFrame:
    """df with running sums in the order of a numeric column (in each group of by). Its values must be unique, or be made so by tie.

    The column is cut at approximate quantiles into ranges. Sums run inside ranges, in parallel, and start from
    the totals of the ranges before, a table of at most MAX_RANGES rows for each group."""
    by = by or []
    edges = range_edges(df, order, ranges)
    x = df.withColumn("_order", F.col(order).cast("double"))
    if edges:
        x = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="_order", outputCol="_range").transform(x).drop("_order")
    else:
        x = x.drop("_order").withColumn("_range", F.lit(0.0))
    key = F.col(order).desc() if descending else F.col(order).asc()
    rkey = F.col("_range").desc() if descending else F.col("_range").asc()
    totals = x.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy(rkey).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(key, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    out = x.join(starts, [*by, "_range"])
    out = out.select("*", *[(F.sum(c).over(inside) + F.col(f"_s_{c}")).alias(name) for c, name in sums.items()])
    return out.drop("_range", *[f"_s_{c}" for c in sums])


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with a number from 0 for each distinct numeric key, in key order."""
    ids = running_sum(df.select(key).distinct().withColumn("_one", F.lit(1)), key, {"_one": name})
    return df.join(ids.select(key, (F.col(name) - 1).alias(name)), key)


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of an order: each task keeps n rows, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)
