"""Aggregates, comparisons and set operators on attribute tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.columns import pearson, rnd


def long_form(df: DataFrame, keys: list[str], columns: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """Wide to long; columns must share a type."""
    return df.unpivot(keys, columns, name, value)


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing count and percent of each column, in one pass."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    out = counts.unpivot(["n"], columns, "column", "n_missing")
    return out.select("column", "n_missing", rnd(F.try_divide(F.col("n_missing") * 100.0, F.col("n")), 4).alias("pct_missing"))


def missing_by_class(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    counts = df.groupBy(by).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([by], columns, "column", "n_missing")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Counts of 0 and 1, their ratio and the percent of 1; null where there is nothing to divide by."""
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(F.count("*").alias("n"), neg.alias("negatives"), pos.alias("positives")).select("*", rnd(F.try_divide(F.col("negatives") * 1.0, F.col("positives"))).alias("ratio"), rnd(F.try_divide(F.col("positives") * 100.0, F.col("n"))).alias("pct_positive"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts of values and their shares. The total is joined, so no window gathers all rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select(column, "n", rnd(F.col("n") / F.col("total")).alias("share"))


def rate_by_class(df: DataFrame, column: str, label: str) -> DataFrame:
    """Mean of a 0/1 label in each class; pure: all rows have one label."""
    out = df.groupBy(column).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))
    return out.select(column, "n", rnd("rate").alias("rate"), F.col("rate").isin(0.0, 1.0).alias("pure"))


def correlations(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Pearson correlation of each column with a label on rows where both are known, and the class means."""
    aggs = []
    for c in columns:
        both = F.col(c).isNotNull() & F.col(label).isNotNull()
        x, y = (F.when(both, F.col(v).cast("double")) for v in (c, label))
        aggs.append(F.struct(pearson(x, y).alias("r"), F.avg(F.when(F.col(label) == 0, x)).alias("mean0"), F.avg(F.when(F.col(label) == 1, x)).alias("mean1"), F.count(x).alias("n")).alias(c))
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns]))
    return one.select(rows.alias("x")).select("x.column", rnd("x.s.r").alias("r"), rnd("x.s.mean0", 4).alias("mean_0"), rnd("x.s.mean1", 4).alias("mean_1"), F.col("x.s.n").alias("n"))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of each pair of columns (the upper triangle), in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs]))
    return one.select(rows.alias("x")).select("x.a", "x.b", rnd("x.r").alias("r"))


def midranks(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """df's distinct values of a column with their average ranks, from counts per value."""
    from strataspark.operators.ordered import running_sum

    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return running_sum(counts, column, {"n": "upto"}).select(column, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias("midrank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with ties at their average rank."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranks = known.join(midranks(known, a).withColumnRenamed("midrank", "_ra"), a).join(midranks(known, b).withColumnRenamed("midrank", "_rb"), b)
    return ranks.agg(rnd(pearson("_ra", "_rb")).alias("rho"), F.count("*").alias("n"))


def explained_by_category(df: DataFrame, value: str, category: str) -> DataFrame:
    """Share of a number's variance that a category explains: between over total sum of squares."""
    g = df.where(F.col(value).isNotNull()).groupBy(category).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = g.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_mean"))
    x = g.join(F.broadcast(total))
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("_mean"), 2))
    return x.agg(rnd(F.try_divide(between, between + F.sum(F.col("n") * F.col("v")))).alias("r2"))


def quantiles(df: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.0, 0.05, 0.5, 0.95, 1.0)) -> DataFrame:
    """Exact quantiles by linear interpolation."""
    q = df.groupBy(by).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("q"))
    return q.select(by, *[rnd(F.col("q")[k]).alias(f"q{round(100 * s):02d}") for k, s in enumerate(shares)])


def mode_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest non-null value of each group, ties to the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value))).alias("mode"), F.max("n").alias("n"))


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first of each set of equal rows; nulls equal each other."""
    return df.groupBy(*columns).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))


def keep_first(df: DataFrame, keys: list[str], attributes: list[str], order: list[str]) -> DataFrame:
    """Of rows that share keys and agree in attributes the first; none of rows that share keys but disagree."""
    g = Window.partitionBy(*keys)
    same = F.size(F.collect_set(F.struct(*[F.coalesce(F.col(a).cast("string"), F.lit("\0")) for a in attributes])).over(g)) == 1
    return df.withColumn("_same", same).withColumn("_n", F.row_number().over(g.orderBy(*order))).where("_same AND _n = 1").drop("_same", "_n")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def out_of_range_share(df: DataFrame, profile: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows outside each column's known range. profile is one row: c_min and c_max for each column c."""
    x = df.join(F.broadcast(profile))
    one = x.agg(*[rnd(F.avg(((F.col(c) < F.col(f"{c}_min")) | (F.col(c) > F.col(f"{c}_max"))).cast("double"))).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "share")


def training_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in columns for f in (F.min, F.max)])


def compare_tables(left: DataFrame, right: DataFrame, keys: list[str], exact: list[str], close: dict[str, float]) -> DataFrame:
    """Differences of two keyed tables by column: rows on one side only, and values that differ (numbers beyond a tolerance)."""
    a, b = left.withColumn("_l", F.lit(1)).alias("a"), right.withColumn("_r", F.lit(1)).alias("b")
    j = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    checks = {c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in exact}
    checks |= {c: ~(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) | F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tol, F.lit(False))) for c, tol in close.items()}
    one = j.agg(F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), *[F.count_if(both & x).alias(c) for c, x in checks.items()])
    return one.unpivot([], ["left_only", "right_only", *checks], "check", "n")


def unknown_codes(df: DataFrame, code: str, legend: DataFrame) -> DataFrame:
    """Codes that the legend lacks, with their rows."""
    return df.where(F.col(code).isNotNull()).join(legend, code, "left_anti").groupBy(code).agg(F.count("*").alias("n"))


def lookup(df: DataFrame, key: str, table: DataFrame, value: str, default=None) -> DataFrame:
    """A left join to a table with unique keys; null values become the default."""
    out = df.join(table.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def set_differences(needed: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of two sets and where they are: present, missing or extra."""
    cols = needed.columns
    a, b = needed.distinct().withColumn("_a", F.lit(True)), present.select(*cols).distinct().withColumn("_b", F.lit(True))
    status = F.when(F.col("_a") & F.col("_b"), "present").when(F.col("_a"), "missing").otherwise("extra")
    return a.join(b, cols, "full").select(*cols, status.alias("status"))


def aligned(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """For each frame: rows, distinct keys, and keys that the first frame lacks."""
    names = list(frames)
    base = frames[names[0]].select(key).distinct()
    out = []
    for n in names:
        f = frames[n].select(key)
        counts = f.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"))
        lost = f.distinct().join(base, key, "left_anti").agg(F.count("*").alias("foreign"))
        out.append(counts.join(F.broadcast(lost)).select(F.lit(n).alias("frame"), "rows", "keys", "foreign"))
    return union_all(out)
