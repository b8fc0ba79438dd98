"""Group folds, memberships, their proofs, and summaries over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.columns import rnd

#: Groups that the driver deals out.
MAX_GROUPS = 200_000


def group_folds(df: DataFrame, group: str, label: str, k: int) -> DataFrame:
    """(group, fold): folds of whole groups with like class shares. Groups go by falling spread of their class counts, then id, each to the fold
    that keeps the folds' class shares most even, then to the smallest fold, then the first. The driver has two counts per group, of at most MAX_GROUPS."""
    rows = df.groupBy(group).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    total = (max(1, sum(r.n0 for r in rows)), max(1, sum(r.n1 for r in rows)))
    held, out = [[0, 0] for _ in range(k)], []
    for r in sorted(rows, key=lambda r: (-abs(r.n0 - r.n1), r[group])):
        def uneven(f, r=r):
            spread = 0.0
            for c, n in ((0, r.n0), (1, r.n1)):
                shares = [(held[j][c] + (n if j == f else 0)) / total[c] for j in range(k)]
                mean = sum(shares) / k
                spread += (sum((s - mean) ** 2 for s in shares) / k) ** 0.5
            return round(spread / 2, 12), sum(held[f]), f

        f = min(range(k), key=uneven)
        held[f][0] += r.n0
        held[f][1] += r.n1
        out.append((r[group], f))
    kind = dict(df.dtypes)[group]
    return df.sparkSession.createDataFrame(out, f"`{group}` {kind}, fold int")


def memberships(df: DataFrame, key: str, folds: int) -> DataFrame:
    """(outer_fold, key, role): each row is test in its own fold and train in the others. df has fold."""
    return df.select(key, "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("outer_fold")).select("outer_fold", key, F.when(F.col("fold") == F.col("outer_fold"), "test").otherwise("train").alias("role"))


def nested_memberships(df: DataFrame, key: str, outer: int, inner: int) -> DataFrame:
    """(outer_fold, inner_fold, key, role) of the inner folds, which split each outer fold's train rows. df has fold and inner."""
    train = df.select(key, "fold", "inner", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("outer_fold")).where("fold <> outer_fold")
    return train.select("outer_fold", key, "inner", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))).alias("inner_fold")).select("outer_fold", "inner_fold", key, F.when(F.col("inner") == F.col("inner_fold"), "validation").otherwise("train").alias("role"))


def buffered(members: DataFrame, points: DataFrame, key: str, r: float) -> DataFrame:
    """members with role removed for train rows within r of one of the same fold's test points. points is (key, x, y)."""
    x = members.join(points, key)
    cell = lambda c: F.floor(F.col(c) / F.lit(float(r))).cast("long")
    around = lambda: F.explode(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]))
    test = x.where("role = 'test'").select("outer_fold", F.col("x").alias("tx"), F.col("y").alias("ty"), cell("x").alias("_i"), cell("y").alias("_j"))
    test = test.select("*", around().alias("_a")).select("*", around().alias("_b")).select("outer_fold", "tx", "ty", (F.col("_i") + F.col("_a")).alias("gx"), (F.col("_j") + F.col("_b")).alias("gy"))
    train = x.where("role = 'train'").withColumns({"gx": cell("x"), "gy": cell("y")})
    near = (train["outer_fold"] == test["outer_fold"]) & (train["gx"] == test["gx"]) & (train["gy"] == test["gy"]) & (F.pow(train["x"] - test["tx"], 2) + F.pow(train["y"] - test["ty"], 2) <= r * r)
    out = train.join(test, near, "left_semi").select("outer_fold", key).withColumn("_out", F.lit(True))
    return members.join(out, ["outer_fold", key], "left").withColumn("role", F.when(F.col("_out"), "removed").otherwise(F.col("role"))).drop("_out")


def partition_faults(members: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """(outer_fold, repeated, lost, extra): rows with two roles, rows of the universe without one, and strangers. All 0 if each fold is a partition."""
    n = F.broadcast(universe.agg(F.count("*").alias("_n")))
    g = members.groupBy("outer_fold", key).agg(F.count("*").alias("c")).join(universe.select(key, F.lit(1).alias("_u")), key, "left")
    f = g.groupBy("outer_fold").agg(F.count_if(F.col("c") > 1).alias("repeated"), F.count("_u").alias("known"), F.count_if(F.col("_u").isNull()).alias("extra"))
    return f.join(n).select("outer_fold", "repeated", (F.col("_n") - F.col("known")).alias("lost"), "extra")


def split_faults(members: DataFrame, facts: DataFrame, key: str, group: str, event: str, label: str, least: int = 1) -> DataFrame:
    """(outer_fold, groups, cells, events, too_few): groups, raster cells (row, col) and events on both sides of a split, and whether a class has fewer than
    least train rows or no test row. All are 0 or false for a sound split. Blank events don't count; removed rows are on neither side."""
    x = members.where("role IN ('train', 'test')").join(facts, key)
    train = F.col("role") == "train"

    def crossing(name: str, *columns) -> DataFrame:
        g = x.groupBy("outer_fold", F.struct(*columns).alias("_v")).agg(F.count_if(train).alias("a"), F.count_if(~train).alias("b"))
        return g.groupBy("outer_fold").agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias(name))

    said = F.nullif(F.trim(F.col(event).cast("string")), F.lit(""))
    one = x.groupBy("outer_fold", said.alias("_v")).agg(F.count_if(train).alias("a"), F.count_if(~train).alias("b")).groupBy("outer_fold").agg(F.count_if(F.col("_v").isNotNull() & (F.col("a") > 0) & (F.col("b") > 0)).alias("events"))
    seen = lambda side, y: F.count_if(side & (F.col(label) == y))
    few = x.groupBy("outer_fold").agg(((F.least(seen(train, 0), seen(train, 1)) < least) | (F.least(seen(~train, 0), seen(~train, 1)) == 0)).alias("too_few"))
    return crossing("groups", group).join(crossing("cells", "row", "col"), "outer_fold").join(one, "outer_fold").join(few, "outer_fold")


def least_distances(members: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """(outer_fold, least): the smallest distance between a test and a train point of each fold. points is (key, x, y)."""
    from strataspark.operators.spatial import nearest

    out = None
    for fold in [r.outer_fold for r in members.select("outer_fold").distinct().orderBy("outer_fold").collect()]:
        x = members.where(F.col("outer_fold") == fold).join(points, key)
        test = x.where("role = 'test'").select(F.col(key).alias("id"), "x", "y")
        train = x.where("role = 'train'").select(F.col(key).alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"))
        one = nearest(test, train).agg(F.min("dist").alias("least")).select(F.lit(fold).alias("outer_fold"), "least")
        out = one if out is None else out.unionByName(one)
    return out


def coverage_faults(members: DataFrame, key: str) -> DataFrame:
    """Rows that aren't test in exactly one fold."""
    return members.groupBy(key).agg(F.count_if(F.col("role") == "test").alias("tests")).where("tests <> 1")


def series(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sample deviation, least and largest of each metric over a series of folds."""
    long = df.unpivot(keys, metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.count("value").alias("n"), rnd(F.avg("value")).alias("mean"), rnd(F.stddev_samp("value")).alias("sd"), rnd(F.min("value")).alias("min"), rnd(F.max("value")).alias("max"))


def difference(df: DataFrame, keys: list[str], split: str, a: str, b: str, value: str) -> DataFrame:
    """Mean of a value at a less that at b, for each key."""
    p = df.groupBy(*keys).pivot(split, [a, b]).agg(F.avg(value))
    return p.select(*keys, rnd(F.col(f"`{a}`") - F.col(f"`{b}`")).alias("difference"))


def summary_faults(folds: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Folds whose stored accuracy or recall isn't what their counts give, and keys that come twice."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    off = (F.abs(F.col("accuracy") - (F.col("tp") + F.col("tn")) / n) > tolerance) | (F.abs(F.col("recall") - F.try_divide(F.col("tp") * 1.0, F.col("tp") + F.col("fn"))) > tolerance)
    wrong = folds.where(off).select("model", "fold", F.lit("metric").alias("fault"))
    twice = folds.groupBy("model", "fold").agg(F.count("*").alias("c")).where("c > 1").select("model", "fold", F.lit("repeated").alias("fault"))
    return wrong.unionByName(twice)
