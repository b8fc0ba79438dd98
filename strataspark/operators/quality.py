"""Rules on data quality, each a few rows of findings: (rule, column, value, severity). One pass counts for all rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.columns import pearson, rnd


def findings(df: DataFrame, columns: list[str], label: str, domains: dict[str, tuple[float, float]], few: int = 10, high: float = 0.8) -> DataFrame:
    """Class balance; columns with missing or impossible values, one value, or few (2 to few); pairs that correlate at least at high."""
    y = F.col(label)
    aggs = [F.avg((y == 1).cast("double")).alias("_balance")]
    for c in columns:
        lo, hi = domains.get(c, (float("-inf"), float("inf")))
        aggs.append(F.struct(F.avg(F.col(c).isNull().cast("double")).alias("gone"), F.count_if((F.col(c) < lo) | (F.col(c) > hi)).cast("double").alias("bad"), F.approx_count_distinct(c).alias("about")).alias(c))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs += [pearson(a, b).alias(f"{a}~{b}") for a, b in pairs]
    r = df.agg(*aggs)
    # exact distinct counts only for columns that an estimate shows to have few values
    about = r.select(*[F.col(f"{c}.about").alias(c) for c in columns]).first()
    narrow = [c for c in columns if about[c] <= 2 * few]
    distinct = df.agg(*[F.countDistinct(c).cast("double").alias(f"_d_{c}") for c in narrow]) if narrow else df.sparkSession.range(1).drop("id")
    one = r.join(F.broadcast(distinct)) if narrow else r
    rows = [(F.lit("balance"), label, F.col("_balance"), "info", F.lit(True))]
    for c in columns:
        rows += [(F.lit("missing"), c, F.col(f"{c}.gone"), "warn", F.col(f"{c}.gone") > 0), (F.lit("impossible"), c, F.col(f"{c}.bad"), "fail", F.col(f"{c}.bad") > 0)]
        if c in narrow:
            n = F.col(f"_d_{c}")
            rows += [(F.lit("constant"), c, n, "warn", n <= 1), (F.lit("low_cardinality"), c, n, "info", (n > 1) & (n <= few))]
    rows += [(F.lit("high_correlation"), f"{a}~{b}", F.abs(F.col(f"`{a}~{b}`")), "warn", F.abs(F.col(f"`{a}~{b}`")) >= high) for a, b in pairs]
    found = F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.struct(rule.alias("rule"), F.lit(c).alias("column"), rnd(v).alias("value"), F.lit(s).alias("severity"))) for rule, c, v, s, hit in rows])
    return one.select(F.explode(F.array_compact(found)).alias("x")).select("x.*")


def audit_rollup(rows: DataFrame) -> DataFrame:
    """Counts of OK, WARN and FAIL in each section, and the worst of them."""
    level = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    g = rows.groupBy("section").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "WARN", "FAIL")], F.max(level).alias("_l"))
    return g.select("section", "ok", "warn", "fail", F.element_at(F.array(*map(F.lit, ("OK", "WARN", "FAIL"))), F.col("_l") + 1).alias("worst"))


def first_difference(a: list[str], b: list[str]) -> int:
    """The first place where two feature lists differ, or -1."""
    return next((i for i in range(max(len(a), len(b))) if a[i : i + 1] != b[i : i + 1]), -1)


def only_own_dummy(df: DataFrame, value: str, dummies: dict[str, str]) -> DataFrame:
    """Rows where the dummies of a category aren't exactly the one of its value (all 0 for a value without one). dummies: column by value."""
    wrong = F.lit(False)
    for v, c in dummies.items():
        wrong |= F.col(f"`{c}`") != (F.col(value).eqNullSafe(F.lit(v))).cast("double")
    return df.where(wrong)


def header_faults(header: DataFrame, cells: DataFrame, cell_m: float = 30.0) -> DataFrame:
    """What a product's stored zone table (zone, cells, area_km2, share) gets wrong against its cells (zone): one row per wrong value."""
    from strataspark.functions.columns import cells_km2

    now = cells.groupBy("zone").agg(F.count("*").alias("n"))
    scored = cells.agg(F.count_if(F.col("zone") > 0).alias("scored"))
    x = header.join(now, "zone", "full").join(F.broadcast(scored))
    n = F.coalesce("n", F.lit(0))
    checks = {"cells": ~F.col("cells").eqNullSafe(n), "area": F.coalesce(F.abs(F.col("area_km2") - cells_km2(n, cell_m)) > 1e-6, F.lit(True)), "share": (F.col("zone") > 0) & F.coalesce(F.abs(F.col("share") - n / F.col("scored")) > 1e-6, F.lit(True))}
    return x.select("zone", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()]))).alias("fault"))
