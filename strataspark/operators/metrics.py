"""Exact threshold and ranking metrics. Rows are counted per distinct score first, so what is ordered is the histogram."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.columns import rnd
from strataspark.operators.ordered import running_sum


def histogram(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """(by, score, p, n): positives and rows of each score."""
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*(by or []), F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))


def _totals(h: DataFrame, by: list[str]) -> DataFrame:
    return h.groupBy(*by).agg(F.sum("p").alias("pos"), (F.sum("n") - F.sum("p")).alias("neg"))


def _with_totals(h: DataFrame, by: list[str]) -> DataFrame:
    t = _totals(h, by)
    return h.join(t, by) if by else h.join(F.broadcast(t))


def curve(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """One row per threshold: tp and fp at scores >= it, with tpr, fpr and precision. Ties fall together."""
    by = by or []
    h = running_sum(histogram(df, score, label, by), "score", {"p": "tp", "n": "above"}, descending=True, by=by)
    x = _with_totals(h, by).withColumn("fp", F.col("above") - F.col("tp"))
    share = lambda a, b: F.try_divide(F.col(a) * 1.0, F.col(b))
    return x.select(*by, "score", "p", "n", "pos", "neg", "tp", "fp", share("tp", "pos").alias("tpr"), share("fp", "neg").alias("fpr"), share("tp", "above").alias("precision"))


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """(by, auc, pos, neg): the share of positive-negative pairs in the right order, ties half; null with one class only."""
    by = by or []
    h = running_sum(histogram(df, score, label, by), "score", {"n": "upto", "p": "p_upto"}, by=by)
    neg_below = (F.col("upto") - F.col("n")) - (F.col("p_upto") - F.col("p"))
    won = F.sum(F.col("p") * (neg_below + 0.5 * (F.col("n") - F.col("p"))))
    g = h.groupBy(*by).agg(won.alias("won"), F.sum("p").alias("pos"), (F.sum("n") - F.sum("p")).alias("neg"))
    return g.select(*by, F.try_divide(F.col("won").cast("double"), F.col("pos") * F.col("neg")).alias("auc"), "pos", "neg")


def average_precision(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Sum over thresholds of the recall gained times the precision there."""
    by = by or []
    c = curve(df, score, label, by)
    return c.groupBy(*by).agg(F.sum(F.try_divide(F.col("p") * 1.0, F.col("pos")) * F.col("precision")).alias("ap"))


def youden(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, j): the highest threshold where tpr - fpr is largest; infinite with j 0 if none is above 0."""
    c = curve(df, score, label).select("score", F.coalesce(F.col("tpr") - F.col("fpr"), F.lit(0.0)).alias("j"))
    best = c.agg(F.max_by("score", F.struct("j", "score")).alias("t"), F.max("j").alias("j"))
    good = F.coalesce(F.col("j") > 0, F.lit(False))
    return best.select(F.when(good, F.col("t")).otherwise(float("inf")).alias("threshold"), F.when(good, F.col("j")).otherwise(0.0).alias("j"))


def youden_out_of_fold(df: DataFrame, score: str, label: str, key: str, origin: str, allowed: str) -> DataFrame:
    """The largest score with j within 1e-12 of the largest. Rows must be unique by key and all of the allowed origin."""
    bad = df.agg((F.count("*") - F.countDistinct(key)).alias("dup"), F.count_if(~F.col(origin).eqNullSafe(F.lit(allowed))).alias("foreign")).first()
    if bad.dup or bad.foreign:
        raise ValueError(f"{bad.dup} repeated and {bad.foreign} foreign rows")
    c = curve(df, score, label).select("score", (F.col("tpr") - F.col("fpr")).alias("j"))
    return c.join(F.broadcast(c.agg(F.max("j").alias("m")))).where(F.col("j") >= F.col("m") - 1e-12).agg(F.max("score").alias("threshold"))


def confusion(df: DataFrame, positive: Column, label: str, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Counts and metrics of predictions; a metric with nothing to divide by is 0."""
    y = F.col(label) == 1
    g = df.groupBy(*(by or [])).agg(F.count_if(positive & y).alias("tp"), F.count_if(positive & ~y).alias("fp"), F.count_if(~positive & y).alias("fn"), F.count_if(~positive & ~y).alias("tn"))
    d = lambda a, b: F.coalesce(F.try_divide(a * 1.0, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall, spec = d(tp, tp + fp), d(tp, tp + fn), d(tn, tn + fp)
    return g.select("*", rnd(d(tp + tn, tp + fp + fn + tn), digits).alias("accuracy"), rnd(precision, digits).alias("precision"), rnd(recall, digits).alias("recall"), rnd(d(2 * tp, 2 * tp + fp + fn), digits).alias("f1"), rnd(spec, digits).alias("specificity"), rnd((recall + spec) / 2, digits).alias("balanced_accuracy"))


def report(df: DataFrame, predicted: Column, label: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, then their plain and their weighted mean."""
    y = F.col(label)
    x = df.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), y.alias("y"), predicted.cast("int").alias("p")).groupBy("class").agg(F.count_if((F.col("p") == F.col("class")) & (F.col("y") == F.col("class"))).alias("tp"), F.count_if(F.col("p") == F.col("class")).alias("said"), F.count_if(F.col("y") == F.col("class")).alias("support"))
    d = lambda a, b: F.coalesce(F.try_divide(a * 1.0, b), F.lit(0.0))
    m = x.select(F.col("class").cast("string").alias("name"), d(F.col("tp"), F.col("said")).alias("precision"), d(F.col("tp"), F.col("support")).alias("recall"), d(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support")
    cols = ("precision", "recall", "f1")
    macro = m.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support")).select(F.lit("macro").alias("name"), *cols, "support")
    weighted = m.agg(*[d(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols], F.sum("support").alias("support")).select(F.lit("weighted").alias("name"), *cols, "support")
    return m.unionByName(macro).unionByName(weighted).select("name", *[rnd(c, 4).alias(c) for c in cols], "support")


def poisson_weights(keys: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """How often each key's row is drawn in each round: independent Poisson(1) numbers, rows by rounds.

    A row's draws among n rows with replacement are Poisson(1) but for a dependence of 1/n; drawn so, they need no row numbers and no join."""
    x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, rounds + 1, dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    return np.searchsorted(POISSON, u.ravel(), side="right").reshape(u.shape)


#: Cumulative probabilities of a Poisson(1) number.
POISSON = np.cumsum([exp(-1) / factorial(k) for k in range(18)])
BOOT_ROWS = 512


def _boot_ranges(rounds: int, seed: int):
    """Rows of a range, sorted by model and score, to pairs won inside the range, positives and negatives, each for every round.

    Only sums are held, so a range, or a score that very many rows share, may be of any size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, model, score = TaskContext.get().partitionId(), None, None
        won = pos = below = p = n = np.zeros(rounds)

        def told():
            return pd.DataFrame({"place": [place], "model": [model], "won": [won + p * (below + 0.5 * n)], "pos": [pos + p], "neg": [below + n]})

        for batch in batches:
            for a in range(0, len(batch), BOOT_ROWS):
                part = batch.iloc[a : a + BOOT_ROWS]
                w, y = poisson_weights(part["key"].to_numpy(np.int64), rounds, seed), part["label"].to_numpy(bool)
                names, values = part["model"].to_numpy(), part["score"].to_numpy(float)
                starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (values[1:] != values[:-1])]))
                ties_p, ties_n = (np.add.reduceat(w * m[:, None], starts, axis=0) for m in (y, ~y))
                for at, tp, tn in zip(starts, ties_p, ties_n, strict=True):
                    if names[at] == model and values[at] == score:  # goes on from the rows before
                        p, n = p + tp, n + tn
                        continue
                    if model is not None and names[at] != model:
                        yield told()
                        won = pos = below = p = n = np.zeros(rounds)
                    won, pos, below = won + p * (below + 0.5 * n), pos + p, below + n
                    model, score, p, n = names[at], values[at], tp, tn
        if model is not None:
            yield told()

    return run


def bootstrap_auc(df: DataFrame, scores: list[str], label: str, rounds: int = 1000, seed: int = 42, key: str = "idx") -> DataFrame:
    """(round, auc of each score) for rounds that drew both classes. df has a unique integer key; all scores see the same draws.

    Rows are cut into ranges of the score; each range gives its sums for all rounds in one pass, and ranges are put together from these."""
    models = F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("score")) for s in scores])).alias("m")
    long = df.where(F.col(label).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label"), models).select("key", "label", "m.model", "m.score").where("score IS NOT NULL")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = long.repartitionByRange(parts, "model", "score").sortWithinPartitions("model", "score")
    sums = ranges.mapInPandas(_boot_ranges(rounds, seed), "place int, model string, won array<double>, pos array<double>, neg array<double>")
    each = sums.select("place", "model", F.posexplode(F.arrays_zip("won", "pos", "neg")).alias("round", "x")).select("place", "model", "round", "x.*")
    before = Window.partitionBy("model", "round").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("won", F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    a = each.groupBy("round", "model").agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return a.where("pos > 0 AND neg > 0").groupBy("round").pivot("model", scores).agg(F.first(F.col("won") / (F.col("pos") * F.col("neg"))))


def auc_gap_error(df: DataFrame, a: str, b: str | None, label: str, key: str) -> DataFrame:
    """(gap, se): the difference of two scores' AUCs (or a's alone), and its standard error by DeLong's components."""
    x = df.select(key, label, *{a, b or a})
    for s in {a, b or a}:
        c = curve(df, s, label).select(F.col("score").alias(s), ((F.col("neg") - F.col("fp") + 0.5 * (F.col("n") - F.col("p"))) / F.col("neg")).alias(f"_v10_{s}"), ((F.col("tp") - F.col("p") + 0.5 * F.col("p")) / F.col("pos")).alias(f"_v01_{s}"))
        x = x.join(c, s)
    d = lambda v: F.when(F.col(label) == int(v == "v10"), F.col(f"_{v}_{a}") - (F.col(f"_{v}_{b}") if b else F.lit(0.0)))
    one = x.select(d("v10").alias("v10"), d("v01").alias("v01"))
    g = one.agg(F.avg("v10").alias("gap"), F.sqrt(F.var_samp("v10") / F.count("v10") + F.var_samp("v01") / F.count("v01")).alias("se"))
    return g.select("gap", "se")


def interval(df: DataFrame, value: Column) -> DataFrame:
    """Mean, 2.5 and 97.5 percent quantiles of a value over rounds, and whether 0 lies outside."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    g = df.agg(F.count("*").alias("rounds"), F.avg(value).alias("mean"), q.alias("q"))
    return g.select("rounds", rnd("mean").alias("mean"), rnd(F.col("q")[0]).alias("low"), rnd(F.col("q")[1]).alias("high"), ((F.col("q")[0] > 0) | (F.col("q")[1] < 0)).alias("separable"))


def subsets(df: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Each row once for every (overlapping) subset that holds it."""
    return df.withColumn("subset", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in groups.items()]))))


def winner(metrics: DataFrame, model: str, value: str, close: float = 1e-4) -> DataFrame:
    """The best model, the runner-up, and whether their gap is too small to call."""
    top = metrics.orderBy(F.desc(value), model).limit(2).agg(F.max_by(model, F.struct(F.col(value), F.lit(1))).alias("best"), F.min_by(model, F.struct(F.col(value), F.lit(1))).alias("second"), (F.max(value) - F.min(value)).alias("gap"))
    return top.select("best", "second", rnd("gap").alias("gap"), (F.col("gap") < close).alias("tied"))


def projection(cells: int, cells_per_s: float, bytes_per_cell: float, free_bytes: float) -> dict[str, float]:
    """Seconds for a raster at a measured speed, and rows of cells that a quarter of the free memory holds."""
    return {"seconds": cells / cells_per_s, "cells_at_once": min(cells, 0.25 * free_bytes / bytes_per_cell)}
