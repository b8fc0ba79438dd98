"""Nested spatial validation: folds, candidates and learners fitted as concurrent jobs, each on its own fold's prepared and balanced train rows."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.checkpoints import cut
from strataspark.operators import folds as K
from strataspark.operators import metrics as M
from strataspark.operators import prep as P

#: Splits are numbered protocol * STEP**2 + outer * STEP + inner, inner 0 for the outer split itself.
STEP = 100
#: Jobs that run at once, in one fair pool of the session's scheduler.
JOBS, POOL = 8, "nested-validation"


def nested_splits(samples: DataFrame, key: str, protocols: list[tuple[str, Column, float]], outer: int, inner_fold: Column, inner: int, radius: float) -> DataFrame:
    """(split, protocol, outer_fold, inner_fold, key, role) of all outer (inner_fold 0) and inner (from 1) splits.

    protocols are (name, fold column from 0, buffer of the outer splits). Roles are train, test and removed, for train rows within the buffer of a test row. Inner splits
    divide the outer train rows that are left, always with the buffer radius."""
    points, out = samples.select(key, "x", "y"), None
    for p, (name, fold, buffer) in enumerate(protocols):
        x = samples.select(key, fold.cast("int").alias("fold"), inner_fold.cast("int").alias("inner"))
        own = K.memberships(x, key, outer)
        own = cut(K.buffered(own, points, key, buffer) if buffer > 0 else own)
        at = F.lit(p * STEP**2) + F.col("outer_fold") * STEP
        first = own.select(at.alias("split"), F.lit(name).alias("protocol"), "outer_fold", F.lit(0).alias("inner_fold"), key, "role")
        left = own.where("role = 'train'").join(x.select(key, "inner"), key).select("outer_fold", key, "inner", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))).alias("i"))
        parts = left.select((at + F.col("i") + 1).alias("outer_fold"), key, F.when(F.col("inner") == F.col("i"), "test").otherwise("train").alias("role"))
        parts = K.buffered(parts, points, key, radius) if radius > 0 else parts
        split = F.col("outer_fold")
        second = parts.select(split.alias("split"), F.lit(name).alias("protocol"), F.floor(F.pmod(split, F.lit(STEP**2)) / STEP).cast("int").alias("outer_fold"), (split % STEP).cast("int").alias("inner_fold"), key, "role")
        both = first.unionByName(second)
        out = both if out is None else out.unionByName(both)
    return cut(out)


def nested_spatial(splits: DataFrame, samples: DataFrame, key: str, label: str, numbers: list[str], angles: list[str], categories: list[str], learners: dict[str, tuple[Callable, list[dict]]], least: int, k: int = 5, jobs: int = JOBS) -> tuple[DataFrame, DataFrame]:
    """(predictions, receipts) of every outer split and learner.

    predictions is (protocol, outer_fold, learner, key, label, score, prediction, threshold) of the outer test rows; receipts (protocol, outer_fold, learner, candidate, mean_auc, threshold, n_oof, origin_ok).
    learners are name -> (fit, candidates): fit(train, **candidate) takes (features vector, label) and gives a model with a probability.

    What each split learns, medians, levels, scales, dropped features, synthetic rows, comes from its own train rows: fold_prepare and fold_smote see nothing else. A candidate's mean AUC over the
    inner splits decides, the first of equals; its inner scores, one for each outer train row, give the threshold; the outer train rows are fitted again with it, and outer test labels are read after that.
    A split whose train rows, after its buffer, lack a class teaches nothing: its test rows have no score, and an outer one no candidate or threshold where its inner splits have no score either.
    All fits of a stage run at once, jobs at a time; the driver holds their AUCs, no rows."""
    spark = samples.sparkSession
    heads = sorted(tuple(r) for r in splits.select("split", "protocol", "outer_fold", "inner_fold").distinct().collect())
    sides = splits.where("role <> 'removed'").select(F.col("split").cast("int").alias("fold"), key, "role")
    rows, _ = P.fold_prepare(samples.select(key, *numbers, *angles, *categories), sides, key, numbers, angles, categories, least=least)
    rows, labels = cut(rows), samples.select(key, label)
    classes = splits.where("role = 'train'").join(labels, key).groupBy("split").agg(F.count_distinct(F.col(label)).alias("n"))
    taught = {r.split for r in classes.where("n > 1").select("split").collect()}
    vector = F.transform(F.array_sort(F.map_keys("features")), lambda n: F.element_at("features", n))

    def at_once(work: Callable, over: list) -> list:
        def one(x):
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", POOL)
            return work(x)

        with ThreadPoolExecutor(jobs) as pool:
            return list(pool.map(inheritable_thread_target(spark)(one), over))

    def sided(split: int) -> tuple[DataFrame, DataFrame]:
        train = cut(P.fold_smote(rows, key, labels, label, 1, split, k).select(array_to_vector("v").alias("features"), label))
        test = cut(rows.where((F.col("fold") == split) & (F.col("role") == "test")).join(labels, key).select(key, label, array_to_vector(vector).alias("features")))
        return train, test

    some = [h[0] for h in heads if h[0] in taught]
    held = dict(zip(some, at_once(sided, some), strict=True))

    def told(split: int, name: str, candidate: dict) -> DataFrame:
        if split not in taught:
            return splits.where((F.col("split") == split) & (F.col("role") == "test")).join(labels, key).select(key, label, F.lit(None).cast("double").alias("score"))
        train, test = held[split]
        model = learners[name][0](train, **candidate)
        return cut(model.transform(test).select(key, label, vector_to_array("probability")[1].alias("score")))

    tries = [(h, name, c) for h in heads if h[3] for name, (_, cs) in learners.items() for c in range(len(cs))]

    def tried(x) -> tuple[float | None, DataFrame]:
        h, name, c = x
        out = told(h[0], name, learners[name][1][c])
        return M.auc(out, "score", label).first().auc if h[0] in taught else None, out

    done = {(h[1], h[2], h[3], name, c): r for (h, name, c), r in zip(tries, at_once(tried, tries), strict=True)}

    def finish(x) -> tuple[DataFrame, tuple]:
        (split, protocol, outer_fold, _), name = x
        inner = sorted(h[3] for h in heads if h[1] == protocol and h[2] == outer_fold and h[3])
        known = [[a for i in inner if (a := done[protocol, outer_fold, i, name, c][0]) is not None] for c in range(len(learners[name][1]))]
        means = [sum(k) / len(k) if k else None for k in known]
        tuned = any(m is not None for m in means)
        best = max(range(len(means)), key=lambda c: (-1.0 if means[c] is None else means[c], -c))
        oof = labels.where("false").select(key, label, F.lit(0.0).alias("score"), F.lit("").alias("origin")) if not inner else None
        for i in inner:
            part = done[protocol, outer_fold, i, name, best][1].withColumn("origin", F.lit("inner_validation"))
            oof = part if oof is None else oof.unionByName(part)
        scored = oof.where("score IS NOT NULL")
        threshold = M.youden_out_of_fold(scored, "score", label, key, "origin", "inner_validation").first().threshold if tuned else None
        mine = splits.where((F.col("split") == split) & (F.col("role") == "train")).select(key)
        n = oof.count()
        sound = n == mine.count() == oof.select(key).distinct().join(mine, key).count() and (threshold is None or not oof.where(F.col("score") == threshold).isEmpty())
        out = told(split, name, learners[name][1][best])
        place = (F.lit(protocol).alias("protocol"), F.lit(outer_fold).alias("outer_fold"), F.lit(name).alias("learner"))
        out = out.select(*place, key, label, "score", (F.col("score") >= F.lit(threshold).cast("double")).cast("int").alias("prediction"), F.lit(threshold).cast("double").alias("threshold"))
        return out, (protocol, outer_fold, name, best if tuned else None, means[best], threshold, n, bool(sound))

    ends = at_once(finish, [(h, name) for h in heads if not h[3] for name in learners])
    predictions = ends[0][0]
    for more, _ in ends[1:]:
        predictions = predictions.unionByName(more)
    receipts = spark.createDataFrame([r for _, r in ends], "protocol string, outer_fold int, learner string, candidate int, mean_auc double, threshold double, n_oof long, origin_ok boolean")
    return predictions, receipts
