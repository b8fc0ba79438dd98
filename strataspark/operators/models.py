"""Classifiers on the library's own learners: forests, boosted trees, an approximate kernel machine; importance, explanations, searches."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from math import factorial

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.checkpoints import cut
from strataspark.functions.columns import key_hash
from strataspark.operators import metrics as M

#: Rows for each task that learns. A small file of numbers has few splits and many rows.
TASK_ROWS = 1 << 16
#: Fits of a search that run at once.
FITS = 4


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in tasks of about TASK_ROWS rows by a hash of a key, each in the key's order; as it is if it fills one task only.

    What a learner draws by task and place then depends on the rows, not on how files are split."""
    tasks = -(-df.count() // TASK_ROWS)
    return df.repartition(tasks, key).sortWithinPartitions(key) if tasks > 1 else df


def vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def fit_forest(df: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 5, seed: int = 42) -> PipelineModel:
    """A random forest. The learner's depth ends at 30, so trees can't grow without limit."""
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    model = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(assembler.transform(df))
    return PipelineModel([assembler, model])


def fit_boosted(df: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 3, seed: int = 42) -> PipelineModel:
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    return PipelineModel([assembler, GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed).fit(assembler.transform(df))])


def fourier(features: list[str], dims: int, gamma: float, seed: int, along: tuple[list[float], float] | None = None) -> Column:
    """Random Fourier features of an RBF kernel exp(-gamma |x - y|**2), as an array; or with along, (coefficients, intercept), the number that a linear machine gives them.

    Made by the batch, and once for each row wherever the column is used or filtered."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (dims, len(features))), rng.uniform(0, 2 * np.pi, dims)

    def run(*columns: pd.Series) -> pd.Series:
        z = np.cos(np.stack([c.to_numpy(float) for c in columns], axis=1) @ w.T + b) * np.sqrt(2 / dims)
        return pd.Series(list(z)) if along is None else pd.Series(z @ np.asarray(along[0]) + along[1])

    told = F.pandas_udf(run, "array<double>" if along is None else "double").asNondeterministic()
    return told(*[F.col(f).cast("double") for f in features])


class KernelMachine:
    """A linear machine on Fourier features with a logistic scale for its margins: an approximation of an RBF support vector machine."""

    def __init__(self, features: list[str], dims: int = 32, gamma: float = 0.5, c: float = 1.0, seed: int = 42):
        self.features, self.dims, self.gamma, self.c, self.seed = features, dims, gamma, c, seed

    def _margin(self) -> Column:
        return fourier(self.features, self.dims, self.gamma, self.seed, (self.machine.coefficients.toArray().tolist(), float(self.machine.intercept)))

    def fit(self, df: DataFrame, label: str) -> KernelMachine:
        """Rows are dealt out in tasks of TASK_ROWS once. They stay as features and label; what is made of them is made by each pass."""
        rows = df.select(*self.features, label)
        n = rows.count()
        rows = rows.repartition(max(1, -(-n // TASK_ROWS))).persist()
        try:
            x = rows.select(label, array_to_vector(fourier(self.features, self.dims, self.gamma, self.seed)).alias("features"))
            self.machine = LinearSVC(labelCol=label, regParam=1 / (self.c * max(1, n)), maxIter=30).fit(x)
            margins = rows.select(label, array_to_vector(F.array(self._margin())).alias("margin"))
            self.scale = LogisticRegression(featuresCol="margin", labelCol=label, rawPredictionCol="r", probabilityCol="p", predictionCol="q").fit(margins)
        finally:
            rows.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-(F.col("margin") * float(self.scale.coefficients[0]) + float(self.scale.intercept))))
        return df.select("*", self._margin().alias("margin")).select(*df.columns, "margin", p.alias("score"))


def score(model: Transformer, df: DataFrame) -> DataFrame:
    """df with score, the probability of class 1."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score")


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    """Each feature's share of the impurity gained, largest first."""
    rows = [(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray(), strict=True)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, share double").orderBy(F.desc("share"), "feature")


def permutation_importance(model: Transformer, df: DataFrame, features: list[str], label: str, key: str, repeats: int = 3, seed: int = 42) -> DataFrame:
    """(feature, drop, sd): how far the AUC falls when a feature's values are dealt to other rows in the order of a hash.

    df has a unique integer key. Values move by joining two hash orders on their ranks; all features and repeats are scored in one job."""
    from strataspark.operators.ordered import running_sum

    base = M.auc(score(model, df), "score", label).first().auc
    one = df.withColumn("_one", F.lit(1))
    mine = running_sum(one.withColumn("_h", key_hash(key, seed)), "_h", {"_one": "_rank"}, tie=key).drop("_h", "_one")
    parts = []
    for r in range(repeats):
        other = running_sum(one.select(key, *features, "_one", key_hash(F.pmod(F.col(key), F.lit(2147483647)) * (31 + r), seed + 7 + r).alias("_h")), "_h", {"_one": "_rank"}, tie=key).select("_rank", *[F.col(f).alias(f"_s_{f}") for f in features])
        dealt = mine.join(other, "_rank")
        for f in features:
            parts.append(dealt.select(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), label, *[F.col(f"_s_{g}" if g == f else g).alias(g) for g in features]))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    aucs = M.auc(score(model, every), "score", label, ["feature", "repeat"])
    return aucs.groupBy("feature").agg(F.avg(F.lit(base) - F.col("auc")).alias("drop"), F.stddev_pop(F.lit(base) - F.col("auc")).alias("sd"))


def _trees(model: PipelineModel, path: str, spark) -> list[dict[str, np.ndarray]]:
    """The forest's nodes as arrays, read from its saved form."""
    model.stages[-1].write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas().sort_values(["treeID", "id"])
    out = []
    for _, t in nodes.groupby("treeID"):
        stats = np.stack(t["impurityStats"].to_numpy())
        split = t["split"].tolist()
        out.append({
            "left": t["leftChild"].to_numpy(), "right": t["rightChild"].to_numpy(), "n": stats.sum(1), "value": stats[:, 1] / stats.sum(1),
            "feature": np.array([s["featureIndex"] for s in split]), "at": np.array([s["leftCategoriesOrThreshold"][0] if len(s["leftCategoriesOrThreshold"]) else 0.0 for s in split]),
        })
    return out


def _paths(trees: list[dict[str, np.ndarray]]) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Each leaf as (value, steps): for every feature on its path (feature, share, low, high). share is the part of the training rows that went the path's way
    at the feature's nodes, all of them multiplied; rows with low < x <= high go that way themselves."""
    out = []
    for t in trees:
        open_nodes = [(0, {})]
        while open_nodes:
            node, steps = open_nodes.pop()
            if t["left"][node] < 0:
                out.append((float(t["value"][node]), [(f, *s) for f, s in steps.items()]))
                continue
            f, at, a, b = int(t["feature"][node]), float(t["at"][node]), int(t["left"][node]), int(t["right"][node])
            share, low, high = steps.get(f, (1.0, -np.inf, np.inf))
            n = t["n"][a] + t["n"][b]
            open_nodes.append((a, steps | {f: (share * t["n"][a] / n, low, min(high, at))}))
            open_nodes.append((b, steps | {f: (share * t["n"][b] / n, max(low, at), high)}))
    return out


def path_shapley(paths: list, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(base, predictions, phi) of rows under the sum of leaves.

    A leaf is a game: a set of known features gives its value times the shares of the others, if the row goes its way in all that are known. Summed by size, the weights of all subsets
    are the coefficients of the product of (share + t), or of share alone where the row leaves the path. The product is extended feature by
    feature, for all rows at once; each feature's own factor is then divided out again, so a leaf costs the square of its path's features, whatever the number of features."""
    base, phi, predicted = 0.0, np.zeros(x.shape), np.zeros(len(x))
    for value, steps in paths:
        d = len(steps)
        shares = np.array([s for _, s, _, _ in steps])
        base += value * shares.prod()
        goes = np.stack([(x[:, f] > low) & (x[:, f] <= high) for f, _, low, high in steps], axis=1) if d else np.ones((len(x), 0), bool)
        predicted += value * goes.all(axis=1)
        c = np.zeros((len(x), d + 1))
        c[:, 0] = 1
        for j in range(d):
            c[:, 1 : j + 2] = c[:, 1 : j + 2] * shares[j] + c[:, : j + 1] * goes[:, j : j + 1]
            c[:, 0] *= shares[j]
        weight = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
        for j, (f, share, _, _) in enumerate(steps):
            known, rest = np.zeros(len(x)), np.zeros(len(x))
            for k in range(d, 0, -1):  # the product without (share + t), from its highest coefficient down
                rest = c[:, k] - share * rest
                known += weight[k - 1] * rest
            unknown = (c[:, :d] * weight).sum(axis=1) / share
            phi[:, f] += value * np.where(goes[:, j], (1 - share) * known, -share * unknown)
    return base, predicted, phi


def tree_shap(model: PipelineModel, df: DataFrame, features: list[str], key: str, path: str) -> DataFrame:
    """(key, base, prediction, phi): exact path-dependent Shapley values of a forest's probability, one per feature; base plus their sum is the prediction.

    Rows are explained where they lie, in batches; the leaves' paths are the model's and go to every task."""
    spark = df.sparkSession
    trees = _trees(model, path, spark)
    paths = spark.sparkContext.broadcast([(v / len(trees), steps) for v, steps in _paths(trees)])

    def run(batches):
        for pdf in batches:
            base, predicted, phi = path_shapley(paths.value, pdf[features].to_numpy(float))
            yield pd.DataFrame({key: pdf[key], "base": base, "prediction": predicted, "phi": list(phi)})

    return df.select(key, *features).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, base double, prediction double, phi array<double>")


def shap_ranking(shap: DataFrame, features: list[str]) -> DataFrame:
    """Features by mean absolute value."""
    one = shap.agg(*[F.avg(F.abs(F.col("phi")[i])).alias(f) for i, f in enumerate(features)])
    return one.unpivot([], features, "feature", "mean_abs").orderBy(F.desc("mean_abs"), "feature")


def at_once(df: DataFrame, work, over: list, jobs: int = FITS) -> list:
    """work of each of over, several at a time: the driver plans one's jobs while the others' run."""
    with ThreadPoolExecutor(jobs) as pool:
        return list(pool.map(inheritable_thread_target(df.sparkSession)(work), over))


def told_by(model, df: DataFrame) -> DataFrame:
    return model.transform(df) if isinstance(model, KernelMachine) else score(model, df)


def grid_search(df: DataFrame, fold: Column, folds: int, candidates: list[dict], fit, label: str, prepare=None) -> DataFrame:
    """(candidate, mean_auc, sd): each candidate's AUC over folds. fit(train, **candidate) gives something with transform or a model for score().

    prepare, say over-sampling, sees a fold's training rows only. Fits run several at a time."""
    x = df.withColumn("_fold", fold)

    def tried(at: tuple[int, int]) -> tuple:
        k, f = at
        train = x.where(F.col("_fold") != f).drop("_fold")
        told = cut(told_by(fit(prepare(train) if prepare else train, **candidates[k]), x.where(F.col("_fold") == f).drop("_fold")).select(label, "score"))
        return k, f, M.auc(told, "score", label).first().auc

    rows = at_once(df, tried, [(k, f) for k in range(len(candidates)) for f in range(folds)])
    out = df.sparkSession.createDataFrame(rows, "candidate int, fold int, auc double")
    return out.groupBy("candidate").agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("sd")).orderBy(F.desc("mean_auc"), "candidate")


def nested_fit(df: DataFrame, outer: int, inner: int, key: str, candidates: list[dict], fit, label: str) -> DataFrame:
    """(outer_fold, key, label, score, prediction, threshold): tuned on inner folds, threshold from their out-of-fold scores, refitted, scored outside.

    df has fold (outer) and inner columns. Every candidate is fitted once on each inner fold; its scores there, stored, give both its AUC and, if it is the best, the threshold.
    Rows are dealt out to tasks once and kept while models are fitted; fits run several at a time."""
    x = spread(df, key).persist()

    def tried(at: tuple[int, int, int]) -> tuple[float | None, DataFrame]:
        o, k, i = at
        train = x.where(F.col("fold") != o)
        told = cut(told_by(fit(train.where(F.col("inner") != i), **candidates[k]), train.where(F.col("inner") == i)).select(key, label, "score"))
        return M.auc(told, "score", label).first().auc, told

    def finished(o: int) -> DataFrame:
        known = [[a for i in range(inner) if (a := done[o, k, i][0]) is not None] for k in range(len(candidates))]
        best = max(range(len(candidates)), key=lambda k: (sum(known[k]) / len(known[k]) if known[k] else -1.0, -k))
        held = None
        for i in range(inner):
            part = done[o, best, i][1].withColumn("origin", F.lit("inner_validation"))
            held = part if held is None else held.unionByName(part)
        threshold = M.youden_out_of_fold(held, "score", label, key, "origin", "inner_validation").first().threshold
        told = told_by(fit(x.where(F.col("fold") != o), **candidates[best]), df.where(F.col("fold") == o))
        return told.select(F.lit(o).alias("outer_fold"), key, label, "score", (F.col("score") >= threshold).cast("int").alias("prediction"), F.lit(threshold).alias("threshold"))

    try:
        tries = [(o, k, i) for o in range(outer) for k in range(len(candidates)) for i in range(inner)]
        done = dict(zip(tries, at_once(df, tried, tries), strict=True))
        parts = at_once(df, finished, list(range(outer)))
    finally:
        x.unpersist()
    out = parts[0]
    for told in parts[1:]:
        out = out.unionByName(told)
    return out


def save_checked(model: PipelineModel, path: str, features: list[str], spark: SparkSession) -> None:
    """A model beside the list of its features, in order."""
    model.write().save(f"{path}/model")
    spark.createDataFrame(list(enumerate(features)), "place int, feature string").coalesce(1).write.parquet(f"{path}/features")


def load_checked(spark: SparkSession, path: str, features: list[str]) -> PipelineModel:
    """The model saved at a path; its features must be the expected ones, in order, and its classes 0 and 1."""
    from strataspark.operators.quality import first_difference

    saved = [r.feature for r in spark.read.parquet(f"{path}/features").orderBy("place").collect()]
    at = first_difference(saved, features)
    if at >= 0:
        raise ValueError(f"features differ at {at}: {saved[at : at + 1]} saved, {features[at : at + 1]} expected")
    model = PipelineModel.load(f"{path}/model")
    last = model.stages[-1]
    if last.numClasses != 2 or last.numFeatures != len(features):
        raise ValueError(f"{last.numClasses} classes, {last.numFeatures} features")
    return model
