"""Queries that fit models. SQL can't express these; some return facts that hold for any right result, which SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.checkpoints import shared_folder
from strataspark.functions import columns as C
from strataspark.operators import metrics as M
from strataspark.operators import models as L
from strataspark.operators.raster import zone_table
from strataspark.plans.registry import query, table
from strataspark.plans.samples import POINTS, points

FEATURES = ["f1", "f2", "f3", "f4"]


def samples(spark, d):
    """Customers with four features and a label that three of them decide, but for a tenth."""
    k = F.col("c_custkey")
    u = lambda m, n: (k * m % n) / float(n)
    x = table(spark, d, "customer").select(k.alias("id"), u(7919, 1009).alias("f1"), u(104729, 997).alias("f2"), u(6101, 883).alias("f3"), u(31, 101).alias("f4"), (k % 3).alias("fold"), (F.expr("c_custkey div 3") % 2).alias("inner"))
    y = F.col("f1") + F.col("f2") * F.col("f2") - 0.5 * F.col("f3") > 0.6
    return x.withColumn("label", F.when(F.col("id") % 10 == 0, (~y).cast("int")).otherwise(y.cast("int")))


@query(None)
def forest_score_zones(spark, d):
    x = samples(spark, d)
    told = L.score(L.fit_forest(x, FEATURES, "label"), x)
    return zone_table(told.select((F.col("id") % 4).alias("region"), C.zone("score").alias("zone")), "region")


#: The AUC of the strongest feature by itself on the held-out fold, which a fitted model must beat.
BASELINE_SQL = """WITH x AS (SELECT c_custkey AS id, (c_custkey * 7919 % 1009) / 1009.0::DOUBLE AS f1, (c_custkey * 104729 % 997) / 997.0::DOUBLE AS f2, (c_custkey * 6101 % 883) / 883.0::DOUBLE AS f3 FROM customer),
y AS (SELECT *, CASE WHEN id % 10 = 0 THEN 1 - (f1 + f2 * f2 - 0.5::DOUBLE * f3 > 0.6::DOUBLE)::INT ELSE (f1 + f2 * f2 - 0.5::DOUBLE * f3 > 0.6::DOUBLE)::INT END AS label FROM x WHERE id % 3 = 0),
v AS (SELECT label, (sum(1 - label) OVER (ORDER BY f1) - 0.5::DOUBLE * sum(1 - label) OVER (PARTITION BY f1)) / sum(1 - label) OVER () AS below FROM y)
SELECT round(avg(below) FILTER (label = 1), 6) AS baseline, true AS better FROM v"""


def _against_baseline(test, told):
    """The baseline, and whether the model's AUC is higher."""
    b, m = M.auc(test, "f1", "label").select(F.col("auc").alias("b")), M.auc(told, "score", "label").select(F.col("auc").alias("m"))
    return b.join(F.broadcast(m)).select(C.rnd("b").alias("baseline"), (F.col("m") > F.col("b")).alias("better"))


@query(BASELINE_SQL)
def boosted_auc(spark, d):
    x = samples(spark, d)
    test = x.where("fold = 0")
    return _against_baseline(test, L.score(L.fit_boosted(x.where("fold <> 0"), FEATURES, "label"), test))


@query(BASELINE_SQL)
def kernel_machine_auc(spark, d):
    x = samples(spark, d)
    test = x.where("fold = 0")
    return _against_baseline(test, L.KernelMachine(FEATURES, gamma=1.0).fit(x.where("fold <> 0"), "label").transform(test))


@query(None)
def grid_search(spark, d):
    x = samples(spark, d)
    fit = lambda t, depth: L.fit_forest(t, FEATURES, "label", trees=5, depth=depth)
    return L.grid_search(x, F.col("fold"), 3, [{"depth": 2}, {"depth": 4}], fit, "label")


@query(None)
def nested_validation(spark, d):
    fit = lambda t, depth: L.fit_forest(t, FEATURES, "label", trees=3, depth=depth)
    return L.nested_fit(samples(spark, d), 3, 2, "id", [{"depth": 2}, {"depth": 4}], fit, "label")


@query(None)
def permutation_importance(spark, d):
    x = samples(spark, d)
    return L.permutation_importance(L.fit_forest(x, FEATURES, "label", trees=5), x, FEATURES, "label", "id", repeats=2)


@query("SELECT 1.0::DOUBLE AS total, 4 AS features")
def impurity_importance(spark, d):
    x = samples(spark, d)
    return L.importances(L.fit_forest(x, FEATURES, "label", trees=5), FEATURES).agg(C.rnd(F.sum("share")).alias("total"), F.count("*").cast("int").alias("features"))


@query("SELECT count(*) AS rows, true AS additive FROM customer")
def shap_additivity(spark, d):
    import uuid

    x = samples(spark, d)
    folder = shared_folder(spark)
    s = L.tree_shap(L.fit_forest(x, FEATURES, "label", trees=5, depth=4), x, FEATURES, "id", f"{folder}/forest-{uuid.uuid4().hex}")
    total = F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, v: a + v)
    return s.agg(F.count("*").alias("rows"), (F.max(F.abs(total - F.col("prediction"))) < 1e-9).alias("additive"))


#: Two protocols of two outer and two inner folds: by groups with a buffer of 600 m, and by numbers without. An inner fold holds whole groups, too.
NESTED_SQL = f"""WITH {POINTS}, p AS (SELECT *, unnest(['spatial', 'random']) AS protocol FROM points), m AS (SELECT protocol, id, x, y, label, (("group" // 2) % 2)::INT AS inner_fold, o::INT AS outer_fold, CASE WHEN (CASE WHEN protocol = 'spatial' THEN "group" % 2 ELSE id % 2 END) = o THEN 'test' ELSE 'train' END AS role FROM p, (SELECT unnest([0, 1]) AS o)),
k AS (SELECT *, CASE WHEN role = 'train' AND protocol = 'spatial' AND EXISTS (SELECT 1 FROM m t WHERE t.protocol = m.protocol AND t.outer_fold = m.outer_fold AND t.role = 'test' AND (t.x - m.x) * (t.x - m.x) + (t.y - m.y) * (t.y - m.y) <= 360000) THEN 'removed' ELSE role END AS kept FROM m)
SELECT protocol, outer_fold, learner, count_if(kept = 'train')::BIGINT AS train, count_if(kept = 'removed')::BIGINT AS removed, count_if(kept = 'test')::BIGINT AS test, count_if(kept = 'test' AND label = 1)::BIGINT AS positives, count_if(kept = 'train')::BIGINT AS out_of_fold, true AS threshold_of_inner, 0::BIGINT AS faults
FROM k, (SELECT unnest(['forest', 'boosted', 'linear']) AS learner) GROUP BY ALL"""


@query(NESTED_SQL)
def nested_spatial(spark, d):
    """Per outer fold and learner: rows of each role, out-of-fold scores, whether the threshold is one of those, and faults of all the fold's splits."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    from strataspark.operators import folds as K
    from strataspark.operators import nested as N

    p = points(spark, d)
    k = F.col("id")
    angle = F.when(k % 9 == 0, -1.0).otherwise((k * 37 % 360).cast("double"))
    x = p.select("*", F.when(k % 11 != 0, F.col("label") * 300 + k * 7919 % 1009).alias("u"), angle.alias("angle"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("kind"), F.floor(F.col("x") / 30).alias("col"), F.floor(F.col("y") / 30).alias("row"))
    splits = N.nested_splits(x, "id", [("spatial", F.col("group") % 2, 600.0), ("random", k % 2, 0.0)], 2, F.expr("`group` div 2") % 2, 2, 600.0)
    learner = {
        "forest": (lambda t, depth: RandomForestClassifier(labelCol="label", numTrees=3, maxDepth=depth, seed=42).fit(t), [{"depth": 2}, {"depth": 3}]),
        "boosted": (lambda t, trees: GBTClassifier(labelCol="label", maxIter=trees, maxDepth=2, seed=42).fit(t), [{"trees": 2}]),
        "linear": (lambda t, c: LogisticRegression(labelCol="label", regParam=c, maxIter=10).fit(t), [{"c": 0.1}]),
    }
    told, receipts = N.nested_spatial(splits, x, "id", "label", ["u"], ["angle"], ["kind"], learner, least=2)
    one = splits.where("inner_fold = 0").groupBy("protocol", "outer_fold").agg(*(F.count_if(F.col("role") == r).alias(r) for r in ("train", "removed")))
    scored = told.groupBy("protocol", "outer_fold", "learner").agg(F.count("*").alias("test"), F.sum("label").cast("long").alias("positives"))
    # inner splits and the spatial outer ones: no group crosses, each class is there; a split whose buffer leaves no train row fits nothing
    facts = x.select("id", "label", "group", "row", "col", F.lit("").alias("event"))
    grouped = splits.where("protocol = 'spatial' OR inner_fold > 0").select("protocol", F.col("outer_fold").alias("o"), F.col("split").alias("outer_fold"), "id", "role")
    grouped = grouped.join(grouped.where("role = 'train'").select("outer_fold").distinct(), "outer_fold", "left_semi")
    bad = K.split_faults(grouped.drop("protocol", "o"), facts, "id", "group", "event", "label", 2).select("outer_fold", (F.col("groups") + F.col("too_few").cast("int")).alias("n"))
    faults = grouped.select("protocol", "o", "outer_fold").distinct().join(bad, "outer_fold").groupBy("protocol", F.col("o").alias("outer_fold")).agg(F.sum("n").alias("faults"))
    out = receipts.join(one, ["protocol", "outer_fold"]).join(scored, ["protocol", "outer_fold", "learner"]).join(faults, ["protocol", "outer_fold"], "left")
    return out.select("protocol", "outer_fold", "learner", "train", "removed", "test", "positives", F.col("n_oof").alias("out_of_fold"), F.col("origin_ok").alias("threshold_of_inner"), F.coalesce("faults", F.lit(0).cast("long")).alias("faults"))


MANY = [f"g{i:02d}" for i in range(23)]


@query("SELECT count(*) AS rows, true AS additive, 23 AS features FROM customer")
def shap_many_features(spark, d):
    """Explained by 23 features, far beyond what weighing every subset allows."""
    import uuid

    k = F.col("id")
    x = samples(spark, d).withColumns({f: (k * (7919 + 1009 * i) % (997 + 2 * i)) / F.lit(float(997 + 2 * i)) for i, f in enumerate(MANY)})
    folder = shared_folder(spark)
    s = L.tree_shap(L.fit_forest(x, MANY, "label", trees=5, depth=6), x, MANY, "id", f"{folder}/forest-{uuid.uuid4().hex}")
    total = F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, v: a + v)
    return s.agg(F.count("*").alias("rows"), (F.max(F.abs(total - F.col("prediction"))) < 1e-9).alias("additive"), F.max(F.size("phi")).alias("features"))


@query("SELECT id, CASE WHEN score >= 0.6 THEN 'alert' WHEN score >= 0.4 THEN 'watch' ELSE 'none' END AS call FROM (SELECT c_custkey AS id, (c_custkey * 7919 % 1009) / 1009.0::DOUBLE AS score FROM customer)")
def score_calls(spark, d):
    s = (F.col("id") * 7919 % 1009) / F.lit(1009.0)
    return points(spark, d).select("id", F.when(s >= 0.6, "alert").when(s >= 0.4, "watch").otherwise("none").alias("call"))
