"""Queries on predictions and folds: curves, thresholds, intervals, partitions, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions import columns as C
from strataspark.operators import folds as K
from strataspark.operators import metrics as M
from strataspark.plans.registry import query, table
from strataspark.plans.samples import POINTS, SCORED, points, scored

HIST = f"{SCORED}, h AS (SELECT score, sum(label) AS p, count(*) AS n FROM scored GROUP BY 1), t AS (SELECT sum(p) AS pos, sum(n) - sum(p) AS neg FROM h), c AS (SELECT score, p, n, pos, neg, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS above, sum(n - p) OVER (ORDER BY score) - (n - p) AS below FROM h, t)"


@query(f"WITH {HIST} SELECT score, tp::BIGINT AS tp, (above - tp)::BIGINT AS fp, round(tp::DOUBLE / pos, 6) AS tpr, round((above - tp)::DOUBLE / neg, 6) AS fpr, round(tp::DOUBLE / above, 6) AS precision FROM c")
def roc_pr_curve(spark, d):
    return M.curve(scored(spark, d), "score", "label").select("score", "tp", "fp", *[C.rnd(c).alias(c) for c in ("tpr", "fpr", "precision")])


@query(f"WITH {HIST} SELECT round(sum(p * (below + 0.5::DOUBLE * (n - p))) / (max(pos) * max(neg))::DOUBLE, 8) AS auc, max(pos)::BIGINT AS pos, max(neg)::BIGINT AS neg FROM c")
def auc(spark, d):
    return M.auc(scored(spark, d), "score", "label").select(C.rnd("auc", 8).alias("auc"), "pos", "neg")


@query(f"WITH {HIST} SELECT round(sum(p::DOUBLE / pos * (tp::DOUBLE / above)), 8) AS ap FROM c")
def average_precision(spark, d):
    return M.average_precision(scored(spark, d), "score", "label").select(C.rnd("ap", 8).alias("ap"))


@query(f"WITH {HIST}, j AS (SELECT score, tp::DOUBLE / pos - (above - tp)::DOUBLE / neg AS j FROM c) SELECT CASE WHEN max(j) > 0 THEN arg_max(score, (j, score)) ELSE 'inf'::DOUBLE END AS threshold, round(greatest(max(j), 0), 8) AS j FROM j")
def youden(spark, d):
    return M.youden(scored(spark, d), "score", "label").select("threshold", C.rnd("j", 8).alias("j"))


@query("""WITH o AS (SELECT e.event_id, (event_id % 3 = 0)::INT AS label, round(value / 200, 4) AS score FROM events e), h AS (SELECT score, sum(label) AS p, count(*) AS n FROM o GROUP BY 1), j AS (SELECT score, sum(p) OVER (ORDER BY score DESC)::DOUBLE / (SELECT sum(p) FROM h) - sum(n - p) OVER (ORDER BY score DESC)::DOUBLE / (SELECT sum(n - p) FROM h) AS j FROM h)
SELECT max(score) AS threshold FROM j WHERE j >= (SELECT max(j) FROM j) - 1e-12""")
def youden_out_of_fold(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 3 == 0).cast("int").alias("label"), C.rnd(F.col("value") / 200, 4).alias("score"), F.lit("inner_validation").alias("origin"))
    return M.youden_out_of_fold(e, "score", "label", "event_id", "origin", "inner_validation")


METRICS_SQL = """round(coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0), 4) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 4) AS recall,
round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0), 4) AS specificity, round((coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2, 4) AS balanced_accuracy"""
CONFUSION_SQL = "count_if(score >= {t} AND label = 1)::BIGINT AS tp, count_if(score >= {t} AND label = 0)::BIGINT AS fp, count_if(score < {t} AND label = 1)::BIGINT AS fn, count_if(score < {t} AND label = 0)::BIGINT AS tn"


@query(f"WITH {SCORED}, c AS (SELECT suppkey % 10 AS part, {CONFUSION_SQL.format(t='0.5::DOUBLE')} FROM scored GROUP BY 1) SELECT *, {METRICS_SQL} FROM c")
def confusion_metrics(spark, d):
    s = scored(spark, d).withColumn("part", F.col("suppkey") % 10)
    return M.confusion(s, F.col("score") >= 0.5, "label", ["part"])


@query(f"""WITH {SCORED}, s AS (SELECT *, unnest(['all', CASE WHEN quantity <= 25 THEN 'small' ELSE 'large' END]) AS subset FROM scored), h AS (SELECT subset, score, sum(label) AS p, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT *, sum(n - p) OVER (PARTITION BY subset ORDER BY score) - (n - p) AS below FROM h)
SELECT subset, round(sum(p * (below + 0.5::DOUBLE * (n - p))) / (sum(p) * (sum(n) - sum(p)))::DOUBLE, 8) AS auc, sum(n)::BIGINT AS rows FROM c GROUP BY 1""")
def subset_auc(spark, d):
    s = M.subsets(scored(spark, d), {"all": F.lit(True), "small": F.col("quantity") <= 25, "large": F.col("quantity") > 25})
    return M.auc(s, "score", "label", ["subset"]).select("subset", C.rnd("auc", 8).alias("auc"), (F.col("pos") + F.col("neg")).alias("rows"))


@query(f"""WITH {SCORED}, x AS (SELECT label AS y, (score >= 0.5::DOUBLE)::INT AS p FROM scored), c AS (SELECT k::VARCHAR AS name, count_if(p = k AND y = k)::DOUBLE AS tp, count_if(p = k) AS said, count_if(y = k) AS support FROM x, (SELECT unnest([0, 1]) AS k) GROUP BY k),
m AS (SELECT name, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(said + support, 0), 0) AS f1, support FROM c),
a AS (SELECT * FROM m UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM m UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m)
SELECT name, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support::BIGINT AS support FROM a""")
def classification_report(spark, d):
    return M.report(scored(spark, d), F.col("score") >= 0.5, "label")


def _components(s: str) -> str:
    """DeLong's components of score s: for a positive the share of negatives below it, for a negative the share of positives above, ties half."""
    return f"""CASE label WHEN 1 THEN (sum(1 - label) OVER (ORDER BY {s}) - 0.5::DOUBLE * sum(1 - label) OVER (PARTITION BY {s})) / sum(1 - label) OVER ()
    ELSE (sum(label) OVER (ORDER BY {s} DESC) - 0.5::DOUBLE * sum(label) OVER (PARTITION BY {s})) / sum(label) OVER () END"""


#: What a right bootstrap must agree with: its draws are its own, so the oracle has the AUCs and their standard error, worked out from pairs.
DELONG = f"""b AS (SELECT toxic AS label, (n_chars * 7919 % 1000) / 1000.0::DOUBLE AS a, (n_chars * 104729 % 1009) / 1009.0::DOUBLE AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
v AS (SELECT label, {_components("a")} AS va, {_components("b")} AS vb FROM b)"""
_SE = "sqrt(var_samp({x}) FILTER (label = 1) / count(*) FILTER (label = 1) + var_samp({x}) FILTER (label = 0) / count(*) FILTER (label = 0))"


def _boot(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return x.select("doc_id", F.col("toxic").alias("label"), (F.col("n_chars") * 7919 % 1000 / 1000.0).alias("a"), (F.col("n_chars") * 104729 % 1009 / 1009.0).alias("b"))


def _agreement(x, value, a, b):
    """The exact figure and its standard error; whether the bootstrap's mean lies within a fifth of it, and its interval is as wide as the error says."""
    known = M.auc_gap_error(x, a, b, "label", "doc_id")
    drawn = M.interval(M.bootstrap_auc(x, ["a", "b"], "label", 1000, key="doc_id"), value)
    width = (F.col("high") - F.col("low")) / (2 * 1.959964 * F.col("se"))
    return drawn.join(F.broadcast(known)).select("rounds", C.rnd("gap", 6).alias("figure"), C.rnd("se", 6).alias("error"), (F.abs(F.col("mean") - F.col("gap")) < 0.2 * F.col("se")).alias("centred"), F.abs(width - 1).between(0, 0.2).alias("wide"))


@query(f"WITH {DELONG} SELECT 1000 AS rounds, round(avg(va - vb) FILTER (label = 1), 6) AS figure, round({_SE.format(x='va - vb')}, 6) AS error, true AS centred, true AS wide FROM v")
def bootstrap_auc_gap(spark, d):
    return _agreement(_boot(spark, d), F.col("a") - F.col("b"), "a", "b")


@query(f"WITH {DELONG} SELECT 1000 AS rounds, round(avg(va) FILTER (label = 1), 6) AS figure, round({_SE.format(x='va')}, 6) AS error, true AS centred, true AS wide FROM v")
def bootstrap_auc_interval(spark, d):
    return _agreement(_boot(spark, d), F.col("a"), "a", None)


@query("WITH m AS (SELECT event_type AS model, avg(value) AS v FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, model) AS k FROM m) SELECT max(model) FILTER (k = 1) AS best, max(model) FILTER (k = 2) AS second, round(max(v) FILTER (k = 1) - max(v) FILTER (k = 2), 6) AS gap, max(v) FILTER (k = 1) - max(v) FILTER (k = 2) < 1e-4 AS tied FROM r")
def winning_model(spark, d):
    return M.winner(table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("v")), "model", "v")


@query(f"WITH {HIST}, a AS (SELECT sum(p * (below + 0.5::DOUBLE * (n - p))) / (max(pos) * max(neg))::DOUBLE AS auc FROM c) SELECT abs(auc - round(auc, 3)) <= 0.0006 AS reproduced, abs(auc - (round(auc, 3) + 0.01)) <= 0.0006 AS other FROM a")
def auc_reproduced(spark, d):
    a = M.auc(scored(spark, d), "score", "label")
    return a.select((F.abs(F.col("auc") - F.round("auc", 3)) <= 0.0006).alias("reproduced"), (F.abs(F.col("auc") - (F.round("auc", 3) + 0.01)) <= 0.0006).alias("other"))


def _folds(spark, d):
    p = points(spark, d).withColumn("block", F.floor(F.col("x") / 10000) * 10 + F.floor(F.col("y") / 10000))
    return p.join(K.group_folds(p, "block", "label", 5), "block")


@query(None)
def group_folds(spark, d):
    return _folds(spark, d).groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.countDistinct("block").alias("blocks"))


@query("SELECT k::INT AS outer_fold, 0::BIGINT AS repeated, 0::BIGINT AS lost, 0::BIGINT AS extra FROM (SELECT unnest(range(5)) AS k)")
def fold_partition_proof(spark, d):
    f = _folds(spark, d)
    return K.partition_faults(K.memberships(f, "id", 5), f, "id")


@query("SELECT count(*) AS rows, 0::BIGINT AS faults FROM customer")
def fold_coverage_proof(spark, d):
    m = K.memberships(_folds(spark, d), "id", 5)
    faults = K.coverage_faults(m, "id").agg(F.count("*").alias("faults"))
    return m.agg(F.countDistinct("id").alias("rows")).join(F.broadcast(faults))


@query(f"""WITH {POINTS}, f AS (SELECT *, (id % 5)::INT AS fold FROM points), m AS (SELECT k::INT AS outer_fold, id, x, y, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS role FROM f, (SELECT unnest(range(5)) AS k)),
o AS (SELECT outer_fold, id, CASE WHEN role = 'train' AND EXISTS (SELECT 1 FROM m t WHERE t.outer_fold = m.outer_fold AND t.role = 'test' AND (t.x - m.x) * (t.x - m.x) + (t.y - m.y) * (t.y - m.y) <= 800 * 800) THEN 'removed' ELSE role END AS role FROM m)
SELECT outer_fold, role, count(*) AS n FROM o GROUP BY ALL""")
def buffered_plan(spark, d):
    p = points(spark, d)
    m = K.memberships(p.withColumn("fold", (F.col("id") % 5).cast("int")), "id", 5)
    return K.buffered(m, p.select("id", "x", "y"), "id", 800.0).groupBy("outer_fold", "role").agg(F.count("*").alias("n"))


#: Folds with the facts that must not cross a split: group, raster cell, event; a part of the train rows is removed.
SPLIT = f"""WITH {POINTS}, m AS (SELECT o::INT AS outer_fold, id, x, y, label, "group" AS g, floor(y / 5000)::BIGINT AS "row", floor(x / 5000)::BIGINT AS "col", CASE WHEN id % 4 = 0 THEN ' ' ELSE 'e' || (id % 50) END AS event,
CASE WHEN "group" % 5 = o THEN 'test' WHEN id % 7 = 0 THEN 'removed' ELSE 'train' END AS role FROM points, (SELECT unnest(range(5)) AS o))"""


def _split(spark, d):
    p = points(spark, d)
    m = K.memberships(p.withColumn("fold", (F.col("group") % 5).cast("int")), "id", 5)
    m = m.withColumn("role", F.when((F.col("role") == "train") & (F.col("id") % 7 == 0), "removed").otherwise(F.col("role")))
    event = F.when(F.col("id") % 4 == 0, " ").otherwise(F.concat(F.lit("e"), (F.col("id") % 50).cast("string")))
    return m, p.select("id", "x", "y", "label", "group", F.floor(F.col("y") / 5000).alias("row"), F.floor(F.col("x") / 5000).alias("col"), event.alias("event"))


@query(f"""{SPLIT}, sides AS (SELECT * FROM m WHERE role <> 'removed'), gr AS (SELECT outer_fold, count_if(s = 2)::BIGINT AS n FROM (SELECT outer_fold, g, count(DISTINCT role) AS s FROM sides GROUP BY ALL) GROUP BY 1),
ce AS (SELECT outer_fold, count_if(s = 2)::BIGINT AS n FROM (SELECT outer_fold, "row", "col", count(DISTINCT role) AS s FROM sides GROUP BY ALL) GROUP BY 1), ev AS (SELECT outer_fold, count_if(s = 2)::BIGINT AS n FROM (SELECT outer_fold, event, count(DISTINCT role) AS s FROM sides WHERE trim(event) <> '' GROUP BY ALL) GROUP BY 1),
fe AS (SELECT outer_fold, least(count_if(role = 'train' AND label = 0), count_if(role = 'train' AND label = 1)) < 6 OR least(count_if(role = 'test' AND label = 0), count_if(role = 'test' AND label = 1)) = 0 AS few FROM sides GROUP BY 1)
SELECT outer_fold, gr.n AS groups, ce.n AS cells, ev.n AS events, few AS too_few FROM gr JOIN ce USING (outer_fold) JOIN ev USING (outer_fold) JOIN fe USING (outer_fold)""")
def split_proof(spark, d):
    m, facts = _split(spark, d)
    return K.split_faults(m, facts.drop("x", "y"), "id", "group", "event", "label", 6)


@query(f"{SPLIT} SELECT a.outer_fold, round(min(sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE)), 4) AS least FROM m a JOIN m b ON a.outer_fold = b.outer_fold AND a.role = 'test' AND b.role = 'train' GROUP BY 1")
def split_distances(spark, d):
    m, facts = _split(spark, d)
    return K.least_distances(m, facts.select("id", "x", "y"), "id").select("outer_fold", C.rnd("least", 4).alias("least"))


@query("""WITH f AS (SELECT c_custkey AS id, c_custkey % 5 AS fold, c_custkey % 3 AS part FROM customer) SELECT o::INT AS outer_fold, i::INT AS inner_fold, CASE WHEN part = i THEN 'validation' ELSE 'train' END AS role, count(*) AS n FROM f, (SELECT unnest(range(5)) AS o), (SELECT unnest(range(3)) AS i) WHERE fold <> o GROUP BY ALL""")
def nested_plan(spark, d):
    c = F.col("c_custkey")
    f = table(spark, d, "customer").select(c.alias("id"), (c % 5).cast("int").alias("fold"), (c % 3).cast("int").alias("inner"))
    return K.nested_memberships(f, "id", 5, 3).groupBy("outer_fold", "inner_fold", "role").agg(F.count("*").alias("n"))


FOLDS_SQL = "f AS (SELECT event_type AS model, CASE WHEN user_id % 2 = 0 THEN 'spatial' ELSE 'random' END AS protocol, event_id % 5 AS fold, avg(value) AS mean_value, max(value) AS top FROM events GROUP BY ALL)"


def _fold_metrics(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("model"), F.when(F.col("user_id") % 2 == 0, "spatial").otherwise("random").alias("protocol"), (F.col("event_id") % 5).alias("fold")).agg(F.avg("value").alias("mean_value"), F.max("value").alias("top"))


@query(f"WITH {FOLDS_SQL}, u AS (UNPIVOT f ON mean_value, top INTO NAME metric VALUE v) SELECT model, protocol, metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max FROM u GROUP BY ALL")
def series_summary(spark, d):
    return K.series(_fold_metrics(spark, d), ["model", "protocol"], ["mean_value", "top"])


@query(f"WITH {FOLDS_SQL} SELECT model, round(avg(mean_value) FILTER (protocol = 'spatial') - avg(mean_value) FILTER (protocol = 'random'), 6) AS difference FROM f GROUP BY 1")
def protocol_difference(spark, d):
    return K.difference(_fold_metrics(spark, d), ["model"], "protocol", "spatial", "random", "mean_value")


@query(f"""WITH {SCORED}, c AS (SELECT 'm' || (suppkey % 3)::VARCHAR AS model, partkey % 5 AS fold, {CONFUSION_SQL.format(t='0.5::DOUBLE')} FROM scored GROUP BY ALL) SELECT model, fold, 'metric' AS fault FROM c WHERE fold = 3 AND model = 'm1'""")
def summary_faults(spark, d):
    s = scored(spark, d).withColumns({"model": F.concat(F.lit("m"), (F.col("suppkey") % 3).cast("string")), "fold": F.col("partkey") % 5})
    c = M.confusion(s, F.col("score") >= 0.5, "label", ["model", "fold"], digits=15)
    return K.summary_faults(c.withColumn("accuracy", F.col("accuracy") + F.when((F.col("fold") == 3) & (F.col("model") == "m1"), 0.01).otherwise(0.0)), 1e-9)
