"""Queries on files, fingerprints, audits and nested documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataspark import lifecycle as V
from strataspark.checkpoints import shared_folder
from strataspark.functions import columns as C
from strataspark.operators import quality as Q
from strataspark.plans.registry import query, table
from strataspark.sources.tables import file_inventory, inventory_faults


@query(None)
def file_fingerprints(spark, d):
    return file_inventory(spark, f"{d}/nation.parquet").unionByName(file_inventory(spark, f"{d}/region.parquet"))


#: Files of customers' numbers and names by market segment, one folder a segment; of the record one is missing, one differs, and one is of a folder that is gone.
INVENTORY_SQL = """WITH f AS (SELECT 'segment=' || c_mktsegment AS folder, sha256(string_agg(c_custkey || ',' || c_name || chr(10), '' ORDER BY c_custkey)) AS sha256, sum(length(c_custkey || ',' || c_name) + 1)::BIGINT AS bytes FROM customer GROUP BY c_mktsegment)
SELECT folder, CASE WHEN folder = (SELECT min(folder) FROM f) THEN 'new' WHEN folder = (SELECT max(folder) FROM f) THEN 'changed' ELSE 'same' END AS state, sha256, bytes FROM f UNION ALL SELECT 'segment=gone', 'missing', '0', 1"""


@query(INVENTORY_SQL)
def inventory_check(spark, d):
    """Every folder's file has the same base name or another; what tells files apart is the path below the root."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.concat_ws(",", "c_custkey", "c_name").alias("line"), "c_custkey")
    path = f"{shared_folder(spark)}/inventory-{uuid.uuid4().hex}"
    c.repartition("segment").sortWithinPartitions("segment", "c_custkey").select("segment", "line").write.partitionBy("segment").text(path)
    files = file_inventory(spark, path).where(F.col("name").contains("/part-"))
    now = files.withColumn("folder", F.substring_index("name", "/", 1))
    ends = F.broadcast(now.agg(F.min("folder").alias("a"), F.max("folder").alias("z")))
    recorded = now.join(ends).where("folder <> a").select("name", F.when(F.col("folder") == F.col("z"), "0").otherwise(F.col("sha256")).alias("sha256"), "bytes")
    recorded = recorded.unionByName(spark.createDataFrame([("segment=gone/part-0", "0", 1)], "name string, sha256 string, bytes long"))
    every = now.select("name", "sha256", "bytes").unionByName(recorded.join(now, "name", "left_anti"))
    told = every.join(inventory_faults(now.drop("folder"), recorded), "name", "left")
    return told.select(F.substring_index("name", "/", 1).alias("folder"), F.coalesce("fault", F.lit("same")).alias("state"), "sha256", "bytes")


def file_fingerprints_single(spark, d):
    """One row for each of two tables, whether each is a file or a folder of parts."""
    f = file_inventory(spark, f"{d}/nation.parquet").withColumn("name", F.lit("nation.parquet")).unionByName(file_inventory(spark, f"{d}/region.parquet").withColumn("name", F.lit("region.parquet")))
    return f.groupBy("name").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("sha256"), F.sum("bytes").alias("bytes"))


@query("SELECT * FROM (VALUES ('train', 'stale'), ('prepare', 'fresh'), ('map', 'new'), ('legacy', 'gone')) AS t(step, state)")
def step_freshness(spark, d):
    files = file_fingerprints_single(spark, d)
    make = lambda step, **settings: V.fingerprint(files, settings).select(F.lit(step).alias("step"), "fingerprint")
    now = make("prepare", size="0.3").unionByName(make("train", seed="42")).unionByName(make("map"))
    return V.freshness(now, make("prepare", size="0.3").unionByName(make("train", seed="41")).unionByName(make("legacy")))


@query("SELECT count(*) AS rows, true AS same, true AS differs FROM orders")
def prediction_identity(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    a = V.prediction_identity(o, "o_orderkey", "o_totalprice")
    b = V.prediction_identity(o.repartition(7), "o_orderkey", "o_totalprice").select(F.col("identity").alias("b"))
    c = V.prediction_identity(o.withColumn("o_totalprice", F.col("o_totalprice") + (F.col("o_orderkey") == 1).cast("int")), "o_orderkey", "o_totalprice").select(F.col("identity").alias("c"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).select("rows", (F.col("identity") == F.col("b")).alias("same"), (F.col("identity") != F.col("c")).alias("differs"))


@query("""WITH r AS (SELECT c_mktsegment AS section, CASE WHEN c_acctbal < -900 THEN 'FAIL' WHEN c_acctbal < 0 THEN 'WARN' ELSE 'OK' END AS status FROM customer)
SELECT section, count_if(status = 'OK')::BIGINT AS ok, count_if(status = 'WARN')::BIGINT AS warn, count_if(status = 'FAIL')::BIGINT AS fail, CASE WHEN count_if(status = 'FAIL') > 0 THEN 'FAIL' WHEN count_if(status = 'WARN') > 0 THEN 'WARN' ELSE 'OK' END AS worst FROM r GROUP BY 1""")
def audit_rollup(spark, d):
    status = F.when(F.col("c_acctbal") < -900, "FAIL").when(F.col("c_acctbal") < 0, "WARN").otherwise("OK")
    return Q.audit_rollup(table(spark, d, "customer").select(F.col("c_mktsegment").alias("section"), status.alias("status")))


@query("SELECT p_partkey FROM part WHERE p_partkey % 50 = 0 AND p_type <> 'PROMO'")
def dummy_activation_faults(spark, d):
    p = table(spark, d, "part").withColumn("PROMO", ((F.col("p_type") == "PROMO") | (F.col("p_partkey") % 50 == 0)).cast("double")).withColumn("SMALL", (F.col("p_type") == "SMALL").cast("double"))
    return Q.only_own_dummy(p, "p_type", {"PROMO": "PROMO", "SMALL": "SMALL"}).select("p_partkey")


@query("""WITH e AS (SELECT event_type AS model, event_id % 3 AS fold, round(avg(value), 6) AS score FROM events GROUP BY ALL) SELECT model, fold, score FROM e""")
def nested_document(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("model"), (F.col("event_id") % 3).alias("fold")).agg(C.rnd(F.avg("value")).alias("score"))
    doc = e.groupBy("model").agg(F.to_json(F.collect_list(F.struct("fold", "score"))).alias("json"))
    rows = F.explode(F.from_json("json", "array<struct<fold:long,score:double>>")).alias("f")
    return doc.select("model", rows).select("model", "f.fold", "f.score")


@query("SELECT s_suppkey % 7 AS feature, l_linenumber AS class, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def merged_class_counts(spark, d):
    parts = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))  # counts of each strip
    return parts.select((F.col("l_suppkey") % 7).alias("feature"), F.col("l_linenumber").alias("class"), "n").groupBy("feature", "class").agg(F.sum("n").alias("n"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, CASE WHEN value < 50 THEN 1 ELSE 2 END AS zone, count(*) AS n FROM events GROUP BY ALL")
def zone_counts_by_day(spark, d):
    from strataspark.streaming.windows import zone_counts

    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("value") < 50, 1).otherwise(2).alias("zone"))
    return zone_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))
