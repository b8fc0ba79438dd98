"""Queries on attribute tables: projection, filters, joins, aggregates, order, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.contract import ORDER_CONTRACT, ZONE_NAMES
from strataspark.functions import columns as C
from strataspark.operators import ordered as O
from strataspark.operators import tables as T
from strataspark.operators.raster import zone_table
from strataspark.plans.registry import query, table
from strataspark.plans.samples import SCORED, ZONE, scored
from strataspark.sources.tables import contract


@query(f"""WITH {SCORED}, z AS (SELECT n_name AS nation, {ZONE.format(s='score')} AS zone, count(*) AS c FROM scored JOIN supplier ON suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
g AS (SELECT nation, zone FROM (SELECT DISTINCT nation FROM z) CROSS JOIN (SELECT unnest(range(0, 6))::INT AS zone)),
f AS (SELECT g.nation, g.zone, coalesce(c, 0)::BIGINT AS cells FROM g LEFT JOIN z USING (nation, zone))
SELECT nation, zone, cells, round(cells * 900.0 / 1e6, 6) AS area_km2, round(CASE WHEN zone = 0 THEN NULL ELSE cells::DOUBLE / sum(CASE WHEN zone > 0 THEN cells END) OVER (PARTITION BY nation) END, 6) AS share FROM f""")
def zonal_profile(spark, d):
    s = scored(spark, d).join(table(spark, d, "supplier"), F.col("suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return zone_table(s.select(F.col("n_name").alias("nation"), C.zone("score").alias("zone")), "nation")


@query("""SELECT o_orderkey, 'ORD-' || o_orderkey::VARCHAR AS order_id, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority_rank,
CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_totalprice END AS total, 1 AS class FROM orders""")
def contract_project(spark, d):
    o = contract(table(spark, d, "orders"), ORDER_CONTRACT)
    raw = F.when(F.col("o_orderkey") % 37 == 0, -9999.0).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("order_id"), C.number(F.substring("o_orderpriority", 1, 1)).alias("priority_rank"), F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("status"), C.missing(raw).alias("total"), F.lit(1).alias("class"))


HOLES = "holes AS (SELECT l_returnflag AS flag, CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE l_quantity END AS quantity, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount END AS discount, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_tax END AS tax FROM lineitem)"


def holes(spark, d):
    gap = lambda key, k, c: F.when(F.col(key) % k != 0, F.col(c))
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), gap("l_orderkey", 37, "l_quantity").alias("quantity"), gap("l_partkey", 11, "l_discount").alias("discount"), gap("l_suppkey", 7, "l_tax").alias("tax"))


@query(f"""WITH {HOLES}, m AS (SELECT count(*) AS n, unnest([{{'c': 'quantity', 'm': count(*) - count(quantity)}}, {{'c': 'discount', 'm': count(*) - count(discount)}}, {{'c': 'tax', 'm': count(*) - count(tax)}}]) AS s FROM holes)
SELECT s.c AS "column", s.m AS n_missing, round(s.m * 100.0::DOUBLE / n, 4) AS pct_missing FROM m""")
def missing_report(spark, d):
    return T.missing_report(holes(spark, d), ["quantity", "discount", "tax"])


@query(f"""WITH {HOLES}, m AS (SELECT flag, unnest([{{'c': 'quantity', 'm': count(*) - count(quantity)}}, {{'c': 'discount', 'm': count(*) - count(discount)}}, {{'c': 'tax', 'm': count(*) - count(tax)}}]) AS s FROM holes GROUP BY flag)
SELECT flag, s.c AS "column", s.m AS n_missing FROM m""")
def missing_by_class(spark, d):
    return T.missing_by_class(holes(spark, d), "flag", ["quantity", "discount", "tax"])


@query(f"WITH {HOLES} SELECT count_if(quantity IS NULL OR discount IS NULL OR tax IS NULL)::BIGINT AS any_missing, count_if(quantity IS NULL AND discount IS NULL AND tax IS NULL)::BIGINT AS all_missing, count_if(quantity IS NOT NULL AND discount IS NOT NULL AND tax IS NOT NULL)::BIGINT AS complete FROM holes")
def missing_any_all(spark, d):
    h = holes(spark, d)
    null = [F.col(c).isNull() for c in ("quantity", "discount", "tax")]
    return h.agg(F.count_if(null[0] | null[1] | null[2]).alias("any_missing"), F.count_if(null[0] & null[1] & null[2]).alias("all_missing"), F.count_if(~(null[0] | null[1] | null[2])).alias("complete"))


@query("SELECT count(*) AS n, count_if(toxic = 0)::BIGINT AS negatives, count_if(toxic = 1)::BIGINT AS positives, round(count_if(toxic = 0)::DOUBLE / nullif(count_if(toxic = 1), 0), 6) AS ratio, round(100.0::DOUBLE * count_if(toxic = 1) / nullif(count(*), 0), 6) AS pct_positive FROM labels")
def class_balance(spark, d):
    return T.class_balance(table(spark, d, "labels"), "toxic")


@query("SELECT count_if(quality = 1 AND toxic = 1)::BIGINT AS both, count_if(quality = 1 AND toxic = 0)::BIGINT AS only_quality, count_if(quality = 0 AND toxic = 1)::BIGINT AS only_toxic, count_if(quality = 0 AND toxic = 0)::BIGINT AS neither FROM labels")
def cross_flags(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, d, "labels").agg(F.count_if(q & t).alias("both"), F.count_if(q & ~t).alias("only_quality"), F.count_if(~q & t).alias("only_toxic"), F.count_if(~q & ~t).alias("neither"))


@query("SELECT p_type AS type, count(*) AS n, round(avg((l_returnflag = 'R')::INT::DOUBLE), 6) AS rate, count(DISTINCT l_returnflag = 'R') = 1 AS pure FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def rate_by_class(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return T.rate_by_class(j.select(F.col("p_type").alias("type"), (F.col("l_returnflag") == "R").cast("int").alias("y")), "type", "y")


@query("SELECT p_brand, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY 1 HAVING count(*) < 0.05 * (SELECT count(*) FROM part)")
def rare_value_shares(spark, d):
    return T.value_shares(table(spark, d, "part"), "p_brand").where("share < 0.05")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def value_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query(f"""WITH {SCORED}, u AS (SELECT label, unnest([{{'c': 'quantity', 'v': quantity}}, {{'c': 'price', 'v': price}}, {{'c': 'discount', 'v': CASE WHEN discount > 0 THEN discount END}}]) AS s FROM scored)
SELECT s.c AS "column", round(corr(s.v, label), 6) AS r, round(avg(s.v) FILTER (label = 0), 4) AS mean_0, round(avg(s.v) FILTER (label = 1), 4) AS mean_1, count(s.v) AS n FROM u WHERE s.v IS NOT NULL GROUP BY 1 ORDER BY abs(r) DESC""")
def point_biserial(spark, d):
    s = scored(spark, d).withColumn("discount", F.when(F.col("discount") > 0, F.col("discount")))
    return T.correlations(s, ["quantity", "price", "discount"], "label").orderBy(F.abs("r").desc())


@query("""SELECT unnest(['l_quantity', 'l_quantity', 'l_quantity', 'l_extendedprice', 'l_extendedprice', 'l_discount']) AS a, unnest(['l_extendedprice', 'l_discount', 'l_tax', 'l_discount', 'l_tax', 'l_tax']) AS b,
unnest([round(corr(l_quantity, l_extendedprice), 6), round(corr(l_quantity, l_discount), 6), round(corr(l_quantity, l_tax), 6), round(corr(l_extendedprice, l_discount), 6), round(corr(l_extendedprice, l_tax), 6), round(corr(l_discount, l_tax), 6)]) + 0.0 AS r FROM lineitem""")
def corr_pairs(spark, d):
    return T.correlation_pairs(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""")
def spearman(spark, d):
    return T.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("""WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m, var_pop(p_retailprice) AS v FROM part GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS mm FROM g)
SELECT round(sum(n * (m - mm) * (m - mm)) / (sum(n * (m - mm) * (m - mm)) + sum(n * v)), 6) AS r2 FROM g, t""")
def explained_by_category(spark, d):
    return T.explained_by_category(table(spark, d, "part"), "p_retailprice", "p_brand")


@query("WITH y AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS s FROM events GROUP BY ALL) SELECT user_id, round(avg(s), 6) AS mean_total, count(*) AS days FROM y GROUP BY 1")
def mean_of_daily_totals(spark, d):
    days = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("s"))
    return days.groupBy("user_id").agg(C.rnd(F.avg("s"), 6).alias("mean_total"), F.count("*").alias("days"))


@query("""SELECT event_type, round(min(value), 6) AS q00, round(quantile_cont(value, 0.05), 6) AS q05, round(median(value), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95, round(max(value), 6) AS q100 FROM events GROUP BY 1""")
def quantile_profile(spark, d):
    return T.quantiles(table(spark, d, "events"), "event_type", "value")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
SELECT user_id, event_type AS mode, n FROM r WHERE k = 1""")
def mode_by_user(spark, d):
    return T.mode_by(table(spark, d, "events"), ["user_id"], "event_type")


@query("""SELECT * FROM (SELECT 'l_quantity' AS "column", count(DISTINCT l_quantity) AS n_values, var_pop(l_quantity) <= 1e-12 AS constant FROM lineitem UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), var_pop(l_linenumber) <= 1e-12 FROM lineitem UNION ALL SELECT 'one', count(DISTINCT l_orderkey * 0), var_pop(l_orderkey * 0) <= 1e-12 FROM lineitem)""")
def constant_columns(spark, d):
    x = table(spark, d, "lineitem").withColumn("one", F.col("l_orderkey") * 0)
    cols = ["l_quantity", "l_linenumber", "one"]
    one = x.agg(*[F.struct(F.countDistinct(c).alias("n"), F.var_pop(c).alias("v")).alias(c) for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in cols]))
    return one.select(rows.alias("x")).select("x.column", F.col("x.s.n").alias("n_values"), (F.col("x.s.v") <= 1e-12).alias("constant"))


@query("SELECT coalesce(sum(c - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey, l_suppkey, l_returnflag)")
def duplicate_rows(spark, d):
    return T.duplicate_rows(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag"])


@query("""WITH g AS (SELECT user_id, event_type, date_trunc('hour', ts) AS hour, min(event_id) AS event_id, count(DISTINCT floor(value / 50)) AS kinds FROM events GROUP BY ALL)
SELECT user_id, event_type, event_id FROM g WHERE kinds = 1""")
def keep_first_drop_conflicts(spark, d):
    e = table(spark, d, "events").withColumns({"level": F.floor(F.col("value") / 50), "hour": F.date_trunc("hour", "ts")})
    return T.keep_first(e, ["user_id", "event_type", "hour"], ["level"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT p_partkey, length(rtrim(split_part(p_retailprice::VARCHAR, '.', 2), '0')) AS digits FROM part WHERE length(rtrim(split_part(p_retailprice::VARCHAR, '.', 2), '0')) < 2")
def few_decimals(spark, d):
    return table(spark, d, "part").select("p_partkey", C.decimals("p_retailprice").alias("digits")).where("digits < 2")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def top_orders(spark, d):
    from pyspark.sql import Window

    best = O.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 15, F.desc("o_totalprice"), "o_orderkey")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")))  # of 15 rows


@query("SELECT c_nationkey, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS best, max(c_acctbal) AS balance FROM customer GROUP BY 1")
def best_candidate(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct((-F.col("c_acctbal")).alias("b"), F.col("c_custkey").alias("k"))).alias("best"), F.max("c_acctbal").alias("balance"))


@query("SELECT event_id, (dense_rank() OVER (ORDER BY user_id) - 1)::BIGINT AS group_id FROM events")
def dense_group_ids(spark, d):
    return O.dense_ids(table(spark, d, "events"), "user_id", "group_id").select("event_id", "group_id")


@query("""SELECT p_partkey, round(1 / (1 + exp(-(p_size - 25) / 10.0::DOUBLE)), 6) AS sigmoid, round(exp(-0.5::DOUBLE * ((p_size - 25) / 8.0::DOUBLE) * ((p_size - 25) / 8.0::DOUBLE)), 6) AS bump, least(greatest(p_retailprice, 950.0::DOUBLE), 1200.0::DOUBLE) AS clipped, floor(p_retailprice / 100)::BIGINT AS bin,
round(sqrt(p_size * p_size + 9.0::DOUBLE), 6) AS hypot, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug, round(ln(p_size) + tan(p_size / 100.0::DOUBLE), 6) AS lntan, round((p_size - 10.0::DOUBLE) / nullif(p_size + 10.0::DOUBLE, 0), 6) AS nd, round(p_size * 900.0::DOUBLE / 1e6, 6) AS km2, round_even(p_retailprice / 10, 0) AS even, printf('%.2f%%', p_size / 60.0::DOUBLE * 100) AS pct, sha256('{"k":' || p_partkey::VARCHAR || ',"s":' || p_size::VARCHAR || '}') AS h,
least(greatest(10 + round((p_size - 10) / 5.0::DOUBLE) * 5.0::DOUBLE, 10.0::DOUBLE), 45.0::DOUBLE) AS snapped FROM part""")
def scalar_functions(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", C.rnd(C.sigmoid((s - 25) / 10.0)).alias("sigmoid"), C.rnd(C.bump(s, 25, 8.0)).alias("bump"), C.clip("p_retailprice", 950.0, 1200.0).alias("clipped"), C.grid_index("p_retailprice", 0.0, 100.0).alias("bin"),
        C.rnd(F.hypot(s.cast("double"), F.lit(3.0))).alias("hypot"), C.slug("p_type").alias("slug"), C.rnd(F.log(s) + F.tan(s / 100.0)).alias("lntan"), C.rnd(C.normalized_difference(s, F.lit(10.0))).alias("nd"), C.rnd(C.cells_km2(s)).alias("km2"),
        C.half_even(F.col("p_retailprice") / 10, 0).alias("even"), C.percent(s / 60.0).alias("pct"), C.json_hash(s=s, k=F.col("p_partkey")).alias("h"), C.snap(s, 10.0, 45.0, 5.0).alias("snapped"),
    )


@query("""SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') = '' AS blank, sha256(replace(text, chr(13) || chr(10), chr(10))) AS h,
replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM documents""")
def text_functions(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", (C.ascii_fold(t) == "").alias("blank"), C.text_hash(t).alias("h"), C.html_escape(t).alias("html"))


@query("SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS folded FROM documents")
def ascii_folding(spark, d):
    return table(spark, d, "documents").select("doc_id", C.ascii_fold("text").alias("folded"))


@query("""WITH m AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE (hour(ts) * 60 + minute(ts)) / 4.0::DOUBLE END AS a FROM events)
SELECT event_id, round(CASE WHEN a >= 0 THEN sin(radians(a)) ELSE 0 END, 6) + 0.0 AS s, round(CASE WHEN a >= 0 THEN cos(radians(a)) ELSE 0 END, 6) + 0.0 AS c, CASE WHEN a = 0 THEN -1.0 WHEN a <= 90 THEN 90 - a ELSE 450 - a END AS compass FROM m""")
def circular_encode(spark, d):
    a = F.when(F.col("event_id") % 17 != 0, (F.hour("ts") * 60 + F.minute("ts")) / 4.0)
    s, c = C.circular(a)
    return table(spark, d, "events").select("event_id", C.rnd(s).alias("s"), C.rnd(c).alias("c"), C.compass(a).alias("compass"))


@query("""WITH t AS (SELECT n_nationkey, (CASE WHEN n_nationkey % 2 = 0 THEN 'N' ELSE 'S' END) || lpad(n_nationkey::VARCHAR, 2, '0') || (CASE WHEN n_nationkey % 3 = 0 THEN 'W' ELSE 'E' END) || lpad((n_nationkey * 5)::VARCHAR, CASE WHEN n_nationkey = 7 THEN 2 ELSE 3 END, '0') AS name FROM nation)
SELECT name, CASE WHEN ok THEN CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE -n_nationkey END END AS lat, CASE WHEN ok THEN CASE WHEN n_nationkey % 3 = 0 THEN -n_nationkey * 5 ELSE n_nationkey * 5 END END AS lon, ok AS valid FROM (SELECT *, regexp_full_match(name, '[NS][0-9]{2}[EW][0-9]{3}') AS ok FROM t)""")
def tile_names(spark, d):
    k = F.col("n_nationkey")
    name = F.concat(F.when(k % 2 == 0, "N").otherwise("S"), F.lpad(k.cast("string"), 2, "0"), F.when(k % 3 == 0, "W").otherwise("E"), F.when(k == 7, F.lpad((k * 5).cast("string"), 2, "0")).otherwise(F.lpad((k * 5).cast("string"), 3, "0")))
    lat, lon = C.tile_corner("name")
    return table(spark, d, "nation").select(name.alias("name")).select("name", lat.alias("lat"), lon.alias("lon"), F.col("name").rlike(r"^[NS]\d{2}[EW]\d{3}$").alias("valid"))


@query("SELECT count(*) AS kept, (SELECT count(*) FROM orders WHERE o_orderkey % 29 <> 0 AND o_orderstatus IN ('F', 'P')) AS removed FROM orders WHERE o_orderkey % 29 = 0 OR o_orderstatus NOT IN ('F', 'P')")
def exclusion_filter(spark, d):
    status = F.when(F.col("o_orderkey") % 29 != 0, F.col("o_orderstatus"))
    out = status.isin("F", "P") & status.isNotNull()
    return table(spark, d, "orders").agg(F.count_if(~F.coalesce(out, F.lit(False))).alias("kept"), F.count_if(out).alias("removed"))


@query("SELECT count_if(c_acctbal < 0)::BIGINT AS below, count_if(c_acctbal > 9000)::BIGINT AS above, count_if(c_acctbal BETWEEN 0 AND 9000)::BIGINT AS inside, count_if(lower(trim(c_mktsegment)) = 'building')::BIGINT AS building FROM customer")
def range_violations(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").agg(F.count_if(b < 0).alias("below"), F.count_if(b > 9000).alias("above"), F.count_if(b.between(0, 9000)).alias("inside"), F.count_if(F.lower(F.trim("c_mktsegment")) == "building").alias("building"))


LEGEND = [(1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, "five")]
LEGEND_SQL = "legend AS (SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, 'three'), (4, 'four'), (5, 'five')) AS t(code, name))"


@query(f"WITH {LEGEND_SQL} SELECT coalesce(name, 'Unknown') AS name, count(*) AS n FROM lineitem LEFT JOIN legend ON l_linenumber = code GROUP BY 1")
def code_lookup(spark, d):
    legend = spark.createDataFrame(LEGEND, "code int, name string")
    return T.lookup(table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "code"), "code", F.broadcast(legend), "name", "Unknown").groupBy("name").agg(F.count("*").alias("n"))


@query(f"WITH {LEGEND_SQL} SELECT l_linenumber AS code, count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (SELECT code FROM legend) GROUP BY 1")
def unknown_codes(spark, d):
    return T.unknown_codes(table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "code"), "code", spark.createDataFrame(LEGEND, "code int, name string"))


@query("""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS f, o_totalprice + CASE WHEN o_custkey % 40 = 0 THEN 1 WHEN o_custkey % 40 = 1 THEN 1e-9 ELSE 0 END AS q FROM orders WHERE o_custkey % 20 <> 7)
SELECT 'left_only' AS "check", count(*) AS n FROM orders WHERE o_custkey % 20 = 7 UNION ALL SELECT 'right_only', 0 UNION ALL
SELECT 'f', count_if(b.f <> a.o_orderstatus)::BIGINT FROM b JOIN orders a USING (o_orderkey) UNION ALL SELECT 'q', count_if(abs(b.q - a.o_totalprice) > 1e-6)::BIGINT FROM b JOIN orders a USING (o_orderkey)""")
def table_compare(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("f"), F.col("o_totalprice").alias("q"))
    b = a.where("o_custkey % 20 <> 7").withColumn("f", F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("f"))).withColumn("q", F.col("q") + F.when(F.col("o_custkey") % 40 == 0, 1).when(F.col("o_custkey") % 40 == 1, 1e-9).otherwise(0))
    return T.compare_tables(a, b, ["o_orderkey"], ["f"], {"q": 1e-6})


@query("SELECT doc_id, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def lookup_default(spark, d):
    return T.lookup(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), "toxic", -1)


@query("SELECT 'documents' AS frame, count(*) AS rows, count(DISTINCT doc_id) AS keys, 0 AS foreign FROM documents UNION ALL SELECT 'labels', count(*), count(DISTINCT doc_id), count_if(doc_id NOT IN (SELECT doc_id FROM documents)) FROM labels")
def aligned_tables(spark, d):
    return T.aligned({"documents": table(spark, d, "documents"), "labels": table(spark, d, "labels")}, "doc_id")


@query("SELECT m AS model, p AS protocol, f::INT AS fold FROM (SELECT unnest(['svm', 'rf', 'gbt']) AS m), (SELECT unnest(['spatial', 'random']) AS p), (SELECT unnest(range(5)) AS f)")
def job_grid(spark, d):
    one = spark.range(1)
    return one.select(F.explode(F.array(*map(F.lit, ("svm", "rf", "gbt")))).alias("model"), F.lit(1)).select("model", F.explode(F.array(F.lit("spatial"), F.lit("random"))).alias("protocol")).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def semi_join_members(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(n, "c_nationkey", "left_semi").select("c_custkey")


@query("SELECT p_partkey, list_position(['PROMO', 'STANDARD', 'SMALL'], p_type)::INT AS place FROM part")
def permutation_place(spark, d):
    order = spark.createDataFrame([(k + 1, t) for k, t in enumerate(("PROMO", "STANDARD", "SMALL"))], "place int, p_type string")
    return T.lookup(table(spark, d, "part"), "p_type", F.broadcast(order), "place").select("p_partkey", "place")


@query("SELECT (SELECT sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag))::BIGINT AS parts, (SELECT count(*) FROM lineitem) AS whole, true AS equal")
def parts_reconcile(spark, d):
    li = table(spark, d, "lineitem")
    parts = li.groupBy("l_returnflag").agg(F.count("*").alias("n")).agg(F.sum("n").alias("parts"))
    return parts.join(F.broadcast(li.agg(F.count("*").alias("whole")))).withColumn("equal", F.col("parts") == F.col("whole"))


@query("""WITH p AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_discount) AS c, max(l_discount) AS e FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 AND l_discount >= 0.02)
SELECT 'l_quantity' AS "column", round(avg((l_quantity < a OR l_quantity > b)::INT::DOUBLE), 6) AS share FROM lineitem, p UNION ALL SELECT 'l_discount', round(avg((l_discount < c OR l_discount > e)::INT::DOUBLE), 6) FROM lineitem, p""")
def out_of_range_share(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_discount")
    return T.out_of_range_share(li, T.training_profile(li.where("l_quantity BETWEEN 5 AND 40 AND l_discount >= 0.02"), li.columns), li.columns)


@query("SELECT 'c' || c_custkey::VARCHAR AS key, c_nationkey AS nation, 1 AS class FROM customer UNION ALL SELECT 's' || s_suppkey::VARCHAR, s_nationkey, 0 FROM supplier")
def union_classes(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_nationkey").alias("nation"), F.lit(1).alias("class"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_nationkey").alias("nation"), F.lit(0).alias("class"))
    return T.union_all([c, s])


@query("""WITH n AS (SELECT i::BIGINT AS i, j::BIGINT AS j FROM (SELECT unnest(range(40)) AS i), (SELECT unnest(range(40)) AS j) WHERE i + j < 60), h AS (SELECT DISTINCT c_custkey % 41 AS i, c_custkey * 7 % 43 AS j FROM customer)
SELECT coalesce(n.i, h.i) AS i, coalesce(n.j, h.j) AS j, CASE WHEN n.i IS NULL THEN 'extra' WHEN h.i IS NULL THEN 'missing' ELSE 'present' END AS status FROM n FULL JOIN h ON n.i = h.i AND n.j = h.j""")
def tile_set_differences(spark, d):
    k = F.col("c_custkey")
    need = spark.range(40).withColumnRenamed("id", "i").select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("j")).where("i + j < 60")
    return T.set_differences(need, table(spark, d, "customer").select((k % 41).alias("i"), (k * 7 % 43).alias("j")))


@query("""SELECT p_brand, round(avg(p_retailprice) FILTER (p_type = 'PROMO'), 4) AS "PROMO", round(avg(p_retailprice) FILTER (p_type = 'SMALL'), 4) AS "SMALL", round(avg(p_retailprice) FILTER (p_type = 'LARGE'), 4) AS "LARGE" FROM part GROUP BY 1""")
def metric_pivot(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").pivot("p_type", ["PROMO", "SMALL", "LARGE"]).agg(C.rnd(F.avg("p_retailprice"), 4))
    return p


@query("SELECT event_type, round(avg(value) - stddev_samp(value), 4) AS low, round(avg(value), 4) AS mean, round(avg(value) + stddev_samp(value), 4) AS high FROM events GROUP BY 1")
def error_bars(spark, d):
    m, s = F.avg("value"), F.stddev_samp("value")
    return table(spark, d, "events").groupBy("event_type").agg(C.rnd(m - s, 4).alias("low"), C.rnd(m, 4).alias("mean"), C.rnd(m + s, 4).alias("high"))


@query("SELECT (props->>'$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1")
def json_property(spark, d):
    return table(spark, d, "events").select(F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS a, least(p_size / 45.0::DOUBLE, 1.0) AS b, (p_retailprice - 900) / 1200 AS c FROM part)
SELECT p_partkey, (CASE WHEN {a} = {b} AND {b} = {c} THEN 'same class' ELSE 'different classes' END) || ', ' || ((a >= 0.5)::INT + (b >= 0.5)::INT + (c >= 0.5)::INT)::VARCHAR || ' of 3 decide for it' AS said FROM s""".format(a=ZONE.format(s="a"), b=ZONE.format(s="b"), c=ZONE.format(s="c")))
def agreement_text(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", C.agreement([s / 50.0, F.least(s / 45.0, F.lit(1.0)), (F.col("p_retailprice") - 900) / 1200]).alias("said"))


@query("SELECT zone, name FROM (VALUES (1, 'Very Low'), (2, 'Low'), (3, 'Moderate'), (4, 'High'), (5, 'Very High')) AS t(zone, name)")
def zone_legend(spark, d):
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, ZONE_NAMES))).alias("p", "name")).select((F.col("p") + 1).alias("zone"), "name")


@query("SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'balance below 0' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment not allowed' END, CASE WHEN c_nationkey > 20 THEN 'nation above 20' END], lambda x: x IS NOT NULL) AS errors FROM customer")
def input_errors(spark, d):
    checks = F.array(F.when(F.col("c_acctbal") < 0, "balance below 0"), F.when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "segment not allowed"), F.when(F.col("c_nationkey") > 20, "nation above 20"))
    return table(spark, d, "customer").select("c_custkey", F.array_compact(checks).alias("errors"))
