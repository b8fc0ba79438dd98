"""Queries that prepare model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions import columns as C
from strataspark.operators import prep as P
from strataspark.operators.quality import findings
from strataspark.plans.registry import query, table
from strataspark.plans.samples import SCORED, scored

GAPS = "g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders)"


def gaps(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.when(k % 13 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("priority"))


@query(f"WITH {GAPS}, m AS (SELECT priority AS mode FROM g WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM g)), 6) AS price, coalesce(priority, mode) AS priority FROM g, m")
def impute_median_mode(spark, d):
    g = P.impute_categories(P.impute_numbers(gaps(spark, d), ["price"]), ["priority"])
    return g.select("o_orderkey", C.rnd("price").alias("price"), "priority")


@query("WITH k AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM part) // 25) SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM k) THEN p_brand ELSE 'Other' END AS brand FROM part")
def rare_merge(spark, d):
    p = table(spark, d, "part")
    return P.merge_rare(p, "p_brand", p.count() // 25).select("p_partkey", F.col("p_brand").alias("brand"))


@query("SELECT * FROM (SELECT 'p_type' AS \"column\", p_type AS reference, count(*) AS n FROM part GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1) UNION ALL SELECT * FROM (SELECT 'p_brand', p_brand, count(*) AS n FROM part GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)")
def reference_levels(spark, d):
    p = table(spark, d, "part")
    return P.reference_level(p, "p_type").unionByName(P.reference_level(p, "p_brand"))


@query("""WITH o AS (SELECT o_orderstatus AS s FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), l AS (SELECT unnest(['F', 'O', 'P']) AS level)
SELECT level, (SELECT s FROM o) = level AS reference, (CASE WHEN (SELECT s FROM o) = level THEN 0 ELSE (SELECT count(*) FROM orders WHERE o_orderstatus = level) END)::BIGINT AS ones FROM l""")
def one_hot(spark, d):
    o = table(spark, d, "orders")
    names = P.levels(o, "o_orderstatus")
    ref = P.reference_level(o, "o_orderstatus").first().reference
    h = P.one_hot(o, "o_orderstatus", names)
    one = h.agg(*[F.sum(F.col(f"`o_orderstatus={n}`")).cast("long").alias(n) for n in names], F.lit(0).cast("long").alias(ref))
    return one.unpivot([], [*names, ref], "level", "ones").select("level", (F.col("level") == ref).alias("reference"), "ones")


@query("""WITH p AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_extendedprice) AS n, stddev_pop(l_extendedprice) AS t FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS quantity, round((l_extendedprice - n) / t, 6) AS price, round(l_quantity, 6) AS back FROM lineitem, p""")
def standardize(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    params = P.scaling(x, ["quantity", "price"])
    z = P.scale(x, params)
    m, s = params["quantity"]
    return z.select("l_orderkey", "l_linenumber", C.rnd("quantity").alias("quantity"), C.rnd("price").alias("price"), C.rnd(F.col("quantity") * s + m).alias("back"))


@query("SELECT round(1 / (1 - power(corr(l_quantity, l_extendedprice), 2)), 5) AS vif FROM lineitem")
def vif_pair(spark, d):
    v = P.vif(P.correlation_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]))
    return spark.createDataFrame([(round(float(v[0]), 5),)], "vif double")


#: Factors of three columns by their pairwise correlations; of the columns with twin among them every collinear one is infinite and the first goes.
VIF_SQL = f"""WITH {SCORED}, r AS (SELECT corr(quantity, discount) AS qd, corr(quantity, tax) AS qt, corr(discount, tax) AS dt FROM scored),
det AS (SELECT *, 1 + 2 * qd * qt * dt - qd * qd - qt * qt - dt * dt AS d FROM r)
SELECT kept, round(v, 5) AS vif FROM (SELECT unnest(['quantity', 'discount', 'tax']) AS kept, unnest([(1 - dt * dt) / d, (1 - qt * qt) / d, (1 - qd * qd) / d]) AS v FROM det) WHERE v <= 10"""


@query(VIF_SQL)
def vif_pruned(spark, d):
    x = scored(spark, d).withColumn("twin", F.col("quantity") * 2 + F.col("tax"))
    left, _ = P.prune_vif(x, ["twin", "quantity", "discount", "tax"])
    factors = P.vif(P.correlation_matrix(x, left))
    return spark.createDataFrame([(c, round(float(v), 5)) for c, v in zip(left, factors, strict=True)], "kept string, vif double")


@query("""SELECT * FROM (SELECT 'l_quantity' AS kept, round(var_pop(l_quantity), 5) AS spread FROM lineitem UNION ALL SELECT 'one', round(var_pop(1.0), 5) FROM lineitem UNION ALL SELECT 'l_discount', round(var_pop(l_discount), 5) FROM lineitem)
WHERE spread > 1e-12""")
def varying_columns(spark, d):
    x = table(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    kept = P.varying(x, ["l_quantity", "one", "l_discount"])
    return x.agg(*[C.rnd(F.var_pop(c), 5).alias(c) for c in kept]).unpivot([], kept, "kept", "spread")


@query("""WITH h AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY (o_orderkey * 1103515245 + 42) % 2147483647) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, CASE WHEN k <= round(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM h""")
def stratified_split(spark, d):
    return P.stratified_split(table(spark, d, "orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "part")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderkey * 1103515245 + 42) % 2147483647) AS place FROM orders")
def seeded_shuffle(spark, d):
    return P.seeded_places(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "place")


@query("""WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 1), r AS (SELECT a.vec_id AS id, b.vec_id AS nid, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS k FROM m a JOIN m b ON a.vec_id <> b.vec_id)
SELECT id, k::INT AS rank, nid, round(dist, 5) AS dist FROM r WHERE k <= 5""")
def smote_neighbours(spark, d):
    m = table(spark, d, "embeddings").where("label = 1").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return P.vector_neighbours(m, 5).select("id", "rank", "nid", C.rnd("dist", 5).alias("dist"))


#: Synthetic rows from the ranks of the rows' hashes: a neighbour and a place between by hashes of row and copy.
SMOTE_SQL = """WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label % 3 AS y FROM embeddings), m AS (SELECT id, v, row_number() OVER (ORDER BY (id * 1103515245 + 42) % 2147483647, id) AS rank FROM x WHERE y = 1),
s AS (SELECT (SELECT count(*) FROM m) AS m, greatest(0, (SELECT count(*) FROM x WHERE y <> 1) - (SELECT count(*) FROM m)) AS need),
r AS (SELECT a.id, b.id AS nid, b.v AS nv, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS k FROM m a JOIN m b ON a.id <> b.id),
c AS (SELECT id, v, rank, unnest(range(1, (need // s.m + (rank <= need % s.m)::INT)::INT + 1)) AS c FROM m, s),
o AS (SELECT c.*, (((id * 131 + c) * 1103515245 + 42) % 2147483647) % 5 + 1 AS k, ((id * 977 + c) * 811297697 + 43) % 2147483647 / 2147483647.0::DOUBLE AS t FROM c)
SELECT -((c - 1) * s.m + rank) AS id, round(v[1] + t * (nv[1] - v[1]), 4) AS first, round(v[64] + t * (nv[64] - v[64]), 4) AS last, round(list_sum(list_transform(list_zip(v, nv), lambda z: z[1] + t * (z[2] - z[1]))), 4) AS total
FROM o JOIN r USING (id, k), s"""


@query(SMOTE_SQL)
def smote_points(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("label") % 3).alias("y"))
    made = P.smote(x, "y", 1).where("id < 0")
    return made.select("id", C.rnd(F.col("v")[0], 4).alias("first"), C.rnd(F.col("v")[63], 4).alias("last"), C.rnd(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("SELECT y, CASE WHEN y = 1 THEN greatest(n, o) ELSE n END AS n FROM (SELECT (label = 1)::INT AS y, count(*) AS n, (SELECT count(*) FROM embeddings WHERE label <> 1) AS o FROM embeddings GROUP BY 1)")
def smote_balance(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("label") == 1).cast("int").alias("y"))
    return P.smote(x, "y", 1).groupBy("y").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT o_orderkey AS k, o_totalprice AS price, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey::DOUBLE END AS cust, o_orderpriority AS pr FROM orders), m AS (SELECT fold, k, CASE WHEN k % 3 = fold THEN 'test' ELSE 'train' END AS role FROM f, (SELECT unnest(range(3))::INT AS fold)),
x AS (SELECT m.fold, m.k, role, price, cust, pr FROM m JOIN f USING (k)), md AS (SELECT fold, median(price) AS mp, median(cust) AS mc FROM x WHERE role = 'train' GROUP BY 1), y AS (SELECT x.fold, k, role, coalesce(price, mp) AS price, coalesce(cust, mc) AS cust, pr FROM x JOIN md ON x.fold = md.fold),
st AS (SELECT fold, avg(price) AS ap, stddev_pop(price) AS sp, avg(cust) AS ac, stddev_pop(cust) AS sc FROM y WHERE role = 'train' GROUP BY 1), kp AS (SELECT fold, pr FROM x WHERE role = 'train' GROUP BY ALL HAVING count(*) >= (SELECT count(*) FROM orders) // 8)
SELECT y.fold, k, role, round((price - ap) / sp, 5) AS price, round((cust - ac) / sc, 5) AS cust, CASE WHEN kp.pr IS NULL THEN 'Other' ELSE y.pr END AS pr FROM y JOIN st ON y.fold = st.fold LEFT JOIN kp ON kp.fold = y.fold AND kp.pr = y.pr""")
def fold_transform(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    f = o.select(k.alias("k"), F.col("o_totalprice").alias("price"), F.when(k % 9 != 0, F.col("o_custkey").cast("double")).alias("cust"), F.col("o_orderpriority").alias("pr"))
    folds = f.select("k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("fold")).select("fold", "k", F.when(F.col("k") % 3 == F.col("fold"), "test").otherwise("train").alias("role"))
    out = P.fold_transform(f, folds, "k", ["price", "cust"], "pr", f.count() // 8)
    return out.select("fold", "k", "role", C.rnd("price", 5).alias("price"), C.rnd("cust", 5).alias("cust"), "pr")


#: Three folds of orders with a number, its double (which takes the number out), a constant, an angle with flat ones, and a category with nulls and a rare level.
FULL = """f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 9 = 0 THEN -1.0::DOUBLE ELSE (o_custkey * 37 % 360)::DOUBLE END AS angle,
CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 'seldom' ELSE o_orderpriority END AS pr FROM orders),
x AS (SELECT fold, k, CASE WHEN k % 3 = fold THEN 'test' ELSE 'train' END AS role, price, 2 * price + 1 AS twin, angle, pr FROM f, (SELECT unnest(range(3))::INT AS fold)), tr AS (SELECT * FROM x WHERE role = 'train'),
md AS (SELECT fold, median(twin) AS m FROM tr GROUP BY 1), mo AS (SELECT fold, pr AS mode FROM (SELECT fold, pr, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, pr) AS r FROM tr WHERE pr IS NOT NULL GROUP BY fold, pr) WHERE r = 1),
c AS (SELECT fold, coalesce(pr, mode) AS lv, count(*) AS n FROM tr JOIN mo USING (fold) GROUP BY ALL), fq AS (SELECT fold, lv FROM c WHERE n >= (SELECT count(*) FROM orders) // 25),
y AS (SELECT x.fold, x.k, x.role, coalesce(twin, m) AS twin, CASE WHEN angle >= 0 THEN sin(radians(angle)) ELSE 0 END AS s, CASE WHEN angle >= 0 THEN cos(radians(angle)) ELSE 0 END AS co, coalesce(fq.lv, 'Other') AS lv FROM x JOIN md ON md.fold = x.fold JOIN mo ON mo.fold = x.fold LEFT JOIN fq ON fq.fold = x.fold AND fq.lv = coalesce(x.pr, mode)),
lc AS (SELECT fold, lv, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, lv) AS r FROM y WHERE role = 'train' GROUP BY fold, lv),
w AS (SELECT fold, k, role, 'twin' AS feature, twin AS v FROM y UNION ALL SELECT fold, k, role, 'angle_sin', s FROM y UNION ALL SELECT fold, k, role, 'angle_cos', co FROM y UNION ALL SELECT y.fold, k, role, 'pr=' || lc.lv, (y.lv = lc.lv)::INT::DOUBLE FROM y JOIN lc ON lc.fold = y.fold AND lc.r > 1)"""


def full_preparation(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    price = F.when(k % 11 != 0, F.col("o_totalprice"))
    f = o.select(k.alias("k"), price.alias("price"), (price * 2 + 1).alias("twin"), F.lit(3.0).alias("same"), F.when(k % 9 == 0, -1.0).otherwise((F.col("o_custkey") * 37 % 360).cast("double")).alias("angle"),
                 F.when(k % 8 == 0, None).when(k % 97 == 0, "seldom").otherwise(F.col("o_orderpriority")).alias("pr"))
    folds = f.select("k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("fold")).select("fold", "k", F.when(F.col("k") % 3 == F.col("fold"), "test").otherwise("train").alias("role"))
    return P.fold_prepare(f, folds, "k", ["price", "twin", "same"], ["angle"], ["pr"], f.count() // 25)


@query(f"WITH {FULL}, st AS (SELECT fold, feature, avg(v) AS m, stddev_pop(v) AS sd FROM w WHERE role = 'train' GROUP BY ALL) SELECT w.fold, k, role, w.feature, round((v - m) / sd, 4) AS value FROM w JOIN st ON st.fold = w.fold AND st.feature = w.feature")
def fold_transform_full(spark, d):
    rows, _ = full_preparation(spark, d)
    return rows.select("fold", "k", "role", F.explode("features").alias("feature", "value")).select("fold", "k", "role", "feature", C.rnd_fast("value", 4).alias("value"))


@query("SELECT fold, 'same' AS feature, 'constant' AS why, false AS infinite FROM (SELECT unnest(range(3))::INT AS fold) UNION ALL SELECT fold, 'price', 'inflated', true FROM (SELECT unnest(range(3))::INT AS fold)")
def fold_transform_dropped(spark, d):
    _, gone = full_preparation(spark, d)
    return gone.select("fold", "feature", "why", F.coalesce(F.col("vif") == float("inf"), F.lit(False)).alias("infinite"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 1.0 ELSE 0.0 END AS "type=PROMO", 0.0 AS "type=GONE", p_size::DOUBLE AS p_size FROM part""")
def aligned_features(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_type") == "PROMO").cast("double").alias("type=PROMO"), F.lit("extra").alias("other"))
    names = ["type=PROMO", "type=GONE", "p_size"]
    return p.select("p_partkey", *[c for c in p.columns if c != "p_partkey"]).select("p_partkey", *[(F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) if n in p.columns else F.lit(0.0)).alias(n) for n in names])


@query(f"""WITH RECURSIVE {SCORED}, q AS (SELECT quantity, count(*) AS n FROM scored GROUP BY 1), s AS (SELECT 0 AS k, -50.0::DOUBLE AS lo, 50.0::DOUBLE AS hi UNION ALL
SELECT k + 1, CASE WHEN m <= 0.3 THEN mid ELSE lo END, CASE WHEN m <= 0.3 THEN hi ELSE mid END FROM (SELECT k, lo, hi, (lo + hi) / 2 AS mid, sum(n / (1 + exp(-((quantity - 25) / 10.0::DOUBLE + (lo + hi) / 2)))) / sum(n) AS m FROM s, q WHERE k < 40 GROUP BY k, lo, hi))
SELECT 0.3::DOUBLE AS wanted, round(lo, 4) AS intercept FROM s WHERE k = 40""")
def prevalence_intercept(spark, d):
    a = P.bisect_intercept(scored(spark, d), (F.col("quantity") - 25) / 10.0, 0.3)
    return spark.createDataFrame([(0.3, round(a, 4))], "wanted double, intercept double")


@query("""WITH x AS (SELECT l_quantity AS q, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_tax END AS t, l_extendedprice AS p, 1.0 AS one, l_linenumber AS ln, (l_returnflag = 'R')::INT AS y FROM lineitem), b AS (SELECT count(*) AS n, count_if(y = 1) AS pos FROM x)
SELECT 'balance' AS rule, 'y' AS "column", round(pos::DOUBLE / n, 6) AS value, 'info' AS severity FROM b
UNION ALL SELECT 'missing', 't', round(avg((t IS NULL)::INT::DOUBLE), 6), 'warn' FROM x
UNION ALL SELECT 'impossible', 'q', count_if(q > 45)::DOUBLE, 'fail' FROM x
UNION ALL SELECT 'constant', 'one', 1.0, 'warn'
UNION ALL SELECT 'low_cardinality', 'ln', count(DISTINCT ln)::DOUBLE, 'info' FROM x
UNION ALL SELECT 'low_cardinality', 't', count(DISTINCT t)::DOUBLE, 'info' FROM x
UNION ALL SELECT 'high_correlation', 'q~p', round(abs(corr(q, p)), 6), 'warn' FROM x HAVING abs(corr(q, p)) >= 0.8""")
def quality_findings(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_tax")).alias("t"), F.col("l_extendedprice").alias("p"), F.lit(1.0).alias("one"), F.col("l_linenumber").cast("double").alias("ln"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return findings(x, ["q", "t", "p", "one", "ln"], "y", {"q": (0.0, 45.0)})


@query("SELECT * FROM (VALUES (0, 2400), (1, 1200)) AS t(label, n)")
def synthetic_terrain(spark, d):
    from strataspark.operators.synthetic import terrain

    return terrain(spark).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY (o_orderkey * 1103515245 + 42) % 2147483647) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n, count(*) OVER () AS t FROM orders)
SELECT o_orderkey, o_orderstatus FROM h WHERE k <= round(n * (500.0::DOUBLE / t))""")
def stratified_sample(spark, d):
    return P.stratified_sample(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 500)


@query("SELECT round(median(p_size), 6) AS size, round(median(p_retailprice), 6) AS price, (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p_type FROM part")
def typical_part(spark, d):
    t = P.typical_row(table(spark, d, "part"), ["p_size", "p_retailprice"], ["p_type"])
    return t.select(C.rnd("p_size").alias("size"), C.rnd("p_retailprice").alias("price"), "p_type")


@query("SELECT 'p_type' AS \"column\", list_sort(list(DISTINCT p_type)) AS known FROM part UNION ALL SELECT 'p_brand', list_sort(list(DISTINCT p_brand)) FROM part")
def class_profile(spark, d):
    return P.class_profile(table(spark, d, "part"), ["p_type", "p_brand"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY (o_orderkey * 1103515245 + 42) % 2147483647 LIMIT 1")
def hashed_example(spark, d):
    return P.row_of_class(table(spark, d, "orders").withColumn("f", (F.col("o_orderstatus") == "F").cast("int")), "o_orderkey", "f", 1).select("o_orderkey", "o_orderstatus")
