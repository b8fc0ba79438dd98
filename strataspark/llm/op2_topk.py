"""Exact top-k by inner product: norm buckets, with length or coordinate pruning from local cosine thresholds.

1. Vectors are cut by length into buckets (approximate quantiles of all lengths); a bucket's rows are dealt into parts of about PART by a hash
   of the id, so vectors of one length don't fill a task.
2. Each query is answered exactly in one part of the longest bucket; its k-th product is theta.
3. It then goes to the other parts of buckets with |q| * longest >= theta. A part is copied once for each QUERY_BLOCK queries that
   go there, and not at all if none does. In a part, its local cosine threshold is
   t = theta / (|q| * longest). If t is at or under LOW, candidates are cut by length: |v| >= theta / |q|. If it is higher, by
   coordinates: on the query's largest unit components, a unit vector with cosine >= t lies within q_f * t +- sqrt((1 - t**2)(1 - q_f**2)).
   What is left is verified by its whole product; theta rises with what is found.
4. The parts' lists (at most k, none under theta) are merged. Nothing that could be among the k is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read
from .vectors import QUERY_BLOCK, best, matrix, ranked, vectors

PART, MAX_BUCKETS, LOW, FOCUS, EPS, AT_ONCE = 2048, 64, 0.3, 4, 1e-9, 256
K, QUERY_MOD = 5, 50
BOUND = 2.0**53


def _integer_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact products of each row of q with each of v: in doubles while these can hold every sum, else in Python's integers, held within a long."""
    if np.abs(q).sum(1).max(initial=0) * np.abs(v).max(initial=0) < BOUND:
        return (q @ v.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in v], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def survivors(q: np.ndarray, theta: np.ndarray, v: np.ndarray, norms: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Which vectors (columns) may reach a query's theta (rows): cut by length, and by coordinates where the local cosine threshold is over LOW."""
    length, longest = np.sqrt((q * q).sum(1)), float(norms.max(initial=0))
    can = (theta > 0) & (length > 0) & (longest > 0)
    safe = np.where(can, length, 1)
    t = np.where(can, theta / (safe * max(longest, 1e-300)) * (1 - EPS), 0)
    keep = norms[None, :] >= np.where(can, theta / safe * (1 - EPS), -1)[:, None]
    keep[t > 1] = False
    at = np.flatnonzero((t > LOW) & (t <= 1))
    if len(at):
        u = q[at] / safe[at, None]
        for f in np.argsort(-np.abs(u), axis=1)[:, :FOCUS].T:
            x = np.take_along_axis(u, f[:, None], 1)[:, 0]
            half = np.sqrt((1 - t[at] ** 2) * np.maximum(0, 1 - x * x)) + EPS
            of = unit.T[f] * np.where(x >= 0, 1, -1)[:, None]
            keep[at] &= of >= (np.abs(x) * t[at] - half)[:, None]
    return keep


def search_topk(vecs: DataFrame, queries: DataFrame, k: int = K, part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, score long): each query's k highest inner products of whole-number vectors, ties to smaller vec_id.

    Both tables have (vec_id long, v array<double>) with whole components, ids unique. A query's own id is no candidate; with fewer than
    k candidates all are returned. Zero vectors take part with product 0. Products beyond a long are held at its ends."""
    spark = vecs.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, n_queries = vecs.count(), queries.count()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lengths = vecs.select("vec_id", "v", norm.alias("norm"))
    buckets = min(MAX_BUCKETS, max(1, n // (4 * part)))
    edges = sorted(set(lengths.approxQuantile("norm", [i / buckets for i in range(1, buckets)], 0.1 / buckets))) if buckets > 1 else []
    of = sum((F.when(F.col("norm") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    bucketed = cut(lengths.withColumn("bucket", of))
    stats = {r.bucket: r for r in bucketed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}  # at most MAX_BUCKETS
    parts = {b: max(1, -(-r.n // part)) for b, r in stats.items()}
    n_parts = F.element_at(F.array(*[F.lit(parts.get(b, 1)) for b in range(len(edges) + 1)]), F.col("bucket") + 1)
    placed = bucketed.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_parts))
    top_bucket = max(stats)

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Queries against a part, AT_ONCE queries at a time, which bounds the matrices."""
        out = []
        if not left.empty and not right.empty:
            v, ids, norms = matrix(right["v"]), right["vec_id"].to_numpy(np.int64), right["norm"].to_numpy(float)
            unit = v / np.where(norms > 0, norms, 1)[:, None]
            for a in range(0, len(left), AT_ONCE):
                few = left.iloc[a : a + AT_ONCE]
                q, me, theta = matrix(few["v"]), few["query_id"].to_numpy(np.int64), few["theta"].to_numpy(float)
                keep = survivors(q, theta, v, norms, unit) & (me[:, None] != ids[None, :])
                some = np.flatnonzero(keep.any(0))
                if not len(some):
                    continue
                s = _integer_products(q, v[some])  # of vectors that some query needs
                for i in range(len(q)):
                    at = np.flatnonzero(keep[i, some] & (s[i] >= theta[i]))
                    at = at[best(s[i][at], ids[some][at], k)]
                    if len(at):
                        out.append((me[i], [{"score": int(x), "vec_id": int(y)} for x, y in zip(s[i][at], ids[some][at], strict=True)]))
        return pd.DataFrame(out, columns=["query_id", "top"], dtype=object)

    def reached(b: pa.RecordBatch) -> dict[int, np.ndarray]:
        """Rows of queries that go to each bucket."""
        q, theta = matrix(b.column("v")), b.column("theta").to_numpy(zero_copy_only=False)
        length = np.sqrt((q * q).sum(1))
        return {bucket: np.flatnonzero((theta <= 0) | (length * r.longest * (1 + EPS) >= theta)) for bucket, r in stats.items()}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(stats, 0)
        for b in batches:
            for bucket, row in reached(b).items():
                total[bucket] += len(row)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the parts that they go to after the first."""
        for b in batches:
            rows, bs, ps = [], [], []
            for bucket, row in reached(b).items():
                for p in range(bucket == top_bucket, parts[bucket]):
                    rows.append(row)
                    bs.append(np.full(len(row), bucket))
                    ps.append(np.full(len(row), p))
            row, bs, ps = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (rows, bs, ps))
            group = b.column("hash").to_numpy()[row] % np.array([groups.get(x, 1) for x in range(len(edges) + 1)])[bs]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("query_id", "v", "theta")), pa.array(bs, pa.int32()), pa.array(ps, pa.int64()), pa.array(group, pa.int64())], names=["query_id", "v", "theta", *keys])

    none = F.lit(-(2.0**63))
    keys = ["bucket", "part", "q_group"]
    tops = "query_id long, top array<struct<score:long,vec_id:long>>"
    copies = lambda df, n: df.withColumn("q_group", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", F.shiftrightunsigned(F.xxhash64(F.col("vec_id"), F.lit(1)), 1).alias("hash"))
    first_groups = F.lit(-(-n_queries // QUERY_BLOCK)).cast("long")
    sent = asked.select("query_id", "v", none.alias("theta"), F.lit(top_bucket).alias("bucket"), F.lit(0).cast("long").alias("part"), F.pmod("hash", first_groups).alias("q_group"))
    part = copies(placed.where((F.col("bucket") == top_bucket) & (F.col("part") == 0)), first_groups)
    first = cut(sent.groupBy(*keys).cogroup(part.groupBy(*keys)).applyInPandas(meet, tops))
    known = first.select("query_id", F.when(F.size("top") >= k, F.col("top")[k - 1]["score"].cast("double")).alias("known"))
    again = cut(asked.join(known, "query_id", "left").select("query_id", "v", "hash", F.coalesce("known", none).alias("theta")))
    n_to = {r.bucket: r.n for r in again.mapInArrow(tally, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most MAX_BUCKETS
    groups = {b: -(-n // QUERY_BLOCK) for b, n in n_to.items() if n}
    n_groups = F.element_at(F.array(*[F.lit(groups.get(b, 0)).cast("long") for b in range(len(edges) + 1)]), F.col("bucket") + 1)
    rest = again.mapInArrow(route, "query_id long, v array<double>, theta double, bucket int, part long, q_group long").groupBy(*keys).cogroup(copies(placed.where(n_groups > 0), n_groups).groupBy(*keys)).applyInPandas(meet, tops)
    return ranked(first.union(rest), k, "long").withColumn("rank", F.col("rank").cast("int"))


def integers(vecs: DataFrame, scale: int = 256) -> DataFrame:
    """Components as whole numbers, floor(scale * x)."""
    return vecs.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


ORACLE = """
WITH i AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
      FROM i q JOIN i c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def query(spark, sf_dir: str) -> DataFrame:
    table = cut(integers(vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero=True)))
    return search_topk(table, table.where(F.col("vec_id") % QUERY_MOD == 0))
