"""Approximate nearest neighbours by inner product: stable projections, a kd-tree, and a chi-square stopping test.

1. A vector x becomes (x, sqrt(M**2 - |x|**2)) with M the largest norm, a query (q, 0): the largest inner product is then the smallest
   distance d, d**2 = M**2 + |q|**2 - 2 q.x. Gaussian (2-stable) projections to DIMS dimensions make |p(x) - p(q)|**2 / d**2 chi-square
   with DIMS degrees of freedom.
2. A kd-tree is fitted on at most SAMPLE projected vectors; every vector is indexed by its leaf. Leaves with more than 2 * LEAF vectors are
   split by a hash of the id, so equal vectors don't fill one.
3. A query goes to leaves by the distance of their boxes from its projection, in rounds: the nearest, then up to the fourth, then all
   others. d is its k-th distance over the rounds before. It goes to a leaf only if the box is within
   radius**2 = quantile(CONFIDENCE) * d**2. It is sent once to each bundle of BUNDLE leaves side by side, with the leaves that it goes to;
   of a bundle there is one copy for each QUERY_BLOCK queries that go there. Queries are dealt out in pieces of bounded size.
4. In a leaf, vectors are verified nearest projections first, BATCH at a time; products of others are never computed. Each batch may
   lower d. A query stops once the next projection lies beyond the radius: a true neighbour is then missed with
   probability 1 - CONFIDENCE at most.
5. The leaves' lists (at most k per leaf, none worse than d) are merged.

Driver and tasks hold the tree and the leaves' boxes: at most SAMPLE / 8 leaves of 2 * DIMS numbers, whatever the table's size.
On vectors without structure the k-th distance is near the mean one, so many vectors must be verified: verified says how many.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read, slots
from .vectors import QUERY_BLOCK, matrix, ranked, vectors

DIMS, SAMPLE, LEAF, CONFIDENCE, BATCH, SEED = 16, 20_000, 512, 0.85, 32, 5
#: Leaves that share a task; distances of queries to a leaf's vectors, and of queries to leaves with their copies, that a task has at once; products summed at once.
BUNDLE, AT_ONCE, DEALT, SUMMED = 8, 1 << 19, 1 << 18, 1 << 14
#: Tasks for each slot of the cluster.
TASKS = 8
#: Leaves by nearness at which a round ends and the bounds are merged; a last round goes to all others within the radius.
ROUNDS = (1, 4)
K, QUERY_MOD = 20, 20


def chi2_cdf(x: float, dims: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def chi2_quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1.0
    while chi2_cdf(hi, dims) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dims) < p else (lo, mid)
    return hi


def fit_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A complete kd-tree as a heap of (dimension, value): each node splits its widest dimension at the median."""
    nodes: list[tuple[int, float]] = []
    level = [points]
    while 2 * len(level) <= leaves:
        then = []
        for p in level:
            d = int(np.argmax(p.max(0) - p.min(0))) if len(p) else 0
            v = float(np.median(p[:, d])) if len(p) else 0.0
            nodes.append((d, v))
            then += [p[p[:, d] < v], p[p[:, d] >= v]]
        level = then
    return nodes


def leaf_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    dims, values = (np.array(x) for x in zip(*nodes, strict=True)) if nodes else (np.zeros(0, int), np.zeros(0))
    for _ in range((len(nodes) + 1).bit_length() - 1):
        at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] >= values[at])
    return at - len(nodes)


def _projector(dim: int, dims: int, most: float, seed: int):
    g = np.random.default_rng(seed).standard_normal((dim + 1, dims))

    def project(v: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, most**2 - (v * v).sum(1)))
        return np.column_stack([v, rest]) @ g

    return project


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of components, so equal vectors get equal scores."""
    return np.cumsum(q * v, axis=1)[:, -1]


def nearest_first(q: np.ndarray, pq: np.ndarray, me: np.ndarray, bound: np.ndarray, v: np.ndarray, pv: np.ndarray, ids: np.ndarray, k: int, most2: float, quantile: float) -> tuple[np.ndarray, np.ndarray]:
    """Verifies a leaf's vectors for some queries, nearest projections first, each until the stopping test holds.

    ids rise. Returns products (-inf: not verified) and the k-th largest product known of each query, at least bound."""
    apart = np.maximum(0, (pq * pq).sum(1)[:, None] + (pv * pv).sum(1)[None] - 2 * pq @ pv.T)
    apart = np.where(me[:, None] == ids[None], np.inf, np.round(apart, 9))  # equal vectors are equally far, so smaller ids come first
    order = np.argsort(apart, axis=1, kind="stable")
    apart = np.take_along_axis(apart, order, 1)
    base = most2 + (q * q).sum(1)
    bound, top, scores = bound.copy(), np.full((len(q), k), -np.inf), np.full(apart.shape, -np.inf)
    for at in range(0, len(ids), BATCH):
        with np.errstate(invalid="ignore"):
            radius = np.where(np.isinf(bound), np.inf, quantile * np.maximum(0, base - 2 * bound) * (1 + 1e-9) + 1e-9)
        live = np.flatnonzero((apart[:, at] <= radius) & np.isfinite(apart[:, at]))
        if not len(live):
            break
        near = order[live, at : at + BATCH]
        found = np.where(np.isfinite(apart[live, at : at + BATCH]), np.matmul(v[near], q[live][:, :, None])[:, :, 0], -np.inf)
        scores[live[:, None], near] = found
        both = np.concatenate([top[live], found], axis=1)
        top[live] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
        bound[live] = np.maximum(bound[live], top[live].min(1))
    return scores, bound


def _foremost(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k highest scores, ties to smaller ids, by row and from the highest down."""
    o = np.lexsort((ids, -score, row))
    return o[np.arange(len(o)) - np.searchsorted(row[o], row[o]) < k]


def search_ann(vecs: DataFrame, queries: DataFrame, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE, sample: int = SAMPLE, leaf: int = LEAF, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): each query's k largest inner products found, ties to smaller vec_id; how many products were computed for it.

    Both tables have (vec_id long, v array<double>), ids unique, as vectors() makes them. A query's own id is no candidate. With
    fewer than k candidates all are returned; empty tables give no rows."""
    spark = vecs.sparkSession
    head = vecs.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.first(F.size("v")).alias("dim")).first()
    if not head.n or not queries.count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    project = _projector(head.dim, dims, float(np.sqrt(head.m)), seed)
    most2, quantile = head.m, chi2_quantile(confidence, dims)
    # of the smallest hashes; those that surely are too large stay where they are
    share = (sample + 6 * sample**0.5 + 10) / head.n
    some = vecs.where(F.xxhash64("vec_id") < int(2**64 * share) - 2**63) if share < 1 else vecs
    seen = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    nodes = fit_tree(project(matrix(seen["v"]), False), min(-(-head.n // leaf), sample // 8))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = project(matrix(b.column("v")), False)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(leaf_of(p, nodes), pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], names=["vec_id", "v", "leaf", "p"])

    placed = cut(vecs.mapInArrow(place, "vec_id long, v array<double>, leaf long, p array<double>"))
    box = [f(F.col("p")[i]) for f in (F.min, F.max) for i in range(dims)]
    boxes = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.array(*box).alias("box")).orderBy("leaf").collect()  # at most sample / 8
    leaves = np.array([b.leaf for b in boxes])
    low, high = np.array([b.box[:dims] for b in boxes]), np.array([b.box[dims:] for b in boxes])
    bundles, starts = np.unique(leaves // BUNDLE, return_index=True)
    bits = 1 << (leaves % BUNDLE)
    salts = -(-np.add.reduceat(np.array([b.n for b in boxes]), starts) // (2 * leaf * BUNDLE))

    def by_bundle(values: np.ndarray):
        """A column of one number for each bundle, by the bundle's number."""
        known = dict(zip(bundles.tolist(), values.tolist(), strict=True))
        return F.element_at(F.array(*[F.lit(known.get(i, 0)) for i in range(int(bundles[-1]) + 1)]), (F.col("bundle") + 1).cast("int"))

    def reached(batches: Iterator[pa.RecordBatch], first: int, last: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Queries in pieces of so few rows that their copies stay within a number, and for each row and bundle the bits of the leaves that it goes to: of the leaves by nearness from first to last, those within the radius."""
        step = max(1, DEALT // max(len(leaves), int(salts.sum()) * BUNDLE))
        for whole in batches:
            for n in range(0, whole.num_rows, step):
                b = whole.slice(n, step)
                q = matrix(b.column("v"))
                p, bound = project(q, True), b.column("bound").to_numpy(zero_copy_only=False)
                dist = np.zeros((len(q), len(leaves)))
                for d in range(dims):
                    dist += np.maximum(0, np.maximum(low[None, :, d] - p[:, None, d], p[:, None, d] - high[None, :, d])) ** 2
                rank = np.argsort(np.argsort(dist, axis=1, kind="stable"), axis=1)
                with np.errstate(invalid="ignore"):
                    radius = np.where(np.isinf(bound), np.inf, quantile * np.maximum(0, most2 + (q * q).sum(1) - 2 * bound) * (1 + 1e-9) + 1e-9)
                goes = (rank >= first) & (rank < (len(leaves) if last is None else last)) & (dist <= radius[:, None])
                yield b, np.add.reduceat(goes * bits, starts, axis=1)

    def tally(first: int, last: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(((goes > 0).sum(0) for _, goes in reached(batches, first, last)), np.zeros(len(bundles), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(bundles))), pa.array(total, pa.int64())], names=["at", "n"])

        return run

    def route(first: int, last: int | None, groups: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, goes in reached(batches, first, last):
                row, at = np.nonzero(goes)
                times = salts[at]
                salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, at = np.repeat(row, times), np.repeat(at, times)
                group = b.column("hash").to_numpy()[row] % groups[at]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row, pa.int64())) for c in ("query_id", "v", "bound")), *(pa.array(x, pa.int64()) for x in (goes[row, at], bundles[at], salt, group))], names=["query_id", "v", "bound", "goes", *keys])

        return run

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Queries against a part of a bundle, leaf by leaf, so many queries at a time that the matrices are bounded."""
        if left.empty or right.empty:
            return pd.DataFrame([], columns=["query_id", "top", "verified"], dtype=object)
        right = right.sort_values(["leaf", "vec_id"])
        v, pv, ids, leaf_ = matrix(right["v"]), matrix(right["p"]), right["vec_id"].to_numpy(np.int64), right["leaf"].to_numpy(np.int64)
        q, me, bound, goes = matrix(left["v"]), left["query_id"].to_numpy(np.int64), left["bound"].to_numpy(float), left["goes"].to_numpy(np.int64)
        pq, verified, found = project(q, True), np.zeros(len(q), np.int64), []
        for at in np.unique(leaf_):
            a, b = np.searchsorted(leaf_, [at, at + 1])
            asks = np.flatnonzero(goes >> (at % BUNDLE) & 1)
            step = max(1, AT_ONCE // (b - a))
            for n in range(0, len(asks), step):
                i = asks[n : n + step]
                scores, least = nearest_first(q[i], pq[i], me[i], bound[i], v[a:b], pv[a:b], ids[a:b], k, most2, quantile)
                verified[i] += (scores > -np.inf).sum(1)
                with np.errstate(invalid="ignore"):
                    least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), least)
                row, at_ = np.nonzero((scores > -np.inf) & (scores >= least[:, None]))
                row, at_ = i[row], a + at_
                exact = np.concatenate([_products(q[row[m : m + SUMMED]], v[at_[m : m + SUMMED]]) for m in range(0, len(row), SUMMED)] or [np.zeros(0)])
                o = _foremost(row, exact, ids[at_], k)
                found.append((row[o], exact[o], ids[at_][o]))
        row, exact, near = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        o = _foremost(row, exact, near, k)
        ends = np.searchsorted(row[o], np.arange(len(q) + 1))
        told = [{"score": s, "vec_id": x} for s, x in zip(exact[o].tolist(), near[o].tolist(), strict=True)]
        some = np.flatnonzero(verified)
        return pd.DataFrame({"query_id": me[some], "top": pd.Series([told[ends[i] : ends[i + 1]] for i in some], dtype=object), "verified": verified[some]})

    keys, parts = ["bundle", "salt", "q_group"], TASKS * slots(spark)  # by work: by bytes Spark would take few tasks
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", F.shiftrightunsigned(F.xxhash64(F.col("vec_id"), F.lit(1)), 1).alias("hash"))
    found = spark.createDataFrame([], "query_id long, top array<struct<score:double,vec_id:long>>, verified long")
    for first, last in zip((0, *ROUNDS), (*ROUNDS, None), strict=True):
        known = ranked(found, k, "double").where(F.col("rank") == k).select("query_id", F.col("score").alias("known"))
        bound = cut(asked.join(known, "query_id", "left").select("query_id", "v", "hash", F.coalesce("known", F.lit(float("-inf"))).alias("bound")).repartition(parts, "query_id"))
        counts = np.zeros(len(bundles), np.int64)
        for r in bound.mapInArrow(tally(first, last), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row for each bundle
            counts[r["at"]] = r.n
        groups = -(-counts // QUERY_BLOCK)
        if not groups.any():
            continue
        held = placed.withColumn("bundle", F.floor(F.col("leaf") / BUNDLE)).where(by_bundle(groups) > 0)
        copies = held.select("vec_id", "v", "p", "leaf", "bundle", F.pmod(F.xxhash64("vec_id"), by_bundle(salts)).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), by_bundle(groups).cast("long") - 1)).alias("q_group"))
        sent = bound.mapInArrow(route(first, last, groups), "query_id long, v array<double>, bound double, goes long, bundle long, salt long, q_group long")
        met = sent.repartition(parts, *keys).groupBy(*keys).cogroup(copies.repartition(parts, *keys).groupBy(*keys)).applyInPandas(meet, "query_id long, top array<struct<score:double,vec_id:long>>, verified long")
        found = found.union(cut(met))
    return ranked(found, k, "double", F.sum("verified").alias("verified")).withColumn("rank", F.col("rank").cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    table = cut(vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero=False))
    return search_ann(table, table.where(F.col("vec_id") % QUERY_MOD == 0))
