"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets.

1. Vectors that are the same collapse to one, their smallest id.
2. Each vector is turned by three rounds of random signs and a fast Hadamard transform, K times for each
   of L tables; a turn's code is its largest coordinate and that one's sign, a bucket K codes. Besides its
   own bucket a vector enters the PROBES buckets that lie nearest: one code replaced by that turn's second or third
   largest coordinate, least difference first. K grows with the logarithm of the table, so that
   a vector meets few strangers; L follows from how often pairs right at the threshold share a bucket,
   measured on random pairs, so that all tables together miss such a pair once in a million.
3. Buckets never make pairs. In LEADERS rounds, each bucket's smallest id leads: the others are verified against it, in double precision. Those over
   the threshold have their link and leave the bucket with the leader. Those within twice the threshold's angle, the
   border, stay, and are noted: two linked vectors of one bucket of which one left with a leader are both in its ball or border.
   What is left in a bucket after these rounds (many that are alike, though under the threshold) is verified in full, block by block.
4. Borders are verified against the balls they belong to, block by block. So every two linked vectors that share a
   bucket end in one component of verified links.
5. Inside a component all vectors are verified against one another, in blocks of BLOCK, and only sums of links
   come out: links that hashing missed inside a component count as well.

No step makes a row for each pair of a group. Many copies of nearly one vector are one ball: one round, then blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import acos, ceil, cos, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.operators.graph import components

from .common import NULL_ID, cut, read, skew_join
from .op7_ngram_join import _forest
from .vectors import finite, matrix

THRESHOLD, PROBES, MISS, STRANGERS, SEED = 0.95, 4, 1e-6, 1.0, 29
LEAST_DIM, MOST_CODES, ROWS, BLOCK, BIN, LEADERS = 64, 8, 2048, 1024, 4096, 4


def hadamard(y: np.ndarray) -> np.ndarray:
    """Rows turned by the (unscaled) Hadamard matrix of their length, a power of two."""
    n, d = y.shape
    h = 1
    while h < d:
        y = y.reshape(n, d // (2 * h), 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return y


def padded(dim: int) -> int:
    return max(LEAST_DIM, 1 << (dim - 1).bit_length())


def codes(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(codes, differences) of one turn of unit rows: the codes of the three largest coordinates, and how far the second and third stand below the first."""
    v, d = x, x.shape[1]
    for _ in range(3):
        v = hadamard(v * rng.choice(np.array([-1, 1], np.float32), d)) / np.float32(d**0.5)
    size = np.abs(v)
    at = np.argpartition(-size, 2, axis=1)[:, :3]
    top = np.take_along_axis(size, at, 1)
    order = np.argsort(-top, axis=1, kind="stable")
    at, top = np.take_along_axis(at, order, 1), np.take_along_axis(top, order, 1)
    return at * 2 + (np.take_along_axis(v, at, 1) < 0), top[:, :1] - top[:, 1:]


def _mixed(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def buckets(x: np.ndarray, dim: int, k: int, tables: int, first: int = 0) -> np.ndarray:
    """A row of tables * (1 + PROBES) bucket keys for each row of x: its own bucket and the nearest ones."""
    size, out = padded(dim), []
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay in range
    unit = np.zeros((len(x), size), np.float32)
    unit[:, :dim] = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    rows = np.arange(len(x))
    for t in range(first, first + tables):
        rng = np.random.default_rng([SEED, size, k, t])
        turns = [codes(unit, rng) for _ in range(k)]
        code = np.stack([c for c, _ in turns], axis=1)
        far = np.concatenate([f for _, f in turns], axis=1)
        start = np.full(len(x), (dim << 40) ^ (k << 32) ^ t, np.uint64)
        picks = [code[:, :, 0]]
        for j in np.argsort(far, axis=1, kind="stable")[:, :PROBES].T:
            other = code[:, :, 0].copy()
            other[rows, j // 2] = code[rows, j // 2, j % 2 + 1]
            picks.append(other)
        for pick in picks:
            h = start
            for i in range(k):
                h = _mixed(h, pick[:, i])
            out.append(h)
    return np.stack(out, axis=1).view(np.int64)


@cache
def plan(n: int, dim: int, threshold: float) -> tuple[int, int]:
    """(K, L): codes in a bucket and tables, for n vectors. Bounded work: 1,000 random pairs at the threshold for each K."""
    size = padded(dim)
    rng = np.random.default_rng([SEED, size])
    x, z = rng.normal(size=(2, 1000, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = threshold * x + (1 - threshold**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    for k in range(2, MOST_CODES + 1):
        a, b = (buckets(v, size, k, 3, 1 << 20).reshape(1000, 3, 1 + PROBES) for v in (x, y))
        meets = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)).mean()
        tables = max(1, ceil(log(MISS) / log(max(1e-12, 1 - meets)))) if meets > 0.01 else 1400
        if n * tables * (1 + PROBES) ** 2 / (2.0 * size) ** k <= STRANGERS:
            break
    return k, tables


def _keyed(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                sizes = part.column("v").value_lengths().to_numpy()
                for dim in np.unique(sizes):
                    some = part.take(pa.array(np.flatnonzero(sizes == dim)))
                    x = matrix(some.column("v"))
                    k, tables = plan(n, int(dim), threshold)
                    keys = buckets(x, int(dim), k, tables)
                    whole = np.ascontiguousarray(x + 0.0)  # no negative zeros
                    digest = [hashlib.sha256(row.tobytes()).digest() for row in whole]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([some.column("_id"), pa.array(digest, pa.binary()), some.column("v"), lists], names=["_id", "digest", "v", "keys"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _judge(threshold: float):
    """2 for pairs at the threshold, 1 for those within twice its angle, else 0."""
    border = cos(min(np.pi, 2 * acos(threshold))) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("v"), batch.column("w")
            sizes = a.value_lengths().to_numpy()
            score = np.full(batch.num_rows, -2.0)
            for dim in np.unique(sizes):
                at = np.flatnonzero((sizes == dim) & (b.value_lengths().to_numpy() == dim))
                take = pa.array(at)
                score[at] = (_unit(matrix(a.take(take))) * _unit(matrix(b.take(take)))).sum(axis=1) if len(at) else 0
            kind = (score >= threshold).astype(np.int32) + (score >= border)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("least"), pa.array(kind, pa.int32())], names=["_id", "least", "kind"])

    return run


def _units(threshold: float, forest: bool):
    """Links of a unit's blocks: inside a group each node's links by weight, across sides a spanning forest of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in pdf.sort_values(["_group", "_id"], kind="stable").groupby("_group", sort=False):
            x, ids, n, side = _unit(np.stack(part["v"].to_numpy())), part["_id"].to_numpy(np.int64), part["n"].to_numpy(np.int64), part["side"].to_numpy()
            apart = bool(part["two"].iloc[0])
            first, second = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if apart else (np.arange(len(x)),) * 2
            alive = x[first] @ x[second].T >= threshold
            if forest:
                u, v = _forest(ids[first[np.nonzero(alive)[0]]], ids[second[np.nonzero(alive)[1]]])
                found.append(pd.DataFrame({"node": u, "links": 0, "to": v}))
                continue
            if not apart:
                np.fill_diagonal(alive, False)
            sums = np.zeros(len(x), np.int64)
            sums[first] += alive @ n[second]
            if apart:
                sums[second] += alive.T @ n[first]
            found.append(pd.DataFrame({"node": ids, "links": sums, "to": ids}))
        return pd.concat(found) if found else pd.DataFrame({"node": [], "links": [], "to": []}).astype("int64")

    return run


def _blocks(members: DataFrame, vecs: DataFrame, threshold: float, two: bool, forest: bool) -> DataFrame:
    """(node, links, to) over the groups of members (group, _id, side, n): all pairs of a group or, if two, those across its sides, block by block.

    Sums of links by node or, if forest, links that span what is linked."""
    sizes = cut(members.groupBy("group").agg(F.ceil(F.count_if(F.col("side") == 0) / BLOCK).alias("b0"), F.ceil(F.count_if(F.col("side") == 1) / BLOCK).alias("b1"), F.count("*").alias("rows")))
    if two:
        sizes = sizes.where("b0 > 0 and b1 > 0")
    small = (F.col("b0") <= 1) & (F.col("b1") <= 1)
    bins = max(1, -(-(sizes.agg(F.sum(F.when(small, F.col("rows")))).first()[0] or 0) // BIN))
    rows = skew_join(members, sizes, "group", "rows", sizes.agg(F.sum("rows")).first()[0] or 0)
    mine = F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))
    block = F.pmod(F.xxhash64("_id"), mine)
    rows = rows.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), (F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b0")) if two else F.col("b0")) - 1)))
    if two:
        low, high, side, across = F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("with")), F.when(F.col("side") == 0, F.col("with")).otherwise(F.col("block")), F.col("side"), F.lit(True)
    else:
        low, high, side, across = F.least("block", "with"), F.greatest("block", "with"), (F.col("block") > F.col("with")).cast("int"), F.col("block") != F.col("with")
    bin_of = F.when(small, F.pmod(F.xxhash64("group"), F.lit(bins))).otherwise(F.col("group"))
    units = rows.select("_id", "n", F.col("group").alias("_group"), low.alias("low"), high.alias("high"), side.alias("side"), across.alias("two"), bin_of.alias("_bin"), small.alias("_small")).join(vecs, "_id")
    return units.groupBy("_small", "_bin", "low", "high").applyInPandas(_units(threshold, forest), "node long, links long, to long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    n_links is the number of other vectors with cosine at or over threshold (above 0), copies included; component_id the smallest vec_id that links
    connect with; kept marks vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different lengths with each other. Rows that share a vec_id count as one vector, the least of their sound
    ones, and each has its result; a null vec_id counts as -2**63, smaller than all others, and its vec_id stays null. Other columns of df
    don't matter. An empty table gives no rows."""
    kind = "float" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    base = df.select(F.coalesce(df[id_col].cast("long"), F.lit(NULL_ID)).alias("_id"), df[id_col].cast("long").alias("vec_id"), df[vec_col].cast(f"array<{kind}>").alias("v"))
    sound = base.where((F.size("v") > 0) & finite(F.col("v")) & F.exists("v", lambda c: c != 0)).groupBy("_id").agg(F.min("v").alias("v"))
    n = base.count()
    each = cut(sound.mapInArrow(_keyed(n, threshold), f"_id long, digest binary, v array<{kind}>, keys array<long>"))
    copies = cut(each.groupBy("digest").agg(F.min("_id").alias("rep"), F.count("*").alias("n")))
    vecs = each.select("_id", "v")
    reps = copies.select(F.col("rep").alias("_id"), "n")
    held = each.join(reps, "_id").select("_id", F.explode("keys").alias("key"))

    def led(members: DataFrame) -> DataFrame:
        least = members.groupBy("key").agg(F.min("_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
        return cut(members.join(least, "key").where("_id <> least"))

    judged, rest = None, led(held)
    for _ in range(LEADERS):
        if not rest.first():
            break
        pairs = rest.select("_id", "least").distinct().join(vecs, "_id").join(vecs.toDF("least", "w"), "least")
        now = cut(pairs.mapInArrow(_judge(threshold), "_id long, least long, kind int"))
        judged = now if judged is None else judged.union(now)
        left = rest.join(now.where("kind < 2"), ["_id", "least"]).select("_id", "key")
        rest = led(left)
    if judged is None:
        found = df.sparkSession.createDataFrame([], "_id long, comp long, links long")
    else:
        linked = judged.where("kind = 2").select("_id", F.col("least").alias("group"))
        leaders = linked.select("group").distinct()
        border = judged.where("kind = 1").select("_id", F.col("least").alias("group")).join(leaders, "group", "left_semi").select("_id", "group")
        sides = linked.withColumn("side", F.lit(0)).union(border.withColumn("side", F.lit(1))).select("group", "_id", "side", F.lit(1).cast("long").alias("n"))
        across = _blocks(sides, vecs, threshold, two=True, forest=True).select("node", "to")
        edges = linked.select(F.col("_id").alias("node"), F.col("group").alias("to")).union(across)
        if rest.first():
            dense = rest.select(F.col("key").alias("group"), "_id").union(rest.select("key", "least")).distinct()
            edges = edges.union(_blocks(dense.select("group", "_id", F.lit(0).alias("side"), F.lit(1).cast("long").alias("n")), vecs, threshold, two=False, forest=True).select("node", "to"))
        edges = cut(edges)
        groups = cut(components(edges, "node", "to"))
        members = groups.withColumnRenamed("node", "_id").join(reps, "_id").select(F.col("comp").alias("group"), "_id", F.lit(0).alias("side"), "n")
        counts = _blocks(members, vecs, threshold, two=False, forest=False).groupBy("node").agg(F.sum("links").alias("links"))
        found = groups.join(counts, "node", "left").select(F.col("node").alias("_id"), "comp", "links")
    known = copies.join(found.withColumnRenamed("_id", "rep"), "rep", "left").select("digest", "n", F.coalesce("comp", "rep").alias("component_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    mine = skew_join(each.select("_id", "digest"), known, "digest", "n", n).select("_id", "n_links", "component_id")
    out = base.select("_id", "vec_id").join(mine, "_id", "left")
    component = F.coalesce("component_id", "_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("_id") == component).alias("kept"))


ORACLE = """
WITH sound AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a, sound b WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a) SELECT a, min(b) AS least FROM r GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(r.least, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(r.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts ON counts.a = e.vec_id LEFT JOIN reach r ON r.a = e.vec_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
