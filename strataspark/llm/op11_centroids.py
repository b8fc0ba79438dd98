"""Centroid clustering with exact assignments: screened in float32, decided in integers.

Components become integers, floor(SCALE * x), and every later step is exact:

1. A batch's inner products with all centroids are one float32 matrix product. Each product has a
   rounding-error bound, (d + 3) * 2**-24 * |x| * |c| with a margin for what the bound's own
   arithmetic rounds, so each |c|**2 - 2 x.c lies in an interval that is proven to hold it.
2. A centroid whose interval begins above another's end can't be nearest. A vector with one centroid
   left is settled; for the others the overlapping centroids alone are recomputed with integers, ties to the smaller number.
3. Each task adds up its vectors by centroid and sends one sum for each (centroid, component), as two limbs of
   a whole number, so sums are exact and don't depend on how the rows are dealt. The driver sees as many
   sums as the centroids have components, whatever the size of the table.

The centroids go to the tasks inside the function, k * d numbers. Each round reads the table again, two columns of it; nothing is kept between rounds but the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

DIM, CENTROIDS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3"
#: Rows screened at once.
ROWS = 8192
#: Integers under this have squared differences whose sum over 2**8 components fits 64 bits; others are Python's.
SMALL = 2**26
LIMB = 2**60
UNIT = 2.0**-24


def lattice(batch: pa.RecordBatch, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, whole numbers) of the rows that take part: dim components, none null or non-finite, nor beyond doubles when scaled."""
    lists = batch.column("v")
    at = np.flatnonzero(np.array(pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False)))
    flat = lists.take(pa.array(at)).flatten()
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
    ok = np.isfinite(x).all(axis=1)
    return at[ok], x[ok]


@dataclass
class Centroids:
    """Centroids as whole numbers (Python's), with what the screening needs of them."""

    rows: list[list[int]]

    def __post_init__(self):
        self.small = all(abs(c) < SMALL for row in self.rows for c in row)
        self.exact = np.array(self.rows, np.int64 if self.small else object)
        with np.errstate(over="ignore"):
            wide = np.array(self.rows, np.float64)
            self.near = wide.T.astype(np.float32)
            self.square = np.array([float(sum(c * c for c in row)) for row in self.rows])
            self.norm = np.sqrt(self.square) * (1 + 1e-12)

    def sha256(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[k])).encode()).hexdigest()


def intervals(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) around |c|**2 - 2 x.c, proven to hold it; not numbers where float32 or float64 overflow.

    With u = 2**-24, both factors' rounding to float32 and a dot product of d terms in any order err by at most
    ((1 + u)**2 * (1 + d*u / (1 - d*u)) - 1) * |x| * |c| <= (d + 3) * u * |x| * |c| for d < 2**16; whole numbers don't underflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        p = (x.astype(np.float32) @ c.near).astype(np.float64)
        reach = np.sqrt((x * x).sum(axis=1))[:, None] * (1 + 1e-9) * c.norm[None, :]
        middle = c.square[None, :] - 2 * p
        error = 2 * (x.shape[1] + 3) * UNIT * reach + 4e-15 * (c.square[None, :] + 2 * np.abs(p)) + 1e-300
        error *= 1 + 1e-9
        return middle - error, middle + error


def whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles, as int64 or, if some are large, as Python's."""
    if not len(x) or np.abs(x).max() < SMALL:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], dtype=object)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances row by row."""
    d = x - c if x.dtype == c.dtype else x.astype(object) - c.astype(object)
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, int]:
    """Each row's nearest centroid, ties to the smaller number, and how many distances had to be recomputed."""
    low, high = intervals(x, c)
    least = np.fmin.reduce(high, axis=1)
    left = ~(low > least[:, None])  # what isn't a number stays
    found = left.argmax(axis=1)
    open_rows = np.flatnonzero(left.sum(axis=1) != 1)
    if not len(open_rows):
        return found, 0
    r, k = np.nonzero(left[open_rows])
    d = distances(whole(x[open_rows])[r], c.exact[k])
    order = sorted(range(len(r)), key=lambda i: (r[i], d[i], k[i])) if d.dtype == object else np.lexsort((k, d, r))
    r, k = r[order], k[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    found[open_rows[r[first]]] = k[first]
    return found, len(r)


def _sums(c: Centroids, dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0] * len(c.rows), [[0] * dim for _ in c.rows]
        for batch in batches:
            _, every = lattice(batch, dim, scale)
            for s in range(0, len(every), ROWS):
                x = every[s : s + ROWS]
                to, _ = nearest(x, c)
                for k in np.unique(to):
                    mine = x[to == k]
                    # under 2**26 each, 8,192 of them: sums of doubles are exact
                    add = mine.sum(axis=0).astype(np.int64).tolist() if np.abs(mine).max() < SMALL else whole(mine).sum(axis=0).tolist()
                    n[k] += len(mine)
                    total[k] = [a + b for a, b in zip(total[k], add, strict=True)]
        rows = [(k, j, n[k], *divmod(total[k][j], LIMB)) for k in range(len(n)) if n[k] for j in range(dim)]
        if rows:
            k, j, m, hi, lo = zip(*rows, strict=True)
            big = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(j, pa.int32()), pa.array(m, pa.int64()), pa.array(_decimals(hi), big), pa.array(_decimals(lo), big)], names=["cluster", "at", "n", "hi", "lo"])

    return run


def _decimals(values) -> list:
    from decimal import Decimal

    return [Decimal(v) for v in values]


def _assign(c: Centroids, dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, every = lattice(batch, dim, scale)
            for s in range(0, max(1, len(every)), ROWS):
                x = every[s : s + ROWS]
                to, _ = nearest(x, c) if len(x) else (np.zeros(0, np.int64), 0)
                d = distances(whole(x), c.exact[to])
                fits = [int(v) if v < 2**63 else None for v in d] if d.dtype == object else d
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at[s : s + ROWS])), pa.array(to, pa.int32()), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def start(vectors: DataFrame, dim: int, k: int, salt: str, scale: int) -> Centroids:
    """The k vectors whose ids hash lowest; rows that share an id by their components, null ids last."""
    size = F.coalesce(F.size("v"), F.lit(-1))
    sound = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= 1.7e308 / scale), F.lit(False)))
    rows = vectors.where((size == dim) & sound).select("v", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    first = rows.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return Centroids([[int(v) for v in np.floor(np.array(r.v) * scale)] for r in first])


def fit_centroids(vectors: DataFrame, dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT, scale: int = SCALE) -> Centroids:
    """Centroids after so many rounds of assigning every vector and taking exact floors of means; empty centroids stay."""
    c = start(vectors, dim, k, salt, scale)
    for _ in range(rounds):
        if not c.rows:
            break
        sums = vectors.mapInArrow(_sums(c, dim, scale), "cluster int, at int, n long, hi decimal(38,0), lo decimal(38,0)").groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
        rows = [list(r) for r in c.rows]
        for r in sums.collect():  # k * dim rows
            rows[r["cluster"]][r["at"]] = (int(r["hi"]) * LIMB + int(r["lo"])) // r["n"]
        if rows == c.rows:
            break
        c = Centroids(rows)
    return c


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT, scale: int = SCALE) -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with another number of components, or with null or non-finite ones, have no row. Every row of df is a vector: rows that
    share an id have a row each, and a null id stays null and is drawn as a first centroid only after all others. Under k vectors make as many
    centroids. Sums and distances are exact whatever the numbers' size; a distance or sum of distances over 2**63 - 1 is null. Other columns of df don't matter. An
    empty table gives no rows."""
    vectors = df.select(df[id_col].cast("long").alias("vec_id"), df[vec_col].cast("array<double>").alias("v"))
    c = fit_centroids(vectors, dim, k, rounds, salt, scale)
    each = vectors.mapInArrow(_assign(c, dim, scale) if c.rows else _nothing, "vec_id long, cluster int, distance long")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    by = each.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), total).alias("own"))
    sums = {r["cluster"]: r["own"] for r in by.collect()}  # a row for each centroid at most
    every = None if None in sums.values() else sum(map(int, sums.values()))
    long = lambda v: None if v is None or v >= 2**63 else int(v)
    about = [(i, long(s), long(every), c.sha256(i)) for i, s in sums.items()]
    known = df.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return each.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        yield pa.RecordBatch.from_pydict({"vec_id": pa.array([], pa.int64()), "cluster": pa.array([], pa.int32()), "distance": pa.array([], pa.int64())})


def _oracle(rounds: int = ROUNDS) -> str:
    """The same clustering in SQL, a pair of steps for each round."""
    near = "SELECT vec_id, v, arg_min(cluster, d * 16 + cluster) AS cluster, min(d) AS d FROM (SELECT x.vec_id, x.v, c.cluster, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM kept x, c{n} c) GROUP BY vec_id, v"
    mean = """SELECT o.cluster, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT cluster, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster)"""
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 AS cluster, v FROM kept QUALIFY cluster < {CENTROIDS})",
    ]
    for n in range(rounds):
        steps += [f"a{n} AS MATERIALIZED ({near.format(n=n)})", f"c{n + 1} AS MATERIALIZED ({mean.format(n=n)})"]
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(n=rounds)})")
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""


ORACLE = _oracle()


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))
