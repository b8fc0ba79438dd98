"""N-gram Jaccard join with Bayesian pruning of candidates.

1. Texts that are the same (SHA-256) collapse to one, their smallest doc_id.
2. Each text gets HASHES MinHash values of its five-word shingles, in one pass; BANDS keys of ROWS
   values each find what may be alike. Texts that share a key, directly or through others, form a candidate group:
   a text is tied to the smallest doc_id of each of its keys, never to all of them.
3. Groups are cut into blocks of at most BLOCK texts or BLOCK_BYTES; each pair of blocks is a task's
   unit, so a large group spreads over many tasks. There, all pairs' MinHash values are compared STEP by STEP; a pair is
   dropped when the posterior probability (uniform prior) of reaching the threshold falls below TOLERANCE. The rest is
   verified on whole shingle sets. A unit returns each text's number of links and the links of a
   spanning forest, never the pairs themselves.
4. Links are summed by text; components of the forest edges are the near-duplicate groups.

With 32 bands of 5, a pair at similarity 0.8 is missed with probability 3e-6, at 0.85 with 2e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.operators.graph import components

from .common import NULL_ID, cut, read, skew_join, slots, small_batches, text_of
from .shingles import bands, chunks, minhash, shingles

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 32, 5, 32, 1e-6
HASHES = BANDS * ROWS
BLOCK, BLOCK_BYTES, BIN = 1024, 4 << 20, 2000


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column("text")):
            run, counts = shingles(data, offsets, WIDTH)
            keys = bands(minhash(run, counts, HASHES), ROWS)
            has = counts > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]), pa.int32()), pa.array(keys[has].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("_id")[a:b], batch.column("digest")[a:b], pa.array(np.diff(offsets), pa.int64()), lists], names=["doc_id", "_id", "digest", "n_bytes", "keys"])


@cache
def fewest(n: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values of n with which P(similarity >= threshold) is at least tolerance.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1); its upper tail is P(Binomial(n + 1, threshold) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _candidates(x: np.ndarray, y: np.ndarray, alive: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that outlast the pruning, compared STEP values at a time."""
    same = np.zeros(alive.shape, np.uint16)
    for n in range(STEP, HASHES + 1, STEP):
        for k in range(n - STEP, n):
            same += x[:, k, None] == y[None, :, k]
        alive &= same >= fewest(n, threshold, tolerance)
        if np.count_nonzero(alive) * 8 < alive.size:
            break
    i, j = np.nonzero(alive)
    m = same[i, j].astype(np.int64)
    for n in range(n + STEP, HASHES + 1, STEP):
        m += (x[i, n - STEP : n] == y[j, n - STEP : n]).sum(1)
        stay = m >= fewest(n, threshold, tolerance)
        i, j, m = i[stay], j[stay], m[stay]
    return i, j


def _common(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles each pair shares: set by set if pairs are few, else by products of slabs of the incidence matrix."""
    if len(i) <= 4 * (len(x) + len(y)):
        return np.array([len(np.intersect1d(x[a], y[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    ux, uy = np.unique(np.concatenate(x)), np.unique(np.concatenate(y))
    shared = np.intersect1d(ux, uy, assume_unique=True)
    places = []
    for sets in (x, y):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, flat)
        ok = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == flat) if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[ok], kind="stable")
        places.append((row[ok][order], at[ok][order]))
    both = np.zeros((len(x), len(y)), np.float32)
    for k in range(0, len(shared), 2048):
        slabs = []
        for (row, at), n in zip(places, (len(x), len(y)), strict=True):
            lo, hi = np.searchsorted(at, [k, k + 2048])
            slab = np.zeros((n, min(2048, len(shared) - k)), np.float32)
            slab[row[lo:hi], at[lo:hi] - k] = 1
            slabs.append(slab)
        both += slabs[0] @ slabs[1].T
    return both[i, j].astype(np.int64)


def links(x: tuple[np.ndarray, np.ndarray, list], y: tuple[np.ndarray, np.ndarray, list] | None, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that reach the threshold: of x and y, or within x (the first before the second). A part is (ids, MinHash values, sets)."""
    ids, values, sets = x
    other, values2, sets2 = x if y is None else y
    alive = ids[:, None] != other[None, :]
    if y is None:
        alive &= np.arange(len(ids))[:, None] < np.arange(len(ids))[None, :]
    i, j = _candidates(values, values2, alive, threshold, tolerance)
    if not len(i):
        return i, j
    n = np.array([len(s) for s in sets])[i] + np.array([len(s) for s in sets2])[j]
    common = _common(sets, sets2, i, j)
    ok = common >= threshold * (n - common) - 1e-9
    return i[ok], j[ok]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) with the same components as the links a-b."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q, label = inv[: len(a)], inv[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[p], label[q])
        after = label.copy()
        np.minimum.at(after, p, low)
        np.minimum.at(after, q, low)
        after = after[after]
        if (after == label).all():
            return nodes[label != np.arange(len(nodes))], nodes[label[label != np.arange(len(nodes))]]
        label = after


def _unit(threshold: float, tolerance: float):
    def parts(pdf: pd.DataFrame):
        """Ids, MinHash values and sorted shingle sets of a unit's texts."""
        values, sets = [], []
        for _, _, data, offsets in chunks(pa.array(pdf["text"], pa.string())):
            run, counts = shingles(data, offsets, WIDTH)
            values.append(minhash(run, counts, HASHES))
            sets += [np.unique(s) for s in np.split(run, np.cumsum(counts)[:-1])]
        return pdf["_id"].to_numpy(np.int64), np.concatenate(values), sets

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        pdf = pdf.sort_values(["comp", "block", "_id", "text"], kind="stable").drop_duplicates(["comp", "block", "_id", "text"])
        for _, part in pdf.groupby("comp", sort=False):
            ids, values, sets = parts(part)
            if part["two"].iloc[0]:
                first = part["block"].to_numpy() == part["low"].to_numpy()
                x, y = ((ids[m], values[m], [s for s, keep in zip(sets, m, strict=True) if keep]) for m in (first, ~first))
                i, j = links(x, y, threshold, tolerance) if first.any() and not first.all() else (np.empty(0, int),) * 2
                a, b = x[0][i], y[0][j]
            else:
                i, j = links((ids, values, sets), None, threshold, tolerance)
                a, b = ids[i], ids[j]
            if len(a):
                node, n = np.unique(np.concatenate([a, b]), return_counts=True)
                u, v = _forest(a, b)
                found += [pd.DataFrame({"node": node, "links": n, "to": node}), pd.DataFrame({"node": u, "links": 0, "to": v})]
        return pd.concat(found) if found else pd.DataFrame({"node": [], "links": [], "to": []}).astype("int64")

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_copies, n_links.

    copy_id is the smallest doc_id with the very same text, n_copies the number of rows that have it. n_links is the number of
    different texts with similarity at or over threshold (Jaccard of five-word shingle sets). class_id is the smallest doc_id that
    links connect it with, through others too; without links it is copy_id. A null text is the
    empty text; empty and blank texts have no links but are copies of their like. Texts under five words are one shingle. doc_ids
    are integers; a null one counts as smaller than all others and gets class_id -2**63. Rows that share a doc_id share its class and links. An empty table gives no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("_id", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("digest", F.unhex(F.sha2("text", 256)))
    each = cut(slim.mapInArrow(_keys, "doc_id long, _id long, digest binary, n_bytes long, keys array<long>"))
    copies = each.groupBy("digest").agg(F.min("_id").alias("copy_id"), F.count("*").alias("n_copies"))
    mine = each.groupBy("digest").agg(F.min(F.struct("_id", "n_bytes", "keys")).alias("s")).select("s.*")
    held = mine.select("_id", F.explode("keys").alias("key"))
    least = held.groupBy("key").agg(F.min("_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = held.join(least, "key").where("_id <> least").select("_id", "least")
    groups = cut(components(near, "_id", "least"))
    sized = mine.drop("keys").groupBy("_id").agg(F.max("n_bytes").alias("n_bytes")).join(groups.withColumnRenamed("node", "_id"), "_id")
    blocks = sized.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).alias("blocks"))
    small = sized.join(blocks.where("blocks = 1"), "comp").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")).first()
    bins = max(slots(spark), -(-small.n // BIN), -(-(small.b or 0) // BLOCK_BYTES))
    member = groups.join(blocks, "comp").select(F.col("node").alias("_id"), "comp", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    texts = slim.select("_id", "text").join(member.hint("shuffle_hash"), "_id")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    units = texts.withColumn("with", other).select(
        "_id", "text", "comp", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), (F.col("block") != F.col("with")).alias("two"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(F.col("comp")).alias("_unit"), (F.col("blocks") == 1).alias("_small"),
    )
    found = cut(units.groupBy("_small", "_unit", "low", "high").applyInPandas(_unit(threshold, tolerance), "node long, links long, to long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(found, "node", "to")
    told = counts.join(classes, "node", "left").select(F.col("node").alias("copy_id"), F.coalesce("comp", "node").alias("class_id"), "n_links")
    texts_told = copies.join(told, "copy_id", "left")  # one row per different text
    out = skew_join(each.select("doc_id", "digest"), texts_told, "digest", "n_copies", each.count())
    return out.select("doc_id", F.coalesce("class_id", "copy_id").alias("class_id"), "copy_id", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id (of rows that share it, the smallest text).

    Columns stay as they are, whatever their names."""
    from pyspark.sql import Window

    classes = near_duplicates(docs, threshold)
    stays = classes.where(F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("class_id")).select(F.col("class_id").alias("id")).distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("id"), F.sha2(text_of(docs), 256).alias("digest"))
    first = Window.partitionBy("id").orderBy("digest")
    kept = rows.join(stays.hint("shuffle_hash"), "id").withColumn("place", F.row_number().over(first)).where("place = 1")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


ORACLE = """
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
copies AS (SELECT text, min(doc_id) AS copy_id, count(*) AS n_copies FROM docs GROUP BY 1),
words AS (SELECT copy_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM copies),
runs AS (SELECT DISTINCT copy_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT copy_id, count(*) AS n FROM runs GROUP BY 1),
common AS (SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS c FROM runs a JOIN runs b ON a.s = b.s AND a.copy_id < b.copy_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.copy_id = a JOIN sizes y ON y.copy_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS root FROM both_ways UNION SELECT b, root FROM reach JOIN both_ways ON a = node),
classes AS (SELECT node, min(root) AS class_id FROM reach GROUP BY 1), counts AS (SELECT a AS node, count(*) AS n_links FROM both_ways GROUP BY 1)
SELECT docs.doc_id, coalesce(class_id, copy_id) AS class_id, copy_id, n_copies, coalesce(n_links, 0) AS n_links
FROM docs JOIN copies ON docs.text = copies.text LEFT JOIN classes ON classes.node = copy_id LEFT JOIN counts ON counts.node = copy_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
