"""Line dedup: two Bloom filters find the lines that may repeat; only those are shuffled and counted exactly.

1. Every document's distinct line digests (SHA-256 of the key) are taken once and checkpointed.
2. A bounded number of tasks each put the digests into a filter of once-seen and one of twice-seen
   hashes. Filters merge bit by bit: what two tasks have both seen once counts as seen twice.
3. Digests that the twice-seen filter holds are suspects. They alone are shuffled, as (document,
   digest), and counted exactly, so a wrong hit of the filter costs a row and changes nothing.
4. Documents that hold a confirmed line, but aren't its largest doc_id, lose it.

The filters have 8 bits a digest, from 2**20 to 2**28 bits (32 MB) each: that bounds the broadcast and a task's memory.
For more lines than that allows, about 30 million, 8-byte hashes alone (one for each batch of documents that has it) go to tasks that own a range of them
each, in one job; every owner has a once-seen filter for its range and gives out what it sees again. The twice-seen filter is built of
these repeats alone; where even they are too many for one, digests are joined with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, ascii_lower, cut, skew_join, slots, small_batches, text_of

BLANKS = " \t\n\x0b\x0c\r"
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
MIN_LOG2, MAX_LOG2, SLICE, MAX_BUILDERS = 20, 28, 1 << 16, 256


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def digest(key: Column) -> Column:
    return F.unhex(F.sha2(key, 256))


def _longs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The first eight bytes of each 32-byte digest of a column of lists."""
    flat = column.flatten()
    if not len(flat):
        return np.empty(0, np.uint64)
    start = flat.offset
    begin = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, start * 4)[0]
    return np.frombuffer(flat.buffers()[2], np.uint8, 32 * len(flat), begin).reshape(-1, 32)[:, :8].copy().view(np.uint64).ravel()


def _positions(h: np.ndarray, log2: int) -> np.ndarray:
    return (h[:, None] * MULTIPLIERS[None, :]) >> np.uint64(64 - log2)


def _holds(bits: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return ((bits[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _put(bits: np.ndarray, pos: np.ndarray) -> None:
    p = pos.ravel()
    np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))


def _builder(log2: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(1 << (log2 - 3), np.uint8) for _ in range(2))
        for batch in batches:
            h, n = np.unique(_longs(batch.column("digests")), return_counts=True)
            pos = _positions(h, log2)
            _put(twice, pos[_holds(once, pos) | (n > 1)])
            _put(once, pos)
        for k in range(0, len(once), SLICE):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k // SLICE], pa.int32()), "once": [once[k : k + SLICE].tobytes()], "twice": [twice[k : k + SLICE].tobytes()]})

    return build


def _merge(pdf):
    once, twice = None, None
    for o, t in zip(pdf["once"], pdf["twice"], strict=True):
        o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
        once, twice = (o, t) if once is None else (once | o, twice | t | (once & o))
    return pdf.iloc[:1][["slice"]].assign(twice=[twice.tobytes()])


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different hashes of each batch, with whether it has them more than once: what a hot line adds is a row a batch."""
    for batch in batches:
        h, n = np.unique(_longs(batch.column("digests")), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], names=["h", "more"])


def _owner(log2: int):
    """Hashes of a range of their own that the task sees again, by its filter of once-seen ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(1 << (log2 - 3), np.uint8)
        for batch in batches:
            every = batch.column("h").to_numpy()
            h, n = np.unique(every, return_counts=True)
            more = np.isin(h, every[batch.column("more").to_numpy(zero_copy_only=False)])
            pos = _positions(h.view(np.uint64), log2)
            again = _holds(once, pos) | (n > 1) | more
            _put(once, pos)
            yield pa.RecordBatch.from_arrays([pa.array(h[again])], names=["h"])

    return run


def _filter(held: DataFrame, log2: int) -> np.ndarray:
    """The twice-seen filter over held."""
    spark = held.sparkSession
    parts = held.select("digests").coalesce(min(MAX_BUILDERS, slots(spark))).mapInArrow(_builder(log2), "slice int, once binary, twice binary")
    rows = parts.groupBy("slice").applyInPandas(_merge, "slice int, twice binary").collect()  # at most 2**log2 bits
    return np.frombuffer(b"".join(r.twice for r in sorted(rows, key=lambda r: r["slice"])), np.uint8) if rows else np.zeros(1 << (log2 - 3), np.uint8)


def _held_by(held: DataFrame, twice: np.ndarray, log2: int) -> DataFrame:
    """(_id, digest) of the digests that the filter has."""
    sent = held.sparkSession.sparkContext.broadcast(twice)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("digests")
            ids = batch.column("_id").take(pc.list_parent_indices(lists))
            mask = pa.array(_holds(sent.value, _positions(_longs(lists), log2)))
            yield pa.RecordBatch.from_arrays([ids.filter(mask), lists.flatten().filter(mask)], names=["_id", "digest"])

    found = cut(held.select("_id", "digests").mapInArrow(suspects, f"_id {dict(held.dtypes)['_id']}, digest binary"))
    sent.unpersist()
    return found


def _put_all(log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (log2 - 3), np.uint8)
        for batch in batches:
            _put(bits, _positions(batch.column("h").to_numpy().view(np.uint64), log2))
        for k in range(0, len(bits), SLICE):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k // SLICE], pa.int32()), "once": [bits[k : k + SLICE].tobytes()], "twice": [bits[k : k + SLICE].tobytes()]})

    return run


def _hash_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("digests")
        yield pa.RecordBatch.from_arrays([batch.column("_id").take(pc.list_parent_indices(lists)), lists.flatten(), pa.array(_longs(lists).view(np.int64))], names=["_id", "digest", "h"])


def _suspects_by_range(held: DataFrame, ranges: int, max_log2: int) -> DataFrame:
    """(_id, digest) that may repeat, for more digests than one pair of filters takes: in one job the hashes, eight bytes each, go to the tasks that own their range.

    Documents' digests are held against a twice-seen filter of what the owners see again or, if even that is too much for it, joined with it."""
    of = F.shiftrightunsigned(F.xxhash64("h"), 33) % ranges
    seen = cut(held.select("digests").mapInArrow(_routed, "h long, more boolean").repartition(ranges, of).mapInArrow(_owner(max_log2), "h long"))
    again = seen.distinct()
    n = again.count()
    if 8 * n < 2**max_log2:
        log2 = max(min(MIN_LOG2, max_log2), int(8 * n).bit_length())
        parts = again.coalesce(min(MAX_BUILDERS, slots(held.sparkSession))).mapInArrow(_put_all(log2), "slice int, once binary, twice binary")
        rows = parts.groupBy("slice").applyInPandas(_merge, "slice int, twice binary").collect()  # at most 2**log2 bits
        twice = np.frombuffer(b"".join(r.twice for r in sorted(rows, key=lambda r: r["slice"])), np.uint8) if rows else np.zeros(1 << (log2 - 3), np.uint8)
        return _held_by(held, twice, log2)
    each = held.mapInArrow(_hash_of, f"_id {dict(held.dtypes)['_id']}, digest binary, h long")
    return cut(each.join(again.hint("merge"), "h").select("_id", "digest"))


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, max_log2: int = MAX_LOG2) -> DataFrame:
    """(_id, drops): for each document, digests of the keys that it must lose. A filter has at most 2**max_log2 bits."""
    keys = F.filter(F.transform(F.split(text_of(docs), "\n"), line_key), lambda k: F.length(k) >= min_chars)
    held = cut(docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.transform(F.array_distinct(keys), digest).alias("digests")).where(F.size("digests") > 0))
    n = held.agg(F.sum(F.size("digests"))).first()[0] or 0
    ranges = max(1, -(-8 * n // 2**max_log2))
    if ranges == 1:
        log2 = max(min(MIN_LOG2, max_log2), int(8 * n).bit_length()) if 8 * n < 2**max_log2 else max_log2
        found = _held_by(held, _filter(held, log2), log2)
    else:
        found = _suspects_by_range(held, ranges, max_log2)
    confirmed = found.dropDuplicates(["digest", "_id"]).groupBy("digest").agg(F.count("*").alias("n"), F.max("_id").alias("keep")).where(F.col("n") >= min_docs)
    losers = skew_join(found, confirmed, "digest", "n", found.count()).where(F.col("_id") != F.col("keep"))
    return losers.groupBy("_id").agg(F.collect_set("digest").alias("drops"))


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _without(min_chars: int):
    """Texts without the lines whose digests are listed, and how many went; a null text stays null."""

    def one(text: str, drops) -> tuple[str, int]:
        gone, lines, kept = {bytes(d) for d in drops}, text.split("\n"), []
        for line in lines:
            key = line.strip(BLANKS).translate(_LOWER)
            if len(key) < min_chars or sha256(key.encode()).digest() not in gone:
                kept.append(line)
        return "\n".join(kept), len(lines) - len(kept)

    @F.pandas_udf("text string, n_dropped long")
    def run(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if t is None else one(t, d) for t, d in zip(texts, drops, strict=True)], columns=["text", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with text cut down to the lines that stay, and columns n_lines and n_dropped.

    A line's key is the line without blanks at both ends and with A-Z lower-cased. Keys of at least
    min_chars code points in at least min_docs documents stay in the largest doc_id only.
    Null and empty texts are one empty line and become the empty text. Rows that share a doc_id count
    as one document and lose the same keys; a null doc_id is one document, smaller than all others.
    An empty table gives an empty table. Other columns are kept, whatever their names, but for the
    names that the operator itself adds: those are replaced."""
    small_batches(docs.sparkSession)
    drops = repeated_lines(docs, min_chars, min_docs).toDF("id", "drops")
    named = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    others = [c for c in named if c != "text"]
    text = text_of(docs)
    df = docs.select(F.struct(*(docs[c] for c in others)).alias("row"), F.coalesce(docs["doc_id"], F.lit(NULL_ID)).alias("id"), text.alias("text"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    df = df.join(drops.hint("shuffle_hash"), "id", "left")
    df = df.withColumn("cut", _without(min_chars)(F.when(F.col("drops").isNotNull(), F.col("text")), F.col("drops")))
    out = [F.coalesce("cut.text", "text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in named]
    return df.select(*out, "n_lines", F.col("cut.n_dropped").alias("n_dropped"))


ORACLE = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each),
rep AS (SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keyed.*, rep.k IS NOT NULL AND doc_id <> keep AS gone FROM keyed LEFT JOIN rep ON keyed.k = rep.k)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    df = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
