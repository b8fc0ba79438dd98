"""Prefix trie of conversations, with leaf counts and savings of whole subtrees by sums along paths.

1. A turn is a 32-byte digest and a number of words before anything is shuffled; texts never are.
2. Turns are sorted by ranges of (conversation, turn), so a very long conversation is many tasks' work. A prefix is the sum of its
   turns' digests times powers of BASE, modulo a prime of 255 bits; such sums can be begun anywhere and joined later: each task
   sums its own stretch, and what a conversation brings over from earlier ranges is added afterwards. At most two conversations a
   range reach over its ends, so the driver sees two small rows a range.
3. A rebuilt prefix is the head's sum plus the own turns' sum, moved by a power of BASE; no turn is moved or copied for it.
4. Each distinct (depth, sum) is a node, keyed by a digest, with an edge to its parent's digest.
5. Subtree sums: a node belongs to its smallest member, and a conversation's own nodes are the end of its path, since deeper nodes have
   fewer members. So a node's subtree is what its members own at its depth or deeper: a running sum from the end of each
   path, added up by node. That is one pass, whatever the depth.
6. The members that end at a node are joined into text by ranges of their ids, many ids a row; the rows of one node are then fed to
   its SHA-256 in order, a stream that holds one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read, skew_join

PRIME = 2**255 - 19
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest(), "big") % PRIME
BACK = pow(BASE, -1, PRIME)
GROUP, HEADS, IDS = 20, 4, 4096
WORD = r"[^\x20\x09-\x0D]+"


def _bytes(x: int) -> bytes:
    return x.to_bytes(32, "big")


def node_key(depth: int, total: int) -> bytes:
    return hashlib.sha256(depth.to_bytes(8, "big") + _bytes(total)).digest()[:16]


ROOT = node_key(0, 0)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's number and sum inside its task's stretch of the conversation. The rows are sorted."""
    task, conv, n, total, power = TaskContext.get().partitionId(), None, 0, 0, 1
    for batch in batches:
        ks, before, after = [], [], []
        for c, h in zip(batch.column("conv_id").to_pylist(), batch.column("h").to_pylist(), strict=True):
            if c != conv:
                conv, n, total, power = c, 0, 0, 1
            before.append(_bytes(total))
            total = (total + int.from_bytes(h, "big") * power) % PRIME
            power = power * BASE % PRIME
            n += 1
            ks.append(n)
            after.append(_bytes(total))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([task] * len(ks), pa.int32()), pa.array(ks, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary()), batch.column("words")], names=["conv_id", "task", "k", "before", "after", "words"])


def _carried(brought: dict):
    """Rows with what their conversation brings over from earlier stretches: (turns, sum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, before, after = batch.column("k").to_pylist(), batch.column("before").to_pylist(), batch.column("after").to_pylist()
            for i, key in enumerate(zip(batch.column("task").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)):
                if key in brought:
                    n, total = brought[key]
                    move = pow(BASE, n, PRIME)
                    ks[i] += n
                    before[i], after[i] = (_bytes((total + move * int.from_bytes(x, "big")) % PRIME) for x in (before[i], after[i]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(ks, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary()), batch.column("words")], names=["conv_id", "k", "before", "after", "words"])

    return run


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, k, before, after, words) of turns (conv_id, turn, h, words): k counts from 1 in the order of turn, then h; before and after are the sums of the turns up to this one."""
    own = cut(turns.repartitionByRange("conv_id", "turn", "h").sortWithinPartitions("conv_id", "turn", "h").mapInArrow(_stretches, "conv_id long, task int, k long, before binary, after binary, words long"))
    last = own.groupBy("conv_id", "task").agg(F.max(F.struct("k", "after")).alias("s"))
    over = last.join(last.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1"), "conv_id").select("conv_id", "task", "s.*")
    brought, at = {}, {}
    for r in sorted(over.collect(), key=lambda r: r["task"]):  # two rows a task at most
        n, total = at.get(r["conv_id"], (0, 0))
        brought[r["task"], r["conv_id"]] = n, total
        at[r["conv_id"]] = n + r["k"], (total + pow(BASE, n, PRIME) * int.from_bytes(r["after"], "big")) % PRIME
    brought = {k: v for k, v in brought.items() if v[0]}
    return own.mapInArrow(_carried(brought), "conv_id long, k long, before binary, after binary, words long")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each rebuilt turn's node and of its parent. Own turns are moved behind a head of m turns; head turns have no shift."""
    moves = {}
    for batch in batches:
        depth, key, parent = [], [], []
        for k, before, after, m, cut_at, head, own in zip(*(batch.column(c).to_pylist() for c in ("k", "before", "after", "m", "cut_at", "head", "own")), strict=True):
            d = k - cut_at + m
            if own is not None:
                if m - cut_at not in moves:
                    moves[m - cut_at] = pow(BASE, m - cut_at, PRIME) if m >= cut_at else pow(BACK, cut_at - m, PRIME)
                start, off = int.from_bytes(head, "big") if head else 0, int.from_bytes(own, "big")
                before, after = ((start + moves[m - cut_at] * (int.from_bytes(x, "big") - off)) % PRIME for x in (before, after))
            else:
                before, after = int.from_bytes(before, "big"), int.from_bytes(after, "big")
            depth.append(d)
            key.append(node_key(d, after))
            parent.append(node_key(d - 1, before))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depth, pa.int64()), pa.array(key, pa.binary()), pa.array(parent, pa.binary()), batch.column("words"), batch.column("ends")], names=["conv_id", "depth", "key", "parent", "words", "ends"])


def rebuilt_turns(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, ends): a row (conv_id, depth, key, parent, words, ends) for each turn of the rebuilt conversations, and (conv_id, key) of the turnless ones."""
    own = numbered(turns)
    firsts = [F.max(F.when(F.col("k") == i, F.struct("before", "after", "words"))).alias(f"f{i}") for i in range(1, HEADS)]
    conv = cut(convs.join(own.groupBy("conv_id").agg(F.max("k").alias("n"), *firsts), "conv_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    base = conv.select(F.col("conv_id").alias("base_id"), F.col("n").alias("base_n"), *(F.col(f"f{i}").alias(f"b{i}") for i in range(1, HEADS)))
    info = conv.withColumn("h", h).withColumn("base_id", F.col("conv_id") - F.col("conv_id") % GROUP).join(base, "base_id", "left")
    at = lambda c, n: F.when(n == 1, F.col(f"{c}1.after")).when(n == 2, F.col(f"{c}2.after")).when(n == 3, F.col(f"{c}3.after"))
    m, zero = F.least(F.col("h"), F.coalesce("base_n", F.lit(0).cast("long"))), F.lit(b"\0" * 32)
    info = cut(info.withColumn("m", m).withColumn("size", F.col("m") + F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("h"))).withColumn("head", at("b", F.col("m"))).withColumn("off", F.coalesce(at("f", F.least("h", "n")), zero)))
    heads = info.where("m > 0").select("conv_id", "m", "size", F.posexplode(F.slice(F.array("b1", "b2", "b3"), F.lit(1), F.col("m").cast("int"))).alias("i", "b"))
    heads = heads.select("conv_id", (F.col("i") + 1).cast("long").alias("k"), "b.before", "b.after", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("cut_at"), F.lit(None).cast("binary").alias("head"), F.lit(None).cast("binary").alias("own"), "b.words", (F.col("size") == F.col("i") + 1).alias("ends"))
    total = info.agg(F.sum("n")).first()[0] or 0
    tails = skew_join(own, info.select("conv_id", "n", "h", "m", "size", "head", "off"), "conv_id", "n", total).where("k > h")
    tails = tails.select("conv_id", "k", "before", "after", "m", F.col("h").alias("cut_at"), "head", F.col("off").alias("own"), "words", (F.col("k") - F.col("h") + F.col("m") == F.col("size")).alias("ends"))
    rows = heads.unionByName(tails).mapInArrow(_rebuilt, "conv_id long, depth long, key binary, parent binary, words long, ends boolean")
    return rows, info.where("size = 0").select("conv_id", F.lit(ROOT).alias("key"))


def subtree_sums(rows: DataFrame, owned: DataFrame, values: list[str]) -> DataFrame:
    """(key, *values): each value summed over the node's subtree. rows are (conv_id, depth, key), owned the nodes as (conv_id, depth, *values) with their smallest member.

    Paths are cut into ranges, each summed by windows; at most one conversation a range goes on in the next, so what is brought over is a row a range."""
    x = rows.select("conv_id", "depth", "key").join(owned, ["conv_id", "depth"], "left").na.fill(0, values)
    x = cut(x.repartitionByRange("conv_id", "depth").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("conv_id", "_part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv_id").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = x.groupBy("conv_id", "_part").agg(*(F.sum(v).alias(v) for v in values))
    brought = parts.select("conv_id", "_part", *(F.sum(v).over(later).alias(f"_{v}") for v in values)).where(F.col(f"_{values[0]}").isNotNull())
    told = x.select("conv_id", "_part", "key", *(F.sum(v).over(inside).alias(v) for v in values)).join(F.broadcast(brought), ["conv_id", "_part"], "left")
    whole = owned.agg(*(F.sum(v).alias(v) for v in values)).select(F.lit(ROOT).alias("key"), *values)
    return told.groupBy("key").agg(*(F.sum(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)).unionByName(whole)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) as rows of joined ids: (key, first, text)."""
    key, ids = None, []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "first", "text"])

    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (k != key or len(ids) == IDS):
                yield row()
                ids = []
            key = k
            ids.append(c)
    if ids:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, first, text) as (key, sha256 of the texts, joined by commas)."""
    key, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if k != key:
                if digest:
                    yield row()
                key, digest = k, hashlib.sha256(t.encode())
            else:
                digest.update(f",{t}".encode())
    if digest:
        yield row()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): SHA-256 of the ids in order, joined by commas."""
    chunks = cut(ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_chunks, "key binary, first long, text string"))
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


def prefix_trie(df: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; those of one turn (repeated rows too, each a turn of its own) by a digest of role and text, so the same rows
    always give the same order. A null role or text is empty. Rows with a null conv_id belong to no
    conversation and are left out. Texts of any length are read whole, once. A table without conversations gives no rows, not even a root.
    Other columns of df don't matter, whatever their names."""
    role, text = (F.coalesce(df[c].cast("string"), F.lit("")) for c in ("role", "text"))
    h = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = df.where(df["conv_id"].isNotNull()).select(df["conv_id"].cast("long").alias("conv_id"), df["turn"].alias("turn"), h.alias("h"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    convs = turns.select("conv_id").distinct()
    rows, none = rebuilt_turns(turns, convs)
    rows = cut(rows)
    head = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).where("n > 0")
    root = head.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.col("least").alias("conv_id"), F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    deeper = rows.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    nodes = cut(root.unionByName(deeper))
    children = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("n_children"))
    known = cut(nodes.join(children.withColumnRenamed("parent", "key"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    own = known.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = subtree_sums(rows, own, ["n_leaves", "saved_tokens"])
    ends = ends_digests(rows.where("ends").select("key", "conv_id").unionByName(none))
    parents = known.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    named = skew_join(known.where(F.col("parent").isNotNull()), parents, "parent", "_n", nodes.count()).drop("_n").unionByName(known.where(F.col("parent").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = named.join(sums, "key").join(ends, "key", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


#: CRC-32 of the digits, bit by bit; prefixes as chained hashes; an ancestor is what a node's smallest member has at its depth.
ORACLE = r"""
WITH turns AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
heads AS MATERIALIZED (SELECT conv_id, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT),
    lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[], lambda s, i: xor(s >> 1, 3988292384::UBIGINT * (s & 1)), xor(c, b)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (SELECT h.conv_id, t.k, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.k <= h.h
  UNION ALL SELECT h.conv_id, t.k + 4, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.k > h.h),
placed AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, sha256(length(role) || ':' || role || text) AS h, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt),
keyed AS MATERIALIZED (SELECT conv_id, depth, sha256(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key, words FROM placed UNION ALL SELECT conv_id, 0, 'root', 0 FROM heads),
nodes AS MATERIALIZED (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM keyed GROUP BY key, depth),
up AS MATERIALIZED (SELECT n.key, n.depth, a.key AS above, a.depth AS above_depth FROM nodes n JOIN keyed a ON a.conv_id = n.conv_id AND a.depth <= n.depth),
children AS (SELECT above AS key, above_depth AS depth, count(*) AS n_children FROM up WHERE above_depth = depth - 1 GROUP BY ALL),
sums AS (SELECT above AS key, above_depth AS depth, count_if(n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM up JOIN nodes USING (key, depth) LEFT JOIN children USING (key, depth) GROUP BY ALL),
last AS (SELECT conv_id, max(depth) AS depth FROM keyed GROUP BY conv_id),
ends AS (SELECT key, depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM keyed JOIN last USING (conv_id, depth) GROUP BY key, depth)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (key, depth) LEFT JOIN children c USING (key, depth) LEFT JOIN ends e USING (key, depth)
LEFT JOIN up u ON u.key = n.key AND u.depth = n.depth AND u.above_depth = n.depth - 1 LEFT JOIN nodes p ON p.key = u.above AND p.depth = u.above_depth
"""


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))
