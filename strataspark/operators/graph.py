"""Connected components by alternating large-star and small-star rounds, all of them DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.checkpoints import cut


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """(node, comp): comp is the smallest node of node's component. Edges from a node to itself don't matter.

    Each round is cut by a checkpoint, and so are the nodes' least neighbours: the join with them then has nothing but shuffles below it, so
    that adaptive execution broadcasts a small table of them, and splits the edges of a node that very many link to. Nodes without an edge don't appear."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    before = None
    for _ in range(rounds):
        e = cut(e)
        state = tuple(e.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        least = cut(_least(e.union(e.select("v", "u").toDF("u", "v"))))
        large = e.join(least.withColumnRenamed("u", "v"), "v").select("u", F.least("v", "m").alias("v")).distinct()
        joined = large.join(_least(large), "u")
        e = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u > v").distinct()
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return e.toDF("node", "comp").union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def linked_groups(rows: DataFrame, group: str, event: str) -> DataFrame:
    """(group, linked): groups that share a non-blank event, directly or through others, get the smallest of their ids."""
    known = rows.where(F.trim(F.coalesce(event, F.lit(""))) != "").select(group, event).distinct()
    first = known.groupBy(event).agg(F.min(group).alias("_least"))
    comp = components(known.join(first, event), group, "_least").select(F.col("node").alias(group), "comp")
    return rows.select(group).distinct().join(comp, group, "left").select(group, F.coalesce("comp", group).alias("linked"))
