"""Vector tables: which rows take part, and blocks of vectors met by blocks of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and vectors met at once in a task.
QUERY_BLOCK = 4096


def finite(c: Column) -> Column:
    """No null, NaN or infinite component."""
    return F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))


def vectors(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part: of the commonest length, all components finite and, unless zero, not all 0.

    Rows with a null id are left out. Of rows that share an id the least vector stays."""
    v = df[vec_col].cast("array<double>")
    ok = df.select(df[id_col].cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite(F.col("v")))
    if not zero:
        ok = ok.where(F.exists("v", lambda x: x != 0))
    size = ok.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    ok = ok.where(F.size("v") == (size.n if size else 0))
    return ok.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column) -> np.ndarray:
    """A column of equally long lists (pandas or Arrow) as a matrix."""
    if isinstance(column, pa.Array):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def ranked(found: DataFrame, k: int, score_type: str, *more: Column) -> DataFrame:
    """One row per (query_id, rank) from lists of (score, vec_id) per query and block, with more aggregates of the query's blocks."""
    s = F.flatten(F.collect_list("top"))
    top = F.slice(F.array_sort(F.transform(s, lambda x: F.struct((-x["score"]).alias("n"), x["vec_id"].alias("i")))), 1, k)
    each = found.groupBy("query_id").agg(top.alias("top"), *more).select("*", F.posexplode("top").alias("p", "x")).drop("top")
    rest = [c for c in each.columns if c not in ("query_id", "p", "x")]
    return each.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.n")).cast(score_type).alias("score"), *rest)
