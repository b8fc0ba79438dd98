"""Receipts of scored raster windows: what is due, what is wrong, and scoring of just that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.checkpoints import cut


def content_hashes(cells: DataFrame, columns: list[str], window: str = "window") -> DataFrame:
    """(window, cells, hash): a hash of each window's rows that doesn't depend on their order or split: sums of two halves of the rows' SHA-256 and their number."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, k, 15), 16, 10).cast("decimal(38,0)"))
    g = cells.groupBy(window).agg(F.count("*").alias("cells"), part(1).alias("a"), part(16).alias("b"))
    return g.select(window, "cells", F.sha2(F.concat_ws(":", "cells", "a", "b"), 256).alias("hash"))


def window_faults(plan: DataFrame, rows: int) -> DataFrame:
    """(window, fault) of a plan (window, top, height) that should cover rows 0 to rows - 1, each once: gap, overlap, empty, start or end. None for a sound plan."""
    w = plan.withColumns({"_end": F.col("top") + F.col("height"), "_next": F.lead("top").over(Window.orderBy("top", "window")), "_first": F.row_number().over(Window.orderBy("top", "window"))})
    fault = (
        F.when(F.col("height") <= 0, "empty").when((F.col("_first") == 1) & (F.col("top") != 0), "start").when(F.col("_next").isNull() & (F.col("_end") != rows), "end")
        .when(F.col("_next") > F.col("_end"), "gap").when(F.col("_next") < F.col("_end"), "overlap")
    )
    return w.select("window", fault.alias("fault")).where("fault IS NOT NULL")


def due_windows(plan: DataFrame, receipts: DataFrame, chunks: DataFrame, columns: list[str], identity: str) -> DataFrame:
    """(window, top, height, why) of the windows to score: new (no receipt), other (made by another model or input), missing (no chunk) or corrupt (the chunk isn't what the receipt says).

    receipts is (window, top, height, identity, cells, hash), chunks the stored rows with their window. A receipt for other rows of the raster counts as other."""
    now = content_hashes(chunks, columns).select("window", F.col("cells").alias("_cells"), F.col("hash").alias("_hash"))
    r = receipts.select("window", F.col("top").alias("_top"), F.col("height").alias("_height"), F.col("identity").alias("_identity"), F.col("cells").alias("_n"), F.col("hash").alias("_h"))
    x = plan.join(r, "window", "left").join(now, "window", "left")
    same = (F.col("_identity") == identity) & (F.col("_top") == F.col("top")) & (F.col("_height") == F.col("height"))
    why = F.when(F.col("_h").isNull(), "new").when(~same, "other").when(F.col("_hash").isNull() & (F.col("_n") > 0), "missing").when((F.coalesce("_hash", F.col("_h")) != F.col("_h")) | (F.coalesce("_cells", F.col("_n")) != F.col("_n")), "corrupt")
    return x.withColumn("why", why).where("why IS NOT NULL").select("window", "top", "height", "why")


def score_due(cells: DataFrame, plan: DataFrame, receipts: DataFrame, chunks: DataFrame, columns: list[str], identity: str, score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, receipts, due) after scoring the due windows' cells, and no others. cells has row; score gives the columns.

    A window without cells gets a receipt of none. Chunks and receipts of windows that aren't due stay as they are; windows that aren't in the plan go. The caller publishes both."""
    due = cut(due_windows(plan, receipts, chunks, columns, identity))
    spans = due.select("window", "top", "height", F.explode(F.sequence(F.col("top"), F.col("top") + F.greatest("height", F.lit(1)) - 1)).alias("row")).where("height > 0")
    made = cut(score(cells.join(spans.select("window", "row"), "row")).select("window", *columns))
    kept = plan.join(due, "window", "left_anti").select("window")
    told = due.select("window", "top", "height").join(content_hashes(made, columns), "window", "left")
    none = F.sha2(F.concat_ws(":", F.lit(0)), 256)
    fresh = told.select("window", "top", "height", F.lit(identity).alias("identity"), F.coalesce("cells", F.lit(0).cast("long")).alias("cells"), F.coalesce("hash", none).alias("hash"))
    return chunks.join(kept, "window", "left_semi").select("window", *columns).unionByName(made), receipts.join(kept, "window", "left_semi").unionByName(fresh), due
