"""Reliable checkpoints and stored tables in the folder that the session names."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes an execution's shuffle files at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Cuts under way in all threads, and what CLEAN was before the first: the last one puts it back.
_lock, _cuts = threading.Lock(), {"n": 0, "before": "false"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder (tests), once for each application, a cluster a folder beside its warehouse."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.startswith("local") and "cluster" not in sc.master:
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder. The shuffles that made it go from the disks at once, not when the driver next collects garbage."""
    spark = df.sparkSession
    shared_folder(spark)
    with _lock:
        if not _cuts["n"]:
            _cuts["before"] = spark.conf.get(CLEAN, "false")
        _cuts["n"] += 1
        spark.conf.set(CLEAN, "true")
    try:
        return df.select("*").checkpoint()  # a new execution: one that was begun before keeps its shuffles
    finally:
        with _lock:
            _cuts["n"] -= 1
            if not _cuts["n"]:
                spark.conf.set(CLEAN, _cuts["before"])


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df written as a Parquet table of its own in the shared folder, in a folder for each value of by, and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.parquet(path)
