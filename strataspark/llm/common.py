"""What the operators of this subpackage share: the checkpoint folder and null-safe columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.checkpoints import cut  # noqa: F401
from strataspark.skew import skew_join  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id inside an operator: smaller than any other.
NULL_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Sends texts to Python in batches of at most so many rows: with the usual 10,000, a batch of long texts takes hundreds of MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def slots(spark: SparkSession) -> int:
    """Tasks that the cluster runs at once."""
    return max(1, spark.sparkContext.defaultParallelism)
