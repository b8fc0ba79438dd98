"""What keeps results trustworthy: content fingerprints, freshness, checked publication, resumable windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(files: DataFrame, settings: dict[str, str]) -> DataFrame:
    """(fingerprint): one hash of file hashes, in name order, and settings. Times don't count.

    files is (name, sha256, bytes); sorted pairs are hashed per 256 name groups first, so no row gathers them all."""
    group = F.pmod(F.xxhash64("name"), F.lit(256))
    parts = files.groupBy(group.alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "sha256"))), ","), 256).alias("h"))
    said = ",".join(f"{k}={v}" for k, v in sorted(settings.items()))
    one = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ",").alias("all"))
    return one.select(F.sha2(F.concat_ws("|", "all", F.lit(said)), 256).alias("fingerprint"))


def freshness(now: DataFrame, recorded: DataFrame, key: str = "step") -> DataFrame:
    """(step, state): fresh, stale (another fingerprint), new (not recorded) or gone."""
    a, b = now.alias("a"), recorded.alias("b")
    state = F.when(F.col(f"b.{key}").isNull(), "new").when(F.col(f"a.{key}").isNull(), "gone").when(F.col("a.fingerprint") == F.col("b.fingerprint"), "fresh").otherwise("stale")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), state.alias("state"))


def prediction_identity(df: DataFrame, key: str, score: str) -> DataFrame:
    """(rows, identity): a hash that is the same for the same scores of the same keys, however they are split or ordered."""
    row = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col(score).cast("string")), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(row).cast("string").alias("sum"), F.bit_xor(F.xxhash64(key, score)).alias("xor")).select("rows", F.sha2(F.concat_ws(":", "rows", "sum", F.col("xor").cast("string")), 256).alias("identity"))


def publish(df: DataFrame, path: str, faults=None, inputs: tuple[str, DataFrame] | None = None) -> DataFrame:
    """Writes to a staging folder beside path, checks what was written, and renames it into place. An existing path is never replaced.

    faults(written) gives rows for what is wrong; any stop the publication and remove the staging folder. inputs, a folder and its recorded
    inventory, are looked at again after writing: if a file was changed, added or taken away meanwhile, nothing is published."""
    from strataspark.sources.tables import file_inventory, inventory_faults

    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path}._staging-{uuid.uuid4().hex}"
    try:
        df.write.mode("errorifexists").parquet(staging)
        written = spark.read.parquet(staging)
        if faults is not None and not (bad := faults(written)).isEmpty():
            raise ValueError(f"{path} not published: {bad.limit(5).collect()}")
        if inputs is not None and not (moved := inventory_faults(file_inventory(spark, inputs[0]), inputs[1])).isEmpty():
            raise ValueError(f"{path} not published, its inputs differ: {moved.limit(5).collect()}")
        if fs.exists(target) or not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
            raise FileExistsError(path)
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
    return spark.read.parquet(path)


def verified_products(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Products whose every listed file is there with the listed hash and size. manifest is (product, name, sha256, bytes)."""
    bad = manifest.join(files, ["name", "sha256", "bytes"], "left_anti").select("product").distinct()
    return manifest.select("product").distinct().join(bad, "product", "left_anti")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(product, name, sha256, bytes) from JSON documents {product, files: {name: {sha256, bytes}}}."""
    doc = spark.read.schema("product string, files map<string, struct<sha256: string, bytes: long>>").json(path, multiLine=True)
    return doc.select("product", F.explode("files").alias("name", "f")).select("product", "name", "f.sha256", "f.bytes")
