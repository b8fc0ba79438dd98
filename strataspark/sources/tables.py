"""Readers and writers of tables: contract checks, CSV, JSON, file fingerprints, raster windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's columns of the schema, in its order and types; other columns go, a missing one is an error."""
    lacking = [f.name for f in schema if f.name not in df.columns]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def normalized_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Renames columns that equal one of names but for case, signs and a band number at the end."""
    import re

    plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    wanted = {plain(n): n for n in names}
    found = {c: wanted.get(plain(c)) or wanted.get(re.sub(r"\d+$", "", plain(c))) for c in df.columns}
    return df.withColumnsRenamed({c: n for c, n in found.items() if n})


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header, read by the given types; its header must hold the schema's columns."""
    head = spark.read.option("header", True).csv(path).columns
    lacking = [f.name for f in schema if f.name not in head]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in head])
    raw = spark.read.option("header", True).schema(text).csv(path)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_checked(df: DataFrame, path: str, key: str) -> DataFrame:
    """Writes Parquet, reads it back, and fails unless the row count is the same and the key unique."""
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    got = back.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys")).first()
    n = df.count()
    if got.n != n or got["keys"] != n:
        raise ValueError(f"{path}: {n} rows written, {got.n} read, {got['keys']} keys")
    return back


def json_legend(spark: SparkSession, path: str, override: dict[int, str] | None = None) -> DataFrame:
    """(code, name) from a JSON object of names; only whole-number keys count, some may be overridden."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    rows = doc.select(F.explode("m").alias("k", "name")).where(F.col("k").rlike(r"^-?\d+$")).select(F.col("k").cast("int").alias("code"), "name")
    if not override:
        return rows
    mine = spark.createDataFrame(list(override.items()), "code int, name string")
    return rows.join(mine, "code", "left_anti").unionByName(mine)


#: Nesting of the coordinates of each kind of geometry.
_SHAPES = {"Point": 1, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(fid, kind, properties, edges) of the features under a path: collections, or with lines one feature per line, which splits large files.

    properties is a map of texts. edges is an array of {x1, y1, x2, y2} along all parts and rings, from each vertex to the next; a point is one edge from itself
    to itself, no geometry gives none. fid is the feature's id, else a hash of it. Coordinates beyond two are left out."""
    feature = "struct<id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    if lines:
        got = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", feature).alias("f"))
    else:
        got = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<features: array<{feature}>>")["features"]).alias("f"))
    kind, said = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    edge = lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    along = lambda path: F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda k: edge(F.get(path, k - 1), F.get(path, k))))
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    out = none
    for name, depth in _SHAPES.items():
        at = F.from_json(said, "array<" * depth + "double" + ">" * depth)
        if depth == 1:
            edges = F.array(edge(at, at))
        else:
            at = F.flatten(at) if depth == 4 else at
            edges = along(at) if depth == 2 else F.flatten(F.transform(at, lambda p: F.coalesce(along(p), none)))
        out = F.when(kind == name, edges).otherwise(out)
    fid = F.coalesce("f.id", F.hex(F.xxhash64(F.to_json("f"))))
    return got.where("f IS NOT NULL").select(fid.alias("fid"), kind.alias("kind"), F.col("f.properties").alias("properties"), F.coalesce(out, none).alias("edges"))


def confined(root: str, path: str) -> str:
    """The path under root, or an error if it leaves it by dots or an absolute start. Names are letters, digits, dot, dash and underscore."""
    import re

    parts = path.split("/")
    if not all(re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]*", p) for p in parts):
        raise ValueError(f"not a path under {root}: {path}")
    return f"{root.rstrip('/')}/{path}"


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, bytes) of every file under a path, hashed where it is read. name is the path below the given one, the file's own name if that is the file.

    Spark reads a file whole to hash it, so one of 2 GB or more ends in an error."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.when(F.startswith("path", F.lit(f"{root}/")), F.substr("path", F.lit(len(root) + 2))).otherwise(F.element_at(F.split("path", "/"), -1))
    return files.select(below.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def inventory_faults(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a recorded inventory."""
    a, b = now.alias("a"), recorded.alias("b")
    what = F.when(F.col("b.name").isNull(), "new").when(F.col("a.name").isNull(), "missing").when((F.col("a.sha256") != F.col("b.sha256")) | (F.col("a.bytes") != F.col("b.bytes")), "changed")
    return a.join(b, F.col("a.name") == F.col("b.name"), "full").select(F.coalesce("a.name", "b.name").alias("name"), what.alias("fault")).where("fault IS NOT NULL")


def write_raster(cells: DataFrame, path: str, tile: int = 512) -> None:
    """Cells (row, col, ...) as Parquet by tile_row, rows in order, so a window reads its tiles only."""
    cells.withColumn("tile_row", F.floor(F.col("row") / tile).cast("int")).repartition("tile_row").sortWithinPartitions("row", "col").write.mode("errorifexists").partitionBy("tile_row").parquet(path)


def read_window(spark: SparkSession, path: str, top: int, left: int, height: int, width: int, tile: int = 512) -> DataFrame:
    """Cells of a window of a raster written by write_raster; partitions outside aren't listed, row groups outside are skipped."""
    cells = spark.read.parquet(path)
    return cells.where(F.col("tile_row").between(top // tile, (top + height - 1) // tile) & F.col("row").between(top, top + height - 1) & F.col("col").between(left, left + width - 1)).drop("tile_row")


def write_report(lines: DataFrame, path: str) -> None:
    """(place, line) as one text file, in order; reports are small."""
    lines.orderBy("place").select("line").coalesce(1).write.mode("errorifexists").text(path)


def merge_section(path: str, section: str, values: dict) -> dict:
    """A JSON document on the driver's disk with one section replaced and stamped; the others stay."""
    import json
    from datetime import UTC, datetime
    from pathlib import Path

    p = Path(path)
    doc = json.loads(p.read_text()) if p.exists() else {}
    doc[section] = values | {"written": datetime.now(UTC).isoformat(timespec="seconds")}
    new = p.with_suffix(p.suffix + ".new")
    new.write_text(json.dumps(doc, indent=1, sort_keys=True))
    new.replace(p)
    return doc
