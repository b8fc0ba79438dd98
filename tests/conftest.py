import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.checkpoint.dir", str(base / "checkpoints")).config("spark.sql.warehouse.dir", str(base / "warehouse")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _plain(v):
    import math

    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(_plain(x) for x in (v.tolist() if hasattr(v, "tolist") and not isinstance(v, (list, tuple)) else v))
    return v


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a DataFrame and a SQL statement give the same columns and rows."""

    def check(df, sql):
        rel = duck.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(rel.columns)
        a = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        b = sorted((tuple(_plain(v) for v in row) for row in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
        assert len(a) == len(b), (len(a), len(b), a[:3], b[:3])
        bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        assert not bad, (len(bad), bad[:5])

    return check
