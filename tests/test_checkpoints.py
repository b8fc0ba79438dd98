"""What a cut leaves on the disks."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from strataspark.checkpoints import CLEAN, cut


def test_shuffles_of_a_cut_go_at_once(spark):
    # they stayed until the driver's next garbage collection, so that rounds of cuts filled the disks
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {p for d in manager.localDirs() for p in Path(d.getPath()).rglob("shuffle_*")}

    before = shuffles()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    out = cut(df)
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert out.count() == 7 and out.agg(F.sum("s")).first()[0] == 499500
    assert spark.conf.get(CLEAN) == "false"
