"""Windows are rescored if their chunk or its maker changed, and else left alone."""

from pyspark.sql import functions as F

from strataspark.checkpoints import cut
from strataspark.streaming import receipts as W


def test_only_what_changed_is_scored_again(spark):
    cells = spark.range(100).select((F.col("id") / 5).cast("long").alias("row"), (F.col("id") % 5).alias("col"), F.col("id").cast("double").alias("value"))
    plan = spark.createDataFrame([(k, 4 * k, 4) for k in range(5)], "window int, top long, height long")
    assert W.window_faults(plan, 20).isEmpty()
    seen = []

    def score(df):
        seen.append({r.window for r in df.select("window").distinct().collect()})
        return df.withColumn("score", F.col("value") / 100)

    columns = ["row", "col", "score"]
    none = spark.createDataFrame([], "window int, top long, height long, identity string, cells long, hash string")
    empty = spark.createDataFrame([], "window int, row long, col long, score double")
    chunks, told, due = W.score_due(cells, plan, none, empty, columns, "m1", score)
    chunks, told = cut(chunks), cut(told)
    assert seen.pop() == {0, 1, 2, 3, 4} and chunks.count() == 100 and {r.why for r in due.collect()} == {"new"}
    assert W.due_windows(plan, told, chunks.repartition(7), columns, "m1").isEmpty()
    broken = chunks.where("window <> 1").withColumn("score", F.when((F.col("window") == 3) & (F.col("row") == 13) & (F.col("col") == 2), 0.5).otherwise(F.col("score")))
    broken = broken.union(chunks.where("window = 2").limit(1))  # a row twice
    again, told2, due = W.score_due(cells, plan, told.where("window <> 4"), broken, columns, "m1", score)
    assert {r.window: r.why for r in due.collect()} == {1: "missing", 2: "corrupt", 3: "corrupt", 4: "new"} and seen.pop() == {1, 2, 3, 4}
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chunks.collect())) and sorted(map(tuple, told2.collect())) == sorted(map(tuple, told.collect()))
    assert {r.why for r in W.due_windows(plan, told, chunks, columns, "m2").collect()} == {"other"}
    assert [r.window for r in W.due_windows(plan.withColumn("top", F.col("top") + (F.col("window") == 2).cast("int")), told, chunks, columns, "m1").collect()] == [2]


def test_gaps_and_overlaps(spark):
    def faults(rows, n=20):
        return {r.window: r.fault for r in W.window_faults(spark.createDataFrame(rows, "window int, top long, height long"), n).collect()}

    assert faults([(0, 0, 10), (1, 10, 10)]) == {}
    assert faults([(0, 0, 9), (1, 10, 10)]) == {0: "gap"}
    assert faults([(0, 0, 11), (1, 10, 10)]) == {0: "overlap"}
    assert faults([(0, 1, 9), (1, 10, 9)]) == {0: "start", 1: "end"}
    assert faults([(0, 0, 10), (1, 10, 0), (2, 10, 10)]) == {1: "empty"}
