"""op5 with filters that are too small for the table, so that the hash's ranges take turns."""

from pyspark.sql import functions as F

from strataspark.llm import op5_line_dedup as op5
from tests.conftest import DATA


def drops(df):
    return {r._id: sorted(map(bytes, r.drops)) for r in df.collect()}


def test_ranges_of_the_hash_give_the_same_lines(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    n = docs.select(F.explode(F.split("text", "\n"))).count()
    assert 8 * n > 2**13
    whole = drops(op5.repeated_lines(docs))
    assert len(whole) > 10 and drops(op5.repeated_lines(docs, max_log2=12)) == whole


def test_a_line_that_all_documents_share(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line that everyone has\n"), F.lit("line of its own, number "), "id").alias("text"))
    got = op5.dedup_lines(docs)
    assert got.agg(F.sum("n_dropped")).first()[0] == 3999
    assert got.where("n_dropped = 0").collect()[0].doc_id == 3999


def test_many_repeats_go_by_a_join(spark):
    """Even the repeats are too many for one filter."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line of a group, number "), (F.col("id") % 900).cast("string"), F.lit("\na line of its own, number "), "id").alias("text"))
    whole = drops(op5.repeated_lines(docs))
    assert len(whole) == 2100 and drops(op5.repeated_lines(docs, max_log2=10)) == whole


def test_jobs_do_not_grow_with_the_ranges(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line of its own, number "), "id").alias("text"))
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for k, log2 in enumerate((13, 9)):
        spark.sparkContext.setJobGroup(f"ranges-{k}", "")
        op5.repeated_lines(docs, max_log2=log2).count()
        jobs.append(len(tracker.getJobIdsForGroup(f"ranges-{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 4


def test_many_dropped_lines_in_one_document(spark):
    import time

    def seconds(n):
        text = "\n".join(f"a repeated line, number {k}" for k in range(n))
        docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string").repartition(3)
        began = time.time()
        assert sorted(r.n_dropped for r in op5.dedup_lines(docs).collect()) == [0, n, n]
        return time.time() - began

    seconds(1000)
    few, many = seconds(6000), seconds(24000)
    assert many < 4 * few + 2
