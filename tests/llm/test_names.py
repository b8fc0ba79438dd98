"""Columns whose names the operators use inside, in every one that returns its input's rows."""

from pyspark.sql import functions as F

from strataspark.checkpoints import shared_folder
from strataspark.llm import op3_mixing, op5_line_dedup, op7_ngram_join

NAMES = "row id key hash total rows full passes before within tokens digest drops cut h n place comp block _id _mix_key _mix_total _mix_full _dedup_id _dedup_drops _dedup_stay _keep_id _keep_n".split()


def docs(spark):
    shared_folder(spark)
    lines = "a line that many documents have\nown "
    df = spark.createDataFrame([(i, f"{lines}{i}" if i else None, "s" if i % 3 else None) for i in range(12)] + [(None, "null id", "s"), (None, "null id too", "s")], "doc_id long, text string, source string")
    return df.select("*", *(F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(n) for n in NAMES)).checkpoint()


def held(df):
    """Every row still has the values of its own document."""
    return all(all(r[n] == f"{n}-{'?' if r.doc_id is None else r.doc_id}" for n in NAMES) for r in df.collect())


def test_line_dedup(spark):
    out = op5_line_dedup.dedup_lines(docs(spark))
    assert out.columns == [*docs(spark).columns, "n_lines", "n_dropped"] and out.count() == 14 and held(out)
    assert out.agg(F.sum("n_dropped")).first()[0] == 10


def test_keep_one(spark):
    out = op7_ngram_join.keep_one(docs(spark))
    assert out.columns == docs(spark).columns and held(out) and out.where("doc_id is null").count() == 1


def test_mixing(spark, monkeypatch):
    for most in (op3_mixing.MAX_BROADCAST, 0):
        monkeypatch.setattr(op3_mixing, "MAX_BROADCAST", most)
        out = op3_mixing.mix_sources(docs(spark))[0].checkpoint()
        assert held(out) and out.select("doc_id", "text").distinct().count() == 14
        shown = out.select("doc_id", "mix_epoch", "mix_start").collect()
        if most:
            first = sorted(shown, key=repr)
        assert sorted(shown, key=repr) == first
