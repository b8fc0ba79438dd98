"""A training-data pipeline: toxic documents go, repeated lines go, near duplicates go, sources are mixed, documents are packed.

STAGES are (name, function) pairs. Each function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the docs of the next. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.checkpoints import stored
from strataspark.llm.common import read
from strataspark.llm.op3_mixing import mix_sources
from strataspark.llm.op5_line_dedup import dedup_lines
from strataspark.llm.op7_ngram_join import keep_one
from strataspark.llm.op8_packing import default_tokenizer, pack_documents
from strataspark.llm.op10_toxicity import fit_toxicity, score_toxicity


def _counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars set anew."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else df.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones outside the held-out fold, doesn't predict as toxic."""
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share, which only the largest doc_id keeps."""
    return _counted(dedup_lines(docs), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources again, as their weights ask."""
    return mix_sources(docs)[0].select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, default_tokenizer())


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_near_copies), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's rows are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (stage, function) in enumerate(STAGES):
        docs = stored(function(spark, docs, sf_dir), f"pipeline-{k}_{stage}")
    return docs
