"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept.  All but the last return the columns of ``documents``, whatever extra
ones there are and whatever their names.

A null text is an empty one: it has a score (the model's bias), no shingles, no
words, no secrets and one token, its end.  Very long texts are taken whole.  Rows
that repeat a document's id and text are one group of near duplicates, so one
of them stays; rows without words are in no group and all stay.  Ties are
settled as the operators say.  A row without an id is a row like others, though
the last to stand for its group.  An empty table gives an empty table in every
stage; without labels the classifier rejects nothing, without benchmark items
nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import decontam, ngram_join, packing, quality, secret_scan
from varve.llm.session import fresh_path, release


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score 0.3 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept(docs, quality.quality_model(docs, labels), 0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return ngram_join.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets found in them replaced by a mark."""
    return secret_scan.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    import public_tokenizers

    # a third of the usual cache, as executors hold more at the end of a run
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=150_000)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and what a stage wrote on its way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept: tuple[str, ...] = ()
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        kept = (path,)
        release(spark, kept)
    return docs
