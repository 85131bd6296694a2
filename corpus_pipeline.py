"""The corpus pipeline: ``documents`` to token files in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet in the shared folder and reads them back as the next
stage's ``docs``.  All stages but the last keep the columns of ``documents``.

Defined cases, for any columns that come along: null and empty texts are scored by
their structure, are one text to the near-duplicates stage, are never contaminated
and never taken by the mix; of equal rows one is kept by the near-duplicates stage, of
rows without doc_id one for each text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, near_copies, quality, simhash, token_files
from tidemark.llm.storage import materialised, shared_path

END_ID = 1


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged."""
    return quality.good_only(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8 or more), that of the smallest doc_id."""
    return simhash.one_of_each(docs, near_copies.near_copies)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; a stray window in one that stays is cut out."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights; a document taken twice is there twice."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows; per row its place in them."""
    import public_tokenizers

    return token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
    ("token files", tokens),
]

#: A learned classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialised(docs, f"{at}/{k}")
    return docs
