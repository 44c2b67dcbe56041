"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept and returns the columns of documents;
the last returns pieces in sequences. ``run`` writes every result to the shared
folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenfold.llm import decontaminate, disclosure, packing, pairwise_quality, sketch_dedup
from evenfold.llm.common import CHAINED_BYTES, default_batches, documents, remainder_of_id
from evenfold.llm.queries import tokenizer_file
from evenfold.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def chained(stage: Stage) -> Stage:
    """The stage with smaller Arrow batches: executors and their Python workers live through all stages and keep what an earlier one took."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        default_batches(spark, CHAINED_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@chained
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the pairwise ranking rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = pairwise_quality.fit(docs, labels, remainder_of_id(F.col("doc_id"), 3) != 1)
    return pairwise_quality.accepted(docs, model)


@chained
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, similarity 0.8): the one with the smallest id."""
    return sketch_dedup.representatives(docs)


@chained
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a verbatim window of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@chained
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and the terms that reveal it."""
    return disclosure.sanitised(docs)


@chained
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", pack)]

#: The fitted ranking, the tokenizer and the segment tree have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
