"""Documents to training sequences: language, toxicity, near duplicates, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import grouping_packer, ppm_language, simhash_blocks, toxic_segments
from twinfold.llm.common import table
from twinfold.llm.queries import BYTE_BPE, END_ID, SEQUENCE
from twinfold.session import scratch, shared_folder

BITS, SHINGLE = 4, 4  # fingerprints link at so many differing bits or fewer; words of a shingle
LEAST_SURE = 0.5  # a document whose language is less sure than this is rejected


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those whose language stays unsure are rejected."""
    trees = ppm_language.learn(docs)
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), ppm_language.language(docs, trees).alias("p"))
    kept = (F.col("p.lang_pred") != ppm_language.UNKNOWN) & (F.col("p.score") >= LEAST_SURE)
    return judged.where(kept).select("doc.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic are rejected."""
    model = toxic_segments.learn(docs, table(spark, sf_dir, "labels"))
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), toxic_segments.toxicity(docs, model).alias("score"))
    return judged.where(F.col("score") < toxic_segments.THRESHOLD).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their SimHash fingerprints the one with the smallest id stays."""
    return simhash_blocks.keep_one(docs, BITS, SHINGLE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return grouping_packer.pack_documents(docs, public_tokenizers.path(BYTE_BPE), END_ID, SEQUENCE)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("best_fit_packing", packing),
]

# The classifiers and the fingerprints cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again.

    What a stage stores besides goes when it has been written.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/twinfold/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
