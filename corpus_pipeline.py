"""From raw documents to packed sequences: five stages, each one operator over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.exact_dedup import exact_dedup
from foliant.llm.mixing import mix
from foliant.llm.near_dedup import near_dedup
from foliant.llm.packing import pack
from foliant.llm.quality_classifier import quality_classifier
from foliant.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier(docs, labels, carry=docs.columns).where("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the smallest doc_id."""
    return exact_dedup(docs, keep="smallest", carry=docs.columns).where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the rows with the smallest doc_id; a null id stays only in a group without another."""
    # What near_dedup decides depends on a row's id and text alone, so these two name it where ids repeat or are null.
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    gone = near_dedup(docs.select("doc_id", "text", digest.alias("digest")), carry="digest").where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_digest"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & (digest == F.col("_digest")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them, shards together and shuffled within."""
    return mix(docs).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all drawn documents and their places in sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: No SQL: a fitted classifier, MinHash, a random splitting tree and a tokenizer come into it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else scratch.save(out)
    return docs
