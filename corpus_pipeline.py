"""A corpus pipeline of the training-data operators: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import exact_dedup, language_id, mixing, packing, simhash
from quillstack.llm.common import discard, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents whose language can't be told go."""
    return language_id.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of texts equal up to white space, the document with the smallest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 on five-word shingles at similarity 0.8: one document of each group stays."""
    return simhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: sources are thinned out or repeated to their target weights."""
    return mixing.take_mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: pieces of the mix with their texts, each with its sequence and position."""
    return packing.pack_documents(docs, with_text=True)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing", mixture),
    ("best-fit packing", sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, each on the materialised result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        if stage is sequences:
            return made
        before, docs = docs, stored(made)
        discard(before)
    return docs
