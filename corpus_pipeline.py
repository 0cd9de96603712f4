"""A training corpus from raw documents: quality, near duplicates, repeated passages, source mix, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import chunks, mixing, ngramjoin, packing, quality
from lodestar.llm.queries import held_out, table, tokenizer_path
from lodestar.llm.scratch import Scratch


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from labelled rows that aren't held out."""
    return quality.score_quality(docs, table(spark, sf_dir, "labels"), train=~held_out(F.col("k")), keep=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 of five-word shingles."""
    return ngramjoin.keep_one_each(docs, words=5, num=8, den=10)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier."""
    return chunks.dedup_chunks(docs, columns=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), window=1024)


STAGES = [
    ("quality classifier", accept_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on the written rows of the one before."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.write(docs)
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
