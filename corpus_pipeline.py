"""A training corpus from the documents: quality rules, near-duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlynx.llm.common import materialise, table
from ledgerlynx.llm.jaccard import one_of_each
from ledgerlynx.llm.packing import pack_documents
from ledgerlynx.llm.pii import redact_documents
from ledgerlynx.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return redact_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048."""
    ranks, own = (public_tokenizers.path(f"byte_bpe_50k.{end}") for end in ("tiktoken", "json"))
    return pack_documents(docs, ranks, own, public_tokenizers.PATTERN, capacity=2048, end_id=0)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("personal data", personal_data), ("best-fit packing", packing)]

#: zstandard ratios and boosted trees have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
