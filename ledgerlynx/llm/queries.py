"""The registered queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .common import shared_folder, table
from .conversations import damaged, repair
from .hard_negatives import hard_negatives
from .hnsw import near_duplicates
from .html_extract import extract_text
from .jaccard import jaccard_components
from .mixing import mix, taken
from .packing import pack_documents
from .pii import digest, find_personal_data
from .quality import quality_rules
from .sharding import shard_documents
from .sql import ORACLES
from .training_order import write_in_order
from .url_filter import Rule, filter_urls

#: The rules that the URL query is asked to apply.
URL_RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, own = (public_tokenizers.path(f"byte_bpe_50k.{end}") for end in ("tiktoken", "json"))
    return pack_documents(table(spark, sf_dir, "documents"), ranks, own, public_tokenizers.PATTERN, capacity=2048, end_id=0)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93).drop("recall")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(table(spark, sf_dir, "documents")))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, own = (public_tokenizers.path(f"byte_bpe_50k.{end}") for end in ("tiktoken", "json"))
    folder = f"{shared_folder(spark)}/llm/training-{uuid.uuid4().hex}"
    return write_in_order(table(spark, sf_dir, "documents"), folder, ranks, own, public_tokenizers.PATTERN, key=20240101, stride=2048, per_shard=4096, end_id=50256)


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, relabel=shifted)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"), damage=damaged)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_best_fit_packing, op2_sharding, op3_embedding_near_dedup, op4_byte_bpe, op5_quality_rules, op6_html_extraction, op7_ngram_jaccard_join, op8_url_filters, op9_personal_data,
        op10_training_order, op11_hard_negative_mining, op12_source_mixing, op13_conversation_repair,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
