"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinseworks.llm.conversations import conversation_repairs
from rinseworks.llm.decontaminate import find_contamination
from rinseworks.llm.fingerprint import fingerprint_with_next
from rinseworks.llm.hilbert import hilbert_shards, shards_sql
from rinseworks.llm.jaccard_join import jaccard_components
from rinseworks.llm.language import language
from rinseworks.llm.neighbours import every_twentieth
from rinseworks.llm.packing import pack
from rinseworks.llm.pii import pii_digest
from rinseworks.llm.quality import quality
from rinseworks.llm.recompression import remove_repeats
from rinseworks.llm.resampling import resample
from rinseworks.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language(table(spark, folder, "documents"))


@query
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def vocabulary() -> dict[str, str]:
    """Places of the public byte-level vocabulary, which is not part of this repository."""
    import public_tokenizers

    return {
        "vocabulary": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
    }


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pack(docs, **vocabulary()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


@query
def op5_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_with_next(table(spark, folder, "documents"))


@query
def op3_hilbert_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert_shards(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


SQL["op3_hilbert_sharding"] = shards_sql()


@query
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii_digest(table(spark, folder, "documents"))


@query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repairs(table(spark, folder, "conversations"))


@query
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return every_twentieth(table(spark, folder, "embeddings"))
