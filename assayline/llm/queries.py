"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ranks import rounded
from . import sql
from .bpe_transducer import BpeParams, bpe_round_trip
from .centroids import shallot, with_clusters
from .chat_format import repair_chats
from .fingerprints import fingerprints
from .host_rules import host_rules
from .licenses import scan_licenses
from .merkle import manifest
from .mixing import mix_plan
from .near_dup import near_duplicates
from .packing import pack
from .sharding import shuffle_into_shards
from .token_output import TokenParams, ids_round_trip
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    params = TokenParams(tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    return ids_round_trip(_table(spark, sf_dir, "documents"), params)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are moved; sizes and checksums are those of the texts that arrived."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return shuffle_into_shards(docs, stable=True).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_chats(_table(spark, sf_dir, "conversations"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(_table(spark, sf_dir, "documents")).withColumn("host_rate", rounded("host_rate"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.col("size") * F.size("copies")
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("copies.shard").alias("shards"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    params = BpeParams(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    back = bpe_round_trip(_table(spark, sf_dir, "documents"), params)
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256")
    return back.select("doc_id", "n_tokens", *digests, "broken")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_clusters(*shallot(_table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_licenses": op2_licenses,
    "op3_sharding": op3_sharding,
    "op4_fingerprints": op4_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_chat_format": op6_chat_format,
    "op7_best_fit": op7_best_fit,
    "op8_near_dup": op8_near_dup,
    "op9_host_rules": op9_host_rules,
    "op10_mixing": op10_mixing,
    "op11_bpe": op11_bpe,
    "op12_manifest": op12_manifest,
    "op13_centroids": op13_centroids,
}

SQL = {"op2_licenses": sql.licenses(), "op8_near_dup": sql.near_dup(), "op9_host_rules": sql.host_rules(), "op12_manifest": sql.manifest(), "op13_centroids": sql.centroids()}
