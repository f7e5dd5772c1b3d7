"""The registered queries of the operators: thin, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_package, table
from .exact_topk import SQL as _topk_sql
from .near_duplicates import SQL as _near_sql
from .quality_rules import SQL as _rules_sql


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_topk import top_k

    ship_package(spark)
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0, k=10)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score_documents

    ship_package(spark)
    return score_documents(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    ship_package(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_quality_rules

    return apply_quality_rules(table(spark, sf_dir, "documents")).drop("host", "host_rate")


def op5_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_index import read_documents, stored_keys, write_corpus

    ship_package(spark)
    folder = write_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    read = read_documents(spark, folder, stored_keys(spark, folder))
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    ship_package(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    ship_package(spark)
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def bpe_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    from .bpe import bpe_encode_decode

    ship_package(spark)
    out = bpe_encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark, table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))[0]


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


QUERIES = {"op6_near_duplicates": op6_near_duplicates, "op3_lm_scoring": op3_lm_scoring, "op1_exact_topk": op1_exact_topk, "op4_quality_classifier": op4_quality_classifier, "op9_bpe": op9_bpe, "op7_token_counts": op7_token_counts, "op5_token_index": op5_token_index, "op2_quality_rules": op2_quality_rules, "op8_mixing": op8_mixing, "op10_sharding": op10_sharding}
SQL: dict[str, str] = {"op1_exact_topk": _topk_sql, "op2_quality_rules": _rules_sql, "op6_near_duplicates": _near_sql}
