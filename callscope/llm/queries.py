"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import bpe, fingerprint, language_model, lexical_search, licenses, mixing, near_dup, neighbours, pii, prefix_trie, secret_scan, substring_dedup, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(table(spark, sf_dir, "documents"), RANKS, PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.scan(table(spark, sf_dir, "documents")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents carry no path: ids are laid out as <source>/<thousand>/<twenty>/<id>."""
    tree = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 20).cast("string"), F.col("doc_id").cast("string"))
    return licenses.scan(table(spark, sf_dir, "documents").withColumn("path", tree))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(table(spark, sf_dir, "documents"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_toxicity": op2_toxicity,
        "op3_neighbours": op3_neighbours,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_mixing": op6_mixing,
        "op7_minhash": op7_minhash,
        "op8_pii": op8_pii,
        "op9_licenses": op9_licenses,
        "op10_imatch": op10_imatch,
        "op11_language_model": op11_language_model,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": substring_dedup.ORACLE,
        "op6_mixing": mixing.ORACLE,
        "op7_minhash": near_dup.ORACLE,
        "op12_prefix_trie": prefix_trie.ORACLE,
        "op13_lexical_search": lexical_search.ORACLE,
    }
