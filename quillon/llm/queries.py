"""Registry of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, common, decontaminate, html_template, langid, quality, secret_scan, simhash, suffix_dedup, token_files, url_graph
from .oracle import ORACLE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def suffix_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_graph.judged(_table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def lang_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    )
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), common.scratch(spark)
    index = token_files.write_token_files(_table(spark, sf_dir, "documents"), folder, path)
    return token_files.read_token_files(index, folder, path).select(
        F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
        F.sha2(secret_scan.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
        secret_scan.joined(F.col("spans"), secret_scan.verdict, lambda s: s["owners"], lambda s: s["repositories"]).alias("verdicts"),
    )


def benchmark_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.judged(docs, model, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_main_text": html_main_text,
        "op2_suffix_substrings": suffix_substrings,
        "op3_bpe_words": bpe_words,
        "op4_simhash_golay": simhash_golay,
        "op5_url_link_graph": url_link_graph,
        "op6_lang_centroids": lang_centroids,
        "op7_token_id_files": token_id_files,
        "op8_secret_ownership": secret_ownership,
        "op9_benchmark_winnowing": benchmark_winnowing,
        "op10_quality_rules": quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
