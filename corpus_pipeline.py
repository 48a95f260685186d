"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, BPE.

Each stage takes all that the one before it kept and is written as Parquet
before the next one reads it.  All but the last return the columns of the
documents table.  Rows repeat and columns may be null anywhere; a stage treats
a null text as empty and names its decision in its own docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import bpe, common, decontaminate, quality, secret_scan, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the counted rules or the classifier (fitted on labelled documents) reject; null and empty texts go.

    Repeated rows go or stay together; without labels of both kinds the counted rules decide alone.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filtered(docs, model)


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the key (id, hash of the text) under which operators name rows, beside any columns they have."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).withColumn("id", F.col("doc.doc_id")).withColumn(
        "th", F.xxhash64(F.coalesce(F.col("doc.text"), F.lit("")))
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least document (by id, null last, then text hash) of each group of similar ones; of rows with one id and text, one.

    Null and wordless texts are one group; of an empty table nothing is kept.
    """
    named = simhash.similar(docs).groupBy("id", "th").agg(F.count(F.lit(1)).alias("n"), F.first(F.expr("id <=> first_id AND th = first_th")).alias("kept"))
    named = common.saved(named, common.scratch(spark), "named")
    gone = common.small(named.where("NOT kept").select(F.col("id").alias("gid"), F.col("th").alias("gth")))
    left = _keyed(docs).join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left_anti")
    # only rows that repeat are shuffled to find their copies
    twice = common.small(named.where("kept AND n > 1").select(F.col("id").alias("rid"), F.col("th").alias("rth")))
    same = F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))
    return left.join(twice, same, "left_anti").unionAll(left.join(twice, same, "left_semi").dropDuplicates(["id", "th"])).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold any window of a benchmark item; null texts hold none, repeated rows go or stay together."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = common.small(found.where("n_hit > 0").select(F.col("id").alias("bid"), F.col("th").alias("bth")).distinct())
    return _keyed(docs).join(bad, F.col("id").eqNullSafe(F.col("bid")) & (F.col("th") == F.col("bth")), "left_anti").select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every live-looking secret and every copied example by a mark of its own, and count the characters anew.

    No document goes; a null text stays null; repeated rows stay repeated.
    """
    clean = secret_scan.redacted(docs, secret_scan.scan(docs).select("id", "text_hash", "spans"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def bpe_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids (little-endian uint32) of each document, and a hash of what they decode to; a null text has none.

    Repeated rows give a row each.
    """
    out = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("bpe_words", bpe_words),
]

#: Training, fingerprints and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared scratch folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.scratch(spark)
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), folder, name)
    return docs
