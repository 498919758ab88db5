"""A training-data pipeline over ``documents``: clean, deduplicate, decontaminate, redact, encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import bpe_fold, line_rules, minhash_forest, phrase_index, secret_trigrams
from sightline.plans.shared import scratch_path

#: Word shingles of the near-duplicate stage.
SHINGLE = 5
#: Rank file of the encoding stage.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def with_text(rows: DataFrame, text: Column, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with another text and its number of characters."""
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    judged = line_rules.clean(docs, out="line_quality").where("line_quality.kept")
    return with_text(judged, F.col("line_quality.clean_text"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return minhash_forest.keep_one(docs, shingle=SHINGLE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return phrase_index.phrase_hits(docs, benchmark, out="leak").where("leak.n_hit = 0").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the secrets' kinds."""
    rules = secret_trigrams.BASE + secret_trigrams.MORE
    found = secret_trigrams.scan(docs, out="found_secrets", rules=rules)
    text = secret_trigrams.redacted(F.col("text"), F.col("found_secrets"), rules)
    return with_text(found, text, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, the number of these, and whether they decode to the text."""
    ranks = bpe_fold.read_ranks(public_tokenizers.path(VOCABULARY))
    coded = bpe_fold.encode(docs, ranks, out="coded")
    same = F.col("coded.decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    columns = [c for c in docs.columns if c.lower() not in ("token_ids", "n_tokens", "decodes")]
    return coded.select(*columns, F.col("coded.ids").alias("token_ids"), "coded.n_tokens", same.alias("decodes"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("encode", encode)]

#: SQL has no byte-pair encoding; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
