"""The package's registered queries: the operators with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import (
    bpe_fold, license_digests, line_rules, minhash_forest, phrase_index, ranked_search, scaled_sketch, secret_trigrams, suffix_levels,
    token_lengths, turn_repair, url_ratio, warc_zstd,
)
from sightline.plans.shared import reliable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query
def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4)


@query
def op6_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    found = phrase_index.phrase_hits(documents, table(spark, sf_dir, "benchmark", "item_id", "text"))
    columns = ["n_words", "n_hit", "n_items", "items_sha256"]
    return found.select("doc_id", *[f"leak.{c}" for c in columns], (F.col("leak.n_hit") > 0).alias("contaminated"))


@query
def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_rules.clean(table(spark, sf_dir, "documents", "doc_id", "text"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return cleaned.select("doc_id", *[f"quality.{c}" for c in columns])


@query
def op7_bpe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe_fold.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe_fold.encode(table(spark, sf_dir, "documents", "doc_id", "text"), ranks, keep_ids=False)
    return coded.select("doc_id", *[f"ids.{c}" for c in ("n_tokens", "ids_sha256", "decoded_sha256")])


@query
def op5_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_digests.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "license.digest", "license.license_id", F.array_join("license.notices", ",").alias("notices"))


ORACLE["op5_license_digests"] = license_digests.oracle_sql()


@query
def op9_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_trigrams.BASE + secret_trigrams.MORE
    found = secret_trigrams.scan(table(spark, sf_dir, "documents", "doc_id", "text"), rules=rules)

    def count(kind: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(secret_trigrams.BASE)]
    base = secret_trigrams.listed(F.col("secrets"), rules, len(secret_trigrams.BASE))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_trigrams.listed(F.col("secrets"), rules).alias("spans"))


@query
def op3_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_ratio.judge(table(spark, sf_dir, "pages", "page_id", "url"))
    return judged.select("page_id", *[f"filter.{c}" for c in ("host", "path", "rule", "verdict")])


@query
def op4_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe_fold.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    counted = table(spark, sf_dir, "documents", "text").select(
        token_lengths.encoded_length(spark, F.col("text"), ranks, public_tokenizers.PATTERN).alias("n_tokens")
    )
    return token_lengths.suffix_sums(reliable(token_lengths.histogram(counted, "n_tokens")))


@query
def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc_zstd.archive(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    records = warc_zstd.read(folder, index.select("file").distinct(), payload=False)
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_levels.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", *[f"repeats.{c}" for c in ("n_bytes", "n_removed", "n_spans")], F.sha2("repeats.kept", 256).alias("kept_sha256"))


@query
def op11_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return ranked_search.top_documents(documents, table(spark, sf_dir, "benchmark", "item_id", "text"), k=50)


ORACLE["op12_ranked_search"] = ranked_search.oracle_sql(50)


@query
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return turn_repair.report(turn_repair.damaged(said), said)
