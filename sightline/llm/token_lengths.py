"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their encoded length; suffix sums over the lengths then
answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lengths are summed in blocks of so many, and the blocks after that.
BLOCK = 1 << 12


def encoded_length(spark: SparkSession, text: Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """Number of tokens of a whole text; 0 for null and empty texts. Strings of special tokens are ordinary text."""
    shared = spark.sparkContext.broadcast((ranks, pattern))

    @F.arrow_udf(T.LongType())
    def lengths(texts: pa.Array) -> pa.Array:
        import tiktoken

        ranks, pattern = shared.value
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return pa.array([len(coder.encode_ordinary(t.as_py() or "")) for t in texts], pa.int64())

    return lengths.asNondeterministic()(text)


def histogram(docs: DataFrame, length: str) -> DataFrame:
    """(n_tokens, n_docs) for every length that occurs; rows without a length are left out."""
    return docs.where(F.col(f"`{length}`").isNotNull()).groupBy(F.col(f"`{length}`").cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For every length L of a histogram, what any limit needs to know.

    docs_from and tokens_from: documents of L tokens or more, and their tokens;
    docs_upto and tokens_upto: those of L or fewer; truncated_total: tokens left if
    every document is cut to L. An empty histogram gives no rows. Blocks of lengths
    are summed apart, and only block totals, one row for BLOCK lengths, meet.
    """
    rows = lengths.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    up = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    every = Window.partitionBy()
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"),
    )
    out = rows.join(blocks, "block").select(
        "n_tokens", "n_docs", "tokens", "all_docs", "all_tokens",
        (F.sum("n_docs").over(up) + F.col("docs_before")).alias("docs_upto"), (F.sum("tokens").over(up) + F.col("tokens_before")).alias("tokens_upto"),
    )
    docs_from, tokens_from = F.col("all_docs") - F.col("docs_upto") + F.col("n_docs"), F.col("all_tokens") - F.col("tokens_upto") + F.col("tokens")
    return out.select(
        "n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), "docs_upto", "tokens_upto",
        (F.col("tokens_upto") - F.col("tokens") + F.col("n_tokens") * docs_from).alias("truncated_total"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut to ``limit``; also for lengths that don't occur."""
    above = sums.where(F.col("n_tokens") >= limit).agg(F.max("docs_from")).first()[0] or 0
    below = sums.where(F.col("n_tokens") < limit).agg(F.max("tokens_upto")).first()[0] or 0
    return below + max(limit, 0) * above


def quantile(sums: DataFrame, q: float) -> int | None:
    """Smallest length that at least the share ``q`` of the documents don't exceed; None without documents."""
    n = sums.agg(F.max("docs_upto")).first()[0]
    if n is None:
        return None
    return sums.where(F.col("docs_upto") >= max(1, math.ceil(q * n))).agg(F.min("n_tokens")).first()[0]
