"""Text files read in splits, where what a line means depends on the lines before it.

A quoted cell, a statement or a comment may run over line and split ends. Each split is
first summed up by what it does to every state that it may begin in; the summaries of a
file's splits, taken one after the other, tell the state in which each split really
begins; then all splits are read again independently. A file is so worked on by as many
tasks as it has splits (``spark.sql.files.maxPartitionBytes``), whatever its size.

The driver gets one row for each split that begins inside of something, at most as many as
it has splits to schedule. Lines end at line feeds; compressed files are one split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def located(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, start): each line's bytes, its file, and where the split begins that holds it, in order within a split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(file, start, rows) for consecutive rows of one split; a split may come in several pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = (pc.run_end_encode(batch.column(batch.schema.get_field_index(c))) for c in ("file", "start"))
        names, places = files.values.to_pylist(), starts.values.to_pylist()
        file_ends, start_ends = files.run_ends.to_pylist(), starts.run_ends.to_pylist()
        low = i = j = 0
        while low < batch.num_rows:
            high = min(file_ends[i], start_ends[j])
            yield names[i], places[j], batch.slice(low, high - low)
            i, j, low = i + (file_ends[i] == high), j + (start_ends[j] == high), high


def in_order(summaries: DataFrame, columns: list[str], begin: Callable[[], dict], step: Callable[[dict, dict], tuple[dict | None, dict]], kind: str) -> list:
    """What each split begins with, for the splits where that is anything.

    ``summaries`` has a row of file, start and ``columns`` for each split. Within a
    file, ``step(state, row)`` gives what to tell about the split (None: nothing) and the
    state behind it; the last row has ``last`` set. ``kind`` is the DDL of what is told.
    """

    returns = T.StructType.fromDDL(f"told array<struct<start: bigint, {kind}>>")["told"].dataType
    arrow = to_arrow_type(returns)

    @F.arrow_udf(returns)
    def told(listed: pa.Array) -> pa.Array:
        out = []
        for group in listed.to_pylist():
            state, found = begin(), []
            for n, row in enumerate(group):
                row["last"] = n == len(group) - 1
                here, state = step(state, row)
                if here is not None:
                    found.append({"start": row["start"], **here})
            out.append(found)
        return pa.array(out, arrow)

    listed = summaries.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", *columns))).alias("splits"))
    return listed.select("file", F.explode(told("splits")).alias("t")).select("file", "t.*").collect()
