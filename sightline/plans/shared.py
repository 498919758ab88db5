"""Shared storage and size-checked helpers for multi-pass operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a derived table that may be sent to every executor. The tables that
# pass this check hold a handful of scalars per row, so 10,000 rows stay below
# a few MB.
BROADCAST_ROWS = 10_000


def shared_root(spark: SparkSession) -> str:
    """Folder reachable by every executor: the one named in spark.checkpoint.dir.

    Only a local session that names none (tests, a single machine) gets a new
    folder; on a cluster the executors could not see it, so there it is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sightline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/sightline-{label}-{uuid.uuid4().hex}"


def reliable(df: DataFrame) -> DataFrame:
    """Write the rows once to shared storage; later passes read them back."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Compute a table expected to be small once.

    At most ``limit + 1`` rows reach the driver. When the table fits it comes
    back as literal rows together with True and may be broadcast; otherwise the
    unchanged lazy table comes back with False and must be joined by shuffle.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return df, False
    return df.sparkSession.createDataFrame(rows), True


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join to a derived table: broadcast when its checked size allows it."""
    settled, fits = settle(small)
    return big.join(F.broadcast(settled) if fits else settled, on, how)


def beside(big: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate next to every row."""
    return big.crossJoin(F.broadcast(one_row))
