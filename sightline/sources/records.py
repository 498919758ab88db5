"""Optional sampling, and records ready for JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.types import FLOATS, kind, quoted

SEED = 42
LOAD_LIMIT, LOAD_SAMPLE = 100_000, 50_000
RECORD_LIMIT = 30_000
HASH_SPAN = 1_000_000_007


def sample_cap(df: DataFrame, key: Sequence[str], size: int, limit: int | None = None, seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows when the table has more than ``limit``, else the table.

    The choice depends on the row key and the seed alone. Rows are thinned by
    their hash before they are sorted, so no more than about ``1.2 * size`` rows
    are ever brought together. Never used unless asked for.
    """
    total = df.count()
    if total <= (limit if limit is not None else size):
        return df
    mark = F.xxhash64(*[quoted(c) for c in key], F.lit(seed))
    share = min(1.0, (size * 1.2 + 2_000) / total)
    thin = df.where(F.pmod(mark, F.lit(HASH_SPAN)) < int(share * HASH_SPAN))
    if share >= 1.0 or thin.count() < size:
        thin = df
    return thin.orderBy(mark, *[quoted(c) for c in key]).limit(size)


def to_records(df: DataFrame) -> DataFrame:
    """Datetimes as ISO text to the second; NaN and infinities as null."""
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if kind(f.dataType) == "datetime":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, FLOATS):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def records_sink(
    df: DataFrame, path: str, fmt: str = "json", key: Sequence[str] | None = None, limit: int | None = None
) -> dict:
    """Write records; with ``key`` and ``limit`` a sample of ``limit`` rows at most.

    Returns whether it was sampled and how many rows were written.
    """
    sampled = limit is not None and key is not None and df.count() > limit
    rows = sample_cap(df, key, limit) if sampled else df
    to_records(rows).write.mode("errorifexists").format(fmt).save(path)
    written = df.sparkSession.read.format(fmt).schema(to_records(df).schema).load(path).count()
    return {"sampled": sampled, "sample_size": written}
