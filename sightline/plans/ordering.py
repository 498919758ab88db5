"""Order-dependent calculations without a window over the whole table.

A window with no partition sends every row to one task. The functions here
work on integer order keys cut into digit blocks instead. A block holds at most
2**20 distinct keys, the next level at most 2**20 blocks, and so on, so every
window partition has a fixed upper size whatever the data look like.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.types import DATETIMES, INTEGERS, field_type, quoted
from sightline.plans.shared import reliable

BLOCK_BITS = 20
LAST_KEY = 2**63 - 1


@dataclass(frozen=True)
class Level:
    """Rows sharing ``groups`` are ordered by ``order``.

    ``block`` is the group column made from ``order`` by dropping its low digits,
    if there is one at this level.
    """

    groups: tuple[str, ...]
    order: str
    block: str | None = None


def order_key(df: DataFrame, name: str) -> Column:
    """Order-preserving BIGINT of a datetime or integer column; nulls come last."""
    dtype = field_type(df, name)
    c = quoted(name)
    if isinstance(dtype, T.TimestampNTZType):
        key = F.unix_micros(c.cast("timestamp"))
    elif isinstance(dtype, T.TimestampType):
        key = F.unix_micros(c)
    elif isinstance(dtype, T.DateType):
        key = F.unix_date(c).cast("long")
    elif isinstance(dtype, INTEGERS):
        key = c.cast("long")
    else:
        raise TypeError(f"{name}: {dtype.simpleString()} is not an integer or datetime order key")
    return F.coalesce(key, F.lit(LAST_KEY))


def orderable(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), DATETIMES + INTEGERS)


def key_levels(key: str, within: tuple[str, ...] = ()) -> list[Level]:
    """Levels, finest first, for rows that are unique by ``within + key``."""
    one, two = f"{key}_b1", f"{key}_b2"
    return [
        Level((*within, one), key, one),
        Level((*within, two), one, two),
        Level(within, two),
    ]


def tied_levels(key: str, tie: str, within: tuple[str, ...] = ()) -> list[Level]:
    """Levels for rows ordered by ``key`` and, among equal keys, by ``tie``.

    A key shared by a third of all rows is itself cut into blocks of ``tie``.
    """
    return key_levels(tie, (*within, key)) + key_levels(key, within)


def _blocked(df: DataFrame, level: Level) -> DataFrame:
    if level.block is None:
        return df
    return df.withColumn(level.block, F.shiftright(F.col(level.order), BLOCK_BITS))


def last_before(df: DataFrame, fields: list[str], levels: list[Level]) -> DataFrame:
    """Add ``<field>_before``: the last non-null value of each field in the rows before.

    The last values of each block are carried one level up, so only blocks, not
    rows, travel between levels.
    """
    level = levels[0]
    rows = _blocked(df, level)
    earlier = (
        Window.partitionBy(*level.groups).orderBy(level.order).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = rows.withColumns({f"{f}_before": F.last(f, ignorenulls=True).over(earlier) for f in fields})
    if len(levels) > 1:
        groups = list(level.groups)
        order = F.col(level.order)
        tails = rows.groupBy(*groups).agg(
            *[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
        )
        inherited = last_before(tails, fields, levels[1:]).select(
            *groups, *[F.col(f"{f}_before").alias(f"{f}_inherited") for f in fields]
        )
        out = out.join(inherited, groups, "left").withColumns(
            {f"{f}_before": F.coalesce(f"{f}_before", f"{f}_inherited") for f in fields}
        )
    return out.drop(*[f"{f}_inherited" for f in fields], *([level.block] if level.block else []))


def sums_before(df: DataFrame, sums: list[str], levels: list[Level]) -> DataFrame:
    """Add ``<name>_before``: the sum of each column over all earlier rows."""
    level = levels[0]
    rows = _blocked(df, level)
    earlier = (
        Window.partitionBy(*level.groups).orderBy(level.order).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = rows.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(earlier), F.lit(0)) for s in sums})
    if len(levels) > 1:
        groups = list(level.groups)
        blocks = rows.groupBy(*groups).agg(*[F.sum(s).alias(s) for s in sums])
        offsets = sums_before(blocks, sums, levels[1:]).select(
            *groups, *[F.col(f"{s}_before").alias(f"{s}_offset") for s in sums]
        )
        out = out.join(offsets, groups, "left").withColumns(
            {f"{s}_before": F.col(f"{s}_before") + F.col(f"{s}_offset") for s in sums}
        )
    return out.drop(*[f"{s}_offset" for s in sums], *([level.block] if level.block else []))


def numbered(df: DataFrame, order: list[Column], into: str = "row_no") -> DataFrame:
    """0-based position under a global sort, for keys of any type.

    The sort is range-partitioned, its result is written once to shared storage
    so that positions cannot change between passes, and only one row count per
    partition is summed up. The order should be unique, or equal keys share a task.
    """
    tagged = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    tagged = reliable(tagged).withColumn("_part", F.shiftright("_mid", 33))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per sort partition: bounded by spark.sql.shuffle.partitions.
    offsets = counts.select(
        "_part",
        F.coalesce(
            F.sum("_rows").over(
                Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_offset"),
    )
    position = F.col("_mid") - F.shiftleft("_part", 33) + F.col("_offset")
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(into, position)
        .drop("_mid", "_part", "_offset")
    )
