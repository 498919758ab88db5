"""Exact order statistics in few scans, without holding all values in one task.

The built-in exact percentile keeps one map entry per distinct value and group.
Here a mergeable sketch first brackets each wanted rank from below and above: a
fraction of about 8 / accuracy of the rows per rank. Brackets that hold more than
BRACKET_ROWS rows are cut again, as often as needed. The last scan counts everything
outside the brackets with map-side aggregation and keeps single values only inside
them, so that what one task ranks has a fixed bound at any size of the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.plans.shared import beside, join_small, reliable, settle

ACCURACY = 20_000
MARGIN = 4.0 / ACCURACY
# Groups up to this size are bracketed by their own minimum and maximum, which
# also keeps the margin of larger groups above ten ranks.
WHOLE_GROUP_ROWS = 50_000
# Rows that may lie within a bracket when its values are ranked in one task.
BRACKET_ROWS = 1_000_000
# Cells into which a larger bracket is cut; the wanted ranks' cells and one on either side stay.
CELLS = 1_000
SUMMARY = ("n", "mean", "std", "std_pop", "min", "max")


@dataclass(frozen=True)
class Rank:
    """A wanted order statistic: its name, rough position and exact 1-based rank."""

    name: str
    near: float
    rank: Callable[[Column], Column]


def quantile_ranks(probability: float) -> tuple[Rank, Rank]:
    """The two ranks between which a linear quantile is interpolated."""

    def low(n: Column) -> Column:
        return F.floor(F.lit(probability) * (n - 1)) + 1

    def high(n: Column) -> Column:
        return F.ceil(F.lit(probability) * (n - 1)) + 1

    tag = f"{probability:g}".replace(".", "_")
    return Rank(f"_lo_{tag}", probability, low), Rank(f"_hi_{tag}", probability, high)


def sketch(value: Column, positions: list[float]) -> Column:
    """One array [low, high, low, high, ...] around the given positions."""
    edges: list[float] = []
    for p in positions:
        edges += [max(0.0, p - MARGIN), min(1.0, p + MARGIN)]
    return F.percentile_approx(value, edges, ACCURACY)


def segment(v: Column, lows: list[Column], highs: list[Column]) -> Column:
    """Odd numbers inside a bracket, even numbers between brackets, in value order."""
    place = F.lit(2 * len(lows))
    for i in reversed(range(len(lows))):
        place = F.when(v < lows[i], F.lit(2 * i)).when(v <= highs[i], F.lit(2 * i + 1)).otherwise(place)
    return place


def narrowed(
    rows: DataFrame, value: str, by: list[str], edges: DataFrame, positions: list[float]
) -> DataFrame:
    """Edges ``_low<i>``, ``_high<i>`` beside ``_n`` whose brackets hold at most BRACKET_ROWS rows, or one value.

    A pass counts the rows below and within each bracket exactly and cuts larger
    brackets to about 4 / CELLS of their rows. The wanted rank is known to lie in a
    bracket before it is cut; where a cut misses it, the side that missed stays.
    """
    spots = range(len(positions))
    largest = edges.agg(F.max("_n")).first()[0] or 0
    if largest <= WHOLE_GROUP_ROWS or 2 * MARGIN * largest <= BRACKET_ROWS:
        return edges
    v = F.col(value)
    grid = [i / CELLS for i in range(CELLS + 1)]
    while True:
        present = rows.where(v.isNotNull())
        joined = join_small(present, edges, by) if by else beside(present, settle(edges)[0])
        inside = [v.between(F.col(f"_low{i}"), F.col(f"_high{i}")) for i in spots]
        seen = joined.groupBy(*by).agg(
            F.first("_n").alias("_n"),
            *[F.first(f"_{side}{i}").alias(f"_{side}{i}") for i in spots for side in ("low", "high")],
            *[F.count_if(v < F.col(f"_low{i}")).alias(f"_below{i}") for i in spots],
            *[F.count_if(c).alias(f"_in{i}") for i, c in enumerate(inside)],
            *[F.percentile_approx(F.when(c, v), grid, ACCURACY).alias(f"_grid{i}") for i, c in enumerate(inside)],
        )
        seen = reliable(seen)
        wide = [(F.col(f"_in{i}") > BRACKET_ROWS) & (F.col(f"_low{i}") < F.col(f"_high{i}")) for i in spots]
        cut = []
        for i, p in enumerate(positions):
            first = F.floor(F.lit(p) * (F.col("_n") - 1)) + 1 - F.col(f"_below{i}")
            last = F.ceil(F.lit(p) * (F.col("_n") - 1)) + 1 - F.col(f"_below{i}")
            low = F.get(F.col(f"_grid{i}"), F.greatest(F.floor(first / F.col(f"_in{i}") * CELLS) - 2, F.lit(0)).cast("int"))
            high = F.get(F.col(f"_grid{i}"), F.least(F.ceil(last / F.col(f"_in{i}") * CELLS) + 2, F.lit(CELLS)).cast("int"))
            cut += [
                F.when(wide[i], low).otherwise(F.col(f"_low{i}")).alias(f"_low{i}"),
                F.when(wide[i], high).otherwise(F.col(f"_high{i}")).alias(f"_high{i}"),
                (wide[i] & ((low > F.col(f"_low{i}")) | (high < F.col(f"_high{i}")))).alias(f"_cut{i}"),
            ]
        moved = seen.select(*by, "_n", *cut)
        again = F.lit(False)
        for i in spots:
            again = again | F.col(f"_cut{i}")
        edges = reliable(moved.drop(*[f"_cut{i}" for i in spots]))
        if moved.where(again).isEmpty():
            return edges


def pick_ranks(segmented: DataFrame, by: list[str], ranks: list[Rank]) -> DataFrame:
    """Exact value at each rank from rows of ``by``, ``_v`` and ``_segment``.

    Values between brackets collapse into one counted row before the shuffle, so
    what is left per group for the running count are the values inside brackets.
    """
    counted = segmented.groupBy(
        *by, "_segment", F.when(F.col("_segment") % 2 == 1, F.col("_v")).alias("_kept")
    ).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("_v").alias("_v"),
        F.max("_v").alias("_v_max"),
        F.avg("_v").alias("_part_mean"),
        F.var_pop("_v").alias("_part_var"),
    )
    group = Window.partitionBy(*by)
    ordered = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns(
        {"_upto": F.sum("_rows").over(ordered), "_n": F.sum("_rows").over(group)}
    ).withColumn("_mean", F.sum(F.col("_rows") * F.col("_part_mean")).over(group) / F.col("_n"))
    # Squared deviations of the parts, each moved from its own mean to the group's.
    shift = F.col("_part_mean") - F.col("_mean")
    squares = F.sum(F.col("_rows") * (F.col("_part_var") + shift * shift))
    hit = F.struct(F.col("_v"), (F.col("_v") == F.col("_v_max")).alias("single"))
    picked = ranked.groupBy(*by).agg(
        F.first("_n").alias("n"),
        F.first("_mean").alias("mean"),
        F.min("_v").alias("min"),
        F.max("_v_max").alias("max"),
        squares.alias("_squares"),
        *[F.min(F.when(F.col("_upto") >= r.rank(F.col("_n")), hit)).alias(r.name) for r in ranks],
    )
    return picked.select(
        *by,
        "n",
        "mean",
        F.sqrt(F.try_divide(F.col("_squares"), F.col("n") - 1)).alias("std"),
        F.sqrt(F.col("_squares") / F.col("n")).alias("std_pop"),
        "min",
        "max",
        *[
            F.when(F.col(r.name).isNull() | F.col(f"{r.name}.single"), F.col(f"{r.name}._v"))
            .otherwise(F.raise_error(F.lit(f"rank {r.name} left its bracket")).cast("double"))
            .alias(r.name)
            for r in ranks
        ],
    )


def order_statistics(
    rows: DataFrame, value: str, ranks: list[Rank], by: list[str] | None = None
) -> DataFrame:
    """Exact values at ``ranks`` of the non-null ``value`` per group."""
    by = by or []
    positions = sorted({r.near for r in ranks})
    v = F.col(value)
    brackets = rows.groupBy(*by).agg(
        F.count(v).alias("_n"),
        F.min(v).alias("_min"),
        F.max(v).alias("_max"),
        sketch(v, positions).alias("_edges"),
    )
    small = F.col("_n") <= WHOLE_GROUP_ROWS
    spots = range(len(positions))
    lows = [F.when(small, F.col("_min")).otherwise(F.col("_edges")[2 * i]) for i in spots]
    highs = [F.when(small, F.col("_max")).otherwise(F.col("_edges")[2 * i + 1]) for i in spots]
    edges = brackets.select(
        *by,
        "_n",
        *[c.alias(f"_low{i}") for i, c in enumerate(lows)],
        *[c.alias(f"_high{i}") for i, c in enumerate(highs)],
    )
    edges = narrowed(rows, value, by, edges, positions).drop("_n")
    present = rows.where(v.isNotNull())
    joined = join_small(present, edges, by) if by else beside(present, settle(edges)[0])
    place = segment(v, [F.col(f"_low{i}") for i in spots], [F.col(f"_high{i}") for i in spots])
    return pick_ranks(joined.select(*by, v.alias("_v"), place.alias("_segment")), by, ranks)


def interpolate(probability: float) -> Column:
    """Linear quantile from the two neighbouring ranks of ``quantile_ranks``."""
    low, high = quantile_ranks(probability)
    place = F.lit(probability) * (F.col("n") - 1)
    return F.col(low.name) + (F.col(high.name) - F.col(low.name)) * (place - F.floor(place))


def quantiles(
    rows: DataFrame, value: str, wanted: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Exact linear quantiles per group: ``by``, the moments and one column per name."""
    ranks = [r for p in wanted.values() for r in quantile_ranks(p)]
    found = order_statistics(rows, value, ranks, by)
    return found.select(*(by or []), *SUMMARY, *[interpolate(p).alias(k) for k, p in wanted.items()])


def to_long(df: DataFrame, cells: dict[str, Column], keep: list[Column] | None = None) -> DataFrame:
    """One row per (row, column): ``column_name``, ``value`` beside ``keep``."""
    wide = df.select(*(keep or []), *[c.alias(f"_cell{i}") for i, c in enumerate(cells.values())])
    kept = [c for c in wide.columns if not c.startswith("_cell")]
    pairs = ", ".join(
        "'" + name.replace("\\", "\\\\").replace("'", "\\'") + f"', _cell{i}"
        for i, name in enumerate(cells)
    )
    return wide.select(
        *[F.col(f"`{k}`") for k in kept],
        F.expr(f"stack({len(cells)}, {pairs}) as (column_name, value)"),
    )


def _narrowed_columns(df: DataFrame, cells: dict[str, Column], found: dict, brackets: list, positions: list[float]) -> list:
    """The brackets of each column, cut until they are small enough; one row per column."""
    sides = [f"_{side}{j}" for j in range(len(positions)) for side in ("low", "high")]
    table = [
        (i, found[f"_n{i}"], *[None if e is None else float(e) for e in (b or [None] * len(sides))]) for i, b in enumerate(brackets)
    ]
    schema = "position int, _n long, " + ", ".join(f"{s} double" for s in sides)
    edges = df.sparkSession.createDataFrame(table, schema)
    args = ", ".join(f"{i}, _v{i}" for i in range(len(cells)))
    stacked = df.select(*[c.cast("double").alias(f"_v{i}") for i, c in enumerate(cells.values())]).select(
        F.expr(f"stack({len(cells)}, {args}) as (position, _v)")
    )
    cut = {r["position"]: [r[s] for s in sides] for r in narrowed(stacked, "_v", ["position"], edges, positions).collect()}
    return [cut.get(i, b) for i, b in enumerate(brackets)]


def column_summary(df: DataFrame, cells: dict[str, Column], wanted: dict[str, float]) -> DataFrame:
    """Count, mean, deviations, extremes and exact quantiles of many columns.

    First scan: one global aggregate over all columns. Second scan: the values
    inside the brackets. One row per column; a column with no
    value has null statistics.
    """
    positions = sorted(set(wanted.values()))
    names = list(cells)
    # One output row, then one row per column: bounded by the table's width.
    aggregates = []
    for i, c in enumerate(cells.values()):
        aggregates += [
            F.count(c).alias(f"_n{i}"),
            F.min(c).alias(f"_min{i}"),
            F.max(c).alias(f"_max{i}"),
            sketch(c, positions).alias(f"_edges{i}"),
        ]
    found = df.agg(*aggregates).first().asDict()
    columns = df.sparkSession.createDataFrame(
        pa.table({"position": range(len(names)), "column_name": names})
    )
    brackets = [
        [found[f"_min{i}"], found[f"_max{i}"]] * len(positions) if found[f"_n{i}"] <= WHOLE_GROUP_ROWS else found[f"_edges{i}"]
        for i in range(len(names))
    ]
    if 2 * MARGIN * max((found[f"_n{i}"] for i in range(len(names))), default=0) > BRACKET_ROWS:
        brackets = _narrowed_columns(df, cells, found, brackets, positions)
    args, segments = [], []
    for i, v in enumerate(cells.values()):
        edges = brackets[i]
        lows = [F.lit(e).cast("double") for e in edges[0::2]]
        highs = [F.lit(e).cast("double") for e in edges[1::2]]
        segments += [v.alias(f"_v{i}"), segment(v, lows, highs).alias(f"_s{i}")]
        args.append(f"{i}, _v{i}, _s{i}")
    stacked = F.expr(f"stack({len(names)}, {', '.join(args)}) as (position, _v, _segment)")
    segmented = df.select(*segments).select(stacked).where("_v is not null")
    ranks = [r for p in wanted.values() for r in quantile_ranks(p)]
    exact = pick_ranks(segmented, ["position"], ranks)
    return columns.join(exact, "position", "left").select(
        "position",
        "column_name",
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        *SUMMARY[1:],
        *[interpolate(p).alias(k) for k, p in wanted.items()],
    )
