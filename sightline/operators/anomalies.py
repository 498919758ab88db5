"""Outliers, sudden changes and sparse columns as rows of one shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from sightline.operators.profile import NULL_WARNING_PCT, measures_of, melt, null_profile
from sightline.plans.ordering import order_key
from sightline.plans.quantiles import column_summary
from sightline.plans.shared import settle
from sightline.plans.sweep import first_jumps

MIN_VALUES = 10
SHOWN_ZSCORE, SHOWN_IQR, SHOWN_CHANGE, SHOWN_ALL = 3, 2, 2, 10
FIELDS = (
    "detector", "position", "column_name", "value", "value_text", "row_key",
    "anomaly_type", "severity", "z_score",
)


def _flags(rows: DataFrame, detector: int, **given: Column) -> DataFrame:
    empty = {
        "value": F.lit(None).cast("double"),
        "value_text": F.lit(None).cast("string"),
        "row_key": F.lit(None).cast("long"),
        "z_score": F.lit(None).cast("double"),
    }
    named = {**{f: F.col(f) for f in FIELDS}, **empty, **given, "detector": F.lit(detector)}
    return rows.select(*[named[f].alias(f) for f in FIELDS])


def _flagged(df: DataFrame, order_by: str, cells: dict[str, Column], tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Cells for which a test holds: column_name, position, value, row_key, mark.

    A test is a condition and a number to keep. Only flagged cells become rows.
    """
    key = order_key(df, order_by)
    found = [
        F.when(
            condition,
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column_name"),
                cells[name].alias("value"),
                mark.cast("double").alias("mark"),
            ),
        )
        for i, name in enumerate(cells)
        if name in tests
        for condition, mark in [tests[name]]
    ]
    if not found:
        found = [F.lit(None).cast("struct<position:int,column_name:string,value:double,mark:double>")]
    return df.select(key.alias("row_key"), F.inline(F.array_compact(F.array(*found))))


def _first_rows(rows: DataFrame, shown: int, *order: str) -> DataFrame:
    """First rows per column; each task forwards at most ``shown`` per column."""
    nth = F.row_number().over(Window.partitionBy("column_name").orderBy(*order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= shown).drop("_nth")


def anom_zscore(
    df: DataFrame, columns: Sequence[str] | None, order_by: str, summary: DataFrame | None = None
) -> DataFrame:
    """Values beyond three population deviations; the first three per column.

    ``summary`` may hold a ``column_summary`` of the same columns.
    """
    cells = measures_of(df, columns)
    names = list(cells)
    if summary is None:
        stats = df.agg(
            *[
                f(c).alias(f"{label}_{i}")
                for i, c in enumerate(cells.values())
                for label, f in (("n", F.count), ("mean", F.avg), ("std_pop", F.stddev_pop))
            ]
        )
        summary = melt(stats, names, ["n", "mean", "std_pop"])
    tests = {}
    # One driver row per column.
    for r in summary.select("column_name", "n", "mean", "std_pop").collect():
        if r["n"] >= MIN_VALUES and r["std_pop"]:
            z = (cells[r["column_name"]] - F.lit(r["mean"])) / F.lit(r["std_pop"])
            tests[r["column_name"]] = (F.abs(z) > 3.0, z)
    far = _flagged(df, order_by, cells, tests).withColumnRenamed("mark", "z_score")
    high = F.col("z_score") > 3.0
    return _flags(
        _first_rows(far, SHOWN_ZSCORE, "row_key", "value"),
        1,
        value=F.col("value"),
        row_key=F.col("row_key"),
        z_score=F.col("z_score"),
        anomaly_type=F.when(high, "outlier_high").otherwise("outlier_low"),
        severity=F.when(high, "high").otherwise("medium"),
    )


def anom_iqr(
    df: DataFrame, columns: Sequence[str] | None, order_by: str, reported: DataFrame | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Values outside the quartile fences; the first two per column not yet reported."""
    cells = measures_of(df, columns)
    if summary is None:
        summary = column_summary(df, cells, {"q25": 0.25, "q75": 0.75})
    tests = {}
    # One driver row per column.
    for r in summary.select("column_name", "n", "q25", "q75").collect():
        if r["n"] >= MIN_VALUES and r["q75"] > r["q25"]:
            reach = (r["q75"] - r["q25"]) * 1.5
            v = cells[r["column_name"]]
            above = v > r["q75"] + reach
            tests[r["column_name"]] = (above | (v < r["q25"] - reach), above)
    out = _flagged(df, order_by, cells, tests)
    if reported is None:
        reported = anom_zscore(df, columns, order_by)
    # At most three reported rows per column.
    seen, _ = settle(reported.where("detector = 1").select("column_name", "row_key", "value"), SHOWN_ZSCORE * len(cells))
    # Where a key repeats, equal cells are as good as each other: as many of them are left out as were reported.
    # So many first rows hold those reported and those to show.
    cell = ["column_name", "row_key", "value"]
    first = _first_rows(out, SHOWN_IQR + SHOWN_ZSCORE, "row_key", "value")
    copies = first.withColumn("_copy", F.row_number().over(Window.partitionBy(*cell).orderBy("mark")))
    reported_cells = seen.groupBy(*cell).agg(F.count(F.lit(1)).alias("_reported"))
    out = copies.join(F.broadcast(reported_cells), cell, "left").where(F.col("_copy") > F.coalesce("_reported", F.lit(0))).drop("_copy", "_reported")
    return _flags(
        _first_rows(out, SHOWN_IQR, "row_key", "value"),
        2,
        value=F.col("value"),
        row_key=F.col("row_key"),
        anomaly_type=F.when(F.col("mark") == 1.0, "outlier_high").otherwise("outlier_low"),
        severity=F.lit("medium"),
    )


def anom_sudden_change(
    df: DataFrame, columns: Sequence[str] | None, date_col: str, order_by: str
) -> DataFrame:
    """Change of more than half against the last value before it in date order.

    Rows without a date come last. A missing value takes the value before it, so
    it is neither a change itself nor the base of one: null cells drop out first.
    """
    cells = measures_of(df, columns)
    names = list(cells)
    # One sorted row per table row carries all columns.
    fields = [f"_v{i}" for i in range(len(names))]
    wide = df.select(
        order_key(df, date_col).alias("_t"), order_key(df, order_by).alias("row_key"), *[c.alias(f) for c, f in zip(cells.values(), fields)]
    )
    jumps = first_jumps(wide, ["_t", "row_key"], fields, 0.5, SHOWN_CHANGE)
    named = F.array(*[F.lit(n) for n in names])
    jumps = jumps.withColumn("column_name", F.get(named, F.col("position")))
    return _flags(
        _first_rows(jumps, SHOWN_CHANGE, "_t", "row_key"),
        3,
        value=F.col("value"),
        row_key=F.col("row_key"),
        anomaly_type=F.lit("sudden_change"),
        severity=F.lit("high"),
    )


def anom_missing(df: DataFrame) -> DataFrame:
    """Columns with more than 30 % nulls (above 50 %: high)."""
    sparse = null_profile(df).where(F.col("null_pct") > NULL_WARNING_PCT)
    return _flags(
        sparse,
        4,
        value=F.col("null_pct"),
        value_text=F.concat(F.col("null_pct").cast("string"), F.lit("% missing")),
        row_key=F.lit(-1).cast("long"),
        anomaly_type=F.lit("missing_spike"),
        severity=F.when(F.col("null_pct") > 50.0, "high").otherwise("medium"),
    )


def anom_merge(flags: DataFrame, shown: int = SHOWN_ALL) -> DataFrame:
    """The ten most severe flags in detector, column and row order, each with a sentence."""
    rank = F.when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    top = flags.withColumn("_rank", rank).orderBy("_rank", "detector", "position", "row_key").limit(shown)
    shown_value = F.coalesce("value_text", F.col("value").cast("string"))
    return top.drop("_rank").withColumn(
        "explanation",
        F.format_string("Detected %s in %s with value %s.", "anomaly_type", "column_name", shown_value),
    )


def detect(
    df: DataFrame,
    columns: Sequence[str] | None,
    order_by: str,
    date_col: str | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """All detectors merged; the column statistics are computed once for both outlier rules."""
    if summary is None:
        cells = measures_of(df, columns)
        summary, _ = settle(column_summary(df, cells, {"q25": 0.25, "q75": 0.75}), len(cells))
    far, _ = settle(anom_zscore(df, columns, order_by, summary))
    flags = far.unionByName(anom_iqr(df, columns, order_by, far, summary))
    if date_col is not None:
        flags = flags.unionByName(anom_sudden_change(df, columns, date_col, order_by))
    return anom_merge(flags.unionByName(anom_missing(df)))
