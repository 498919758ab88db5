"""Table and column profiles: shape, nulls, duplicates, types, summaries."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions import keywords as K
from sightline.functions.types import (
    FLOATS,
    field_type,
    kind,
    measure,
    numeric_columns,
    percent,
    quoted,
)
from sightline.plans.quantiles import column_summary, to_long
from sightline.plans.shared import settle

QUARTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}
NULL_WARNING_PCT = 30.0
LONG_TEXT = 64


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, any other type unchanged."""
    c = quoted(name)
    return F.when(~F.isnan(c), c) if isinstance(field_type(df, name), FLOATS) else c


def dtype_name(dtype: T.DataType) -> str:
    """Type name; timestamps with and without zone are one type here."""
    return "timestamp" if isinstance(dtype, T.TimestampNTZType) else dtype.simpleString()


def distinct_key(df: DataFrame, name: str) -> Column:
    """The value to count distinct: long texts travel as their digest."""
    c = value(df, name)
    if kind(field_type(df, name)) == "string":
        return F.when(F.length(c) > LONG_TEXT, F.sha2(c, 256)).otherwise(c)
    return c


def melt(one_row: DataFrame, names: Sequence[str], fields: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One-row aggregate with ``<field>_<i>`` columns to one row per name."""
    return one_row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"),
                        F.lit(name).alias("column_name"),
                        *[F.col(c) for c in carry],
                        *[F.col(f"{f}_{i}").alias(f) for f in fields],
                    )
                    for i, name in enumerate(names)
                ]
            )
        )
    )


def shape(df: DataFrame) -> DataFrame:
    """Rows, columns, and the name and type of each column."""
    fields = df.schema.fields
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(dtype_name(f.dataType)).alias("dtype"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(fields)).cast("long").alias("n_cols"), F.inline(listed)
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and share (one decimal) per column, in one aggregate."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(value(df, c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(df.columns)],
    )
    return melt(counts, df.columns, ["nulls"], ["n_rows"]).withColumn(
        "null_pct", F.coalesce(F.round(percent(F.col("nulls"), F.col("n_rows")), 1), F.lit(0.0))
    )


def null_column_list(df: DataFrame) -> DataFrame:
    """Columns with at least one null."""
    return null_profile(df).where("nulls > 0").select("column_name", "nulls", "null_pct")


def _plain(c: Column, dtype: T.DataType) -> Column:
    """A value whose JSON text tells all different values apart: moments as microseconds, -0.0 as 0.0, at any depth."""
    if isinstance(dtype, FLOATS):
        return c + F.lit(0.0).cast(dtype)
    if isinstance(dtype, T.TimestampNTZType):
        return c.cast("string")  # a wall-clock time need not exist in the session's zone
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.StructType):
        fields = [_plain(c.getField(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(dtype.fields)]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _plain(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        entry = T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)])
        return F.array_sort(F.transform(F.map_entries(c), lambda x: F.to_json(_plain(x, entry))))
    return c


def row_digest(df: DataFrame) -> Column:
    """Cryptographic digest of a whole row; equal rows and only those share it.

    Grouping by 32 bytes instead of all columns keeps the shuffle narrow for
    wide rows and long texts.
    """
    cells = [_plain(value(df, f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]
    return F.unhex(F.sha2(F.to_json(F.struct(*cells)), 256))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows equal to an earlier row, nulls being equal."""
    groups = df.select(row_digest(df).alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def quality_warnings(df: DataFrame, load_warnings: Sequence[str] = ()) -> DataFrame:
    """Data-quality messages as rows: code, column, message."""
    sparse = (
        null_profile(df)
        .where(F.col("null_pct") > NULL_WARNING_PCT)
        .select(
            F.lit("high_nulls").alias("code"),
            "column_name",
            F.format_string(
                "Column '%s' has %s%% missing values", "column_name", F.col("null_pct").cast("string")
            ).alias("message"),
        )
    )
    repeated = (
        duplicate_rows(df)
        .where("duplicates > 0")
        .select(
            F.lit("duplicates").alias("code"),
            F.lit("").alias("column_name"),
            F.format_string("Found %d duplicate rows", "duplicates").alias("message"),
        )
    )
    out = sparse.unionByName(repeated)
    for message in load_warnings:
        loaded = df.sparkSession.range(1).select(
            F.lit("load").alias("code"), F.lit("").alias("column_name"), F.lit(message).alias("message")
        )
        out = loaded.unionByName(out)
    return out


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Non-null distinct values per column.

    Columns of one type are stacked into (column, value) rows, which are made
    distinct before and after one shuffle; there is one scan per type, of its own
    columns. ``approx=True`` uses a sketch with 2 % error and no shuffle of values.
    """
    names = [c for c in (columns or df.columns) if kind(field_type(df, c)) != "complex"]
    if approx:
        row = df.agg(
            *[F.approx_count_distinct(value(df, c), 0.02).alias(f"n_distinct_{i}") for i, c in enumerate(names)]
        )
        return melt(row, names, ["n_distinct"])
    by_type: dict[str, list[int]] = {}
    for i, c in enumerate(names):
        by_type.setdefault(field_type(df, c).simpleString(), []).append(i)
    counts = None
    for positions in by_type.values():
        cells = df.select(*[distinct_key(df, names[i]).alias(f"_c{i}") for i in positions])
        pairs = ", ".join(f"{i}, _c{i}" for i in positions)
        values = cells.select(F.expr(f"stack({len(positions)}, {pairs}) AS (position, _value)"))
        one = (
            values.where("_value IS NOT NULL").distinct().groupBy("position").agg(F.count(F.lit(1)).alias("n_distinct"))
        )
        counts = one if counts is None else counts.unionByName(one)
    listed = df.sparkSession.createDataFrame(
        pa.table({"position": pa.array(range(len(names)), pa.int32()), "column_name": names})
    )
    # One row per column on both sides.
    return listed.join(F.broadcast(counts), "position", "left").select(
        "position", "column_name", F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct")
    )


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values and integer maximum."""
    fields = df.schema.fields
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(value(df, f.name).isNull()).alias(f"nulls_{i}") for i, f in enumerate(fields)],
        *[
            (F.max(quoted(f.name)).cast("double") if kind(f.dataType) == "integer" else F.lit(None).cast("double"))
            .alias(f"max_value_{i}")
            for i, f in enumerate(fields)
        ],
    )
    base = melt(counted, df.columns, ["nulls", "max_value"], ["n_rows"])
    # One row per column on both sides.
    typed = F.create_map(*[x for f in fields for x in (F.lit(f.name), F.lit(dtype_name(f.dataType)))])
    classed = F.create_map(*[x for f in fields for x in (F.lit(f.name), F.lit(kind(f.dataType)))])
    distinct = distinct_counts(df, approx=approx).select("column_name", "n_distinct")
    return base.join(F.broadcast(distinct), "column_name", "left").select(
        "position",
        "column_name",
        typed[F.col("column_name")].alias("dtype"),
        classed[F.col("column_name")].alias("kind"),
        "n_rows",
        "nulls",
        F.coalesce(F.round(percent(F.col("nulls"), F.col("n_rows")), 1), F.lit(0.0)).alias("null_pct"),
        F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct"),
        "max_value",
    )


def semantic_types(profile: DataFrame) -> DataFrame:
    """Add ``semantic_type`` to a column profile; the first matching rule wins."""
    name = F.lower("column_name")
    share = F.try_divide(F.col("n_distinct").cast("double"), F.col("n_rows").cast("double"))
    is_id = (name == "id") | name.endswith("_id")
    empty_date = (F.col("kind") == "datetime") & (F.col("nulls") == F.col("n_rows"))
    return profile.withColumn(
        "semantic_type",
        F.when(empty_date, "text")
        .when((F.col("kind") == "datetime") | K.contains_any(name, K.DATE_NAMED), "datetime")
        .when(F.col("kind") == "boolean", "categorical")
        .when(F.col("kind").isin("integer", "float"), "numeric")
        .when(is_id & (share > 0.8), "id")
        .when(is_id, "categorical")
        .when((F.col("kind") == "string") & (share < 0.5), "categorical")
        .otherwise("text"),
    )


def kpi_columns(typed_profile: DataFrame) -> DataFrame:
    """Numeric columns whose name holds a business keyword."""
    return typed_profile.where(
        (F.col("semantic_type") == "numeric") & K.contains_any(F.lower("column_name"), K.KPI)
    ).select("position", "column_name")


def measures_of(df: DataFrame, columns: Sequence[str] | None) -> dict[str, Column]:
    names = list(columns) if columns else numeric_columns(df)
    return {c: measure(df, c) for c in names}


def summary_of(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Unrounded statistics of numeric columns, one row each, for several readers."""
    cells = measures_of(df, columns)
    return settle(column_summary(df, cells, QUARTILES), len(cells))[0]


def describe(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2, summary: DataFrame | None = None
) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of numeric columns."""
    stats = summary if summary is not None else column_summary(df, measures_of(df, columns), QUARTILES)
    return stats.select(
        "column_name",
        "n",
        *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")],
    )


def column_stats(
    df: DataFrame, columns: Sequence[str] | None = None, summary: DataFrame | None = None
) -> DataFrame:
    """Summary at six decimals for columns that hold at least one value."""
    stats = describe(df, columns, 6, summary).where("n > 0")
    return stats.select("column_name", "min", "max", "mean", F.col("q50").alias("median"), "std", "q25", "q75")


def head_sample(df: DataFrame, order_by: Sequence[str], rows: int = 5) -> DataFrame:
    """First rows by an explicit key, as text, with nulls spelled "None"."""
    first = df.orderBy(*[quoted(c) for c in order_by]).limit(rows)
    return first.select(
        *[F.coalesce(value(df, c).cast("string"), F.lit("None")).alias(c) for c in df.columns]
    )


def date_range(df: DataFrame, date_col: str | None) -> DataFrame:
    """First and last date and a one-line text of both."""
    if date_col is None:
        return df.sparkSession.range(1).select(
            F.lit(None).cast("string").alias("start_date"),
            F.lit(None).cast("string").alias("end_date"),
            F.lit("No date column").alias("date_range"),
        )
    d = quoted(date_col)
    span = df.agg(
        F.date_format(F.min(d), "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.max(d), "yyyy-MM-dd").alias("end_date"),
    )
    return span.withColumn(
        "date_range",
        F.coalesce(
            F.concat("start_date", F.lit(" to "), "end_date"),
            F.lit("No date column"),
        ),
    )


def kpi_series(df: DataFrame, kpis: Sequence[str], order_by: str) -> DataFrame:
    """Long table of KPI values with their order key; non-finite values are null."""
    cells = {}
    for k in kpis:
        c = measure(df, k)
        cells[k] = F.when(F.abs(c) != F.lit(float("inf")), c)
    return to_long(df, cells, [quoted(order_by).alias("order_key")]).withColumnRenamed("column_name", "kpi")


def health_score(df: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Score 0 to 100 from sparse columns, duplicates and anomaly severities."""
    sparse = null_profile(df).agg(F.count_if(F.col("null_pct") > NULL_WARNING_PCT).alias("sparse_columns"))
    flags = anomalies.agg(
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "medium").alias("medium"),
    )
    # Three one-row aggregates side by side.
    row = sparse.crossJoin(F.broadcast(duplicate_rows(df))).crossJoin(F.broadcast(flags))
    lost = (
        F.lit(10) * F.col("sparse_columns")
        + F.lit(5) * F.floor(F.col("duplicates") / 100)
        + F.lit(10) * F.col("high")
        + F.lit(5) * F.col("medium")
    )
    score = F.greatest(F.lit(0), F.lit(100) - lost).cast("long")
    return row.select(
        "sparse_columns",
        "duplicates",
        "high",
        "medium",
        score.alias("health_score"),
        F.when(score >= 80, "Excellent").when(score >= 60, "Fair").otherwise("Poor").alias("band"),
    )
