"""Row filters, the values they offer, and when a filtered view is worth new text."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.types import INTEGERS, field_type, quoted
from sightline.operators.classify import cardinalities
from sightline.plans.shared import beside

MIN_CHOICES, MAX_CHOICES = 2, 20
LARGE_TABLE_ROWS = 50_000


@dataclass
class Filter:
    """A view on a table: date range, equal dimensions, one clicked chart element."""

    start: str | None = None
    end: str | None = None
    dimensions: Mapping[str, object] = field(default_factory=dict)
    selection: tuple[str, object] | None = None


def filter_date_range(df: DataFrame, date_col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from the start to the end of the last day, both inclusive.

    The bounds are literals on the bare column, so they reach the file scan.
    """
    out = df
    # A literal of the column's own type keeps the comparison free of casts.
    dtype = field_type(df, date_col)
    if start:
        out = out.where(quoted(date_col) >= F.lit(start).cast(dtype))
    if end:
        after = (dt.date.fromisoformat(end[:10]) + dt.timedelta(days=1)).isoformat()
        out = out.where(quoted(date_col) < F.lit(after).cast(dtype))
    return out


def filter_dimensions(df: DataFrame, dimensions: Mapping[str, object]) -> DataFrame:
    """Rows equal in every given dimension, compared as text; empty values do not filter."""
    out = df
    for name, wanted in dimensions.items():
        if wanted is None or wanted == "":
            continue
        text = str(wanted).lower() if isinstance(wanted, bool) else str(wanted)
        out = out.where(equals_text(out, name, text))
    return out


def equals_text(df: DataFrame, name: str, text: str) -> Column:
    """Rows whose value reads as ``text``, as a comparison of the bare column where that is the same.

    An integer, date or boolean has one text; a literal of the column's type with
    just this text reaches the file scan, and without such a literal no row fits.
    """
    dtype = field_type(df, name)
    if not isinstance(dtype, (*INTEGERS, T.DateType, T.BooleanType)):
        return quoted(name).cast("string") == F.lit(text)
    wanted = typed_literal(dtype, text)
    return F.lit(False) if wanted is None else quoted(name) == F.lit(wanted).cast(dtype)


def typed_literal(dtype: T.DataType, text: str) -> object | None:
    """The value of an integer, date or boolean type that is written exactly so."""
    if isinstance(dtype, T.BooleanType):
        return {"true": True, "false": False}.get(text)
    if isinstance(dtype, T.DateType):
        try:
            day = dt.date.fromisoformat(text)
        except ValueError:
            return None
        return day if day.isoformat() == text else None
    bits = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}[dtype.simpleString()]
    if not re.fullmatch(r"-?(0|[1-9]\d*)", text) or text == "-0":
        return None
    return int(text) if -(2**bits) <= int(text) < 2**bits else None


def filter_selection(df: DataFrame, column: str | None, wanted: object) -> DataFrame:
    """Rows of a clicked chart element; a column the table lacks does not filter."""
    if not column or wanted is None or column not in df.columns:
        return df
    return filter_dimensions(df, {column: wanted})


def apply_filter(df: DataFrame, view: Filter, date_col: str | None = None) -> DataFrame:
    out = df
    if date_col:
        out = filter_date_range(out, date_col, view.start, view.end)
    out = filter_dimensions(out, view.dimensions)
    if view.selection:
        out = filter_selection(out, *view.selection)
    return out


def filterable_dimensions(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Categorical columns with 2 to 20 values, a null counting as one."""
    counted = cardinalities(df, list(categorical))
    return counted.where(F.col("n_values").between(MIN_CHOICES, MAX_CHOICES)).select("column_name", "n_values")


def dimension_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values."""
    c = quoted(column)
    return df.select(c.alias("value")).where("value is not null").distinct().orderBy("value")


def regenerate_trigger(original: DataFrame, filtered: DataFrame) -> DataFrame:
    """Whether a filter removed enough rows: a tenth of a large table, else a fifth."""
    before = original.agg(F.count(F.lit(1)).alias("original_rows"))
    after = filtered.agg(F.count(F.lit(1)).alias("filtered_rows"))
    return regenerate_by_counts(before, after)


def regenerate_by_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """The same from one row of ``original_rows`` and one of ``filtered_rows``."""
    gone = F.try_divide(
        (F.col("original_rows") - F.col("filtered_rows")).cast("double"), F.col("original_rows").cast("double")
    )
    needed = F.when(F.col("original_rows") > LARGE_TABLE_ROWS, 0.10).otherwise(0.20)
    return beside(before, after).select(
        "original_rows",
        "filtered_rows",
        F.coalesce(F.floor(gone * 100 + 0.5), F.lit(0)).cast("long").alias("filtered_out_pct"),
        F.coalesce(gone >= needed, F.lit(False)).alias("regenerate"),
    )
