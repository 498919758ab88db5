"""Type tests and measure expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
DATETIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
TEXTS = (T.StringType, T.CharType, T.VarcharType)


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def kind(dtype: T.DataType) -> str:
    """Coarse type class: integer, float, boolean, datetime, string or complex."""
    if isinstance(dtype, INTEGERS):
        return "integer"
    if isinstance(dtype, FLOATS) or isinstance(dtype, T.DecimalType):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, DATETIMES):
        return "datetime"
    if isinstance(dtype, TEXTS):
        return "string"
    return "complex"


def is_numeric(dtype: T.DataType) -> bool:
    return kind(dtype) in ("integer", "float")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def quoted(name: str) -> Column:
    """Column reference that survives dots and spaces in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def measure(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE with NaN turned into null.

    Parquet doubles may hold NaN, which Spark sorts above every number and
    counts as a value; one missing value is what every statistic here means.
    """
    c = quoted(name)
    if isinstance(field_type(df, name), FLOATS):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double")


def null_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column; other columns are untouched."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATS)}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floats else quoted(c).alias(c)
            for c in df.columns
        ]
    )


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, null when whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100.0


def change_pct(new: Column, old: Column) -> Column:
    """(new - old) / |old| * 100, null when old is zero."""
    return F.try_divide(new - old, F.abs(old)) * 100.0
