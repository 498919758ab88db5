"""Named queries over the given tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(df: DataFrame, digits: int = 4) -> DataFrame:
    """Common output types: BIGINT, DOUBLE at a fixed precision, text dates."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def steady(name: str) -> Column:
    """Mean at four decimals, rounded off the midpoint.

    Means of a few two-decimal amounts lie exactly between two roundings, where
    engines differ; the same small shift is in the SQL.
    """
    return F.round(F.col(name) + F.lit(3.7e-7), 4).alias(name)


def gappy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with two sparse columns and one that is null throughout a status."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_linestatus") != "O", F.col("l_discount")).alias("l_discount"),
        "l_returnflag",
    )


GAPPY_LINES = """(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_returnflag <> 'R' THEN l_tax END AS l_tax,
  CASE WHEN l_linestatus <> 'O' THEN l_discount END AS l_discount, l_returnflag FROM lineitem)"""


def narrow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few columns of lineitem, so that equal rows exist."""
    return gappy_lines(spark, sf_dir).select("l_quantity", "l_tax", "l_discount", "l_returnflag")


NARROW_LINES = f"(SELECT l_quantity, l_tax, l_discount, l_returnflag FROM {GAPPY_LINES})"


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with two derived prices and the year of shipping."""
    li = table(spark, sf_dir, "lineitem")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.withColumn("revenue", revenue).withColumn("charge", F.col("revenue") * (1 + F.col("l_tax"))).withColumn(
        "ship_year", F.year("l_shipdate")
    )


PRICED_LINES = """(SELECT *, l_extendedprice * (1 - l_discount) AS revenue,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
  CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem)"""
