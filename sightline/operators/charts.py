"""Chart datasets: small aggregates ready to draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import keywords as K
from sightline.functions.types import change_pct, measure, quoted
from sightline.operators.correlation import histogram, value_counts
from sightline.operators.findings import cell_means, exp_segment_winners, group_means, segment_buckets
from sightline.operators.profile import distinct_counts, melt
from sightline.plans.shared import beside

LONG_SPAN_DAYS = 90


def kpi_cards(df: DataFrame, measures: Sequence[str], limit: int = 3) -> DataFrame:
    """Mean and sum of the first measures, in one aggregate."""
    names = list(measures)[:limit]
    row = df.agg(
        *[f(measure(df, c)).alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in (("mean", F.avg), ("total", F.sum))]
    )
    cards = melt(row, names, ["mean", "total"])
    return cards.select("column_name", "mean", F.coalesce("total", F.lit(0.0)).alias("total"))


def bar_pct_diff(df: DataFrame, measure_name: str, dim: str) -> DataFrame:
    """Mean per group, highest first, with the difference to the best in percent."""
    means = group_means(df, dim, measure_name)
    best = means.agg(F.max("mean").alias("_best"))
    diff = F.round(change_pct(F.col("mean"), F.col("_best")), 1)
    return (
        beside(means, best)
        .orderBy(F.desc("mean"), "grp")
        .select(F.col("grp").cast("string").alias("x"), F.col("mean").alias("y"), F.coalesce(diff, F.lit(0.0)).alias("pct_diff"))
    )


def grouped_bar_long(df: DataFrame, measure_name: str, segment: str, variant: str) -> DataFrame:
    """Mean per segment and variant as rows (category, variant, y), only when winners differ."""
    cells = cell_means(df, segment, variant, measure_name)
    long = cells.select(F.col("seg").cast("string").alias("category"), F.col("var").cast("string").alias("variant"), F.col("mean").alias("y"))
    differ = exp_segment_winners(df, measure_name, variant, segment).agg(
        F.coalesce(F.bool_or(~F.col("consistent")), F.lit(False)).alias("_differ")
    )
    return beside(long, differ).where("_differ").drop("_differ")


def grouped_bar(
    df: DataFrame, measure_name: str, segment: str, variant: str, variants: Sequence[object], always: bool = False
) -> DataFrame:
    """Mean per segment (rows) and variant (columns), only when winners differ.

    The caller names the variants, so the table is as wide as asked for; the long
    form for any number of variants is ``grouped_bar_long``.
    """
    cells = cell_means(df, segment, variant, measure_name)
    wide = cells.groupBy(F.col("seg").cast("string").alias("category")).pivot("var", list(variants)).agg(F.first("mean"))
    if always:
        return wide
    differ = exp_segment_winners(df, measure_name, variant, segment).agg(
        F.coalesce(F.bool_or(~F.col("consistent")), F.lit(False)).alias("_differ")
    )
    return beside(wide, differ).where("_differ").drop("_differ")


def multi_line(df: DataFrame, measure_name: str, time: str, dim: str) -> DataFrame:
    """Mean per period and group in time order."""
    cells = cell_means(df, time, dim, measure_name)
    return cells.orderBy("seg", "var").select(
        F.col("seg").cast("string").alias("x"), F.col("mean").alias("y"), F.col("var").cast("string").alias("grp")
    )


def segment_bar(df: DataFrame, segment: str, measure_name: str) -> DataFrame:
    """Mean per quartile bucket of a numeric segment."""
    return segment_buckets(df, segment, measure_name).orderBy("bucket").select("bucket", "low", "high", F.col("mean").alias("y"))


def _by_period(df: DataFrame, measure_name: str, time: str) -> DataFrame:
    present = df.select(quoted(time).alias("period"), measure(df, measure_name).alias("_m")).na.drop()
    return present.groupBy("period").agg(F.avg("_m").alias("y"))


def ts_line(df: DataFrame, measure_name: str, time: str) -> DataFrame:
    """Mean per period in time order."""
    line = _by_period(df, measure_name, time)
    return line.orderBy("period").select(F.col("period").cast("string").alias("x"), "y")


def ranked_periods(df: DataFrame, measure_name: str, time: str) -> DataFrame:
    """Mean per period, highest first."""
    line = _by_period(df, measure_name, time)
    return line.orderBy(F.desc("y"), "period").select(F.col("period").cast("string").alias("x"), "y")


def top_categories(df: DataFrame, measure_name: str, dim: str, top: int = 20) -> DataFrame:
    """The highest means; 15 for transactions, 20 in general."""
    means = group_means(df, dim, measure_name).orderBy(F.desc("mean"), "grp").limit(top)
    return means.select(F.col("grp").cast("string").alias("x"), F.col("mean").alias("y"))


def rec_kpi(df: DataFrame, kpis: Sequence[str], limit: int = 4) -> DataFrame:
    """Mean of rate-like columns and sum of the others."""
    names = list(kpis)[:limit]
    averaged = {c: K.name_contains(c, K.AVERAGED_KPI) for c in names}
    row = df.agg(
        *[
            (F.avg(measure(df, c)) if averaged[c] else F.coalesce(F.sum(measure(df, c)), F.lit(0.0))).alias(f"y_{i}")
            for i, c in enumerate(names)
        ]
    )
    kind = F.create_map(*[x for c in names for x in (F.lit(c), F.lit("mean" if averaged[c] else "sum"))])
    return melt(row, names, ["y"]).select("column_name", kind[F.col("column_name")].alias("aggregation"), "y")


def rec_time_line(df: DataFrame, kpi: str, date_col: str, points: int | None = None) -> DataFrame:
    """Sums over time: by month with empty months as zero beyond 90 days, else by date.

    The whole series, or its first ``points``.
    """
    d = quoted(date_col).cast("timestamp")
    present = df.select(d.alias("ts"), measure(df, kpi).alias("_m")).na.drop()
    span = present.agg(F.min("ts").alias("_from"), F.max("ts").alias("_to")).withColumn(
        "_long", F.floor((F.unix_micros("_to") - F.unix_micros("_from")) / 86_400_000_000) > LONG_SPAN_DAYS
    )
    point = F.when(F.col("_long"), F.date_trunc("month", "ts")).otherwise(F.col("ts"))
    sums = beside(present, span).groupBy(point.alias("x")).agg(F.sum("_m").alias("y"))
    month = F.expr("interval 1 month")
    grid = span.where("_long").select(
        F.explode(F.sequence(F.date_trunc("month", "_from"), F.date_trunc("month", "_to"), month)).alias("x")
    )
    # Months between two dates: bounded by the calendar.
    empty = grid.select("x", F.lit(0.0).alias("y"))
    line = sums.unionByName(empty).groupBy("x").agg(F.sum("y").alias("y"))
    first = line if points is None else line.orderBy("x").limit(points)
    return first.select(F.date_format("x", "yyyy-MM-dd HH:mm:ss").alias("x"), "y")


def choose_category(df: DataFrame, categories: Sequence[str], low: int, high: int, skip: str | None = None) -> str | None:
    """Name of the category column with the fewest values within bounds."""
    counted = distinct_counts(df, categories).where(F.col("n_distinct").between(low, high))
    rows = counted.where(F.col("column_name") != F.lit(skip or "")).orderBy("n_distinct", "position").limit(1).collect()
    return rows[0]["column_name"] if rows else None


def rec_bar(df: DataFrame, kpi: str, categories: Sequence[str], top: int = 20) -> DataFrame:
    """Sum of a KPI by the category column with the fewest values between 2 and 15."""
    category = choose_category(df, categories, 2, 15)
    if category is None:
        return df.sparkSession.range(0).select(
            F.lit("").alias("column_name"), F.lit("").alias("x"), F.lit(0.0).alias("y")
        )
    c = quoted(category)
    sums = df.where(c.isNotNull()).groupBy(c.alias("x")).agg(F.coalesce(F.sum(measure(df, kpi)), F.lit(0.0)).alias("y"))
    return sums.orderBy(F.desc("y"), "x").limit(top).select(
        F.lit(category).alias("column_name"), F.col("x").cast("string").alias("x"), "y"
    )


def rec_pie(df: DataFrame, categories: Sequence[str], bar_category: str | None = None) -> DataFrame:
    """Rows per value of the first category column with 3 to 8 values that the bar does not use."""
    used = bar_category or choose_category(df, categories, 2, 15)
    counted = distinct_counts(df, categories).where(F.col("n_distinct").between(3, 8))
    rows = counted.where(F.col("column_name") != F.lit(used or "")).orderBy("position").limit(1).collect()
    if not rows:
        return df.sparkSession.range(0).select(
            F.lit("").alias("column_name"), F.lit("").alias("x"), F.col("id").alias("y")
        )
    name = rows[0]["column_name"]
    return value_counts(df, name).select(F.lit(name).alias("column_name"), F.col("value").alias("x"), F.col("n").alias("y"))


def rec_histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Histogram of the column with the largest variance, if it varies at all."""
    names = list(columns)
    row = df.agg(*[F.var_samp(measure(df, c)).alias(f"variance_{i}") for i, c in enumerate(names)])
    best = (
        melt(row, names, ["variance"]).where("variance > 0").orderBy(F.desc("variance"), "position").limit(1).collect()
    )
    if not best:
        return histogram(df.limit(0), names[0]).limit(0).select(F.lit("").alias("column_name"), "bin", "x", "y")
    name = best[0]["column_name"]
    return histogram(df, name).select(F.lit(name).alias("column_name"), "bin", "x", "y")
