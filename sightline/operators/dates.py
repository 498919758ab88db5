"""Date metrics: granularity, period changes, trend, forecast, best and worst month."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.types import change_pct, measure, quoted
from sightline.plans.ordering import order_key
from sightline.plans.shared import reliable
from sightline.plans.sweep import gap_counts, rank_moments

MIN_ROWS = 4
DAY_MICROS = 86_400_000_000


def _steps(df: DataFrame, date_col: str, measures: Sequence[str], order_by: str | None = None) -> DataFrame:
    """Count and sums of each measure per distinct timestamp, one row per measure.

    Rows are summed for all measures at once before they are spread by measure.
    Sums are taken around the measure's mean, which keeps squares small. The
    means, and with ``order_by`` the last values, are one driver row.
    """
    ts = quoted(date_col).cast("timestamp")
    dated = df.where(quoted(date_col).isNotNull())
    wanted = [F.avg(measure(df, m)).alias(f"m{i}") for i, m in enumerate(measures)]
    if order_by is not None:
        wanted += [
            F.max_by(measure(df, m), F.when(measure(df, m).isNotNull(), F.struct(ts, order_key(df, order_by)))).alias(f"l{i}")
            for i, m in enumerate(measures)
        ]
    base = dated.agg(*wanted).first().asDict()
    sums, rows = [], []
    for i, m in enumerate(measures):
        mean = F.lit(base[f"m{i}"]).cast("double")
        y = measure(df, m) - mean
        sums += [F.count(y).alias(f"c{i}"), F.sum(y).alias(f"y{i}"), F.sum(y * y).alias(f"q{i}")]
        rows.append((m, mean, F.lit(base.get(f"l{i}")).cast("double"), f"c{i}", f"y{i}", f"q{i}"))
    return spread_steps(dated.groupBy(ts.alias("ts")).agg(*sums), rows)


def spread_steps(wide: DataFrame, measures: Sequence[tuple[str, Column, Column, str, str, str]]) -> DataFrame:
    """One row per timestamp to one per timestamp and measure: (name, mean, last value, columns of count, sum and squares around the mean)."""
    rows = [
        F.struct(
            F.lit(name).alias("column_name"), mean.alias("_mean"), last.alias("_last"),
            F.col(c).alias("c"), F.col(sy).alias("_sy"), F.col(syy).alias("_syy"),
        )
        for name, mean, last, c, sy, syy in measures
    ]
    return wide.select("ts", F.inline(F.array(*rows))).where("c > 0")


def granularity(df: DataFrame, date_col: str) -> DataFrame:
    """Median gap of consecutive rows in whole days, and its name."""
    return granularities({"": (df, date_col)}).drop("source")


def granularities(columns: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """``granularity`` of many date columns, of one table or several: a row a column, ``source`` is its name here.

    Rows sharing a timestamp have gaps of zero between them. Gaps are counted
    per whole day; that keeps the counted table as short as the span in days, and
    the two middle gaps are still known exactly at the edge of a day. All columns are
    laid out in one order, so their number adds no shuffle. A column with fewer than
    four dated rows has no row.
    """
    times = None
    for source, (df, date_col) in columns.items():
        d = quoted(date_col)
        one = df.where(d.isNotNull()).groupBy(d.cast("timestamp").alias("ts")).agg(F.count(F.lit(1)).alias("c"))
        one = one.select(F.lit(source).alias("source"), order_key(one, "ts").alias("t"), "c")
        times = one if times is None else times.unionByName(one)
    days = gap_counts(times, DAY_MICROS, "source").withColumnRenamed("units", "days")
    # One row per distinct whole-day gap; ranked through one sorted array a column.
    sorted_days = F.array_sort(F.collect_list(F.struct("days", "w", "low", "high")))
    listed = days.groupBy("source").agg(sorted_days.alias("g"), F.sum("w").alias("n"))
    step = F.aggregate(
        "g",
        F.struct(
            F.lit(0).cast("long").alias("seen"),
            F.lit(None).cast("long").alias("left"),
            F.lit(None).cast("long").alias("right"),
        ),
        lambda acc, x: F.struct(
            (acc["seen"] + x["w"]).alias("seen"),
            _middle(acc["left"], acc["seen"], x, F.floor((F.col("n") + 1) / 2)).alias("left"),
            _middle(acc["right"], acc["seen"], x, F.floor(F.col("n") / 2) + 1).alias("right"),
        ),
    )
    halves = listed.where(F.col("n") >= MIN_ROWS - 1).select("source", step.alias("m"))
    # Both middle gaps in one day: that day. Else: the mean of the two edge gaps.
    left, right = F.col("m.left"), F.col("m.right")
    same = F.floor(left / DAY_MICROS) == F.floor(right / DAY_MICROS)
    whole = F.when(same, F.floor(left / DAY_MICROS)).otherwise(F.floor((left + right) / 2 / DAY_MICROS))
    return halves.select("source", whole.alias("median_days")).select(
        "source",
        "median_days",
        F.when(F.col("median_days") <= 1, "daily")
        .when(F.col("median_days") <= 8, "weekly")
        .when(F.col("median_days") <= 35, "monthly")
        .when(F.col("median_days") <= 100, "quarterly")
        .otherwise("yearly")
        .alias("granularity"),
    )


def _middle(found: Column, seen: Column, x: Column, rank: Column) -> Column:
    """Gap at ``rank`` if it falls in this day: its high edge if last there, else its low edge."""
    here = (seen < rank) & (rank <= seen + x["w"])
    return F.coalesce(found, F.when(here, F.when(rank == seen + x["w"], x["high"]).otherwise(x["low"])))


def _period_means(steps: DataFrame) -> DataFrame:
    """Mean per measure, unit and period, all from one aggregate by day."""
    daily = steps.groupBy("column_name", F.to_date("ts").alias("day")).agg(
        F.sum(F.col("_sy") + F.col("c") * F.col("_mean")).alias("s"), F.sum("c").alias("c")
    )
    units = F.array(
        *[
            F.struct(F.lit(u).alias("unit"), F.date_trunc(u, "day").alias("period"))
            for u in ("month", "week", "year")
        ]
    )
    return (
        daily.select("column_name", "s", "c", F.inline(units))
        .groupBy("column_name", "unit", "period")
        .agg((F.sum("s") / F.sum("c")).alias("mean"), F.sum("c").alias("c"))
    )


def _enough(table: DataFrame, counted: str = "n") -> DataFrame:
    return table.where(F.col(counted) >= MIN_ROWS)


def _last_two(means: DataFrame) -> DataFrame:
    """Change of the last non-empty period against the one before, per measure and unit.

    Periods are bounded by the calendar, so a group here is short.
    """
    groups = means.groupBy("column_name", "unit").agg(
        F.max_by("mean", "period").alias("last"),
        F.max("period").alias("last_period"),
        F.sum("c").alias("n"),
    )
    before = (
        means.join(groups.select("column_name", "unit", "last_period"), ["column_name", "unit"])
        .where("period < last_period")
        .groupBy("column_name", "unit")
        .agg(F.max_by("mean", "period").alias("prev"))
    )
    return groups.join(before, ["column_name", "unit"], "left").select(
        "column_name", "unit", "n", F.round(change_pct(F.col("last"), F.col("prev")), 2).alias("change_pct")
    )


def period_change(df: DataFrame, date_col: str, measures: Sequence[str]) -> DataFrame:
    """Month, week (Monday to Sunday) and year changes of the mean, in percent."""
    changes = _last_two(_period_means(_steps(df, date_col, measures)))
    return _pivot_changes(_enough(changes))


def _pivot_changes(changes: DataFrame) -> DataFrame:
    def of(unit: str) -> Column:
        return F.max(F.when(F.col("unit") == unit, F.col("change_pct")))

    return changes.groupBy("column_name").agg(
        of("month").alias("mom_pct"), of("week").alias("wow_pct"), of("year").alias("yoy_pct")
    )


def _trend(steps: DataFrame) -> DataFrame:
    """Least squares of the value on the row's rank by date, without numbering rows.

    Rows sharing a timestamp take their mean rank. The starting rank of each
    timestamp is the number of earlier rows.
    """
    steps = reliable(steps)  # one row per measure and timestamp, used twice
    summed = steps.select("column_name", order_key(steps, "ts").alias("t"), "c", F.col("_sy").alias("sy"), F.col("_syy").alias("syy"))
    known = steps.groupBy("column_name").agg(F.first("_mean").alias("mean"), F.first("_last").alias("last_value"))
    sums = rank_moments(summed, "column_name").join(F.broadcast(known), "column_name")
    sums = sums.select("column_name", "n", "mean", "last_value", F.col("xy").alias("_xy"), F.col("y").alias("_y"), F.col("yy").alias("_yy"))
    n = F.col("n").cast("double")
    sxx = n * (n * n - 1) / 12.0
    sxy = F.col("_xy") - (n - 1) / 2.0 * F.col("_y")
    syy = F.col("_yy") - F.col("_y") * F.col("_y") / n
    return sums.select(
        "column_name",
        "n",
        "mean",
        "last_value",
        F.try_divide(sxy, sxx).alias("slope"),
        F.when(syy > 0, F.try_divide(sxy * sxy, sxx * syy)).otherwise(F.lit(0.0)).alias("r2"),
    )


def row_trend(df: DataFrame, date_col: str, measures: Sequence[str]) -> DataFrame:
    """Slope (6 decimals) and r squared (4 decimals) of value on row rank by date."""
    fit = _enough(_trend(_steps(df, date_col, measures)))
    return fit.select(
        "column_name", F.round("slope", 6).alias("trend_slope"), F.round("r2", 4).alias("trend_r2")
    )


def forecast_next(df: DataFrame, date_col: str, measures: Sequence[str], order_by: str) -> DataFrame:
    """Last value plus one step of the trend, 4 decimals; the key decides among equal dates."""
    fit = _enough(_trend(_steps(df, date_col, measures, order_by)))
    return fit.select("column_name", F.round(F.col("last_value") + F.col("slope"), 4).alias("forecast_next"))


def _months(means: DataFrame) -> DataFrame:
    """Best and worst month by mean, the earlier one among equals; two months needed."""
    months = means.where("unit = 'month'")
    best = F.struct(-F.col("mean"), F.col("period"))
    worst = F.struct(F.col("mean"), F.col("period"))
    found = months.groupBy("column_name").agg(
        F.sum("c").alias("n"),
        F.count(F.lit(1)).alias("_months"),
        F.date_format(F.min_by("period", best), "yyyy-MM").alias("best_period"),
        F.round(F.max("mean"), 2).alias("best_value"),
        F.date_format(F.min_by("period", worst), "yyyy-MM").alias("worst_period"),
        F.round(F.min("mean"), 2).alias("worst_value"),
    )
    return _enough(found).where("_months >= 2").drop("n", "_months")


def best_worst_month(df: DataFrame, date_col: str, measures: Sequence[str]) -> DataFrame:
    return _months(_period_means(_steps(df, date_col, measures)))


def direction(slope: Column, mean: Column) -> Column:
    return F.when(slope > 0.01 * mean, "up").when(slope < -0.01 * mean, "down").otherwise("flat")


def trend_direction(df: DataFrame, date_col: str, measures: Sequence[str]) -> DataFrame:
    """Slope (3 decimals) and up, down or flat against one percent of the mean."""
    fit = _enough(_trend(_steps(df, date_col, measures)))
    return fit.select(
        "column_name",
        F.round("slope", 3).alias("trend_slope"),
        direction(F.col("slope"), F.col("mean")).alias("trend_direction"),
    )


METRICS = (
    "mom_pct", "wow_pct", "yoy_pct", "trend_slope", "trend_r2", "trend_direction",
    "best_period", "worst_period", "forecast_next",
)


def date_metrics(df: DataFrame, date_col: str, measures: Sequence[str], order_by: str) -> DataFrame:
    """All metrics, one row per measure with at least four dated values."""
    return metrics_of(_steps(df, date_col, measures, order_by))


def metrics_of(steps: DataFrame) -> DataFrame:
    """All metrics from counts and sums by timestamp."""
    means = _period_means(steps)
    fit = _enough(_trend(steps))
    # Every joined table has one row per measure.
    joined = fit.join(F.broadcast(_pivot_changes(_last_two(means))), "column_name", "left").join(
        F.broadcast(_months(means)), "column_name", "left"
    )
    return joined.select(
        "column_name",
        "mom_pct",
        "wow_pct",
        "yoy_pct",
        F.round("slope", 6).alias("trend_slope"),
        F.round("r2", 4).alias("trend_r2"),
        direction(F.col("slope"), F.col("mean")).alias("trend_direction"),
        "best_period",
        "worst_period",
        F.round(F.col("last_value") + F.col("slope"), 4).alias("forecast_next"),
    )


def filtered_metrics(base: DataFrame, filtered: DataFrame, date_col: str, measures: Sequence[str]) -> DataFrame:
    """Metrics recomputed on filtered rows over a baseline of ``date_metrics``.

    A metric the filtered rows cannot give keeps its baseline. Fit quality and
    forecast stay those of the whole table, the slope has three decimals.
    """
    return refreshed(base, _steps(filtered, date_col, measures))


def refreshed(base: DataFrame, steps: DataFrame) -> DataFrame:
    """``base`` with the metrics that the steps of a view can give."""
    means = _period_means(steps)
    fit = _enough(_trend(steps)).select(
        "column_name",
        F.round("slope", 3).alias("trend_slope"),
        direction(F.col("slope"), F.col("mean")).alias("trend_direction"),
    )
    months = _months(means).select("column_name", "best_period", "worst_period")
    fresh = (
        fit.join(F.broadcast(_pivot_changes(_last_two(means))), "column_name", "left")
        .join(F.broadcast(months), "column_name", "left")
    )
    recomputed = [c for c in METRICS if c in fresh.columns]
    renamed = fresh.select("column_name", *[F.col(c).alias(f"_new_{c}") for c in recomputed])
    joined = base.join(F.broadcast(renamed), "column_name", "left")
    return joined.select(
        "column_name",
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in recomputed else F.col(c) for c in METRICS],
    )
