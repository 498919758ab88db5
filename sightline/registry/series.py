"""Anomaly, date metric and filter queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import anomalies, dates, filters
from sightline.plans.rollup import Rollup, rollup
from sightline.registry.base import gappy_lines, query, shown, steady, table
from sightline.registry.profiles import NULLS_SQL, union_sql

FLAG_FIELDS = ["column_name", "value", "row_key", "anomaly_type", "severity", "z_score"]


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with a second measure that is missing for one priority and zero for another."""
    orders = table(spark, sf_dir, "orders")
    scaled = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None)).when(
        F.col("o_orderpriority") == "5-LOW", F.lit(0.0)
    )
    return orders.withColumn(
        "o_square", scaled.otherwise(F.col("o_totalprice") * F.col("o_totalprice") / 1e6)
    )


ORDERS_WITH_GAPS = """(SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '5-LOW' THEN 0.0::DOUBLE
  ELSE o_totalprice * o_totalprice / 1000000.0::DOUBLE END AS o_square FROM orders)"""
SERIES = {
    "value": ("events", "event_id"),
    "o_totalprice": (ORDERS_WITH_GAPS, "o_orderkey"),
    "o_square": (ORDERS_WITH_GAPS, "o_orderkey"),
}


def zscore_sql(column: str) -> str:
    source, key = SERIES[column]
    return f"""SELECT '{column}' AS column_name, v AS value, k AS row_key,
        CASE WHEN z > 3 THEN 'outlier_high' ELSE 'outlier_low' END AS anomaly_type, CASE WHEN z > 3 THEN 'high' ELSE 'medium' END AS severity,
        z AS z_score
      FROM (SELECT v, k, z, row_number() OVER (ORDER BY k) AS r FROM
        (SELECT {column} AS v, {key} AS k, ({column} - m) / s AS z FROM {source},
           (SELECT avg({column}) AS m, stddev_pop({column}) AS s FROM {source}) WHERE {column} IS NOT NULL) WHERE abs(z) > 3) WHERE r <= 3"""


def iqr_sql(column: str) -> str:
    source, key = SERIES[column]
    return f"""SELECT '{column}' AS column_name, v AS value, k AS row_key,
        CASE WHEN v > hi THEN 'outlier_high' ELSE 'outlier_low' END AS anomaly_type, 'medium' AS severity, CAST(NULL AS DOUBLE) AS z_score
      FROM (SELECT v, k, hi, row_number() OVER (ORDER BY k) AS r FROM
        (SELECT {column} AS v, {key} AS k, a - 1.5::DOUBLE * (b - a) AS lo, b + 1.5::DOUBLE * (b - a) AS hi FROM {source},
           (SELECT quantile_cont({column}, 0.25) AS a, quantile_cont({column}, 0.75) AS b FROM {source}) WHERE {column} IS NOT NULL)
        WHERE (v < lo OR v > hi) AND k NOT IN (SELECT row_key FROM ({zscore_sql(column)}))) WHERE r <= 2"""


def change_sql(column: str) -> str:
    source, key = SERIES[column]
    date = "ts" if column == "value" else "o_orderdate"
    return f"""SELECT '{column}' AS column_name, v AS value, k AS row_key, 'sudden_change' AS anomaly_type, 'high' AS severity,
        CAST(NULL AS DOUBLE) AS z_score
      FROM (SELECT v, k, row_number() OVER (ORDER BY d, k) AS r FROM
        (SELECT {column} AS v, {key} AS k, {date} AS d, {column} / nullif(lag({column}) OVER (ORDER BY {date}, {key}), 0) - 1 AS c
         FROM {source} WHERE {column} IS NOT NULL) WHERE abs(c) > 0.5) WHERE r <= 2"""


def all_changes_sql(column: str) -> str:
    source, key = SERIES[column]
    date = "ts" if column == "value" else "o_orderdate"
    return f"""SELECT '{column}' AS column_name, count(*) AS n_rows, round(sum(v - p), 4) AS moved FROM
      (SELECT {column} AS v, lag({column}) OVER (ORDER BY {date}, {key}) AS p FROM {source} WHERE {column} IS NOT NULL)"""


def rounded_flags(sql: str) -> str:
    return (
        f"SELECT column_name, round(value, 4) AS value, row_key, anomaly_type, severity, round(z_score, 4) AS z_score FROM ({sql})"
    )


@query("anom_zscore", rounded_flags(union_sql([zscore_sql(c) for c in SERIES])))
def anom_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = anomalies.anom_zscore(table(spark, sf_dir, "events"), ["value"], "event_id")
    orders = anomalies.anom_zscore(orders_with_gaps(spark, sf_dir), ["o_totalprice", "o_square"], "o_orderkey")
    return shown(events.unionByName(orders).select(*FLAG_FIELDS))


@query("anom_iqr", rounded_flags(union_sql([iqr_sql(c) for c in SERIES])))
def anom_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = anomalies.anom_iqr(table(spark, sf_dir, "events"), ["value"], "event_id")
    orders = anomalies.anom_iqr(orders_with_gaps(spark, sf_dir), ["o_totalprice", "o_square"], "o_orderkey")
    return shown(events.unionByName(orders).select(*FLAG_FIELDS))


@query("anom_sudden_change", rounded_flags(union_sql([change_sql(c) for c in SERIES])))
def anom_sudden_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders has many rows per date, told apart by their key."""
    events = anomalies.anom_sudden_change(table(spark, sf_dir, "events"), ["value"], "ts", "event_id")
    orders = anomalies.anom_sudden_change(
        orders_with_gaps(spark, sf_dir), ["o_totalprice", "o_square"], "o_orderdate", "o_orderkey"
    )
    return shown(events.unionByName(orders).select(*FLAG_FIELDS))


MISSING_SQL = f"""SELECT column_name, pct AS value, CAST(-1 AS BIGINT) AS row_key, 'missing_spike' AS anomaly_type,
    CASE WHEN pct > 50 THEN 'high' ELSE 'medium' END AS severity, CAST(pct AS VARCHAR) || '% missing' AS value_text
  FROM (SELECT column_name, round(nulls * 100.0::DOUBLE / n_rows, 1) AS pct FROM ({NULLS_SQL})) WHERE pct > 30"""


@query("anom_missing", MISSING_SQL)
def anom_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = anomalies.anom_missing(gappy_lines(spark, sf_dir))
    return shown(flags.select("column_name", "value", "row_key", "anomaly_type", "severity", "value_text"))


MERGED = ["o_totalprice", "o_square"]


def _merge_sql() -> str:
    parts = []
    for i, c in enumerate(MERGED):
        parts += [
            f"SELECT 1 AS detector, {i} AS position, * FROM ({zscore_sql(c)})",
            f"SELECT 2, {i}, * FROM ({iqr_sql(c)})",
            f"SELECT 3, {i}, * FROM ({change_sql(c)})",
        ]
    return f"""SELECT CAST(detector AS BIGINT) AS detector, column_name, row_key, anomaly_type, severity,
        'Detected ' || anomaly_type || ' in ' || column_name || ' with value ' || printf('%.2f', value) || '.' AS explanation
      FROM ({union_sql(parts)}) q ORDER BY CASE q.severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, q.detector, q.position, q.row_key LIMIT 10"""


@query("anom_merge", _merge_sql())
def anom_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value in the sentence is cut to two decimals here, as both engines print long ones differently."""
    orders = orders_with_gaps(spark, sf_dir)
    flags = anomalies.detect(orders, MERGED, "o_orderkey", "o_orderdate")
    two = F.regexp_replace("explanation", r"with value .*$", "with value ")
    cut = F.concat(two, F.format_string("%.2f", "value"), F.lit("."))
    return shown(flags.select("detector", "column_name", "row_key", "anomaly_type", "severity", cut.alias("explanation")))


# -- dates -----------------------------------------------------------------------


def _granularity_sql(source: str, date: str) -> str:
    return f"""SELECT '{source}' AS source, median_days,
      CASE WHEN median_days <= 1 THEN 'daily' WHEN median_days <= 8 THEN 'weekly' WHEN median_days <= 35 THEN 'monthly'
           WHEN median_days <= 100 THEN 'quarterly' ELSE 'yearly' END AS granularity
      FROM (SELECT CAST(floor(quantile_cont(g, 0.5) / 86400000000.0::DOUBLE) AS BIGINT) AS median_days FROM
        (SELECT epoch_us({date}) - lag(epoch_us({date})) OVER (ORDER BY {date}) AS g FROM {{table}} WHERE {date} IS NOT NULL) WHERE g IS NOT NULL)"""


@query(
    "granularity",
    union_sql(
        [
            _granularity_sql("events", "ts").format(table="events"),
            _granularity_sql("orders", "o_orderdate").format(table="orders"),
            _granularity_sql("weeks", "w").format(table="(SELECT DISTINCT date_trunc('week', o_orderdate) AS w FROM orders)"),
            _granularity_sql("months", "m").format(table="(SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)"),
            _granularity_sql("quarters", "q").format(table="(SELECT DISTINCT date_trunc('quarter', o_orderdate) AS q FROM orders)"),
            _granularity_sql("years", "y").format(table="(SELECT DISTINCT date_trunc('year', o_orderdate) AS y FROM orders)"),
        ]
    ),
)
def granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")

    def distinct(unit: str, name: str) -> DataFrame:
        return orders.select(F.date_trunc(unit, "o_orderdate").alias(name)).distinct()

    columns = {"events": (table(spark, sf_dir, "events"), "ts"), "orders": (orders, "o_orderdate")}
    columns |= {u + "s": (distinct(u, u[0]), u[0]) for u in ("week", "month", "quarter", "year")}
    return shown(dates.granularities(columns))


DATED = ["o_totalprice", "o_square"]


def _period_sql(column: str, source: str, unit: str) -> str:
    return f"""(SELECT round((max(m) FILTER (WHERE r = 1) - max(m) FILTER (WHERE r = 2)) / nullif(abs(max(m) FILTER (WHERE r = 2)), 0) * 100, 2)
      FROM (SELECT m, row_number() OVER (ORDER BY p DESC) AS r FROM
        (SELECT date_trunc('{unit}', o_orderdate) AS p, avg({column}) AS m FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)))"""


def _change_metrics(column: str, source: str) -> str:
    return ", ".join(
        f"{_period_sql(column, source, u)} AS {n}" for u, n in (("month", "mom_pct"), ("week", "wow_pct"), ("year", "yoy_pct"))
    )


@query(
    "period_change", union_sql([f"SELECT '{c}' AS column_name, {_change_metrics(c, ORDERS_WITH_GAPS)}" for c in DATED])
)
def period_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.period_change(orders_with_gaps(spark, sf_dir), "o_orderdate", DATED)


def fit_sql(column: str, source: str, date: str = "o_orderdate") -> str:
    """Rows sharing a date take their mean rank."""
    return f"""(SELECT regr_slope(v, i) AS slope, regr_r2(v, i) AS r2, avg(v) AS mean FROM
      (SELECT v, avg(rn) OVER (PARTITION BY d) AS i FROM
        (SELECT {column} AS v, {date} AS d, row_number() OVER (ORDER BY {date}) - 1 AS rn FROM {source} WHERE {column} IS NOT NULL)))"""


def full_fit_sql(column: str, source: str, date: str = "o_orderdate") -> str:
    """Slope with the variance of the untied ranks 0 .. n-1, as the trend defines it."""
    return f"""(SELECT covar_pop(v, i) / ((count(*)::DOUBLE * count(*) - 1) / 12) AS slope,
        covar_pop(v, i) * covar_pop(v, i) / (((count(*)::DOUBLE * count(*) - 1) / 12) * var_pop(v)) AS r2, avg(v) AS mean FROM
      (SELECT v, avg(rn) OVER (PARTITION BY d) AS i FROM
        (SELECT {column} AS v, {date} AS d, row_number() OVER (ORDER BY {date}) - 1 AS rn FROM {source} WHERE {column} IS NOT NULL)))"""


@query(
    "row_trend",
    union_sql(
        [f"SELECT '{c}' AS column_name, round(slope, 6) AS trend_slope, round(r2, 4) AS trend_r2 FROM {full_fit_sql(c, ORDERS_WITH_GAPS)}" for c in DATED]
        + [f"SELECT 'value' AS column_name, round(slope, 6), round(r2, 4) FROM {fit_sql('value', 'events', 'ts')}"]
    ),
)
def row_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = dates.row_trend(orders_with_gaps(spark, sf_dir), "o_orderdate", DATED)
    return orders.unionByName(dates.row_trend(table(spark, sf_dir, "events"), "ts", ["value"]))


def _last_sql(column: str, source: str) -> str:
    return f"(SELECT arg_max({column}, {{'d': o_orderdate, 'k': o_orderkey}}) FROM {source} WHERE {column} IS NOT NULL)"


@query(
    "forecast_next",
    union_sql(
        [f"SELECT '{c}' AS column_name, round({_last_sql(c, ORDERS_WITH_GAPS)} + slope, 4) AS forecast_next FROM {full_fit_sql(c, ORDERS_WITH_GAPS)}" for c in DATED]
    ),
)
def forecast_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.forecast_next(orders_with_gaps(spark, sf_dir), "o_orderdate", DATED, "o_orderkey")


def _month_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS column_name, strftime(arg_min(p, {{'m': -m, 'p': p}}), '%Y-%m') AS best_period, round(max(m), 2) AS best_value,
        strftime(arg_min(p, {{'m': m, 'p': p}}), '%Y-%m') AS worst_period, round(min(m), 2) AS worst_value
      FROM (SELECT date_trunc('month', o_orderdate) AS p, avg({column}) AS m FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)"""


@query("best_worst_month", union_sql([_month_sql(c, ORDERS_WITH_GAPS) for c in DATED]))
def best_worst_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.best_worst_month(orders_with_gaps(spark, sf_dir), "o_orderdate", DATED)


DIRECTION = "CASE WHEN slope > 0.01 * mean THEN 'up' WHEN slope < -0.01 * mean THEN 'down' ELSE 'flat' END"


@query(
    "trend_direction",
    union_sql(
        [f"SELECT '{c}' AS column_name, round(slope, 3) AS trend_slope, {DIRECTION} AS trend_direction FROM {full_fit_sql(c, ORDERS_WITH_GAPS)}" for c in DATED]
    ),
)
def trend_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.trend_direction(orders_with_gaps(spark, sf_dir), "o_orderdate", DATED)


def _all_metrics_sql(column: str) -> str:
    s = ORDERS_WITH_GAPS
    return f"""SELECT column_name, {_change_metrics(column, s)}, round(slope, 6) AS trend_slope, round(r2, 4) AS trend_r2,
        {DIRECTION} AS trend_direction, best_period, worst_period, round({_last_sql(column, s)} + slope, 4) AS forecast_next
      FROM {full_fit_sql(column, s)}, ({_month_sql(column, s)})"""


@query("date_metrics", union_sql([_all_metrics_sql(c) for c in DATED]))
def date_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.date_metrics(orders_with_gaps(spark, sf_dir), "o_orderdate", DATED, "o_orderkey")


VIEW_SQL = f"(SELECT * FROM {ORDERS_WITH_GAPS} WHERE o_orderpriority IN ('1-URGENT') AND o_orderdate < DATE '1998-01-01')"


def _filtered_sql(column: str, view: str = VIEW_SQL) -> str:
    """No row of the first view has a second measure: that one keeps its baseline."""
    if column == "o_square" and view == VIEW_SQL:
        return _all_metrics_sql(column)
    return f"""SELECT '{column}' AS column_name, {_change_metrics(column, view)}, round(f.slope, 3) AS trend_slope, round(b.r2, 4) AS trend_r2,
        CASE WHEN f.slope > 0.01 * f.mean THEN 'up' WHEN f.slope < -0.01 * f.mean THEN 'down' ELSE 'flat' END AS trend_direction,
        best_period, worst_period, round({_last_sql(column, ORDERS_WITH_GAPS)} + b.slope, 4) AS forecast_next
      FROM {full_fit_sql(column, view)} f, {full_fit_sql(column, ORDERS_WITH_GAPS)} b, ({_month_sql(column, view)})"""


@query("filtered_metrics", union_sql([_filtered_sql(c) for c in DATED]))
def filtered_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = orders_with_gaps(spark, sf_dir)
    view = filters.Filter(end="1997-12-31", dimensions={"o_orderpriority": "1-URGENT"})
    base = dates.date_metrics(orders, "o_orderdate", DATED, "o_orderkey")
    return dates.filtered_metrics(base, filters.apply_filter(orders, view, "o_orderdate"), "o_orderdate", DATED)


FINISHED_SQL = f"(SELECT * FROM {ORDERS_WITH_GAPS} WHERE o_orderstatus IN ('F') AND o_orderdate >= DATE '1993-06-01')"
ROLLUP_VIEWS = {
    "urgent": (filters.Filter(end="1997-12-31", dimensions={"o_orderpriority": "1-URGENT"}), VIEW_SQL),
    "finished": (filters.Filter(start="1993-06-01", selection=("o_orderstatus", "F")), FINISHED_SQL),
}


@query(
    "rollup_metrics",
    union_sql([f"SELECT '{name}' AS shown_view, * FROM ({_filtered_sql(c, sql)})" for name, (_, sql) in ROLLUP_VIEWS.items() for c in DATED]),
)
def rollup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rollup(orders_with_gaps(spark, sf_dir), "o_orderdate", ["o_orderpriority", "o_orderstatus"], DATED, "o_orderkey")
    out = None
    for name, (view, _) in ROLLUP_VIEWS.items():
        one = kept.filtered_metrics(view).withColumn("shown_view", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


LINE_VIEWS = {
    "all": (filters.Filter(), "true"),
    "late": (filters.Filter(start="1995-01-01"), "l_shipdate >= DATE '1995-01-01'"),
    "returned": (filters.Filter(dimensions={"l_returnflag": "R"}, selection=("l_linestatus", "F")), "l_returnflag = 'R' AND l_linestatus = 'F'"),
    "none": (filters.Filter(dimensions={"l_returnflag": "?"}), "false"),
}
LINE_MEASURES = ["l_quantity", "l_tax"]
GAPPY_SHIPPED = "(SELECT l_shipdate, l_linestatus, l_returnflag, l_quantity, CASE WHEN l_returnflag <> 'R' THEN l_tax END AS l_tax FROM lineitem)"


def _line_rollup(spark: SparkSession, sf_dir: str) -> Rollup:
    lines = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_returnflag") != "R", F.col("l_tax")))
    return rollup(lines, "l_shipdate", ["l_returnflag", "l_linestatus"], LINE_MEASURES)


@query(
    "rollup_trigger",
    union_sql(
        [
            f"""SELECT '{name}' AS shown_view, original_rows, filtered_rows,
        CAST(floor((original_rows - filtered_rows) * 100.0::DOUBLE / original_rows + 0.5) AS BIGINT) AS filtered_out_pct,
        (original_rows - filtered_rows)::DOUBLE / original_rows >= CASE WHEN original_rows > 50000 THEN 0.10 ELSE 0.20 END AS regenerate
        FROM (SELECT count(*) AS original_rows, count(*) FILTER (WHERE {cond}) AS filtered_rows FROM lineitem)"""
            for name, (_, cond) in LINE_VIEWS.items()
        ]
    ),
)
def rollup_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _line_rollup(spark, sf_dir)
    out = None
    for name, (view, _) in LINE_VIEWS.items():
        one = kept.regenerate_trigger(view).withColumn("shown_view", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _rollup_chart_sql(name: str, cond: str) -> str:
    rows = f"(SELECT * FROM {GAPPY_SHIPPED} WHERE {cond})"
    cards = [f"SELECT '{name}' AS shown_view, '{c}' AS chart, 'mean' AS x, round(avg({c}) + 3.7e-7::DOUBLE, 4) AS y FROM {rows}" for c in LINE_MEASURES]
    cards += [f"SELECT '{name}', '{c}', 'total', round(coalesce(sum({c}), 0) + 3.7e-7::DOUBLE, 4) FROM {rows}" for c in LINE_MEASURES]
    bars = f"SELECT '{name}', 'bar', l_returnflag, round(avg(l_tax) + 3.7e-7::DOUBLE, 4) FROM {rows} GROUP BY l_returnflag HAVING avg(l_tax) IS NOT NULL"
    return " UNION ALL ".join([*cards, bars])


@query("rollup_charts", union_sql([_rollup_chart_sql(name, cond) for name, (_, cond) in LINE_VIEWS.items()]))
def rollup_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _line_rollup(spark, sf_dir)
    out = None
    for name, (view, _) in LINE_VIEWS.items():
        cards = kept.kpi_cards(view)
        cells = F.inline(F.array(*[F.struct(F.lit(k).alias("x"), F.col(k).alias("y")) for k in ("mean", "total")]))
        one = cards.select(F.col("column_name").alias("chart"), cells).unionByName(
            kept.top_categories("l_tax", "l_returnflag", 20, view).select(F.lit("bar").alias("chart"), "x", "y")
        )
        one = one.select(F.lit(name).alias("shown_view"), "chart", "x", steady("y"))
        out = one if out is None else out.unionByName(one)
    return out


# -- filters ---------------------------------------------------------------------

ORDER_FIELDS = (
    "o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, "
    "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority"
)


@query(
    "filter_date_range",
    f"SELECT {ORDER_FIELDS} FROM orders WHERE orders.o_orderdate >= DATE '1997-03-01' AND orders.o_orderdate < DATE '1998-04-01'",
)
def filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(filters.filter_date_range(table(spark, sf_dir, "orders"), "o_orderdate", "1997-03-01", "1998-03-31"))


@query("filter_dimensions", f"SELECT {ORDER_FIELDS} FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def filter_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"o_orderstatus": "F", "o_orderpriority": "2-HIGH", "o_custkey": None, "o_orderkey": ""}
    return shown(filters.filter_dimensions(table(spark, sf_dir, "orders"), wanted))


@query(
    "filter_selection",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice, 4) AS l_extendedprice FROM lineitem WHERE lineitem.l_linenumber = 3",
)
def filter_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return shown(filters.filter_selection(filters.filter_selection(li, "l_linenumber", 3), "no_such_column", 1))


@query(
    "filterable_dimensions",
    "SELECT * FROM ("
    + union_sql(
        [
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_values FROM lineitem"
            for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")
        ]
    )
    + ") WHERE n_values BETWEEN 2 AND 20",
)
def filterable_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]
    return shown(filters.filterable_dimensions(table(spark, sf_dir, "lineitem"), names))


@query("dimension_values", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL")
def dimension_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.dimension_values(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    "regenerate_trigger",
    union_sql(
        [
            f"""SELECT '{flag}' AS kept, count(*) AS original_rows, count(*) FILTER (WHERE {cond}) AS filtered_rows,
        CAST(floor((count(*) - count(*) FILTER (WHERE {cond})) * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS filtered_out_pct,
        (count(*) - count(*) FILTER (WHERE {cond}))::DOUBLE / count(*) >= CASE WHEN count(*) > 50000 THEN 0.10 ELSE 0.20 END AS regenerate
        FROM lineitem"""
            for flag, cond in (("A", "l_returnflag = 'A'"), ("below 46", "l_quantity < 46"), ("below 50", "l_quantity < 50"))
        ]
    ),
)
def regenerate_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    views = {
        "A": filters.filter_dimensions(li, {"l_returnflag": "A"}),
        "below 46": li.where("l_quantity < 46"),
        "below 50": li.where("l_quantity < 50"),
    }
    out = None
    for name, view in views.items():
        one = filters.regenerate_trigger(li, view).withColumn("kept", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
