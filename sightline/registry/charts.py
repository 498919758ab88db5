"""Chart dataset queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import charts
from sightline.registry.base import PRICED_LINES, priced_lines, query, shown, steady, table
from sightline.registry.findings import SIZE_BUCKETS, cells_sql, histogram_sql
from sightline.registry.profiles import union_sql

CARDS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "kpi_cards",
    union_sql([f"SELECT '{c}' AS column_name, round(avg({c}), 2) AS mean, round(sum({c}), 2) AS total FROM lineitem" for c in CARDS]),
)
def kpi_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(charts.kpi_cards(table(spark, sf_dir, "lineitem"), CARDS), 2)


@query(
    "bar_pct_diff",
    """WITH m AS (SELECT l_returnflag AS x, avg(l_extendedprice) AS y FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1)
    SELECT x, round(y, 4) AS y, round((y - max(y) OVER ()) / abs(max(y) OVER ()) * 100, 1) AS pct_diff FROM m""",
)
def bar_pct_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(charts.bar_pct_diff(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag"))


@query(
    "grouped_bar",
    f"""SELECT CAST(seg AS VARCHAR) AS category, round(max(m) FILTER (WHERE var = 'A'), 4) AS "A", round(max(m) FILTER (WHERE var = 'N'), 4) AS "N",
      round(max(m) FILTER (WHERE var = 'R'), 4) AS "R" FROM {cells_sql("l_linenumber", "l_returnflag", "l_extendedprice", "lineitem")} GROUP BY 1""",
)
def grouped_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return shown(charts.grouped_bar(li, "l_extendedprice", "l_linenumber", "l_returnflag", ["A", "N", "R"]))


@query(
    "multi_line",
    f"""SELECT strftime(seg, '%Y-%m-%d %H:%M:%S') AS x, round(m + 3.7e-7::DOUBLE, 4) AS y, var AS grp
    FROM {cells_sql("l_shipdate", "l_returnflag", "l_extendedprice", "lineitem")}""",
)
def multi_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = charts.multi_line(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_shipdate", "l_returnflag")
    return lines.select("x", steady("y"), "grp")


@query("segment_bar", f"SELECT bucket, round(low, 4) AS low, round(high, 4) AS high, round(mean, 4) AS y FROM ({SIZE_BUCKETS})")
def segment_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(charts.segment_bar(table(spark, sf_dir, "part"), "p_size", "p_retailprice"))


TS_LINE = "SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS x, round(avg(o_totalprice) + 3.7e-7::DOUBLE, 4) AS y FROM orders GROUP BY 1"


@query("ts_line", TS_LINE)
def ts_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.ts_line(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate").select("x", steady("y"))


@query("ranked_periods", TS_LINE)
def ranked_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.ranked_periods(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate").select("x", steady("y"))


@query(
    "top_categories",
    """SELECT x, round(y, 4) AS y FROM (SELECT CAST(o_custkey AS VARCHAR) AS x, avg(o_totalprice) AS y FROM orders GROUP BY o_custkey
      ORDER BY avg(o_totalprice) DESC, o_custkey LIMIT 20)""",
)
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(charts.top_categories(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", 20))


REC_KPIS = ["charge", "l_extendedprice", "discount_rate", "l_quantity"]
RATED_LINES = f"(SELECT *, l_discount AS discount_rate FROM {PRICED_LINES})"


@query(
    "rec_kpi",
    union_sql(
        [
            f"SELECT '{c}' AS column_name, '{'mean' if c == 'discount_rate' else 'sum'}' AS aggregation, "
            f"round({'avg' if c == 'discount_rate' else 'sum'}({c}), 2) AS y FROM {RATED_LINES}"
            for c in REC_KPIS
        ]
    ),
)
def rec_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = priced_lines(spark, sf_dir).withColumn("discount_rate", F.col("l_discount"))
    return shown(charts.rec_kpi(lines, [*REC_KPIS, "revenue"]), 2)


HOLED = "(SELECT o_orderdate, o_totalprice FROM orders WHERE NOT month(o_orderdate) BETWEEN 5 AND 6)"


@query(
    "rec_time_line",
    f"""WITH s AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM {HOLED}),
      g AS (SELECT unnest(generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', b)::TIMESTAMP, INTERVAL 1 MONTH)) AS x FROM s),
      m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS x, sum(o_totalprice) AS y FROM {HOLED} GROUP BY 1)
    SELECT 'long' AS span, strftime(g.x, '%Y-%m-%d %H:%M:%S') AS x, round(coalesce(y, 0), 2) AS y FROM g LEFT JOIN m ON g.x = m.x
    UNION ALL SELECT 'short', strftime(x, '%Y-%m-%d %H:%M:%S'), round(y, 2) FROM
      (SELECT date_trunc('hour', ts) AS x, sum(value) AS y FROM events WHERE value IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 200)""",
)
def rec_time_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of orders whose prices in May and June are missing; a month of events by the hour."""
    price = F.when(~F.month("o_orderdate").between(5, 6), F.col("o_totalprice"))
    holed = table(spark, sf_dir, "orders").withColumn("o_totalprice", price)
    hours = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("hour", "ts"))
    long = charts.rec_time_line(holed, "o_totalprice", "o_orderdate", 200).withColumn("span", F.lit("long"))
    short = charts.rec_time_line(hours, "value", "ts", 200).withColumn("span", F.lit("short"))
    return shown(long.unionByName(short), 2)


CATEGORIES = ["o_orderpriority", "o_orderstatus", "o_custkey"]


@query(
    "rec_bar",
    """SELECT 'o_orderstatus' AS column_name, o_orderstatus AS x, round(sum(o_totalprice), 2) AS y FROM orders
    WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""",
)
def rec_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(charts.rec_bar(table(spark, sf_dir, "orders"), "o_totalprice", CATEGORIES), 2)


@query("rec_pie", "SELECT 'o_orderpriority' AS column_name, o_orderpriority AS x, count(*) AS y FROM orders GROUP BY o_orderpriority")
def rec_pie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.rec_pie(table(spark, sf_dir, "orders"), CATEGORIES)


@query("rec_histogram", f"SELECT 'l_extendedprice' AS column_name, * FROM ({histogram_sql('l_extendedprice', 'lineitem')})")
def rec_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(charts.rec_histogram(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))
