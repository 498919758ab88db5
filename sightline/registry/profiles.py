"""Profile and classification queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import anomalies, classify, profile
from sightline.registry.base import GAPPY_LINES, NARROW_LINES, gappy_lines, narrow_lines, query, shown, table

LINE_TYPES = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp"),
]
GAPPY_NAMES = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_returnflag"]


def union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


NULLS_SQL = union_sql(
    [
        f"SELECT {i} AS position, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS nulls FROM {GAPPY_LINES}"
        for i, c in enumerate(GAPPY_NAMES)
    ]
)


@query(
    "shape",
    union_sql(
        [
            f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, '{t}' AS dtype, count(*) AS n_rows, "
            f"CAST({len(LINE_TYPES)} AS BIGINT) AS n_cols FROM lineitem"
            for i, (c, t) in enumerate(LINE_TYPES)
        ]
    ),
)
def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(profile.shape(table(spark, sf_dir, "lineitem")))


@query(
    "null_profile",
    f"SELECT CAST(position AS BIGINT) AS position, column_name, n_rows, nulls, round(nulls * 100.0::DOUBLE / n_rows, 1) AS null_pct FROM ({NULLS_SQL})",
)
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(profile.null_profile(gappy_lines(spark, sf_dir)))


@query(
    "null_column_list",
    f"SELECT column_name, nulls, round(nulls * 100.0::DOUBLE / n_rows, 1) AS null_pct FROM ({NULLS_SQL}) WHERE nulls > 0",
)
def null_column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(profile.null_column_list(gappy_lines(spark, sf_dir)))


NARROW_DUPLICATES = (
    f"SELECT CAST(sum(c - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS c FROM {NARROW_LINES} "
    "GROUP BY l_quantity, l_tax, l_discount, l_returnflag)"
)


@query(
    "quality_warnings",
    f"""
    WITH n AS ({NULLS_SQL}), p AS (SELECT column_name, round(nulls * 100.0::DOUBLE / n_rows, 1) AS pct FROM n
      WHERE column_name IN ('l_quantity', 'l_tax', 'l_discount', 'l_returnflag'))
    SELECT 'high_nulls' AS code, column_name,
      'Column ''' || column_name || ''' has ' || CAST(pct AS VARCHAR) || '% missing values' AS message FROM p WHERE pct > 30
    UNION ALL SELECT 'duplicates', '', 'Found ' || CAST(duplicates AS VARCHAR) || ' duplicate rows' FROM ({NARROW_DUPLICATES})
    UNION ALL SELECT 'load', '', 'read as latin-1'
    """,
)
def quality_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quality_warnings(narrow_lines(spark, sf_dir), ["read as latin-1"])


@query("duplicate_rows", NARROW_DUPLICATES)
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_rows(narrow_lines(spark, sf_dir))


@query(
    "distinct_counts",
    union_sql(
        [
            f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM lineitem"
            for i, (c, _) in enumerate(LINE_TYPES)
        ]
    ),
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(profile.distinct_counts(table(spark, sf_dir, "lineitem")))


PROFILED = {
    "orders": {
        "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float",
        "o_orderdate": "datetime", "o_orderpriority": "string",
    },
    "customer": {
        "c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float",
        "c_mktsegment": "string",
    },
    "events": {
        "event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "string", "value": "float",
        "props": "string",
    },
    "part": {
        "p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer",
        "p_retailprice": "float",
    },
    "documents": {
        "doc_id": "integer", "text": "string", "lang": "string", "source": "string", "n_chars": "integer",
    },
    "lineitem": {
        "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
        "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime",
    },
}

PROFILE_SQL = union_sql(
    [
        f"SELECT '{t}' AS table_name, {i} AS position, '{c}' AS column_name, '{k}' AS kind, count(*) AS n_rows, "
        f"count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct, "
        + (f"CAST(max({c}) AS DOUBLE)" if k == "integer" else "CAST(NULL AS DOUBLE)")
        + f" AS max_value FROM {t}"
        for t, columns in PROFILED.items()
        for i, (c, k) in enumerate(columns.items())
    ]
)
DATE_WORDS = "date|time|year|month|day"
KPI_WORDS = (
    "revenue|sales|profit|amount|total|count|price|cost|value|quantity|qty|income|loss|margin|growth|rate|score|salary"
)
SEMANTIC_SQL = f"""SELECT table_name, position, column_name,
  CASE WHEN kind = 'datetime' AND nulls = n_rows THEN 'text'
       WHEN kind = 'datetime' OR regexp_matches(column_name, '{DATE_WORDS}') THEN 'datetime'
       WHEN kind IN ('integer', 'float') THEN 'numeric'
       WHEN column_name = 'id' OR column_name LIKE '%\\_id' ESCAPE '\\' THEN
         CASE WHEN n_distinct > 0.8 * n_rows THEN 'id' ELSE 'categorical' END
       WHEN kind = 'string' AND n_distinct < 0.5 * n_rows THEN 'categorical'
       ELSE 'text' END AS semantic_type FROM ({PROFILE_SQL})"""
TIME_WORDS = "week|month|quarter|year|day|date|period|time|timestamp"
SEGMENT_WORDS = "age|group|tier|level|rank|score|grade|class|type|category|store"
ROLE_SQL = f"""SELECT table_name, position, column_name, kind,
  CASE WHEN column_name LIKE '%id' AND length(column_name) > 2
         OR kind = 'integer' AND NOT regexp_matches(column_name, '{SEGMENT_WORDS}')
            AND (n_distinct > 0.5 * n_rows OR max_value = n_distinct AND n_distinct > 10) THEN 'identifier'
       WHEN kind = 'datetime' OR regexp_matches(column_name, '{TIME_WORDS}') THEN 'time'
       WHEN kind = 'integer' AND n_distinct <= 30 AND regexp_matches(column_name, '{SEGMENT_WORDS}') THEN 'segment'
       WHEN kind = 'string' OR kind = 'integer' AND n_distinct <= 15 THEN 'dimension'
       ELSE 'measure' END AS role FROM ({PROFILE_SQL})"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        profile.column_profile(table(spark, sf_dir, t)).withColumn("table_name", F.lit(t)) for t in PROFILED
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("semantic_types", f"SELECT table_name, CAST(position AS BIGINT) AS position, column_name, semantic_type FROM ({SEMANTIC_SQL})")
def semantic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = profile.semantic_types(_profiles(spark, sf_dir))
    return shown(typed.select("table_name", "position", "column_name", "semantic_type"))


@query(
    "kpi_columns",
    f"SELECT CAST(position AS BIGINT) AS position, column_name FROM ({SEMANTIC_SQL}) WHERE semantic_type = 'numeric' "
    f"AND regexp_matches(column_name, '{KPI_WORDS}')",
)
def kpi_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(profile.kpi_columns(profile.semantic_types(_profiles(spark, sf_dir))))


MEASURED = ["l_quantity", "l_extendedprice", "l_tax", "l_discount"]


def _describe_sql(digits: int, columns: list[str], shape: str) -> str:
    parts = []
    for c in columns:
        v = {
            "n": f"count({c})",
            "mean": f"round(avg({c}), {digits})",
            "std": f"round(stddev_samp({c}), {digits})",
            "min": f"round(min({c}), {digits})",
            "max": f"round(max({c}), {digits})",
            "q25": f"round(quantile_cont({c}, 0.25), {digits})",
            "q50": f"round(quantile_cont({c}, 0.5), {digits})",
            "q75": f"round(quantile_cont({c}, 0.75), {digits})",
        }
        wanted = ["n", "mean", "std", "min", "q25", "q50", "q75", "max"]
        names = {k: k for k in wanted}
        if shape == "stats":
            wanted = ["min", "max", "mean", "q50", "std", "q25", "q75"]
            names = {**{k: k for k in wanted}, "q50": "median"}
        parts.append(
            f"SELECT '{c}' AS column_name, " + ", ".join(f"{v[k]} AS {names[k]}" for k in wanted) + f" FROM {GAPPY_LINES}"
        )
    return union_sql(parts)


@query("describe", _describe_sql(2, MEASURED, "describe"))
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.describe(gappy_lines(spark, sf_dir), MEASURED)


@query("column_stats", _describe_sql(6, MEASURED, "stats"))
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_stats(gappy_lines(spark, sf_dir), MEASURED)


@query(
    "head_sample",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'None' ELSE o_orderpriority END AS o_orderpriority
    FROM orders ORDER BY orders.o_orderkey LIMIT 5""",
)
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderdate",
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return profile.head_sample(orders, ["o_orderkey"])


@query(
    "date_range",
    """SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS start_date, strftime(max(o_orderdate), '%Y-%m-%d') AS end_date,
      strftime(min(o_orderdate), '%Y-%m-%d') || ' to ' || strftime(max(o_orderdate), '%Y-%m-%d') AS date_range FROM orders""",
)
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.date_range(table(spark, sf_dir, "orders"), "o_orderdate")


@query(
    "kpi_series",
    """SELECT 'l_extendedprice' AS kpi, l_orderkey * 10 + l_linenumber AS order_key, round(l_extendedprice, 4) AS value FROM lineitem
    UNION ALL SELECT 'unit_price', l_orderkey * 10 + l_linenumber,
      round(CASE WHEN l_discount > 0 THEN l_extendedprice / l_discount END, 4) FROM lineitem""",
)
def kpi_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second KPI holds infinities and NaN where the discount is zero."""
    li = table(spark, sf_dir, "lineitem")
    endless = F.when(F.col("l_returnflag") == "R", F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    rows = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_key"),
        "l_extendedprice",
        F.coalesce(F.try_divide("l_extendedprice", "l_discount"), endless).alias("unit_price"),
    )
    return shown(profile.kpi_series(rows, ["l_extendedprice", "unit_price"], "order_key"))


@query(
    "health_score",
    f"""
    WITH z AS (SELECT count(*) FILTER (WHERE abs((l_extendedprice - m) / s) > 3) AS far
        FROM {GAPPY_LINES}, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem)),
      p AS (SELECT count(*) FILTER (WHERE pct > 30) AS sparse, count(*) FILTER (WHERE pct > 50) AS high,
          count(*) FILTER (WHERE pct > 30 AND pct <= 50) AS medium
        FROM (SELECT round(nulls * 100.0::DOUBLE / n_rows, 1) AS pct FROM ({NULLS_SQL})
              WHERE column_name IN ('l_quantity', 'l_tax', 'l_discount', 'l_returnflag'))),
      d AS ({NARROW_DUPLICATES}),
      t AS (SELECT sparse, duplicates, high, medium, greatest(0, 100 - 10 * sparse - 5 * (duplicates // 100) - 10 * high - 5 * medium) AS score
        FROM p, d)
    SELECT sparse AS sparse_columns, duplicates, high, medium, CAST(score AS BIGINT) AS health_score,
      CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Fair' ELSE 'Poor' END AS band FROM t
    """,
)
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = narrow_lines(spark, sf_dir)
    return profile.health_score(lines, anomalies.anom_missing(lines))


@query("column_roles", f"SELECT table_name, CAST(position AS BIGINT) AS position, column_name, role FROM ({ROLE_SQL})")
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = classify.column_roles(_profiles(spark, sf_dir))
    return shown(roles.select("table_name", "position", "column_name", "role"))


def _score_sql() -> str:
    def points(words: str, score: int) -> str:
        return f"sum(CASE WHEN regexp_matches(column_name, '{words}') THEN {score} ELSE 0 END)"

    return f"""
    WITH r AS ({ROLE_SQL}), s AS (SELECT table_name,
        {points("promotion|variant|treatment|group|test|campaign|condition|experiment", 3)}
          + CASE WHEN bool_or(role = 'identifier') AND bool_or(role = 'measure') THEN 1 ELSE 0 END AS experiment,
        CASE WHEN bool_or(role = 'time') THEN CASE WHEN bool_or(kind = 'datetime') THEN 2 ELSE 1 END ELSE 0 END
          + sum(CASE WHEN column_name IN ('week','month','quarter','year','day','date','period','time','timestamp')
              THEN CASE WHEN kind = 'integer' THEN 1 ELSE 2 END ELSE 0 END) AS timeseries,
        {points("order_id|transaction_id|invoice|receipt|purchase", 3)}
          + CASE WHEN bool_or(role = 'time') AND bool_or(role = 'measure') THEN {points("customer|client|user", 1)} ELSE 0 END
          AS transactional,
        {points("customer_id|user_id|age|segment|churn|ltv|gender|region|tier", 2)} AS customer,
        {points("revenue|cost|profit|margin|budget|expense|sales|income|ebitda", 2)} AS financial
      FROM r GROUP BY table_name),
    t AS (SELECT *, greatest(experiment, timeseries, transactional, customer, financial) AS best,
        experiment + timeseries + transactional + customer + financial AS total FROM s)
    SELECT table_name, CAST(experiment AS BIGINT) AS experiment, CAST(timeseries AS BIGINT) AS timeseries,
      CAST(transactional AS BIGINT) AS transactional, CAST(customer AS BIGINT) AS customer, CAST(financial AS BIGINT) AS financial,
      round(coalesce(best::DOUBLE / nullif(total, 0), 0), 3) AS confidence,
      CASE WHEN total = 0 THEN 'general' WHEN experiment >= 3 AND experiment = best THEN 'experiment'
           WHEN best < 0.5 * total THEN 'general' WHEN experiment = best THEN 'experiment'
           WHEN timeseries = best THEN 'timeseries' WHEN transactional = best THEN 'transactional'
           WHEN customer = best THEN 'customer' ELSE 'financial' END AS dataset_type
    FROM t"""


@query("dataset_type_score", _score_sql())
def dataset_type_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        classify.dataset_type_score(classify.column_roles(profile.column_profile(table(spark, sf_dir, t)))).withColumn(
            "table_name", F.lit(t)
        )
        for t in PROFILED
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "primary_measure",
    """SELECT 'l_extendedprice' AS column_name, round(var_samp(l_extendedprice), 2) AS variance FROM lineitem
    WHERE (SELECT var_samp(l_extendedprice) > greatest(var_samp(l_quantity), var_samp(l_tax), var_samp(l_discount)) FROM lineitem)""",
)
def primary_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(classify.primary_measure(table(spark, sf_dir, "lineitem"), MEASURED), 2)


def _code_sql(dim: str, position: int) -> str:
    return f"""SELECT '{dim}' AS column_name, {position} AS position, abs(corr(code, o_totalprice)) AS score FROM (
      SELECT o_totalprice, coalesce(code, -1) AS code FROM o LEFT JOIN (
        SELECT d, row_number() OVER (ORDER BY d) - 1 AS code FROM (SELECT DISTINCT {dim} AS d FROM o WHERE {dim} IS NOT NULL))
      ON {dim} = d)"""


@query(
    "primary_dimension",
    f"""WITH o AS (SELECT o_totalprice, o_orderstatus, nullif(o_orderpriority, '3-MEDIUM') AS o_orderpriority FROM orders),
      s AS ({_code_sql("o_orderstatus", 0)} UNION ALL {_code_sql("o_orderpriority", 1)})
    SELECT column_name, round(score, 6) AS score FROM s ORDER BY s.score DESC, position LIMIT 1""",
)
def primary_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '3-MEDIUM')"))
    return shown(classify.primary_dimension(orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice"), 6)


@query(
    "category_codes",
    f"""WITH o AS (SELECT o_totalprice, o_orderstatus, nullif(o_orderpriority, '3-MEDIUM') AS o_orderpriority FROM orders),
      s AS ({_code_sql("o_orderstatus", 0)} UNION ALL {_code_sql("o_orderpriority", 1)})
    SELECT column_name, round(score, 6) AS correlation FROM s""",
)
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways of coding categories: in one small window and by a distributed sort."""
    orders = table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '3-MEDIUM')"))
    small = classify.category_correlation(orders, "o_orderstatus", "o_totalprice")
    large = classify.category_correlation(orders, "o_orderpriority", "o_totalprice", small_rows=2)
    return shown(small.unionByName(large), 6)


@query(
    "cardinalities",
    union_sql(
        [
            f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_values FROM {GAPPY_LINES}"
            for i, c in enumerate(["l_orderkey", "l_tax", "l_discount", "l_returnflag"])
        ]
    ),
)
def cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(classify.cardinalities(gappy_lines(spark, sf_dir), ["l_orderkey", "l_tax", "l_discount", "l_returnflag"]))
