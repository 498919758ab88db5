"""Correlation, distribution and finding queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.shapes import shape_pattern
from sightline.operators import correlation, wording
from sightline.operators import findings as N
from sightline.registry.base import PRICED_LINES, priced_lines, query, shown, steady, table
from sightline.registry.profiles import union_sql

PRICES = ["charge", "l_discount", "l_extendedprice", "l_quantity", "l_tax", "revenue"]


@query(
    "top_correlations",
    "WITH p AS (SELECT * REPLACE (CASE WHEN l_returnflag <> 'R' THEN l_tax END AS l_tax) FROM "
    + PRICED_LINES
    + ") SELECT col_a, col_b, round(q.r, 4) AS r FROM ("
    + union_sql(
        [f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM p" for a, b in combinations(PRICES, 2)]
    )
    + ") q WHERE abs(q.r) > 0.3 ORDER BY abs(q.r) DESC, col_a, col_b LIMIT 10",
)
def top_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priced_lines(spark, sf_dir).withColumn("l_tax", F.when(F.col("l_returnflag") != "R", F.col("l_tax")))
    return correlation.top_correlations(rows, PRICES)


WIDE = {f"x{i:02d}": f"(l_extendedprice * {1 + i % 4} + l_quantity * {700 * (i % 5)} + (l_orderkey % {i + 2}) * {5000 * (i % 3)} + l_linenumber * {300 * i})" for i in range(16)}


@query(
    "top_correlations_wide",
    "WITH w AS (SELECT " + ", ".join(f"CASE WHEN l_linenumber % 6 <> {i % 7} THEN CAST({x} AS DOUBLE) END AS {c}" for i, (c, x) in enumerate(WIDE.items())) + " FROM lineitem) "
    + "SELECT col_a, col_b, round(q.r, 4) AS r FROM ("
    + union_sql([f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM w" for a, b in combinations(WIDE, 2)])
    + ") q WHERE abs(q.r) > 0.3 ORDER BY abs(q.r) DESC, col_a, col_b LIMIT 40",
)
def wide_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of many columns with missing values, from one scan."""
    cells = [F.when(F.col("l_linenumber") % 6 != i % 7, F.expr(x).cast("double")).alias(c) for i, (c, x) in enumerate(WIDE.items())]
    return correlation.top_correlations(table(spark, sf_dir, "lineitem").select(*cells), list(WIDE), top=40)


SPARSE_PRICES = f"""(SELECT charge, revenue, l_extendedprice, l_quantity, l_discount, 1.0::DOUBLE AS constant
  FROM (SELECT * REPLACE (CASE WHEN l_returnflag <> 'R' THEN revenue END AS revenue) FROM {PRICED_LINES})
  WHERE revenue IS NOT NULL)"""
MATRIX = ["charge", "revenue", "l_extendedprice", "l_quantity", "l_discount"]
MATRIX_SQL = union_sql(
    [
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 2) + 0.0::DOUBLE AS value FROM {SPARSE_PRICES}"
        for a in MATRIX
        for b in MATRIX
    ]
)


def _sparse_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priced_lines(spark, sf_dir).withColumn("revenue", F.when(F.col("l_returnflag") != "R", F.col("revenue")))
    return rows.withColumn("constant", F.lit(1.0))


@query("corr_matrix", MATRIX_SQL)
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.corr_matrix(_sparse_prices(spark, sf_dir), [*MATRIX, "constant"])


@query(
    "corr_heatmap_pivot",
    "SELECT y, "
    + ", ".join(f"coalesce(max(value) FILTER (WHERE x = '{c}'), 0) AS {c}" for c in [*MATRIX, "constant"])
    + f" FROM ({MATRIX_SQL}) GROUP BY y",
)
def corr_heatmap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*MATRIX, "constant"]
    return correlation.heatmap_pivot(correlation.corr_matrix(_sparse_prices(spark, sf_dir), names), names)


@query(
    "scatter_best_pair",
    "SELECT x_col, y_col, round(q.r, 6) AS r FROM ("
    + union_sql(
        [
            f"SELECT '{a}' AS x_col, '{b}' AS y_col, corr({a}, {b}) AS r FROM {SPARSE_PRICES}"
            for a, b in combinations(MATRIX, 2)
        ]
    )
    + ") q WHERE abs(q.r) > 0.3 AND abs(q.r) < 1 ORDER BY abs(q.r) DESC, x_col, y_col LIMIT 1",
)
def scatter_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(correlation.scatter_best_pair(_sparse_prices(spark, sf_dir), MATRIX), 6)


@query(
    "scatter_points",
    "WITH best AS (SELECT x_col, y_col FROM ("
    + union_sql(
        [
            f"SELECT '{a}' AS x_col, '{b}' AS y_col, corr({a}, {b}) AS r FROM {SPARSE_PRICES}"
            for a, b in combinations(MATRIX, 2)
        ]
    )
    + ") q WHERE abs(q.r) > 0.3 AND abs(q.r) < 1 ORDER BY abs(q.r) DESC, x_col, y_col LIMIT 1) "
    + "SELECT x_col, y_col, round(x + 3.7e-7::DOUBLE, 4) AS x, round(y + 3.7e-7::DOUBLE, 4) AS y FROM ("
    + union_sql(
        [
            f"SELECT '{a}' AS x_col, '{b}' AS y_col, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM {SPARSE_PRICES} WHERE "
            + " AND ".join(f"{c} IS NOT NULL" for c in MATRIX)
            for a, b in combinations(MATRIX, 2)
        ]
    )
    + ") JOIN best USING (x_col, y_col)",
)
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = correlation.scatter_points(_sparse_prices(spark, sf_dir), MATRIX)
    return points.select("x_col", "y_col", steady("x"), steady("y"))


def histogram_sql(column: str, source: str) -> str:
    return f"""
    WITH v AS (SELECT CAST({column} AS DOUBLE) AS v FROM {source} WHERE {column} IS NOT NULL),
      s AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5::DOUBLE ELSE min(v) END AS lo,
                   CASE WHEN min(v) = max(v) THEN max(v) + 0.5::DOUBLE ELSE max(v) END AS hi FROM v),
      w AS (SELECT lo, hi, (hi - lo) / 20.0::DOUBLE AS w FROM s),
      g AS (SELECT v, lo, w, least(CAST(floor((v - lo) / w) AS BIGINT), 19) AS g FROM v, w),
      b AS (SELECT CASE WHEN v < lo + g * w THEN g - 1 WHEN v >= lo + (g + 1) * w AND g < 19 THEN g + 1 ELSE g END AS bin,
                   count(*) AS c FROM g GROUP BY 1)
    SELECT CAST(i AS BIGINT) AS bin, round(lo + (i + 0.5::DOUBLE) * w, 4) AS x, coalesce(c, 0) AS y
    FROM w, range(20) r(i) LEFT JOIN b ON b.bin = i"""


@query("histogram", histogram_sql("l_extendedprice", "lineitem"))
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(correlation.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query(
    "histogram_edges",
    f"""SELECT * FROM (SELECT 'l_quantity' AS column_name, * FROM ({histogram_sql("l_quantity", "lineitem")}))
    UNION ALL SELECT * FROM (SELECT 'constant', * FROM ({histogram_sql("constant", "(SELECT 7.0 AS constant FROM lineitem)")}))""",
)
def histogram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers on bin edges, and a constant column."""
    li = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(7.0))
    parts = [
        shown(correlation.histogram(li, c)).withColumn("column_name", F.lit(c)) for c in ("l_quantity", "constant")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "skew_shape",
    """SELECT round(skewness(value), 4) AS skew,
      CASE WHEN skewness(value) > 1 THEN 'right' WHEN skewness(value) < -1 THEN 'left' ELSE 'symmetric' END AS shape FROM events""",
)
def skew_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(correlation.skew_shape(table(spark, sf_dir, "events"), "value"))


@query("value_counts", "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.value_counts(table(spark, sf_dir, "events"), "event_type")


@query(
    "group_distribution",
    """SELECT event_type AS grp, count(value) AS n, round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q25,
      round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q75, round(max(value), 4) AS max
    FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY 1""",
)
def group_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(correlation.group_distribution(table(spark, sf_dir, "events"), "event_type", "value"))


@query(
    "group_values",
    """SELECT grp, seq, round(value, 4) AS value FROM (SELECT event_type AS grp, value,
      row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events
      WHERE event_type IS NOT NULL AND value IS NOT NULL) WHERE seq <= 500""",
)
def group_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(correlation.group_values(table(spark, sf_dir, "events"), "event_type", "value", ["event_id"]))


# -- findings --------------------------------------------------------------------

FLAG_MEANS = "(SELECT l_returnflag AS g, avg(l_extendedprice) AS m FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1)"


def ends_sql(dim: str, measure: str, source: str) -> str:
    return f"""SELECT arg_min(g, {{'m': -m, 'g': g}}) AS winner, max(m) AS winner_val, arg_max(g, {{'m': -m, 'g': g}}) AS loser,
      min(m) AS loser_val, count(*) AS n_groups
    FROM (SELECT CAST({dim} AS VARCHAR) AS g, avg({measure}) AS m FROM {source} WHERE {dim} IS NOT NULL GROUP BY 1) WHERE m IS NOT NULL"""


EXP_WINNER_SQL = f"""SELECT winner, round(winner_val, 4) AS winner_val, loser, round(loser_val, 4) AS loser_val, n_groups, gap_pct,
    CASE WHEN gap_pct > 10 THEN 'high' WHEN gap_pct >= 5 THEN 'medium' ELSE 'low' END AS significance
  FROM (SELECT *, round(coalesce((winner_val - loser_val) / nullif(abs(loser_val), 0) * 100, 0), 1) AS gap_pct
    FROM ({ends_sql("l_returnflag", "l_extendedprice", "lineitem")}) WHERE n_groups >= 2)"""


@query("exp_winner", EXP_WINNER_SQL)
def exp_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.exp_winner(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag"))


def cells_sql(seg: str, var: str, measure: str, source: str) -> str:
    return (
        f"(SELECT {seg} AS seg, {var} AS var, avg({measure}) AS m FROM {source} "
        f"WHERE {seg} IS NOT NULL AND {var} IS NOT NULL AND {measure} IS NOT NULL GROUP BY 1, 2)"
    )


@query(
    "exp_segment_winners",
    f"""WITH w AS (SELECT seg, arg_min(var, {{'m': -m, 'v': var}}) AS winner, max(m) AS winner_mean
        FROM {cells_sql("l_linenumber", "l_returnflag", "l_extendedprice", "lineitem")} GROUP BY 1),
      c AS (SELECT count(DISTINCT winner) = 1 AS consistent FROM w)
    SELECT CAST(seg AS VARCHAR) AS segment, winner, round(winner_mean, 4) AS winner_mean, consistent,
      CASE WHEN consistent THEN 'medium' ELSE 'high' END AS significance FROM w, c""",
)
def exp_segment_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return shown(N.exp_segment_winners(li, "l_extendedprice", "l_returnflag", "l_linenumber"))


@query(
    "exp_period_stability",
    f"""WITH c AS {cells_sql("ship_year", "l_returnflag", "l_extendedprice", PRICED_LINES)},
      w AS (SELECT seg, arg_min(var, {{'m': -m, 'v': var}}) AS winner FROM c GROUP BY 1),
      s AS (SELECT count(DISTINCT winner) = 1 AS stable FROM w)
    SELECT CAST(seg AS VARCHAR) AS period, var AS variant, round(m, 4) AS mean, winner, stable,
      CASE WHEN stable THEN 'low' ELSE 'high' END AS significance FROM c JOIN w USING (seg), s""",
)
def exp_period_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.exp_period_stability(priced_lines(spark, sf_dir), "l_extendedprice", "l_returnflag", "ship_year"))


@query(
    "exp_spread",
    """WITH s AS (SELECT l_returnflag AS variant, stddev_samp(l_extendedprice) AS std, avg(l_extendedprice) AS mean
        FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1)
    SELECT variant, round(std, 4) AS std, round(mean, 4) AS mean, round(std / nullif(mean, 0), 4) AS cv,
      CASE WHEN max(std / nullif(mean, 0)) OVER () > 0.3 THEN 'high' ELSE 'low' END AS significance FROM s""",
)
def exp_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.exp_spread(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag"))


@query(
    "exp_unit_gap",
    """WITH u AS (SELECT l_partkey AS u, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1),
      n AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) + 1 AS k FROM u),
      r AS (SELECT u, m, row_number() OVER (ORDER BY m DESC, u) AS top, row_number() OVER (ORDER BY m, u) AS low FROM u),
      a AS (SELECT any_value(n) AS n_units, avg(m) FILTER (WHERE top <= k) AS t, avg(m) FILTER (WHERE low <= k) AS b,
        string_agg(CAST(u AS VARCHAR), ',' ORDER BY top) FILTER (WHERE top <= least(5, k)) AS top_ids FROM r, n)
    SELECT n_units, round(t, 4) AS top_mean, round(b, 4) AS bottom_mean, gap_pct, top_ids,
      CASE WHEN gap_pct > 50 THEN 'high' ELSE 'medium' END AS significance
    FROM (SELECT *, CASE WHEN b > 0 THEN round((t - b) / abs(b) * 100, 1) ELSE 0 END AS gap_pct FROM a)""",
)
def exp_unit_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.exp_unit_gap(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_partkey"))


BUCKET_SQL = """
    WITH e AS (SELECT list_sort(list_distinct([min(s), quantile_cont(s, 0.25), quantile_cont(s, 0.5), quantile_cont(s, 0.75), max(s)])) AS e
        FROM (SELECT CAST({seg} AS DOUBLE) AS s FROM {source})),
      b AS (SELECT greatest(1, len([x for x in e if x < s])) AS bucket, m, e
        FROM (SELECT CAST({seg} AS DOUBLE) AS s, {measure} AS m FROM {source} WHERE {seg} IS NOT NULL), e)
    SELECT CAST(bucket AS BIGINT) AS bucket, any_value(e[bucket]) AS low, any_value(e[least(bucket + 1, len(e))]) AS high,
      count(*) AS n_rows, avg(m) AS mean FROM b GROUP BY bucket HAVING avg(m) IS NOT NULL"""
SIZE_BUCKETS = BUCKET_SQL.format(seg="p_size", measure="p_retailprice", source="part")
TAX_BUCKETS = BUCKET_SQL.format(
    seg="l_linenumber", measure="l_extendedprice", source="(SELECT least(l_linenumber, 3) AS l_linenumber, l_extendedprice FROM lineitem)"
)


@query(
    "segment_buckets",
    f"""SELECT 'part' AS source, bucket, round(low, 4) AS low, round(high, 4) AS high, n_rows, round(mean, 4) AS mean FROM ({SIZE_BUCKETS})
    UNION ALL SELECT 'lineitem', bucket, round(low, 4), round(high, 4), n_rows, round(mean, 4) FROM ({TAX_BUCKETS})""",
)
def segment_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second table has coinciding quartiles."""
    li = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.least("l_linenumber", F.lit(3)))
    one = N.segment_buckets(table(spark, sf_dir, "part"), "p_size", "p_retailprice").withColumn("source", F.lit("part"))
    two = N.segment_buckets(li, "l_linenumber", "l_extendedprice").withColumn("source", F.lit("lineitem"))
    return shown(one.unionByName(two))


PATTERN_CASE = """CASE WHEN len(v) < 3 THEN 'flat'
      WHEN list_bool_and([v[i + 1] > v[i] for i in range(1, len(v))]) THEN 'increasing'
      WHEN list_bool_and([v[i + 1] < v[i] for i in range(1, len(v))]) THEN 'decreasing'
      WHEN v[h + 1] < list_avg(v[1:h]) AND v[h + 1] < list_avg(v[h + 1:]) THEN 'u-shaped'
      WHEN v[h + 1] > list_avg(v[1:h]) AND v[h + 1] > list_avg(v[h + 1:]) THEN 'inverted-u'
      ELSE 'flat' END"""


@query(
    "shape_pattern",
    f"""WITH q AS (SELECT o_custkey, quarter(o_orderdate) AS q, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2),
      l AS (SELECT o_custkey, list(m ORDER BY q) AS v, count(*) // 2 AS h FROM q GROUP BY 1)
    SELECT o_custkey, {PATTERN_CASE} AS pattern FROM l""",
)
def shape_of_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern of the mean order value over the quarters of the year, per customer."""
    orders = table(spark, sf_dir, "orders")
    quarters = orders.groupBy("o_custkey", F.quarter("o_orderdate").alias("q")).agg(F.avg("o_totalprice").alias("m"))
    # At most four quarters per customer.
    lists = quarters.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("q", "m"))).alias("s"))
    return lists.select("o_custkey", shape_pattern(F.transform("s", lambda s: s["m"])).alias("pattern"))


def period_sql(unit: str = "day") -> str:
    return f"""(SELECT p, m, row_number() OVER (ORDER BY p) - 1 AS i FROM
      (SELECT date_trunc('{unit}', o_orderdate) AS p, avg(o_totalprice) AS m FROM orders GROUP BY 1))"""


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))


TREND_SQL = f"""SELECT CASE WHEN slope > 0 THEN 'upward' ELSE 'downward' END AS direction, round(slope, 4) AS slope, round(r2, 3) AS r2,
    total_change_pct, n_periods, round(first_val, 4) AS first_val, round(last_val, 4) AS last_val, round(min_val, 4) AS min_val,
    round(max_val, 4) AS max_val, CASE WHEN abs(total_change_pct) > 15 THEN 'high' ELSE 'medium' END AS significance
  FROM (SELECT *, round((last_val - first_val) / abs(first_val) * 100, 1) AS total_change_pct FROM
    (SELECT regr_slope(m, i) AS slope, regr_r2(m, i) AS r2, count(*) AS n_periods, arg_min(m, p) AS first_val,
       arg_max(m, p) AS last_val, min(m) AS min_val, max(m) AS max_val FROM {{source}}))"""


@query("ts_trend", TREND_SQL.format(source=period_sql()))
def ts_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.ts_trend(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate"))


@query(
    "ts_trend_text",
    TREND_SQL.format(
        source="""(SELECT p, m, row_number() OVER (ORDER BY p) - 1 AS i FROM
          (SELECT strftime(o_orderdate, '%Y-%m') AS p, avg(o_totalprice) AS m FROM orders GROUP BY 1))"""
    ),
)
def ts_trend_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods given as text are numbered by a distributed sort."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return shown(N.ts_trend(orders, "o_totalprice", "month"))


BEST_WORST_SQL = f"""SELECT strftime(bp, '%Y-%m-%d %H:%M:%S') AS best_period, round(bv, 4) AS best_val,
    strftime(wp, '%Y-%m-%d %H:%M:%S') AS worst_period, round(wv, 4) AS worst_val, round((bv - wv) / abs(wv) * 100, 1) AS gap_pct,
    'medium' AS significance
  FROM (SELECT arg_min(p, {{'m': -m, 'p': p}}) AS bp, max(m) AS bv, arg_min(p, {{'m': m, 'p': p}}) AS wp, min(m) AS wv FROM {period_sql("month")})"""


@query("ts_best_worst", BEST_WORST_SQL)
def ts_best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.ts_best_worst(_monthly(spark, sf_dir), "o_totalprice", "month"))


SPIKE_SQL = f"""SELECT n_notable, strftime(p, '%Y-%m-%d %H:%M:%S') AS notable_period, change_pct,
    CASE WHEN abs(change_pct) > 50 THEN 'high' ELSE 'medium' END AS significance
  FROM (SELECT count(*) AS n_notable, arg_min(p, {{'c': -abs(c), 'p': p}}) AS p, round(arg_min(c, {{'c': -abs(c), 'p': p}}) * 100, 1) AS change_pct
    FROM (SELECT p, m / nullif(lag(m) OVER (ORDER BY p), 0) - 1 AS c FROM {period_sql()}) WHERE abs(c) > 0.25) WHERE n_notable > 0"""


@query("ts_spikes", SPIKE_SQL)
def ts_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.ts_spikes(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate"))


LATEST_SQL = f"""SELECT strftime(lp, '%Y-%m-%d %H:%M:%S') AS last_period, round(lv, 4) AS last_val,
    strftime(pp, '%Y-%m-%d %H:%M:%S') AS prev_period, round(pv, 4) AS prev_val, change_pct,
    CASE WHEN abs(change_pct) > 10 THEN 'high' ELSE 'low' END AS significance
  FROM (SELECT *, round(coalesce((lv - pv) / nullif(abs(pv), 0) * 100, 0), 1) AS change_pct FROM
    (SELECT max(p) FILTER (WHERE r = 1) AS lp, max(m) FILTER (WHERE r = 1) AS lv, max(p) FILTER (WHERE r = 2) AS pp, max(m) FILTER (WHERE r = 2) AS pv
     FROM (SELECT p, m, row_number() OVER (ORDER BY p DESC) AS r FROM {period_sql("month")})))"""


@query("ts_latest_change", LATEST_SQL)
def ts_latest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.ts_latest_change(_monthly(spark, sf_dir), "o_totalprice", "month"))


PARETO_SQL = """SELECT top_share, round(top_mean, 4) AS top_mean, round(overall_mean, 4) AS overall_mean, round(total, 4) AS total,
    CASE WHEN top_share > 50 THEN 'high' ELSE 'medium' END AS significance
  FROM (SELECT CASE WHEN total > 0 THEN round(ts / total * 100, 1) ELSE 0 END AS top_share, ts / k AS top_mean, overall_mean, total FROM
    (SELECT sum(v) FILTER (WHERE r <= k) AS ts, any_value(k) AS k, avg(v) AS overall_mean, sum(v) AS total FROM
      (SELECT v, row_number() OVER (ORDER BY v DESC) AS r, greatest(1, CAST(floor(count(*) OVER () * 0.1::DOUBLE) AS BIGINT)) AS k
       FROM (SELECT {measure} AS v FROM {source} WHERE {measure} IS NOT NULL))))"""


@query("pareto_top10", PARETO_SQL.format(measure="value", source="events"))
def pareto_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.pareto_top10(table(spark, sf_dir, "events"), "value"))


@query(
    "pareto_ties",
    PARETO_SQL.format(measure="l_quantity", source="lineitem"),
)
def pareto_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty distinct values: the tenth ends inside a run of equal ones."""
    return shown(N.pareto_top10(table(spark, sf_dir, "lineitem"), "l_quantity"))


DISTRIBUTION_SQL = """SELECT round(avg({m}), 4) AS mean, round(quantile_cont({m}, 0.5), 4) AS median, round(min({m}), 4) AS min,
    round(max({m}), 4) AS max, round(skewness({m}), 4) AS skew,
    CASE WHEN skewness({m}) > 1 THEN 'right' WHEN skewness({m}) < -1 THEN 'left' ELSE 'symmetric' END AS shape,
    'medium' AS significance FROM {source}"""


@query("distribution_summary", DISTRIBUTION_SQL.format(m="value", source="events"))
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.distribution_summary(table(spark, sf_dir, "events"), "value"))


def impact_sql(dim: str, measure: str, source: str, gap: str, high: int) -> str:
    return f"""SELECT winner AS best, round(winner_val, 4) AS best_val, loser AS worst, round(loser_val, 4) AS worst_val, gap_pct, n_groups,
      CASE WHEN gap_pct > {high} THEN 'high' ELSE 'medium' END AS significance
    FROM (SELECT *, coalesce(round({gap}, 1), 0) AS gap_pct FROM ({ends_sql(dim, measure, source)}))"""


PLAIN_GAP = "(winner_val - loser_val) / nullif(abs(loser_val), 0) * 100"
POSITIVE_GAP = f"CASE WHEN loser_val > 0 THEN {PLAIN_GAP} END"
IMPACTS = {
    "transactional": (POSITIVE_GAP, 20),
    "customer": (PLAIN_GAP, 20),
    "general": (PLAIN_GAP, 15),
}


@query(
    "dim_impact",
    union_sql(
        [
            f"SELECT '{k}' AS variant, * FROM ({impact_sql('c_nationkey', 'c_acctbal', 'customer', gap, high)})"
            for k, (gap, high) in IMPACTS.items()
        ]
    ),
)
def dim_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    parts = [
        shown(N.dim_impact(customer, "c_acctbal", "c_nationkey", k)).withColumn("variant", F.lit(k)) for k in IMPACTS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SHARE_SQL = """SELECT arg_min(g, {'n': -n, 'g': g}) FILTER (WHERE g IS NOT NULL) AS dominant,
    round(max(n) FILTER (WHERE g IS NOT NULL) * 100.0::DOUBLE / sum(n), 1) AS share_pct, count(g) AS n_segments, 'medium' AS significance
  FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS g, count(*) AS n FROM customer GROUP BY 1)"""


@query("segment_share", SHARE_SQL)
def segment_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return shown(N.segment_share(customer, "c_mktsegment"))


@query(
    "financial_total",
    """SELECT round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 2) AS mean, round(min(l_extendedprice), 2) AS min,
      round(max(l_extendedprice), 2) AS max, 'high' AS significance FROM lineitem""",
)
def financial_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.financial_total(table(spark, sf_dir, "lineitem"), "l_extendedprice"), 2)


@query(
    "contribution_share",
    """SELECT top_group, round(top_sum, 2) AS top_sum, round(total, 2) AS total, top_share,
      CASE WHEN top_share > 40 THEN 'high' ELSE 'medium' END AS significance
    FROM (SELECT arg_max(g, s) FILTER (WHERE g IS NOT NULL) AS top_group, max(s) FILTER (WHERE g IS NOT NULL) AS top_sum, sum(s) AS total,
        round(max(s) FILTER (WHERE g IS NOT NULL) / sum(s) * 100, 1) AS top_share
      FROM (SELECT nullif(o_orderstatus, 'P') AS g, sum(o_totalprice) AS s FROM orders GROUP BY 1))""",
)
def contribution_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    return shown(N.contribution_share(orders, "o_totalprice", "o_orderstatus"), 2)


Z_SQL = """SELECT outlier_count, CASE WHEN outlier_count > 3 THEN 'high' ELSE 'medium' END AS significance
  FROM (SELECT count(*) AS outlier_count FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
    WHERE abs((value - m) / s) > 2.5) WHERE outlier_count > 0"""


@query("z_outlier_count", Z_SQL)
def z_outlier_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(N.z_outlier_count(table(spark, sf_dir, "events"), "value"))


# -- sentences -------------------------------------------------------------------


def _signed(c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN '+' ELSE '' END || CAST({c} AS VARCHAR)"


def _f(c: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', {c})"


WINNER_LIST = f"(SELECT string_agg(g || '=$' || {_f('m')} || 'K', ', ' ORDER BY m DESC, g) FROM {FLAG_MEANS})"
ANSWERS = {
    "winner": f"""SELECT winner || ' generates $' || {_f('winner_val')} || 'K mean l_extendedprice — ' || {_f('gap_pct')} || '% higher than '
        || loser || ' ($' || {_f('loser_val')} || 'K). All values: ' || {WINNER_LIST} || '.' AS answer, significance FROM ({EXP_WINNER_SQL})""",
    "trend": f"""SELECT 'o_totalprice shows a ' || direction || ' trend over ' || n_periods || ' periods (R²=' || CAST(r2 AS VARCHAR)
        || '). Total change: ' || {_signed('total_change_pct')} || '%. Range: $' || {_f('min_val')} || 'K–$' || {_f('max_val')} || 'K.' AS answer,
        significance FROM ({TREND_SQL.format(source=period_sql())})""",
    "best_worst": f"""SELECT 'Best: ' || best_period || ' at $' || {_f('best_val')} || 'K. Worst: ' || worst_period || ' at $' || {_f('worst_val')}
        || 'K. Gap: ' || CAST(gap_pct AS VARCHAR) || '%.' AS answer, significance FROM ({BEST_WORST_SQL})""",
    "spikes": f"""SELECT 'Notable change at ' || notable_period || ': ' || {_signed('change_pct')} || '%. ' || n_notable
        || ' period(s) show changes >25%.' AS answer, significance FROM ({SPIKE_SQL})""",
    "latest": f"""SELECT 'Most recent period (' || last_period || '): $' || {_f('last_val')} || 'K vs previous (' || prev_period || '): $'
        || {_f('prev_val')} || 'K. Change: ' || {_signed('change_pct')} || '%.' AS answer, significance FROM ({LATEST_SQL})""",
    "pareto": f"""SELECT 'Top 10% of records account for ' || CAST(top_share AS VARCHAR) || '% of total value. Average: $' || {_f('top_mean')}
        || ' vs overall $' || {_f('overall_mean')} || '. ' || CASE WHEN top_share > 50 THEN 'High concentration risk.' ELSE 'Reasonably distributed.' END
        AS answer, significance FROM ({PARETO_SQL.format(measure='value', source='events')})""",
    "shape": f"""SELECT 'value distribution is ' || CASE shape WHEN 'right' THEN 'right-skewed (high outliers)' WHEN 'left' THEN 'left-skewed'
        ELSE 'approximately symmetric' END || '. Mean: $' || {_f('mean')} || ', Median: $' || {_f('median')} || ', Range: $' || {_f('min')} || '–$'
        || {_f('max')} || '.' AS answer, significance FROM ({DISTRIBUTION_SQL.format(m='value', source='events')})""",
    "general": f"""SELECT 'value: average $' || {_f('mean', 2)} || ', median $' || {_f('median', 2)} || ', range $' || {_f('min', 2)} || '–$'
        || {_f('max', 2)} || '. Skew: ' || shape || '.' AS answer, significance FROM ({DISTRIBUTION_SQL.format(m='value', source='events')})""",
    "impact": f"""SELECT best || ' leads with $' || {_f('best_val', 2)} || ' average value — ' || {_f('gap_pct')} || '% above the lowest group.' AS answer,
        significance FROM ({impact_sql('event_type', 'value', 'events', PLAIN_GAP, 15)})""",
    "customer": f"""SELECT best || ' segment leads with $' || {_f('best_val')} || ' average c_acctbal — ' || {_f('gap_pct')} || '% above ' || worst || '.'
        AS answer, significance FROM ({impact_sql('c_mktsegment', 'c_acctbal', 'customer', PLAIN_GAP, 20)})""",
    "share": f"""SELECT dominant || ' is the largest segment at ' || CAST(share_pct AS VARCHAR) || '% of customers. Total segments: ' || n_segments || '.'
        AS answer, significance FROM ({SHARE_SQL})""",
    "outliers": f"""SELECT outlier_count || ' record(s) show unusually high or low value values (beyond 2.5 standard deviations from average). '
        || 'These may warrant individual investigation.' AS answer, significance FROM ({Z_SQL})""",
}


@query(
    "finding_answers",
    union_sql([f"SELECT '{k}' AS kind, answer, significance FROM ({sql})" for k, sql in ANSWERS.items()]),
)
def finding_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, orders, events = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "events"))
    customer, months = table(spark, sf_dir, "customer"), _monthly(spark, sf_dir)
    sparse = customer.withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    parts = {
        "winner": wording.winner(li, "l_extendedprice", "l_returnflag"),
        "trend": wording.trend(orders, "o_totalprice", "o_orderdate"),
        "best_worst": wording.best_worst(months, "o_totalprice", "month"),
        "spikes": wording.spikes(orders, "o_totalprice", "o_orderdate"),
        "latest": wording.latest_change(months, "o_totalprice", "month"),
        "pareto": wording.pareto(events, "value", "event_type"),
        "shape": wording.distribution(events, "value", "transactional"),
        "general": wording.distribution(events, "value"),
        "impact": wording.impact(events, "value", "event_type"),
        "customer": wording.impact(customer, "c_acctbal", "c_mktsegment", "customer"),
        "share": wording.share(sparse, "c_mktsegment"),
        "outliers": wording.outliers(events, "value"),
    }
    out = None
    for kind, rows in parts.items():
        one = rows.select(F.lit(kind).alias("kind"), "answer", "significance")
        out = one if out is None else out.unionByName(one)
    return out


EXPERIMENT_ANSWERS = {
    "segment": f"""WITH w AS (SELECT seg, arg_min(var, {{'m': -m, 'v': var}}) AS winner
          FROM {cells_sql("l_linestatus", "l_returnflag", "l_extendedprice", "lineitem")} GROUP BY 1),
        c AS (SELECT count(DISTINCT winner) = 1 AS c, min(winner) AS w, string_agg(seg || ': ' || winner, '; ' ORDER BY seg) AS l FROM w)
      SELECT CASE WHEN c THEN 'Yes — ' || w || ' wins consistently across all l_linestatus segments. (' || l || ')'
        ELSE 'No — the winning l_returnflag differs by l_linestatus. ' || l || '. A segmented strategy outperforms a one-size-fits-all approach.' END
        AS answer, CASE WHEN c THEN 'medium' ELSE 'high' END AS significance FROM c""",
    "stability": f"""WITH w AS (SELECT seg, arg_min(var, {{'m': -m, 'v': var}}) AS winner
          FROM {cells_sql("ship_year", "l_returnflag", "l_extendedprice", PRICED_LINES)} GROUP BY 1),
        c AS (SELECT count(DISTINCT winner) = 1 AS c, count(*) AS n, string_agg(CAST(seg AS VARCHAR) || ': ' || winner, '; ' ORDER BY CAST(seg AS VARCHAR)) AS l FROM w),
        o AS ({EXP_WINNER_SQL})
      SELECT CASE WHEN c THEN 'Yes — ' || winner || ' maintains its lead consistently across all ' || n || ' periods. Period winners: ' || l
        ELSE 'No — ' || winner || ' shows inconsistent performance across periods. Period winners: ' || l END AS answer,
        CASE WHEN c THEN 'low' ELSE 'high' END AS significance FROM c, o""",
    "spread": """WITH s AS (SELECT l_returnflag AS v, stddev_samp(l_extendedprice) AS s, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1),
        a AS (SELECT string_agg(v || '=' || CAST(round(s, 2) AS VARCHAR), ', ' ORDER BY v) AS l, max(s / nullif(m, 0)) > 0.3 AS wide FROM s)
      SELECT CASE WHEN wide THEN 'High variability within groups — std by l_returnflag: ' || l || '. Location/unit factors dominate over l_returnflag choice.'
        ELSE 'Consistent performance within groups — std by l_returnflag: ' || l || '. ' END AS answer,
        CASE WHEN wide THEN 'high' ELSE 'low' END AS significance FROM a""",
    "total": f"""SELECT 'Total l_extendedprice: $' || format('{{:,.1f}}', sum(l_extendedprice)) || '. Average per period: $' || {_f('avg(l_extendedprice)')}
        || '. Range: $' || {_f('min(l_extendedprice)')} || '–$' || {_f('max(l_extendedprice)')} || '.' AS answer, 'high' AS significance FROM lineitem""",
    "contribution": """SELECT arg_max(g, s) || ' accounts for ' || CAST(round(max(s) / sum(s) * 100, 1) AS VARCHAR) || '% of total l_extendedprice ($'
        || format('{:,.1f}', max(s)) || ').' AS answer, CASE WHEN round(max(s) / sum(s) * 100, 1) > 40 THEN 'high' ELSE 'medium' END AS significance
        FROM (SELECT l_returnflag AS g, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1)""",
    "buckets": f"""WITH b AS ({SIZE_BUCKETS}), l AS (SELECT list(mean ORDER BY bucket) AS v, count(*) // 2 AS h,
          string_agg(CASE WHEN bucket = 1 THEN '[' ELSE '(' END || CAST(round(low, 3) AS VARCHAR) || ', ' || CAST(round(high, 3) AS VARCHAR)
            || ']=$' || {_f('round(mean, 2)')} || 'K', '; ' ORDER BY bucket) AS l FROM b),
        p AS (SELECT {PATTERN_CASE} AS p, l FROM l)
      SELECT CASE p WHEN 'u-shaped' THEN 'U Shaped' WHEN 'inverted-u' THEN 'Inverted U' ELSE upper(p[1]) || p[2:] END
        || ' pattern for p_size: ' || l || '.' AS answer, CASE WHEN p = 'flat' THEN 'low' ELSE 'high' END AS significance FROM p""",
}


@query(
    "experiment_answers",
    union_sql([f"SELECT '{k}' AS kind, answer, significance FROM ({sql})" for k, sql in EXPERIMENT_ANSWERS.items()]),
)
def experiment_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, priced = table(spark, sf_dir, "lineitem"), priced_lines(spark, sf_dir)
    m, d = "l_extendedprice", "l_returnflag"
    parts = {
        "segment": wording.segment_winners(li, m, d, "l_linestatus"),
        "stability": wording.period_stability(priced, m, d, "ship_year"),
        "spread": wording.spread(li, m, d),
        "total": wording.total(li, m, "l_shipdate", d),
        "contribution": wording.contribution(li, m, d),
        "buckets": wording.segment_impact(table(spark, sf_dir, "part"), "p_retailprice", "p_size"),
    }
    out = None
    for kind, rows in parts.items():
        one = rows.select(F.lit(kind).alias("kind"), "answer", "significance")
        out = one if out is None else out.unionByName(one)
    return out
