"""Edges that the comparison with SQL on the test tables does not reach."""

import datetime as dt
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.functions.shapes import shape_pattern
from sightline.operators import anomalies, charts, classify, correlation, dates, filters, profile, text, wording
from sightline.operators import findings as N
from sightline.plans.analyze import analyze


def table(spark, **columns):
    return spark.createDataFrame(pa.table(columns))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# -- profile -----------------------------------------------------------------------


def small_sales(spark):
    first = [dt.datetime(2023, 1, 1), "Widget", "North", 100.5, 10, 50.0]
    second = [dt.datetime(2023, 1, 2), "Widget", "North", 200.0, 20, None]
    rows = [first] * 10 + [second] * 9
    names = ["date", "product", "region", "sales_amount", "quantity", "profit"]
    return table(spark, **{n: [r[i] for r in rows] for i, n in enumerate(names)})


def test_small_sales_matches_the_published_log(spark):
    df = small_sales(spark)
    assert one(profile.duplicate_rows(df))["duplicates"] == 17
    nulls = {r["column_name"]: r["null_pct"] for r in profile.null_profile(df).collect()}
    assert nulls == {"date": 0, "product": 0, "region": 0, "sales_amount": 0, "quantity": 0, "profit": 47.4}
    stats = {r["column_name"]: r for r in profile.describe(df).collect()}
    assert (stats["sales_amount"]["mean"], stats["sales_amount"]["std"]) == (147.63, 51.04)
    assert (stats["quantity"]["mean"], stats["quantity"]["std"]) == (14.74, 5.13)
    messages = [r["message"] for r in profile.quality_warnings(df).collect()]
    assert messages == ["Column 'profit' has 47.4% missing values", "Found 17 duplicate rows"]
    typed = profile.semantic_types(profile.column_profile(df))
    assert [r["column_name"] for r in profile.kpi_columns(typed).orderBy("position").collect()] == [
        "sales_amount", "quantity", "profit",
    ]


def test_kpis_of_a_staff_sheet(spark):
    df = table(
        spark,
        employee_id=list(range(15)),
        name=[f"n{i}" for i in range(15)],
        department=["A", "B", "C"] * 5,
        salary=[float(i) for i in range(15)],
        hire_date=[dt.datetime(2020, 1, 1 + i) for i in range(15)],
        performance_score=[float(i) for i in range(15)],
    )
    typed = profile.semantic_types(profile.column_profile(df))
    assert {r["column_name"] for r in profile.kpi_columns(typed).collect()} == {"salary", "performance_score"}
    kinds = {r["column_name"]: r["semantic_type"] for r in typed.collect()}
    assert kinds["employee_id"] == "numeric" and kinds["department"] == "categorical" and kinds["name"] == "text"


def test_nan_is_missing_and_all_null_dates_are_text(spark):
    df = table(
        spark,
        x=pa.array([1.0, float("nan"), None]),
        when=pa.array([None, None, None], pa.timestamp("us")),
        flag=[True, False, True],
    )
    rows = {r["column_name"]: r for r in profile.semantic_types(profile.column_profile(df)).collect()}
    assert (rows["x"]["nulls"], rows["x"]["n_distinct"]) == (2, 1)
    assert rows["when"]["semantic_type"] == "text"
    assert rows["flag"]["semantic_type"] == "categorical"


def test_equal_rows_are_told_from_similar_ones(spark):
    df = table(
        spark,
        a=pa.array([None, "1", "1", "1", "", None]),
        b=pa.array(["1", None, None, "", "1", "1"]),
        t=[dt.datetime(2020, 1, 1, 0, 0, 0, 1)] * 2 + [dt.datetime(2020, 1, 1, 0, 0, 0, m) for m in (1, 1, 1, 2)],
    )
    assert one(profile.duplicate_rows(df))["duplicates"] == 1
    zeros = table(spark, z=[0.0, -0.0, float("nan"), float("nan")])
    assert one(profile.duplicate_rows(zeros))["duplicates"] == 2


def test_empty_table(spark):
    df = table(spark, a=pa.array([], pa.float64()), s=pa.array([], pa.string()))
    assert {r["null_pct"] for r in profile.null_profile(df).collect()} == {0.0}
    assert one(profile.duplicate_rows(df))["duplicates"] == 0
    assert one(profile.date_range(df, None))["date_range"] == "No date column"
    assert one(filters.regenerate_trigger(df, df))["regenerate"] is False


# -- classification ---------------------------------------------------------------------


def promotion(spark):
    rng = np.random.default_rng(42)
    size = rng.choice(["Small", "Medium", "Large"], 137, p=[0.3, 0.5, 0.2])
    age = rng.integers(1, 29, 137)
    promo = rng.integers(1, 4, 137)
    base = {1: 58.1, 2: 47.3, 3: 55.0}
    large = {1: 63.0, 2: 52.0, 3: 77.2}
    out = {k: [] for k in ("LocationID", "MarketID", "MarketSize", "AgeOfStore", "Promotion", "week", "SalesInThousands")}
    for week in (1, 2, 3, 4):
        for i in range(137):
            mean = (large if size[i] == "Large" else base)[int(promo[i])]
            factor = 59 if age[i] <= 3 else 50 if age[i] <= 15 else 57
            sales = max(0.0, rng.normal((mean + factor) / 2 * 1.05, 8))
            for k, v in zip(out, (i + 1, i % 10 + 1, size[i], int(age[i]), int(promo[i]), week, round(float(sales), 2))):
                out[k].append(v)
    return table(spark, **out)


def test_promotion_experiment_end_to_end(spark):
    df = promotion(spark)
    result = analyze(df, order_by="LocationID")
    meta = result.meta
    assert meta.dataset_type == "experiment" and meta.confidence > 0.3
    assert set(meta.identifiers) == {"LocationID", "MarketID"}
    assert (meta.primary_dimension, meta.primary_measure, meta.primary_time) == ("Promotion", "SalesInThousands", "week")
    assert meta.segments == ["AgeOfStore"] and meta.dimensions == ["MarketSize", "Promotion"]
    found = result.findings.collect()
    assert len(found) == 6
    order = {"high": 0, "medium": 1, "low": 2}
    assert [order[r["significance"]] for r in found] == sorted(order[r["significance"]] for r in found)
    for r in found:
        json.loads(r["data_json"])
        config = json.loads(r["chart_config_json"])
        assert not {config.get("x"), config.get("y"), config.get("group")} & set(meta.identifiers)
    winners = {r["segment"]: r["winner"] for r in N.exp_segment_winners(df, "SalesInThousands", "Promotion", "MarketSize").collect()}
    assert winners["Large"] == "3"
    assert len(result.charts) <= 6
    assert set(result.charts) == {"kpi_cards", "bar", "grouped_bar", "box_plot", "multi_line", "segment_bar"}
    for name, chart in result.charts.items():
        assert chart.count() > 0 or name == "grouped_bar"
    health = one(result.health)
    assert 0 <= health["health_score"] <= 100


def test_expected_types_of_the_given_tables(spark, sf):
    def read(name):
        return spark.read.parquet(f"{sf}/{name}.parquet")

    orders = classify.resolve(read("orders"))
    assert (orders.dataset_type, orders.confidence) == ("timeseries", 0.667)
    assert orders.primary_measure == "o_totalprice" and orders.primary_time == "o_orderdate"
    customer = classify.resolve(read("customer"))
    assert customer.dataset_type == "customer"
    assert classify.resolve(read("events")).dataset_type == "general"


def test_single_variant_and_single_period_fall_back_to_general_questions(spark):
    one_variant = table(spark, promotion=["a"] * 6, sales=[1.5, 2.5, 3.5, 4.5, 5.5, 6.5])
    asked = {r["analyzer"] for r in analyze(one_variant).findings.collect()}
    assert asked == {"general"}
    one_period = table(spark, day=[dt.datetime(2024, 1, 1)] * 5, load=[1.5, 2.5, 2.0, 9.0, 1.0])
    result = analyze(one_period)
    assert result.meta.dataset_type == "timeseries"
    assert {r["analyzer"] for r in result.findings.collect()} == {"general"}


def test_results_are_saved_side_by_side(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    view = filters.Filter(dimensions={"o_orderstatus": "F"})
    result = analyze(orders, order_by="o_orderkey", view=view, approx=True)
    result.save(str(tmp_path / "out"))
    for name in result.tables():
        assert (tmp_path / "out" / name / "_SUCCESS").exists()
    rows = {r["n_rows"] for r in spark.read.parquet(str(tmp_path / "out" / "profile")).collect()}
    assert rows == {orders.where("o_orderstatus = 'F'").count()}


def test_roles_can_be_overridden(spark):
    df = promotion(spark)
    meta = classify.resolve(df, roles={"MarketID": "dimension", "week": "measure"})
    assert "MarketID" in meta.dimensions and meta.times == []


# -- statistics ---------------------------------------------------------------------------


def test_constant_columns_have_no_correlation_skew_or_fences(spark):
    df = table(spark, a=[1.0, 2.0, 3.0, 4.0], c=[5.1] * 4, d=pa.array([0.1, None, 0.1, 0.1]), k=[1, 2, 3, 4])
    assert correlation.top_correlations(df, ["a", "c", "d"]).collect() == []
    assert one(correlation.skew_shape(df, "c"))["shape"] == "symmetric"
    assert correlation.scatter_best_pair(df, ["a", "c"]).collect() == []
    assert anomalies.anom_iqr(df, ["c"], "k").collect() == []
    assert anomalies.anom_zscore(df, ["c"], "k").collect() == []
    bins = correlation.histogram(df, "c").collect()
    assert len(bins) == 20 and sum(r["y"] for r in bins) == 4


def test_pairwise_complete_correlation_equals_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(1e6, 1, 500)
    b = a + rng.normal(0, 0.5, 500)
    gaps = [None if i % 3 == 0 else float(v) for i, v in enumerate(b)]
    df = table(spark, a=a, b=gaps)
    keep = np.array([g is not None for g in gaps])
    expected = np.corrcoef(a[keep], b[keep])[0, 1]
    assert one(correlation.top_correlations(df, ["b", "a"]))["r"] == pytest.approx(expected, abs=1e-4)


def test_histogram_agrees_with_numpy_on_edges(spark):
    values = [i / 10 for i in range(101)]
    counts, edges = np.histogram(values, bins=20)
    got = correlation.histogram(table(spark, v=values), "v").orderBy("bin").collect()
    assert [r["y"] for r in got] == counts.tolist()
    assert [r["x"] for r in got] == pytest.approx(((edges[:-1] + edges[1:]) / 2).tolist())


@pytest.mark.parametrize(
    "values, expected",
    [
        ([], "flat"), ([1.0, 2.0], "flat"), ([1.0, 2.0, 3.0], "increasing"), ([3.0, 2.0, 1.0], "decreasing"),
        ([3.0, 1.0, 4.0], "u-shaped"), ([1.0, 9.0, 2.0], "inverted-u"), ([1.0, 1.0, 1.0], "flat"),
        ([5.0, 6.0, 1.0, 6.0], "u-shaped"),
    ],
)
def test_shape_pattern(spark, values, expected):
    df = table(spark, v=pa.array([values], pa.list_(pa.float64())))
    assert one(df.select(shape_pattern(F.col("v")).alias("p")))["p"] == expected


# -- findings -----------------------------------------------------------------------------


def test_ties_one_group_and_zero_denominators(spark):
    df = table(spark, g=["b", "a", "c", None], m=[2.0, 2.0, 0.0, 99.0], one=["x"] * 4)
    row = one(N.exp_winner(df, "m", "g"))
    assert (row["winner"], row["loser"], row["gap_pct"], row["significance"]) == ("a", "c", 0.0, "low")
    assert N.exp_winner(df, "m", "one").collect() == []
    impact = one(N.dim_impact(df, "m", "g", "customer"))
    assert (impact["best"], impact["gap_pct"]) == ("a", 0.0)
    share = one(N.segment_share(df, "g"))
    assert (share["dominant"], share["share_pct"], share["n_segments"]) == ("a", 25.0, 3)
    assert N.z_outlier_count(df.where("m = 2"), "m").collect() == []


def test_series_edges(spark):
    days = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    flat = table(spark, t=days, m=[0.0, 5.0, 5.0, 0.0])
    trend = one(N.ts_trend(flat, "m", "t"))
    assert trend["total_change_pct"] is None and trend["significance"] == "medium"
    spike = one(N.ts_spikes(flat, "m", "t"))
    assert (spike["n_notable"], spike["change_pct"]) == (1, -100.0)
    constant = table(spark, t=days, m=[3.0] * 4)
    row = one(N.ts_trend(constant, "m", "t"))
    assert (row["slope"], row["r2"], row["direction"]) == (0.0, 0.0, "downward")
    assert N.ts_spikes(constant, "m", "t").collect() == []
    assert N.ts_trend(constant.limit(1), "m", "t").collect() == []
    latest = one(N.ts_latest_change(table(spark, t=[1, 2], m=[0.0, 4.0]), "m", "t"))
    assert latest["change_pct"] == 0.0


def test_pareto_counts_part_of_a_tie(spark):
    values = [10.0] * 5 + [1.0] * 25
    row = one(N.pareto_top10(table(spark, v=values), "v"))
    assert row["top_mean"] == 10.0
    assert row["top_share"] == round(30 / 75 * 100, 1)
    assert one(N.pareto_top10(table(spark, v=[4.0]), "v"))["top_share"] == 100.0


def test_unit_gap_counts_units_without_value(spark):
    units = [f"u{i:02d}" for i in range(20)] + ["empty"]
    values = pa.array([float(i + 1) for i in range(20)] + [None])
    row = one(N.exp_unit_gap(table(spark, u=units, v=values), "v", "u"))
    assert row["n_units"] == 21
    assert (row["top_mean"], row["bottom_mean"]) == (19.0, 2.0)
    assert row["top_ids"] == "u19,u18,u17"


def test_buckets_of_coinciding_quartiles(spark):
    df = table(spark, s=[1, 1, 1, 1, 2, 9], m=[1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    got = [(r["bucket"], r["low"], r["high"], r["mean"]) for r in N.segment_buckets(df, "s", "m").orderBy("bucket").collect()]
    assert got == [(1, 1.0, 1.75, 2.5), (2, 1.75, 9.0, 5.5)]
    same = N.segment_buckets(table(spark, s=[4, 4], m=[1.0, 3.0]), "s", "m").collect()
    assert [(r["bucket"], r["mean"]) for r in same] == [(1, 2.0)]


def test_long_group_lists_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(wording, "LISTED", 3)
    df = table(spark, g=[f"g{i}" for i in range(9)], m=[float(i) for i in range(9)])
    answer = one(wording.winner(df, "m", "g"))["answer"]
    assert "g8" in answer and "g6" in answer and "g5" not in answer and ", and 6 more" in answer


# -- anomalies and dates ------------------------------------------------------------------


def test_anomalies_first_rows_and_order(spark):
    values = [1.0, 2.0] * 30
    for i in (3, 10, 20, 40, 50):
        values[i] = 500.0
    df = table(spark, k=list(range(60)), x=values, gone=pa.array([None] * 40 + [1.0] * 20))
    far = anomalies.anom_zscore(df, ["x"], "k").collect()
    assert [r["row_key"] for r in sorted(far, key=lambda r: r["row_key"])] == [3, 10, 20]
    near = anomalies.anom_iqr(df, ["x"], "k").collect()
    assert sorted(r["row_key"] for r in near) == [40, 50]
    merged = anomalies.detect(df, ["x"], "k").collect()
    assert [r["severity"] for r in merged] == ["high"] * 4 + ["medium"] * 2
    assert merged[0]["explanation"] == "Detected outlier_high in x with value 500.0."
    assert merged[3]["value_text"] == "66.7% missing"


def test_few_values_are_not_judged(spark):
    df = table(spark, k=list(range(9)), x=[1.0] * 8 + [1e9])
    assert anomalies.anom_zscore(df, ["x"], "k").collect() == []


def test_sudden_change_skips_gaps_and_zero_bases(spark):
    day = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 4, 5)] + [None]
    df = spark.createDataFrame(
        pa.table({
            "k": [6, 5, 4, 3, 2, 1], "d": pa.array(day, pa.timestamp("us")), "x": pa.array([10.0, None, 16.0, 0.0, 7.0, 1.0]),
        })
    )
    got = sorted((r["row_key"], r["value"]) for r in anomalies.anom_sudden_change(df, ["x"], "d", "k").collect())
    assert got == [(3, 0.0), (4, 16.0)]


def test_dates_need_four_rows(spark):
    days = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    df = table(spark, d=days, x=[1.0, 2.0, 3.0], k=[1, 2, 3])
    assert dates.date_metrics(df, "d", ["x"], "k").collect() == []
    assert dates.granularity(df, "d").collect() == []


def test_trend_equals_numpy_without_ties(spark):
    rng = np.random.default_rng(5)
    start = dt.datetime(2023, 1, 1)
    values = rng.normal(50_000, 12_000, 200)
    df = table(spark, d=[start + dt.timedelta(days=i) for i in range(200)], x=values, k=list(range(200)))
    row = one(dates.date_metrics(df, "d", ["x"], "k"))
    slope, intercept = np.polyfit(np.arange(200), values, 1)
    assert row["trend_slope"] == pytest.approx(slope, abs=1e-5)
    assert row["trend_r2"] == pytest.approx(np.corrcoef(np.arange(200), values)[0, 1] ** 2, abs=1e-4)
    assert row["forecast_next"] == pytest.approx(values[-1] + slope, abs=1e-3)
    assert row["yoy_pct"] is None and row["mom_pct"] is not None
    assert one(dates.granularity(df, "d"))["granularity"] == "daily"


def test_median_gap_between_two_day_counts(spark):
    days = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 13), dt.datetime(2024, 1, 23)]
    row = one(dates.granularity(table(spark, d=days), "d"))
    assert (row["median_days"], row["granularity"]) == (5, "weekly")


def test_constant_measure_has_a_flat_trend(spark):
    days = [dt.datetime(2024, m, 1) for m in (1, 2, 3, 4, 5)]
    row = one(dates.date_metrics(table(spark, d=days, x=[0.0] * 5, k=[1, 2, 3, 4, 5]), "d", ["x"], "k"))
    assert (row["trend_slope"], row["trend_r2"], row["trend_direction"], row["mom_pct"]) == (0.0, 0.0, "flat", None)
    assert (row["best_period"], row["worst_period"]) == ("2024-01", "2024-01")


# -- filters and charts ---------------------------------------------------------------------


@pytest.mark.parametrize("before, after, expected", [(60_000, 54_000, True), (1_000, 950, False), (100, 80, True), (0, 0, False)])
def test_regeneration_thresholds(spark, before, after, expected):
    assert one(filters.regenerate_trigger(spark.range(before), spark.range(after)))["regenerate"] is expected


def test_filters_keep_the_whole_last_day_and_compare_as_text(spark):
    stamps = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2, 23, 59, 59, 999_999), dt.datetime(2024, 1, 3)]
    df = table(spark, d=stamps, n=[1, 2, 3], b=[True, False, True])
    assert filters.filter_date_range(df, "d", "2024-01-01", "2024-01-02").count() == 2
    assert filters.filter_dimensions(df, {"n": "2"}).count() == 1
    assert filters.filter_dimensions(df, {"b": True}).count() == 2
    view = filters.Filter(start="2024-01-02", selection=("n", 3))
    assert filters.apply_filter(df, view, "d").count() == 1


def test_date_filter_reaches_the_scan(spark, sf):
    df = filters.filter_date_range(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderdate", "1997-01-01", "1997-12-31")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan


def test_charts_without_candidates_are_empty(spark):
    df = table(spark, c=["x"] * 3, v=[1.0, 1.0, 1.0])
    assert charts.rec_bar(df, "v", ["c"]).collect() == []
    assert charts.rec_pie(df, ["c"]).collect() == []
    assert charts.rec_histogram(df, ["v"]).collect() == []
    assert len(charts.grouped_bar(df, "v", "c", "c", list(range(101)), always=True).columns) == 102


def test_grouped_bar_only_when_winners_differ(spark):
    same = table(spark, s=["p", "p", "q", "q"], v=["a", "b", "a", "b"], m=[2.0, 1.0, 2.0, 1.0])
    assert charts.grouped_bar(same, "m", "s", "v", ["a", "b"]).collect() == []
    differ = table(spark, s=["p", "p", "q", "q"], v=["a", "b", "a", "b"], m=[2.0, 1.0, 1.0, 2.0])
    assert len(charts.grouped_bar(differ, "m", "s", "v", ["a", "b"]).collect()) == 2


# -- text -----------------------------------------------------------------------------------


def test_bad_replies_fall_back(spark):
    replies = table(
        spark,
        run_id=["good", "broken", "object", "none"],
        reply=['```json\n[{"headline": "H", "magnitude": "huge"}]\n```', "[{", '{"headline": "x"}', ""],
    )
    findings = table(
        spark,
        run_id=["good", "broken", "object"],
        position=[0, 0, 0],
        question=["Q"] * 3,
        answer=["The mean rose. A lot."] * 3,
        significance=["high"] * 3,
        metric=["7"] * 3,
    )
    insights = text.validate_insights(replies, "reply", findings)
    row = one(insights)
    assert (row["run_id"], row["headline"], row["magnitude"], row["context"]) == ("good", "H", "medium", "The average rose. A lot.")
    runs = table(spark, run_id=["good", "broken", "object", "none"], description=["D"] * 4)
    got = {r["run_id"]: r["summary"] for r in text.run_summaries(runs, insights, findings).collect()}
    assert got["good"] == "D. H. The average rose."
    assert got["broken"] == "D. The mean rose. A lot.. This finding addresses: Q."
    assert got["none"].startswith("D. No significant patterns")


def test_plain_language_keeps_parts_of_words(spark):
    df = table(spark, t=["Meaning, the mean z-score; STD outliers outlier"])
    assert one(text.plain_language(df, "t"))["t"] == (
        "Meaning, the average statistical flag; variation outliers unusually high or low value"
    )
