"""Fixed bounds of what meets in one task, and rows that earlier versions lost."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import anomalies, classify, correlation, filters, profile
from sightline.plans import quantiles, shared
from sightline.plans.analyze import analyze, analyze_csv


@pytest.fixture
def tiny(monkeypatch):
    passes = []
    checkpoint = quantiles.reliable
    monkeypatch.setattr(quantiles, "reliable", lambda df: passes.append(1) or checkpoint(df))
    monkeypatch.setattr(quantiles, "WHOLE_GROUP_ROWS", 50)
    monkeypatch.setattr(quantiles, "MARGIN", 0.2)
    monkeypatch.setattr(quantiles, "CELLS", 20)
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 30)
    return passes


def test_brackets_are_cut_until_they_are_small(spark, tiny):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=6_000), np.full(3_000, 0.25), rng.integers(0, 5, 1_000)])
    groups = rng.integers(0, 3, len(values))
    rows = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, values)], "g int, v double")
    wanted = {"q10": 0.1, "q50": 0.5, "q99": 0.99}
    got = quantiles.quantiles(rows, "v", wanted).first()
    assert len(tiny) >= 6  # at least three passes
    for name, p in wanted.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12)
    for r in quantiles.quantiles(rows, "v", wanted, ["g"]).collect():
        for name, p in wanted.items():
            assert r[name] == pytest.approx(np.quantile(values[groups == r["g"]], p), rel=1e-12)
    cells = {"v": F.col("v"), "none": F.lit(None).cast("double"), "w": F.col("v") * -2}
    got = {r["column_name"]: r for r in quantiles.column_summary(rows, cells, wanted).collect()}
    assert got["w"]["q10"] == pytest.approx(np.quantile(values * -2, 0.1), rel=1e-12) and got["none"]["n"] == 0


def test_narrow_brackets_hold_few_rows(spark, tiny):
    values = np.random.default_rng(1).normal(size=20_000)
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    edges = spark.createDataFrame([(20_000, -9.0, 9.0)], "_n long, _low0 double, _high0 double")
    low, high = quantiles.narrowed(rows, "v", [], edges, [0.5]).select("_low0", "_high0").first()
    assert ((values >= low) & (values <= high)).sum() <= 30 and low <= np.median(values) <= high


def test_rows_that_differ_by_a_microsecond_are_not_duplicates(spark):
    base = dt.datetime(2024, 3, 31, 2, 30, 0, 1)
    near = base + dt.timedelta(microseconds=1)
    for kind in ("timestamp_ntz", "timestamp", "struct<t: timestamp>", "array<timestamp_ntz>", "map<string, timestamp_ntz>"):
        wrap = {"s": lambda x: (x,), "a": lambda x: [x], "m": lambda x: {"k": x}}.get(kind[0], lambda x: x)
        df = spark.createDataFrame([(wrap(base),), (wrap(near),), (wrap(base),), (None,)], f"v {kind}")
        assert profile.duplicate_rows(df).first()[0] == 1


def test_nan_is_one_value_of_a_column(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert classify.cardinalities(df, ["v"]).first()["n_values"] == 3


def test_repeated_keys_lose_no_outliers(spark):
    rows = [(i, 1.0 + i % 3) for i in range(60)] + [(5_000, 1_000.0), (5_000, 9.0)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = anomalies.anom_iqr(df, ["v"], "k").collect()
    assert [(r["row_key"], r["value"]) for r in got] == [(5_000, 9.0)]


def test_filters_on_typed_columns_reach_the_scan(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    for value in (3, "3"):
        some = filters.filter_dimensions(lines, {"l_linenumber": value})
        assert "EqualTo(l_linenumber,3)" in some._jdf.queryExecution().executedPlan().toString()
        assert some.count() == lines.where("l_linenumber = 3").count() > 0
    for value in ("03", "3.0", "x", "", 2**40):
        assert filters.filter_dimensions(lines, {"l_linenumber": value}).count() == (lines.count() if value == "" else 0)
    df = spark.createDataFrame([(dt.date(2024, 1, 2), True), (None, None)], "d date, b boolean")
    assert filters.filter_dimensions(df, {"d": "2024-01-02", "b": True}).count() == 1
    assert filters.filter_dimensions(df, {"d": "2024-1-2"}).count() == filters.filter_dimensions(df, {"b": "yes"}).count() == 0


def test_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError):
        shared.shared_root(Session)


def test_analysis_with_a_key_of_several_columns_or_none(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").limit(2_000)
    with_key = analyze(lines, order_by=["l_orderkey", "l_linenumber"])
    assert with_key.anomalies.count() > 0 and with_key.date_metrics.count() > 0
    sparse = lines.withColumn("l_tax", F.when(F.col("l_linenumber") == 1, F.col("l_tax")))
    without = analyze(sparse)
    assert [r["column_name"] for r in without.anomalies.collect()] == ["l_tax"] and without.health.count() == 1
    assert without.date_metrics is None


def test_from_file_to_analysis(spark, tmp_path):
    lines = "".join(f"2024-01-{1 + i % 28:02d},${10 + i % 7},{'AB'[i % 2]},c{i:03d}\n" for i in range(80))
    (tmp_path / "sales.csv").write_text("sale_date,revenue,region,customer_id\n" + lines + "2024-02-01,$1,A,c1,surplus\n")
    result = analyze_csv(spark, str(tmp_path / "sales.csv"), order_by=["customer_id"])
    named = result.tables()
    assert {"profile", "warnings", "date_range", "granularity", "kpi_columns", "filterable", "health", "anomalies", "date_metrics"} <= set(named)
    assert result.date_range.first()["start_date"] == "2024-01-01"
    assert any("bad line" in str(r) for r in result.warnings.collect())
    assert [r["column_name"] for r in result.kpi_columns.collect()] == ["revenue"]
    assert [r["column_name"] for r in result.filterable.collect()] == ["region"]
    for df in named.values():
        df.collect()


def test_wide_heatmap_is_as_wide_as_asked(spark):
    matrix = spark.createDataFrame([("a", "a", 1.0)], "x string, y string, value double")
    assert len(correlation.heatmap_pivot(matrix, [f"c{i}" for i in range(150)]).columns) == 151
