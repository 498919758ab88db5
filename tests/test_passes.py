"""Wide correlations in one scan, and work along an order across many partitions."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.operators import anomalies, correlation, dates
from sightline.plans import moments, sweep


@pytest.fixture
def many_partitions(spark):
    """Small tables keep their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def wide(rng, rows, columns):
    base = rng.normal(size=(rows, 3))
    x = base @ rng.normal(size=(3, columns)) + rng.normal(size=(rows, columns)) * rng.uniform(0.1, 3, columns) + rng.choice([0, 5, 1e7], columns)
    x[rng.random(x.shape) < rng.choice([0, 0.2], columns)] = np.nan
    x[:, 4] = 7.3
    return pd.DataFrame(x, columns=[f"v{i:03d}" for i in range(columns)])


def expected(frame):
    r = frame.corr().to_numpy()
    names = list(frame.columns)
    return {(names[i], names[j]): r[i, j] for i in range(len(names)) for j in range(i + 1, len(names))}


def test_400_columns_in_one_scan(spark, tmp_path):
    frame = wide(np.random.default_rng(1), 1500, 400)
    spark.createDataFrame(pa.Table.from_pandas(frame, preserve_index=False)).repartition(5).write.parquet(str(tmp_path / "w"))
    df = spark.read.parquet(str(tmp_path / "w"))
    spark.sparkContext.setJobGroup("lazy", "no job before the result is asked for")
    found = correlation._pair_correlations(df, [(a, b) for i, a in enumerate(df.columns) for b in df.columns[i + 1 :]])
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")) == []
    spark.sparkContext._jsc.clearJobGroup()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    got = {(r["col_a"], r["col_b"]): r["r"] for r in found.collect()}
    want = expected(frame)
    assert len(got) == 400 * 399 // 2
    for pair, r in want.items():
        if "v004" in pair:
            assert got[pair] is None
        else:
            assert got[pair] == pytest.approx(r, abs=1e-6)


def test_tiles_of_columns(spark, monkeypatch):
    monkeypatch.setattr(moments, "TILE", 8)
    frame = wide(np.random.default_rng(2), 300, 14)
    df = spark.createDataFrame(pa.Table.from_pandas(frame, preserve_index=False)).repartition(3)
    pairs = [(b, a) for i, a in enumerate(df.columns) for b in df.columns[i + 1 :]]
    got = {(r["col_b"], r["col_a"]): r["r"] for r in correlation._pair_correlations(df, pairs).collect()}
    want = expected(frame)
    assert set(got) == set(want) and all(got[p] == pytest.approx(r, abs=1e-6) for p, r in want.items() if "v004" not in p)


def test_wide_correlations_without_rows_or_overlap(spark):
    columns = [f"v{i:02d}" for i in range(13)]
    none = spark.createDataFrame([], ", ".join(f"{c} double" for c in columns))
    assert correlation.top_correlations(none, columns).count() == 0
    rows = [tuple(float(k == i % 13) if k in (i % 13, (i + 1) % 13) else None for k in range(13)) for i in range(60)]
    apart = spark.createDataFrame(rows, none.schema)
    assert correlation.corr_matrix(apart, columns).where("value is not null").count() == 0


def test_gaps_over_partitions(spark, many_partitions):
    rng = np.random.default_rng(3)
    stamps = np.sort(rng.choice(10**9, 5000)) * 10**6
    stamps[2000:3500] = stamps[2000]  # a moment that a third of all rows share
    rng.shuffle(stamps)
    df = spark.createDataFrame(pa.table({"ts": pa.array(stamps, pa.timestamp("us", tz="UTC"))})).repartition(7)
    times = df.groupBy("ts").agg(F.count("*").alias("c")).select(F.unix_micros("ts").alias("t"), "c")
    got = {r["units"]: (r["w"], r["low"], r["high"]) for r in sweep.gap_counts(times, dates.DAY_MICROS).collect()}
    gaps = pd.Series(np.diff(np.sort(stamps)))
    want = gaps.groupby(gaps // dates.DAY_MICROS).agg(["count", "min", "max"])
    assert got == {int(k): tuple(map(int, v)) for k, v in zip(want.index, want.to_numpy())}
    assert dates.granularity(df, "ts").first()["median_days"] == int(np.median(np.diff(np.sort(stamps))) // dates.DAY_MICROS)
    assert dates.granularity(df.limit(0), "ts").count() == 0


def test_granularities_share_one_sweep(spark, many_partitions):
    rng = np.random.default_rng(5)
    stamps = {"hours": rng.permutation(900) * 3600 * 10**6, "weeks": rng.permutation(400) * 7 * dates.DAY_MICROS, "few": np.arange(3) * 10**6}
    frames = {k: spark.createDataFrame(pa.table({f"{k} at": pa.array(np.sort(v), pa.timestamp("us", tz="UTC"))})).repartition(5) for k, v in stamps.items()}
    columns = {k: (df, f"{k} at") for k, df in frames.items()} | {"none": (frames["few"].limit(0), "few at")}
    got = {r["source"]: (r["median_days"], r["granularity"]) for r in dates.granularities(columns).collect()}
    assert got == {"hours": (0, "daily"), "weeks": (7, "weekly")}


def test_trend_over_partitions(spark, many_partitions):
    rng = np.random.default_rng(4)
    n = 3000
    frame = pd.DataFrame({"ts": pd.to_datetime(rng.permutation(n) * 61, unit="s"), "a": rng.normal(5, 2, n), "b": rng.normal(1e6, 3, n)})
    frame.loc[rng.random(n) < 0.3, "a"] = np.nan
    df = spark.createDataFrame(pa.Table.from_pandas(frame, preserve_index=False)).repartition(6)
    got = {r["column_name"]: r for r in dates.row_trend(df, "ts", ["a", "b"]).collect()}
    for name in ("a", "b"):
        y = frame.sort_values("ts")[name].dropna().to_numpy()
        slope, _ = np.polyfit(np.arange(len(y)), y, 1)
        r = np.corrcoef(np.arange(len(y)), y)[0, 1]
        assert got[name]["trend_slope"] == pytest.approx(slope, abs=2e-6) and got[name]["trend_r2"] == pytest.approx(r * r, abs=1e-4)


def test_jumps_over_partitions(spark, many_partitions):
    """Changes across partition ends, over stretches without values and among equal dates."""
    rng = np.random.default_rng(5)
    n = 900
    frame = pd.DataFrame({"day": rng.integers(0, 12, n), "key": rng.permutation(n), "steady": 100 + rng.normal(0, 1, n)})
    frame["wild"] = rng.choice([1.0, 1.2, 3.0, 0.0], n)
    frame["sparse"] = np.nan
    ordered = frame.sort_values(["day", "key"]).index
    frame.loc[ordered[[3, 700, 899]], "sparse"] = [1.0, 5.0, 5.1]
    df = spark.createDataFrame(pa.Table.from_pandas(frame, preserve_index=False)).repartition(5)
    rows = df.select(F.col("day").alias("_t"), F.col("key").alias("row_key"), "steady", "wild", "sparse")
    found = sweep.first_jumps(rows, ["_t", "row_key"], ["steady", "wild", "sparse"], 0.5, 2)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["_t"], r["row_key"])):
        got.setdefault(r["position"], []).append((r["_t"], r["row_key"], r["value"]))
    for i, name in enumerate(["steady", "wild", "sparse"]):
        known = frame.sort_values(["day", "key"]).dropna(subset=[name])
        change = (known[name] / known[name].shift().replace(0, np.nan) - 1).abs() > 0.5
        want = [(int(a), int(b), float(c)) for a, b, c in known[change.to_numpy()][["day", "key", name]].to_numpy()][:2]
        assert got.get(i, [])[:2] == want
    assert len(got[2]) == 1
    dated = df.withColumn("date", F.timestamp_seconds(F.col("day") * 86400))
    flags = anomalies.anom_sudden_change(dated, ["steady", "wild", "sparse"], "date", "key").collect()
    assert {(r["column_name"], r["row_key"]) for r in flags} == {(n, k) for i, n in ((1, "wild"), (2, "sparse")) for _, k, _ in got[i][:2]}


def test_outliers_under_one_key(spark):
    """Rows equal in key and value count one by one: three are far, the next two are outside the fences."""
    rows = [(1, 1e6)] * 7 + [(k, float(k % 5)) for k in range(2, 400)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(3)
    far = anomalies.anom_zscore(df, ["v"], "k")
    fences = anomalies.anom_iqr(df, ["v"], "k")
    assert [(r["row_key"], r["value"]) for r in far.collect()] == [(1, 1e6)] * 3
    assert [(r["row_key"], r["value"]) for r in fences.collect()] == [(1, 1e6)] * 2
