"""Quantiles and ordering against brute force, on data made to be awkward."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.plans import ordering, quantiles
from sightline.plans.shared import settle, shared_root


def table(spark, **columns):
    return spark.createDataFrame(pa.table(columns))


def awkward(kind, n, seed=7):
    rng = np.random.default_rng(seed)
    if kind == "ties":
        return np.where(rng.random(n) < 0.34, 3.0, rng.integers(0, 6, n).astype(float))
    if kind == "tail":
        return np.exp(rng.normal(0, 6, n))
    if kind == "sorted":
        return np.arange(n, dtype=float)
    if kind == "two":
        return np.where(np.arange(n) % 2 == 0, -1.0, 1.0)
    return rng.normal(0, 1, n)


@pytest.mark.parametrize("kind", ["ties", "tail", "sorted", "two", "normal"])
@pytest.mark.parametrize("n", [1, 2, 201, 120_000])
def test_quantiles_equal_numpy(spark, kind, n):
    values = awkward(kind, n)
    rows = table(spark, v=values)
    wanted = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.75, "f": 0.99, "g": 1.0}
    got = quantiles.quantiles(rows, "v", wanted).first()
    for name, p in wanted.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
    assert got["n"] == n
    assert got["mean"] == pytest.approx(values.mean(), rel=1e-9, abs=1e-9)
    if n > 1:
        assert got["std"] == pytest.approx(values.std(ddof=1), rel=1e-9, abs=1e-9)


def test_brackets_are_used_above_the_whole_group_size(spark, monkeypatch):
    """With every group treated as large, brackets alone must find the ranks."""
    monkeypatch.setattr(quantiles, "WHOLE_GROUP_ROWS", 20_000)
    values = awkward("tail", 90_000)
    groups = np.where(np.arange(90_000) % 3 == 0, "hot", "rest")
    rows = table(spark, g=groups, v=values)
    got = {r["g"]: r for r in quantiles.quantiles(rows, "v", {"q": 0.9}, ["g"]).collect()}
    for g in ("hot", "rest"):
        assert got[g]["q"] == pytest.approx(np.quantile(values[groups == g], 0.9), rel=1e-12)


def test_column_summary_handles_nulls_and_empty_columns(spark):
    rows = table(spark, a=pa.array([1.0, None, 3.0, float("nan")]), b=pa.array([None] * 4, pa.float64()))
    cells = {"a": F.when(~F.isnan("a"), F.col("a")), "b": F.col("b")}
    got = {r["column_name"]: r for r in quantiles.column_summary(rows, cells, {"m": 0.5}).collect()}
    assert (got["a"]["n"], got["a"]["m"], got["a"]["mean"]) == (2, 2.0, 2.0)
    assert got["b"]["n"] == 0 and got["b"]["m"] is None


def keyed_rows():
    random.seed(3)
    keys = set()
    for _ in range(400):
        keys.add(random.choice([0, 1, 2**20, 2**41]) + random.randrange(-50, 50) * random.choice([1, 2**19, 2**39]))
    keys = list(keys)
    random.shuffle(keys)
    return keys, [random.randrange(100) for _ in keys]


def test_last_before_and_sums_before_cross_block_borders(spark):
    keys, values = keyed_rows()
    rows = table(spark, k=keys, v=values, at=keys).withColumn("p", F.struct(F.col("at").alias("k"), "v"))
    levels = ordering.key_levels("k")
    out = ordering.sums_before(ordering.last_before(rows, ["p"], levels), ["v"], levels)
    got = {r["k"]: r for r in out.collect()}
    assert len(got) == len(keys)
    before, last = 0, None
    for k, v in sorted(zip(keys, values)):
        row = got[k]
        assert row["v_before"] == before
        assert (None if row["p_before"] is None else tuple(row["p_before"])) == last
        before, last = before + v, (k, v)


def test_last_before_with_many_rows_on_one_key(spark):
    n = 3_000
    key = [5 if i % 3 == 0 else i for i in range(n)]
    tie = [i * 700_001 for i in range(n)]
    rows = table(spark, g=["x" if i % 5 else "y" for i in range(n)], k=key, t=tie)
    rows = rows.withColumns({"at": F.col("t"), "odd": F.when(F.col("t") % 2 == 1, F.col("t"))})
    got = ordering.last_before(rows, ["at", "odd"], ordering.tied_levels("k", "t", ("g",))).collect()
    expected, last, last_odd = {}, {}, {}
    for g, k, t in sorted((r["g"], r["k"], r["t"]) for r in got):
        expected[(g, k, t)] = (last.get(g), last_odd.get(g))
        last[g] = t
        if t % 2 == 1:
            last_odd[g] = t
    assert len(got) == n
    for r in got:
        assert (r["at_before"], r["odd_before"]) == expected[(r["g"], r["k"], r["t"])]


def test_numbered_is_a_dense_order(spark):
    words = [f"w{i:05d}" for i in range(5_000)]
    random.shuffle(words)
    out = ordering.numbered(table(spark, w=words).repartition(7), [F.col("w")]).collect()
    assert [r["w"] for r in sorted(out, key=lambda r: r["row_no"])] == sorted(words)
    assert sorted(r["row_no"] for r in out) == list(range(5_000))


def test_null_keys_come_last(spark):
    rows = table(spark, d=pa.array([3, None, 1], pa.int64()))
    keys = [r[0] for r in rows.select(ordering.order_key(rows, "d")).collect()]
    assert keys == [3, ordering.LAST_KEY, 1]


def test_settle_reports_tables_that_are_too_long(spark):
    small, fits = settle(spark.range(5), 5)
    assert fits and small.count() == 5
    same, fits = settle(spark.range(6), 5)
    assert not fits and same.count() == 6


def test_shared_root_follows_the_session_setting(spark):
    root = shared_root(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
    assert shared_root(spark).rsplit("/", 1)[0] in (root, root.rsplit("/", 1)[0])
