"""Filtered views answered from stored cells equal those of the rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.operators import charts, dates, filters
from sightline.operators.filters import Filter
from sightline.plans.analyze import analyze
from sightline.plans.rollup import rollup

MEASURES = ["amount", "rate"]
VIEWS = [
    Filter(start="2021-03-02", end="2022-02-10"),
    Filter(dimensions={"region": "north", "paid": True}),
    Filter(end="2021-12-31", selection=("_sums", 2)),
    Filter(dimensions={"region": "nowhere"}),
    Filter(selection=("unknown", "x")),
]


def rows(seed=1, n=4000):
    rng = np.random.default_rng(seed)
    stamps = 1609459200 + rng.integers(0, 600 * 24, n) * 3600
    stamps[: n // 3] = stamps[0]  # a moment that a third of all rows share
    frame = pd.DataFrame(
        {
            "id": np.arange(n),
            "sold at": pd.to_datetime(stamps, unit="s", utc=True),
            "region": rng.choice(["north", "south", None], n),
            "paid": rng.random(n) < 0.5,
            "_sums": rng.integers(0, 4, n),
            "amount": rng.normal(1e6, 5, n),
            "rate": np.where(rng.random(n) < 0.2, np.nan, rng.random(n)),
        }
    )
    frame.loc[rng.random(n) < 0.05, "sold at"] = pd.NaT
    return frame


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(pa.Table.from_pandas(rows(), preserve_index=False)).repartition(5)


def kept(df, order_by="id"):
    return rollup(df, "sold at", ["region", "paid", "_sums"], MEASURES, order_by)


def same(got, want, key):
    assert got.columns == want.columns
    got, want = ({tuple(r[k] for k in key): r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for k, row in want.items():
        for name, v in row.items():
            assert got[k][name] == (pytest.approx(v, rel=1e-9, abs=2e-4) if isinstance(v, float) else v), (k, name)
    return want


def test_views_equal_the_rows(spark, sales):
    cells = kept(sales)
    base = dates.date_metrics(sales, "sold at", MEASURES, "id")
    assert len(same(cells.date_metrics(), base, ["column_name"])) == 2
    for view in VIEWS:
        chosen = filters.apply_filter(sales, view, "sold at")
        same(cells.filtered_metrics(view), dates.filtered_metrics(base, chosen, "sold at", MEASURES), ["column_name"])
        same(cells.regenerate_trigger(view), filters.regenerate_trigger(sales, chosen), [])
        same(cells.kpi_cards(view), charts.kpi_cards(chosen, MEASURES), ["column_name"])
        same(cells.top_categories("rate", "region", 5, view), charts.top_categories(chosen, "rate", "region", 5), ["x"])


def test_second_filter_reads_no_rows(spark, sales):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    n = sales.count()
    cells = kept(sales.mapInArrow(counted, sales.schema))
    # the range partitioning may look at the cells twice, but not at the rows
    assert read.value == n
    for view in VIEWS[:2]:
        cells.filtered_metrics(view).collect()
        cells.regenerate_trigger(view).collect()
        cells.kpi_cards(view).collect()
    assert read.value == n


def test_filters_reach_the_scan(spark, sales):
    cells = kept(sales)
    for view, pushed in ((Filter(start="2021-05-01"), "GreaterThanOrEqual(`sold at`"), (Filter(dimensions={"region": "north"}), "EqualTo(region,north)")):
        plan = cells.view(view)._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    slim = cells.kpi_cards(VIEWS[1], 1)._jdf.queryExecution().executedPlan().toString()
    assert "q0" not in slim.split("ReadSchema")[1].split("\n")[0]


def test_what_the_cells_lack(spark, sales):
    cells = rollup(sales, "sold at", ["region"], MEASURES)
    assert cells.lacking(Filter(dimensions={"paid": True, "region": "north", "id": ""})) == ["paid"]
    with pytest.raises(ValueError, match="paid"):
        cells.kpi_cards(Filter(selection=("paid", True)))
    with pytest.raises(ValueError, match="order_by"):
        cells.date_metrics()
    with pytest.raises(ValueError, match="rate"):
        rollup(sales, "sold at", ["rate"], ["amount"])


def test_empty_table(spark, sales):
    cells = kept(sales.limit(0))
    assert cells.date_metrics().count() == 0 and cells.filtered_metrics(VIEWS[0]).count() == 0
    assert cells.regenerate_trigger(VIEWS[0]).first()["original_rows"] == 0
    assert [r["mean"] for r in cells.kpi_cards().collect()] == [None, None]


def test_days_and_few_dimensions_make_few_cells(spark):
    df = spark.range(20000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("d"), (F.col("id") % 3).alias("k"), F.col("id").alias("v")
    )
    cells = rollup(df, "d", ["k"], ["v"])
    assert cells.cells.count() == 30
    assert cells.kpi_cards().first()["total"] == pytest.approx(20000 * 19999 / 2)


def test_views_of_an_analysis(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    found = analyze(orders, order_by="o_orderkey", keep_views=True)
    view = Filter(start="1995-01-01", dimensions={"o_orderpriority": "1-URGENT"})
    chosen = filters.apply_filter(orders, view, "o_orderdate")
    want = dates.filtered_metrics(found.date_metrics, chosen, "o_orderdate", list(found.views.measures))
    same(found.views.filtered_metrics(view), want, ["column_name"])
