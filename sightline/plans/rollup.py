"""Partial sums by date and dimension, stored once, from which filtered views are answered without the rows.

A cell stands for all rows that share a date value and the values of the kept
dimensions. It has their number and, for each measure, count, mean, squares around the
mean and the last value. These merge exactly, so any filter on the date and the kept
dimensions is a selection of cells, and whatever is asked of the view is an aggregate of
them. There are as many cells as different (date value, dimension values): for days and
dimensions of a few values a small part of the rows, for moments to the microsecond as
many as rows, though with few columns.

Cells are written in the order of the date as Parquet, so the date range and the dimensions
of a filter reach the file scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.types import FLOATS, field_type, kind, measure, quoted
from sightline.operators import dates
from sightline.operators.filters import Filter, apply_filter, regenerate_by_counts
from sightline.operators.profile import melt
from sightline.plans.ordering import order_key
from sightline.plans.shared import scratch_path, settle


def rollup(
    df: DataFrame, date_col: str, dimensions: Sequence[str], measures: Sequence[str], order_by: str | None = None, path: str | None = None
) -> Rollup:
    """Cells of ``df``, from one scan, written to ``path`` or to a new folder of shared storage.

    ``order_by`` is an integer or datetime key that decides which of the rows of one date
    is last; without it there is no forecast. Null dates and null dimension values have cells of
    their own. Dimensions are integers, texts, booleans, dates or timestamps: a floating
    number may be written in several ways, and filters compare as text.
    """
    kept = list(dict.fromkeys([date_col, *dimensions]))
    for c in kept[1:]:
        if kind(field_type(df, c)) == "complex" or isinstance(field_type(df, c), FLOATS):
            raise ValueError(f"{c} can't be a dimension: {field_type(df, c).simpleString()}")
    sums = "_sums"
    while sums in {c.lower() for c in kept}:
        sums += "_"
    parts: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, m in enumerate(measures):
        y = measure(df, m)
        parts += [F.count(y).alias(f"c{i}"), F.avg(y).alias(f"m{i}"), (F.var_pop(y) * F.count(y)).alias(f"q{i}")]
        if order_by is not None:
            parts.append(F.max(F.when(y.isNotNull(), F.struct(order_key(df, order_by).alias("key"), y.alias("value")))).alias(f"l{i}"))
    cells = df.groupBy(*[quoted(c).alias(c) for c in kept]).agg(F.struct(*parts).alias(sums))
    order = [quoted(c) for c in kept]
    path = path or scratch_path(df.sparkSession, "rollup")
    cells.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    stored = df.sparkSession.read.schema(cells.schema).parquet(path)
    return Rollup(stored, date_col, tuple(kept[1:]), tuple(measures), sums, tuple(df.columns), order_by is not None)


@dataclass
class Rollup:
    """Answers of filtered views; each equals what the operator of the same name gives for the filtered rows."""

    cells: DataFrame
    date_col: str
    dimensions: tuple[str, ...]
    measures: tuple[str, ...]
    sums: str
    source_columns: tuple[str, ...]
    has_last: bool
    _base: DataFrame | None = field(default=None, repr=False)

    def lacking(self, view: Filter) -> list[str]:
        """Columns of the table that the view filters by and the cells don't have; such a view needs the rows."""
        asked = [c for c, wanted in view.dimensions.items() if wanted is not None and wanted != ""]
        if view.selection and view.selection[0] and view.selection[1] is not None:
            asked.append(view.selection[0])
        return [c for c in asked if c in self.source_columns and c not in self.cells.columns]

    def view(self, view: Filter | None = None) -> DataFrame:
        """The cells of a view."""
        if view is None:
            return self.cells
        if lacking := self.lacking(view):
            raise ValueError(f"the rollup keeps no {', '.join(lacking)}")
        return apply_filter(self.cells, view, self.date_col)

    def _of(self, what: str) -> Column:
        return F.col(f"{self.sums}.{what}")

    def _place(self, measure_name: str) -> int:
        return self.measures.index(measure_name)

    def _total(self, i: int) -> Column:
        return F.sum(self._of(f"c{i}") * self._of(f"m{i}"))

    def _mean(self, i: int) -> Column:
        return F.try_divide(self._total(i), F.sum(self._of(f"c{i}")))

    def _steps(self, cells: DataFrame, last: bool = False) -> DataFrame:
        """Count and sums around the view's mean per distinct timestamp, a row per measure; the means are one driver row."""
        ts = quoted(self.date_col).cast("timestamp")
        dated = cells.where(quoted(self.date_col).isNotNull())
        places = range(len(self.measures))
        wanted = [self._mean(i).alias(f"m{i}") for i in places]
        if last:
            wanted += [F.max(F.when(self._of(f"l{i}").isNotNull(), F.struct(ts, self._of(f"l{i}"))))[f"l{i}"]["value"].alias(f"l{i}") for i in places]
        known = dated.agg(*wanted).first().asDict()
        sums, rows = [], []
        for i in places:
            mean = F.lit(known[f"m{i}"]).cast("double")
            c, off = self._of(f"c{i}"), self._of(f"m{i}") - mean
            sums += [F.sum(c).alias(f"c{i}"), F.sum(c * off).alias(f"y{i}"), F.sum(self._of(f"q{i}") + c * off * off).alias(f"q{i}")]
            rows.append((self.measures[i], mean, F.lit(known.get(f"l{i}")).cast("double"), f"c{i}", f"y{i}", f"q{i}"))
        return dates.spread_steps(dated.groupBy(ts.alias("ts")).agg(*sums), rows)

    def date_metrics(self) -> DataFrame:
        """Metrics of the whole table, one row a measure; computed once."""
        if not self.has_last:
            raise ValueError("date metrics need a rollup with order_by")
        if self._base is None:
            self._base, _ = settle(dates.metrics_of(self._steps(self.cells, last=True)))
        return self._base

    def filtered_metrics(self, view: Filter) -> DataFrame:
        """Metrics of a view over those of the whole table, as ``dates.filtered_metrics``."""
        return dates.refreshed(self.date_metrics(), self._steps(self.view(view)))

    def regenerate_trigger(self, view: Filter) -> DataFrame:
        """Whether the view leaves out enough rows, as ``filters.regenerate_trigger``."""
        counted = F.coalesce(F.sum(self._of("n")), F.lit(0))
        return regenerate_by_counts(
            self.cells.agg(counted.alias("original_rows")), self.view(view).agg(counted.alias("filtered_rows"))
        )

    def kpi_cards(self, view: Filter | None = None, limit: int = 3) -> DataFrame:
        """Mean and sum of the first measures, as ``charts.kpi_cards``."""
        names = self.measures[:limit]
        row = self.view(view).agg(
            *[f(i).alias(f"{k}_{i}") for i in range(len(names)) for k, f in (("mean", self._mean), ("total", self._total))]
        )
        cards = melt(row, names, ["mean", "total"])
        return cards.select("column_name", "mean", F.coalesce("total", F.lit(0.0)).alias("total"))

    def group_means(self, dim: str, measure_name: str, view: Filter | None = None) -> DataFrame:
        """Mean of a measure per value of a dimension, as ``findings.group_means``."""
        d = quoted(dim)
        means = self.view(view).where(d.isNotNull()).groupBy(d.alias("grp")).agg(self._mean(self._place(measure_name)).alias("mean"))
        return means.where("mean is not null")

    def top_categories(self, measure_name: str, dim: str, top: int = 20, view: Filter | None = None) -> DataFrame:
        """The highest means, as ``charts.top_categories``."""
        means = self.group_means(dim, measure_name, view).orderBy(F.desc("mean"), "grp").limit(top)
        return means.select(F.col("grp").cast("string").alias("x"), F.col("mean").alias("y"))
