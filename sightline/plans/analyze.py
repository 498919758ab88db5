"""The whole analysis of one table: profile, roles, findings, charts, anomalies, dates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sightline.functions.types import FLOATS, kind, numeric_columns, quoted
from sightline.operators import anomalies, charts, classify, correlation, dates, findings, profile, wording
from sightline.operators.classify import Meta
from sightline.operators.filters import MAX_CHOICES, Filter, apply_filter, filterable_dimensions
from sightline.plans.ordering import numbered
from sightline.plans.rollup import Rollup, rollup
from sightline.plans.shared import reliable, settle
from sightline.sources import cleaning
from sightline.sources.csv import title_row_skip

PARTS_AT_ONCE = 4


@dataclass
class Analysis:
    """Lazy result tables; acting on one runs only what it needs."""

    meta: Meta
    profile: DataFrame
    findings: DataFrame | None
    charts: dict[str, DataFrame] = field(default_factory=dict)
    anomalies: DataFrame | None = None
    date_metrics: DataFrame | None = None
    correlations: DataFrame | None = None
    stats: DataFrame | None = None
    health: DataFrame | None = None
    warnings: DataFrame | None = None
    date_range: DataFrame | None = None
    granularity: DataFrame | None = None
    kpi_columns: DataFrame | None = None
    filterable: DataFrame | None = None
    views: Rollup | None = None

    def tables(self) -> dict[str, DataFrame]:
        named = {
            "profile": self.profile,
            "findings": self.findings,
            "correlations": self.correlations,
            "stats": self.stats,
            "anomalies": self.anomalies,
            "date_metrics": self.date_metrics,
            "health": self.health,
            "warnings": self.warnings,
            "date_range": self.date_range,
            "granularity": self.granularity,
            "kpi_columns": self.kpi_columns,
            "filterable": self.filterable,
            **{f"chart_{k}": v for k, v in self.charts.items()},
        }
        return {k: v for k, v in named.items() if v is not None}

    def each(self, act: Callable[[str, DataFrame], None]) -> None:
        """Act on every table, a few at a time."""
        with ThreadPoolExecutor(PARTS_AT_ONCE) as pool:
            list(pool.map(lambda item: act(*item), self.tables().items()))

    def save(self, root: str, fmt: str = "parquet") -> None:
        """Write every table below a folder."""
        self.each(lambda name, df: df.write.format(fmt).save(f"{root.rstrip('/')}/{name}"))


def ask(df: DataFrame, meta: Meta) -> DataFrame | None:
    """The findings that fit the kind of dataset, or the general ones.

    An experiment needs two variants and a time series two periods.
    """
    m, d, t = meta.primary_measure, meta.primary_dimension, meta.primary_time
    parts: list[DataFrame] = []
    if meta.dataset_type == "experiment" and m and d and meta.distinct[d] > 1:
        parts = [wording.winner(df, m, d)]
        parts += [wording.segment_winners(df, m, d, o) for o in [x for x in meta.dimensions if x != d][:2]]
        if t:
            parts.append(wording.period_stability(df, m, d, t))
        parts.append(wording.spread(df, m, d))
        parts += [wording.unit_gap(df, m, u) for u in meta.identifiers[:1]]
        parts += [wording.segment_impact(df, m, s) for s in meta.segments[:2]]
    elif meta.dataset_type == "timeseries" and m and t and meta.distinct[t] > 1:
        # One scan for all four questions; as many rows as there are periods.
        means = reliable(findings.period_means(df, t, m))
        asked = (wording.trend, wording.best_worst, wording.spikes, wording.latest_change)
        parts = [question(df, m, t, means) for question in asked]
    elif meta.dataset_type == "transactional" and m:
        parts = [wording.pareto(df, m, d), wording.distribution(df, m, "transactional")]
        parts += [wording.impact(df, m, d, "transactional")] if d else []
    elif meta.dataset_type == "customer" and m and d:
        parts = [wording.impact(df, m, d, "customer"), wording.share(df, d)]
    elif meta.dataset_type == "financial" and m:
        parts = [wording.total(df, m, t, d)]
        parts += [wording.contribution(df, m, d)] if d else []
    parts = parts or _general(df, meta)
    return wording.collect(parts) if parts else None


def _general(df: DataFrame, meta: Meta) -> list[DataFrame]:
    numeric = numeric_columns(df)
    m = meta.primary_measure or (numeric[0] if numeric else None)
    if not m:
        return []
    parts = [wording.distribution(df, m)]
    if meta.primary_dimension:
        parts.append(wording.impact(df, m, meta.primary_dimension))
    return [*parts, wording.outliers(df, m)]


def draw(df: DataFrame, meta: Meta) -> dict[str, DataFrame]:
    """Chart datasets that fit the kind of dataset; identifiers are never an axis."""
    m, d, t = meta.primary_measure, meta.primary_dimension, meta.primary_time
    if not m:
        return {}
    out: dict[str, DataFrame] = {}
    if meta.dataset_type == "experiment" and d:
        out["kpi_cards"] = charts.kpi_cards(df, meta.measures, 3)
        out["bar"] = charts.bar_pct_diff(df, m, d)
        others = [c for c in meta.dimensions if c != d]
        if others:
            out["grouped_bar"] = charts.grouped_bar_long(df, m, others[0], d)
        out["box_plot"] = correlation.group_distribution(df, d, m)
        if t:
            out["multi_line"] = charts.multi_line(df, m, t, d)
        if meta.segments:
            out["segment_bar"] = charts.segment_bar(df, meta.segments[0], m)
    elif meta.dataset_type in ("timeseries", "financial") and t:
        out["kpi_cards"] = charts.kpi_cards(df, meta.measures, 2)
        out["line"] = charts.ts_line(df, m, t)
        out["ranked_periods"] = charts.ranked_periods(df, m, t)
        if d:
            out["multi_line"] = charts.multi_line(df, m, t, d)
    elif meta.dataset_type in ("transactional", "customer"):
        out["kpi_cards"] = charts.kpi_cards(df, meta.measures, 2)
        if d:
            out["bar"] = charts.top_categories(df, m, d, 15)
            out["box_plot"] = correlation.group_distribution(df, d, m)
    else:
        out["kpi_cards"] = charts.kpi_cards(df, [m], 1)
        if d:
            out["bar"] = charts.top_categories(df, m, d, 20)
        out["histogram"] = correlation.histogram(df, m)
    return out


def analyze(
    df: DataFrame,
    order_by: str | Sequence[str] | None = None,
    roles: dict[str, str] | None = None,
    view: Filter | None = None,
    approx: bool = False,
    load_warnings: Sequence[str] = (),
    keep_views: bool = False,
) -> Analysis:
    """Analyse a table. ``order_by`` is an integer or datetime key that orders rows.

    Several columns may form the key; rows are then numbered in its order, and the
    number stands for the row in anomalies and trends. Without a key there are no
    outliers, sudden changes and date metrics, which report rows.

    Only the column roles are computed at once; all other tables are lazy except
    for their bounded lookup rows. ``keep_views`` also stores partial sums by the first date column
    and the dimensions offered as filters: ``views`` then answers filters without the rows.
    """
    meta = classify.resolve(df, roles, approx)
    datetimes = [f.name for f in df.schema.fields if kind(f.dataType) == "datetime"]
    if view is not None:
        df = apply_filter(df, view, datetimes[0] if datetimes else None)
    keyed, key = df, order_by
    if order_by is not None and not isinstance(order_by, str):
        key = "_row_no"
        keyed = numbered(df, [quoted(c).asc_nulls_last() for c in order_by], key)
    numeric = [c for c in numeric_columns(df) if meta.semantic[c] == "numeric"]
    date_col = datetimes[0] if datetimes else None

    def statistics() -> tuple[DataFrame | None, DataFrame | None]:
        if not numeric:
            return None, None
        summary = profile.summary_of(df, numeric)
        # The ten shown flags, read by two result tables.
        if key is not None:
            found = anomalies.detect(keyed, numeric, key, date_col, summary)
        else:
            found = anomalies.anom_merge(anomalies.anom_missing(df))
        flags, _ = settle(found, anomalies.SHOWN_ALL)
        return profile.column_stats(df, numeric, summary), flags

    def metrics() -> DataFrame | None:
        if date_col is None or key is None or not numeric:
            return None
        return dates.date_metrics(keyed, date_col, numeric, key)

    # The parts do not depend on each other; their lookup scans may overlap.
    with ThreadPoolExecutor(PARTS_AT_ONCE) as pool:
        stats = pool.submit(statistics)
        dated = pool.submit(metrics)
        asked = pool.submit(ask, df, meta)
        related = pool.submit(correlation.top_correlations, df, numeric) if len(numeric) > 1 else None
        result = Analysis(
            meta=meta,
            profile=meta.profile
            if view is None
            else classify.column_roles(profile.semantic_types(profile.column_profile(df, approx))),
            findings=asked.result(),
            charts=draw(df, meta),
            date_metrics=dated.result(),
            correlations=related.result() if related else None,
        )
        result.stats, result.anomalies = stats.result()
    if result.anomalies is not None:
        result.health = profile.health_score(df, result.anomalies)
    result.warnings = profile.quality_warnings(df, load_warnings)
    result.date_range = profile.date_range(df, date_col)
    result.granularity = dates.granularity(df, date_col) if date_col else None
    result.kpi_columns = profile.kpi_columns(result.profile)
    categorical = [c for c, kind_ in meta.semantic.items() if kind_ == "categorical"]
    result.filterable = filterable_dimensions(df, categorical) if categorical else None
    if keep_views and date_col is not None and numeric:
        # a null counts as one of the values offered
        offered = [c for c in categorical if 1 <= meta.distinct[c] <= MAX_CHOICES and not isinstance(df.schema[c].dataType, FLOATS)]
        result.views = rollup(keyed, date_col, offered, numeric, key)
    return result


def analyze_csv(spark: SparkSession, path: str, order_by: str | Sequence[str] | None = None, **options) -> Analysis:
    """From file to result: read CSV below a title if there is one, clean, analyse.

    ``options`` go to the reader. The cleaned table is written once to shared storage,
    as all parts of the analysis read it.
    """
    notes: list[str] = []
    table = reliable(cleaning.clean(title_row_skip(spark, path, warnings=notes, **options)))
    return analyze(table, order_by, load_warnings=notes)
