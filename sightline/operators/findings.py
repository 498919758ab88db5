"""Answers to fixed business questions, each one or a few rows of numbers.

Every function reads only the columns it needs, aggregates them before any
shuffle, and works on the small result from there. ``significance`` follows the
thresholds named in each function. The sentences are in ``wording``.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.shapes import shape_pattern
from sightline.functions.types import change_pct, measure, percent, quoted
from sightline.operators.correlation import adjusted_skewness, skew_label
from sightline.plans.ordering import (
    key_levels,
    last_before,
    numbered,
    order_key,
    orderable,
    sums_before,
)
from sightline.plans.quantiles import Rank, order_statistics, quantiles
from sightline.plans.shared import beside, join_small, reliable, settle

def level(high: Column, medium: Column | None = None, otherwise: str = "medium") -> Column:
    out = F.when(high, "high")
    if medium is not None:
        out = out.when(medium, "medium")
    return out.otherwise(otherwise)


# -- means by group --------------------------------------------------------


def group_means(df: DataFrame, dim: str, measure_name: str) -> DataFrame:
    """Mean of a measure per non-null group; the key keeps its type."""
    d = quoted(dim)
    return (
        df.where(d.isNotNull())
        .groupBy(d.alias("grp"))
        .agg(F.avg(measure(df, measure_name)).alias("mean"))
        .where("mean is not null")
    )


def _ends(means: DataFrame) -> DataFrame:
    """Best and worst group of a mean table; ties go to the smaller key."""
    order = F.struct(-F.col("mean"), F.col("grp"))
    return means.agg(
        F.min_by("grp", order).cast("string").alias("winner"),
        F.max("mean").alias("winner_val"),
        F.max_by("grp", order).cast("string").alias("loser"),
        F.min("mean").alias("loser_val"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def _rounded_gap(high: str, low: str) -> Column:
    return F.round(change_pct(F.col(high), F.col(low)), 1)


def exp_winner(df: DataFrame, measure_name: str, variant: str) -> DataFrame:
    """Best and worst variant and the gap between them (high > 10 %, medium >= 5 %)."""
    ends = _ends(group_means(df, variant, measure_name)).where("n_groups >= 2")
    gap = F.coalesce(_rounded_gap("winner_val", "loser_val"), F.lit(0.0))
    return ends.withColumn("gap_pct", gap).withColumn(
        "significance", level(F.col("gap_pct") > 10, F.col("gap_pct") >= 5, "low")
    )


def cell_means(df: DataFrame, rows: str, variant: str, measure_name: str) -> DataFrame:
    """Mean per (row key, variant) over rows where all three are present."""
    r, v, m = quoted(rows), quoted(variant), measure(df, measure_name)
    present = df.select(r.alias("seg"), v.alias("var"), m.alias("_m")).na.drop()
    return present.groupBy("seg", "var").agg(F.avg("_m").alias("mean"))


def _winner_per(cells: DataFrame) -> DataFrame:
    best = F.struct(-F.col("mean"), F.col("var"))
    return cells.groupBy("seg").agg(
        F.min_by("var", best).cast("string").alias("winner"), F.max("mean").alias("winner_mean")
    )


def exp_segment_winners(df: DataFrame, measure_name: str, variant: str, segment: str) -> DataFrame:
    """Winning variant per segment and whether all segments agree (no: high)."""
    winners = _winner_per(cell_means(df, segment, variant, measure_name))
    agreed = winners.agg((F.count_distinct("winner") == 1).alias("consistent"))
    return beside(winners, agreed).select(
        F.col("seg").cast("string").alias("segment"),
        "winner",
        "winner_mean",
        "consistent",
        F.when(F.col("consistent"), "medium").otherwise("high").alias("significance"),
    )


def exp_period_stability(df: DataFrame, measure_name: str, variant: str, period: str) -> DataFrame:
    """Mean per period and variant, the period's winner, and whether it never changes."""
    cells = cell_means(df, period, variant, measure_name)
    winners = _winner_per(cells).select("seg", "winner")
    stable = winners.agg((F.count_distinct("winner") == 1).alias("stable"))
    # Joined by shuffle unless the number of periods is small.
    return beside(join_small(cells, winners, ["seg"]), stable).select(
        F.col("seg").cast("string").alias("period"),
        F.col("var").cast("string").alias("variant"),
        "mean",
        "winner",
        "stable",
        F.when(F.col("stable"), "low").otherwise("high").alias("significance"),
    )


def exp_spread(df: DataFrame, measure_name: str, variant: str) -> DataFrame:
    """Sample deviation and coefficient of variation per variant (any > 0.3: high)."""
    d, m = quoted(variant), measure(df, measure_name)
    spread = (
        df.where(d.isNotNull())
        .groupBy(d.cast("string").alias("variant"))
        .agg(F.stddev_samp(m).alias("std"), F.avg(m).alias("mean"))
        .withColumn("cv", F.try_divide("std", "mean"))
    )
    wide = spread.agg(F.coalesce(F.max("cv") > 0.3, F.lit(False)).alias("_wide"))
    return beside(spread, wide).select(
        "variant", "std", "mean", "cv", F.when(F.col("_wide"), "high").otherwise("low").alias("significance")
    )


def _tail_mean(threshold: str, size: Column, keep: Column) -> Column:
    """Mean of the ``size`` rows on one side of a threshold, exact under ties."""
    v, t = F.col("_v"), F.col(threshold)
    beyond = F.sum(F.when(keep, v))
    n_beyond = F.count_if(keep)
    return (F.coalesce(beyond, F.lit(0.0)) + (size - n_beyond) * F.first(t)) / size


def exp_unit_gap(df: DataFrame, measure_name: str, unit: str) -> DataFrame:
    """Mean of the top and bottom tenth of units (floor(n/10)+1 each), gap > 50 %: high.

    Units may be as many as rows, so the tenth is found by its threshold value
    rather than by numbering all units.
    """
    u, m = quoted(unit), measure(df, measure_name)
    # Written once, read three times.
    means = reliable(df.where(u.isNotNull()).groupBy(u.alias("_u")).agg(F.avg(m).alias("_v")))
    sizes = means.agg(F.count(F.lit(1)).alias("units"), F.count("_v").alias("valued")).first()
    units, valued = sizes["units"], sizes["valued"]
    cut = min(int(units * 0.1) + 1, valued)
    bounds = order_statistics(
        means,
        "_v",
        [
            Rank("_top", 1.0 - cut / max(valued, 1), lambda n: n - cut + 1),
            Rank("_bottom", cut / max(valued, 1), lambda n: F.lit(cut)),
        ],
    ).select("_top", "_bottom")
    tails = beside(means, settle(bounds)[0]).agg(
        F.count(F.lit(1)).alias("n_units"),
        _tail_mean("_top", F.lit(cut), F.col("_v") > F.col("_top")).alias("top_mean"),
        _tail_mean("_bottom", F.lit(cut), F.col("_v") < F.col("_bottom")).alias("bottom_mean"),
    )
    five = means.where("_v is not null").orderBy(F.desc("_v"), "_u").limit(min(5, cut))
    listed = five.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("_v")).alias("k"), F.col("_u").alias("u")))),
                lambda s: s["u"].cast("string"),
            ),
            ",",
        ).alias("_ids"),
    )
    gap = F.when(F.col("bottom_mean") > 0, _rounded_gap("top_mean", "bottom_mean")).otherwise(F.lit(0.0))
    return beside(tails, listed).select(
        "n_units",
        "top_mean",
        "bottom_mean",
        gap.alias("gap_pct"),
        F.col("_ids").alias("top_ids"),
        level(gap > 50).alias("significance"),
    )


# -- quantile buckets ------------------------------------------------------


def segment_buckets(df: DataFrame, segment: str, measure_name: str) -> DataFrame:
    """Mean of a measure per quarter of a numeric segment.

    Edges are exact quartiles; equal edges merge; buckets are closed on the right
    and the first one also on the left.
    """
    rows = df.select(measure(df, segment).alias("_s"), measure(df, measure_name).alias("_m"))
    rows = rows.where("_s is not null")
    cuts = quantiles(rows, "_s", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}).first()
    # At most five driver scalars, so that placing a row is plain compiled comparison.
    edges = sorted({cuts[c] for c in ("min", "_q1", "_q2", "_q3", "max") if cuts[c] is not None}) or [0.0]
    above = F.lit(0)
    for e in edges:
        above = above + (F.col("_s") > F.lit(e)).cast("int")
    means = (
        rows.groupBy(F.greatest(above, F.lit(1)).alias("bucket"))
        .agg(F.avg("_m").alias("mean"), F.count(F.lit(1)).alias("n_rows"))
        .where("mean is not null")
    )
    listed = F.array(*[F.lit(e) for e in edges])
    return means.select(
        F.col("bucket").cast("long").alias("bucket"),
        F.element_at(listed, F.col("bucket")).alias("low"),
        F.element_at(listed, F.least(F.col("bucket") + 1, F.lit(len(edges)))).alias("high"),
        "n_rows",
        "mean",
    )


def pattern_of(buckets: DataFrame) -> DataFrame:
    """Shape of the bucket means in bucket order (not flat: high).

    There are at most four buckets.
    """
    means = F.transform(
        F.array_sort(F.collect_list(F.struct("bucket", "mean"))), lambda s: s["mean"]
    )
    return buckets.agg(means.alias("_means")).select(
        shape_pattern(F.col("_means")).alias("pattern"),
        level(shape_pattern(F.col("_means")) != "flat", None, "low").alias("significance"),
    )


# -- time series -----------------------------------------------------------


def period_means(df: DataFrame, time: str, measure_name: str) -> DataFrame:
    """Mean per distinct period with an integer key ``_t`` in time order."""
    t = quoted(time)
    present = df.select(t.alias("period"), measure(df, measure_name).alias("_m")).na.drop()
    means = present.groupBy("period").agg(F.avg("_m").alias("mean"))
    if orderable(df, time):
        return means.withColumn("_t", order_key(means, "period"))
    return numbered(means, [F.col("period")], "_t")


def given(means: DataFrame | None, df: DataFrame, time: str, measure_name: str) -> DataFrame:
    """Period means computed before, for several questions, or computed now."""
    return means if means is not None else period_means(df, time, measure_name)


def ts_trend(
    df: DataFrame, measure_name: str, time: str, means: DataFrame | None = None
) -> DataFrame:
    """Least-squares line over the period index and total change (> 15 %: high)."""
    means = given(means, df, time, measure_name).withColumn("_one", F.lit(1).cast("long"))
    indexed = sums_before(means, ["_one"], key_levels("_t")).select(
        F.col("_one_before").cast("double").alias("_i"), "mean", "_t"
    )
    fit = indexed.agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.regr_slope("mean", "_i").alias("slope"),
        F.when(F.var_pop("mean") > 0, F.regr_r2("mean", "_i")).otherwise(F.lit(0.0)).alias("r2"),
        F.min_by("mean", "_t").alias("first_val"),
        F.max_by("mean", "_t").alias("last_val"),
        F.min("mean").alias("min_val"),
        F.max("mean").alias("max_val"),
    ).where("n_periods >= 2")
    change = _rounded_gap("last_val", "first_val")
    return fit.select(
        F.when(F.col("slope") > 0, "upward").otherwise("downward").alias("direction"),
        "slope",
        F.round("r2", 3).alias("r2"),
        change.alias("total_change_pct"),
        "n_periods",
        "first_val",
        "last_val",
        "min_val",
        "max_val",
        level(F.coalesce(F.abs(change) > 15, F.lit(False))).alias("significance"),
    )


def ts_best_worst(
    df: DataFrame, measure_name: str, time: str, means: DataFrame | None = None
) -> DataFrame:
    """Best and worst period, the earlier one among equals."""
    means = given(means, df, time, measure_name)
    return means.agg(
        F.min_by("period", F.struct(-F.col("mean"), F.col("_t"))).cast("string").alias("best_period"),
        F.max("mean").alias("best_val"),
        F.min_by("period", F.struct(F.col("mean"), F.col("_t"))).cast("string").alias("worst_period"),
        F.min("mean").alias("worst_val"),
        F.count(F.lit(1)).alias("_n"),
    ).where("_n >= 2").select(
        "best_period",
        "best_val",
        "worst_period",
        "worst_val",
        _rounded_gap("best_val", "worst_val").alias("gap_pct"),
        F.lit("medium").alias("significance"),
    )


def ts_spikes(
    df: DataFrame, measure_name: str, time: str, means: DataFrame | None = None
) -> DataFrame:
    """Changes above 25 % between neighbouring periods and the largest (> 50 %: high)."""
    means = given(means, df, time, measure_name)
    moved = last_before(means, ["mean"], key_levels("_t")).select(
        "period", "_t", (F.try_divide("mean", "mean_before") - 1).alias("_change")
    )
    size = F.abs("_change")
    found = moved.where(size > 0.25).agg(
        F.count(F.lit(1)).alias("n_notable"),
        F.min_by("period", F.struct(-size, F.col("_t"))).cast("string").alias("notable_period"),
        F.round(F.min_by("_change", F.struct(-size, F.col("_t"))) * 100, 1).alias("change_pct"),
    )
    return found.where("n_notable > 0").withColumn("significance", level(F.abs("change_pct") > 50))


def ts_latest_change(
    df: DataFrame, measure_name: str, time: str, means: DataFrame | None = None
) -> DataFrame:
    """Last period against the one before (> 10 %: high)."""
    last_two = given(means, df, time, measure_name).orderBy(F.desc("_t")).limit(2)
    pair = last_two.agg(
        F.max_by("period", "_t").cast("string").alias("last_period"),
        F.max_by("mean", "_t").alias("last_val"),
        F.min_by("period", "_t").cast("string").alias("prev_period"),
        F.min_by("mean", "_t").alias("prev_val"),
        F.count(F.lit(1)).alias("_n"),
    ).where("_n = 2").drop("_n")
    change = F.coalesce(_rounded_gap("last_val", "prev_val"), F.lit(0.0))
    return pair.withColumn("change_pct", change).withColumn(
        "significance", level(F.abs("change_pct") > 10, None, "low")
    )


# -- single measure --------------------------------------------------------


def pareto_top10(df: DataFrame, measure_name: str) -> DataFrame:
    """Share and mean of the largest tenth of rows (> 50 %: high)."""
    rows = df.select(measure(df, measure_name).alias("_v")).where("_v is not null")

    def cut(n: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(n * F.lit(0.1)))

    bound = order_statistics(rows, "_v", [Rank("_top", 0.9, lambda n: n - cut(n) + 1)]).select(
        "_top", F.col("n").alias("_n")
    )
    sums = beside(rows, settle(bound)[0]).agg(
        F.first("_n").alias("n_rows"),
        _tail_mean("_top", cut(F.first("_n")), F.col("_v") > F.col("_top")).alias("top_mean"),
        F.avg("_v").alias("overall_mean"),
        F.sum("_v").alias("total"),
    )
    top_sum = F.col("top_mean") * cut(F.col("n_rows"))
    share = F.when(F.col("total") > 0, F.round(percent(top_sum, F.col("total")), 1)).otherwise(F.lit(0.0))
    return sums.select(
        share.alias("top_share"),
        "top_mean",
        "overall_mean",
        "total",
        level(share > 50).alias("significance"),
    )


def distribution_summary(df: DataFrame, measure_name: str) -> DataFrame:
    """Mean, median, range and skewness label of a measure."""
    rows = df.select(measure(df, measure_name).alias("_v")).where("_v is not null")
    stats = quantiles(rows, "_v", {"median": 0.5}).select("mean", "median", "min", "max", "n")
    skew = rows.agg(adjusted_skewness(F.col("_v")).alias("skew"))
    return (
        beside(stats, skew)
        .where("n > 0")
        .select(
            "mean", "median", "min", "max", "skew", skew_label("skew").alias("shape"), F.lit("medium").alias("significance")
        )
    )


DIM_IMPACT_HIGH = {"transactional": 20, "customer": 20, "general": 15}


def dim_impact(df: DataFrame, measure_name: str, dim: str, variant: str = "general") -> DataFrame:
    """Best group and its lead over the worst; when the lead counts depends on the variant."""
    ends = _ends(group_means(df, dim, measure_name)).where("n_groups >= 1")
    gap = _rounded_gap("winner_val", "loser_val")
    if variant == "transactional":
        gap = F.when(F.col("loser_val") > 0, gap)
    return ends.select(
        F.col("winner").alias("best"),
        F.col("winner_val").alias("best_val"),
        F.col("loser").alias("worst"),
        F.col("loser_val").alias("worst_val"),
        F.coalesce(gap, F.lit(0.0)).alias("gap_pct"),
        "n_groups",
    ).withColumn("significance", level(F.col("gap_pct") > DIM_IMPACT_HIGH[variant]))


def segment_share(df: DataFrame, dim: str) -> DataFrame:
    """Largest category and its share of all rows, rows without category included."""
    counts = df.groupBy(quoted(dim).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("grp").isNotNull()
    return counts.agg(
        F.min_by(F.col("grp"), F.when(known, F.struct(-F.col("n"), F.col("grp")))).cast("string").alias("dominant"),
        F.round(percent(F.max(F.when(known, F.col("n"))), F.sum("n")), 1).alias("share_pct"),
        F.count_if(known).alias("n_segments"),
    ).where("n_segments > 0").withColumn("significance", F.lit("medium"))


def financial_total(df: DataFrame, measure_name: str) -> DataFrame:
    """Sum, mean and range of a measure."""
    m = measure(df, measure_name)
    return df.agg(
        F.sum(m).alias("total"), F.avg(m).alias("mean"), F.min(m).alias("min"), F.max(m).alias("max")
    ).withColumn("significance", F.lit("high"))


def contribution_share(df: DataFrame, measure_name: str, dim: str) -> DataFrame:
    """Group with the largest sum and its share of the grand total (> 40 %: high).

    The grand total comes from the same group sums, rows without a group included.
    """
    sums = df.groupBy(quoted(dim).alias("grp")).agg(F.sum(measure(df, measure_name)).alias("s"))
    known = F.col("grp").isNotNull()
    sized = F.coalesce("s", F.lit(0.0))
    found = sums.agg(
        F.min_by("grp", F.when(known, F.struct(-sized, F.col("grp")))).cast("string").alias("top_group"),
        F.max(F.when(known, sized)).alias("top_sum"),
        F.sum("s").alias("total"),
    ).where("top_group is not null")
    share = F.when(F.col("total") > 0, F.round(percent(F.col("top_sum"), F.col("total")), 1)).otherwise(F.lit(0.0))
    return found.withColumn("top_share", share).withColumn("significance", level(F.col("top_share") > 40))


def z_outlier_count(df: DataFrame, measure_name: str) -> DataFrame:
    """Rows more than 2.5 population deviations from the mean (> 3 rows: high)."""
    rows = df.select(measure(df, measure_name).alias("_v"))
    stats = rows.agg(F.avg("_v").alias("_mean"), F.stddev_pop("_v").alias("_std"))
    z = F.try_divide(F.col("_v") - F.col("_mean"), F.col("_std"))
    return (
        beside(rows, stats)
        .agg(F.count_if(F.abs(z) > 2.5).alias("outlier_count"))
        .where("outlier_count > 0")
        .withColumn("significance", level(F.col("outlier_count") > 3))
    )
