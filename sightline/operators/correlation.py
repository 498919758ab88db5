"""Correlations, histograms, distribution shape and value counts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.types import measure, quoted
from sightline.plans.moments import pair_moments
from sightline.plans.quantiles import quantiles
from sightline.plans.shared import beside

PAIRS_PER_SCAN = 60
BINS = 20


def adjusted_skewness(c: Column) -> Column:
    """Sample skewness with the small-sample factor; null below three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def _pair_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of each pair over the rows where both are present.

    The first scan takes count, mean and variance per column (one driver row per
    column). The second sums products of centred columns: one plain sum per pair
    of complete columns, six for a pair with nulls. A pair whose either side does
    not vary has none. More than ``PAIRS_PER_SCAN`` pairs take one scan for all, by
    matrix products.
    """
    names = sorted({c for pair in pairs for c in pair})
    place = {c: i for i, c in enumerate(names)}
    if len(pairs) > PAIRS_PER_SCAN:
        return _many_correlations(df, pairs, names, place)
    base = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            f(measure(df, c)).alias(f"{label}{i}")
            for c, i in place.items()
            for label, f in (("count", F.count), ("mean", F.avg), ("var", F.var_pop))
        ],
    ).first()
    centred = df.select(
        *[(measure(df, c) - F.lit(base[f"mean{i}"]).cast("double")).alias(f"x{i}") for c, i in place.items()]
    )
    total = base["n"]
    out = None
    for start in range(0, len(pairs), PAIRS_PER_SCAN):
        sums, rows = [], []
        for k, (a, b) in enumerate(pairs[start : start + PAIRS_PER_SCAN]):
            i, j = place[a], place[b]
            sums.append(f"sum(x{i} * x{j}) AS xy{k}")
            if base[f"count{i}"] == base[f"count{j}"] == total:
                known = [f"{total}D", "0D", "0D"] + [f"{finite(base[f'var{c}']) * total!r}D" for c in (i, j)]
            else:
                both = f"x{i} IS NOT NULL AND x{j} IS NOT NULL"
                sums.append(f"CAST(count_if({both}) AS DOUBLE) AS n{k}")
                for label, value in (("x", f"x{i}"), ("y", f"x{j}"), ("xx", f"x{i} * x{i}"), ("yy", f"x{j} * x{j}")):
                    sums.append(f"sum(CASE WHEN {both} THEN {value} END) AS {label}{k}")
                known = [f"{label}{k}" for label in ("n", "x", "y", "xx", "yy")]
            rows.append(f"struct({k} AS pair, " + ", ".join(
                f"{v} AS {label}" for v, label in zip([*known, f"xy{k}"], ("n", "sx", "sy", "sxx", "syy", "sxy"))
            ) + ")")
        one = centred.agg(*[F.expr(e) for e in sums]).select(F.expr(f"inline(array({', '.join(rows)}))"))
        named = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs[start : start + PAIRS_PER_SCAN]])
        one = one.withColumn("_names", named[F.col("pair")])
        out = one if out is None else out.unionByName(one)
    moments = out.selectExpr(
        "_names.a AS col_a",
        "_names.b AS col_b",
        "sxy / nullif(n, 0) - sx * sy / nullif(n * n, 0) AS cov",
        "sxx / nullif(n, 0) - sx * sx / nullif(n * n, 0) AS vx",
        "syy / nullif(n, 0) - sy * sy / nullif(n * n, 0) AS vy",
        "1e-14D * sxx / nullif(n, 0) AS noise_x",
        "1e-14D * syy / nullif(n, 0) AS noise_y",
    )
    # What rounding leaves of a constant counts as no variance.
    return moments.selectExpr(
        "col_a", "col_b", "CASE WHEN vx > noise_x AND vy > noise_y THEN cov / sqrt(vx * vy) END AS r"
    )


def _many_correlations(df: DataFrame, pairs: list[tuple[str, str]], names: list[str], place: dict[str, int]) -> DataFrame:
    moments = pair_moments(df, [measure(df, c) for c in names])
    listed = df.sparkSession.createDataFrame(
        pa.table({
            "i": pa.array([min(place[a], place[b]) for a, b in pairs], pa.int32()), "j": pa.array([max(place[a], place[b]) for a, b in pairs], pa.int32()),
            "col_a": [a for a, _ in pairs], "col_b": [b for _, b in pairs],
        })
    )
    found = listed.join(moments, ["i", "j"], "left")
    varies = (F.col("si") > F.col("n") * F.col("noise_i")) & (F.col("sj") > F.col("n") * F.col("noise_j"))
    return found.select("col_a", "col_b", F.when(varies, F.col("c") / F.sqrt(F.col("si") * F.col("sj"))).alias("r"))


def finite(x: float | None) -> float:
    return x if x is not None and math.isfinite(x) else 0.0


def rounded(name: str, digits: int) -> Column:
    """Rounded without a negative zero."""
    return F.round(name, digits) + F.lit(0.0)


def top_correlations(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """Strongest pairwise correlations above 0.3, each pair once in name order."""
    pairs = list(combinations(sorted(columns), 2))
    strong = _pair_correlations(df, pairs).where(F.abs("r") > 0.3)
    ranked = strong.orderBy(F.abs("r").desc(), "col_a", "col_b").limit(top)
    return ranked.select("col_a", "col_b", rounded("r", 4).alias("r"))


def corr_matrix(df: DataFrame, columns: Sequence[str], min_columns: int = 4) -> DataFrame:
    """Long correlation matrix over rows without nulls, varying columns only.

    Where fewer than ``min_columns`` columns vary, the others stay in with a
    null correlation.
    """
    names = list(columns)
    complete = df.select(*[measure(df, c).alias(c) for c in names]).na.drop(subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    upper = _pair_correlations(complete, pairs)
    both = upper.unionByName(
        upper.where("col_a <> col_b").select(
            F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r"
        )
    )
    varying = upper.where("col_a = col_b and r is not null")
    flags = varying.agg(F.count(F.lit(1)).alias("_varying"))
    shown = beside(both, flags).where((F.col("r").isNotNull()) | (F.col("_varying") < min_columns))
    return shown.select(F.col("col_a").alias("x"), F.col("col_b").alias("y"), rounded("r", 2).alias("value"))


def heatmap_pivot(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long matrix to one row per ``y`` and one column per name; gaps are zero."""
    names = list(columns)
    return matrix.groupBy("y").pivot("x", names).agg(F.first("value")).na.fill(0.0, subset=names)


def scatter_best_pair(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strongest pair with |r| between 0.3 and 1 over rows without nulls."""
    names = list(columns)
    complete = df.select(*[measure(df, c).alias(c) for c in names]).na.drop(subset=names)
    pairs = list(combinations(names, 2))
    found = _pair_correlations(complete, pairs).where((F.abs("r") > 0.3) & (F.abs("r") < 1.0))
    return (
        found.orderBy(F.abs("r").desc(), "col_a", "col_b")
        .limit(1)
        .select(F.col("col_a").alias("x_col"), F.col("col_b").alias("y_col"), "r")
    )


def scatter_points(df: DataFrame, columns: Sequence[str], points: int | None = None) -> DataFrame:
    """Rows (x_col, y_col, x, y) of the strongest pair: all rows without nulls, or a random sample of ``points``.

    Without a pair there are no rows.
    """
    names = list(columns)
    best = scatter_best_pair(df, names).first()
    complete = df.select(*[measure(df, c).alias(c) for c in names]).na.drop(subset=names)
    x, y = (best["x_col"], best["y_col"]) if best else (names[0], names[0])
    rows = complete.where(F.lit(best is not None)).select(
        F.lit(x).alias("x_col"), F.lit(y).alias("y_col"), quoted(x).alias("x"), quoted(y).alias("y")
    )
    return rows if points is None else rows.orderBy(F.rand(42)).limit(points)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed, empty ones kept."""
    v = df.select(measure(df, column).alias("_v")).where("_v is not null")
    span = v.agg(F.min("_v").alias("_min"), F.max("_v").alias("_max")).select(
        F.when(F.col("_min") == F.col("_max"), F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
        F.when(F.col("_min") == F.col("_max"), F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"),
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    guess = F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))
    # The division may land one bin off an edge; the edge itself decides.
    low_edge = F.col("_lo") + F.col("_guess") * width
    high_edge = F.col("_lo") + (F.col("_guess") + 1) * width
    placed = (
        beside(v, span)
        .withColumn("_guess", guess)
        .withColumn(
            "bin",
            F.when(F.col("_v") < low_edge, F.col("_guess") - 1)
            .when((F.col("_v") >= high_edge) & (F.col("_guess") < bins - 1), F.col("_guess") + 1)
            .otherwise(F.col("_guess")),
        )
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("_count"))
    grid = span.select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(F.broadcast(counts), "bin", "left").select(
        F.col("bin").cast("long").alias("bin"),
        (F.col("_lo") + (F.col("bin") + 0.5) * width).alias("x"),
        F.coalesce("_count", F.lit(0).cast("long")).alias("y"),
    )


def skew_shape(df: DataFrame, column: str) -> DataFrame:
    """Adjusted skewness and its label."""
    return df.agg(adjusted_skewness(measure(df, column)).alias("skew")).select("skew", skew_label("skew").alias("shape"))


def skew_label(name: str) -> Column:
    c = F.col(name)
    return F.when(c > 1, "right").when(c < -1, "left").otherwise("symmetric")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null category, most frequent first."""
    c = quoted(column)
    counts = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").select(F.col("value").cast("string").alias("value"), "n")


def group_distribution(df: DataFrame, group: str, column: str) -> DataFrame:
    """Five-number summary of a measure per group, over all rows."""
    rows = df.select(quoted(group).cast("string").alias("grp"), measure(df, column).alias("_v"))
    rows = rows.where("grp is not null and _v is not null")
    stats = quantiles(rows, "_v", {"q25": 0.25, "median": 0.5, "q75": 0.75}, ["grp"])
    return stats.select("grp", "n", "min", "q25", "median", "q75", "max")


def group_values(
    df: DataFrame, group: str, column: str, order_by: Sequence[str], cap: int = 500, groups: int | None = None
) -> DataFrame:
    """First values of a measure per group in key order, as a box plot shows them.

    The cap is part of the chart; the numbers of ``group_distribution`` are not
    capped. Each task forwards at most ``cap`` rows per group.
    """
    rows = df.select(
        quoted(group).cast("string").alias("grp"),
        measure(df, column).alias("value"),
        *[quoted(c).alias(f"_k{i}") for i, c in enumerate(order_by)],
    ).where("grp is not null and value is not null")
    keys = [F.col(f"_k{i}") for i in range(len(order_by))]
    if groups is not None:
        firsts = rows.groupBy("grp").agg(F.min(F.struct(*keys)).alias("_first"))
        shown = firsts.orderBy("_first", "grp").limit(groups).select("grp")
        rows = rows.join(F.broadcast(shown), "grp", "left_semi")
    nth = F.row_number().over(Window.partitionBy("grp").orderBy(*keys))
    return rows.withColumn("seq", nth).where(F.col("seq") <= cap).select("grp", F.col("seq").cast("long").alias("seq"), "value")
