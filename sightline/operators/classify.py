"""Column roles, kind of dataset and primary columns."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import keywords as K
from sightline.functions.types import measure, quoted
from sightline.operators.profile import column_profile, distinct_counts, distinct_key, melt, semantic_types, value
from sightline.plans.ordering import numbered
from sightline.plans.shared import BROADCAST_ROWS, reliable, settle

DATASET_TYPES = ("experiment", "timeseries", "transactional", "customer", "financial")


def column_roles(profile: DataFrame) -> DataFrame:
    """Add ``role`` to a column profile; the first matching rule wins."""
    name = K.normal_name(F.col("column_name"))
    integer = F.col("kind") == "integer"
    distinct = F.col("n_distinct")
    attribute = K.contains_any(name, K.SEGMENT)
    key_like = (
        integer
        & ~attribute
        & (
            (distinct > 0.5 * F.col("n_rows"))
            | ((F.col("max_value") == distinct) & (distinct > 10))
        )
    )
    named_key = (
        name.isin(*K.IDENTIFIER_NAMES)
        | name.endswith("_id")
        | (name.endswith("id") & (F.length(name) > 2))
    )
    return profile.withColumn(
        "role",
        F.when(named_key | key_like, "identifier")
        .when((F.col("kind") == "datetime") | K.contains_any(name, K.TIME), "time")
        .when(integer & (distinct <= 30) & attribute, "segment")
        .when(F.col("kind").isin("string", "boolean") | (integer & (distinct <= 15)), "dimension")
        .when(F.col("kind").isin("integer", "float"), "measure"),
    )


def dataset_type_score(roles: DataFrame) -> DataFrame:
    """Keyword scores per kind of dataset, the confidence and the decision; one row."""
    named = roles.withColumn("clow", K.normal_name(F.col("column_name")))
    # Equal names count once, with the type of the first column that has them.
    names = named.groupBy("clow").agg(F.min_by("kind", "position").alias("kind"))
    clow = F.col("clow")

    def points(words: tuple[str, ...], score: int) -> Column:
        return F.coalesce(F.sum(F.when(K.contains_any(clow, words), score)), F.lit(0))

    words = names.agg(
        points(K.EXPERIMENT, 3).alias("experiment"),
        F.coalesce(
            F.sum(F.when(clow.isin(*K.TIME), F.when(F.col("kind") == "integer", 1).otherwise(2))), F.lit(0)
        ).alias("timeseries"),
        points(K.TRANSACTIONAL, 3).alias("transactional"),
        points(K.CUSTOMER_LIKE, 1).alias("customer_like"),
        points(K.CUSTOMER, 2).alias("customer"),
        points(K.FINANCIAL, 2).alias("financial"),
    )
    held = named.agg(
        F.coalesce(F.bool_or(F.col("role") == "identifier"), F.lit(False)).alias("has_id"),
        F.coalesce(F.bool_or(F.col("role") == "measure"), F.lit(False)).alias("has_measure"),
        F.coalesce(F.bool_or(F.col("role") == "time"), F.lit(False)).alias("has_time"),
        F.coalesce(F.bool_or(F.col("kind") == "datetime"), F.lit(False)).alias("has_datetime"),
    )
    scored = words.crossJoin(F.broadcast(held)).select(
        (F.col("experiment") + F.when(F.expr("has_id and has_measure"), 1).otherwise(0)).alias("experiment"),
        (
            F.col("timeseries")
            + F.when(F.expr("has_time and has_datetime"), 2).when(F.col("has_time"), 1).otherwise(0)
        ).alias("timeseries"),
        (
            F.col("transactional")
            + F.when(F.expr("has_time and has_measure"), F.col("customer_like")).otherwise(0)
        ).alias("transactional"),
        "customer",
        "financial",
    )
    scores = [F.col(t) for t in DATASET_TYPES]
    total = sum(scores[1:], scores[0])
    best = F.greatest(*scores)
    leader = F.coalesce(*[F.when(F.col(t) == best, F.lit(t)) for t in DATASET_TYPES])
    confidence = F.coalesce(F.try_divide(best.cast("double"), total.cast("double")), F.lit(0.0))
    return scored.select(
        *[F.col(t).cast("long").alias(t) for t in DATASET_TYPES],
        F.round(confidence, 3).alias("confidence"),
        F.when(total == 0, "general")
        .when((F.col("experiment") >= 3) & (F.col("experiment") == best), "experiment")
        .when(confidence < 0.5, "general")
        .otherwise(leader)
        .alias("dataset_type"),
    )


def primary_measure(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """The measure with the largest sample variance, the first among equals."""
    row = df.agg(*[F.var_samp(measure(df, c)).alias(f"variance_{i}") for i, c in enumerate(measures)])
    return (
        melt(row, measures, ["variance"])
        .orderBy(F.col("variance").desc_nulls_last(), "position")
        .limit(1)
        .select("column_name", "variance")
    )


def category_correlation(
    df: DataFrame,
    dimension: str,
    measure_name: str,
    small_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Absolute correlation of a measure with the sorted category codes (null = -1).

    Count, mean and variance are taken per category first, so a hot category is
    one row and no code is joined back to the table. A dimension with more than
    ``small_rows`` categories is coded by a distributed sort.
    """
    groups = df.groupBy(quoted(dimension).alias("_d")).agg(
        F.count(measure(df, measure_name)).cast("double").alias("n"),
        F.avg(measure(df, measure_name)).alias("m"),
        F.var_pop(measure(df, measure_name)).alias("v"),
    )
    # One scan: few categories are kept as literal rows, many are written once.
    groups, few = settle(groups, small_rows)
    if not few:
        groups = reliable(groups)
    known = groups.where(F.col("_d").isNotNull())
    if few:
        coded = known.withColumn("code", F.row_number().over(Window.orderBy("_d")) - 1)
    else:
        coded = numbered(known, [F.col("_d")], "code")
    missing = groups.where(F.col("_d").isNull()).withColumn("code", F.lit(-1))
    rows = coded.selectExpr("n", "m", "v", "CAST(code AS DOUBLE) AS code").unionByName(
        missing.selectExpr("n", "m", "v", "CAST(code AS DOUBLE) AS code")
    ).where("n > 0")
    centre = rows.selectExpr("sum(n * m) / sum(n) AS my", "sum(n * code) / sum(n) AS mx")
    sums = rows.crossJoin(F.broadcast(centre)).selectExpr(
        "sum(n * (code - mx) * (code - mx)) AS sxx",
        "sum(n * (v + (m - my) * (m - my))) AS syy",
        "sum(n * (code - mx) * (m - my)) AS sxy",
    )
    return sums.select(
        F.lit(dimension).alias("column_name"),
        F.expr("abs(CASE WHEN sxx > 0 AND syy > 0 THEN sxy / sqrt(sxx * syy) END)").alias("correlation"),
    )


def primary_dimension(
    df: DataFrame,
    dimensions: Sequence[str],
    measure_name: str | None,
    dataset_type: str = "general",
) -> DataFrame:
    """The dimension that tells most about the measure, with its score."""
    spark = df.sparkSession
    if dataset_type == "experiment":
        for name in dimensions:
            if K.name_contains(name.replace(" ", "_"), K.EXPERIMENT):
                return spark.range(1).select(
                    F.lit(name).alias("column_name"), F.lit(None).cast("double").alias("score")
                )
    scores = None
    for i, name in enumerate(dimensions):
        if measure_name:
            one = category_correlation(df, name, measure_name).withColumnRenamed("correlation", "score")
        else:
            one = df.agg(F.count_distinct(distinct_key(df, name)).cast("double").alias("score")).select(
                F.lit(name).alias("column_name"), "score"
            )
        one = one.withColumn("position", F.lit(i))
        scores = one if scores is None else scores.unionByName(one)
    return (
        scores.orderBy(F.col("score").desc_nulls_last(), "position").limit(1).select("column_name", "score")
    )


def cardinalities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column, a null counting as one value."""
    nulls = df.agg(
        *[F.coalesce(F.max(value(df, c).isNull().cast("long")), F.lit(0)).alias(f"null_{i}") for i, c in enumerate(columns)]
    )
    # One row per column on both sides.
    return (
        distinct_counts(df, columns)
        .join(F.broadcast(melt(nulls, columns, ["null"]).select("column_name", "null")), "column_name")
        .select("position", "column_name", (F.col("n_distinct") + F.col("null")).alias("n_values"))
    )


@dataclass
class Meta:
    """What the columns of a table mean; the only part resolved on the driver."""

    dataset_type: str
    confidence: float
    semantic: dict[str, str]
    profile: DataFrame
    distinct: dict[str, int]
    identifiers: list[str] = field(default_factory=list)
    times: list[str] = field(default_factory=list)
    segments: list[str] = field(default_factory=list)
    dimensions: list[str] = field(default_factory=list)
    measures: list[str] = field(default_factory=list)
    primary_measure: str | None = None
    primary_dimension: str | None = None
    primary_time: str | None = None


def resolve(df: DataFrame, roles: dict[str, str] | None = None, approx: bool = False) -> Meta:
    """Profile and classify a table; ``roles`` overrides single columns.

    What reaches the driver is one profile row per column and single scalars.
    """
    typed = semantic_types(column_profile(df, approx=approx))
    ruled = column_roles(typed)
    if roles:
        fixed = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
        ruled = ruled.withColumn("role", F.coalesce(fixed[F.col("column_name")], F.col("role")))
    table = ruled.toArrow()
    settled = df.sparkSession.createDataFrame(table)
    rows = sorted(table.to_pylist(), key=lambda r: r["position"])

    def having(role: str) -> list[str]:
        return [r["column_name"] for r in rows if r["role"] == role]

    measures = having("measure")
    with ThreadPoolExecutor(2) as pool:
        variance = pool.submit(lambda: primary_measure(df, measures).first()) if measures else None
        decision = dataset_type_score(settled).first()
    meta = Meta(
        dataset_type=decision["dataset_type"],
        confidence=decision["confidence"],
        semantic={r["column_name"]: r["semantic_type"] for r in rows},
        profile=settled,
        distinct={r["column_name"]: r["n_distinct"] for r in rows},
        identifiers=having("identifier"),
        times=having("time"),
        segments=having("segment"),
        dimensions=having("dimension"),
        measures=measures,
    )
    meta.primary_time = meta.times[0] if meta.times else None
    if variance is not None:
        meta.primary_measure = variance.result()["column_name"]
    if meta.dimensions:
        chosen = primary_dimension(df, meta.dimensions, meta.primary_measure, meta.dataset_type)
        meta.primary_dimension = chosen.first()["column_name"]
    return meta
