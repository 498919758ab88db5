"""Shape of a short ordered list of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shape_pattern(values: Column) -> Column:
    """increasing, decreasing, u-shaped, inverted-u or flat.

    Three values are needed. A list that is neither rising nor falling
    throughout is judged by its middle value against the mean of the values
    before it and the mean of the values from it on.
    """
    n = F.size(values)
    later = F.greatest(n - 1, F.lit(0))
    steps = F.zip_with(F.slice(values, 2, later), F.slice(values, 1, later), lambda b, a: b - a)
    half = F.floor(n / 2).cast("int")

    def mean(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x) / F.size(part)

    before = mean(F.slice(values, 1, half))
    after = mean(F.slice(values, half + 1, n - half))
    middle = F.element_at(values, half + 1)
    return (
        F.when(n < 3, "flat")
        .when(F.forall(steps, lambda d: d > 0), "increasing")
        .when(F.forall(steps, lambda d: d < 0), "decreasing")
        .when((middle < before) & (middle < after), "u-shaped")
        .when((middle > before) & (middle > after), "inverted-u")
        .otherwise("flat")
    )
