"""Cross products of many columns in one scan.

Each task keeps one buffer: for every pair of columns the number of rows where both are
present, the two means over those rows, the squares and the product around them. A
batch of rows adds to it by four matrix products; buffers are merged pair by pair with
the usual update of means, so values far from zero lose no digits. A buffer of k columns
takes 32 k^2 bytes; beyond ``TILE`` columns, pairs of tiles get a scan each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 1000
PARTIAL = "i int, n array<double>, mi array<double>, mj array<double>, si array<double>, sj array<double>, c array<double>, own_n array<double>, own_m array<double>, own_s array<double>"
NAMES = [f.split()[0] for f in PARTIAL.split(", ")]
PAIR = "i int, j int, n double, mi double, mj double, si double, sj double, c double, noise_i double, noise_j double"


def batch_moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean, squares, products) of all pairs of columns of a block; entry (i, j) of mean and squares is of i where j is present too."""
    present = np.isfinite(x)
    n_each = present.sum(axis=0)
    centre = np.where(present, x, 0.0).sum(axis=0) / np.maximum(n_each, 1)
    x = np.where(present, x - centre, 0.0)
    products = x.T @ x
    if present.all():
        n = np.full(products.shape, float(len(x)))
        sums = np.broadcast_to(x.sum(axis=0)[:, None], products.shape)
        squares = np.broadcast_to(np.diag(products)[:, None], products.shape)
    else:
        known = present.astype(np.float64)
        n, sums, squares = known.T @ known, x.T @ known, (x * x).T @ known
    some = np.maximum(n, 1.0)
    mean = centre[:, None] + sums / some
    return n, mean, np.maximum(squares - sums * sums / some, 0.0), products - sums * sums.T / some


def merged(a, b):
    """Moments of two sets of rows together, entry by entry: (n, mean i, mean j, squares i, squares j, products)."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1.0)
    weight = a[0] * share
    di, dj = b[1] - a[1], b[2] - a[2]
    return n, a[1] + di * share, a[2] + dj * share, a[3] + b[3] + di * di * weight, a[4] + b[4] + dj * dj * weight, a[5] + b[5] + di * dj * weight


def _scan(rows: DataFrame, width: int) -> DataFrame:
    """PAIR rows of all pairs i <= j of the first ``width`` columns of ``rows``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([pc.fill_null(c, float("nan")).to_numpy(zero_copy_only=False) for c in batch.columns])
            n, mean, squares, products = batch_moments(x)
            own = (n, mean, mean.T, squares, squares.T, products)
            held = own if held is None else merged(held, own)
        if held is not None:
            alone = [np.diag(held[k]) for k in (0, 1, 3)]
            arrays = [[m[i, i:] for i in range(width)] for m in held] + [[d[i:] for i in range(width)] for d in alone]
            columns = [pa.array(range(width), pa.int32()), *[pa.array(m, pa.list_(pa.float64())) for m in arrays]]
            yield pa.RecordBatch.from_arrays(columns, NAMES)

    def together(group: pa.Table) -> pa.Table:
        held = alone = None
        i = group["i"][0].as_py()
        for r in range(group.num_rows):
            row = [group[k][r].values.to_numpy() for k in NAMES[1:]]
            own, (n, m, s) = tuple(row[:6]), row[6:]
            one = (n, m, m, s, s, s)
            held, alone = (own, one) if held is None else (merged(held, own), merged(alone, one))
        k = len(held[0])
        # what rounding leaves of a column that does not vary, against all its values
        noise = np.maximum(1e-14 * alone[3] / np.maximum(alone[0], 1), 1e-26 * alone[1] ** 2)
        names = [f.split()[0] for f in PAIR.split(", ")]
        return pa.Table.from_arrays([pa.array([i] * k, pa.int32()), pa.array(range(i, i + k), pa.int32()), *map(pa.array, held), pa.array(np.full(k, noise[0])), pa.array(noise)], names)

    return rows.mapInArrow(partial, PARTIAL).groupBy("i").applyInArrow(together, PAIR)


def pair_moments(df: DataFrame, cells: Sequence[Column]) -> DataFrame:
    """PAIR rows for all pairs i <= j of ``cells`` (doubles): rows where both are finite, means, squares and product around them.

    noise_i and noise_j are variances below which a column does not vary.
    """
    named = [c.cast("double").alias(f"x{i}") for i, c in enumerate(cells)]
    if len(cells) <= TILE:
        return _scan(df.select(*named), len(cells))
    half = TILE // 2
    tiles = [range(low, min(low + half, len(cells))) for low in range(0, len(cells), half)]
    out = None
    for a, first in enumerate(tiles):
        for b, second in enumerate(tiles[a:], a):
            places = [*first] if a == b else [*first, *second]
            one = _scan(df.select(*[named[i] for i in places]), len(places))
            if a != b:
                one = one.where((F.col("i") < len(first)) & (F.col("j") >= len(first)))
            at = F.array(*[F.lit(i) for i in places])
            one = one.withColumn("i", F.get(at, F.col("i"))).withColumn("j", F.get(at, F.col("j")))
            out = one if out is None else out.unionByName(one)
    return out
