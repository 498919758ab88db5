"""Work along an order: one range partitioning, a pass over each partition, and a small table that joins the partitions' ends.

Rows are laid out by range and sorted, so a partition is a stretch of the order, however
the keys are distributed. Each partition is read once, in NumPy, and gives a few rows: sums,
counts or first hits of its own, and what stands at its two ends. Those few rows are
written to shared storage; what spans two partitions follows from them by a window over
partitions. Stretches that share a key are split like any other, if the order has a tie-break.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.plans.shared import reliable


def swept(df: DataFrame, order: list[str], work: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """What ``work(partition number, sorted batches)`` gives for each partition; computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(TaskContext.get().partitionId(), batches)

    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return reliable(laid.mapInArrow(run, kind))


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A numeric column; nulls are NaN in a column of doubles."""
    values = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_floating(values.type):
        values = pc.fill_null(values, float("nan"))
    return values.to_numpy(zero_copy_only=False)


def gap_counts(times: DataFrame, unit: int, group: str | None = None) -> DataFrame:
    """(group, units, w, low, high): how many gaps of consecutive rows of a group have so many whole units, with the least and the largest gap.

    ``times`` has distinct (group, BIGINT moment ``t``) with the number ``c`` of their
    rows; rows of one moment have gaps of zero between them. All groups share one sweep;
    without ``group`` all rows are one.
    """
    if group is None:
        return gap_counts(times.withColumn("_all", F.lit("")), unit, "_all").drop("_all")
    names = [group, "part", "units", "w", "low", "high"]
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4]

    def work(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[str, list[int]] = {}
        found: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(batch.schema.get_field_index(group)))
            t, c = column(batch, "t"), column(batch, "c")
            start = 0
            for name, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                own, rows = t[start:stop], int(c[start:stop].sum())
                start = stop
                gaps = np.diff(own if name not in ends else np.append(ends[name][1], own))
                ends[name] = [ends[name][0] if name in ends else int(own[0]), int(own[-1])]
                days = gaps // unit
                known, at, n = np.unique(days, return_inverse=True, return_counts=True)
                low = np.full(len(known), np.iinfo(np.int64).max)
                high = np.full(len(known), -1)
                np.minimum.at(low, at, gaps)
                np.maximum.at(high, at, gaps)
                cells = list(zip(known.tolist(), n.tolist(), low.tolist(), high.tolist()))
                if rows > len(own):
                    cells.append((0, rows - len(own), 0, 0))
                for d, w, a, b in cells:
                    old = found.get((name, d), [0, a, b])
                    found[name, d] = [old[0] + w, min(old[1], a), max(old[2], b)]
        out = [(name, None, d, *cell) for (name, d), cell in found.items()]
        out += [(name, part, None, 1, *two) for name, two in ends.items()]
        columns = list(zip(*out)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names)

    seen = swept(times.select(group, "t", "c"), [group, "t"], work, f"{group} string, part int, units bigint, w bigint, low bigint, high bigint")
    # one row a group and partition
    before = F.lag("high").over(Window.partitionBy(group).orderBy("part"))
    ends = seen.where("part is not null").select(group, (F.col("low") - before).alias("gap")).where("gap is not null")
    ends = ends.select(group, F.floor(F.col("gap") / unit).alias("units"), F.lit(1).cast("long").alias("w"), F.col("gap").alias("low"), F.col("gap").alias("high"))
    cells = seen.where("part is null").drop("part").unionByName(ends)
    return cells.groupBy(group, "units").agg(F.sum("w").alias("w"), F.min("low").alias("low"), F.max("high").alias("high"))


def rank_moments(steps: DataFrame, group: str) -> DataFrame:
    """(group, n, xy, y, yy): sums over rows numbered from 0 by ``t`` within each group.

    ``steps`` has distinct (group, BIGINT ``t``) with the count ``c`` and the sums ``sy``
    and ``syy`` of their rows. xy is the sum of value times number; rows of one
    moment take the mean of their numbers.
    """

    def work(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[float]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = pc.run_end_encode(batch.column(batch.schema.get_field_index(group)))
            c, sy, syy = (column(batch, k) for k in ("c", "sy", "syy"))
            low = 0
            for name, high in zip(names.values.to_pylist(), names.run_ends.to_pylist()):
                own = c[low:high]
                s = sums.setdefault(name, [0, 0.0, 0.0, 0.0])
                number = s[0] + np.cumsum(own) - own + (own - 1) / 2.0
                s[1] += float((sy[low:high] * number).sum())
                s[2] += float(sy[low:high].sum())
                s[3] += float(syy[low:high].sum())
                s[0] += int(own.sum())
                low = high
        columns = [list(sums), [part] * len(sums), *zip(*sums.values())] if sums else [()] * 6
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], [group, "part", "n", "xy", "y", "yy"])

    seen = swept(steps.select(group, "t", "c", "sy", "syy"), [group, "t"], work, f"{group} string, part int, n bigint, xy double, y double, yy double")
    # a row a group and partition
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = seen.withColumn("xy", F.col("xy") + earlier * F.col("y"))
    return placed.groupBy(group).agg(*[F.sum(k).alias(k) for k in ("n", "xy", "y", "yy")])


def first_jumps(rows: DataFrame, order: list[str], values: list[str], share: float, shown: int) -> DataFrame:
    """(position, order..., value): for each of ``values``, the first cells that differ by more than ``share`` from the last known cell before.

    ``order`` names BIGINT columns, values are doubles; a null or NaN cell is not known. At
    most ``shown`` cells of each partition and column come back, the first of all among them.
    """
    kind = "part int, position int, what string, " + ", ".join(f"{o} bigint" for o in order) + ", value double, last double"

    def work(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple] = {}
        last = [np.nan] * len(values)
        hits: list[list[tuple]] = [[] for _ in values]
        for batch in batches:
            keys = [column(batch, o) for o in order]
            for i, name in enumerate(values):
                cells = column(batch, name)
                at = np.flatnonzero(~np.isnan(cells))
                if not len(at):
                    continue
                known = cells[at]
                if i not in first:
                    first[i] = (*[int(k[at[0]]) for k in keys], float(known[0]))
                if len(hits[i]) < shown:
                    before = np.append(last[i], known[:-1])
                    with np.errstate(divide="ignore", invalid="ignore"):
                        jumped = (np.abs(known / before - 1) > share) & (before != 0) & ~np.isnan(before)
                    for j in np.flatnonzero(jumped)[: shown - len(hits[i])].tolist():
                        hits[i].append((*[int(k[at[j]]) for k in keys], float(known[j])))
                last[i] = float(known[-1])
        rows = [(part, i, "hit", *h, None) for i, found in enumerate(hits) for h in found]
        rows += [(part, i, "ends", *f, last[i]) for i, f in first.items()]
        columns = list(zip(*rows)) if rows else [()] * (5 + len(order))
        kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * len(order), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in kind.split(", ")])

    seen = swept(rows.select(*order, *values), order, work, kind)
    # a row a column and partition that has any known cell
    before = F.lag("last").over(Window.partitionBy("position").orderBy("part"))
    ends = seen.where("what = 'ends'").withColumn("before", before).where(F.abs(F.try_divide("value", "before") - 1) > share)
    return seen.where("what = 'hit'").unionByName(ends.drop("before")).select("position", *order, "value")
