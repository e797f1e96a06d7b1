"""Two-objective selection (both to be least): fronts, crowding, survivors, knee.

As DataFrame operators on groups of points ``(group, id, x, y)``, and on the
driver for a search's population of at most a few hundred.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def front(points: DataFrame) -> DataFrame:
    """Points that none of their group dominates: in order of x no earlier y is as low, equals aside.

    One running minimum over each group's distinct x instead of all pairs.
    """
    by_x = Window.partitionBy("group").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    low = points.groupBy("group", "x").agg(F.min("y").alias("low"))
    low = low.withColumn("before", F.min("low").over(by_x))
    return points.join(low, ["group", "x"]).where("y = low and (before is null or y < before)").select("group", "id", "x", "y")


def fronts(points: DataFrame, below: int | None = None) -> DataFrame:
    """``points`` with ``front`` from 0: what remains undominated after the fronts before it.

    Each group streams through one task in order of x and y.  With ``below``
    only points of earlier fronts are returned, and each task first drops those
    that its own points put further back: a chain of ``below`` points that
    dominate a point puts it there in the whole group too.  Points with a null
    are in front 0; a NaN is above all numbers.
    """
    points = points.select("group", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    schema = f"group {points.schema['group'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, x double, y double, front int"
    if below is not None:
        points = points.sortWithinPartitions("group", "x", "y").mapInArrow(_sweep(below), schema).drop("front")
    return points.repartition("group").sortWithinPartitions("group", "x", "y").mapInArrow(_sweep(below), schema)


def _in_order(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whole numbers in the order of the column's doubles."""
    v = column.to_numpy(zero_copy_only=False) + 0.0
    bits = v.view(np.int64)
    return np.where(np.isnan(v), np.iinfo(np.int64).max, np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits))


def _sweep(below: int | None):
    """Batches of (group, id, x, y) in order of group, x and y with their fronts.

    All that dominates a point comes before it, so its front is the number of
    fronts whose least y so far is no higher; equal points share theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, k = None, None, 0
        least: list[int] = []
        for b in batches:
            out = np.zeros(len(b), np.int32)
            whole = np.flatnonzero(~np.any([c.is_null().to_numpy(zero_copy_only=False) for c in (b.column(0), b.column(2), b.column(3))], axis=0))
            kept = b.take(pa.array(whole))
            for i, g, x, y in zip(whole.tolist(), kept.column(0).to_pylist(), _in_order(kept.column(2)).tolist(), _in_order(kept.column(3)).tolist(), strict=True):
                if g != group:
                    group, last, least = g, None, []
                if (x, y) != last:
                    last, k = (x, y), bisect_right(least, y)
                    least[k : k + 1] = [y]
                out[i] = k
            made = pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], ["group", "id", "x", "y", "front"])
            yield made if below is None else made.filter(pa.array(out < below))

    return run


def crowding(points: DataFrame, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """``points`` with ``crowd``: gaps between neighbours over the range, both objectives; null at the ends (infinitely far)."""
    parts = []
    all_ = Window.partitionBy(*by)
    for v in ("x", "y"):
        o = Window.partitionBy(*by).orderBy(v, "id")
        wide = F.max(v).over(all_) - F.min(v).over(all_)
        parts.append(F.when(wide > 0, (F.lead(v).over(o) - F.lag(v).over(o)) / wide).when(F.lead(v).over(o).isNotNull() & F.lag(v).over(o).isNotNull(), F.lit(0.0)))
    return points.withColumn("crowd", parts[0] + parts[1])


def survivors(ranked: DataFrame, n: int) -> DataFrame:
    """The n best of each group of ``ranked(group, id, x, y, front, crowd)``: whole fronts first, then the least crowded."""
    o = Window.partitionBy("group").orderBy("front", F.col("crowd").desc_nulls_first(), "id")
    return ranked.withColumn("place", F.row_number().over(o)).where(F.col("place") <= n)


def knee(points: DataFrame, weight: float) -> DataFrame:
    """The point of each group with the least weighted sum of y over its maximum and x's shortfall (x is minus a gain).

    A point of no gain comes last; of equals the lower y, then the id.
    """
    g = Window.partitionBy("group")
    gain = -F.col("x")
    top, most = F.max(gain).over(g), F.max("y").over(g)
    score = (1 - weight) * F.col("y") / most + weight * (1 - gain / top)
    scored = points.withColumn("score", F.when((gain <= 0) | (top <= 0) | (most <= 0), F.lit(None).cast("double")).otherwise(score))
    first = F.min(F.struct(F.col("score").isNull().alias("none"), F.round("score", 12).alias("r"), "y", "id", "x", "score"))
    return scored.groupBy("group").agg(first.alias("b")).select("group", "b.id", "b.x", "b.y", "b.score")


# -- on the driver


def ranks(p: np.ndarray) -> np.ndarray:
    """Front of each point of a small population."""
    out = np.full(len(p), -1, np.int32)
    le = (p[:, None, :] <= p[None, :, :]).all(2)
    dominates = le & (p[:, None, :] < p[None, :, :]).any(2)
    k = 0
    while (left := out < 0).any():
        free = left & ~(dominates & left[:, None]).any(0)
        out[free] = k
        k += 1
    return out


def distances(p: np.ndarray) -> np.ndarray:
    """Crowding distance within one front."""
    out = np.zeros(len(p))
    for v in p.T:
        o = np.argsort(v, kind="stable")
        wide = v[o[-1]] - v[o[0]] if len(o) else 0
        out[o[[0, -1]]] = np.inf
        if wide > 0 and len(o) > 2:
            out[o[1:-1]] += (v[o[2:]] - v[o[:-2]]) / wide
    return out
