"""Time series as arrays of doubles: parsing, subsequence distance, warping distance, compressibility."""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distances keep five decimals, cut off, and end here.
TOP = 2147483647


def parse(c: Column) -> Column:
    return F.transform(F.split(c, ","), lambda v: F.trim(v).cast("double"))


def cut(c: Column) -> Column:
    return F.floor(F.least(c * 1e5, F.lit(float(TOP)))) / F.lit(1e5)


def _nearest(series: Column, shapelet: Column) -> Column:
    """Least Euclidean distance of ``shapelet`` to a stretch of ``series``, which is at least as long."""
    m = F.size(shapelet)

    def at(i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0.0), lambda s, k: s + F.pow(F.get(series, i + k) - F.get(shapelet, k), F.lit(2.0)))

    return cut(F.sqrt(F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size(series) - m, F.lit(0))), at))))


def distance(series: Column, shapelet: Column) -> Column:
    """Subsequence distance; of two lengths the shorter slides along the longer."""
    longer, shorter = F.when(F.size(series) >= F.size(shapelet), series).otherwise(shapelet), F.when(F.size(series) >= F.size(shapelet), shapelet).otherwise(series)
    return F.when((F.size(series) > 0) & (F.size(shapelet) > 0), _nearest(longer, shorter))


def distance_padded(series: Column, shapelet: Column) -> Column:
    """Subsequence distance; a series shorter than the shapelet is filled up with zeros."""
    missing = F.greatest(F.size(shapelet) - F.size(series), F.lit(0))
    full = F.concat(series, F.array_repeat(F.lit(0.0), missing))
    return F.when(F.size(shapelet) > 0, _nearest(full, shapelet))


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def local_cut(d: np.ndarray | float) -> np.ndarray:
    return np.floor(np.minimum(np.asarray(d) * 1e5, TOP)) / 1e5


def local_distance(series: Sequence[float], shapelet: Sequence[float], pad: bool = False) -> float:
    a, b = np.asarray(series, float), np.asarray(shapelet, float)
    if len(a) < len(b):
        a, b = (np.concatenate((a, np.zeros(len(b) - len(a)))), b) if pad else (b, a)
    w = np.lib.stride_tricks.sliding_window_view(a, len(b))
    return float(local_cut(np.sqrt(((w - b) ** 2).sum(1)).min()))


def local_distances(series: np.ndarray, shapelet: np.ndarray) -> np.ndarray:
    """Distances of equally long series (rows) to one shapelet, which is no longer."""
    w = np.lib.stride_tricks.sliding_window_view(series, len(shapelet), axis=1)
    return local_cut(np.sqrt(((w - shapelet) ** 2).sum(2)).min(1))


def dtw(a: Sequence[float], b: Sequence[float]) -> float:
    """Dynamic time warping distance with squared steps, row by row."""
    x, y = np.asarray(a, float), np.asarray(b, float)
    row = np.concatenate(([0.0], np.full(len(y), np.inf)))
    for v in x:
        cost = (y - v) ** 2
        new = np.full(len(y) + 1, np.inf)
        for j in range(len(y)):
            new[j + 1] = cost[j] + min(row[j], row[j + 1], new[j])
        row = new
    return float(local_cut(np.sqrt(row[-1])))


def dtw_nearest(series: Sequence[float], shapelet: Sequence[float]) -> float:
    """Least warping distance of the shapelet to a window of its length, all windows at once; a shorter series is one window."""
    a, b = np.asarray(series, float), np.asarray(shapelet, float)
    w = np.lib.stride_tricks.sliding_window_view(a, min(len(a), len(b)))
    row = np.full((len(w), len(b) + 1), np.inf)
    row[:, 0] = 0
    for k in range(w.shape[1]):
        cost = (w[:, k : k + 1] - b) ** 2
        new = np.full_like(row, np.inf)
        for j in range(len(b)):
            new[:, j + 1] = cost[:, j] + np.minimum(np.minimum(row[:, j], row[:, j + 1]), new[:, j])
        row = new
    return float(local_cut(np.sqrt(row[:, -1].min())))


def dtw_udf(shapelet: Sequence[float]):
    @F.pandas_udf("double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(lambda v: dtw_nearest(v, shapelet) if v is not None and len(v) else None)

    return run


def compression_ratio(values: Sequence[float]) -> float:
    """Compressed over plain length of the values' text; lower is simpler."""
    raw = ",".join(map(str, values))
    return len(gzip.compress(raw.encode(), mtime=0)) / max(len(raw), 1)


def compression_udf():
    @F.pandas_udf("double")
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda v: compression_ratio([float(x) for x in v]))

    return run
