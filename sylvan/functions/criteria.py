"""Split criteria over class counts: Column builders, and the same on the driver's numbers.

Counts come as one column (or number) per class.  x ln x is 0 below 1e-6, and a
gain within 1e-6 of nothing is 0, so that tiny weights do not decide.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
GAP = 1e-5
LN2 = math.log(2.0)


def total(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def xlnx(c: Column) -> Column:
    return F.when(c < EPS, F.lit(0.0)).otherwise(c * F.ln(c))


def bits(counts: Sequence[Column]) -> Column:
    """Weighted entropy in bits, not divided by the weight."""
    return (xlnx(total(counts)) - total([xlnx(c) for c in counts])) / F.lit(LN2)


def gain(old: Column, new: Column, known: Column, weight: Column) -> Column:
    """Information gain from unnormalised entropies; rows of unknown value lower it in proportion."""
    diff = old - new
    return F.when((F.abs(diff) < EPS) | (known < EPS), F.lit(0.0)).otherwise((known / weight) * diff / known)


def min_split(known: Column, n_classes: int, least: float) -> Column:
    """A tenth of the mean class weight, but at least ``least`` and at most 25."""
    tenth = F.lit(0.1) * known / F.lit(float(n_classes))
    return F.when(tenth <= least, F.lit(float(least))).when(tenth > 25, F.lit(25.0)).otherwise(tenth)


def mdl(score: Column, candidates: Column, weight: Column) -> Column:
    """The gain less what it costs to name one of the thresholds."""
    return score - F.log2(candidates) / weight


def laplace(count: Column, bag: Column, n_classes: int) -> Column:
    return (count + 1) / (bag + n_classes)


def entropy_bound(p: float, t: float) -> float:
    """Least conditional entropy of a binary class of share ``p`` given a feature of support ``t``."""

    def h(q: float) -> float:
        return 0.0 if q <= 0 or q >= 1 else -q * math.log2(q) - (1 - q) * math.log2(1 - q)

    if t <= 0 or t >= 1:
        return h(p)
    inside = min(1.0, p / t)  # the feature holds the class as far as it can
    outside = max(0.0, (p - t) / (1 - t)) if p > t else 0.0
    first = t * h(inside) + (1 - t) * h(outside)
    q = 1 - p  # or the other class
    inside = min(1.0, q / t)
    outside = max(0.0, (q - t) / (1 - t)) if q > t else 0.0
    return min(first, t * h(inside) + (1 - t) * h(outside))


# -- the same on plain numbers


def num_xlnx(x: float) -> float:
    return 0.0 if x < EPS else x * math.log(x)


def num_bits(counts: Sequence[float]) -> float:
    return (num_xlnx(sum(counts)) - sum(map(num_xlnx, counts))) / LN2


def info_gain(bags: Sequence[Sequence[float]], weight: float | None = None) -> float:
    """Information gain of bags of class counts; ``weight`` counts rows of unknown value too."""
    known = sum(map(sum, bags))
    weight = known if weight is None else weight
    old = num_bits([sum(c) for c in zip(*bags, strict=True)])
    diff = old - sum(map(num_bits, bags))
    return 0.0 if abs(diff) < EPS or known < EPS else (known / weight) * diff / known


def split_info(bags: Sequence[Sequence[float]]) -> float:
    """Entropy of the bag sizes, per unit of weight."""
    sizes = [sum(b) for b in bags]
    return num_bits(sizes) / sum(sizes) if sum(sizes) > 0 else 0.0


def add_errs(n: float, e: float, cf: float) -> float:
    """Errors to add to e seen in n for the upper confidence limit at ``cf``."""
    if cf > 0.5:
        return 0.0
    if e < 1:
        base = n * (1 - cf ** (1 / n))
        return base if e == 0 else base + e * (add_errs(n, 1.0, cf) - base)
    if e + 0.5 >= n:
        return max(n - e, 0.0)
    z = NormalDist().inv_cdf(1 - cf)
    f = (e + 0.5) / n
    upper = (f + z * z / (2 * n) + z * math.sqrt(f / n - f * f / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return upper * n - e


def add_errs_col(n: Column, e: Column, cf: float) -> Column:
    """add_errs() as an expression; n must be positive."""
    z = NormalDist().inv_cdf(1 - cf)
    base = n * (1 - F.pow(F.lit(cf), 1 / n))

    def upper(e: Column) -> Column:
        f = (e + 0.5) / n
        root = F.sqrt(F.greatest(f / n - f * f / n + z * z / (4 * n * n), F.lit(0.0)))
        return F.when(e + 0.5 >= n, F.greatest(n - e, F.lit(0.0))).otherwise((f + z * z / (2 * n) + z * root) / (1 + z * z / n) * n - e)

    if cf > 0.5:
        return F.lit(0.0)
    return F.when(e == 0, base).when(e < 1, base + e * (upper(F.lit(1.0)) - base)).otherwise(upper(e))
