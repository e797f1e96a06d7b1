"""Shapelets: scoring of candidates over all series, and a two-objective evolutionary search.

A candidate is scored by the best threshold on its distances, found by the
same scan as a numeric attribute.  Candidates are a bounded population (a few
hundred short arrays), so they go to every task; the series stay where they are.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as T
from . import pareto
from .splits import best_threshold, class_order, numeric_scan

#: Candidates scored in one job at most, and their values in all.
MOST, MOST_VALUES = 2000, 2_000_000
#: Differences that are held at once, and series whose distances one task sorts, about.
CELLS, PIECE = 2_000_000, 1_000_000


def distances(series: DataFrame, candidates: DataFrame, pad: bool = False) -> DataFrame:
    """(cand, sid, label, w, value) for every series and every candidate of ``candidates(cand, shapelet)``."""
    size = candidates.agg(F.count("*"), F.sum(F.size("shapelet"))).first()
    if size[0] > MOST or (size[1] or 0) > MOST_VALUES:
        raise ValueError("too many candidates for one job; score them in parts")
    d = T.distance_padded if pad else T.distance
    pairs = series.crossJoin(F.broadcast(candidates))  # one side is bounded by the checks above
    return pairs.select("cand", "sid", "label", "w", d(F.col("series"), F.col("shapelet")).alias("value"))


def population_distances(series: DataFrame, population: list[np.ndarray], pad: bool = True) -> DataFrame:
    """distances() for a search's population (cand: place in the list), over Arrow batches of series in numpy."""

    def run(batches):
        for pdf in batches:
            parts = []
            lengths = pdf["series"].map(len).to_numpy() if len(pdf) else np.zeros(0, int)
            stacks = [(at, np.stack(pdf["series"].iloc[at].to_numpy())) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]]
            for k, p in enumerate(population):
                v = np.empty(len(pdf))
                for at, rows in stacks:
                    if rows.shape[1] >= len(p):
                        step = max(1, CELLS // (len(p) * (rows.shape[1] - len(p) + 1)))
                        v[at] = np.concatenate([T.local_distances(rows[i : i + step], p) for i in range(0, len(rows), step)])
                    else:
                        v[at] = [T.local_distance(s, p, pad) for s in rows]
                parts.append(pd.DataFrame({"cand": k, "sid": pdf["sid"], "label": pdf["label"], "w": pdf["w"], "value": v}))
            if parts:
                yield pd.concat(parts)

    kind = series.schema["sid"].dataType.simpleString()
    return series.select("sid", "label", "w", "series").mapInPandas(run, f"cand long, sid {kind}, label string, w double, value double")


def score_candidates(series: DataFrame, candidates: DataFrame | list[np.ndarray], least: float = 2.0, use_mdl: bool = False, pad: bool = False, n: int = 0) -> DataFrame:
    """(cand, threshold, lower, candidates, raw_gain, gain) of each candidate's best threshold; ``n``: the number of series, where known.

    Null series weigh in the gain as unknown.
    """
    d = population_distances(series, candidates, pad) if isinstance(candidates, list) else distances(series, candidates, pad)
    return best_threshold(d, class_order(series, "label"), least, use_mdl, keys=("cand",), buckets=max(1, n // PIECE))


def candidate_scan(series: DataFrame, candidates: DataFrame, least: float = 2.0) -> DataFrame:
    return numeric_scan(distances(series, candidates), class_order(series, "label"), least, keys=("cand",), buckets=1)


def to_bits(x: float) -> np.ndarray:
    """The 64 bits of a double, sign first."""
    return np.unpackbits(np.frombuffer(struct.pack(">d", x), np.uint8))


def from_bits(b: np.ndarray) -> float:
    return struct.unpack(">d", np.packbits(b).tobytes())[0]


def mutate(values: np.ndarray, p: float, rng: np.random.Generator) -> np.ndarray:
    """With probability p flip bits, the j-th of each value less often the more it weighs; the result stays finite."""
    if rng.random() >= p:
        return values.copy()
    chance = p - p * np.log(65 - np.arange(1, 65)) / np.log(65)
    out = []
    for v in values:
        b = to_bits(v)
        flipped = b ^ (rng.random(64) < chance)
        out.append(from_bits(flipped if not flipped[1:12].all() else b))
    return np.array(out)


def cross(a: np.ndarray, b: np.ndarray, p: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """With probability p swap the tails after independent cuts."""
    if rng.random() >= p or min(len(a), len(b)) < 2:
        return a.copy(), b.copy()
    i, j = rng.integers(1, len(a)), rng.integers(1, len(b))
    return np.concatenate((a[:i], b[j:])), np.concatenate((b[:j], a[i:]))


@dataclass
class Found:
    shapelet: np.ndarray
    gain: float
    ratio: float
    threshold: float | None


def evaluate(series: DataFrame, population: list[np.ndarray], least: float, memo: dict[bytes, tuple[float, float | None]], n: int = 0) -> list[Found]:
    """Gain and compressibility of each; those seen before are not scored again."""
    new = {p.tobytes(): p for p in population if p.tobytes() not in memo}
    keys = list(new)
    for at in range(0, len(keys), MOST):
        part = keys[at : at + MOST]
        got = {r["cand"]: (r["raw_gain"], r["threshold"]) for r in score_candidates(series, [new[k] for k in part], least, pad=True, n=n).collect()}
        memo.update({k: got.get(i, (0.0, None)) for i, k in enumerate(part)})
    return [Found(p, memo[p.tobytes()][0], T.compression_ratio(p.tolist()), memo[p.tobytes()][1]) for p in population]


def search(series: DataFrame, population: int = 100, evaluations: int = 500, crossover: float = 0.8, mutation: float = 0.1, weight: float = 0.75, least: float = 2.0, seed: int = 1) -> Found | None:
    """The shapelet of the final front at the knee of gain and simplicity; None if none gains.

    Random stretches of random series, then generations of tournament, crossover,
    mutation and survival; one job a generation.  ``series(sid, label, w, series)``.
    """
    series = series.where("series is not null and size(series) > 0 and label is not null").persist()
    try:
        return _search(series, population, evaluations, crossover, mutation, weight, least, seed)
    finally:
        series.unpersist()


def _search(series: DataFrame, population: int, evaluations: int, crossover: float, mutation: float, weight: float, least: float, seed: int) -> Found | None:
    n, rng = series.count(), np.random.default_rng(seed)
    population += population % 2
    start = [np.array(r["series"], float) for r in series.select("series").orderBy(F.xxhash64("sid", F.lit(seed)), "sid").limit(population).collect()]
    if not start:
        return None
    pool = []
    for i in range(population):
        s = start[i % len(start)]
        b = int(rng.integers(0, len(s)))
        pool.append(s[b : int(rng.integers(b, len(s))) + 1])
    memo: dict[bytes, tuple[float, float | None]] = {}
    now, done = evaluate(series, pool, least, memo, n), population

    def judge(p: list[Found]) -> tuple[np.ndarray, np.ndarray]:
        o = np.array([(-f.gain, f.ratio) for f in p])
        r = pareto.ranks(o)
        c = np.zeros(len(p))
        for k in set(r.tolist()):
            c[r == k] = pareto.distances(o[r == k])
        return r, c

    rank, crowd = judge(now)
    while done < evaluations:
        young: list[np.ndarray] = []
        order = [*rng.permutation(population), *rng.permutation(population)]
        better = lambda i, j: i if (rank[i], -crowd[i]) < (rank[j], -crowd[j]) else j if (rank[i], -crowd[i]) > (rank[j], -crowd[j]) else (i, j)[int(rng.integers(2))]
        for k in range(0, 2 * population, 4):
            a, b = cross(now[better(order[k], order[k + 1])].shapelet, now[better(order[k + 2], order[k + 3])].shapelet, crossover, rng)
            young += [mutate(a, mutation, rng), mutate(b, mutation, rng)]
        both = now + evaluate(series, young, least, memo, n)
        done += len(young)
        rank, crowd = judge(both)
        keep = sorted(range(len(both)), key=lambda i: (rank[i], -crowd[i], i))[:population]
        now, rank, crowd = [both[i] for i in keep], rank[keep], crowd[keep]
    return knee([f for f, r in zip(now, rank, strict=True) if r == 0], weight)


def knee(front: list[Found], weight: float) -> Found | None:
    good = [f for f in front if f.gain > 0]
    if not good:
        return None
    top, most = max(f.gain for f in front), max(f.ratio for f in front)
    return min(good, key=lambda f: ((1 - weight) * f.ratio / most + weight * (1 - f.gain / top), f.ratio))
