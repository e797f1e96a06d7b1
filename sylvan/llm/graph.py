"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import collect_garbage, drop, in_batches, materialise

#: Edges that one task connects by itself at most; more go through the steps.
SMALL = 100_000


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    own = low.select("u", F.col("m").alias("v"))
    rest = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).distinct()


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of all edges, held in memory; a root is its tree's smallest node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            root[max(a, c)] = min(a, c)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], ["node", "comp"])


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, comp) for every node of ``edges(u, v)``; comp is the component's smallest node.

    Each step's edges go to the shared folder; only two totals come to the
    driver.  The number of steps is logarithmic in the longest chain.  Loops
    (u = v) are ignored; no edges give no rows.  Up to ``SMALL`` edges need no
    steps, whose many plans cost the driver more memory than such edges do.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if e.count() <= SMALL:
        return in_batches(e.coalesce(1), _connect, "node long, comp long")
    mark = None
    for _ in range(max_steps):
        new = materialise(_small_star(_large_star(e)), "edges")
        drop(e)
        e = new
        del new
        collect_garbage(e.sparkSession)  # many small shuffles, each a file for every task
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))
