"""Scoring with a fitted tree.

Each split's branch is one column expression; a row's weight then travels down
the tree level by level in an array of (node, weight), split where a value is
unknown.  No row is multiplied and nothing is shuffled, the expressions grow
with the number of nodes alone, and batch and streaming DataFrames take the same
plan.  Rows must be normalised (see tree.normalise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree import Node, Tree

_B, _P, _V = "_branches", "_paths", "_visited"


def shares(n: Node) -> list[float]:
    total = sum(n.shares)
    return [s / total if total > 0 else 0.0 for s in n.shares]


def _array(values: list) -> Column:
    return F.array(*[_array(v) if isinstance(v, list) else F.lit(v) for v in values])


def route(df: DataFrame, tree: Tree) -> DataFrame:
    """``df`` with ``_paths``, the leaves that a row's weight reaches, and ``_visited``, all nodes on the way."""
    nodes = list(tree.walk())
    place = {n.id: i for i, n in enumerate(nodes)}
    inner = [n for n in nodes if not n.leaf]
    at = {n.id: i for i, n in enumerate(inner)}
    start = F.array(F.struct(F.lit(place[0]).alias("node"), F.lit(1.0).alias("w")))
    if not inner:
        return df.withColumn(_P, start).withColumn(_V, start)
    which = _array([at.get(n.id, -1) for n in nodes])
    kids = _array([[place[c] for c in n.children] for n in inner])
    parts = _array([shares(n) for n in inner])
    df = df.withColumn(_B, F.array(*[n.split.branch().cast("int") for n in inner])).withColumn(_P, start).withColumn(_V, start)

    def step(p: Column) -> Column:
        k = F.get(which, p["node"])
        b = F.get(F.col(_B), k)
        all_ = F.filter(F.zip_with(F.get(kids, k), F.get(parts, k), lambda c, s: F.struct(c.alias("node"), (p["w"] * s).alias("w"))), lambda x: x["w"] > 0)
        one = F.array(F.struct(F.get(F.get(kids, k), b).alias("node"), p["w"].alias("w")))
        return F.when(k < 0, F.array(p)).when(b.isNull(), all_).otherwise(one)

    depth, level = 0, [tree.root]
    while any(not n.leaf for n in level):
        level = [tree.nodes[c] for n in level for c in n.children]
        depth += 1
    for _ in range(depth):
        df = df.withColumn(_P, F.flatten(F.transform(_P, step)))
        df = df.withColumn(_V, F.array_union(_V, _P))
    return df.drop(_B)


def _ids(tree: Tree) -> Column:
    return _array([n.id for n in tree.walk()])


def with_probabilities(df: DataFrame, tree: Tree, out: str) -> DataFrame:
    """``df`` with an array of class probabilities, in the order of ``tree.classes``."""
    table = _array([tree.probabilities(n, tree.options.laplace) for n in tree.walk()])
    none = F.array_repeat(F.lit(0.0), len(tree.classes))
    total = F.aggregate(F.col(_P), none, lambda acc, p: F.zip_with(acc, F.get(table, p["node"]), lambda a, q: a + p["w"] * q))
    return route(df, tree).withColumn(out, total).drop(_P, _V)


def with_leaf(df: DataFrame, tree: Tree, out: str = "leaf") -> DataFrame:
    """``df`` with the id of the leaf that a row reaches whole; null for a row whose weight splits."""
    one = F.when(F.size(_P) == 1, F.get(_ids(tree), F.get(F.col(_P), 0)["node"]))
    return route(df, tree).withColumn(out, one).drop(_P, _V)


def predict_proba(df: DataFrame, tree: Tree, out: str = "probability") -> DataFrame:
    """``df`` with a map from class to probability."""
    return with_probabilities(df, tree, "_prob").withColumn(out, F.map_from_arrays(_array(tree.classes), F.col("_prob"))).drop("_prob")


def predict(df: DataFrame, tree: Tree, out: str = "prediction") -> DataFrame:
    """``df`` with the likeliest class; of those within 1e-6 the first."""
    near = F.array_position(F.transform("_prob", lambda x: x > F.array_max("_prob") - 1e-6), True)
    return with_probabilities(df, tree, "_prob").withColumn(out, F.get(_array(tree.classes), (near - 1).cast("int"))).drop("_prob")


def membership(df: DataFrame, tree: Tree, keep: list[str], weight: Column | None = None) -> DataFrame:
    """(keep, node, w): the weight that each row brings to each node it reaches, the root first."""
    own = F.lit(1.0) if weight is None else weight
    rows = route(df, tree).select(*keep, own.alias("_own"), F.explode(_V).alias("v"))
    return rows.select(*keep, F.get(_ids(tree), F.col("v.node")).alias("node"), (F.col("_own") * F.col("v.w")).alias("w")).where("w > 0")
