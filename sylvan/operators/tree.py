"""Decision trees on mixed columns: level-wise fit, pruning, and the node table.

All open nodes of a level are split by the same few jobs; only a node's class
counts and its winning split come to the driver.  Rows carry their node's id and
weight; a row of unknown value goes to every child with its part of the weight.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import criteria as C
from ..functions import sequences as S
from ..functions import series as TS
from . import patterns, shapelets, splits

KINDS = ("nominal", "numeric", "seq", "ts")


@dataclass(frozen=True)
class Options:
    """Settings, with the usual defaults; contradictory ones raise."""

    unpruned: bool = False
    collapse: bool = True
    confidence: float = 0.25
    least: float = 2.0
    reduced_error: bool = False
    folds: int = 3
    binary: bool = False
    raising: bool = True
    laplace: bool = False
    mdl: bool = True
    relocate: bool = True
    support: float = 0.5
    gap: int = 2
    longest: int = 20
    pattern_weight: float = 0.75
    gain_pruning: bool = False
    population: int = 100
    evaluations: int = 500
    crossover: float = 0.8
    mutation: float = 0.1
    seed: int = 1
    max_depth: int | None = None  # levels; no limit

    def __post_init__(self) -> None:
        if self.unpruned and not self.raising:
            raise ValueError("an unpruned tree has no subtree raising to leave out")
        if self.unpruned and self.reduced_error:
            raise ValueError("an unpruned tree has no reduced-error pruning")
        if not 0 < self.confidence < 1:
            raise ValueError("confidence must be between 0 and 1")
        if self.folds < 2:
            raise ValueError("reduced-error pruning takes at least two folds")


def infer_kinds(df: DataFrame, label: str, kinds: dict[str, str] | None = None) -> dict[str, str]:
    """The kind of each feature column: as given, else by name prefix (SEQ_, TS_), else by type.

    Other columns raise: arrays, maps, structs and intervals have no kind.
    """
    out = {}
    for f in df.schema.fields:
        if f.name == label or kinds is not None and f.name not in kinds:
            continue
        k = (kinds or {}).get(f.name)
        if k is None:
            numeric = isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType))
            k = "seq" if f.name.startswith("SEQ_") else "ts" if f.name.startswith("TS_") else "numeric" if numeric else "nominal" if isinstance(f.dataType, (T.StringType, T.BooleanType)) else None
        if k not in KINDS:
            raise ValueError(f"column {f.name} of type {f.dataType.simpleString()} has no kind")
        out[f.name] = k
    return out


def normalise(df: DataFrame, label: str, kinds: dict[str, str]) -> DataFrame:
    """Features as double, string, array of itemsets or array of doubles; NaN as null; dates as seconds."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = kinds.get(f.name)
        if kind == "numeric":
            c = F.unix_micros(c.cast("timestamp")) / 1e6 if isinstance(f.dataType, (T.DateType, T.TimestampType)) else c.cast("double")
            c = F.when(~F.isnan(c), c)
        elif kind == "seq":
            c = S.parse(c) if isinstance(f.dataType, T.StringType) else c
        elif kind == "ts":
            c = TS.parse(c) if isinstance(f.dataType, T.StringType) else c.cast("array<double>")
        elif kind == "nominal" or f.name == label:
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


@dataclass(frozen=True)
class Split:
    """How a node's rows are dealt to its children; branches are numbered from 0."""

    kind: str  # value, values, threshold, pattern, shapelet
    attr: str
    values: tuple[str, ...] = ()  # one a branch (values), or the one against the rest (value)
    threshold: float | None = None
    pattern: str | None = None
    gap: int = 0
    shapelet: tuple[float, ...] = ()

    @property
    def arity(self) -> int:
        return len(self.values) if self.kind == "values" else 2

    def branch(self, df_cols: dict[str, Column] | None = None) -> Column:
        """Branch of a normalised row; null if unknown."""
        c = (df_cols or {}).get(self.attr, F.col(f"`{self.attr}`"))
        if self.kind == "values":
            at = F.array_position(F.array(*[F.lit(v) for v in self.values]), c)
            return F.when(at > 0, (at - 1).cast("int"))
        if self.kind == "value":
            return F.when(c.isNotNull(), F.when(c == self.values[0], 0).otherwise(1))
        if self.kind == "threshold":
            return F.when(c.isNotNull(), F.when(c - self.threshold < C.EPS, 0).otherwise(1))
        if self.kind == "pattern":
            return F.when(c.isNotNull(), S.contains(c, S.from_text(self.pattern), self.gap).cast("int"))
        d = TS.distance(c, TS.literal(self.shapelet))
        return F.when(d.isNotNull(), F.when(d - self.threshold < C.EPS, 0).otherwise(1))

    def condition(self, branch: int) -> str:
        if self.kind == "values":
            return f"{self.attr} = {self.values[branch]}"
        if self.kind == "value":
            return f"{self.attr} {'=' if branch == 0 else '!='} {self.values[0]}"
        if self.kind == "threshold":
            return f"{self.attr} {'<=' if branch == 0 else '>'} {round(self.threshold, 6):g}"
        if self.kind == "pattern":
            return f"{self.attr} {'contains' if branch else 'lacks'} {self.pattern} (gap {self.gap})"
        return f"dist({self.attr}, [{', '.join(f'{v:g}' for v in self.shapelet)}]) {'<=' if branch == 0 else '>'} {round(self.threshold, 6):g}"


@dataclass
class Node:
    id: int
    parent: int | None
    branch: int | None
    counts: list[float]  # class weights of the rows that reached it
    split: Split | None = None
    shares: list[float] = field(default_factory=list)  # weight in each branch, unknown rows included
    children: list[int] = field(default_factory=list)
    held: list[float] = field(default_factory=list)  # class weights of the pruning fold

    @property
    def weight(self) -> float:
        return sum(self.counts)

    @property
    def leaf(self) -> bool:
        return self.split is None

    def errors(self) -> float:
        return self.weight - max(self.counts, default=0.0)


@dataclass
class Tree:
    classes: list[str]
    kinds: dict[str, str]
    nodes: dict[int, Node]
    options: Options

    @property
    def root(self) -> Node:
        return self.nodes[0]

    def walk(self, at: int = 0) -> Iterator[Node]:
        """Nodes before their children."""
        stack = [at]
        while stack:
            n = self.nodes[stack.pop()]
            yield n
            stack += reversed(n.children)

    def measures(self) -> dict[str, int]:
        all_ = list(self.walk())
        leaves = sum(n.leaf for n in all_)
        return {"measureTreeSize": len(all_), "measureNumLeaves": leaves, "measureNumRules": leaves}

    def measure(self, name: str) -> int:
        found = {k.lower(): v for k, v in self.measures().items()}
        if name.lower() not in found:
            raise ValueError(f"{name} is not a measure")
        return found[name.lower()]

    def prediction(self, n: Node) -> str:
        """The first of a node's largest classes; of an empty node its parent's."""
        while n.weight <= 0 and n.parent is not None:
            n = self.nodes[n.parent]
        return self.classes[max(range(len(self.classes)), key=lambda i: (n.counts[i], -i))]

    def probabilities(self, n: Node, laplace: bool = False) -> list[float]:
        """Class shares; an empty node has its parent's."""
        while n.weight <= 0 and n.parent is not None:
            n = self.nodes[n.parent]
        k = len(self.classes)
        if n.weight <= 0:
            return [1 / k] * k
        return [(c + 1) / (n.weight + k) if laplace else c / n.weight for c in n.counts]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n.id, n.parent, n.branch, json.dumps(asdict(n.split)) if n.split else None, n.split.attr if n.split else None, float(n.weight), [float(c) for c in n.counts], n.leaf, n.weight <= 0, self.prediction(n)) for n in self.walk()]
        return spark.createDataFrame(rows, "node int, parent int, branch int, split string, attr string, weight double, counts array<double>, is_leaf boolean, is_empty boolean, prediction string")

    def to_json(self) -> str:
        return json.dumps({"classes": self.classes, "kinds": self.kinds, "options": asdict(self.options), "nodes": [asdict(n) for n in self.walk()]})

    @staticmethod
    def from_json(text: str) -> Tree:
        d = json.loads(text)
        nodes = {}
        for n in d["nodes"]:
            s = n.pop("split")
            split = Split(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items()}) if s else None
            nodes[n["id"]] = Node(**n, split=split)
        return Tree(d["classes"], d["kinds"], nodes, Options(**d["options"]))

    def _drop_below(self, n: Node) -> None:
        for c in list(self.walk(n.id))[1:]:
            self.nodes.pop(c.id, None)
        n.children = []

    def make_leaf(self, n: Node) -> None:
        self._drop_below(n)
        n.split, n.shares = None, []


def _deal(rows: DataFrame, chosen: dict[int, tuple[Split, list[float], list[int]]]) -> DataFrame:
    """Rows of the nodes that split, moved to their children; rows of other nodes go."""
    parts = []
    for node, (split, shares, kids) in chosen.items():
        total = sum(shares)
        b = split.branch()
        unknown = F.array(*[F.struct(F.lit(k).alias("to"), F.lit(s / total).alias("part")) for k, s in zip(kids, shares, strict=True) if s > 0])
        known = F.array(F.struct(F.element_at(F.array(*[F.lit(k) for k in kids]), b + 1).alias("to"), F.lit(1.0).alias("part")))
        parts.append((node, F.when(b.isNull(), unknown).otherwise(known)))
    out = rows.where(F.col("node").isin(list(chosen))).withColumn("_to", F.explode(by_node(parts)))
    return out.withColumn("node", F.col("_to.to")).withColumn("w", F.col("w") * F.col("_to.part")).where("w > 0").drop("_to")


def by_node(parts: list[tuple[int, Column]]) -> Column:
    """The column of a row's node, as one flat CASE."""
    out = None
    for node, c in parts:
        out = F.when(F.col("node") == node, c) if out is None else out.when(F.col("node") == node, c)
    return out


def _counts(rows: DataFrame, classes: list[str]) -> dict[int, list[float]]:
    got = rows.groupBy("node").agg(*splits.class_sums(classes)).collect()
    return {r["node"]: [r[f"c{i}"] for i in range(len(classes))] for r in got}


def _candidates(rows: DataFrame, open_: dict[int, Node], tree: Tree, domains: dict[str, list[str]], n_rows: int) -> dict[int, list[tuple[float, int, int, Split]]]:
    """For each open node its valid splits as (score, -phase, -attribute's place, split)."""
    o, classes, out = tree.options, tree.classes, {n: [] for n in open_}
    place = {a: i for i, a in enumerate(tree.kinds)}
    of = {k: [a for a, x in tree.kinds.items() if x == k] for k in KINDS}
    if of["nominal"]:
        longs = splits.long_form(rows, of["nominal"], "string", "label", F.col("w"), keep=("node",))
        if o.binary:
            for r in splits.best_value(longs, classes, o.least).collect():
                out[r["node"]].append((r["gain"], 0, -place[r["attr"]], Split("value", r["attr"], (r["value"],))))
        else:
            arity = {a: len(d) for a, d in domains.items()}
            for r in splits.nominal_multiway(longs, classes, arity, o.least).where(f"valid and gain > {C.EPS}").collect():
                out[r["node"]].append((r["score"], 0, -place[r["attr"]], Split("values", r["attr"], tuple(domains[r["attr"]]))))
    if of["numeric"]:
        longs = splits.long_form(rows, of["numeric"], "double", "label", F.col("w"), keep=("node",))
        for r in splits.best_threshold(longs, classes, o.least, o.mdl, buckets=splits.buckets(n_rows)).where(f"gain > {C.EPS}").collect():
            out[r["node"]].append((r["gain"], 0, -place[r["attr"]], Split("threshold", r["attr"], threshold=r["threshold"])))
    if not of["seq"] and not of["ts"]:
        return out
    for node, n in open_.items():
        mine = rows.where(F.col("node") == node)
        base = _class_gains(mine, max(out[node], key=lambda c: c[:3])[3], classes) if o.gain_pruning and of["seq"] and out[node] else 0.0
        for a in of["seq"]:
            seqs = mine.select(F.col("row_id").alias("sid"), "label", F.col(f"`{a}`").alias("seq"))
            best = patterns.pick(patterns.mine(seqs, o.support, o.gap, o.longest, min_gain=base), o.pattern_weight)
            if best and best.gain > C.EPS:
                out[node].append((best.gain, -1, -place[a], Split("pattern", a, pattern=best.text(), gap=o.gap)))
        for a in of["ts"]:
            s = mine.select(F.col("row_id").alias("sid"), "label", "w", F.col(f"`{a}`").alias("series"))
            best = shapelets.search(s, o.population, o.evaluations, o.crossover, o.mutation, o.pattern_weight, o.least, o.seed * 1_000_003 + node * 1009 + place[a])
            if best is None:
                continue
            cand = rows.sparkSession.createDataFrame([(0, [float(v) for v in best.shapelet])], "cand long, shapelet array<double>")
            r = shapelets.score_candidates(s, cand, o.least, o.mdl, n=n_rows).first()
            if r is not None and r["gain"] > C.EPS:
                out[node].append((r["gain"], -2, -place[a], Split("shapelet", a, threshold=r["threshold"], shapelet=tuple(float(v) for v in best.shapelet))))
    return out


def _class_gains(rows: DataFrame, split: Split, classes: list[str]) -> dict[str, float]:
    """The gain of a split about each class against the rest."""
    bags = rows.select(F.lit(split.attr).alias("attr"), split.branch().cast("string").alias("value"), "label", "w")
    return {r["label"]: r["gain"] for r in splits.class_gains(bags, classes, ("attr",)).collect()}


def _grow(rows: DataFrame, held: DataFrame | None, whole: DataFrame, tree: Tree, domains: dict[str, list[str]]) -> None:
    o = tree.options
    open_ = dict(tree.nodes)
    made, n_rows = len(tree.nodes), whole.count()
    kept: list[DataFrame] = []
    for _ in count() if o.max_depth is None else range(o.max_depth):
        open_ = {k: n for k, n in open_.items() if n.weight >= 2 * o.least - C.EPS and n.errors() > C.EPS}
        if not open_:
            break
        rows = rows.where(F.col("node").isin(list(open_))).persist()
        kept.append(rows)
        found = {k: max(v, key=lambda c: c[:3]) for k, v in _candidates(rows, open_, tree, domains, n_rows).items() if v}
        while len(kept) > 1:  # this level is held, so the one before is not needed
            kept.pop(0).unpersist()
        if not found:
            break
        chosen: dict[int, Split] = {k: c[3] for k, c in found.items()}
        moved = {k: s for k, s in chosen.items() if s.kind == "threshold"}
        if o.relocate and moved:
            t = rows.sparkSession.createDataFrame([(k, s.attr, float(s.threshold)) for k, s in moved.items()], "node int, attr string, threshold double")
            for r in splits.relocate(whole, t, sorted({s.attr for s in moved.values()})).collect():
                chosen[r["node"]] = replace(chosen[r["node"]], threshold=r["actual"])
        sizes: dict[int, list[float]] = {}
        branch = by_node([(k, s.branch()) for k, s in chosen.items()])
        for r in rows.where(F.col("node").isin(list(chosen))).groupBy("node", branch.alias("b")).agg(F.sum("w").alias("w")).collect():
            if r["b"] is not None:
                sizes.setdefault(r["node"], [0.0] * chosen[r["node"]].arity)[r["b"]] = r["w"]
        step: dict[int, tuple[Split, list[float], list[int]]] = {}
        for k, s in chosen.items():
            part = sizes.get(k, [])
            if sum(x >= o.least - C.EPS for x in part) < 2:
                continue
            n = open_[k]
            lost = n.weight - sum(part)
            n.split = s
            n.shares = [x + lost * x / sum(part) for x in part]
            n.children = list(range(made, made + s.arity))
            made += s.arity
            step[k] = (s, part, n.children)
        if not step:
            break
        rows = _deal(rows, step)
        counts = _counts(rows, tree.classes)
        seen = {}
        if held is not None:
            held = _deal(held, step)
            seen = _counts(held, tree.classes)
        open_ = {}
        for k, (_, _, kids) in step.items():
            for b, c in enumerate(kids):
                none = [0.0] * len(tree.classes)
                tree.nodes[c] = open_[c] = Node(c, k, b, counts.get(c, none), held=seen.get(c, none))
    for d in kept:
        d.unpersist()


def _errors_below(tree: Tree, n: Node) -> float:
    return sum(x.errors() for x in tree.walk(n.id) if x.leaf)


def collapse(tree: Tree, n: Node) -> None:
    """A subtree that does not lower the training errors becomes a leaf."""
    if n.leaf:
        return
    if _errors_below(tree, n) >= n.errors() - 1e-3:
        tree.make_leaf(n)
    else:
        for c in n.children:
            collapse(tree, tree.nodes[c])


def estimated(counts: list[float], cf: float) -> float:
    """Errors of a leaf at its upper confidence limit."""
    n = sum(counts)
    e = n - max(counts, default=0.0)
    return e + C.add_errs(n, e, cf) if n > 0 else 0.0


def _estimated_below(tree: Tree, n: Node) -> float:
    return sum(estimated(x.counts, tree.options.confidence) for x in tree.walk(n.id) if x.leaf)


def _through(rows: DataFrame, tree: Tree, at: int) -> dict[int, list[float]]:
    """Class counts of all nodes from ``at`` down for ``rows`` dealt from there."""
    out: dict[int, list[float]] = {}
    now = rows.withColumn("node", F.lit(at))
    level = [at]
    while level:
        out |= _counts(now, tree.classes)
        step = {k: (tree.nodes[k].split, tree.nodes[k].shares, tree.nodes[k].children) for k in level if not tree.nodes[k].leaf}
        if not step:
            break
        now = _deal(now, step)
        level = [c for _, _, kids in step.values() for c in kids]
    return out


def _rows_at(tree: Tree, rows: DataFrame, at: int) -> DataFrame:
    """Rows that reach a node, with the weight they have there."""
    path = []
    n = tree.nodes[at]
    while n.parent is not None:
        path.append(n)
        n = tree.nodes[n.parent]
    now = rows.withColumn("node", F.lit(0))
    for n in reversed(path):
        p = tree.nodes[n.parent]
        now = _deal(now, {p.id: (p.split, p.shares, p.children)}).where(F.col("node") == n.id)
    return now


def prune(tree: Tree, n: Node, rows: DataFrame) -> None:
    """Error-based, bottom up: a subtree becomes a leaf, or its largest branch takes its place."""
    if n.leaf:
        return
    for c in list(n.children):
        prune(tree, tree.nodes[c], rows)
    as_leaf, as_tree = estimated(n.counts, tree.options.confidence), _estimated_below(tree, n)
    largest = max(range(len(n.children)), key=lambda i: (tree.nodes[n.children[i]].weight, i))
    child = tree.nodes[n.children[largest]]
    as_branch, counts = float("inf"), {}
    if tree.options.raising and not child.leaf and as_leaf > as_tree + 0.1:
        counts = _through(_rows_at(tree, rows, n.id), tree, child.id)
        as_branch = sum(estimated(counts.get(x.id, [0.0]), tree.options.confidence) for x in tree.walk(child.id) if x.leaf)
    if as_leaf <= as_tree + 0.1 and as_leaf <= as_branch + 0.1:
        tree.make_leaf(n)
    elif as_branch <= as_tree + 0.1:
        keep = {x.id for x in tree.walk(child.id)}
        for x in list(tree.walk(n.id))[1:]:
            if x.id not in keep:
                tree.nodes.pop(x.id)
        for x in keep:
            tree.nodes[x].counts = counts.get(x, [0.0] * len(tree.classes))
        n.split, n.children, n.counts = child.split, child.children, child.counts
        n.shares = [tree.nodes[c].weight for c in n.children]
        for c in n.children:
            tree.nodes[c].parent = n.id
        tree.nodes.pop(child.id)
        prune(tree, n, rows)


def prune_by_fold(tree: Tree, n: Node) -> float:
    """Reduced-error, bottom up; the errors on the held fold that remain below ``n``."""
    own = sum(n.held) - n.held[tree.classes.index(tree.prediction(n))] if n.held else 0.0
    if n.leaf:
        return own
    below = sum(prune_by_fold(tree, tree.nodes[c]) for c in n.children)
    if own <= below + C.EPS:
        tree.make_leaf(n)
        return own
    return below


def folds(df: DataFrame, label: str, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """``df`` with ``fold`` from 0: each class dealt evenly, by a hash of the row's key."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(label)), F.lit(n)).cast("int"))


def fit(df: DataFrame, label: str, kinds: dict[str, str] | None = None, weight: str | None = None, options: Options | None = None) -> Tree:
    """Fit a tree to ``df``.  Rows of null label do not count; a null or NaN feature is unknown."""
    o = options or Options()
    kinds = infer_kinds(df.drop(weight) if weight else df, label, kinds)
    base = normalise(df.where(F.col(label).isNotNull()), label, kinds)
    data = base.select(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in base.columns]).alias("row_id"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.col(label).alias("label"), *[F.col(f"`{a}`") for a in kinds]).withColumn("node", F.lit(0))
    if any(k in ("seq", "ts") for k in kinds.values()):
        data = data.withColumn("row_id", F.xxhash64("row_id", F.monotonically_increasing_id()))
    data = data.persist()
    classes = splits.class_order(data, "label")
    domains = {a: [r[0] for r in data.select(f"`{a}`").where(F.col(f"`{a}`").isNotNull()).distinct().orderBy(F.col(f"`{a}`")).limit(10_001).collect()] for a, k in kinds.items() if k == "nominal"}
    if any(len(d) > 10_000 for d in domains.values()):
        raise ValueError("a nominal column has more than 10000 values")
    grow, held = data, None
    if o.reduced_error:
        dealt = folds(data, "label", o.folds, o.seed)
        grow, held = dealt.where(F.col("fold") < o.folds - 1).drop("fold"), dealt.where(F.col("fold") == o.folds - 1).drop("fold")
    tree = Tree(classes, kinds, {}, o)
    none = [0.0] * len(classes)
    tree.nodes[0] = Node(0, None, None, _counts(grow, classes).get(0, none), held=_counts(held, classes).get(0, none) if held is not None else [])
    if classes:
        _grow(grow, held, data, tree, domains)
        if o.reduced_error:
            prune_by_fold(tree, tree.root)
        else:
            if o.collapse:
                collapse(tree, tree.root)
            if not o.unpruned:
                prune(tree, tree.root, grow)
    data.unpersist()
    return tree
