"""Fitted trees as text, DOT, prefix form and SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.tree import Node, Tree


def _label(tree: Tree, n: Node) -> str:
    w, e = n.weight, n.errors()
    return f"{tree.prediction(n)} ({w:.1f}{f'/{e:.1f}' if e > 0 else ''})"


def text(tree: Tree) -> str:
    """One line a branch, indented by depth; leaves with their weight and errors; then leaves and size."""
    lines = []

    def dump(n: Node, depth: int) -> None:
        for i, c in enumerate(n.children):
            child = tree.nodes[c]
            lines.append("|   " * depth + n.split.condition(i) + (f": {_label(tree, child)}" if child.leaf else ""))
            if not child.leaf:
                dump(child, depth + 1)

    if tree.root.leaf:
        lines.append(f": {_label(tree, tree.root)}")
    dump(tree.root, 0)
    m = tree.measures()
    return "\n".join([*lines, "", f"Number of Leaves  : {m['measureNumLeaves']}", "", f"Size of the tree : {m['measureTreeSize']}"])


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def dot(tree: Tree) -> str:
    """A graph with nodes numbered from the root down, before their children."""
    number = {n.id: i for i, n in enumerate(tree.walk())}
    out = ["digraph tree {"]
    for n in tree.walk():
        out.append(f"N{number[n.id]} [label={_quoted(_label(tree, n) if n.leaf else n.split.attr)}{' shape=box style=filled' if n.leaf else ''}]")
        out += [f"N{number[n.id]}->N{number[c]} [label={_quoted(n.split.condition(i)[len(n.split.attr) :].strip() if n.split.kind != 'shapelet' else n.split.condition(i))}]" for i, c in enumerate(n.children)]
    return "\n".join([*out, "}"])


def prefix(tree: Tree, at: int = 0) -> str:
    n = tree.nodes[at]
    if n.leaf:
        return f"[{_label(tree, n)}]"
    return f"[{n.split.attr}: {', '.join(n.split.condition(i) for i in range(len(n.children)))} {' '.join(prefix(tree, c) for c in n.children)}]"


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql(tree: Tree, at: int = 0) -> str:
    """The prediction as a CASE over the columns; rows of unknown value take the node's own class.

    Patterns and shapelets have no portable SQL and raise.
    """
    n = tree.nodes[at]
    own = _literal(tree.prediction(n))
    if n.leaf:
        return own
    s = n.split
    col = '"' + s.attr.replace('"', '""') + '"'
    if s.kind == "threshold":
        test = [f"{col} - {s.threshold!r} < 1e-6", f"NOT ({col} - {s.threshold!r} < 1e-6)"]
    elif s.kind == "value":
        test = [f"{col} = {_literal(s.values[0])}", f"{col} <> {_literal(s.values[0])}"]
    elif s.kind == "values":
        test = [f"{col} = {_literal(v)}" for v in s.values]
    else:
        raise ValueError(f"a {s.kind} split has no SQL form")
    return f"CASE WHEN {col} IS NULL THEN {own} " + " ".join(f"WHEN {t} THEN {sql(tree, c)}" for t, c in zip(test, n.children, strict=True)) + f" ELSE {own} END"


def save(spark: SparkSession, tree: Tree, path: str) -> None:
    """The tree as a text table of one row, and beside it its node table."""
    spark.createDataFrame([(tree.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/tree")
    tree.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")


def load(spark: SparkSession, path: str) -> Tree:
    return Tree.from_json(spark.read.text(f"{path}/tree", wholetext=True).first()[0].strip())
