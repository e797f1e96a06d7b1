"""Split statistics and split search on weighted rows, for all nodes and attributes of a level at once.

Rows are in long form ``(node, attr, value, label, w)``, one table for numeric
values (double) and one for nominal ones (string); a null value is unknown.
Class counts become one column a class, ``c0`` up, in the order of ``classes``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import criteria as C

#: Pieces into which a numeric attribute's values are cut for its running sums, at least.
BUCKETS = 16
#: Rows of a piece, about, where the number of rows is known; thresholds that are moved in one pass.
PIECE, PER_PASS = 1_000_000, 300
KEYS = ("node", "attr")


def buckets(rows: int) -> int:
    """Pieces for a table of so many rows."""
    return max(BUCKETS, -(-rows // PIECE))


def class_order(df: DataFrame, label: str) -> list[str]:
    """The class labels in order; a bounded number, as each becomes a column."""
    got = [r[0] for r in df.select(F.col(label).cast("string")).where(F.col(label).isNotNull()).distinct().limit(1001).collect()]
    if len(got) > 1000:
        raise ValueError("more than 1000 classes")
    return sorted(got)


def long_form(df: DataFrame, attrs: Sequence[str], kind: str, label: str, weight: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each row and attribute; ``kind`` is the value's type, double or string.  NaN counts as unknown."""
    cells = []
    for a in attrs:
        v = F.col(a).cast(kind)
        cells.append(F.struct(F.lit(a).alias("attr"), (F.when(~F.isnan(v), v) if kind == "double" else v).alias("value")))
    w = F.lit(1.0) if weight is None else weight
    return df.select(*keep, F.col(label).cast("string").alias("label"), w.cast("double").alias("w"), F.explode(F.array(*cells)).alias("cell")).select(*keep, "cell.attr", "cell.value", "label", "w")


def class_sums(classes: Sequence[str], w: str = "w") -> list[Column]:
    return [F.sum(F.when(F.col("label") == c, F.col(w)).otherwise(0.0)).alias(f"c{i}") for i, c in enumerate(classes)]


def counts(prefix: str, n: int) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(n)]


def distribution(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted contingency table: (keys, w)."""
    return df.groupBy(*keys).agg(F.sum("w").alias("w"))


def contingency(rows: DataFrame, classes: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, value, c0 ...): class counts of each value, unknown ones under null."""
    return rows.groupBy(*keys, "value").agg(*class_sums(classes))


def nominal_multiway(rows: DataFrame, classes: Sequence[str], arity: dict[str, int] | None = None, least: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, bags, big, gain, score, valid): one bag a value.

    The score is the gain over log2 of the attribute's arity: that of its domain
    if given, else the values seen.  Valid: two bags of at least ``least``.
    """
    n = len(classes)
    t = contingency(rows, classes, keys)
    own = C.total(counts("c", n))
    known = F.col("value").isNotNull()
    agg = t.groupBy(*keys).agg(
        F.sum(own).alias("weight"),
        F.sum(F.when(known, own).otherwise(0.0)).alias("known"),
        F.sum(F.when(known, C.bits(counts("c", n))).otherwise(0.0)).alias("new"),
        F.count(F.when(known, 1)).alias("bags"),
        F.count(F.when(known & (own >= least - C.EPS), 1)).alias("big"),
        *[F.sum(F.when(known, F.col(f"c{i}")).otherwise(0.0)).alias(f"k{i}") for i in range(n)],
    )
    size = F.col("bags")
    if arity:
        size = F.coalesce(F.create_map(*[x for k, v in arity.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])[F.col(keys[-1])], size)
    gain = C.gain(C.bits(counts("k", n)), F.col("new"), F.col("known"), F.col("weight"))
    return agg.withColumn("gain", gain).withColumn("arity", size).withColumn("score", F.when(size > 1, F.col("gain") / F.log2(size)).otherwise(F.lit(0.0))).withColumn("valid", F.col("big") > 1).select(*keys, "weight", "known", "bags", "big", "arity", "gain", "score", "valid")


def one_vs_rest(rows: DataFrame, classes: Sequence[str], least: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, value, gain, valid) of each split into one value and the rest."""
    n = len(classes)
    t = contingency(rows, classes, keys)
    all_ = t.groupBy(*keys).agg(F.sum(C.total(counts("c", n))).alias("weight"), *[F.sum(F.when(F.col("value").isNotNull(), F.col(f"c{i}")).otherwise(0.0)).alias(f"k{i}") for i in range(n)])
    j = t.where("value is not null").join(all_, list(keys))
    rest = [F.col(f"k{i}") - F.col(f"c{i}") for i in range(n)]
    known = C.total(counts("k", n))
    gain = C.gain(C.bits(counts("k", n)), C.bits(counts("c", n)) + C.bits(rest), known, F.col("weight"))
    big = (C.total(counts("c", n)) >= least - C.EPS) & (C.total(rest) >= least - C.EPS)
    return j.select(*keys, "value", gain.alias("gain"), big.alias("valid"))


def best_value(rows: DataFrame, classes: Sequence[str], least: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, value, gain): the best valid split into one value and the rest; of equals the first in order."""
    t = one_vs_rest(rows, classes, least, keys).where(f"valid and gain > {C.EPS}")
    best = F.min(F.struct((-F.round("gain", 12)).alias("g"), "value", "gain"))
    return t.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.value", "b.gain")


def class_gains(rows: DataFrame, classes: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, label, gain): each class against the rest, one bag a value."""
    n = len(classes)
    t = contingency(rows, classes, keys)
    own = C.total(counts("c", n))
    known = F.col("value").isNotNull()
    pair = [F.sum(F.when(known, C.bits([F.col(f"c{i}"), own - F.col(f"c{i}")])).otherwise(0.0)).alias(f"n{i}") for i in range(n)]
    a = t.groupBy(*keys).agg(F.sum(own).alias("weight"), F.sum(F.when(known, own).otherwise(0.0)).alias("known"), *pair, *[F.sum(F.when(known, F.col(f"c{i}")).otherwise(0.0)).alias(f"k{i}") for i in range(n)])
    each = [F.struct(F.lit(c).alias("label"), C.gain(C.bits([F.col(f"k{i}"), F.col("known") - F.col(f"k{i}")]), F.col(f"n{i}"), F.col("known"), F.col("weight")).alias("gain")) for i, c in enumerate(classes)]
    return a.select(*keys, F.explode(F.array(*each)).alias("x")).select(*keys, "x.label", "x.gain")


def numeric_scan(rows: DataFrame, classes: Sequence[str], least: float = 2.0, keys: Sequence[str] = KEYS, buckets: int = BUCKETS) -> DataFrame:
    """(keys, lower, upper, left, right, gain, weight, known, floor, n_rows) of every cut between two values more than 1e-5 apart.

    Running class counts over the sorted values: each attribute's values are cut
    at approximate quantiles into ``buckets`` pieces that sort and add up apart;
    the pieces' totals, a few rows an attribute, give each piece its offset.
    """
    n, keys = len(classes), list(keys)
    t = contingency(rows, classes, keys)
    sized = rows.groupBy(*keys).agg(F.sum("w").alias("weight"), F.count("value").alias("n_rows"), *[F.sum(F.when(F.col("value").isNotNull() & (F.col("label") == c), F.col("w")).otherwise(0.0)).alias(f"k{i}") for i, c in enumerate(classes)])
    known = t.where("value is not null")
    if buckets > 1:
        cuts = known.groupBy(*keys).agg(F.percentile_approx("value", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(1000)).alias("cuts"))
        known = known.join(cuts, keys).withColumn("bucket", F.size(F.filter("cuts", lambda x: x < F.col("value")))).drop("cuts")
    else:
        known = known.withColumn("bucket", F.lit(0))
    order = Window.partitionBy(*keys).orderBy("bucket")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pieces = known.groupBy(*keys, "bucket").agg(F.min("value").alias("low"), *[F.sum(f"c{i}").alias(f"s{i}") for i in range(n)])
    pieces = pieces.select(*keys, "bucket", F.lead("low").over(order).alias("next_low"), *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0.0)).alias(f"o{i}") for i in range(n)])
    inside = Window.partitionBy(*keys, "bucket").orderBy("value")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = known.join(pieces, [*keys, "bucket"])
    j = j.select(*keys, F.col("value").alias("lower"), F.coalesce(F.lead("value").over(inside), F.col("next_low")).alias("upper"), *[(F.col(f"o{i}") + F.sum(f"c{i}").over(run)).alias(f"l{i}") for i in range(n)])
    j = j.where(F.col("upper") > F.col("lower") + C.GAP).join(sized, keys)
    left, all_ = counts("l", n), counts("k", n)
    right = [a - b for a, b in zip(all_, left, strict=True)]
    size = C.total(all_)
    gain = C.gain(C.bits(all_), C.bits(left) + C.bits(right), size, F.col("weight"))
    return j.select(*keys, "lower", "upper", C.total(left).alias("left"), C.total(right).alias("right"), gain.alias("gain"), "weight", size.alias("known"), C.min_split(size, n, least).alias("floor"), "n_rows")


def midpoint(lower: Column, upper: Column) -> Column:
    """Halfway between two values, or the lower where that can't be told from the upper."""
    mid = (lower + upper) / 2
    return F.when(mid >= upper, lower).otherwise(mid)


def best_threshold(rows: DataFrame, classes: Sequence[str], least: float = 2.0, use_mdl: bool = True, keys: Sequence[str] = KEYS, buckets: int = BUCKETS) -> DataFrame:
    """(keys, threshold, lower, candidates, raw_gain, gain): the best cut of each numeric attribute.

    Cuts with less than ``floor`` on a side do not count; the gain is charged for
    the number of cuts that do.  ``gain`` may be 0 or less: then there is no split.
    """
    scan = numeric_scan(rows, classes, least, keys, buckets)
    fit = scan.where((F.col("left") >= F.col("floor") - C.EPS) & (F.col("right") >= F.col("floor") - C.EPS) & (F.col("n_rows") >= 2 * F.col("floor") - C.EPS))
    best = F.min(F.struct((-F.round("gain", 12)).alias("g"), "lower", "upper", "gain", "weight"))
    b = fit.groupBy(*keys).agg(F.count("*").alias("candidates"), best.alias("b"))
    charged = C.mdl(F.col("b.gain"), F.col("candidates"), F.col("b.weight")) if use_mdl else F.col("b.gain")
    return b.select(*keys, midpoint(F.col("b.lower"), F.col("b.upper")).alias("threshold"), F.col("b.lower").alias("lower"), "candidates", F.col("b.gain").alias("raw_gain"), charged.alias("gain"))


def relocate(df: DataFrame, thresholds: DataFrame, attrs: Sequence[str], keys: Sequence[str] = ("node", "attr")) -> DataFrame:
    """``thresholds(keys, threshold)`` with ``actual``: the largest value of the whole table that is not above.

    One row a split comes to the driver; each ``PER_PASS`` of them are maxima of one pass with partial sums, so no values move.
    """
    kinds = [thresholds.schema[k].dataType for k in (*keys, "threshold")]
    want = [r for r in thresholds.select(*keys, "threshold").collect() if r["attr"] in attrs]
    out = None
    for at in range(0, max(1, len(want)), PER_PASS):
        rows = []
        for r in want[at : at + PER_PASS]:
            v = F.col(r["attr"]).cast("double")
            given = [F.lit(r[k]).cast(kind).alias(k) for k, kind in zip((*keys, "threshold"), kinds, strict=True)]
            rows.append(F.struct(*given, F.max(F.when(~F.isnan(v) & (v <= r["threshold"] + C.EPS), v)).alias("actual")))
        got = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*").where("actual is not null") if rows else thresholds.select(*keys, "threshold", F.col("threshold").alias("actual")).limit(0)
        out = got if out is None else out.unionByName(got)
    return out
