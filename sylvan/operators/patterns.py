"""Sequential patterns: id-lists, supports, extension steps, and a level-wise miner.

Sequences are ``(sid, label, seq)`` with seq an array of sorted itemsets; the
id-list has a row ``(sid, tid, item)`` for each item's place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import criteria as C
from ..functions import sequences as S


def id_list(seqs: DataFrame) -> DataFrame:
    """(sid, tid, item), each once; itemsets count from 1."""
    sets = seqs.where("seq is not null").select("sid", F.posexplode("seq").alias("t", "items"))
    return sets.select("sid", (F.col("t") + 1).alias("tid"), F.explode(F.array_distinct("items")).alias("item"))


def item_dictionary(ids: DataFrame) -> DataFrame:
    """(item, code): codes from 1 in order of the items."""
    return ids.select("item").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("item")))


def item_support(ids: DataFrame) -> DataFrame:
    return ids.select("sid", "item").distinct().groupBy("item").agg(F.count("*").alias("support"))


def min_support(share: float, n: int) -> int:
    return max(1, math.ceil(share * n))


def pairs(ids: DataFrame, later: bool) -> DataFrame:
    """(a, b, support): sequences with both in one itemset (a < b), or with b in an itemset after one with a."""
    a, b = ids.select("sid", F.col("tid").alias("t1"), F.col("item").alias("a")), ids.select("sid", F.col("tid").alias("t2"), F.col("item").alias("b"))
    if later:  # the first a and the last b of a sequence decide
        a, b = a.groupBy("sid", "a").agg(F.min("t1").alias("t1")), b.groupBy("sid", "b").agg(F.max("t2").alias("t2"))
    on = (F.col("t1") < F.col("t2")) if later else ((F.col("t1") == F.col("t2")) & (F.col("a") < F.col("b")))
    return a.join(b, "sid").where(on).select("sid", "a", "b").distinct().groupBy("a", "b").agg(F.count("*").alias("support"))


def s_step(ends: DataFrame, ids: DataFrame, gap: int) -> DataFrame:
    """Places (pattern columns, sid, tid, item) of one more itemset after ``ends(sid, tid, ...)``, at most ``gap`` on."""
    nxt = ids.select("sid", F.col("tid").alias("tid2"), F.col("item").alias("item2"))
    near = F.col("tid2") > F.col("tid")
    return ends.join(nxt, "sid").where(near & (F.col("tid2") - F.col("tid") <= gap) if gap > 0 else near)


def i_step(ends: DataFrame, ids: DataFrame) -> DataFrame:
    """Places of one more item, greater than the last, in the itemset where ``ends(sid, tid, item)`` end."""
    nxt = ids.select("sid", F.col("tid"), F.col("item").alias("item2"))
    return ends.join(nxt, ["sid", "tid"]).where("item2 > item")


def step_support(steps: DataFrame) -> DataFrame:
    """(a, b, support) of two-item patterns."""
    return steps.select("sid", F.col("item").alias("a"), F.col("item2").alias("b")).distinct().groupBy("a", "b").agg(F.count("*").alias("support"))


def match_gain(matched: DataFrame, keys: list[str], sizes: DataFrame, classes: list[str]) -> DataFrame:
    """(keys, support, gain, ova): class entropy less that given the match, over all classes and for each class against the rest.

    ``matched(keys, label, n)`` counts matching sequences, ``sizes(label, n)`` all of them; rows, not weights.
    """
    n = len(classes)
    total = {r["label"]: float(r["n"]) for r in sizes.collect()}  # one number a class
    t = matched.groupBy(*keys).agg(*[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).cast("double").alias(f"c{i}") for i, c in enumerate(classes)])
    all_ = [F.lit(total.get(c, 0.0)) for c in classes]
    own = [F.col(f"c{i}") for i in range(n)]
    rest = [a - b for a, b in zip(all_, own, strict=True)]
    whole, hit = F.lit(sum(total.values())), C.total(own)

    def two(x: Column, of: Column) -> Column:
        return C.bits([x, of - x])

    ova = F.array(*[(two(a, whole) - two(c, hit) - two(r, whole - hit)) / whole for a, c, r in zip(all_, own, rest, strict=True)])
    return t.select(*keys, hit.cast("bigint").alias("support"), ((C.bits(all_) - C.bits(own) - C.bits(rest)) / whole).alias("gain"), ova.alias("ova"))


@dataclass(frozen=True)
class Mined:
    pattern: tuple[tuple[str, ...], ...]
    support: int
    gain: float
    one_vs_all: tuple[float, ...] = ()  # a gain a class, in order
    generator: bool = True  # no pattern within it, the empty one included, matches the same sequences

    @property
    def length(self) -> int:
        return sum(map(len, self.pattern))

    def text(self) -> str:
        return S.to_text(self.pattern)


def most_gain(p: float, support: float) -> float:
    """The most that a pattern of this support, or any that matches fewer, can gain about a class of share ``p``.

    The bound grows with the support up to the smaller of the class and the rest, where it is the whole entropy.
    """
    whole = C.num_bits([p, 1 - p])
    return whole if support >= min(p, 1 - p) else whole - C.entropy_bound(p, support)


def mine(seqs: DataFrame, support: float = 0.5, gap: int = 2, longest: int = 20, generators: bool = True, min_gain: float | dict[str, float] = 0.0, most_level: int = 100_000) -> list[Mined]:
    """Frequent patterns with their gains, level by level in items.

    Each level extends all places where last level's patterns end, in one job,
    and keeps the patterns of enough support under the gap limit.  With
    ``generators`` a pattern goes that ends in the very places where a pattern it
    strictly contains does: whatever extends it matches what the shorter one's
    extension matches.  One that matches the same sequences in other places
    stays, as under a gap its extensions may match others.  A pattern is not
    extended when neither it nor anything rarer can gain more than ``min_gain``
    (one number, or one a class) about any class.  Per-pattern totals come to the
    driver, at most ``most_level`` a level; places stay distributed.  Single items
    are scored whatever their support and come first by their gains' sum.
    """
    seqs = seqs.where("seq is not null and label is not null")
    sizes = seqs.groupBy("label").agg(F.count("*").alias("n")).persist()
    held = [sizes]
    try:
        return _mine(seqs, sizes, support, gap, longest, generators, min_gain, most_level, held)
    finally:
        for df in held:
            df.unpersist()


def _mine(seqs: DataFrame, sizes: DataFrame, support: float, gap: int, longest: int, generators: bool, min_gain: float | dict[str, float], most_level: int, held: list[DataFrame]) -> list[Mined]:
    per = {r["label"]: r["n"] for r in sizes.collect()}
    classes, n = sorted(per), sum(per.values())
    if not n:
        return []
    least = [min_gain.get(c, 0.0) if isinstance(min_gain, dict) else min_gain for c in classes]
    need = min_support(support, n)
    ids = id_list(seqs).join(seqs.select("sid", "label"), "sid").persist()
    held.append(ids)
    plain = ids.drop("label")
    ends = ids.select(F.col("item").alias("pattern"), "sid", "label", "tid", "item")
    found: list[Mined] = []
    by_sids: dict[tuple[int, int], list[tuple[tuple[str, ...], ...]]] = {}
    by_places: dict[tuple[int, int], list[tuple[tuple[str, ...], ...]]] = {}
    for length in range(1, longest + 1):
        ends = ends.persist()
        held.append(ends)
        hit = ends.groupBy("pattern", "sid", "label").agg(F.count("*").alias("k"), F.expr("bit_xor(xxhash64(sid, tid))").alias("p"))
        marks = hit.groupBy("pattern").agg(F.expr("bit_xor(xxhash64(sid))").alias("sids"), F.sum("k").alias("k"), F.expr("bit_xor(p)").alias("places"))
        scored = match_gain(hit.groupBy("pattern", "label").agg(F.count("*").alias("n")), ["pattern"], sizes, classes).join(marks, "pattern")
        frequent = scored.where((F.col("support") >= need) | F.lit(length == 1)).limit(most_level + 1).collect()
        if len(frequent) > most_level:
            raise ValueError(f"more than {most_level} patterns of {length} items; raise the support")
        if length > 1:  # the level before has been extended
            held.pop(-2).unpersist()
        grow = []
        for r in sorted(frequent, key=lambda r: (-round(sum(r["ova"]), 12) if length == 1 else 0, r["pattern"])):
            p = tuple(tuple(s.split(",")) for s in r["pattern"].split(">"))
            same, there = by_sids.setdefault((r["support"], r["sids"]), []), by_places.setdefault((r["k"], r["places"]), [])
            if generators and any(S.strictly_contains(p, q) for q in there):
                continue
            found.append(Mined(p, r["support"], r["gain"], tuple(r["ova"]), r["support"] < n and not any(S.strictly_contains(p, q) for q in same)))
            same.append(p)
            there.append(p)
            may = any(most_gain(per[c] / n, r["support"] / n) > g for c, g in zip(classes, least, strict=True))
            if r["support"] >= need and r["support"] > 1 and may:
                grow.append((r["pattern"],))
        if not grow or length == longest:
            break
        open_ = ends.join(F.broadcast(seqs.sparkSession.createDataFrame(grow, "pattern string")), "pattern")  # at most most_level
        s = s_step(open_, plain, gap).select(F.concat("pattern", F.lit(">"), "item2").alias("pattern"), "sid", "label", F.col("tid2").alias("tid"), F.col("item2").alias("item"))
        i = i_step(open_, plain).select(F.concat("pattern", F.lit(","), "item2").alias("pattern"), "sid", "label", "tid", F.col("item2").alias("item"))
        ends = s.unionByName(i).distinct()
        enough = ends.select("pattern", "sid").distinct().groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= need)
        ends = ends.join(enough.select("pattern"), "pattern")
    return found


def pick(found: list[Mined], weight: float = 0.75) -> Mined | None:
    """The pattern with the best trade of gain against length; the shorter of equals.

    Of each length the pattern that gains most about each class is a candidate, of
    these the one that gains most about all; gains count against the most that
    any pattern gains about a class.
    """
    if not found:
        return None
    longest = max(m.length for m in found)
    lead: dict[tuple[int, int], Mined] = {}
    ova = lambda m: m.one_vs_all or (m.gain,)
    for m in sorted(found, key=lambda m: m.text()):
        for c, g in enumerate(ova(m)):
            if (m.length, c) not in lead or g > ova(lead[m.length, c])[c]:
                lead[m.length, c] = m
    top = max(ova(m)[c] for (_, c), m in lead.items())
    best: dict[int, Mined] = {}
    for (length, _), m in sorted(lead.items(), key=lambda x: x[0]):
        if length not in best or m.gain > best[length].gain:
            best[length] = m
    score = lambda m: weight * (1 - m.gain / (top if top > 0 else 1.0)) + (1 - weight) * m.length / longest
    return min(best.values(), key=lambda m: (score(m), m.length))
