"""Sequences of itemsets: text ``a,b>c>d`` and arrays of arrays, and containment of a pattern."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters an item may have in the textual form of containment.
ITEM = "[a-zA-Z0-9+*_-]"
Pattern = Sequence[Sequence[str]]


def parse(c: Column) -> Column:
    """Text to sorted itemsets; blanks do not count."""
    return F.transform(F.split(F.replace(c, F.lit(" "), F.lit("")), ">"), lambda s: F.array_sort(F.split(s, ",")))


def text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda s: F.array_join(s, ",")), ">")


def from_text(s: str) -> list[list[str]]:
    return [sorted(x.split(",")) for x in s.replace(" ", "").split(">")]


def to_text(p: Pattern) -> str:
    return ">".join(",".join(s) for s in p)


def regex(p: Pattern, gap: int) -> str:
    """A regular expression that finds the pattern in a sequence's text.

    With a gap of g at most g - 1 itemsets lie between two of the pattern's;
    without one (g <= 0) any number.  Items must be sorted and of ITEM.
    """
    item = f"{ITEM}+"
    skip = f"(?:{item}(?:,{item})*>){{0,{gap - 1}}}" if gap > 0 else f"(?:{item}(?:,{item})*>)*"
    sets = [f"(?:{item},)*" + f"(?:,{item})*,".join(map(re.escape, s)) + f"(?:,{item})*" for s in p]
    return "(?:^|>)" + (">" + skip).join(sets) + "(?:>|$)"


def contains_regex(c: Column, p: Pattern, gap: int) -> Column:
    return c.rlike(regex(p, gap))


def contains(c: Column, p: Pattern, gap: int) -> Column:
    """Whether itemsets p[0], p[1], ... are subsets of ever later itemsets of ``c``, each at most ``gap`` after the one before (any distance for gap <= 0).

    Folds the set of places where the pattern's beginning can end.
    """
    places = F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1)))

    def ends(s: Sequence[str]) -> Column:
        want = F.array(*[F.lit(i) for i in s])
        return F.filter(places, lambda i: (F.size(c) >= i) & (F.size(F.array_except(want, F.get(c, i - 1))) == 0))

    def after(before: Column):
        return lambda i: F.exists(before, lambda j: (i > j) & (i - j <= gap) if gap > 0 else i > j)

    at = ends(p[0])
    for s in p[1:]:
        at = F.filter(ends(s), after(at))
    return F.size(at) > 0


def contains_local(seq: Pattern, p: Pattern, gap: int) -> bool:
    """contains() on lists."""
    at = {i for i, s in enumerate(seq) if set(p[0]) <= set(s)}
    for want in p[1:]:
        at = {i for i, s in enumerate(seq) if set(want) <= set(s) and any(j < i and (gap <= 0 or i - j <= gap) for j in at)}
    return bool(at)


def strictly_contains(big: Pattern, small: Pattern) -> bool:
    """Whether ``small`` embeds in ``big`` in order, itemset by itemset, and is shorter."""
    k = 0
    for s in big:
        if k < len(small) and set(small[k]) <= set(s):
            k += 1
    return k == len(small) and sum(map(len, small)) < sum(map(len, big))
