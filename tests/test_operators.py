"""Split search, unknown values, patterns, fronts: properties and brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from sylvan.functions import criteria as C
from sylvan.functions import sequences as S
from sylvan.operators import missing, pareto, patterns, shapelets, splits
from sylvan.operators.tree import Split


def brute_best(rows, classes, least=2.0):
    """Best cut of (value, label, w) by trying each."""
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    weight, w = sum(r[2] for r in rows), sum(r[2] for r in known)
    floor = min(max(0.1 * w / len(classes), least), 25.0)
    values, best, n = sorted({r[0] for r in known}), None, 0
    for a, b in zip(values, values[1:]):
        if b - a <= 1e-5:
            continue
        bags = [[sum(r[2] for r in known if (r[0] <= a) == side and r[1] == c) for c in classes] for side in (True, False)]
        if min(map(sum, bags)) < floor or len(known) < 2 * floor:
            continue
        n += 1
        g = C.info_gain(bags, weight)
        if best is None or g > best[1] + 1e-12:
            best = (a, g)
    return best and (*best, n)


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_numeric_search(spark, buckets):
    r = random.Random(buckets)
    rows = [(0, "x", None if r.random() < 0.1 else r.choice([1.0, 2.0, 2.000001, 3.5, 7.0, 9.0, -4.0]) + r.randrange(6), r.choice("abc"), r.choice([1.0, 0.5])) for _ in range(400)]
    rows += [(1, "x", 1.0, "a", 1.0)] * 5 + [(2, "x", None, "a", 1.0)] * 3
    df = spark.createDataFrame(rows, "node int, attr string, value double, label string, w double").repartition(4)
    got = {x.node: x for x in splits.best_threshold(df, ["a", "b", "c"], use_mdl=False, buckets=buckets).collect()}
    want = brute_best([x[2:] for x in rows if x[0] == 0], ["a", "b", "c"])
    assert set(got) == {0}
    assert (got[0].lower, got[0].candidates) == (want[0], want[2]) and got[0].gain == pytest.approx(want[1])


def test_nan_is_unknown_and_order_does_not_matter(spark):
    r = random.Random(9)
    df = spark.createDataFrame([(float("nan") if i % 9 == 0 else float(r.randrange(20)), r.choice("ab")) for i in range(300)], "v double, label string")
    a = splits.best_threshold(splits.long_form(df, ["v"], "double", "label"), ["a", "b"], keys=("attr",)).first()
    b = splits.best_threshold(splits.long_form(df.repartition(7, "v"), ["v"], "double", "label"), ["a", "b"], keys=("attr",)).first()
    assert tuple(a) == tuple(b)


def test_routing_keeps_the_weight(spark):
    r = random.Random(5)
    rows = [(None if r.random() < 0.3 else r.random() * 10, r.choice("ab"), r.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "v double, label string, w double")
    out = missing.route(df, Split("threshold", "v", threshold=4.0).branch(), [0.25, 0.75]).collect()
    assert sum(x.w for x in out) == pytest.approx(sum(x[2] for x in rows))
    assert sum(x.w for x in out if x.v is None and x.bag == 0) == pytest.approx(0.25 * sum(x[2] for x in rows if x[0] is None))


def test_unknown_mass(spark):
    rows = [("p", "a", 3.0), ("q", "b", 1.0), (None, "a", 4.0)]
    got = {(x.bag, x.label): x.w for x in missing.bag_counts(spark.createDataFrame(rows, "bag string, label string, w double")).collect()}
    assert got == {("p", "a"): 6.0, ("q", "b"): 1.0, ("q", "a"): 1.0}


def random_sequences(n, seed):
    r = random.Random(seed)
    return [(i, r.choice("yn"), [sorted(r.sample("abc", r.randrange(1, 3))) for _ in range(r.randrange(1, 6))]) for i in range(n)]


@pytest.mark.parametrize("gap", [0, 1, 2])
def test_mined_patterns(spark, gap):
    seqs = random_sequences(60, gap)
    df = spark.createDataFrame(seqs, "sid long, label string, seq array<array<string>>")
    found = patterns.mine(df, support=0.3, gap=gap, longest=3, generators=False)
    assert len({m.pattern for m in found}) == len(found)
    per = Counter(x[1] for x in seqs)
    for m in found:
        hit = Counter(x[1] for x in seqs if S.contains_local(x[2], m.pattern, gap))
        assert sum(hit.values()) == m.support and (m.support >= 18 or m.length == 1)
        bags = [[hit[c] for c in per], [per[c] - hit[c] for c in per]]
        assert m.gain == pytest.approx(C.info_gain(bags), abs=1e-6)
    names = {m.text() for m in found}
    for a in "abc":  # every frequent pattern of two items is there
        for b in "abc":
            for p in ([[a], [b]], [[a, b]] if a < b else None):
                if p and sum(S.contains_local(x[2], p, gap) for x in seqs) >= 18:
                    assert S.to_text(p) in names
    assert patterns.pick(found) is not None and patterns.pick([]) is None


def brute_patterns(seqs, need, gap, longest):
    """Every frequent pattern of up to ``longest`` items, with the sequences it matches."""
    items = sorted({i for _, _, s in seqs for x in s for i in x})
    level, out = [((i,),) for i in items], {}
    for _ in range(longest):
        hit = {p: frozenset(sid for sid, _, s in seqs if S.contains_local(s, p, gap)) for p in level}
        hit = {p: h for p, h in hit.items() if len(h) >= need}
        out |= hit
        level = [q for p in hit for i in items for q in ((*p, (i,)), *([(*p[:-1], (*p[-1], i))] if i > p[-1][-1] else []))]
    return out


@pytest.mark.parametrize(("gap", "classes"), [(0, "yn"), (1, "yn"), (2, "xyz"), (0, "xyz")])
def test_every_frequent_pattern_has_a_found_one_that_matches_the_same(spark, gap, classes):
    r = random.Random(10 * gap + len(classes))
    seqs = [(i, r.choice(classes), [sorted(r.sample("abcd", r.randrange(1, 3))) for _ in range(r.randrange(1, 6))]) for i in range(30)]
    df = spark.createDataFrame(seqs, "sid long, label string, seq array<array<string>>")
    found = patterns.mine(df, support=0.2, gap=gap, longest=3)
    of = {m.pattern: frozenset(sid for sid, _, s in seqs if S.contains_local(s, m.pattern, gap)) for m in found}
    want = brute_patterns(seqs, 6, gap, 3)
    for p, h in want.items():
        assert any(of[m.pattern] == h and m.length <= sum(map(len, p)) for m in found), p
    per = Counter(c for _, c, _ in seqs)
    for m in found:
        hit = Counter(c for sid, c, _ in seqs if sid in of[m.pattern])
        assert m.support == len(of[m.pattern])
        for c, g in zip(sorted(per), m.one_vs_all, strict=True):
            rest = len(seqs) - per[c]
            bags = [[hit[c], m.support - hit[c]], [per[c] - hit[c], rest - m.support + hit[c]]]
            assert g == pytest.approx(C.info_gain(bags), abs=1e-6)
    assert {m.pattern for m in found} <= {m.pattern for m in patterns.mine(df, 0.2, gap, 3, generators=False)}


@pytest.mark.parametrize("labels", ["xxxyy", "xxxyz"])
@pytest.mark.parametrize("least", [0.0, 0.5])
def test_a_pattern_whose_beginnings_gain_little_is_found(spark, labels, least):
    texts = ["a>c>b>f>c>d"] * 3 + ["c>d>g>h>a>c>b>f>c"] * 2
    seqs = [(i, c, S.from_text(s)) for i, (c, s) in enumerate(zip(labels, texts, strict=True))]
    df = spark.createDataFrame(seqs, "sid long, label string, seq array<array<string>>")
    found = {m.text(): m for m in patterns.mine(df, support=0.5, gap=2, longest=4, min_gain=least)}
    assert found["b>c>d"].gain == pytest.approx(0.9709505944546686, abs=1e-9)


def test_the_bound_holds_for_all_rarer_patterns():
    n = 12
    for k in range(1, n):
        for s in range(1, n + 1):
            most = max(C.info_gain([[h, t - h], [k - h, n - k - t + h]]) for t in range(1, s + 1) for h in range(max(0, t - n + k), min(k, t) + 1))
            assert patterns.most_gain(k / n, s / n) >= most - 1e-9


def test_the_pick_weighs_classes_apart():
    m = lambda t, g, ova: patterns.Mined(tuple(tuple(x.split(",")) for x in t.split(">")), 5, g, ova)
    # Of one item, a leads for the first class and b for the second; b gains more about all; c leads for none.
    found = [m("a", 0.2, (0.4, 0.1)), m("b", 0.3, (0.1, 0.35)), m("c", 0.5, (0.3, 0.3)), m("a>b", 0.31, (0.5, 0.2))]
    assert patterns.pick(found, 0.75).text() == "b"
    assert patterns.pick(found, 1.0).text() == "a>b"
    assert patterns.pick([m("a", 0.0, (0.0, 0.0))]).text() == "a"


def test_relocated_thresholds(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 7), (None, 9), (float("nan"), 11), (3.5, None)], "x double, y int")
    t = spark.createDataFrame([(1, "x", 2.9), (2, "x", 3.5), (3, "y", 8.0), (4, "x", 0.5)], "node int, attr string, threshold double")
    got = {r.node: (r.attr, r.threshold, r.actual) for r in splits.relocate(df, t, ["x", "y"]).collect()}
    assert got == {1: ("x", 2.9, 2.0), 2: ("x", 3.5, 3.5), 3: ("y", 8.0, 7.0)}
    assert splits.relocate(df, t.limit(0), ["x"]).collect() == []


def test_population_distances_of_mixed_lengths(spark):
    r = np.random.default_rng(4)
    rows = [(i, "a", 1.0, r.random(int(n)).tolist()) for i, n in enumerate(r.integers(1, 9, 40))]
    df = spark.createDataFrame(rows, "sid long, label string, w double, series array<double>")
    pop = [r.random(n) for n in (1, 3, 6, 12)]
    got = {(x.cand, x.sid): x.value for x in shapelets.population_distances(df, pop).collect()}
    from sylvan.functions import series as T

    assert got == {(k, sid): T.local_distance(s, p, True) for k, p in enumerate(pop) for sid, _, _, s in rows}


def test_fronts(spark):
    r = random.Random(8)
    pts = [(r.choice("gh"), i, float(r.randrange(12)), float(r.randrange(12))) for i in range(150)]
    df = spark.createDataFrame(pts, "group string, id long, x double, y double")
    dom = lambda a, b: a[0] == b[0] and a[2] <= b[2] and a[3] <= b[3] and a[2:] != b[2:]
    want = {p[1] for p in pts if not any(dom(q, p) for q in pts)}
    assert {x.id for x in pareto.front(df).collect()} == want
    assert {x.id for x in pareto.fronts(df).where("front = 0").collect()} == want
    d = pareto.distances(np.array([[0.0, 3.0], [1.0, 2.0], [3.0, 0.0]]))
    assert d.tolist() == [np.inf, 2.0, np.inf]


def test_all_fronts_of_large_and_odd_groups(spark):
    r = random.Random(9)
    pts = [(r.choice("gh"), i, float(r.randrange(9)), r.choice([-1.5, 0.0, 2.0, 7.25, float("inf")])) for i in range(300)]
    df = spark.createDataFrame(pts, "group string, id long, x double, y double").repartition(5)
    want = {}
    for g in "gh":
        own = [p for p in pts if p[0] == g]
        want |= dict(zip([p[1] for p in own], pareto.ranks(np.array([p[2:] for p in own])).tolist(), strict=True))
    assert {x.id: x.front for x in pareto.fronts(df).collect()} == want
    assert {x.id: x.front for x in pareto.fronts(df, 3).collect()} == {i: k for i, k in want.items() if k < 3}
    odd = [("g", 0, 1.0, 1.0), ("g", 1, None, 2.0), (None, 2, 9.0, 9.0), (None, 3, 1.0, 1.0), ("g", 4, 1.0, float("nan")), ("g", 5, 2.0, 3.0), ("g", 6, 2.0, float("nan"))]
    df = spark.createDataFrame(odd, "group string, id long, x double, y double")
    assert {x.id: x.front for x in pareto.fronts(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2}
    big = spark.range(200_000).selectExpr("'g' as group", "id", "cast(id % 50 as double) as x", "cast(id % 7919 as double) as y")  # a matrix of all pairs has 40 GB
    got = pareto.fronts(big, 20).groupBy("front").count().collect()
    assert sorted(x.front for x in got) == list(range(20)) and pareto.fronts(big).count() == 200_000


def test_shapelet_search_is_reproducible(spark):
    r = random.Random(6)
    rows = [(i, "ab"[i % 2], 1.0, [r.random() + (3 if i % 2 and 5 <= k < 9 else 0) for k in range(15)]) for i in range(40)]
    df = spark.createDataFrame(rows, "sid long, label string, w double, series array<double>")
    a, b = (shapelets.search(df, population=8, evaluations=16, seed=3) for _ in range(2))
    assert a.gain > 0.5 and a.shapelet.tolist() == b.shapelet.tolist()


def test_variation_keeps_values_finite():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v = shapelets.mutate(np.array([1.0, -2.5, 0.0]), 1.0, rng)
        assert np.isfinite(v).all() and len(v) == 3
    assert shapelets.from_bits(shapelets.to_bits(-3.25)) == -3.25
