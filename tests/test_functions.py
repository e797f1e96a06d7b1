"""Criteria, sequence and series functions against golden values and definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sylvan.functions import criteria as C
from sylvan.functions import sequences as S
from sylvan.functions import series as TS


@pytest.mark.parametrize(
    "n,e,cf,want",
    [(14, 5, 0.25, 1.761119807), (6, 0, 0.25, 1.237796844), (6, 0.5, 0.25, 1.270651701), (6, 1, 0.25, 1.303506558), (100, 10, 0.25, 2.749611451), (3, 2.6, 0.25, 0.4), (14, 5, 0.1, 2.878602932), (10, 1, 0.6, 0)],
)
def test_added_errors(spark, n, e, cf, want):
    assert C.add_errs(n, e, cf) == pytest.approx(want, abs=1e-8)
    got = spark.range(1).select(C.add_errs_col(F.lit(float(n)), F.lit(float(e)), cf).alias("x")).first()["x"]
    assert got == pytest.approx(want, abs=1e-8)


def test_gains():
    bags = [[2, 3], [4, 0], [3, 2]]
    assert C.info_gain(bags) == pytest.approx(0.246749820, abs=1e-8)
    assert C.info_gain(bags, 16) == pytest.approx(0.215906092, abs=1e-8)
    assert C.info_gain(bags) / math.log2(3) == pytest.approx(0.155681803, abs=1e-8)
    assert C.info_gain([[5, 0], [0, 5]]) == pytest.approx(1.0)
    assert math.log2(7) / 14 == pytest.approx(0.200525352, abs=1e-8)
    r = random.Random(1)
    for _ in range(200):
        assert C.info_gain([[r.randrange(9) for _ in range(3)] for _ in range(4)]) >= 0


def test_entropy_bound_is_one():
    """No feature of the support leaves less conditional entropy than the bound."""
    r = random.Random(2)
    for _ in range(300):
        n, pos, t = 40, r.randrange(1, 40), r.randrange(1, 40)
        h = lambda a, b: 0 if not a or not b else -(a * math.log2(a / (a + b)) + b * math.log2(b / (a + b))) / n
        least = min(h(k, t - k) + h(pos - k, n - t - pos + k) for k in range(max(0, t + pos - n), min(t, pos) + 1))
        assert C.entropy_bound(pos / n, t / n) <= least + 1e-9


@pytest.mark.parametrize(
    "seq,pattern,gap,want",
    [("a,b,c>x>d", "a,c>d", 2, True), ("a,b,c>x>y>d", "a,c>d", 2, False), ("a,b,c>x>y>d", "a,c>d", 0, True), ("a,d", "a>d", 2, False), ("a>b>a>c", "a>c", 1, True), ("ab>c", "b>c", 1, False)],
)
def test_containment(spark, seq, pattern, gap, want):
    p = S.from_text(pattern)
    df = spark.createDataFrame([(seq,)], "t string").withColumn("s", S.parse(F.col("t")))
    r = df.select(S.contains_regex(F.col("t"), p, gap).alias("a"), S.contains(F.col("s"), p, gap).alias("b")).first()
    assert (r.a, r.b, S.contains_local(S.from_text(seq), p, gap)) == (want, want, want)


def test_forms_of_containment_agree(spark):
    r = random.Random(3)
    make = lambda n: [sorted(r.sample("abcd", r.randrange(1, 4))) for _ in range(r.randrange(1, n))]
    seqs = [make(7) for _ in range(120)]
    df = spark.createDataFrame([(S.to_text(s), s) for s in seqs], "t string, s array<array<string>>")
    for gap in range(4):
        for _ in range(4):
            p = make(4)
            got = df.select(S.contains_regex(F.col("t"), p, gap).alias("a"), S.contains(F.col("s"), p, gap).alias("b")).collect()
            want = [S.contains_local(s, p, gap) for s in seqs]
            assert [x.a for x in got] == want == [x.b for x in got]


@pytest.mark.parametrize(
    "series,shapelet,swap,pad", [([1, 2, 3, 4, 5], [2.5, 3.5], 0.7071, 0.7071), ([1, 2], [5, 1, 2.5], 0.5, 4.82182), ([0], [1e9], 21474.83647, 21474.83647)]
)
def test_distances(spark, series, shapelet, swap, pad):
    df = spark.createDataFrame([([float(v) for v in series],)], "s array<double>")
    r = df.select(TS.distance(F.col("s"), TS.literal(shapelet)).alias("a"), TS.distance_padded(F.col("s"), TS.literal(shapelet)).alias("b")).first()
    assert (r.a, r.b) == pytest.approx((swap, pad), abs=1e-4)
    assert (TS.local_distance(series, shapelet), TS.local_distance(series, shapelet, pad=True)) == (r.a, r.b)


def test_distance_to_an_own_stretch_is_nothing():
    r = random.Random(4)
    s = [r.random() for _ in range(30)]
    assert TS.local_distance(s, s[7:19]) == 0 and TS.dtw(s, s) == 0
    assert TS.compression_ratio([1.0] * 50) < TS.compression_ratio([r.random() for _ in range(50)])


def test_warping_distance_is_the_least_over_all_windows(spark, sf):
    from sylvan.plans import catalog
    from sylvan.sources import fixtures

    got = {r.sid: r.distance for r in catalog.QUERIES["dtw_optional"](spark, sf).collect()}
    series = {r.sid: list(r.series) for r in fixtures.embedding_series(spark, sf).collect()}
    shapelet = series[38][8:24]
    assert got.keys() == series.keys() and got[38] == 0
    for sid in list(series)[:10]:
        s = series[sid]
        assert abs(got[sid] - min(TS.dtw(s[i : i + 16], shapelet) for i in range(len(s) - 15))) < 2e-5
    assert TS.dtw_nearest(shapelet[:5], shapelet) == TS.dtw(shapelet[:5], shapelet)
