"""Mixing: targets by repeated resharing, the sample by one global ranking, odd rows."""

import random

import pytest

from sylvan.llm import mixing


def reshare(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


@pytest.fixture
def docs(spark):
    r = random.Random(4)
    rows = []
    for i in range(3000):
        source = "hot" if r.random() < 0.4 else r.choice(["a", "b", "é", "Z", None, "tiny"] + ["c"] * 4)
        rows.append((i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), source if source != "tiny" or r.random() < 0.05 else "a", 1.0))
    rows += [(None, "x y", "a", 1.0), (5, None, "a", 1.0), (7, "\t \n", "empty", 1.0), rows[3], rows[3], (9999, "w " * 100_000, "long", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target double"), rows


def test_targets_and_fixed_size(docs, monkeypatch):
    df, rows = docs
    monkeypatch.setattr(mixing, "BUCKET", 20)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes, source = {}, {}
    for d, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = reshare(sizes)
    by_size = {}
    for r in got:
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        key = (r.source_size, round(r.target, 6))
        by_size.setdefault(key, []).append(r)
    assert {k for k in by_size} == {(n, round(want[s], 6)) for s, n in sizes.items()}
    for (_, target), own in by_size.items():
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) / 2 + 1e-6
    assert sorted(map(tuple, mixing.mix_sources(df.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_buckets_do_not_change_the_sample(docs, monkeypatch):
    df, _ = docs
    whole = sorted(map(tuple, mixing.mix_sources(df).collect()), key=str)
    monkeypatch.setattr(mixing, "BUCKET", 3)
    assert sorted(map(tuple, mixing.mix_sources(df).collect()), key=str) == whole


def test_empty(docs):
    df, _ = docs
    assert mixing.mix_sources(df.limit(0)).collect() == []
    assert {r.taken for r in mixing.mix_sources(df.where("text is null")).collect()} == {0}


def test_longer_documents_are_likelier_to_be_in(spark):
    """Of two lengths in one source the longer is in by its odds, and the target is met all the same."""
    rows = [(i, "w " * (4 if i % 2 else 36), "a") for i in range(20_000)] + [(-i, "w " * 40, "b") for i in range(1, 20_001)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 3.0), share=0.7)
    own = [r for r in got.collect() if r.doc_id >= 0]
    share = {n: sum(r.taken > 0 for r in own if r.size == n) / 10_000 for n in (4, 36)}
    odds = {n: p / (1 - p) for n, p in share.items()}
    assert odds[36] / odds[4] == pytest.approx(3.0, rel=0.1)  # square root of nine times the length
    assert abs(sum(r.taken for r in own) - own[0].target) <= 18


def test_buckets_of_a_large_capped_source_stay_small(spark):
    from pyspark.sql import functions as F

    sized = spark.range(300_000).select("id", F.lit("hot").alias("source"), (F.col("id") % 50).alias("size"))
    plan = spark.createDataFrame([("hot", 7_350_000, 300_000, 14_700_000.0)], "source string, source_size long, n long, target double")
    most = mixing.rank(sized, plan, "s").groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert most <= mixing.SPREAD * mixing.BUCKET * 1.2
