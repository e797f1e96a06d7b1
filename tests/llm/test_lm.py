"""The language model against counts and probabilities by definition."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sylvan.llm import lm
from sylvan.llm.elias_fano import EliasFano, Trie


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(rows, order):
    """Rows of (id, held, text)."""
    grams = [Counter() for _ in range(order + 1)]
    ctx = [Counter() for _ in range(order + 1)]
    for _, held, t in rows:
        if held:
            continue
        w = ["<s>"] * order + tokens(t)
        for i in range(order, len(w)):
            for k in range(1, order + 1):
                grams[k][tuple(w[i - k + 1 : i + 1])] += 1
                ctx[k][tuple(w[i - k + 1 : i])] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    out = []
    for d, held, t in rows:
        own = tokens(t)
        w = ["<s>"] * order + own
        base = score = known = 0.0
        for i in range(order, len(w)):
            c = grams[1][(w[i],)]
            known += c > 0
            p = (c + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                p = (grams[k][tuple(w[i - k + 1 : i + 1])] + lm.MU * p) / (ctx[k][tuple(w[i - k + 1 : i])] + lm.MU)
            score += math.log10(p)
        out.append((d, held, len(own), int(known), n, base, score))
    return out


def rows(seed, n=120):
    r = random.Random(seed)
    vocab = ["the", "The", "of", "é"] + [f"w{i}" for i in range(300)]
    passage = " ".join(r.choices(vocab, k=40))
    out = [(1, False, None), (2, True, ""), (3, True, "zzz unseen words"), (None, False, "the of"), (5, False, "the of " * 3000)]
    for i in range(10, n):
        t = " ".join(r.choices(vocab, weights=[50, 20, 30, 5] + [1] * 300, k=r.choice([1, 5, 40, 300])))
        out.append((i, r.random() < 0.2, passage + " " + t if r.random() < 0.3 else t))
    return out + [out[-1]]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("hot", [lm.HOT, 50])
def test_scores(spark, monkeypatch, order, hot):
    monkeypatch.setattr(lm, "BLOCK", 3000)
    monkeypatch.setattr(lm, "SHARD", 4000)
    monkeypatch.setattr(lm, "HOT", hot)
    data = rows(order)
    df = spark.createDataFrame([(*x, "b") for x in data], "doc_id long, held boolean, text string, block string").repartition(3)
    got = sorted((tuple(r) for r in lm.score_texts(df, order).collect()), key=str)
    want = sorted(brute(data, order), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert g[6] == pytest.approx(w[6], abs=w[2] * order / lm.STEP)


def test_held_out_gains_over_the_base(spark, sf):
    got = lm.score_held_out(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_and_all_held(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_held_out(df).collect() == []
    df = spark.createDataFrame([(1, True, "a b")], "doc_id long, held boolean, text string")
    (r,) = lm.score_texts(df).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0.0


def test_packing():
    r = np.random.default_rng(3)
    for a in (np.zeros(0, np.uint64), r.integers(0, 2**64 - 1, 100, dtype=np.uint64), np.arange(70000, dtype=np.uint32)):
        assert (lm.unpack(lm.pack(a)) == a).all()
    parts = [np.arange(5, dtype=np.uint8), np.zeros(0, np.uint16), np.arange(300, dtype=np.uint32)]
    assert all((a == b).all() for a, b in zip(lm.split(lm.join(parts)), parts, strict=True))


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, u in ((0, 1), (1, 1), (5, 10), (100, 50), (1000, 10**6), (3000, 2**56), (2000, 3)):
        v = np.sort(r.integers(0, u, n, dtype=np.uint64))
        e = EliasFano.build(v)
        assert (e.get(np.arange(n)) == v).all()
        x = np.concatenate((r.integers(0, u + 5, 300, dtype=np.uint64), v[:300]))
        assert (e.successor(x) == np.searchsorted(v, x)).all()
        if n:
            lo = r.integers(0, n, len(x))
            hi = np.minimum(n, lo + r.integers(0, n, len(x)))
            assert e.successor(x, lo, hi).tolist() == [a + int(np.searchsorted(v[a:b], q)) for a, b, q in zip(lo, hi, x, strict=True)]


def test_trie():
    r = np.random.default_rng(2)
    pairs = np.unique(np.stack((r.integers(0, 40, 500), r.integers(0, 2**32, 500)), 1), axis=0)
    ctx, succ = (pairs[:, 0].astype(np.uint64) * np.uint64(99999999977)), pairs[:, 1].astype(np.uint32)
    count, code = r.integers(1, 1000, len(ctx)), r.integers(0, 65536, len(ctx))
    t = Trie.build(ctx, succ, count, code).mapped()
    at = t.find(ctx, succ)
    assert at.tolist() == list(range(len(ctx))) and (t.counts(at) == count).all() and (t.codes[at] == code).all()
    assert (t.find(ctx, succ ^ np.uint32(1)) < 0).all() and (t.find(ctx + np.uint64(1), succ) < 0).all()
    none = np.zeros(0, np.int64)
    assert t.find(none.astype(np.uint64), none.astype(np.uint32)).tolist() == []
    assert Trie.build(none.astype(np.uint64), none.astype(np.uint32), none, none).find(ctx, succ).max() == -1
