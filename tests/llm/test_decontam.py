"""Decontamination: subsequences and windows by definition, planted items, clean documents, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sylvan.llm import decontam as d
from sylvan.llm.text import token_hash


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(8) for _ in range(r.randrange(1, 90))] for _ in range(2))
        assert d.common(np.array(a), np.array(b)) == lcs(a, b)


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 5) for i in range(3000)]
    words = lambda n: r.choices(vocab, weights, k=n)
    items = [words(r.randrange(15, 60)) for _ in range(40)] + [words(200)]
    docs, truth = [], set()
    for i in range(400):
        text = words(r.choice([10, 100, 600]))
        k = r.randrange(len(items))
        item = list(items[k])
        if i % 8 == 0:
            if i % 16 == 0:  # a paraphrase: every eighth word differs, and some are left out
                item = [r.choice(vocab) if j % 8 == 3 else w for j, w in enumerate(item) if j % 13 != 6]
            at = r.randrange(len(text) + 1)
            text[at:at] = item
            truth.add((i, k))
        docs.append((i, " ".join(text).replace("w1 ", "W1\t"), 0.5))
    docs += [(1000, None, 0.0), (1001, "", 0.0), (1002, "\n ", 0.0), (1003, "w1 " * 60_000, 0.0)]
    docs.append(docs[0])
    df = spark.createDataFrame(docs, "doc_id long, text string, cosine double")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, ""), (92, "w1 w2 w3")], "item_id long, text string")
    return df, bench, truth, items


def test_planted_items_are_found_and_clean_documents_left(world):
    df, bench, truth, _ = world
    got = d.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    assert sum(r.doc_id == 0 for r in got) == 2  # the repeated row
    kept = d.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in df.collect() if r.doc_id not in {i for i, _ in truth})


def test_blocks_of_items(world, monkeypatch):
    df, bench, truth, _ = world
    monkeypatch.setattr(d, "ITEMS", 10)
    assert {(r.doc_id, r.item_id) for r in d.contaminated(df, bench).collect()} == truth


def test_search_against_brute_force_over_all_pairs(world):
    df, bench, truth, items = world
    hashed = [token_hash(" ".join(w)) for w in items]
    want = set()
    for r in df.where("doc_id < 1000").dropDuplicates(["doc_id"]).collect():
        ids = token_hash(r.text)
        for k, w in enumerate(hashed):
            for a in range(0, max(1, len(ids) - len(w) // 2), 8):
                if d.common(w, ids[a : a + len(w) + 8]) >= 0.7 * len(w):
                    want.add((r.doc_id, k))
    found = {(r.doc_id, r.item_id) for r in d.contaminated(df, bench).collect()}
    assert len(want & found) >= 0.95 * len(want) and want >= truth


def test_svd_matches_the_dense_one(spark, monkeypatch):
    r = np.random.default_rng(1)
    base = [r.integers(0, d.TERMS, 40) for _ in range(20)]
    rows = [np.concatenate((base[i % 20], r.integers(0, d.TERMS, 3))).astype(np.int32) for i in range(200)]
    df = spark.createDataFrame([(1.0, bytearray(x.tobytes())) for x in rows], "weight double, terms binary").repartition(3)
    idf = np.ones(d.TERMS)
    values, vectors = d.randomised_svd(df, idf, rank=20)
    dense = np.zeros((200, d.TERMS))
    for i, x in enumerate(rows):
        t, n = np.unique(x, return_counts=True)
        dense[i, t] = n / np.sqrt((n * n).sum())
    exact = np.linalg.svd(dense, compute_uv=False)[:20]
    assert np.allclose(values, exact, rtol=0.02)
    assert np.allclose(vectors.T @ vectors, np.eye(20), atol=1e-6)


def test_empty_tables(world):
    df, bench, *_ = world
    assert d.contaminated(df.limit(0), bench).collect() == []
    assert d.contaminated(df.limit(5), bench.limit(0)).collect() == []
    assert d.keep_clean(df.limit(0), bench).collect() == []


@pytest.fixture(scope="module")
def many(spark):
    """Thousands of items; copies with none, a fifth, three tenths of the words replaced, or words left out and put in."""
    r = random.Random(7)
    vocab = [f"v{i}" for i in range(8000)]
    weights = [1 / (i + 5) for i in range(8000)]
    words = lambda n: r.choices(vocab, weights, k=n)
    items = [words(r.randrange(15, 60)) for _ in range(3000)]
    docs, kinds = [], {}
    for i in range(400):
        k = r.randrange(len(items))
        item = list(items[k])
        kind = ("verbatim", "fifth", "three tenths", "moved")[i % 4]
        if kind in ("fifth", "three tenths"):
            for j in r.sample(range(len(item)), int(len(item) * (0.2 if kind == "fifth" else 0.3))):
                item[j] = r.choice(vocab)
        elif kind == "moved":
            item = [x for w in item if r.random() > 0.1 for x in ([w, r.choice(vocab)] if r.random() < 0.1 else [w])]
        text = words(200)
        at = r.randrange(len(text) + 1)
        text[at:at] = item
        docs.append((i, " ".join(text)))
        kinds[i] = (kind, k, text[max(0, at - len(items[k])) : at + len(item) + len(items[k])])
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"), kinds, items


def test_recall_with_thousands_of_items(many):
    df, bench, kinds, items = many
    found = {(r.doc_id, r.item_id) for r in d.contaminated(df, bench).collect()}
    lost, n = {}, {}
    for i, (kind, k, near) in kinds.items():  # only copies that must stand by definition count
        w, text = token_hash(" ".join(items[k])), token_hash(" ".join(near))
        cover, answer = d.common(w, text) / len(w), d.common(w[-d.ANSWER :], text) / d.ANSWER
        if cover >= d.VERBATIM or cover >= d.MIN_COVER and answer >= d.MIN_ANSWER:
            n[kind] = n.get(kind, 0) + 1
            lost[kind] = lost.get(kind, 0) + ((i, k) not in found)
    print("copies", n, "lost", lost)
    assert len(n) == 4 and not any(lost.values()), (n, lost)


def test_one_item_is_found_whatever_the_block(many, monkeypatch):
    monkeypatch.setattr(d, "HITS", 50)
    df, bench, kinds, _ = many
    found = {(r.doc_id, r.item_id) for r in d.contaminated(df.where("doc_id < 20"), bench).collect()}
    assert {(i, kinds[i][1]) for i in range(0, 20, 4)} <= found


def test_a_stretch_that_stands_outweighs_one_of_more_cover():
    item = [f"a{i}" for i in range(40)]
    filler = [f"b{i}" for i in range(300)]
    stands, not_ = item[:4] + ["x"] * 12 + item[16:], item[:30] + ["x"] * 10
    words, text = token_hash(" ".join(item)), token_hash(" ".join(stands + filler + not_))
    ix = d.index([5], [words], np.random.default_rng(1).standard_normal((d.TERMS, 8)), np.ones(d.TERMS))
    got = list(d.matches(ix, text, np.array([len(text)])))
    assert [(m[0], m[1], m[3], m[4]) for m in got] == [(0, 0, 0.7, 1.0)]


def test_the_space_is_fitted_on_every_word_of_every_document(world, monkeypatch):
    df, bench, _, items = world
    seen = []
    monkeypatch.setattr(d, "randomised_svd", lambda rows, idf: seen.append(rows.collect()) or (None, None))
    d.latent_space(df, bench)
    want = sorted(sorted((token_hash(r.text) % d.TERMS).tolist()) for r in df.collect() if r.text and r.text.split())
    want += [sorted((p % d.TERMS).tolist()) for w in items for p in d.item_passages(token_hash(" ".join(w)))]
    entries = [np.frombuffer(r.terms, np.int32) for r in seen[0]]
    assert sorted(sorted(np.repeat(e % d.TERMS, e // d.TERMS + 1).tolist()) for e in entries) == sorted(want)


def test_a_term_of_very_many_occurrences_takes_several_entries(monkeypatch):
    monkeypatch.setattr(d, "MOST", 4)
    texts = pa.array(["a a a a a a a a a a b", None, "b b b b"])
    rows = [np.frombuffer(r["data"], np.int32) for b in d._count(iter([pa.RecordBatch.from_arrays([texts], ["text"])])) for r in b.to_pylist() if r["kind"] == "row"]
    a, b = (int(token_hash(w)[0] % d.TERMS) for w in "ab")
    assert [sorted(zip((r % d.TERMS).tolist(), (r // d.TERMS + 1).tolist(), strict=True)) for r in rows] == [sorted([(a, 4), (a, 4), (a, 2), (b, 1)]), [(b, 4)]]
    row, term, value = d._matrix(pa.RecordBatch.from_arrays([pa.array([1.0]), pa.array([rows[0].tobytes()])], ["weight", "terms"]), np.ones(d.TERMS))
    assert row.tolist() == [0, 0] and dict(zip(term.tolist(), value.tolist(), strict=True)) == pytest.approx({a: 10 / 101**0.5, b: 1 / 101**0.5})


def test_both_tables_empty(world):
    df, bench, *_ = world
    assert d.contaminated(df.limit(0), bench.limit(0)).collect() == []
