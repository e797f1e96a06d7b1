"""The line field: forward-backward by enumeration, features, held-out quality, odd rows."""

import itertools
import zlib

import numpy as np
import pytest

from sylvan.llm import quality_crf as q
from sylvan.llm.text import string_buffers
import pyarrow as pa


def test_marginals_by_enumeration():
    r = np.random.default_rng(1)
    size = np.array([1, 4, 2, 6])
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    u, t = r.normal(size=size.sum()), r.normal(size=(2, 2))
    a, b, _ = q.forward_backward(u, first, size, t)
    for f, n in zip(first, size):
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(u[f + k] for k in range(n) if y[k]) + sum(t[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            good += w * np.array(y)
        assert np.allclose(q._sigmoid((a + b)[f : f + n]), good / total)


def test_gradient_raises_the_likelihood_of_neighbouring_labels():
    doc = np.repeat(np.arange(40), 5)
    label = np.arange(40) % 2
    x = np.zeros((200, q.MEASURES), np.uint8)
    x[:, 0] = np.where(np.repeat(label, 5) == 1, 1, 6)
    x[::5, 0] = 3  # the first line tells nothing by itself
    f = q.fit(doc, np.ones(200), x, label)
    s = f.documents(doc, np.ones(200), x, 40)
    assert (s[label == 1] > 0.8).all() and (s[label == 0] < 0.2).all()


def test_lines():
    data, off = string_buffers(pa.array(["one two\n\nTHREE!!", "", None, "a a a a", "\n"]))
    doc, length, x = q.line_features(data, off)
    assert doc.tolist() == [0, 0, 3] and length.tolist() == [8, 7, 7]
    assert x[1, 0] == q.BINS - 1 and x[0, 0] == 0 and x[2, 13] > 0


def test_held_out(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = q.score_held_out(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    mark = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, mark[r.doc_id]) for r in got if r.held_out and r.doc_id in mark]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum(g > b for g in good for b in bad) > 0.9 * len(good) * len(bad)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a plain line"), (5, "a line of words.\n" * 2_500), (6, "X!! Y!! Z!!"), (6, "X!! Y!! Z!!")]
    return spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, score double")


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 1), (5, None), (None, 1)], "doc_id long, quality int")
    got = q.score(odd, q.learn(odd, labels)).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score == got[2].score and got[5].score == got[6].score < got[4].score


def test_no_labels_and_empty(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in q.score(odd, q.learn(odd, none)).collect()} == {0.5}
    assert q.score_held_out(odd.limit(0), none).collect() == []
