"""Language identification: n-grams and distances by definition, held-out accuracy, odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sylvan.llm import langid


def slow_grams(text):
    c = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        p = f"_{w}_"
        for n in (1, 2, 3):
            c.update(g for i in range(len(p) - n + 1) if (g := p[i : i + n]).strip("_"))
    return c


TEXTS = ["", "Ab a", "été l'été 12 x", "a" * 500, "日本 語", "--- 99", "Don't\0stop", "İstanbul"]


def test_grams_by_definition():
    for t, k in zip(TEXTS, langid.grams(TEXTS), strict=True):
        want = Counter({langid.gram_key(g): n for g, n in slow_grams(t).items()})
        assert Counter(k.tolist()) == want, t


def test_distance_by_definition():
    m = langid.Model(("a", "b"), np.array([5, 7, 9]), np.array([[0, 1, 3], [2, 3, 0]]), 3)
    assert m.distances(np.array([7, 5, 8])).tolist() == [1 + 1 + 3, 3 + 1 + 3]


def test_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !!", "en"), (None, "the cat and the dog", None), (5, "the cat and the dog " * 20000, "en"), (6, "der hund und die katze", "de"), (6, "der hund und die katze", "de"), (7, "the dog", "en")]
    return spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, lang string, lang_text string, score int")


def test_odd_rows(odd):
    m = langid.learn(odd)
    got = langid.identify(odd, m).collect()
    assert m.langs == ("de", "en")
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "de", "de", "en"]
    assert all(r.lang_score == 0 for r in got[:3])


def test_nothing_to_learn_from(odd):
    m = langid.learn(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, m).collect()} == {"und"}
    assert langid.identify_held_out(odd.limit(0)).collect() == []


def test_filter_keeps_what_has_a_language(odd):
    kept = langid.keep_identified(odd.drop("lang_text"))
    assert kept.count() == 5 and kept.columns == ["doc_id", "text", "lang", "score"]
