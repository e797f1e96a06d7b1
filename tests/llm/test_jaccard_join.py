"""The Jaccard join against a brute-force version over all pairs."""

import random
import re

from sylvan.llm.jaccard_join import near_duplicates


def brute(rows, n, num, den):
    """Rows of (id, text) to {(id, text): (size, component)}; ids are distinct or null."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed, docs=260):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(vocab, k=30))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  two"), (5, "one two three four"), (6, "É x"), (7, "é x"), (None, "one two")]
    base = None
    for i in range(10, 10 + docs):
        kind = r.random()
        if base is None or kind < 0.25:
            base = r.choices(vocab, k=r.choice([1, 3, 5, 8, 20, 60, 150, 400]))
            words = list(base)
        else:
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                at = r.randrange(len(words) + 1)
                words[at : at + r.choice([0, 1, 2])] = r.choices(vocab, k=r.choice([0, 1]))
        text = " ".join(words)
        if r.random() < 0.3:
            text = passage + "\n" + text
        rows.append((i, text))
    return rows


def check(spark, rows, n, num, den):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, tok int").repartition(5)
    got = [tuple(r) for r in near_duplicates(df, n, num, den).collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(brute(rows, n, num, den), key=key)


def test_four_words(spark):
    check(spark, corpus(1), 4, 85, 100)


def test_five_words(spark):
    check(spark, corpus(2), 5, 80, 100)


def test_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(50)]
    check(spark, rows, 4, 85, 100)


def test_chain_of_links(spark):
    rows = [(i, " ".join(f"t{j}" for j in range(i * 3, i * 3 + 60))) for i in range(40, 0, -1)]
    check(spark, rows, 4, 85, 100)


def test_empty_and_repeated_rows(spark):
    check(spark, [], 4, 85, 100)
    rows = [(7, "a b c d e"), (7, "a b c d e"), (9, "A b c d e"), (4, "z")]
    check(spark, rows, 4, 85, 100)


def test_blocks_alone_find_every_link(spark, monkeypatch):
    from sylvan.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "_verify", lambda pairs, *_: pairs.limit(0))
    monkeypatch.setattr(jaccard_join, "SIDE", 16)
    monkeypatch.setattr(jaccard_join, "TILE", 7)
    check(spark, corpus(4), 4, 85, 100)


def test_one_giant_family(spark, monkeypatch):
    """Every text shares a passage with all others, so all are one family, cut into many sides."""
    from sylvan.llm import jaccard_join

    r = random.Random(6)
    monkeypatch.setattr(jaccard_join, "SIDE", 24)
    monkeypatch.setattr(jaccard_join, "HOT", 64)
    monkeypatch.setattr(jaccard_join, "SAMPLED", 4)
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(240):
        own = rows[r.randrange(len(rows))][1].split()[60:] if i % 3 == 2 else [f"q{r.randrange(10**6)}" for _ in range(r.choice([8, 20, 45, 90]))]
        own = own[: len(own) - r.randrange(3)]
        rows.append((i, " ".join(passage + own)))
    check(spark, rows, 4, 85, 100)


def test_filters_meet_where_sets_are_similar():
    import numpy as np

    from sylvan.llm.jaccard_join import meet, order_prefixes, similar

    r = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 80)).astype(np.uint64))
        b = np.unique(np.concatenate((a[r.random(len(a)) > 0.12], r.integers(0, 2**63, r.integers(0, 5)).astype(np.uint64), a[:1])))
        if similar(a, b, 85, 100):
            assert all(meet(x, y) for x, y in zip(order_prefixes(a, 85, 100), order_prefixes(b, 85, 100), strict=True))


def test_one_of_each(spark):
    from sylvan.llm.jaccard_join import one_of_each

    rows = [(3, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (2, "other words in this one here"), (None, "a b c d e f"), (None, "null id of its own text"), (None, "null id of its own text"), (7, None), (8, ""), (7, None), (9, "z")]
    df = spark.createDataFrame([(d, t, "l", "s", 1, 2, True, 3) for d, t in rows], "doc_id long, text string, lang string, _id string, _h long, `a.b` long, _gone boolean, k long")
    got = sorted((tuple(r)[:2] for r in one_of_each(df).collect()), key=str)
    want = [(2, "A b c d e f"), (2, "other words in this one here"), (None, "null id of its own text"), (7, None), (8, ""), (7, None), (9, "z")]
    assert got == sorted(want, key=str)
    assert one_of_each(df).columns == df.columns and one_of_each(df.limit(0)).collect() == []


def test_few_edges_are_connected_without_steps(spark, monkeypatch):
    from sylvan.llm import graph

    r = random.Random(12)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(7000, 7000)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for u, v in edges:
            if u != v:
                want[u] = want[v] = min(want[u], want[v])
    assert {x.node: x.comp for x in graph.components(df, max_steps=0).collect()} == want
    assert graph.components(df.limit(0), max_steps=0).collect() == []
    monkeypatch.setattr(graph, "SMALL", 0)
    assert {x.node: x.comp for x in graph.components(df).collect()} == want
