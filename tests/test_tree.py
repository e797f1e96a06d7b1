"""Fit, prune, score, render, keep, stream."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sylvan.operators import score
from sylvan.operators.tree import Options, Tree, fit, infer_kinds, normalise
from sylvan.plans import options, render
from sylvan.sources import arff
from sylvan.streaming.scoring import score_stream, write


def rows(n=300, seed=1, gaps=0.0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, c = r.random() * 10, r.choice(["red", "green", "blue"])
        y = "p" if x > 6 or c == "red" and x > 3 else "q"
        out.append((None if r.random() < gaps else x, None if r.random() < gaps else c, y if r.random() > 0.05 else "pq"[y == "p"]))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "x double, colour string, y string").persist()


@pytest.fixture(scope="module")
def holey(spark):
    return spark.createDataFrame(rows(gaps=0.15) + [(1.0, "red", None)], "x double, colour string, y string").persist()


@pytest.fixture(scope="module")
def fitted(data):
    return fit(data, "y")


def accuracy(df, tree, label="y"):
    p = score.predict(normalise(df, label, tree.kinds), tree)
    return p.where(F.col("prediction") == F.col(label)).count() / df.count()


def test_fit_and_prune(data, fitted):
    raw = fit(data, "y", options=Options(unpruned=True, collapse=False))
    assert accuracy(data, fitted) > 0.9
    assert 3 <= fitted.measure("MEASURETREESIZE") <= raw.measure("measureTreeSize")
    for t in (raw, fitted):
        for n in t.walk():
            if not n.leaf:
                assert sum(t.nodes[c].weight for c in n.children) == pytest.approx(n.weight)
    with pytest.raises(ValueError):
        fitted.measure("measureHeight")


def test_variants(data):
    binary = fit(data, "y", options=Options(binary=True))
    assert all(len(n.children) in (0, 2) for n in binary.walk()) and accuracy(data, binary) > 0.9
    rep = fit(data, "y", options=Options(reduced_error=True))
    assert accuracy(data, rep) > 0.85
    assert accuracy(data, fit(data, "y", options=Options(raising=False))) > 0.9


def test_unknown_values(spark, holey):
    t = fit(holey, "y")
    n = normalise(holey, "y", t.kinds)
    p = score.predict_proba(n, t).select(F.map_values("probability").alias("p")).collect()
    assert all(sum(r.p) == pytest.approx(1.0) for r in p)
    m = score.membership(n.withColumn("id", F.monotonically_increasing_id()), t, ["id"])
    leaves = [x.id for x in t.walk() if x.leaf]
    sums = m.where(F.col("node").isin(leaves)).groupBy("id").agg(F.sum("w").alias("s")).collect()
    assert len(sums) == holey.count() and all(r.s == pytest.approx(1.0) for r in sums)
    assert t.root.weight == holey.where("y is not null").count()


def test_a_tree_of_one_leaf(spark):
    t = fit(spark.createDataFrame([(1.0, "a")] * 4, "x double, y string"), "y")
    assert t.root.leaf and t.measures()["measureNumLeaves"] == 1
    assert score.predict(spark.createDataFrame([(None,)], "x double"), t).first().prediction == "a"


def test_sequences_and_series(spark):
    r = random.Random(3)
    out = []
    for i in range(60):
        good = i % 2 == 0
        s = ">".join(r.choice("cde") for _ in range(4))
        v = [r.random() + (4 if good and 3 <= k < 6 else 0) for k in range(10)]
        out.append(("a>b>" + s if good else s, ",".join(map(str, v)), "yn"[good]))
    df = spark.createDataFrame(out, "SEQ_s string, TS_v string, y string")
    seq = fit(df.drop("TS_v"), "y", options=Options(longest=2, support=0.3))
    assert seq.root.split.kind == "pattern" and accuracy(df.drop("TS_v"), seq) == 1.0
    ts = fit(df.drop("SEQ_s"), "y", options=Options(population=8, evaluations=16, max_depth=2))
    assert ts.root.split.kind == "shapelet" and accuracy(df.drop("SEQ_s"), ts) > 0.9
    assert "dist(TS_v" in render.text(ts) and "contains" in render.text(seq)
    with pytest.raises(ValueError):
        render.sql(seq)


def test_kinds(spark):
    df = spark.createDataFrame([("a", 1, 2.0, "x>y", "1,2")], "y string, i int, f double, SEQ_q string, TS_t string")
    assert infer_kinds(df, "y") == {"i": "numeric", "f": "numeric", "SEQ_q": "seq", "TS_t": "ts"}
    assert infer_kinds(df, "y", {"SEQ_q": "nominal"}) == {"SEQ_q": "nominal"}
    with pytest.raises(ValueError):
        infer_kinds(spark.createDataFrame([("a", [1])], "y string, v array<int>"), "y")
    for bad in ({"unpruned": True, "reduced_error": True}, {"unpruned": True, "raising": False}, {"confidence": 1.0}, {"folds": 1}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_forms(spark, data, fitted, tmp_path):
    text = render.text(fitted)
    assert f"Size of the tree : {fitted.measures()['measureTreeSize']}" in text and "x <= " in text
    dot = render.dot(fitted)
    assert dot.startswith("digraph") and dot.count("->") == fitted.measures()["measureTreeSize"] - 1
    assert render.prefix(fitted).count("[") == fitted.measures()["measureTreeSize"]
    render.save(spark, fitted, f"file://{tmp_path}/t")
    again = render.load(spark, f"file://{tmp_path}/t")
    assert isinstance(again, Tree) and again.to_json() == fitted.to_json()
    t = data.toPandas()  # noqa: F841
    want = duckdb.sql(f"SELECT {render.sql(fitted)} AS p FROM t").df()["p"].tolist()
    assert [r.prediction for r in score.predict(data, fitted).collect()] == want


def test_stream(spark, data, fitted, tmp_path):
    data.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
    write(score_stream(stream, fitted, ["x", "colour"]), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = score.predict(data, fitted).groupBy("prediction").count().collect()
    assert sorted(map(tuple, got.groupBy("prediction").count().collect())) == sorted(map(tuple, want))


def test_arff(spark, tmp_path):
    (tmp_path / "a.arff").write_text("% c\n@relation r\n\n@attribute 'a b' numeric\n@attribute c {x, 'y z'}\n@ATTRIBUTE SEQ_s string\n@data\n1.5, x, 'a,b>c'\n?, 'y z', ?\n")
    df = arff.read(spark, f"file://{tmp_path}/a.arff")
    assert df.columns == ["a b", "c", "SEQ_s"]
    assert [tuple(r) for r in df.collect()] == [(1.5, "x", "a,b>c"), (None, "y z", None)]


def test_arff_quotes_signs_and_sparse_rows(spark, tmp_path):
    lines = ["@RELATION r", "@attribute a numeric", "@attribute 'b c' {first, \"x y\"}", "@attribute s string", "@data", "1,first,'it\\'s, so'", "@home,first,@data1", "2, \"x y\" ,\"?\"", "{0 3, 2 'q, r'}", "{1 \"x y\", 0 ?}", "{ }", "?,?,?"]
    (tmp_path / "a.arff").write_text("\n".join(lines))
    got = [tuple(r) for r in arff.read(spark, f"file://{tmp_path}/a.arff").collect()]
    assert got == [(1.0, "first", "it's, so"), (None, "first", "@data1"), (2.0, "x y", "?"), (3.0, "first", "q, r"), (None, "x y", None), (0.0, "first", None), (None, None, None)]


def test_arff_of_too_long_a_header(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arff, "MOST", 3)
    (tmp_path / "a.arff").write_text("@relation r\n@attribute a numeric\n@attribute b numeric\n@data\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        arff.read(spark, f"file://{tmp_path}/a.arff")


def test_options():
    o = options.parse("-R -N 4 -Q 7 -B -SP -M 5 -P 0.3 -POP 20".split())
    assert (o.reduced_error, o.folds, o.seed, o.binary, o.relocate, o.least, o.support, o.population) == (True, 4, 7, True, False, 5, 0.3, 20)
    for o in (Options(), Options(unpruned=True, collapse=False), Options(reduced_error=True, folds=5), Options(raising=False, confidence=0.1, laplace=True, mdl=False, gain_pruning=True)):
        assert options.parse(options.emit(o)) == o
    for bad in ("-U -S", "-U -R", "-C 0.1 -R", "-U -C 0.1", "-N 3", "-C 1.5", "-X", "-M", "-B -B", "-M x"):
        with pytest.raises(ValueError):
            options.parse(bad.split())
    assert all(flag in options.listing() for flag, *_ in options.OPTIONS)


def test_command_line(spark, tmp_path):
    from sylvan.__main__ import main

    assert "-POP" in main([])
    rows_ = "".join(f"{i},{'ab'[i > 10]}\n" for i in range(20))
    (tmp_path / "t.arff").write_text(f"@relation r\n@attribute x numeric\n@attribute y {{a,b}}\n@data\n{rows_}")
    assert "x <= 10" in main(["-M", "2", f"file://{tmp_path}/t.arff", "y"])


def test_unknown_series_lower_the_gain(spark):
    """Half of the series are unknown: the shapelet's gain counts against all rows' weight, so a better known column wins."""
    out = []
    for i in range(80):
        good = i % 2 == 0
        v = [0.1 * k + (4 if good and 3 <= k < 6 else 0) for k in range(10)]
        out.append((None if i % 4 < 2 and i < 70 else ",".join(map(str, v)), "p" if good or i % 10 == 1 else "q", "yn"[good]))
    df = spark.createDataFrame(out, "TS_v string, c string, y string")
    o = Options(population=8, evaluations=16, max_depth=1, unpruned=True)
    assert fit(df, "y", options=o).root.split.kind == "values"
    assert fit(df.drop("c"), "y", options=o).root.split.kind == "shapelet"


def test_static_gain_bounds_the_patterns(spark):
    rows_ = [("a>b" if i % 2 else "b>a", i % 2 * 1.0 + i % 7 / 10, "yn"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows_, "SEQ_s string, x double, y string")
    t = fit(df, "y", options=Options(gain_pruning=True, longest=2, support=0.3, max_depth=1, unpruned=True))
    assert t.root.split.kind == "threshold"  # the pattern gains no more, and the first of equals stays
