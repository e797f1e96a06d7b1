"""The pipeline against a brute-force version, on planted documents and on the smallest tables."""

import random

import corpus_pipeline
from sylvan.llm import decontam, langid, mixing, pii
from sylvan.llm.storage import materialise
from tests.llm.test_jaccard_join import brute


def test_each_stage_and_the_result(spark, tmp_path):
    r = random.Random(1)
    words = {"en": "the and of to is in that it was for".split() + [f"en{i}ing" for i in range(400)], "de": "der die und das ist nicht ein zu mit".split() + [f"de{i}ung" for i in range(400)]}
    item = " ".join(f"secret{i}" for i in range(30))
    docs = []
    for i in range(120):
        lang = r.choice(["en", "de"])
        docs.append((i, " ".join(r.choices(words[lang], k=r.choice([15, 60, 200]))), lang, r.choice(["a", "b", None]), 0))
    docs += [(200 + i, docs[i][1] + " tail", docs[i][2], "a", 0) for i in range(0, 20) if len(docs[i][1].split()) > 50]
    docs += [(300, docs[3][1] + " " + item, "en", "b", 0), (301, "--- 123 ...", "en", "b", 0), (302, None, None, None, 0), (303, "write to foo.bar@mail.example.com about the thing and the rest of it", "en", "a", 0)]
    df = spark.createDataFrame([(d, t, l, s, len(t or "")) for d, t, l, s, _ in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    spark.conf.set(pii.KEY, "pipeline")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = materialise(stage(spark, now, str(tmp_path)), "stage")
        assert now.columns == df.columns
        kept.append({x.doc_id: x.text for x in now.collect()})
    assert set(kept[0]) == {d for d, *_ in docs} - {301, 302}
    rows = sorted(kept[0].items())
    component = {d: c for d, _, c in brute(rows, 5, 80, 100)}
    assert set(kept[1]) == {d for d, _ in rows if component[d] == d}
    assert set(kept[1]) - set(kept[2]) == {300}
    assert all(pii.replace(t, b"pipeline")[0] == kept[3][d] for d, t in kept[2].items())
    assert "foo.bar" not in kept[3][303] and kept[3].keys() == kept[2].keys()
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    want = sorted(map(tuple, mixing.mix_sources(now).collect()), key=str)
    assert sorted(map(tuple, last.collect()), key=str) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == want
    assert decontam.keep_clean(now, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == now.count()
    assert langid.keep_identified(now).count() == now.count()
