import random

import corpus_pipeline
from vaultmill.llm import entry


def write(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 500)) for _ in range(n)) + "."
    item = text(40)
    docs, labels = [], []
    for i in range(240):
        t = text(rng.randint(30, 90))
        if i % 4 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif i % 10 == 1:
            t = docs[1][1] if i > 1 else t
        elif i % 10 == 3:
            t = f"{t} {item}"
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(i % 4 != 0), 0))
    docs += [docs[2], (None, None, None, None, None), (None, "", "en", "s0", 0)]
    write(spark, tmp_path, docs, labels, [(0, item)])
    stage = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, f in stage.items():
        now = f(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = now.collect()
        if name != "shards":
            assert now.columns == corpus_pipeline.COLUMNS
    good = [r for r in left["quality"] if r.doc_id is not None]
    assert all(r.doc_id % 4 for r in good) and {r.doc_id for r in good} == {i for i in range(240) if i % 4}
    one = [r.doc_id for r in left["near_copies"]]
    assert len({r.text for r in left["near_copies"] if r.doc_id is not None}) == sum(i is not None for i in one) and 1 in one and 11 not in one and one.count(2) == 1
    assert not any(item in (r.text or "") for r in left["leaks"])
    assert {r.doc_id for r in left["leaks"]} == {i for i in one if i is None or i % 10 != 3}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, left["shards"]))
    sizes = [sum(r.shard == s for r in rows) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1


def test_names():
    assert all(any(q.startswith(f"op{n}_") for q in entry.QUERIES) for n in range(1, 14))
    assert set(entry.SQL) <= set(entry.QUERIES)
