import math
import random

import numpy as np
import pytest

from vaultmill.functions.text import terms_of
from vaultmill.operators import embed, fuse, lexical, semantic

WORDS = ["zebra", "horse", "plain", "river", "stone", "cloud", "école", "x1"]


def corpus(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = [(f"d{i:02d}", " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, text string")


def brute(rows, query):
    docs = {i: terms_of(t) for i, t in rows}
    avg = sum(map(len, docs.values())) / len(docs)
    score = {}
    for p in query:
        tf = {i: sum(t[k : k + len(p)] == p for k in range(len(t))) for i, t in docs.items()}
        n = sum(v > 0 for v in tf.values())
        idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
        idf = idf if idf > 0 else 1e-6
        for i, f in tf.items():
            if f:
                score[i] = score.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[i]) / avg))
    return sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))


@pytest.mark.parametrize("text", ["zebra", "zebra horse", "zebra zebra river", "ecole", "stone–cloud", "zebra stone–cloud“", "nothing"])
def test_bm25(spark, text):
    rows, df = corpus(spark)
    post, length = lexical.postings(df, "text"), lexical.lengths(df, "text")
    got = lexical.search(post, lexical.stats(length), text, 20).orderBy("lexical_rank").collect()
    want = brute(rows, lexical.phrases(text))[:20]
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert np.allclose([r.score for r in got], [w[1] for w in want])
    assert [r.lexical_rank for r in got] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("text", ["don't", "3.14", "`x`", "a\\b", "AND OR", "", "***"])
def test_refused_and_empty_queries(spark, text):
    _, df = corpus(spark)
    post, length = lexical.postings(df, "text"), lexical.lengths(df, "text")
    assert lexical.search(post, lexical.stats(length), text).count() == 0
    assert lexical.search(post, lexical.stats(length), "zebra", 0).count() == 0


def test_lenient_queries():
    assert lexical.phrases("don't", strict=False) == [["don", "t"]]


def test_nearest_keeps_rank_gaps(spark):
    rows = [("a", 0, [1.0, 0.0]), ("a", 1, [0.9, 0.0]), ("b", 0, [0.5, 0.0]), ("c", 0, [0.0, 1.0])]
    c = spark.createDataFrame(rows, "doc_id string, chunk_index int, embedding array<float>")
    got = {r.doc_id: (r.chunk_index, r.semantic_rank) for r in semantic.search(c, [1.0, 0.0], 3).collect()}
    assert got == {"a": (0, 1), "b": (0, 3)}
    assert semantic.nearest(c, [1.0, 0.0], 0).count() == 0
    near = semantic.nearest(c, [2.0, 0.0], 4, "cosine").orderBy("rank").collect()
    assert near[-1].doc_id == "c" and near[-1].distance == pytest.approx(1.0)


def lists(spark, lex, sem):
    a = spark.createDataFrame([(d, i + 1) for i, d in enumerate(lex)], "doc_id string, lexical_rank int")
    b = spark.createDataFrame([(d, 0, i + 1) for i, d in enumerate(sem)], "doc_id string, chunk_index int, semantic_rank int")
    return a, b


@pytest.mark.parametrize(
    "lex, sem, k, want",
    [
        ([], [], 10, []),
        (["a"], [], 10, [("a", 1 / 61, "lexical")]),
        ([], ["a"], 10, [("a", 1 / 61, "semantic")]),
        (["a", "b"], ["a"], 10, [("a", 2 / 61, "fused"), ("b", 1 / 62, "lexical")]),
        (["b", "a"], ["a", "b"], 10, [("a", 1 / 61 + 1 / 62, "fused"), ("b", 1 / 61 + 1 / 62, "fused")]),
        (list("abcdefghij"), list("klmnopqrst"), 5, [("a", 1 / 61, "lexical"), ("k", 1 / 61, "semantic"), ("b", 1 / 62, "lexical"), ("l", 1 / 62, "semantic"), ("c", 1 / 63, "lexical")]),
        (["a"], ["b"], 0, []),
    ],
)
def test_fusion(spark, lex, sem, k, want):
    got = [(r.doc_id, r.rrf_score, r.signal) for r in fuse.fuse(*lists(spark, lex, sem), k).collect()]
    assert [(d, s) for d, _, s in got] == [(d, s) for d, _, s in want]
    assert np.allclose([x for _, x, _ in got], [x for _, x, _ in want])


def test_published_scores():
    share = lambda *r: round(sum(1 / (fuse.RRF_K + x) for x in r), 6)
    assert [share(1, 1), share(1, 2), share(5, 3), share(2), share(3)] == [0.032787, 0.032522, 0.031258, 0.016129, 0.015873]


def test_pruned_ranking_is_the_whole_ranking(spark, monkeypatch):
    """Equal ranks and scores for any query, and far fewer postings where the query is selective."""
    from hashlib import sha256

    from pyspark.sql import functions as F

    monkeypatch.setattr(lexical, "FIRST", 8)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(sha256(str(i).encode()).hexdigest()[:16], " ".join(rng.choices(vocabulary, weights, k=rng.choice([3, 8, 40, 200])))) for i in range(1500)]
    rows += [(sha256(b"best").hexdigest()[:16], "w50 w51 w52 w50"), (sha256(b"tie").hexdigest()[:16], "w50 w51 w52 w50")]
    posts = lexical.postings(spark.createDataFrame(rows, "id string, text string"), "text").withColumn("block", F.substring("doc_id", 1, 2)).cache()
    stored, corpus = lexical.blocks(posts).cache(), lexical.stats(lexical.lengths(spark.createDataFrame(rows, "id string, text string"), "text")).cache()
    for text in ("w50 w51 w52", "w0", "w0 w1 w2", "w0 w50", "w59 w59 none", "none", "w3–w4 w50", ""):
        for k in (1, 7, 20):
            want = [tuple(r) for r in lexical.search(posts, corpus, text, k).orderBy("lexical_rank").collect()]
            assert [tuple(r) for r in lexical.pruned(posts, stored, corpus, text, k).orderBy("lexical_rank").collect()] == [(a, b, pytest.approx(c)) for a, b, c in want], (text, k)
    query = lexical.phrases("w50 w51 w52")
    found = lexical.matches(posts, query)
    exact = lexical.score(found, lexical.weights(found, corpus)).withColumn("block", F.substring("doc_id", 1, 2))
    bound = lexical.bounds(stored, found, corpus, query)
    assert exact.join(bound, "block").where(F.col("score") > F.col("bound") + 1e-9).count() == 0
    least = lexical.search(posts, corpus, "w50 w51 w52", 2).agg(F.min("score")).first()[0]
    left = bound.where(F.col("bound") >= least - 1e-9).select("block")
    kept = lexical.matches(posts.join(left, "block", "left_semi"), query).count()
    assert kept < 0.35 * found.count()


def test_postings_of_a_document_are_made_in_its_row(spark):
    """No occurrence of a term is shuffled, and rows without terms give none."""
    from vaultmill.operators import lexical

    docs = spark.createDataFrame([(1, "One", "two one, ONE"), (2, None, None), (3, "", "!")], "id long, title string, text string")
    p = lexical.postings(docs, "title", "text")
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, p.collect())) == [(1, "one", 3, [0, (1 << 29) + 1, (1 << 29) + 2], 4), (1, "two", 1, [1 << 29], 4)]


def test_rounding_is_not_repeated_in_sorts(spark):
    """A sort makes its expressions for every comparison, so what is rounded is a column before it."""
    scores = spark.createDataFrame([("b", 0.1 + 0.2), ("a", 0.3), ("c", 0.5)], "doc_id string, score double")
    chunks = spark.createDataFrame([("b", 1, [0.5]), ("b", 0, [0.5]), ("a", 0, [0.5]), ("c", 0, [0.25])], "doc_id string, chunk_index int, embedding array<float>")
    top, near = lexical.ranked(scores, 1_000_000), semantic.nearest(chunks, [0.0], 1_000_000)
    assert [(r.doc_id, r.lexical_rank) for r in top.orderBy("lexical_rank").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    assert [(r.doc_id, r.chunk_index) for r in near.orderBy("rank").collect()] == [("c", 0), ("a", 0), ("b", 0), ("b", 1)]
    assert near.columns == ["doc_id", "chunk_index", "distance", "rank"]
    for df in (top, near):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        sorts = [x for x in lines if "Sort [" in x or "Window [" in x]
        assert len(sorts) == 2 and not any("round(" in x for x in sorts)


def test_equal_texts_are_encoded_once(spark):
    class Counting:
        def encode(self, texts):
            return np.array([[len(t), len(texts)] for t in texts], np.float32)

    rows = spark.createDataFrame([(i, "xyz"[: i % 3 + 1]) for i in range(30)], "i int, text string").coalesce(1)
    got = embed.embedded(rows, Counting).collect()
    assert len(got) == 30 and all(r["embedding"] == [len(r["text"]), 3.0] for r in got)
