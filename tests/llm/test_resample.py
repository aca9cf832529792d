import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultmill.llm import resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, low, high):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, low=1, high=1, buckets=10_000, least=20, percent=10):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    count = lambda texts: np.bincount([bucket(g) for t in texts for g in grams(t, low, high)[1]] or [0], minlength=buckets) - (0 if any(grams(t, low, high)[1] for t in texts) else np.eye(1, buckets, dtype=int)[0])
    s, t = count([x for _, x in rows]), count(target)
    out = []
    for i, x in rows:
        w, g = grams(x, low, high)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in map(bucket, g)]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        rank.setdefault(r, []).append(k + 1)
    return [(*r[:4], rank[r].pop(0) if rank.get(r) else None) for r in out]


def made_up(n, seed=2):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["a", "Be", "c3", "ñandú", "日本", "É"]) + str(rng.randint(0, 30)) for _ in range(80)]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_", "\x00"]) for _ in range(k))
    rows = [(k, text(rng.randint(0, 60))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " .,\x7f"), (None, text(30)), (5, rows[5][1]), (5, rows[5][1]), (n + 3, text(5000)), (None, None)]
    return rows, [text(25) for _ in range(10)] + [None, ""]


def test_suffixes_against_sorting():
    rng = random.Random(1)
    for depth in (1, 2, 3, 5):
        docs = [[rng.randint(0, 3) for _ in range(rng.randint(0, 12))] for _ in range(15)]
        ids = np.array([x for d in docs for x in d], np.int64)
        left = np.array([len(d) - k for d in docs for k in range(len(d))], np.int64)
        tail = lambda p: tuple(ids[p : p + min(depth, left[p])])  # noqa: B023, E731
        order, lcp = resample.suffixes(ids, left, depth)
        assert sorted(order.tolist()) == list(range(len(ids)))
        tails = [tail(p) for p in order.tolist()]
        assert tails == sorted(tails)
        for k in range(1, len(tails)):
            a, b = tails[k - 1], tails[k]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("low, high", [(1, 1), (1, 2), (2, 4), (7, 7)])
def test_features(low, high):
    rows, _ = made_up(60)
    texts = [(t or "").encode() for _, t in rows]
    for buckets in (97, 1 << 20):
        words, packed = resample.hashed(texts, low, high, buckets)
        for (_, t), n, b in zip(rows, words.tolist(), packed):
            w, g = grams(t, low, high)
            assert n == len(w) and np.frombuffer(b, resample.kind_of(buckets)).tolist() == [zlib.crc32(x.encode()) % buckets for x in g]


@pytest.mark.parametrize("low, high, buckets, percent", [(1, 1, 10_000, 10), (1, 2, 50, 37), (3, 3, 1 << 17, 100), (1, 1, 1, 0)])
def test_against_brute_force(spark, monkeypatch, low, high, buckets, percent):
    monkeypatch.setattr(resample, "BLOCK", 300)
    rows, target = made_up(150)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    out, n = resample.resample(df, aim, low=low, high=high, buckets=buckets, percent=percent)
    assert out.columns == ["doc_id", "text", "score", "n_features", "weight", "_score", "rank"] and n["score"] == "_score"
    got = [(r.doc_id, r.n_features, r.weight, r._score, r["rank"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, target, low, high, buckets, percent=percent)))
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1))
    drawn = resample.drawn_rows(df, aim, low=low, high=high, buckets=buckets, percent=percent)
    assert drawn.columns == df.columns and drawn.count() == len(ranks)


def test_many_ties(spark):
    """One score for most rows: ids decide, and no range gets them all."""
    df = spark.range(4000).select((F.col("id") % 3).alias("doc_id"), F.lit("word " * 25).alias("text"))
    scored, n = resample.resample(df, df.limit(0), percent=50)
    rows = scored.collect()
    drawn = sorted((r["rank"], -r.score, r.doc_id) for r in rows if r["rank"])
    assert [r[0] for r in drawn] == list(range(1, 2001)) and drawn == sorted(drawn)
    assert [x[1:] for x in drawn] == sorted((-r.score, r.doc_id) for r in rows)[:2000]
    tied = df.withColumn("doc_id", F.lit(1).cast("long"))
    order = [F.col("doc_id"), F.col("row")]
    parts = resample.ranked(tied.select("doc_id").withColumn("row", F.monotonically_increasing_id()), order, "rank", 4000)
    assert sorted(r["rank"] for r in parts.collect()) == list(range(1, 4001))


def test_empty_and_refused(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out, _ = resample.resample(docs, docs)
    assert out.count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert [tuple(r)[2:] for r in resample.resample(one, docs)[0].collect()] == [r[1:] for r in brute([(1, "a " * 30)], [])]
    for bad in ({"low": 0}, {"low": 2, "high": 1}, {"buckets": 0}, {"percent": 101}, {"least": 0}):
        with pytest.raises(ValueError):
            resample.resample(docs, docs, **bad)
    with pytest.raises(TypeError):
        resample.resample(one.withColumn("doc_id", F.lit("x")), docs)
