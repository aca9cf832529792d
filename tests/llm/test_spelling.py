import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vaultmill.llm import spelling


def words_of(rows, least=7, seen=2, every=31):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    return {w: c for w, c in n.items() if c >= seen}


def edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, times=10):
    near = {w: [v for v in words if edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def vocabulary(n, seed=3):
    """Words in groups of near ones, with repeats of letters, and lengths on both sides of each class."""
    rng, out = random.Random(seed), set()
    letters = "abné"
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.choice([7, 7, 8, 8, 9, 12, 13, 30])))
        for _ in range(rng.randint(1, 6)):
            out.add(w)
            k = rng.randint(0, len(w))
            w = rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + w[k + 1 :]])
            w = w if len(w) >= 7 else w + "abnab"[: 7 - len(w)]
    out |= {"a" * k for k in range(7, 16)} | {"ab" * k for k in range(4, 9)} | {"prefixed" + c for c in "abcdefgh"} | {"x" * 500, "x" * 499 + "y", "x" * 501}
    return {w: rng.choice([2, 2, 3, 5, 30, 400]) for w in sorted(out)}


@pytest.mark.parametrize("crowd, room, chunk", [(spelling.CROWD, spelling.ROOM, spelling.CHUNK), (5, 40, 30), (1, 7, 64)])
def test_neighbours_against_brute_force(spark, monkeypatch, crowd, room, chunk):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "ROOM", room)
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    words = vocabulary(500)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(r.word, r.n_near, r.best_n, r.best) for r in spelling.neighbours(df).collect()}
    want = set()
    for w in words:
        near = sorted((v for v in words if edit(w, v)), key=lambda v: (-words[v], v))
        if near:
            want.add((w, len(near), words[near[0]], near[0]))
    assert got == want
    if crowd == 1:  # cut down to one open character
        posted = spelling.dealt(df).groupBy("block", "m", "a", "b").count().join(spelling.dealt(df).select("block", "m", "a", "b").distinct(), ["block", "m", "a", "b"])
        assert not [r for r in posted.collect() if r["count"] > crowd and r.m - r.a - r.b > 1]


def test_count_filter_loses_nothing_and_drops_much():
    """Whatever is near passes the filter; of what the shortest lists bring, it drops pairs before verification."""
    words = list(vocabulary(400))
    n = len(words)
    size = np.array([len(w) for w in words])
    dropped = 0
    for m in (8, 9, 13):
        own = np.flatnonzero((size == m) | (size == m - 1))
        zero = np.zeros(len(own), np.int64)
        b = spelling.Block(zero, zero + m, zero, zero, [words[i] for i in own], zero + n)
        found = {(x, y) for xs, ys in b.candidates() for x, y in zip(xs.tolist(), ys.tolist())}
        for i, v in enumerate(b.words):
            for j, w in enumerate(b.words):
                if len(v) == m and edit(v, w) and (len(w) < m or j < i):
                    assert (i, j) in found and b.enough(np.array([i]), np.array([j]))[0] and b.near(np.array([i]), np.array([j]))[0]
        x, y = (np.array(c) for c in zip(*sorted(found)))
        passed = b.enough(x, y)
        dropped += (~passed).sum()
        assert not (b.near(x, y) & ~passed).any()
        for i, j in zip(x[passed].tolist(), y[passed].tolist()):
            assert b.near(np.array([i]), np.array([j]))[0] == edit(b.words[i], b.words[j])
    assert dropped


def test_batches_that_cut_blocks(monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 10)
    words = [(g, f"{'abcdefgh'[g]}{x}bcdefg") for g in range(8) for x in "aeiou"]
    rows = pa.table({"block": [g for g, _ in words], "m": [8] * 40, "a": [0] * 40, "b": [0] * 40, "word": [w for _, w in words], "n": list(range(40))})
    for size in (1, 3, 7, 40):
        out = pa.Table.from_batches(list(spelling.search(iter(rows.to_batches(size))))).to_pylist()
        assert len(out) == 40 and all(r["n_near"] == 4 for r in out)
    assert list(spelling.search(iter([]))) == [] and list(spelling.search(iter(rows.slice(0, 0).to_batches()))) == []


def test_variants(spark):
    rng = random.Random(9)
    common = ["station", "mountain", "Übergröße", "différente", "ONTOLOGY", "banana", "sevenly", "a" * 4000]
    rows = []
    for i in range(400):
        ws = [rng.choice(common) for _ in range(rng.randint(0, 30))]
        rows.append((i, rng.choice([" ", ", ", "1", "×"]).join(ws)))
    rows += [(1000 + i, "statiom mountian mountann mountannn différentes") for i in range(2)] + [(None, "station banane"), (None, None), (7, None), (8, ""), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int").repartition(4)
    got = [tuple(r) for r in spelling.variants(df).collect()]
    want = brute(words_of(rows))
    assert set(got) == want and len(got) == len(want)
    assert any(r[1] for r in got) and len({r[2] for r in got}) < len(got)
    many = [tuple(r) for r in spelling.variants(df, every=2, times=2, least=5).collect()]
    assert set(many) == brute(words_of(rows, 5, 2, 2), 2)
    assert any(r[2] not in (r[0], r[1]) for r in many)  # chains
    assert spelling.variants(df.limit(0)).count() == 0
