import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vaultmill.llm import common, grid, simhash


def fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints():
    for t in [None, "", " \t ", "One", "a b c", "A b\u00a0c d e f", "É é x y z w", "x " * 70000, "a b c d " * 3]:
        assert simhash.fingerprint((t or "").encode()) == fingerprint(t)


def test_components(spark):
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(300)]
    other = [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(80)]
    edges = path + star + other + [(7, 7), (1, 0)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    pairs = {(at[a], at[b]) for a, b in edges} | {(at[b], at[a]) for a, b in edges}
    want = {nodes[i]: nodes[r] for i, r in enumerate(roots(len(nodes), lambda i, j: (i, j) in pairs))}
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("room, slices", [(simhash.ROOM, simhash.SLICE), (3000, 8)])
def test_ball_hashing_finds_all_links(spark, monkeypatch, room, slices):
    monkeypatch.setattr(simhash, "ROOM", room)
    monkeypatch.setattr(simhash, "SLICE", slices)
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for p in list(prints)[:40]:
        for _ in range(4):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
            prints.add(p)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p, k) for p in signed for k in (0, 3) if k == 0 or p % 2], "fp long, tab int")
    found = simhash.links(df, len(signed)).where("tab = 0")
    odd = {x for r in simhash.links(df, len(signed)).where("tab = 3").collect() for x in r[1:]}
    assert odd and all(x % 2 for x in odd)  # tables do not meet
    comp = {r.node: r.root for r in common.components(found).collect()}
    want = roots(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    groups = {}
    for p, r in zip(signed, want):
        groups.setdefault(r, set()).add(p)
    for g in groups.values():
        assert {comp.get(p, p) for p in g} == {min(g)}


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 99)) for _ in range(120)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40):
        w = base[i % 6].split()
        w[rng.randrange(len(w))] = "edit"
        rows.append((10 + i, " ".join(w)))
    rows += [(100, None), (101, ""), (None, "  "), (102, base[0].upper()), (102, base[0].upper()), (None, "lonely text of four words"), (103, "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    fp = [fingerprint(t) for _, t in rows]
    want = roots(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    least = {}
    for (i, _), r in zip(rows, want):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert sorted(map(str, [(i, f - 2**64 if f >= 2**63 else f, least.get(r)) for (i, _), f, r in zip(rows, fp, want)])) == sorted(map(str, map(tuple, got)))
    # the stage links by the shingles of five words; a few edits leave enough of them, empty texts are one
    kept = simhash.one_of_each(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["0", "1", "2", "3", "4", "5", "100", "103", "None"])


@pytest.mark.parametrize("few", [0, 1000])
def test_stage_finds_similar_texts(spark, monkeypatch, few):
    """Pairs of similarity 0.8 and more are found (most of them), pairs below are left alone (all of them)."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(4)
    rows, close = [], {}
    for i in range(120):
        w = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(w)
        for k in rng.sample(range(200), 2 + i % 8):
            other[k] = "edit"
        a, b = ({tuple(x[k : k + 5]) for k in range(196)} for x in (w, other))
        close[i] = len(a & b) / len(a | b)
        rows += [(i, " ".join(w)), (1000 + i, " ".join(other))]
    rows += [(3000 + i, " ".join(f"c{k}" for k in range(60 + i // 20))) for i in range(100)]  # copies, and copies that go on
    left = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert set(range(120)) <= left and {i for i in left if i >= 3000} == {3000}
    similar = {i for i in close if close[i] >= 0.8}
    assert not {i for i in range(120) if 1000 + i not in left} - similar
    assert sum(1000 + i not in left for i in similar) >= 0.9 * len(similar) > 20


def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_of(spark, texts):
    return {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}


def test_stage_keeps_texts_that_share_a_repeated_line(spark):
    """Texts of which a repeated shingle makes the most are no copies of each other."""
    rng = random.Random(11)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    menu = "home about contact imprint privacy terms "
    texts = ["la " * 900 + own(400) for _ in range(6)] + [menu * 40 + own(250) for _ in range(6)] + [menu * 200 + own(12) for _ in range(6)] + [own(30) + " x" * 5000 for _ in range(6)]
    assert max(jaccard(a, b) for a in texts for b in texts if a is not b) < 0.6
    assert kept_of(spark, texts) == set(range(len(texts)))


def test_stage_against_exact_similarity(spark, monkeypatch):
    """Texts with repeats, copies of copies, equal fingerprints: no link below 0.8 ever, and most links above."""
    rng = random.Random(12)
    texts = []
    for _ in range(40):
        line = " ".join(f"r{rng.randrange(50)}" for _ in range(rng.randint(1, 8)))
        w = [x for _ in range(rng.randint(1, 60)) for x in rng.choice([[f"w{rng.randrange(3000)}"], line.split()])]
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 5)):
            w = list(w)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            texts.append(" ".join(w))
    texts += ["one two three four", "One  two three four", "one two three five", "a", "b", "", " "]
    near = roots(len(texts), lambda i, j: texts[i] == texts[j] or jaccard(texts[i], texts[j]) >= 0.8)
    kept = kept_of(spark, texts)
    assert {near[i] for i in range(len(texts))} <= kept  # the smallest of every group stays
    wrongly = len(kept) - len(set(near))
    assert wrongly <= 0.1 * (len(texts) - len(set(near)))
    # the same if every fingerprint is equal: nothing is taken for a copy that is none
    monkeypatch.setattr(simhash, "majority", lambda h: 0)
    monkeypatch.setattr(simhash, "simhashes", lambda tables, width: lambda c: F.array(*[F.lit(0).cast("long")] * tables))
    assert {near[i] for i in range(len(texts))} <= kept_of(spark, texts)


def test_stage_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f", 1)] * 30 + [(1, "other words that are not alike", 2), (None, "a b c d e f", 3), (None, None, 4), (None, None, 5)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, i long")).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, [(1, "a b c d e f"), (1, "other words that are not alike"), (None, None)]))


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == simhash.one_of_each(empty).count() == 0


def vectors(seed, n=300, dim=12):
    rng = np.random.default_rng(seed)
    rows, centers = [], rng.normal(size=(8, dim))
    for i in range(n):
        v = centers[i % 8] + rng.normal(size=dim) * 0.15 * (i % 3)
        rows.append((i, (v * rng.uniform(0.1, 9)).astype(np.float32).tolist(), i % 8 % 3))
    rows += [(n + i, rows[0][1], rows[0][2]) for i in range(40)]  # a group of copies
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * dim, 1), (903, [float("nan")] + [1.0] * (dim - 1), 1), (904, [None] + [1.0] * (dim - 1), 1), (905, [float("inf")] * dim, 1)]
    rows += [(906, rows[0][1], None), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0), (909, [1e-30] * dim, 0), (910, [1e30] * dim, 0)]
    return rows


@pytest.mark.parametrize("seed, room, small, crowd", [(1, 1 << 21, 64, 256), (2, 768, 4, 2), (3, 100, 2, 1)])
def test_grid_join_is_exact(spark, monkeypatch, seed, room, small, crowd):
    monkeypatch.setattr(grid, "ROOM", room)
    monkeypatch.setattr(grid, "SMALL", small)
    monkeypatch.setattr(grid, "CROWD", crowd)
    rows = vectors(seed)

    def ok(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        (_, a, p), (_, b, q) = rows[i], rows[j]
        if p is None or p != q or not ok(a) or not ok(b) or len(a) != len(b):
            return False
        a, b = np.array(a, float), np.array(b, float)
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98

    n = len(rows)
    want_links = [sum(linked(i, j) for j in range(n) if j != i) for i in range(n)]
    want = roots(n, linked)
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string")
    if seed == 2:  # labels may be text
        table = table.withColumn("label", F.concat(F.lit("l"), F.col("label").cast("string")))
    got = {r.vec_id: r for r in grid.near_vectors(table).collect()}
    assert len(got) == n
    for k, (i, _, _) in enumerate(rows):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (want_links[k], rows[want[k]][0], rows[want[k]][0] == i)


def test_ids_must_be_whole_numbers(spark):
    rows = spark.createDataFrame([("a", [1.0], "x", "t")], "vec_id string, embedding array<float>, label string, text string")
    with pytest.raises(TypeError):
        grid.near_vectors(rows)
    with pytest.raises(TypeError):
        simhash.near_duplicates(rows, id_col="vec_id")


def test_grid_join_with_repeated_and_null_ids(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, v, 0), (1, v, 0), (1, w, 0), (None, w, 0), (None, [1.0, 1.0], 0)]
    got = sorted(map(str, map(tuple, grid.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())))
    assert got == sorted(map(str, [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (None, 1, 1, False), (None, 0, None, True)]))
    assert grid.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_unsettled_components_raise(spark):
    path = spark.createDataFrame([(i * 7919 % 64, (i + 1) * 7919 % 64) for i in range(63)], "a long, b long")
    with pytest.raises(RuntimeError):
        common.components(path, max_rounds=2)
    assert {r.root for r in common.components(path).collect()} == {0}


def test_groups_yield_few_pairs(spark):
    """A group of many near copies makes as many candidate pairs as members, not all of them."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    group = {base}
    while len(group) < 600:
        group.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    far = {rng.getrandbits(64) for _ in range(200)}
    signed = [p - 2**64 if p >= 2**63 else p for p in group | far]
    found = simhash.links(spark.createDataFrame([(p, 0) for p in signed], "fp long, tab int"), len(signed), bits=40, slice_=4096)
    got = found.distinct().select("a", "b").collect()
    assert len(got) < 2 * len(group)
    comp = {r.node: r.root for r in common.components(spark.createDataFrame(got)).collect()}
    assert len({comp.get(p, p) for p in signed if p % 2**64 in group}) == 1 and not {p % 2**64 for p in comp} & far
