import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vaultmill.llm import repeats
from vaultmill.llm.lyndon import suffix_array


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_order(letters):
    s = [*letters, 0]
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows):
    """rows in corpus order; rows that repeat id and text are one document."""
    seen, out, done = {}, [], {}
    for i, t in rows:
        if (i, t) in done:
            out.append(done[i, t])
            continue
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                cover[s] += 1
                cover[s + 100] -= 1
            seen.setdefault(w, 1)
        c = np.cumsum(cover)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        done[i, t] = (i, len(b), int(c.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~c].tobytes()).hexdigest())
        out.append(done[i, t])
    return out


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, edge = text(60), text(40)
    rows = []
    for i in range(120):
        t = text(rng.randint(1, 80))
        if i % 3 == 0:
            t = f"{t} {passage} {text(20)}"
        if i % 7 == 0:
            k = rng.randint(0, 50)
            t = t + passage[k : k + 99 + i % 3]
        if i % 11 == 0:
            t = f"{edge}{i % 2}{edge}{t}"
        rows.append((i, t))
    copy = rows[5][1] + text(90)
    rows += [(200 + i, copy) for i in range(30)]
    rows += [(230 + i, copy[: 200 + i] + "#" + copy[200 + i :]) for i in range(30)]
    rows += [(300, "ab" * 400), (301, "ab" * 400), (302, "a" * 1000), (303, None), (304, ""), (305, "x" * 99), (306, "y" * 100), (307, "y" * 101), (307, "y" * 101)]
    return rows


@pytest.mark.parametrize("hot, sort, chunk, crowd", [(4096, 1 << 18, 1 << 19, 64), (8, 2000, 1 << 19, 64), (4096, 500, 700, 64), (4096, 1 << 18, 1 << 19, 2), (20, 500, 700, 5)])
def test_removed_bytes(spark, monkeypatch, hot, sort, chunk, crowd):
    for name, value in (("HOT", hot), ("SORT", sort), ("CHUNK", chunk), ("CROWD", crowd)):
        monkeypatch.setattr(repeats, name, value)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(5)
    got = [tuple(r) for r in repeats.repeats(df).drop("kept").collect()]
    assert sorted(got) == sorted(brute(rows))


def test_colliding_hashes_remove_nothing(spark, monkeypatch):
    """The 64-bit numbers only group and set aside: with three bits left the results are the same."""
    stir = repeats.stir
    monkeypatch.setattr(repeats, "stir", lambda x: stir(x) & repeats.U(0xE000000000000000))
    rows = corpus()[::2]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for crowd in (64, 2):
        monkeypatch.setattr(repeats, "CROWD", crowd)
        assert sorted(tuple(r) for r in repeats.repeats(df).drop("kept").collect()) == sorted(brute(rows))


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        repeats.repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_kept_text_and_null_ids(spark):
    t = "".join(chr(97 + i * i % 23) + str(i) for i in range(60))
    rows = spark.createDataFrame([(1, t), (2, "head " + t), (None, t + " tail")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in repeats.repeats(rows).collect()}
    assert got == {1: t, 2: "head ", None: " tail"}
    assert repeats.repeats(rows.limit(0)).count() == 0
