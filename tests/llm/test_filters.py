import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultmill.llm import chat, hosts, leaks, quality, shard, simhash, warc


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 20, "y" * 100
    rows = [(3, "http://a/ b\r\nX: y", big), (1, None, big), (2, "u", "short"), (9, "u", "short"), (4, "u", None), (5, "u", ""), (6, "u", other), (7, "u", other), (6, "u", other), (None, "u", other), (None, "u", big + "z"), (8, "u", "é" * 50), (10, "u", "é" * 50)]
    path = str(tmp_path / "archives")
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archives(df, path)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b and len(b) >= 100]
        first = min([j for j in same if j is not None], default=None)
        again = len(b) >= 100 and first is not None and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    got = [tuple(r) for r in warc.read_archives(spark, path).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    heads = [h for f in (tmp_path / "archives").glob("part*") for h, _ in warc.records(io.BufferedReader(gzip.open(f))) if h["warc-type"] != "warcinfo"]
    assert len(heads) == len(rows) and {h["warc-record-id"] for h in heads if h["warc-type"] == "response"} >= {h["warc-refers-to"] for h in heads if h["warc-type"] == "revisit"}
    warc.write_archives(df.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def members(data):
    """Unpacks one gzip member after the other."""
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data) + d.flush()
        data = d.unused_data


@pytest.mark.parametrize("few", [0, 10])
def test_archives_are_small_and_seekable(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW", few)
    rng = random.Random(7)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdef<>é ") for _ in range(400)) * (1 + i % 3)) for i in range(60)]
    rows += [(100 + i, "http://copy/", rows[7][2]) for i in range(50)] + [(200, "http://large/", "z" * (17 << 20)), (201, None, "z" * (17 << 20))]
    path = tmp_path / "a"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), str(path), room=3000)
    files = list(path.glob("part*"))
    assert len(files) > 5
    seen = 0
    for f in files:
        parts = [m for m in members(f.read_bytes()) if m]
        assert b"WARC-Type: warcinfo" in parts[0] and b"".join(parts) == gzip.decompress(f.read_bytes())
        seen += len(parts) - 1
        for m in parts:
            assert len(list(warc.records(io.BytesIO(m)))) == 1  # a record can be read on its own
        assert sum(len(gzip.compress(m)) for m in parts[:-1]) < 6000
    assert seen == len(rows)
    got = {r.page_id: r for r in warc.read_archives(spark, str(path)).collect()}
    assert len(got) == len(rows) and all(got[100 + i].refers_to == 7 for i in range(50)) and got[201].refers_to == 200 and got[201].payload_bytes == 17 << 20
    assert b"WARC-Date: 2" in gzip.decompress(files[0].read_bytes())


@pytest.mark.parametrize("bad", [b"HTTP\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"])
def test_broken_archives(bad):
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(bad)))


PAGES = "page_id long, url string, html string, host string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(rows)], PAGES)


def rules(spark, rows):
    return spark.createDataFrame(rows, "action string, host string, path string")


@pytest.mark.parametrize(
    "url, host, path",
    [
        ("HTTP://A.Example.COM/En/x?q#f", "a.example.com", "/En/x"),
        ("http://h", "h", ""),
        ("http://h?x", "h", ""),
        ("http://h#x/y", "h", ""),
        ("a://b://c/d", "b:", "//c/d"),
        ("no scheme", "", ""),
        ("", "", ""),
        (None, "", ""),
        ("x:///p", "", "/p"),
        ("http://É.x/p", "É.x", "/p"),
    ],
)
def test_url_parts(spark, url, host, path):
    d = spark.createDataFrame([(url,)], "u string").select(hosts.host_of(F.col("u")), hosts.path_of(F.col("u"))).first()
    assert tuple(d) == (host, path)


def test_rules(spark):
    urls = ["http://com/en/", "http://x.com/en/7", "http://a.example.com/en/77", "http://example.com/en/8", "http://notexample.com/en/7", "http://b.net/de/8", "http://example.net/de/81", "http://example.net/de", "http://org/es/", "http://com.org/es/q", None]
    out, n = hosts.filter_urls(pages(spark, [(u, None) for u in urls]), rules(spark, hosts.RULES))
    got = {r.page_id: (r[n["rule"]], r[n["verdict"]]) for r in out.collect()}
    assert n["host"] == "_host" and len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"^.*?://([^/?#]*)([^?#]*)", u or "")
        h, p = (m[1], m[2]) if m else ("", "")
        fit = [(len(a + b), act, a + b) for act, a, b in hosts.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        if fit:
            assert got[i] == (max(fit)[2], max(fit)[1])
        else:
            assert got[i][0] is None and got[i][1] in ("allow", "block")


def ppr(n, edges, seeds, damping=0.85, rounds=200):
    out = np.zeros((n, n))
    for a, b, w in edges:
        out[a, b] += w
    total = out.sum(axis=1)
    s = np.array(seeds, float) / sum(seeds)
    r = s.copy()
    for _ in range(rounds):
        back = r[total == 0].sum()
        r = (1 - damping) * s + damping * (s * back + (r / np.where(total == 0, 1, total)) @ out)
    return r


def test_walks(spark):
    link = lambda *to: "".join(f"<a class=x href='{t}'>" for t in to)
    rows = [
        ("http://good.org/ok/1", link("http://near.org/x", "//FRIEND.org", "/own", "http://good.org/y")),
        ("http://near.org/x", link("https://friend.org/?", "https://friend.org/2")),
        ("http://friend.org/", ""),
        ("http://spammer.org/", link("http://bad.org/1", "http://friend.org/")),
        ("http://bad.org/no/1", link("http://spammer.org/")),
        ("http://alone.org/", None),
    ]
    r = rules(spark, [("allow", "good.org", "/ok/"), ("block", "bad.org", "/no/")])
    out, n = hosts.filter_urls(pages(spark, rows), r)
    got = {x[n["host"]]: x for x in out.collect()}
    names = ["good.org", "near.org", "friend.org", "spammer.org", "bad.org", "alone.org"]
    e = [(0, 1, 1), (0, 2, 1), (1, 2, 1), (3, 4, 1), (3, 2, 1), (4, 3, 1)]
    trust, distrust = ppr(6, e, [1, 0, 0, 0, 0, 0]), ppr(6, [(b, a, w) for a, b, w in e], [0, 0, 0, 0, 1, 0])
    for i, h in enumerate(names):
        assert got[h][n["trust"]] == pytest.approx(trust[i], abs=1e-4) and got[h][n["distrust"]] == pytest.approx(distrust[i], abs=1e-4)
    assert {h: got[h][n["verdict"]] for h in names} == {"good.org": "allow", "near.org": "allow", "friend.org": "allow", "spammer.org": "block", "bad.org": "block", "alone.org": "allow"}
    out, n = hosts.filter_urls(pages(spark, rows), rules(spark, []))
    assert {x[n["verdict"]] for x in out.collect()} == {"allow"}
    assert hosts.filter_urls(pages(spark, []), r)[0].count() == 0


def test_walk_settles_far_from_seeds(spark):
    e = [(i, i + 1, 1) for i in range(12)] + [(12, 0, 1), (3, 12, 2)]
    name = lambda i: f"h{i:02}"
    nodes = spark.createDataFrame([(name(i),) for i in range(14)], "host string")
    edges = spark.createDataFrame([(name(a), name(b), n) for a, b, n in e], "src string, dst string, n long")
    got = {r.host: r["rank"] for r in hosts.walk(nodes, edges, spark.createDataFrame([("h00", 5.0)], "host string, mass double"), damping=0.05).collect()}
    want = ppr(14, e, [1] + [0] * 13, damping=0.05)
    assert all(got[name(i)] == pytest.approx(want[i], rel=1e-6, abs=0) for i in range(14)) and want[11] > 0 == got["h13"]


def test_preferences(spark):
    rows = [
        (1, 0, 0, "user", "q"), (1, 0, 1, "assistant", "yes"), (1, 0, 2, "user", "and"), (1, 0, 3, "assistant", "é"),
        (1, 1, 0, "user", "q"), (1, 1, 1, "assistant", "no"),
        (2, 0, 0, None, None), (2, 1, 0, None, None), (2, 1, 1, "assistant", None),
        (3, 0, 0, "user", "alone"), (None, 0, 0, "user", "x"), (4, 0, 0, "user", "a"), (4, 1, 0, "system", "a"), (4, 0, None, "user", "z"), (4, 0, None, "user", "z"),
    ]
    df = spark.createDataFrame(rows, "pair long, side int, turn int, role string, text string")
    got = {r.pair: r for r in chat.preferences(df).collect()}
    assert set(got) == {1, 2, 4}
    r = got[1]
    assert (r.shared_turns, r.prompt, r.rejected) == (1, "<|user|>\nq<|end|>\n", "<|assistant|>\nno<|end|>\n")
    a, b = r.chosen_mask.split(",")[1].split(":")
    assert r.chosen[int(a) : int(b)] == "é<|end|>" and r.rejected_mask == "14:23"
    assert (got[2].shared_turns, got[2].chosen, got[2].rejected_mask) == (1, "", "14:21") and got[2].prompt == "<||>\n<|end|>\n"
    assert got[4].shared_turns == 0 and got[4].prompt == "" and got[4].chosen.count("z") == 2
    assert chat.preferences(df.limit(0)).count() == 0


def score(item, text):
    h = np.zeros((len(item) + 1, len(text) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment():
    rng = random.Random(4)
    for _ in range(200):
        a = np.array([rng.randint(1, 4) for _ in range(rng.randint(1, 12))])
        b = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 30))], np.int64)
        s, e, got = leaks.align(a, b)
        assert got == score(a.tolist(), b.tolist()) == score(a.tolist(), b[s:e].tolist())


def test_leaks(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    item = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [item(40) for _ in range(12)] + [item(3), item(9)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, " .. ")]
    docs = []
    for d in range(150):
        body = item(rng.randint(0, 200))
        if d % 3 == 0:
            w = list(items[d % 14])
            for _ in range(min(len(w) // 10, d % 5)):
                w[rng.randrange(len(w))] = "other"
            if d % 4 == 0 and len(w) > 20:
                del w[20]
            at = rng.randint(0, len(body))
            body[at:at] = [x.upper() + "," for x in w]
        docs.append((d, " ".join(body)))
    docs += [(200, None), (201, ""), (None, bench[0][1]), (202, " ".join(items[1][:20])), (203, (bench[2][1] + " ") * 30)]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    words = lambda t: leaks.WORDS.findall((t or "").lower())
    want = {}
    for d, t in docs:
        for i, w in bench:
            if words(w) and (sim := (score(words(w), words(t)) + len(words(w))) / (2 * len(words(w)))) >= leaks.LEAST:
                want[d, i] = sim
    got = {(r.doc_id, r.item_id): r for r in leaks.leaks(df, b).collect()}
    long = {k: v for k, v in want.items() if len(words(dict(bench)[k[1]])) > 10}
    assert {k for k in got if len(words(dict(bench)[k[1]])) > 10} == set(long) and set(got) <= set(want)
    assert all(got[k].similarity == pytest.approx(v) for k, v in long.items())
    assert (None, 0) in got and (203, 2) in got
    hit = {k[0] for k in got}
    assert sorted(map(str, (r.doc_id for r in leaks.clean(df, b).collect()))) == sorted(map(str, (d for d, _ in docs if d not in hit)))
    assert leaks.leaks(df, b.limit(0)).count() == 0 and leaks.clean(df, b.limit(0)).count() == len(docs) and leaks.leaks(df.limit(0), b).count() == 0


def test_leaks_of_short_items(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(40)]
    items = [[rng.choice(vocab) for _ in range(n)] for n in range(1, 17) for _ in range(3)]
    items += ["a b c d e".split(), "f g h i".split(), "r r s r r".split()]
    docs = ["x a b other d e y", "x f g other h i y", "r r r r"]
    for w in items * 6:
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = [rng.choice(["other", *vocab])] * rng.randint(0, 1)
        docs.append(" ".join([*rng.choices(vocab, k=rng.randint(0, 6)), *w, *rng.choices(vocab, k=rng.randint(0, 6))]))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    want = {(i, k): sim for i, t in enumerate(docs) for k, w in enumerate(items) if (sim := (score(w, t.split()) + len(w)) / (2 * len(w))) >= leaks.LEAST}
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks.leaks(d, b, shortest=1).collect()}
    usual = {(r.doc_id, r.item_id) for r in leaks.leaks(d, b).collect()}
    assert usual == {k for k in want if len(items[k[1]]) >= leaks.SHORTEST} != set(want)
    assert (0, len(items) - 3) in want and (1, len(items) - 2) in want and {len(items[k]) for _, k in want} == set(range(1, 17))
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_items_of_one_template(spark, monkeypatch):
    """Thousands of items share most of their words; all links are found, by either way of fetching."""
    rng = random.Random(12)
    template = [f"t{i}" for i in range(14)]
    items = [[*template[:7], *(f"w{rng.randrange(3000)}" for _ in range(6)), *template[7:]] for _ in range(2000)]
    docs = [" ".join([f"x{rng.randrange(99)}", *items[rng.randrange(2000)], "end"]) for _ in range(30)] + [" ".join(template)] * 20 + ["clean words only"] * 20
    docs.append(" ".join(w for it in items[:150] for w in it))  # a dump of the benchmark
    d = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(docs)], "doc_id long, text string, i string, t string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").repartition(4)
    some = rng.sample(range(2000), 40) + [int(r) for r in range(5)]
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(d, b).collect()}
    for k in some:
        for i, t in enumerate(docs):
            sim = (score(items[k], t.split()) + 20) / 40
            assert ((i, k) in got) == (sim >= leaks.LEAST), (i, k, sim)
    assert {i for i, _ in got} >= set(range(30)) and {k for i, k in got if i == 70} >= set(range(150)) and not {i for i, _ in got} & set(range(30, 70))
    monkeypatch.setattr(leaks, "FEW", 0)
    monkeypatch.setattr(leaks, "FILTER", 10)  # a filter that lets nearly everything through
    monkeypatch.setattr(leaks, "TOGETHER", 3)
    monkeypatch.setattr("vaultmill.llm.common.CROWD", 4)
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(d, b).collect()} == got
    left = leaks.clean(d, b)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == list(range(30, 70))


def test_salted_join(spark):
    from vaultmill.llm.common import salted

    many = spark.createDataFrame([(i % 3 if i % 2 else 7, i) for i in range(200)] + [(None, 1)], "k long, part int")
    few = spark.createDataFrame([(7, "a"), (1, "b"), (1, "c"), (5, "d")], "k long, slot string")
    want = sorted(map(str, many.join(few, "k").collect()))
    assert sorted(map(str, salted(many, few, ["k"], ["part"], 8).collect())) == want
    assert salted(many.limit(0), few, ["k"], ["part"]).count() == 0


def made(rng, good):
    words = [rng.choice(["river", "stone", "cloud", "field"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(20, 80))]
    return " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)


def test_classifier(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        rows.append((i, made(rng, good), ["en", "de"][i % 2], f"s{i % 7}", good))
        if i < 400:
            labels.append((i, int(good), 0))
    rows += [(1000, None, None, None, True), (1001, "", "en", "s1", True)]
    d = spark.createDataFrame([(*r[:4], 1.0) for r in rows], "doc_id long, text string, lang string, source string, p double")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (0, None, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(d, lab).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[400:600]]
    assert sum(got[r[0]].keep == r[4] for r in held) >= 0.97 * len(held)
    assert quality.judge(d, lab.limit(0)).where("not keep").count() == 0
    kept = quality.kept(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r.keep for r in got.values())
    assert quality.judge(d.limit(0), lab).count() == 0


def test_classifier_learns_rare_words():
    rng = random.Random(5)
    insults = [f"{i}{i}insult" for i in range(5)]

    def row(bad):
        words = [rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(40)]
        return " ".join([*words, rng.choice(insults)] if bad else words)

    y = np.array([float(i % 10 == 0) for i in range(400)])
    rows = [quality.features(row(x)) for x in y]
    w = quality.Sample(np.concatenate(rows), np.array([len(r) for r in rows])).train(y)
    said = [w[quality.features(row(i % 10 == 0))].sum() + w[-1] > 0 for i in range(400)]
    assert sum(said[::10]) >= 36 and sum(said) - sum(said[::10]) <= 4


def test_sites_shrink(spark):
    rows = [("big", "a", 0.9)] * 400 + [("big", "b", 0.8)] * 400 + [("bad", "a", 0.1)] * 400 + [("tiny", "a", 0.1)]
    s = {(r.host, r.path): r for r in quality.sites(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    mean = sum(r[2] for r in rows) / len(rows)
    assert s["big", "a"].overall == pytest.approx(mean)
    assert abs(s["big", "a"].base - 0.85) < 0.02 and s["bad", "a"].base < 0.15
    assert 0.1 < s["tiny", "a"].base < mean and s["tiny", "a"].base > s["bad", "a"].base


def by_hand(rows):
    """The posteriors of (host, path, p) rows by the formulas of the docstring, one row after the other."""
    groups = lambda key: {k: [r[2] for r in rows if key(r) == k] for k in {key(r) for r in rows}}
    hosts, paths = groups(lambda r: r[0]), groups(lambda r: r[:2])
    n, total = len(rows), sum(r[2] for r in rows)
    mean = min(max(total / n, 1e-4), 1 - 1e-4)
    square = lambda g: sum(sum(v) ** 2 / len(v) for v in g.values())
    each = sum(r[2] ** 2 for r in rows)

    def strength(between, groups, above, within):
        noise = within / max(1, n - groups)
        spread = max(0.0, between / max(1, groups - above) - noise) / max(1.0, n / max(1, groups))
        return min(1e6, max(1.0, mean * (1 - mean) / max(spread, 1e-9) - 1))

    k_host = strength(square(hosts) - total**2 / n, len(hosts), 1, each - square(hosts))
    k_path = strength(square(paths) - square(hosts), len(paths), len(hosts), each - square(paths))
    clip = lambda x: min(max(x, 1e-9), 1 - 1e-9)
    logit = lambda x: math.log(clip(x) / (1 - clip(x)))
    out = []
    for h, q, p in rows:
        base = (sum(hosts[h]) + k_host * mean) / (len(hosts[h]) + k_host)
        site = (k_path * base + sum(paths[h, q]) - p) / (k_path + len(paths[h, q]) - 1)
        score = logit(p) + logit(site) - logit(mean)
        out.append((h, q, p, site, score, score >= 0))
    return out


def test_posteriors_by_hand(spark):
    rng = random.Random(21)
    rows = []
    for h, q, n, m in [("good", "a", 150, 0.95), ("good", "b", 60, 0.9), ("bad", "a", 150, 0.12), ("bad", None, 40, 0.2), (None, "a", 30, 0.5), ("mixed", "a", 50, 0.9), ("mixed", "b", 50, 0.1), ("tiny", "a", 1, 0.1), ("few", "b", 3, 0.3)]:
        rows += [(h, q, min(1.0, max(0.0, rng.gauss(m, 0.25)))) for _ in range(n)]
    rows += [rows[0], rows[0], ("tiny", "z", 1.0), ("tiny", "z", 0.0)]
    d = spark.createDataFrame([(*r, i % quality.SALTS, "x", 1) for i, r in enumerate(rows)], "host string, path string, p double, salt int, site_host string, __n int")
    names = {c: c for c in ("host", "path", "p", "salt", "site", "score", "keep")}
    out = quality.decide(d, names)
    assert {"site_host", "__n"} <= set(out.columns)
    key = lambda r: (str(r[0]), str(r[1]), round(r[2], 12))
    got = sorted((tuple(r) for r in out.select("host", "path", "p", "site", "score", "keep").collect()), key=key)
    want = sorted(by_hand(rows), key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2:5] == pytest.approx(b[2:5], rel=1e-9, abs=1e-9) and a[5] == b[5]
    # shrinkage decides: weak documents of good sites stay, fair ones of bad sites go
    assert any(r[2] < 0.5 and r[5] for r in want) and any(r[2] >= 0.5 and not r[5] for r in want)


def test_random_host_graph(spark):
    """Thousands of links with hubs, cycles and hosts without links, against the dense walk."""
    rng = np.random.default_rng(3)
    n = 300
    e = {(int(a), int(b)) for a, b in zip(rng.integers(0, n // 2, 3000), rng.integers(0, n, 3000)) if a != b}
    e |= {(0, i) for i in range(1, n)} | {(i, 1) for i in range(2, n // 2)} | {(n - 2, n - 1), (n - 1, n - 2)}
    e = [(a, b, int(rng.integers(1, 5))) for a, b in sorted(e)]
    seeds = {0: 3.0, 7: 1.0, n - 1: 2.0, n - 5: 4.0}
    nodes = spark.createDataFrame([(f"h{i}",) for i in range(n)], "host string")
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", w) for a, b, w in e], "src string, dst string, n long")
    got = {r.host: r["rank"] for r in hosts.walk(nodes, edges, spark.createDataFrame([(f"h{k}", v) for k, v in seeds.items()], "host string, mass double")).collect()}
    want = ppr(n, e, [seeds.get(i, 0) for i in range(n)], rounds=400)
    assert all(got[f"h{i}"] == pytest.approx(want[i], rel=1e-5, abs=1e-12) for i in range(n))


def test_sample_has_one_row_an_id(spark):
    """Rows that repeat a labelled id do not come to the driver; labels that repeat are averaged."""
    d = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    d = d.unionByName(spark.createDataFrame([(2, "two"), (3, None), (None, "x")], "doc_id long, text string"))
    lab = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 0, 1), (2, 0, None), (3, None, 1), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows, q, t = quality.sampled(d, lab)
    assert rows.n == 3 and sorted(map(str, zip(q, t))) == sorted(["(np.float64(1.0), np.float64(1.0))", "(np.float64(0.0), np.float64(nan))", "(np.float64(nan), np.float64(1.0))"])
    assert quality.sampled(d, lab, sample=1)[0].n == 1
    one = [sorted(b[1].tolist()) for b in (quality.sampled(x, lab.where("doc_id = 1"))[0].blocks[0] for x in (d, d.repartition(7)))]
    assert one[0] == one[1]


def test_names_of_the_table_stay(spark):
    more = {c: F.lit(c) for c in ("__h", "__p", "__n", "__s", "__i", "i", "t", "rank", "site_host", "fp", "cell", "first", "size")}
    p = pages(spark, [("http://com/en/", "<a href='//x.org/'>"), (None, None)]).withColumns(more)
    out, n = hosts.filter_urls(p, rules(spark, hosts.RULES))
    assert [c for c in out.columns if c in p.columns] == p.columns and {r["__h"] for r in out.collect()} == {"__h"}
    d = spark.createDataFrame([(1, "one two three four", "en", "s"), (1, "one two three four", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string").withColumns(more)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.kept(d, lab).columns == d.columns and quality.kept(d, lab).count() == 3
    b = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    assert leaks.clean(d, b).columns == d.columns and [r.doc_id for r in leaks.clean(d, b).collect()] == [2]
    assert simhash.one_of_each(d).columns == d.columns and simhash.one_of_each(d).count() == 2
    out, n = shard.shard(d)
    assert [c for c in out.columns if c in d.columns] == d.columns and out.count() == 3


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(999)) for _ in range(150_000))
    item = " ".join(long.split()[70_000:70_030])
    d = spark.createDataFrame([(1, long, "en", "s"), (2, "short text of a few words", "en", "s")], "doc_id long, text string, lang string, source string")
    got = leaks.leaks(d, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.similarity, r.first_word) for r in got] == [(1, 1.0, 70_000)]
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(d, lab).count() == 2
    turns = [(k, s, 0, "user", long) for k in (1, 2) for s in (0, 1)] + [(1, 1, 1, "assistant", long), (2, 0, 1, "assistant", "x")]
    rows = {r.pair: r for r in chat.preferences(spark.createDataFrame([(*t, "more") for t in turns], "pair long, side int, turn int, role string, text string, prompt string")).collect()}
    assert rows[1].rejected_mask == f"14:{len(long) + 21}" and len(rows[1].prompt) == len(long) + 17 and rows[2].chosen.startswith("<|assistant|>\nx")
