"""Quality classifier with hierarchical empirical Bayes.

Evidence of the document itself comes from two logistic models on its text, one for quality and one
for toxicity, trained here on at most ``SAMPLE`` labelled rows (those with the smallest hash of the
id: a bounded, repeatable sample; scoring covers every row). Features are the shape of the text
and which hashed words occur, rare ones too. p is the chance that the document is of quality and
not toxic.

Sites add what single documents cannot show. Documents are grouped by host (``source`` in this
corpus) and by path within the host (``lang`` here; a URL's host and leading path elsewhere). By
grouped aggregation alone: the global mean of p; a beta prior for hosts around it, whose strength
follows from the spread of host means beyond sampling noise (method of moments); a posterior mean for
each host; in the same way a prior for paths around their host and a posterior mean for each path.
Sparse sites shrink to their host and sparse hosts to the whole corpus. A document's final odds are
its own odds, times path odds over global odds, its own evidence left out of its site's sums. Kept
are documents with odds of at least 1.

The join of documents with their site is salted on both sides, so a site with a third of all rows
is spread over many tasks.

Ids are whole numbers (others raise a TypeError). Null and empty texts: the models' answer for an empty text. Null hosts and paths are sites of their
own. Labels may repeat (they are averaged) or name unknown documents; of rows that repeat a labelled id, the
one whose text has the smallest hash is learned from, all are judged. Without labels of both classes
a model is silent and keeps everything. Empty input: empty output.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultmill.llm.common import cut, integer_id, row_id, table, text_hash, unused

SAMPLE, BITS, SALTS = 20_000, 17, 32
RIDGE, TRUST, SETTLED = 10.0, 1.5, 1e-5
BLOCK = 1 << 20  # features of the sample worked on at once
STEM = 4  # letters of the word beginnings that are features too
WORDS = re.compile(r"\w+")
MARKS = "!?#$%&*|.,;:\n"
DENSE = len(MARKS) + 12
EDGES = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
WIDTH = (1 << BITS) + DENSE * (len(EDGES) + 1)


def features(text: str | None) -> np.ndarray:
    """Indices of the binary features of a text: hashed words and word beginnings, and the band of each shape measure."""
    s = text or ""
    n = max(1, len(s))
    tokens = s.split()
    low = s.lower()
    words = WORDS.findall(low)
    distinct = set(words)
    t, w = max(1, len(tokens)), max(1, len(words))
    lines = s.split("\n")
    letters = sum(map(len, words))
    shouted = sum(x.isupper() and len(x) > 1 for x in tokens)
    marked = sum(not x[-1].isalnum() and x[-1] not in ".,;:" for x in tokens)
    same = sum(a == b for a, b in zip(tokens, tokens[1:]))
    shape = [s.count(c) / t for c in MARKS]
    shape += [
        letters / n, shouted / t, marked / t, same / t, len(distinct) / w, len(set(lines)) / len(lines),
        sum(x.isdigit() for x in words) / w, letters / w / 20, sum(x == "|" for x in tokens) / t, min(1.0, t / 2000), min(1.0, t / 50), min(1.0, len(distinct) / 100),
    ]
    bands = np.searchsorted(EDGES, np.array(shape)) + np.arange(DENSE) * (len(EDGES) + 1)
    distinct |= {f"{x[:STEM]}-" for x in distinct if len(x) > STEM}
    hashed = np.fromiter((zlib.crc32(x.encode()) for x in distinct), np.int64, len(distinct)) & ((1 << BITS) - 1)
    return np.concatenate([np.unique(hashed), bands + (1 << BITS)]).astype(np.int32)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def featured(texts: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.int32()))


class Sample:
    """Binary features of a bounded number of rows, row after row, in blocks of about ``BLOCK``."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.n, self.blocks = len(sizes), []
        full = np.flatnonzero(sizes)
        ends = np.cumsum(sizes[full])
        a = 0
        while a < len(full):
            before = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
            size = sizes[full[a:b]]
            self.blocks.append((full[a:b], flat[before : ends[b - 1]], np.cumsum(size) - size, size))
            a = b

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each row, the sum of its features' weights."""
        out = np.zeros(self.n)
        for rows, flat, starts, _ in self.blocks:
            out[rows] = np.add.reduceat(weights[flat], starts)
        return out

    def back(self, values: np.ndarray) -> np.ndarray:
        """For each feature, the sum of its rows' values."""
        out = np.zeros(WIDTH)
        for rows, flat, _, size in self.blocks:
            out += np.bincount(flat, np.repeat(values[rows], size), WIDTH)
        return out

    def train(self, y: np.ndarray) -> np.ndarray:
        """Logistic regression over all rows with a label (y is nan elsewhere); the last weight is the bias.

        Every feature gets a weight, held back by a ridge as strong as the evidence on it is weak:
        its scale is |z| ** ``TRUST``, z being how many standard deviations its count among positive
        rows is from what their share gives. L-BFGS until no slope is over ``SETTLED`` of the steepest
        at the start; the loss is strictly convex and falls with every step, so this ends.
        """
        known = ~np.isnan(y)
        n, share = known.sum(), y[known].mean() if known.any() else 0
        if not 0 < share < 1:
            return np.zeros(WIDTH + 1, np.float32)
        y = np.where(known, y, 0)
        seen = self.back(known.astype(float))
        z = (self.back(y) - seen * share) / np.sqrt(seen * share * (1 - share) + 1)
        scale = np.abs(z) ** TRUST

        def slopes(w: np.ndarray) -> tuple[float, np.ndarray]:
            x = self.sums(w[:-1] * scale) + w[-1]
            r = np.where(known, (1 / (1 + np.exp(-np.clip(x, -500, 500))) - y) / n, 0)
            loss = np.where(known, np.logaddexp(0, x) - y * x, 0).sum() / n + RIDGE / (2 * n) * (w[:-1] ** 2).sum()
            return loss, np.append(self.back(r) * scale + RIDGE / n * w[:-1], r.sum())

        w = np.zeros(WIDTH + 1)
        w[-1] = np.log(share / (1 - share))
        loss, g = slopes(w)
        enough = SETTLED * np.abs(g).max()
        past: list[tuple[np.ndarray, np.ndarray, float]] = []  # steps, changes of slope, their products
        while np.abs(g).max() > enough:
            d, used = g.copy(), []
            for s, t, st in reversed(past):
                used.append((s * d).sum() / st)
                d -= used[-1] * t
            d *= past[-1][2] / (past[-1][1] ** 2).sum() if past else 1 / np.abs(g).sum()
            for (s, t, st), u in zip(past, reversed(used)):
                d += s * (u - (t * d).sum() / st)
            step, fall = 1.0, (g * d).sum()
            new, better, h = w, loss, g
            while step > 1e-12:
                new = w - step * d
                better, h = slopes(new)
                if better <= loss - 1e-4 * step * fall:
                    break
                step /= 2
            if not better < loss:  # as low as the arithmetic goes
                break
            s, t = new - w, h - g
            if (s * t).sum() > 0:
                past = [*past[-7:], (s, t, (s * t).sum())]
            w, loss, g = new, better, h
        return np.append(w[:-1] * scale, w[-1]).astype(np.float32)


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Sample, np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, on the driver."""
    lab = labels.where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    lab = lab.where("q is not null or t is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of three numbers
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text")).join(F.broadcast(lab), "doc_id")
    one = rows.groupBy("doc_id", "q", "t").agg(F.min(F.struct(text_hash(F.col("text")).alias("h"), "text")).alias("x"))  # of rows that repeat an id
    got = one.select(featured("x.text").alias("f"), "q", "t").toArrow()  # as many rows as labels at most
    parts = [c for c in got["f"].chunks if len(c)]
    flat = np.concatenate([c.flatten().to_numpy() for c in parts]) if parts else np.zeros(0, np.int32)
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in parts]) if parts else np.zeros(0, np.int64)
    q, t = (np.array([np.nan if x is None else x >= 0.5 for x in got[c].to_pylist()], float) for c in "qt")
    del got, parts
    pa.default_memory_pool().release_unused()  # the driver keeps one copy of the sample
    return Sample(flat, sizes), q, t


def evidence(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A column function: text -> chance that a document is of quality and not toxic."""
    rows, q, t = sampled(docs, labels, sample)
    models = [rows.train(y) for y in (q, t)]
    shared = docs.sparkSession.sparkContext.broadcast(models)  # two vectors of fixed width
    silent = [not m.any() for m in models]

    @F.arrow_udf(T.DoubleType())
    def chance(texts: pa.Array) -> pa.Array:
        good, bad = shared.value
        out = np.empty(len(texts))
        for i, x in enumerate(texts):
            f = features(x.as_py())
            p = 1.0 if silent[0] else 1 / (1 + np.exp(-np.clip(float(good[f].sum() + good[-1]), -30, 30)))
            if not silent[1]:
                p *= 1 - 1 / (1 + np.exp(-np.clip(float(bad[f].sum() + bad[-1]), -30, 30)))
            out[i] = p
        return pa.array(out)

    return chance


def sites(scored: DataFrame) -> DataFrame:
    """scored(host, path, p) -> (host, path, n, s, base, strength, global): what a document's posterior needs."""
    floor = 1e-4
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("ss").alias("hss"), F.count("*").alias("k"), F.sum((F.col("s") * F.col("s")) / F.col("n")).alias("sq"))
    hosts = cut(hosts)
    g = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum("hss").alias("ss"), F.sum("k").alias("paths"), F.count("*").alias("hosts"), F.sum(F.col("hs") ** 2 / F.col("hn")).alias("hsq"), F.sum("sq").alias("psq"), F.sum(F.col("hn").cast("double") ** 2).alias("n2")).first()
    n, mean = g["n"] or 0, (g["s"] / g["n"] if g["n"] else 0.5)
    mean = min(max(mean, floor), 1 - floor)

    def strength(between: float, groups: int, above: int, within: float, total: float) -> float:
        """Beta prior strength from the spread of group means beyond the noise within groups."""
        noise = within / max(1, total - groups)
        size = total / max(1, groups)
        spread = max(0.0, between / max(1, groups - above) - noise) / max(1.0, size)
        return float(min(1e6, max(1.0, mean * (1 - mean) / max(spread, 1e-9) - 1)))

    if n:
        k_host = strength(g["hsq"] - g["s"] ** 2 / n, g["hosts"], 1, g["ss"] - g["hsq"], n)
        k_path = strength(g["psq"] - g["hsq"], g["paths"], g["hosts"], g["ss"] - g["psq"], n)
    else:
        k_host = k_path = 1.0
    h = hosts.select(F.col("host").alias("of"), ((F.col("hs") + k_host * mean) / (F.col("hn") + k_host)).alias("base"))
    out = paths.join(h, F.col("host").eqNullSafe(F.col("of"))).drop("of", "ss")
    return out.withColumn("strength", F.lit(k_path)).withColumn("overall", F.lit(mean))


def logit(c: Column) -> Column:
    x = F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(x / (1 - x))


def decide(d: DataFrame, n: dict[str, str]) -> DataFrame:
    """Adds site, score and keep to rows with host, path, p and salt (columns named by n)."""
    s = sites(d.select(F.col(n["host"]).alias("host"), F.col(n["path"]).alias("path"), F.col(n["p"]).alias("p")))
    cols = ("host", "path", "n", "s", "base", "strength", "overall")
    m = {c: v for c, v in zip((*cols, "salt"), unused([f"site_{c}" for c in (*cols, "salt")], d).values())}
    s = s.select(*[F.col(c).alias(m[c]) for c in cols], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(m["salt"]))
    j = d.join(s, (d[n["salt"]] == s[m["salt"]]) & d[n["host"]].eqNullSafe(s[m["host"]]) & d[n["path"]].eqNullSafe(s[m["path"]]))
    p = F.col(n["p"])
    site = (F.col(m["strength"]) * F.col(m["base"]) + F.col(m["s"]) - p) / (F.col(m["strength"]) + F.col(m["n"]) - 1)
    j = j.withColumn(n["site"], site)
    j = j.withColumn(n["score"], logit(p) + logit(F.col(n["site"])) - logit(F.col(m["overall"])))
    return j.withColumn(n["keep"], F.col(n["score"]) >= 0).drop(n["salt"], *s.columns)


def judge(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text hash, host, path, p, site, score, keep) for every row of docs."""
    chance = evidence(docs, labels, sample)
    i = integer_id(docs, "doc_id")
    d = docs.select(
        i.alias("doc_id"), text_hash(docs["text"]).alias("text_hash"), docs[f"`{host}`"].cast("string").alias("host"), docs[f"`{path}`"].cast("string").alias("path"),
        chance(docs["text"].cast("string")).alias("p"), F.pmod(F.xxhash64(i, F.octet_length(docs["text"])), F.lit(SALTS)).cast("int").alias("salt"),
    )
    return decide(cut(d), {c: c for c in ("host", "path", "p", "salt", "site", "score", "keep")})


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps."""
    n = unused(("i", "h", "host", "path"), docs)
    good = judge(docs, labels).where("keep").select(row_id(F.col("doc_id")).alias(n["i"]), F.col("text_hash").alias(n["h"]), F.col("host").alias(n["host"]), F.col("path").alias(n["path"])).distinct()
    same = (row_id(integer_id(docs, "doc_id")) == good[n["i"]]) & (text_hash(docs["text"]) == good[n["h"]]) & docs["source"].cast("string").eqNullSafe(good[n["host"]]) & docs["lang"].cast("string").eqNullSafe(good[n["path"]])
    return docs.join(good, same, "left_semi")


def op9_quality_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with evidence, site posterior and score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return judge(docs, table(spark, sf_dir, "labels")).where("keep").select("doc_id", "p", "site", "score", "keep")
