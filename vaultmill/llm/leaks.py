"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case. A document is contaminated by a test item of L
words if their local alignment (match 1, mismatch and gap -1) has a score S with similarity
(S + L) / 2L >= ``LEAST``; where words are replaced that is the share of words left. Items of fewer
than ``SHORTEST`` words are no passages (any text holds "the" and "of") and match nothing.

Such an alignment has at most B = 2 (1 - LEAST) L losses to spend: 1 for an item word left out at an
end or a word put in, 2 for a word replaced or dropped. No loss costs more than two of the item's
L - 2 n-grams of three words per unit, nor more than one of its L - 1 n-grams of two words or of
its L single words. Each item uses the longest of these n-grams of which some must be left (under
0.8: three words for items of more than 10, two words for shorter ones, the word itself for an item
of one). With D the most that can be lost, all but D of them occur in the document, and of any
D + 1 at least one does: the D + 1 that the fewest documents hold are the item's seeds.

1. One pass over the documents finds which hold which n-grams of the benchmark. A filter of bits for
   its words and one for its n-grams go to the executors, each of 2 to the ``FILTER`` bits at most however
   large the benchmark is; what they let through is shuffled as (n-gram, document) and meets the benchmark's n-grams there, so a filter that
   is too full costs time only.
2. N-grams are counted by documents and the seeds are chosen. Documents and items that share a seed
   are candidates; those that share as many n-grams as must be left go on.
3. The texts of these documents alone are fetched (by a broadcast of their keys up to ``FEW``, by a
   shuffle beyond that), meet their items and are aligned, ``TOGETHER`` items of a document at a time.

This finds every contaminated document, however common the item is; nothing limits hits, items or
documents. N-grams and items that very many documents share are dealt to several tasks (``salted``).

Null, empty and blank texts on either side match nothing. Document ids are whole numbers (others
raise a TypeError), item ids too; null ids are kept. Repeated rows on either side are judged alike,
each on its own. Empty tables: no document is contaminated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vaultmill.llm.common import cut, integer_id, row_id, salted, table, text_hash, unused

GRAM, LEAST, SHORTEST = 3, 0.8, 3
FILTER = 28  # a filter has at most 2 to this power of bits: 32 MB
FEW = 200_000  # keys of documents that are broadcast, of 16 bytes
TOGETHER = 64
WORDS = re.compile(r"\w+")
CHUNK = 200_000  # words looked up at once
KNOWN = 1 << 18  # words whose hash is remembered
U = np.uint64
MIX = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Numbers(dict):
    """Word -> a small number that stands for its 64-bit hash; 0 for words that a filter does not hold.

    Words seen before are remembered; ``rest`` forgets them when they have become many, so numbers
    hold between two calls of it.
    """

    def __init__(self, words: np.ndarray | None = None):
        super().__init__()
        self.words, self.table = words, np.zeros(1024, U)
        self.n = 0

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word) | 1
        if self.words is not None:
            mask = len(self.words) * 64 - 1
            if not all(int(self.words[at >> 6]) >> (at & 63) & 1 for at in (h & mask, h >> 32 & mask)):
                self[word] = 0
                return 0
        self.n += 1
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros(self.n, U)])
        self.table[self.n] = h
        self[word] = self.n
        return self.n

    def of(self, text: str | None) -> list[int]:
        return list(map(self.__getitem__, WORDS.findall(text.lower()))) if text else []

    def hashes(self, ids: list[int]) -> np.ndarray:
        return self.table[np.array(ids, np.int64)]

    def rest(self) -> None:
        if len(self) > KNOWN:
            self.clear()
            self.n = 0


def codes(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all runs of n words without a zero, and a number for each."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    known, last = words > 0, len(words) - n + 1
    at = np.flatnonzero(np.logical_and.reduce([known[k : last + k] for k in range(n)]))
    x = np.full(len(at), U(n))
    with np.errstate(over="ignore"):
        for k in range(n):
            x = (x ^ (x >> U(29))) * MIX[k] + words[at + k]
        x ^= x >> U(32)
    return at, x


def plan(words: int) -> tuple[int, int]:
    """For an item of so many words: the length of its n-grams, and how many of them may be lost."""
    spend = 2 * (1 - LEAST) * words + 1e-9
    size, lost = 1, int(spend)
    for g in range(2, GRAM + 1):
        most = int((g - 1) * spend)
        if words - g + 1 > most:
            size, lost = g, most
    return size, lost


def prepared(bench: DataFrame, shortest: int) -> DataFrame:
    """(k, item_id, text, size, need, seeds, grams, words): k is a number of its own for every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Numbers()
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                known.rest()
                words = known.hashes(known.of(t))
                if len(words) >= max(1, shortest):
                    size, lost = plan(len(words))
                    rows.append((i, t, size, len(words) - size + 1 - lost, lost + 1, codes(words, size)[1].view(np.int64), np.unique(words).view(np.int64)))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            cols = zip(*rows) if rows else [()] * 7
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["item_id", "text", "size", "need", "seeds", "grams", "words"])

    rows = bench.select(integer_id(bench, "item_id").alias("item_id"), bench["text"].cast("string").alias("text"))
    found = rows.mapInArrow(read, "item_id long, text string, size int, need int, seeds int, grams array<long>, words array<long>")
    return cut(found.withColumn("k", F.monotonically_increasing_id()))


def filter_bits(codes: DataFrame) -> np.ndarray:
    """codes(c) -> two bits for every code, as 64-bit words."""
    bits = min(FILTER, max(10, int(np.ceil(np.log2(64 * max(1, codes.count()))))))
    at = codes.select(F.explode(F.array(F.col("c"), F.shiftrightunsigned("c", 32))).alias("at")).select(F.expr(f"at & {(1 << bits) - 1}L").alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63L as int)))").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), U)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(U)
    return out


def held(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which codes the filter holds; of others it lets a few through."""
    mask, ok = U(len(bits) * 64 - 1), np.ones(len(code), bool)
    for shift in (0, 32):
        at = (code >> U(shift)) & mask
        ok &= (bits[at >> U(6)] >> (at & U(63))) & U(1) > 0
    return ok


def hits(docs: DataFrame, words: np.ndarray, grams: np.ndarray, sizes: list[int]) -> DataFrame:
    """docs(i, t, text) -> (i, t, gram), each n-gram once for a row."""
    shared = docs.sparkSession.sparkContext.broadcast((words, grams))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Numbers(shared.value[0])
        for b in batches:
            starts, ids, first = [0], [], 0
            for row, x in enumerate(b.column(2), 1):
                ids += known.of(x.as_py())
                ids.append(0)
                starts.append(len(ids))
                if len(ids) < CHUNK and row < b.num_rows:
                    continue
                words = known.hashes(ids)
                known.rest()
                for n in sizes:
                    at, gram = codes(words, n)
                    ok = held(shared.value[1], gram)
                    doc, gram = np.searchsorted(starts, at[ok], side="right") - 1 + first, gram[ok]
                    order = np.lexsort((gram, doc))
                    doc, gram = doc[order], gram[order]
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
                    rows = pa.array(doc[new])
                    yield pa.record_batch([b.column(0).take(rows), b.column(1).take(rows), pa.array(gram[new].view(np.int64))], ["i", "t", "gram"])
                starts, ids, first = [0], [], row

    return docs.mapInArrow(look, "i long, t long, gram long")


def candidates(found: DataFrame, items: DataFrame) -> DataFrame:
    """(i, t, k): documents and items that share a seed and as many n-grams as must be left."""
    grams = items.select("k", "need", "seeds", F.posexplode("grams").alias("offset", "gram"))
    often = found.groupBy("gram").agg(F.count("*").alias("docs"))
    rank = F.row_number().over(W.partitionBy("k").orderBy(F.coalesce("docs", F.lit(0)), "offset"))
    ranked = cut(grams.join(often, "gram", "left").withColumn("rank", rank).where("docs is not null"))
    seeds = ranked.where("rank <= seeds").select("k", "gram").distinct()
    pairs = salted(found, seeds, ["gram"], ["i", "t"]).select("i", "t", "k").distinct()
    # of these pairs alone the other n-grams are looked up: as many rows as the items have n-grams
    wanted = salted(pairs, ranked.groupBy("k", "need", "gram").agg(F.count("*").alias("times")), ["k"], ["i", "t"])
    shared = wanted.join(found.distinct(), ["i", "t", "gram"])
    return cut(shared.groupBy("i", "t", "k").agg(F.sum("times").alias("times"), F.max("need").alias("need")).where("times >= need").select("i", "t", "k"))


def matches(text: np.ndarray, item: np.ndarray) -> tuple[float, int, int] | None:
    """(similarity, first word, end) of the best stretch of a text that is contaminated by the item."""
    size, lost = plan(len(item))
    need, mine = len(item) - size + 1 - lost, codes(item, size)[1]
    order = np.argsort(mine, kind="stable")
    lookup = mine[order]
    at, c = codes(text, size)
    lo, hi = np.searchsorted(lookup, c, "left"), np.searchsorted(lookup, c, "right")
    met = np.flatnonzero(hi > lo)
    n = (hi - lo)[met]
    off = order[np.repeat(lo[met], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    diagonal = np.repeat(at[met], n) - off
    slack = max(4, len(item) // 2)
    order = np.argsort(diagonal, kind="stable")
    diagonal, off = diagonal[order], off[order]
    cuts = np.flatnonzero(np.diff(diagonal) > len(item) + 2 * slack) + 1
    best: tuple[float, int, int] | None = None
    for g, o in zip(np.split(diagonal, cuts), np.split(off, cuts)):
        if not len(g) or len(np.unique(o)) < need:
            continue
        a, b = max(0, int(g[0]) - slack), min(len(text), int(g[-1]) + len(item) + slack)
        s, e, score = align(item, text[a:b])
        sim = (score + len(item)) / (2 * len(item))
        if sim >= LEAST and (best is None or sim > best[0]):
            best = (sim, a + s, a + e)
    return best


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """Local alignment: (first word, end, score) in the stretch; ties go to the earliest end."""
    n = len(stretch)
    step = np.arange(n + 1)
    h = np.zeros(n + 1, np.int64)
    origin = step.copy()
    best = (0, 0, 0)
    for w in item:
        diagonal = h[:-1] + np.where(stretch == w, 1, -1)
        t = np.zeros(n + 1, np.int64)
        start = step.copy()
        up = h[1:] - 1
        take = diagonal >= up
        c = np.where(take, diagonal, up)
        o = np.where(take, origin[:-1], origin[1:])
        live = c > 0
        t[1:][live] = c[live]
        start[1:][live] = o[live]
        lifted = t + step  # gaps in the item: the best to the left, one less per step
        top = np.maximum.accumulate(lifted)
        new = np.concatenate([[True], lifted[1:] > top[:-1]])
        source = np.maximum.accumulate(np.where(new, step, 0))
        h = top - step
        origin = np.where(h > 0, start[source], step)
        h = np.maximum(h, 0)
        j = int(h.argmax())
        if h[j] > best[2]:
            best = (int(origin[j]), j, int(h[j]))
    return best


def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, items of (item_id, text)) -> the contaminated stretches."""
    known = Numbers()
    for b in batches:
        rows = []
        for i, text, items in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            known.rest()
            words = known.hashes(known.of(text.as_py()))
            for x in items.as_py():
                best = matches(words, known.hashes(known.of(x["text"])))
                if best is not None:
                    rows.append((i, x["item_id"], *best))
        cols = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "similarity", "first_word", "end_word"])


SCHEMA = "doc_id long, item_id long, similarity double, first_word long, end_word long"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, i, t, text): i and t name a document, rows of equal id and text alike."""
    i, text = integer_id(docs, "doc_id"), docs["text"].cast("string")
    return docs.select(i.alias("doc_id"), row_id(i).alias("i"), text_hash(text).alias("t"), text.alias("text"))


def leaks(docs: DataFrame, bench: DataFrame, *, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, end_word) for each contaminated document and item."""
    items = prepared(bench, shortest)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # GRAM numbers at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    rows = keyed(docs)
    words, grams = (filter_bits(items.select(F.explode(c).alias("c")).distinct()) for c in ("words", "grams"))
    found = cut(hits(rows.select("i", "t", "text"), words, grams, sizes))
    pairs = candidates(found, items)
    keys = cut(pairs.groupBy("i", "t").agg(F.count("*").alias("n")))
    if keys.count() <= FEW:
        rows = rows.join(F.broadcast(keys.select("i", "t")), ["i", "t"], "left_semi")
    part = F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / TOGETHER)).alias("part")
    named = salted(pairs, items.select("k", "item_id", "text"), ["k"], ["i", "t"])
    sets = named.join(keys, ["i", "t"]).groupBy("i", "t", part).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    return rows.join(sets, ["i", "t"]).select("doc_id", "text", "items").mapInArrow(aligned, SCHEMA)


def clean(docs: DataFrame, bench: DataFrame, *, shortest: int = SHORTEST) -> DataFrame:
    """The rows of docs without contamination."""
    n = unused(("i", "t"), docs)
    # a document is named by id and text; its hash takes the id's place, so that both come back as one number
    named = keyed(docs).select(F.xxhash64("i", "t").alias("doc_id"), "text")
    bad = cut(leaks(named, bench, shortest=shortest).select(F.col("doc_id").alias(n["i"])).distinct())
    if bad.count() <= FEW:
        bad = F.broadcast(bad)
    mark = F.xxhash64(row_id(integer_id(docs, "doc_id")), text_hash(docs["text"]))
    return docs.join(bad, mark == bad[n["i"]], "left_anti")


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
