"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

Words are counted over all documents. Two words are near if one inserted, deleted or replaced character
turns one into the other. A word's form is the most frequent word near it, if that is ``TIMES`` as frequent;
following forms to the end gives its root, so the words with one root are the variants of it.

**Dealing.** For the longer length m of a pair, every word of length m or m - 1 goes to two blocks: one for
its first half and one for its last half. An edit lies in one half only, so near words share a block, and
the pair counts in the block in whose open middle the first difference lies, so it counts once. Blocks of
more than ``CROWD`` words are cut again by the halves of their open middle, down to one open character,
where a block holds no more words than there are letters and is one list. Which to cut follows from counts of blocks by
hash, ``SLOTS`` of them at most, so all words of a block agree on it.

**Index.** Within a block the open middles, between two border marks, are cut into 2-grams, and each 2-gram
at each place has a list of the words that hold it there. A middle of r characters has r + 1 of them, and an
edit spoils two, so near words share r - 1 at least, at the same place or, behind a missing character, one
place off. Any three 2-grams of a word therefore include a shared one: its three shortest lists are merged
(lists of its own length and, at both places, of words one shorter), and what turns up is looked up in the
other lists. Pairs with r - 1 or more are verified on the whole words. A slice of words is merged at once, as
one sort of their lists, with ``ROOM`` entries at most. What leaves a block is one row a word: how many
words are near, and the best of them.

Words: maximal runs of letters (``LETTERS``), A-Z lower-cased only. If 31 divides the CRC-32 of
``<id>:<run>``, the character at its remainder by the length is deleted, which makes misspellings to find.
Null texts: no words. Null ids: written as nothing. Repeated rows count again. Words of any length are treated
alike. Ties of frequency: the smallest word by code points. Empty tables: empty. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultmill.llm.common import cut, integer_id, shuffle_width, table
from vaultmill.llm.resample import crc32_sql

LETTERS = r"A-Za-zÀ-ÿ"
LEAST, SEEN, TIMES, EVERY = 7, 2, 10, 31
CROWD, SLOTS = 2048, 65_536  # words of a block that is not cut; counts kept of blocks by hash
CHUNK, LETTERS_AT_ONCE, ROOM = 1 << 15, 1 << 22, 1 << 21  # words, characters and list entries worked on at once
POSTED = "block long, m int, a int, b int, word string, n long"
NEAR = "word string, n_near long, best_n long, best string"


def counted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, seen: int = SEEN, every: int = EVERY) -> DataFrame:
    """(word, n): the words and how often each occurs."""
    runs = F.regexp_extract_all(docs[f"`{text_col}`"].cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), 0)
    rows = docs.select(F.coalesce(integer_id(docs, id_col).cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("run"))
    # lower() changes letters beyond ASCII as well, so it is for words without capitals among those
    low = F.when(F.col("run").rlike(r"[À-Þ]"), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower("run"))
    rows = rows.select("i", low.alias("w")).select("w", F.crc32(F.concat("i", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("w")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.char_length("w")))).otherwise(F.col("w"))
    words = rows.select(word.alias("word")).where(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def halves(rows: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows (word, n, m, a, b) with a open to b closed characters: the middle's first or last half closed as well."""
    half = F.col("a") + F.floor((F.col("m") - F.col("a") - F.col("b") + 1) / 2).cast("int")
    two = F.array(F.struct(half.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("m") - half).alias("b")))
    same = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")))
    return rows.withColumn("x", F.explode(two if where is None else F.when(where, two).otherwise(same))).select("word", "n", "m", "x.a", "x.b")


def block(m: str = "m", a: str = "a", b: str = "b", word: str = "word") -> Column:
    """The block of a word with its first a and last b characters closed, as a hash."""
    return F.xxhash64(m, a, b, F.substring(word, F.lit(1), F.col(a)), F.substring(word, F.char_length(word) - F.col(b) + 1, F.col(b)))


def dealt(words: DataFrame) -> DataFrame:
    """words(word, n) -> a row for each block of each word (POSTED)."""
    spark, size = words.sparkSession, F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    rows = halves(rows)
    while True:
        slot = F.pmod(block(), F.lit(SLOTS))
        blocks = rows.where("m - a - b > 1").groupBy(block().alias("k")).agg(F.count("*").alias("c")).where(F.col("c") > CROWD)
        crowded = [r[0] for r in blocks.select(F.pmod("k", F.lit(SLOTS))).distinct().collect()]  # SLOTS numbers at most
        if not crowded:
            return rows.select(block().alias("block"), "m", "a", "b", "word", "n")
        hot = F.broadcast(spark.createDataFrame([(s,) for s in crowded], "slot long"))
        marked = rows.withColumn("slot", slot).join(hot.withColumn("hot", F.lit(True)), "slot", "left")
        rows = halves(marked, F.col("hot").isNotNull() & (F.col("m") - F.col("a") - F.col("b") > 1))


class Block:
    """Some blocks of words, one after the other, as flat arrays."""

    def __init__(self, group: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, words: list[str], n: np.ndarray):
        self.group, self.m, self.a, self.b, self.words, self.n = group, m, a, b, words, n
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        self.code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        # 2-grams of the open middles, a border mark (0) on each side
        count = self.size - a - b + 1
        self.first = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(words)), count)
        place = np.arange(len(owner)) - self.first[owner]
        at = self.start[owner] + a[owner] + place  # of the second character
        code = np.append(self.code, 0)
        second = np.where(place < count[owner] - 1, code[at], 0)
        one = np.where(place > 0, code[at - 1], 0)
        # with one open character an edit spoils all there is: these blocks are one list each
        gram = np.unique(np.where((m - a - b == 1)[owner], 0, one << 21 | second), return_inverse=True)[1]
        self.gram, self.count, self.owner, self.place = gram, count, owner, place
        self.short = (self.size < m).astype(np.int64)
        # a list is a block, whether its words are the shorter ones, a 2-gram and a place
        self.places, self.grams = int(place.max(initial=0)) + 2, int(gram.max(initial=0)) + 1
        key = self.key(self.group[owner] * 2 + self.short[owner], gram, place)
        order = np.argsort(key, kind="stable")
        self.posted, self.who = key[order], owner[order]

    def key(self, part: np.ndarray, gram: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (part * self.grams + gram) * self.places + place

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a word of full length and another that share one of the three shortest lists of the first."""
        probe = np.flatnonzero(~self.short[self.owner].astype(bool))
        own, gram, place = self.owner[probe], self.gram[probe], self.place[probe]
        lists = [(0, 0), (1, 0), (1, -1)]  # words as long at the place; shorter ones there or, behind the gap, one before
        lo, hi = [], []
        for short, shift in lists:
            key = self.key(self.group[own] * 2 + short, gram, place + shift)
            lo.append(np.searchsorted(self.posted, key))
            hi.append(np.where(place + shift >= 0, np.searchsorted(self.posted, key, side="right"), lo[-1]))
        hi[0] = np.minimum(hi[0], np.searchsorted(self.who_in_list(), self.pair_code(lo[0], own)))  # each pair from its later word
        total = sum(h - x for h, x in zip(hi, lo))
        order = np.lexsort((total, own))
        rank = np.arange(len(order)) - np.repeat(*self.runs(own[order])) if len(order) else order
        use = order[rank < 3]
        ends = np.cumsum(total[use])
        i = 0
        while i < len(use):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ROOM, side="right")))
            left, right = [], []
            for x, h in zip(lo, hi):
                x, c = x[use[i:j]], (h - x)[use[i:j]]
                upto = np.cumsum(c)
                right.append(self.who[np.repeat(x - (upto - c), c) + np.arange(upto[-1] if len(upto) else 0)])
                left.append(np.repeat(own[use[i:j]], c))
            code = np.sort(np.concatenate(left) * len(self.words) + np.concatenate(right))
            code = code[np.diff(code, prepend=-1) != 0]
            yield code // len(self.words), code % len(self.words)
            i = j

    @staticmethod
    def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of equal values start, and how long they are."""
        head = np.flatnonzero(np.diff(x, prepend=-1))
        return head, np.diff(np.append(head, len(x)))

    def who_in_list(self) -> np.ndarray:
        """Ascending numbers of (list, word), lists numbered by their first entry."""
        head, size = self.runs(self.posted)
        return np.repeat(head, size) * (len(self.words) + 1) + self.who

    def pair_code(self, head: np.ndarray, word: np.ndarray) -> np.ndarray:
        return head * (len(self.words) + 1) + word

    def flat(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For so many things of each pair: the pair's number, the thing's, and where pairs begin."""
        begin = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        return of, np.arange(len(of)) - begin[of], begin

    def enough(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether pairs share all but two 2-grams of the first word, at the same place or one before in a shorter word."""
        of, k, begin = self.flat(self.count[x])
        want, last = self.gram[self.first[x[of]] + k], self.count[y[of]] - 1
        there = (k <= last) & (self.gram[self.first[y[of]] + np.minimum(k, last)] == want)
        there |= (self.short[y[of]] > 0) & (k > 0) & (self.gram[self.first[y[of]] + np.maximum(k - 1, 0)] == want)
        return np.add.reduceat(there.astype(np.int64), begin) >= self.count[x] - 2

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether whole words are one edit apart, the first difference in the open middle. y is as long as x or one shorter."""
        of, k, begin = self.flat(self.size[x])
        a, last = self.code[self.start[x[of]] + k], self.size[y[of]] - 1
        ahead = (k <= last) & (self.code[self.start[y[of]] + np.minimum(k, last)] == a)
        behind = np.where(self.short[y[of]] > 0, (k > 0) & (self.code[self.start[y[of]] + np.maximum(k - 1, 0)] == a), ahead)
        size = self.size[x]
        first = np.minimum.reduceat(np.where(ahead, size[of], k), begin)  # place of the first difference
        tail = np.add.reduceat((behind & (k > first[of])).astype(np.int64), begin) == size - 1 - first
        return tail & (first < size) & (first >= self.a[x]) & (first < self.m[x] - self.b[x])

    def rows(self) -> pa.RecordBatch:
        """For each word with near ones: how many, and the best of them."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in self.candidates():
            for i in range(0, len(x), CHUNK):
                p, q = x[i : i + CHUNK], y[i : i + CHUNK]
                some = self.enough(p, q)
                p, q = p[some], q[some]
                if len(p):
                    some = self.near(p, q)
                    left.append(p[some])
                    right.append(q[some])
        x, y = np.concatenate(left), np.concatenate(right)
        pair = np.unique(x * len(self.words) + y)  # a pair may turn up in several slices
        x, y = pair // max(1, len(self.words)), pair % max(1, len(self.words))
        x, y = np.concatenate([x, y]), np.concatenate([y, x])
        named = np.unique(y)
        place = np.zeros(len(self.words), np.int64)
        place[sorted(named.tolist(), key=self.words.__getitem__)] = np.arange(len(named))
        order = np.lexsort((place[y], -self.n[y], x))
        head, count = self.runs(x[order]) if len(x) else (x, x)
        who, best = x[order][head], y[order][head]
        return pa.record_batch([pa.array([self.words[i] for i in who]), pa.array(count), pa.array(self.n[best]), pa.array([self.words[i] for i in best])], ["word", "n_near", "best_n", "best"])


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows POSTED in the order of block, m, a, b -> rows NEAR. Holds about ``CHUNK`` words at once."""

    def work(held: pa.Table) -> Iterator[pa.RecordBatch]:
        ints = [held[c].to_numpy().astype(np.int64) for c in ("block", "m", "a", "b", "n")]
        change = np.any([np.diff(c, prepend=c[0] - 1) != 0 if i == 0 else np.diff(c, prepend=c[0]) != 0 for i, c in enumerate(ints[:4])], axis=0)
        found = Block(np.cumsum(change) - 1, *ints[1:4], held["word"].to_pylist(), ints[4]).rows()
        if found.num_rows:
            yield found

    held, letters = [], 0
    for b in batches:
        for i in range(0, b.num_rows, CHUNK):
            part = b.slice(i, CHUNK)
            held.append(part)
            letters += part.column(4).nbytes
            if sum(x.num_rows for x in held) < CHUNK and letters < LETTERS_AT_ONCE:
                continue
            whole = pa.Table.from_batches(held)
            # up to the last block that is known to be over
            last = whole.num_rows - 1
            same = np.all([whole[c].to_numpy() == whole[c][last].as_py() for c in ("block", "m", "a", "b")], axis=0)
            over = int(np.argmin(same[::-1])) if not same.all() else len(same)
            if over < len(same):
                yield from work(whole.slice(0, len(same) - over).combine_chunks())
            rest = whole.slice(len(same) - over).combine_chunks()
            held = rest.to_batches()
            letters = rest["word"].nbytes
    if held and sum(x.num_rows for x in held):
        yield from work(pa.Table.from_batches(held).combine_chunks())


def neighbours(words: DataFrame) -> DataFrame:
    """words(word, n), distinct -> (word, n_near, best_n, best) for words with near ones."""
    posted = dealt(words)
    order = ["block", "m", "a", "b"]
    found = posted.repartition(shuffle_width(words.sparkSession), *order).sortWithinPartitions(*order).select("block", "m", "a", "b", "word", "n").mapInArrow(search, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best")))
    rows = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x"))
    return rows.select("word", "n_near", (-F.col("x.minus")).alias("best_n"), F.col("x.best").alias("best"))


def rooted(forms: DataFrame, most: int, times: int = TIMES) -> DataFrame:
    """forms(word, form) -> (word, root). A chain's words are ``times`` as frequent with every step, up to
    ``most``, so it has few steps; the steps known double in each round."""
    steps = max(1, math.ceil(math.log(max(2, most), times)) + 1)
    known = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps))):
        on = known.select(F.col("word").alias("at"), F.col("root").alias("then"))
        known = cut(known.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("then", "root").alias("root")))
    return known


def variants(docs: DataFrame, *, times: int = TIMES, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for all words of docs (options as in ``counted``)."""
    words = cut(counted(docs, **options))
    near = neighbours(words)
    chosen = F.col("best_n") >= times * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n"))
    rows = cut(rows)
    roots = rooted(rows.where("form is not null"), rows.agg(F.max("n")).first()[0] or 1, times)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
p AS (SELECT i || ':' || run AS t, run, count(*) AS c FROM r WHERE length(run) >= {LEAST} GROUP BY ALL),
{crc32_sql("p")},
v AS (SELECT c, CASE WHEN h % {EVERY} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM p JOIN x USING (t)),
w AS (SELECT word, sum(c)::BIGINT AS n FROM v WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(c) >= {SEEN}),
l AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (
  SELECT a.word AS x, b.word AS y FROM l a JOIN l b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, w.word FROM l JOIN w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM l JOIN w ON l.rest = w.word),
best AS (SELECT x, count(*) AS n_near, first(y ORDER BY w.n DESC, y) AS y, max(w.n) AS m FROM near JOIN w ON w.word = y GROUP BY x),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {TIMES} * n THEN y END AS form, CASE WHEN m >= {TIMES} * n THEN m END AS form_n FROM w LEFT JOIN best ON best.x = w.word),
c(word, hop) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.hop WHERE f.form IS NOT NULL),
e AS (SELECT c.word, c.hop AS root FROM c JOIN f ON f.word = c.hop WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN e ON e.word = f.word
"""
