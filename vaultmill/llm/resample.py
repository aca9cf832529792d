"""Target-distribution importance resampling over hashed n-grams, found by word-id suffix arrays.

A document's features are all runs of ``low`` to ``high`` consecutive words, repeats counted, each hashed
to one of ``buckets`` buckets. Rows are worked on in blocks of about ``BLOCK`` words of a partition: words
become ids, and the positions of all documents are sorted by the up to ``high`` words that begin there, a
suffix array cut at that depth. Where neighbours in the array share n words (the LCP), they are occurrences
of one n-gram, so each run of the array with LCP >= n is an n-gram: it is hashed once, and its bucket is
written back to all its positions. What stays of a document is its buckets, 2 or 4 bytes each, in the
shared folder; the texts are read once.

With S features of all documents, s of them in a bucket, and T and t of the target's texts, a bucket's
gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), a document's weight the floored mean
of its features' gains, and its score the weight plus floor(1000 times a Gumbel number drawn from the hash of
its id), so the highest scores are a sample without replacement in proportion to exp(weight / 1000). Of the N
documents with at least ``least`` words, floor(percent * N / 100) are drawn, ranked by score, then id.

Ranks need no task that holds all rows: scores are whole numbers, so a count by score gives the lowest score
drawn; what reaches it is sorted in ranges, and a row's rank is its place in its range after the ranges before.

Words: runs of digits, ASCII letters (A-Z lower-cased) and all characters beyond ASCII. Null, empty and
wordless texts: no features, weight 0, never drawn (``least`` is 1 at least). Null ids: hashed as an empty
string, last of equal scores. Repeated rows: each scored; of rows equal in score and id any goes first, the
same in each read of the result. An empty target: every gain compares with an even spread. Empty input: empty.
Other columns of the table are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultmill.llm.common import cut, integer_id, shuffle_width, table, unused

LOW, HIGH, BUCKETS, LEAST, PERCENT, SEED = 1, 1, 10_000, 20, 10, 2024
BLOCK = 1 << 20  # words sorted at once; a longer text is a block of its own
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def suffixes(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions, sorted by the up to ``depth`` words that begin there, and for each how many of these
    it shares with the one before. left: words from each position to its document's end, itself included;
    a suffix that ends sorts before those that go on."""
    columns = [ids]
    for k in range(1, depth):
        then = np.zeros(len(ids), ids.dtype)
        on = np.flatnonzero(left > k)
        then[on] = ids[on + k] + 1
        columns.append(then)
    order = np.lexsort(columns[::-1]) if depth > 1 else np.argsort(ids, kind="stable")
    lcp = np.zeros(len(ids), np.int64)
    shared = np.ones(max(0, len(ids) - 1), bool)
    for k, c in enumerate(columns):
        at = c[order]
        shared &= (at[1:] == at[:-1]) & ((at[1:] > 0) | (k == 0))
        lcp[1:] += shared
    return order, lcp


def hashed(texts: list[bytes], low: int, high: int, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """The number of words of each text, and the buckets of its features, packed."""
    kind = kind_of(buckets)
    split = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
    names, ends = list(number), np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(ids))
    order, lcp = suffixes(ids, left, high)
    per_text: list[list[bytes]] = [[] for _ in texts]
    for n in range(low, high + 1):
        whole = left[order] >= n
        head = (lcp < n) & whole
        grams = ids[order[head][:, None] + np.arange(n)].tolist()
        buckets_of = np.fromiter((zlib.crc32(b" ".join([names[i] for i in g])) % buckets for g in grams), np.int64, len(grams))
        at = np.zeros(len(ids), kind)
        at[order[whole]] = buckets_of[np.cumsum(head)[whole] - 1]
        for out, b, size in zip(per_text, ends.tolist(), sizes.tolist()):
            if size >= n:
                out.append(at[b - size : b - n + 1].tobytes())
    return sizes, [b"".join(x) for x in per_text]


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most this size together, of one row at least."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def features(text: Column, low: int, high: int, buckets: int) -> Column:
    """(words, buckets): how many words a text has, and the packed buckets of its features."""

    @F.arrow_udf(T.StructType([T.StructField("words", T.LongType()), T.StructField("buckets", T.BinaryType())]))
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        counts, packed = [np.zeros(0, np.int64)], []
        for a, b in blocks(lengths, 4 * BLOCK):  # about ``BLOCK`` words
            n, x = hashed([t or b"" for t in texts.slice(a, b - a).to_pylist()], low, high, buckets)
            counts.append(n)
            packed += x
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.array(packed, pa.binary())], ["words", "buckets"])

    return run(text.cast("string"))


def kind_of(buckets: int) -> np.dtype:
    return np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def histogram(packed: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket, of rows (packed). ``buckets`` rows come to the driver at most."""
    kind = kind_of(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_py() or b"", kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = packed.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds, in thousandths of the log of a ratio."""
    b, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + b) / ((x + 1) * (t + b)))) for x, y in zip(source.tolist(), target.tolist())], np.int64)


def weights(packed: Column, gain: Broadcast, buckets: int) -> Column:
    """The floored mean of the gains of packed buckets."""
    kind = kind_of(buckets)

    @F.arrow_udf(T.LongType())
    def run(rows: pa.Array) -> pa.Array:
        sums = (gain.value[np.frombuffer(x.as_py() or b"", kind)] for x in rows)
        return pa.array([int(g.sum()) // len(g) if len(g) else 0 for g in sums], pa.int64())

    return run(packed)


def lowest_drawn(scored: DataFrame, name: str, draws: int) -> int:
    """The score of the row in place ``draws`` from the top: counts by 64 scores, then by one. Scores lie
    within some 100,000 of each other (logs of counts), so the driver gets a few thousand numbers."""
    score, above, where = F.col(name), 0, F.lit(True)
    for wide in (64, 1):
        rows = scored.where(where).groupBy(F.floor(score / wide).alias("s")).agg(F.count("*").alias("n")).collect()
        for s, n in sorted(map(tuple, rows), reverse=True):
            if above + n >= draws:
                break
            above += n
        where = F.floor(score / wide) == s
    return s


def ranked(rows: DataFrame, keys: list[Column], rank: str, most: int) -> DataFrame:
    """Adds the place of each row in the order of the keys, null beyond ``most``. Rows are sorted in ranges."""
    n = unused(("part", "place", "before"), rows)
    width = shuffle_width(rows.sparkSession)
    sorted_ = rows.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    at = cut(sorted_.select("*", F.spark_partition_id().alias(n["part"]), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(n["place"])))
    sizes = dict(map(tuple, at.groupBy(n["part"]).count().collect()))  # a number for each partition
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    offsets = rows.sparkSession.createDataFrame(starts, f"{n['part']} int, {n['before']} long")
    place = F.col(n["before"]) + F.col(n["place"]) + 1
    return at.join(F.broadcast(offsets), n["part"]).withColumn(rank, F.when(place <= most, place)).drop(*n.values())


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", keep: list[str] | None = None,
    low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED,
) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` of all rows of docs (all columns by default), with n_features, weight, score and rank.

    Returns the table and the names that the added columns got (they evade names already there).
    """
    if not 1 <= low <= high or buckets < 1 or least < 1 or not 0 <= percent <= 100:
        raise ValueError("1 <= low <= high, buckets and least of 1 or more, percent from 0 to 100")
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    n = unused(("n_features", "weight", "score", "rank", "found", "words", "id", "row"), docs)
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], integer_id(docs, id_col).alias(n["id"]), features(docs[f"`{text_col}`"], low, high, buckets).alias(n["found"]))
    rows = cut(rows.select(*[c for c in rows.columns if c != n["found"]], F.col(f"{n['found']}.words").alias(n["words"]), F.col(f"{n['found']}.buckets").alias(n["found"])))
    wanted = target.select(features(target[f"`{target_col}`"], low, high, buckets).alias("f")).select("f.buckets")
    gain = spark.sparkContext.broadcast(gains(histogram(rows.select(n["found"]), buckets), histogram(wanted, buckets)))  # ``buckets`` numbers
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(n["id"]).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / float(1 << 32))))
    scored = rows.withColumn(n["weight"], weights(F.col(n["found"]), gain, buckets)).withColumn(n["score"], F.col(n["weight"]) + gumbel)
    scored = scored.withColumn(n["n_features"], (F.octet_length(n["found"]) / kind_of(buckets).itemsize).cast("long")).drop(n["found"])
    scored = cut(scored.withColumn(n["row"], F.monotonically_increasing_id()))
    able = F.col(n["words"]) >= least
    draws = percent * scored.where(able).count() // 100
    columns = [*keep, n["n_features"], n["weight"], n["score"]]
    if not draws:
        out = scored.withColumn(n["rank"], F.lit(None).cast("long"))
    else:
        reach = able & (F.col(n["score"]) >= lowest_drawn(scored.where(able), n["score"], draws))
        order = [F.col(n["score"]).desc(), F.col(n["id"]).asc_nulls_last(), F.col(n["row"])]
        drawn = ranked(scored.where(reach), order, n["rank"], draws)
        out = drawn.unionByName(scored.where(~reach).withColumn(n["rank"], F.lit(None).cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in columns], n["rank"]), {k: n[k] for k in ("n_features", "weight", "score", "rank")}


def drawn_rows(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that are drawn, best first in each of the ranges they were sorted in."""
    out, n = resample(docs, target, **options)
    return out.where(F.col(n["rank"]).isNotNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def op11_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text"), keep=["doc_id"])[0]


def crc32_sql(strings: str) -> str:
    """CTEs that end in x(t, h), the CRC-32 of the UTF-8 bytes of every string t of the table ``strings``."""
    return f"""
ct AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab),
x AS (SELECT t, xor(list_reduce(list_transform(range(strlen(t)), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT),
    lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM (SELECT t, hex(encode(t)) AS hx FROM {strings}), ct)"""


OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
f AS (SELECT r, unnest(w) AS t FROM d),
texts AS (SELECT t FROM f UNION SELECT t FROM b), {crc32_sql("texts")},
k AS (SELECT t, h % {BUCKETS} AS k FROM x),
sb AS (SELECT k, count(*) AS s FROM f JOIN k USING (t) GROUP BY k),
tb AS (SELECT k, count(*) AS t FROM b JOIN k USING (t) GROUP BY k),
g AS (SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM sb), 0) + {BUCKETS}))::DOUBLE
    / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM tb), 0) + {BUCKETS}))::DOUBLE))::BIGINT AS gain FROM sb FULL JOIN tb USING (k)),
m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN k USING (t) JOIN g USING (k) GROUP BY r),
z AS (SELECT doc_id, d.r, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN m ON m.r = d.r),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= {LEAST})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM z LEFT JOIN o ON o.r = z.r
"""
