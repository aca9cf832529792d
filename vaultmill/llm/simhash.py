"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most r bits exactly if some value lies within r // 2 bits of one and
r - r // 2 of the other. Every distinct fingerprint therefore emits all values in a ball of half
the radius (r = 4: 2,081 values), values are shuffled, and fingerprints that meet in one value are
pairs. By the triangle inequality all that meet in one value are within r of each other, so each
meeting point needs links to its smallest member only, never all pairs; links are verified by
their bit count all the same.

The shuffle on values is folded: values are dealt by their leading p bits, and the members of a
fingerprint's ball fall into few such slices (one, plus p, plus p * (p - 1) / 2). A fingerprint is
sent once to each of these slices and its values there are generated on arrival, which moves
dozens of words for each fingerprint rather than 2,081 and yields the same meetings. p grows with
the number of distinct fingerprints so that a slice holds about ``SLICE`` of them; a slice that is
fuller is split again by its next bits, in turn, so memory stays bounded. Equal fingerprints
are one item. Components come from the links of all slices.

A radius of 4 in 64 bits finds few of the texts that share 80% of their shingles: these are 10 bits
apart on average. ``one_of_each`` therefore gives each text ``TABLES`` fingerprints, from hashes that are
mixed anew for each, and hashes the balls of their last ``SHORT`` bits, where such texts are within the
radius of 4 in every fourth table or more; all tables go through at once, as parts of one value space. These
fingerprints are of the *set* of a text's shingles, so a line that a text repeats counts once. What meets
there are candidates, also by chance, so members of a meeting point are paired with its smallest and
with their neighbour in order, which a stranger among them does not break. Pairs with more than ``LOOSE``
differences in the other bits of the table are strangers: texts of similarity 0.8 differ in 4 of these 24
on average, give or take 2, others in 12. Of the rest each slice keeps the shortest spanning forest, so a group of near copies of any size yields as many pairs as it has members. No pair is
a near copy by its fingerprints, equal ones included: the texts of every pair are read again, and the Jaccard
similarity of their sets of shingles must reach ``ALIKE``. Only texts equal byte for byte are one without that.

Ids are whole numbers (others raise a TypeError). Null, empty and blank texts: fingerprint zero, linked like any other. Null ids: never the smallest
of a component, unless it has no other. Repeated rows: rows of one fingerprint. Empty input: empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultmill.llm.common import HUBS, LAST_ID, LEAF, components, cut, integer_id, row_id, salted, smallest, star, table, text_hash, unused

RADIUS, SHINGLE, SEED = 4, 4, 42
TABLES, SHORT, WORDS, ALIKE, SHORT_SLICE = 9, 40, 5, 0.8, 4096  # of one_of_each
LOOSE = 7  # of the 24 bits beyond SHORT
FEW, FAN = 200_000, 256  # keys of texts that are broadcast, of 32 bytes; pairs of a text for one task
TABLE_BITS = 40  # bits of a slice's number below the table's
SLICE = 512  # distinct fingerprints for a slice, on average
ROOM = 1 << 21  # values generated at once
BLOCK = 1 << 16


def shingle_hashes(data: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``width`` words (A-Z lower-cased, joined by one space), repeats included."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), BLOCK):
        part = h[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprint(data: bytes) -> int:
    return majority(shingle_hashes(data))


def fingerprints(data: bytes, tables: int, width: int) -> list[int]:
    """Of the set of shingles: a fingerprint from the hashes as they are, then from the hashes mixed with 1, 2, .."""
    h = np.unique(shingle_hashes(data, width))
    out = [majority(h)]
    with np.errstate(over="ignore"):
        for k in range(1, tables):
            x = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out.append(majority(x ^ (x >> np.uint64(31))))
    return out


@F.arrow_udf(T.LongType())
def simhash(texts: pa.Array) -> pa.Array:
    """The fingerprint as a signed 64-bit number."""
    out = np.fromiter((fingerprint(b"" if t is None else t) for t in _bytes(texts)), np.uint64, len(texts))
    return pa.array(out.view(np.int64))


def simhashes(tables: int, width: int):
    """A column function: the fingerprints of a text as signed 64-bit numbers."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(texts: pa.Array) -> pa.Array:
        flat = np.array([f for t in _bytes(texts) for f in fingerprints(b"" if t is None else t, tables, width)], np.uint64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * tables), pa.array(flat.view(np.int64)))

    return run


def _bytes(texts: pa.Array) -> Iterator[bytes | None]:
    for t in texts.cast(pa.large_binary()):
        yield t.as_py()


def flips(bits: list[int], most: int) -> list[np.ndarray]:
    """XOR masks with exactly 0, 1, .. ``most`` of the given bits set."""
    one = np.array([1 << b for b in bits], np.uint64)
    out = [np.zeros(1, np.uint64)]
    for _ in range(most):
        i, j = len(out), out[-1]
        grown = np.unique((j[:, None] | one[None, :]).ravel()) if len(one) else np.zeros(0, np.uint64)
        out.append(grown[np.bitwise_count(grown) == i])
    return out


def meetings(base: np.ndarray, left: np.ndarray, who: np.ndarray, bits: list[int], chain: bool = False) -> list[np.ndarray]:
    """Links (member, smallest member) between all that meet in a value, with chain also to the next.

    base: value so far, with the slice's bits set; left: flips still allowed among ``bits``.
    """
    n, half = len(bits), int(left.max(initial=0))
    ball = [sum(math.comb(n, k) for k in range(b + 1)) for b in range(half + 1)]
    if len(base) < 2:
        return []
    if bits and len(base) > 64 and sum(ball[b] * int((left == b).sum()) for b in range(half + 1)) > ROOM:
        bit, rest = np.uint64(1 << bits[0]), bits[1:]
        out = []
        for side in (np.uint64(0), bit):
            same = (base & bit) == side
            keep = same | (left > 0)
            out += meetings(np.where(same, base, base ^ bit)[keep], np.where(same, left, left - 1)[keep], who[keep], rest, chain)
        return out
    masks = flips(bits, half)
    values, owner = [], []
    for b in range(half + 1):
        of = np.flatnonzero(left == b)
        m = np.concatenate(masks[: b + 1])
        values.append((base[of][:, None] ^ m[None, :]).ravel())
        owner.append(np.repeat(of.astype(np.int32), len(m)))
    v, o = np.concatenate(values), np.concatenate(owner)
    s = np.sort(v)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return []
    del s
    at = np.searchsorted(twice, v)
    at[at == len(twice)] = 0
    met = twice[at] == v
    at, w = at[met], who[o[met]]
    order = np.lexsort((w, at))
    at, w = at[order], w[order]
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    root = np.repeat(w[head], np.diff(np.append(head, len(w))))
    pairs = np.stack([w, root], 1)
    if chain:
        next_ = np.stack([w[1:], w[:-1]], 1)[at[1:] == at[:-1]]
        pairs = np.concatenate([pairs, next_])
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return [pairs] if len(pairs) else []


def forest(pairs: np.ndarray) -> np.ndarray:
    """(node, root) for every node that is not its component's smallest."""
    nodes, flat = np.unique(pairs, return_inverse=True)
    flat = flat.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[flat[:, 0]], label[flat[:, 1]])
        new = label.copy()
        np.minimum.at(new, flat[:, 0], low)
        np.minimum.at(new, flat[:, 1], low)
        np.minimum.at(new, label[flat[:, 0]], low)
        np.minimum.at(new, label[flat[:, 1]], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return np.stack([nodes[off], nodes[label[off]]], 1)


def shortest(pairs: np.ndarray) -> np.ndarray:
    """The pairs that connect what all pairs connect, those with the fewest bits first."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    keep = []
    order = np.lexsort((pairs[:, 1], pairs[:, 0], np.bitwise_count(pairs[:, 0] ^ pairs[:, 1])))
    for k, (a, b) in zip(order.tolist(), pairs[order].tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(k)
    return pairs[np.sort(np.array(keep, np.int64))]


def links(prints: DataFrame, n: int, radius: int = RADIUS, bits: int = 64, slice_: int | None = None) -> DataFrame:
    """prints(fp, tab): distinct fingerprints, about n of them in each table -> links (tab, a, b).

    With all 64 bits, links connect every component of a table. With fewer, the balls are those of the
    last ``bits``; links are candidates whose other bits do not speak against them, a forest of each slice.
    """
    half, whole, mask = radius // 2, bits == 64, np.uint64((1 << bits) - 1)
    if radius % 2:
        raise ValueError("the radius must be even")
    p = min(TABLE_BITS, max(0, math.ceil(math.log2(max(1, n) / (slice_ or SLICE)))))
    top = [bits - 1 - i for i in range(p)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.concatenate(flips(top, half))
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            tab = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(TABLE_BITS)
            for i in range(0, len(fp), max(1, ROOM // len(masks))):
                part = fp[i : i + max(1, ROOM // len(masks))]
                key = ((part & mask)[:, None] ^ masks[None, :]) >> np.uint64(bits - p) if p else np.zeros((len(part), 1), np.uint64)
                key = (key | tab[i : i + len(part), None]).ravel()
                order = np.argsort(key, kind="stable")
                key, who = key[order], np.repeat(part, len(masks))[order]
                cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                packed = [x.tobytes() for x in np.split(who, cuts[1:])] if len(cuts) else []
                yield pa.record_batch([pa.array(key[cuts].astype(np.int64)), pa.array(packed, pa.binary())], ["slice", "prints"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (1 << (bits - p)) - 1
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(k, []).append(x)
        for k in list(held):
            who = np.unique(np.frombuffer(b"".join(held.pop(k)), np.uint64))
            top_bits = k & ((1 << TABLE_BITS) - 1)
            base = (who & np.uint64(low)) | np.uint64(top_bits << (bits - p) if p else 0)
            left = half - np.bitwise_count(base ^ (who & mask)).astype(np.int64)
            found = meetings(base, left, who, list(range(bits - 1 - p, -1, -1)), not whole)
            if found:
                pairs = np.concatenate(found)
                apart = pairs[:, 0] ^ pairs[:, 1]
                pairs = pairs[(np.bitwise_count(apart & mask) <= radius) & (whole or np.bitwise_count(apart >> np.uint64(bits % 64)) <= LOOSE)]
                out = (forest(pairs) if whole else shortest(np.unique(pairs, axis=0))).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(out), k >> TABLE_BITS, np.int32)), pa.array(out[:, 0]), pa.array(out[:, 1])], ["tab", "a", "b"])

    spark = prints.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = prints.select("fp", "tab").mapInArrow(emit, "slice long, prints binary")
    return slices.repartition(width, "slice").mapInArrow(meet, "tab int, a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """prints(fp, rep): one row per fingerprint with its smallest key -> (fp, best), the component's smallest key."""
    prints = cut(prints)
    comp = components(links(prints.select("fp", F.lit(0).alias("tab")), prints.count()))
    member = smallest(comp.join(prints, comp.node == prints.fp)).withColumnRenamed("node", "fp")
    return prints.join(member, "fp", "left").select("fp", F.coalesce("best", "rep").alias("best"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    rows = cut(docs.select(integer_id(docs, id_col).alias("doc_id"), simhash(docs[f"`{text_col}`"].cast("string")).alias("fp")))
    # written out, so that the join below deals both sides anew and a hot fingerprint's rows can be split
    best = cut(classes(rows.groupBy("fp").agg(F.min(row_id(F.col("doc_id"))).alias("rep"))))
    return rows.join(best, "fp").select("doc_id", "fp", F.when(F.col("best") < LAST_ID, F.col("best")).alias("component_id"))


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", WORDS))


@F.arrow_udf(T.BooleanType())
def similar(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether the sets of shingles of two texts have a Jaccard similarity of ``ALIKE``; texts without words are alike."""
    out = []
    for a, b in zip(_bytes(left), _bytes(right)):
        a, b = shingle_set(a), shingle_set(b)
        shared = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= ALIKE * max(len(a), len(b)) else 0
        out.append(shared >= ALIKE * (len(a) + len(b) - shared))
    return pa.array(out, pa.bool_())


def text_key(c: Column) -> Column:
    """A text's 128 bits, of two hashes."""
    return F.struct(text_hash(c).alias("one"), F.xxhash64(F.lit(WORDS), c.isNull(), F.coalesce(c, F.lit(""))).alias("two"))


def candidates(nodes: DataFrame) -> DataFrame:
    """nodes(node, prints) -> pairs x < y of nodes that may be near copies: as many as nodes in each table at most."""
    named = cut(nodes.select(F.col("node").alias("v"), F.posexplode("prints").alias("tab", "fp")))
    same = star(named.select(F.struct("tab", "fp").alias("u"), "v"), max(LEAF, named.count() // HUBS)).where("m < v")
    first = named.groupBy("tab", "fp").agg(F.min("v").alias("v"))  # a node for each fingerprint
    met = cut(links(first.select("fp", "tab"), nodes.count(), bits=SHORT, slice_=SHORT_SLICE).distinct())
    end = lambda fp, name: first.select("tab", F.col("fp").alias(fp), F.col("v").alias(name))
    met = salted(salted(met, end("b", "m"), ["tab", "b"], ["a"]), end("a", "v"), ["tab", "a"], ["b"])
    pairs = met.select("m", "v").unionByName(same.select("m", "v"))
    return cut(pairs.select(F.least("m", "v").alias("x"), F.greatest("m", "v").alias("y")).distinct())


def alike(docs: DataFrame, key: tuple[Column, Column], nodes: DataFrame) -> DataFrame:
    """nodes(node, i, t, prints), a row for each text -> pairs (x, y) of nodes whose texts are near copies."""
    pairs = candidates(nodes.select("node", "prints"))
    asked = cut(nodes.select("node", "i", "t").join(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "node", "left_semi"))
    texts = docs.select(key[0].alias("i"), key[1].alias("t"), docs["text"].cast("string").alias("text"))
    # a text is named by its smallest id; rows that repeat id and text are one
    texts = texts.join(F.broadcast(asked) if asked.count() <= FEW else asked, ["i", "t"]).dropDuplicates(["node"]).select("node", "text")
    ends = pairs.select("x", "y", F.explode(F.array("x", "y")).alias("node"))
    both = salted(ends, texts, ["node"], ["x", "y"], FAN).groupBy("x", "y").agg(F.min(F.struct("node", "text")).alias("a"), F.max(F.struct("node", "text")).alias("b"))
    return cut(both.where(similar("a.text", "b.text")).select("x", "y"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each group of near copies the one with the smallest id (null ids last).
    Rows that repeat both id and text are one document."""
    key = lambda d: (row_id(integer_id(d, "doc_id")), text_key(d["text"].cast("string")))
    n = unused(("i", "t"), docs)
    i, t = key(docs)
    rows = cut(docs.select(i.alias("i"), t.alias("t"), simhashes(TABLES, WORDS)(docs["text"].cast("string")).alias("prints")))
    nodes = cut(rows.groupBy("t").agg(F.min("i").alias("i"), F.first("prints").alias("prints")).withColumn("node", F.monotonically_increasing_id()))
    edges = alike(docs, (i, t), nodes).select(F.col("x").alias("a"), F.col("y").alias("b"))
    reps = nodes.select("node", F.struct("i", "t").alias("rep"))
    member = smallest(components(edges).join(reps, "node"))
    best = reps.join(member, "node", "left").select(F.coalesce("best", "rep").alias("best"))
    best = best.select(F.col("best.i").alias(n["i"]), F.col("best.t").alias(n["t"])).distinct()
    kept = docs.join(best, (i == best[n["i"]]) & (t == best[n["t"]]), "left_semi")
    i, t = key(kept)
    return kept.withColumns({n["i"]: i, n["t"]: t}).dropDuplicates([n["i"], n["t"]]).drop(n["i"], n["t"])


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def xxh64_sql(texts: str, seed: int = SEED) -> str:
    """CTEs that end in x(t, h), the XXH64 of every string t of the table ``texts``. SQL has no
    wrapping 64-bit product, so numbers are 128 bits wide and cut after each step."""
    full = 1 << 64
    primes = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)  # fixed values
    num = lambda x: f"{x % full}::UHUGEINT"
    mul = lambda a, k: f"(({a}) * {num(primes[k - 1])} % {full}::UHUGEINT)"
    rot = lambda a, r: f"(({a}) * {num(1 << r)} % {full}::UHUGEINT + ({a}) // {num(1 << (64 - r))})"
    lane = lambda x: mul(rot(mul(x, 2), 31), 1)
    plus = lambda a, b: f"(({a} + {b}) % {full}::UHUGEINT)"
    hexed = lambda pos, n: f"('0x' || substr(x, {pos}, {n}))::UBIGINT::UHUGEINT"
    starts = ", ".join(num(seed + s) for s in (primes[0] + primes[1], primes[1], 0, -primes[0]))
    tops = plus(plus(plus(rot("v[1]", 1), rot("v[2]", 7)), rot("v[3]", 12)), rot("v[4]", 18))
    return f"""
b AS (SELECT t, strlen(t)::BIGINT AS n, hex(encode(t)) AS h FROM {texts}),
r AS (SELECT t, n, array_to_string(list_reverse(list_transform(range(n), lambda i: substr(h, 2 * i + 1, 2))), '') AS x FROM b),
l AS (SELECT t, n, list_transform(range(n // 8), lambda i: {hexed("2 * (n - 8 * i - 8) + 1", 16)}) AS q,
  CASE WHEN n % 8 >= 4 THEN [{hexed("2 * (n - n // 8 * 8 - 4) + 1", 8)}] ELSE []::UHUGEINT[] END AS f,
  list_transform(range(n % 4), lambda i: {hexed("2 * (n % 4 - 1 - i) + 1", 2)}) AS o FROM r),
v AS (SELECT t, n, q, f, o, CASE WHEN n < 32 THEN []::UHUGEINT[] ELSE list_transform([{starts}], lambda s, j:
  list_reduce(list_transform(range(n // 32), lambda k: q[4 * k + j]), lambda a, y: {mul(rot(plus("a", mul("y", 2)), 31), 1)}, s)) END AS v FROM l),
h0 AS (SELECT t, q, f, o, n, CASE WHEN n < 32 THEN {num(seed + primes[4])} ELSE list_reduce(v, lambda a, y: {plus(mul(f"xor(a, {lane('y')})", 1), num(primes[3]))}, {tops}) END AS h FROM v),
h1 AS (SELECT t, f, o, list_reduce(q[n // 32 * 4 + 1 :], lambda a, y: {plus(mul(rot(f"xor(a, {lane('y')})", 27), 1), num(primes[3]))}, {plus("h", "n::UHUGEINT")}) AS h FROM h0),
h2 AS (SELECT t, o, list_reduce(f, lambda a, y: {plus(mul(rot(f"xor(a, {mul('y', 1)})", 23), 2), num(primes[2]))}, h) AS h FROM h1),
h3 AS (SELECT t, list_reduce(o, lambda a, y: {mul(rot(f"xor(a, {mul('y', 5)})", 11), 1)}, h) AS h FROM h2),
h4 AS (SELECT t, {mul(f"xor(h, h // {num(1 << 33)})", 2)} AS h FROM h3),
h5 AS (SELECT t, {mul(f"xor(h, h // {num(1 << 29)})", 3)} AS h FROM h4),
x AS (SELECT t, xor(h, h // {num(1 << 32)})::UBIGINT AS h FROM h5)"""


OP6_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, total, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS t
  FROM (SELECT doc_id, w, greatest(1, len(w) - {SHINGLE - 1}) AS total, unnest(range(greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM d WHERE len(w) > 0)),
texts AS (SELECT DISTINCT t FROM s), {xxh64_sql("texts")},
k AS (SELECT doc_id, p, 2 * count(*) FILTER ((h >> p) & 1 = 1) > any_value(total) AS one FROM s JOIN x USING (t), range(64) z(p) GROUP BY doc_id, p),
fp AS (SELECT documents.doc_id, coalesce(f, 0::UBIGINT) AS f FROM documents
  LEFT JOIN (SELECT doc_id, sum(CASE WHEN one THEN (1::UBIGINT << p) ELSE 0 END)::UBIGINT AS f FROM k GROUP BY doc_id) USING (doc_id)),
n AS (SELECT f, min(doc_id) AS least FROM fp GROUP BY f),
e AS (SELECT a.f AS a, b.f AS b FROM n a JOIN n b ON bit_count(xor(a.f, b.f)) <= {RADIUS}),
c(f, seen) AS (SELECT f, f FROM n UNION SELECT c.f, e.b FROM c JOIN e ON e.a = c.seen),
m AS (SELECT c.f, min(least) AS root FROM c JOIN n ON n.f = c.seen GROUP BY c.f)
SELECT doc_id, lower(lpad(hex(f), 16, '0')) AS fingerprint, root AS component_id FROM fp JOIN m USING (f)
"""
