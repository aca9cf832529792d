"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2^60 positions (the first 15 hex digits of an MD5) cut into ``cells`` equal cells. A
document's key is its id with size and checksum of its text, so rows without id, or of one id, spread
over the ring too; only rows equal in all three share a position.
Every shard owns ``vnodes`` virtual nodes; a cell belongs to the first virtual node at or after
it, clockwise (of several in one cell the first counts). A shard's capacity is floor(n / shards), plus one for the first n mod shards
shards, so full shards are exactly balanced (law "rows": counts at most one apart). A shard takes
the keys of its own cells in clockwise order while it has room; keys beyond that continue
clockwise to the next virtual node whose shard still has room. Keys of cells below capacity never
move, so only the overflow depends on the other shards.

Only cell counts reach the driver: ``cells`` numbers, a bound set by the parameter, whatever the
number of rows. The plan that goes back has a run of ranks (cell, from, to, shard, offset) for
each cell plus at most one for each shard that fills up, so it is broadcast with a proven bound.
A row's rank within its cell is the only shuffle.

Null text: size 16, crc 0. Null id: the word "null" stands for it. Ids may be of any type that casts to
text. Rows of one position are ordered by id, and by null before empty text. Columns of the table keep
their names; added ones evade them. Empty input: empty output.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vaultmill.llm.common import shared_dir, table, unused

BITS, CELL_BITS, SHARDS, VNODES = 60, 16, 40, 128


def position(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def key_position(id_col: Column, size: Column, crc: Column) -> Column:
    key = F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("null")), size.cast("string"), crc.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def owners(shards: int, vnodes: int, cell_bits: int = CELL_BITS) -> list[int]:
    """The shard of every cell of the ring."""
    ring = sorted((position(f"shard-{s}-node-{v}") >> (BITS - cell_bits), position(f"shard-{s}-node-{v}"), s) for s in range(shards) for v in range(vnodes))
    at = [r[0] for r in ring]
    return [ring[bisect.bisect_left(at, c) % len(ring)][2] for c in range(1 << cell_bits)]


def deal(counts: dict[int, int], shards: int, vnodes: int, cell_bits: int = CELL_BITS) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, last rank, shard, slot of the first rank); ranks count from 0."""
    own, n = owners(shards, vnodes, cell_bits), sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    filled = [0] * shards
    runs: list[tuple[int, int, int, int, int]] = []
    over: list[tuple[int, int, int]] = []

    def put(cell: int, start: int, k: int, s: int) -> None:
        runs.append((cell, start, start + k - 1, s, filled[s]))
        filled[s] += k
        room[s] -= k

    for cell in sorted(counts):
        s = own[cell]
        k = min(room[s], counts[cell])
        if k:
            put(cell, 0, k, s)
        if k < counts[cell]:
            over.append((cell, k, counts[cell] - k))
    size = len(own)
    after = list(range(size + 1))  # union-find: the next cell, clockwise, whose shard may have room

    def find(c: int) -> int:
        root = c
        while after[root] != root:
            root = after[root]
        while after[c] != root:
            after[c], c = root, after[c]
        return root

    for cell, start, k in over:
        c = cell
        while k:
            c = find(c)
            if c == size:
                c = find(0)
            s = own[c]
            if not room[s]:
                after[c] = c + 1
                continue
            m = min(room[s], k)
            put(cell, start, m, s)
            start, k = start + m, k - m
    return runs


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, vnodes: int = VNODES, cell_bits: int = CELL_BITS) -> tuple[DataFrame, dict[str, str]]:
    """All rows of docs with the columns size, text_crc32, law, shard, slot and grown_shard added."""
    spark = docs.sparkSession
    shared_dir(spark)
    n = unused(("size", "text_crc32", "law", "shard", "slot", "grown_shard", "at", "cell", "rank", "run_cell", "first", "last", "to", "offset"), docs)
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    size, crc = F.octet_length(text).cast("long") + 16, F.crc32(text.cast("binary"))
    at = key_position(docs[f"`{id_col}`"], size, crc)
    cell = F.shiftright(at, BITS - cell_bits).cast("int")
    counts = {r[0]: r[1] for r in docs.groupBy(cell.alias("c")).count().collect()}  # at most 2^cell_bits rows
    runs = spark.createDataFrame(deal(counts, shards, vnodes, cell_bits), f"{n['run_cell']} int, {n['first']} long, {n['last']} long, {n['to']} int, {n['offset']} long")
    d = docs.select("*", size.alias(n["size"]), crc.alias(n["text_crc32"]), F.lit("rows").alias(n["law"]), at.alias(n["at"]), cell.alias(n["cell"]))
    order = W.partitionBy(n["cell"]).orderBy(n["at"], F.col(f"`{id_col}`").asc_nulls_last(), n["size"], n["text_crc32"], F.col(f"`{text_col}`").isNull())
    d = d.withColumn(n["rank"], F.row_number().over(order).cast("long") - 1)
    j = d.join(F.broadcast(runs), (d[n["cell"]] == runs[n["run_cell"]]) & (d[n["rank"]] >= runs[n["first"]]) & (d[n["rank"]] <= runs[n["last"]]))
    out = j.withColumn(n["shard"], F.col(n["to"])).withColumn(n["slot"], F.col(n["offset"]) + F.col(n["rank"]) - F.col(n["first"])).withColumn(n["grown_shard"], F.lit(None).cast("int"))
    return out.drop(*[n[c] for c in ("run_cell", "first", "last", "to", "offset", "at", "cell", "rank")]), n


def op7_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


# The ring of the defaults. CRC-32 byte by byte, since SQL has no function for it; keys beyond a shard's
# room walk on one after the other, each to the next virtual node whose shard has room.
OP7_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
t AS (SELECT doc_id, text IS NULL AS none, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
y AS (SELECT doc_id, none, n + 16 AS size, [4294967295] || list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM t),
z AS (SELECT doc_id, none, size, xor(list_reduce(bytes, lambda a, b: xor(tab[xor(a & 255, b) + 1], a >> 8)), 4294967295)::BIGINT AS crc FROM y, crc),
d AS (SELECT *, ('0x' || left(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || size || '|' || crc), 15))::BIGINT AS pos FROM z),
v AS (SELECT pos >> {BITS - CELL_BITS} AS cell, arg_min(s, pos) AS shard
  FROM (SELECT a.range AS s, ('0x' || left(md5('shard-' || a.range || '-node-' || b.range), 15))::BIGINT AS pos FROM range({SHARDS}) a, range({VNODES}) b) GROUP BY 1),
k AS (SELECT *, pos >> {BITS - CELL_BITS} AS cell, row_number() OVER (ORDER BY pos, doc_id NULLS LAST, size, crc, none) AS clock FROM d),
o AS (SELECT k.*, coalesce((SELECT arg_min(shard, v.cell) FROM v WHERE v.cell >= k.cell), (SELECT arg_min(shard, v.cell) FROM v)) AS own FROM k),
r AS (SELECT s.range AS shard, (SELECT count(*) FROM d) // {SHARDS} + (s.range < (SELECT count(*) FROM d) % {SHARDS})::BIGINT AS room FROM range({SHARDS}) s),
h AS (SELECT o.*, room, row_number() OVER (PARTITION BY own ORDER BY clock) AS nth FROM o JOIN r ON r.shard = own),
over_ AS (SELECT clock, cell, row_number() OVER (ORDER BY clock) AS j FROM h WHERE nth > room),
left_ AS (SELECT list(room - taken ORDER BY shard) AS room FROM (SELECT r.shard, room, least(room, count(own)) AS taken FROM r LEFT JOIN o ON own = r.shard GROUP BY r.shard, room)),
walk(j, room, clock, shard) AS (
  SELECT 0::BIGINT, room, 0::BIGINT, 0::BIGINT FROM left_
  UNION ALL
  SELECT j, list_transform(room, lambda x, i: CASE WHEN i = shard + 1 THEN x - 1 ELSE x END), clock, shard FROM (
    SELECT over_.j, any_value(walk.room) AS room, over_.clock, arg_min(v.shard, (v.cell - over_.cell + {1 << CELL_BITS}) % {1 << CELL_BITS}) AS shard
    FROM walk JOIN over_ ON over_.j = walk.j + 1, v WHERE walk.room[v.shard + 1] > 0 GROUP BY over_.j, over_.clock)),
p AS (SELECT h.*, CASE WHEN nth <= h.room THEN own ELSE w.shard END AS shard, nth > h.room AS moved FROM h LEFT JOIN walk w ON w.clock = h.clock AND w.j > 0)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY moved, clock) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p
"""
