"""Near-duplicate embeddings by an epsilon grid order join.

Vectors of one label (and length) with cosine >= ``least`` are linked. On unit vectors that is a
Euclidean distance of at most eps = sqrt(2 - 2 * least). Vectors are turned onto the principal axes
of the data (a rotation keeps distances; the axes come from one distributed pass of moments, a
matrix of bounded size), the leading coordinates are cut into cells of width eps, and vectors are
sorted by cell, lexicographically: the epsilon grid order. The sorted sequence is cut into blocks of
about ``ROOM`` bytes, however long the vectors are. Blocks that hold cells next to each other meet by
an equi-join on the leading cells, and a pair of blocks goes on only if their bounding boxes come
within eps. That join sees names and boxes only; a cell with many blocks is dealt to several tasks
(its blocks are counted first). Each pair of sequence intervals is
joined recursively: split in halves, halves with boxes further apart than eps are skipped, and
small ones are compared by one matrix product in double precision. A pair yields the number of
links per vector and the edges of a spanning forest, never a list of all pairs.

Vectors equal in all components and label are one class, compared once and counted by size, so
groups of copies of any size cost nothing. Cosines are computed from the vectors as they are; the
rotation only decides what is skipped, with a margin far above its rounding.

Labels may have any type that casts to text; ids are whole numbers (others raise a TypeError). Null or
zero vectors, and those with null or non-finite components, link with nothing; so does a null label.
Null ids: never the smallest of a component unless it has no other. Repeated rows count as vectors
of their own. Empty input: empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultmill.llm.common import LAST_ID, components, cut, integer_id, row_id, salted, shuffle_width, smallest, table
from vaultmill.llm.simhash import forest

LEAST = 0.98
LEADING = 8  # coordinates with cells
KEYED = 3  # of these, coordinates that blocks are joined on
ROOM, SMALL = 1 << 21, 128  # bytes of a block in single precision; vectors of an interval that is compared outright
CROWD = 256  # blocks of a cell for one task
MARGIN = 1e-6
STEPS = np.stack(np.meshgrid(*[np.arange(-1, 2, dtype=np.int32)] * KEYED, indexing="ij"), -1).reshape(-1, KEYED)


@F.arrow_udf(T.BinaryType())
def packed(vectors: pa.Array) -> pa.Array:
    """The components as little-endian doubles; null for vectors that link with nothing."""
    out = []
    for v in vectors:
        x = v.values
        if x is None or x.null_count or not len(x):
            out.append(None)
            continue
        a = x.to_numpy(zero_copy_only=False).astype("<f8")
        out.append(a.tobytes() if np.isfinite(a).all() and a.any() else None)
    return pa.array(out, pa.binary())


def unit(blobs: list[bytes]) -> np.ndarray:
    return scaled(np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1))


def scaled(a: np.ndarray) -> np.ndarray:
    a = a / np.abs(a).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def slim(blobs: list[bytes]) -> bytes:
    """The vectors of a block, in single precision if that loses nothing."""
    a = np.frombuffer(b"".join(blobs), "<f8")
    with np.errstate(over="ignore"):
        b = a.astype("<f4")
    return (b if (b == a).all() else a).tobytes()


def full(data: pa.Buffer, n: int, dim: int) -> np.ndarray:
    a = np.frombuffer(data, "<f4" if data.size == 4 * n * dim else "<f8")
    return scaled(a.astype("<f8").reshape(n, dim))


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """vectors(vec, dim) -> per length the principal axes as rows, leading first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(1).to_numpy()
            blobs = b.column(0).to_pylist()
            for d in np.unique(dims).tolist():
                u = unit([x for x, k in zip(blobs, dims) if k == d])
                u = np.hstack([u, np.ones((len(u), 1))])
                sums[d] = sums.get(d, 0) + u.T @ u
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], ["dim", "m"])

    def total(key: tuple, t: pa.Table) -> pa.Table:
        m = sum(np.frombuffer(x, "<f8") for x in t["m"].to_pylist())
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "m": pa.array([m.tobytes()], pa.binary())})

    out = {}
    parts = vectors.select("vec", "dim").mapInArrow(moments, "dim int, m binary")
    for r in parts.groupBy("dim").applyInArrow(total, "dim int, m binary").collect():  # one row per vector length
        m = np.frombuffer(r["m"], "<f8").reshape(r["dim"] + 1, -1)
        n = m[-1, -1]
        cov = m[:-1, :-1] / n - np.outer(m[-1, :-1], m[-1, :-1]) / n**2
        _, v = np.linalg.eigh(cov)
        out[r["dim"]] = np.ascontiguousarray(v[:, ::-1].T)
    return out


def joined(u: np.ndarray, x: np.ndarray, a: slice, v: np.ndarray, y: np.ndarray, b: slice, eps: float, least: float, same: bool, out: list[np.ndarray]) -> None:
    """Recursive join of two intervals of the order; x and y are leading coordinates of u and v."""
    na, nb = a.stop - a.start, b.stop - b.start
    if not na or not nb:
        return
    gap = np.maximum(0, np.maximum(x[a].min(axis=0) - y[b].max(axis=0), y[b].min(axis=0) - x[a].max(axis=0)))
    if (gap * gap).sum() > eps * eps:
        return
    if na <= SMALL and nb <= SMALL:
        i, j = np.nonzero(u[a] @ v[b].T >= least)
        i, j = i + a.start, j + b.start
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        out.append(np.stack([i, j], 1))
        return
    halves = lambda s, n: [slice(s.start, s.start + n // 2), slice(s.start + n // 2, s.stop)] if n > SMALL else [s]
    for p in halves(a, na):
        for q in halves(b, nb):
            if not same or p.start <= q.start:
                joined(u, x, p, v, y, q, eps, least, same, out)


def links(items: DataFrame, *, least: float, leading: int = LEADING) -> tuple[DataFrame, DataFrame]:
    """items(id, n, label, dim, vec): classes of equal vectors with their sizes.

    Returns (id, links) and (a, b), edges that connect every component.
    """
    spark = items.sparkSession
    eps = float(np.sqrt(2 - 2 * least)) + MARGIN
    turn = axes(items)
    width = shuffle_width(spark)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            dims, blobs = b.column("dim").to_numpy(), b.column("vec").to_pylist()
            cells = np.zeros((b.num_rows, leading), np.int32)
            for d in np.unique(dims).tolist():
                w = np.flatnonzero(dims == d)
                x = unit([blobs[i] for i in w]) @ turn[d][:leading].T
                cells[w, : x.shape[1]] = np.floor(x / eps)
            yield pa.record_batch([*b.columns, *(pa.array(cells[:, k]) for k in range(leading))], [*b.schema.names, *(f"c{k}" for k in range(leading))])

    order = ["label", "dim", *(f"c{k}" for k in range(leading)), "id"]
    placed = items.select("id", "n", "label", "dim", "vec").mapInArrow(place, items.select("id", "n", "label", "dim", "vec").schema.simpleString()[7:-1].replace(":", " ") + "".join(f", c{k} int" for k in range(leading)))
    placed = cut(placed.repartitionByRange(width, *order).sortWithinPartitions(*order))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of vectors of one label, named by their first id (which is unique)."""
        held: list[pa.RecordBatch] = []
        size = 0

        def row(p: pa.Table) -> tuple:
            dim, blobs = p["dim"][0].as_py(), p["vec"].to_pylist()
            x = unit(blobs) @ turn[dim][:leading].T
            cells = np.unique(np.stack([p[f"c{k}"].to_numpy() for k in range(KEYED)], 1), axis=0)
            around = np.unique((cells[:, None, :] + STEPS[None, :, :]).reshape(-1, KEYED), axis=0)
            ids = p["id"].to_numpy().astype(np.int64)
            names = [[" ".join(map(str, c)) for c in w.tolist()] for w in (cells, around)]
            return (int(ids[0]), p["label"][0].as_py(), ids.tobytes(), p["n"].to_numpy().astype(np.int64).tobytes(), slim(blobs), dim, x.min(axis=0).tolist(), x.max(axis=0).tolist(), *names)

        def blocks(t: pa.Table, end: bool) -> tuple[list[tuple], pa.Table]:
            rows, at, n = [], 0, t.num_rows
            label, dim = t["label"].to_pylist(), t["dim"].to_pylist()
            while at < n:
                stop, most = at, max(1, ROOM // (4 * dim[at]))
                while stop < n and stop - at < most and label[stop] == label[at] and dim[stop] == dim[at]:
                    stop += 1
                if stop == n and stop - at < most and not end:
                    break
                rows.append(row(t.slice(at, stop - at)))
                at = stop
            return rows, t.slice(at)

        def record(rows: list[tuple]) -> pa.RecordBatch:
            names = pa.list_(pa.string())
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), names, names)
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["block", "label", "ids", "ns", "vecs", "dim", "low", "high", "cells", "around"])

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= 8 * ROOM:
                rows, rest = blocks(pa.Table.from_batches(held), False)
                held, size = rest.to_batches(), rest.nbytes
                for r in rows:  # a block at a time: they are large
                    yield record([r])
        if held:
            for r in blocks(pa.Table.from_batches(held), True)[0]:
                yield record([r])

    blocks = cut(placed.mapInArrow(block, "block long, label string, ids binary, ns binary, vecs binary, dim int, low array<double>, high array<double>, cells array<string>, around array<string>"))
    home = blocks.select(F.col("block").alias("block2"), "label", "dim", F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode("cells").alias("cell"))
    around = blocks.select("block", "label", "dim", "low", "high", F.explode("around").alias("cell"))
    apart = F.aggregate(
        F.zip_with(F.zip_with("low", "high2", lambda p, q: p - q), F.zip_with("low2", "high", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g
    )
    # a block's number is the first id of a sorted run, so "label, dim" agree and each pair is met from one side
    met = salted(home, around, ["label", "dim", "cell"], ["block2"], CROWD)
    pairs = met.where("block <= block2").where(apart <= eps * eps).select("block", "block2").distinct()
    left = blocks.select("block", "dim", F.col("ids").alias("i1"), F.col("ns").alias("n1"), F.col("vecs").alias("v1"))
    right = blocks.select(F.col("block").alias("block2"), F.col("ids").alias("i2"), F.col("ns").alias("n2"), F.col("vecs").alias("v2"))
    work = pairs.join(left, "block").join(right, "block2").select("block", "block2", "dim", "i1", "n1", "v1", "i2", "n2", "v2")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                same, dim = b.column(0)[r].as_py() == b.column(1)[r].as_py(), b.column(2)[r].as_py()
                i1, n1, i2, n2 = (np.frombuffer(b.column(k)[r].as_buffer(), "<i8") for k in (3, 4, 6, 7))
                u, v = full(b.column(5)[r].as_buffer(), len(i1), dim), full(b.column(8)[r].as_buffer(), len(i2), dim)
                x, y = u @ turn[dim][:leading].T, v @ turn[dim][:leading].T
                found: list[np.ndarray] = []
                joined(u, x, slice(0, len(u)), v, y, slice(0, len(v)), eps, least, same, found)
                if not found:
                    continue
                ij = np.concatenate(found)
                if not len(ij):
                    continue
                a, c = i1[ij[:, 0]], i2[ij[:, 1]]
                who = np.concatenate([a, c])
                nodes, at = np.unique(who, return_inverse=True)
                count = np.zeros(len(nodes), np.int64)
                np.add.at(count, at, np.concatenate([n2[ij[:, 1]], n1[ij[:, 0]]]))
                tree = forest(np.stack([a, c], 1))
                ids = np.concatenate([nodes, tree[:, 0]])
                cnt = np.concatenate([count, np.zeros(len(tree), np.int64)])
                to = np.concatenate([nodes, tree[:, 1]])
                yield pa.record_batch([pa.array(ids), pa.array(cnt), pa.array(to)], ["id", "links", "to"])

    met = cut(work.repartition(width, "block", "block2").mapInArrow(meet, "id long, links long, to long"))
    return met.groupBy("id").agg(F.sum("links").alias("links")), met.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))


def near_vectors(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    i = integer_id(rows, id_col)
    r = rows.select(i.alias("vec_id"), row_id(i).alias("rid"), rows[f"`{label_col}`"].cast("string").alias("label"), packed(rows[f"`{vec_col}`"]).alias("vec"))
    r = r.withColumn("vec", F.when(F.col("label").isNotNull(), F.col("vec"))).withColumn("h", F.sha2("vec", 256))
    r = cut(r)
    live = r.where(F.col("vec").isNotNull())
    classes = live.groupBy("label", "h").agg(F.min("rid").alias("rid"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    # row ids may repeat or be null, so classes get numbers of their own, fixed by writing them out
    items = cut(classes.withColumn("dim", (F.octet_length("vec") / 8).cast("int")).withColumn("id", F.monotonically_increasing_id()))
    counted, edges = links(items, least=least)
    comp = components(edges)
    member = smallest(comp.join(items, comp.node == items.id).select("node", "root", F.col("rid").alias("rep"))).withColumnRenamed("node", "id")
    done = items.join(counted, "id", "left").join(member, "id", "left").select("label", "h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("best", "rid").alias("best"))
    # rows that link with nothing have no class; they stay out of the join, where they would be one key
    alone = r.where("vec is null").select("vec_id", "rid", F.lit(0).cast("long").alias("links"), F.col("rid").alias("best"))
    j = r.where("vec is not null").select("vec_id", "rid", "label", "h").join(done, ["label", "h"]).select("vec_id", "rid", "links", "best").unionByName(alone)
    comp_id = F.col("best")
    comp_id = F.when(comp_id < LAST_ID, comp_id)
    return j.select("vec_id", F.col("links").cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.col("vec_id").isNull() & comp_id.isNull()).alias("kept"))


def op10_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (
  WITH RECURSIVE w(node, seen) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT w.node, p.b FROM w JOIN p ON p.a = w.seen)
  SELECT node, min(seen) AS root FROM w GROUP BY node)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.root AS component_id, e.vec_id = r.root AS kept
FROM embeddings e JOIN r ON r.node = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) n ON n.a = e.vec_id
"""
