"""Neighbours and bounded walks on the edge list.

Walks and lookups start from the few and go to the many: ids that are known meet the tables through a
filter that reaches the scan (up to ``FEW`` ids) or through a broadcast (up to ``SOME``); only beyond
that are tables shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultmill.errors import QueryError

MOST_DEPTH = 3
FEW, SOME = 1000, 1_000_000  # ids in a filter; ids in a broadcast, of 16 characters


def having(table: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """The rows of a table with one of at most FEW ids, as a filter on the scan."""
    return table.where(F.col(key).isin(ids)) if ids else table.where(F.lit(False))


def matching(table: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, bool]:
    """The rows of a table whose key is among ids (one column), and whether they are few ids."""
    ids = ids.toDF("__id").where("__id is not null").distinct()
    got = [r[0] for r in ids.limit(FEW + 1).collect()]
    if len(got) <= FEW:
        return having(table, key, got), True
    if ids.limit(SOME + 1).count() <= SOME:
        ids = F.broadcast(ids)
    return table.join(ids, table[key] == F.col("__id"), "inner").drop("__id"), False


def neighbors(edges: DataFrame, documents: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Outbound edges with the paths of both ends; dangling targets have a null path."""
    src = documents.select(F.col("id").alias("source_id"), F.col("path").alias("source_path"))
    tgt = documents.select(F.col("id").alias("target_id"), F.col("path").alias("target_path"))
    e = edges
    if doc_id is not None:
        e, src = having(edges, "source_id", [doc_id]), F.broadcast(having(src, "source_id", [doc_id]))
        tgt, few = matching(tgt, "target_id", e.select("target_id"))
        tgt = F.broadcast(tgt) if few else tgt
    rows = e.join(src, "source_id", "left").join(tgt, "target_id", "left")
    return rows.select("source_id", "target_id", "relationship_type", "source_path", "target_path").orderBy("target_id", F.asc_nulls_first("relationship_type"))


def backlinks(edges: DataFrame, documents: DataFrame, doc_id: str) -> DataFrame:
    """Inbound edges (an extension)."""
    e = having(edges, "target_id", [doc_id])
    src, few = matching(documents.select(F.col("id").alias("source_id"), F.col("path").alias("source_path")), "source_id", e.select("source_id"))
    rows = e.join(F.broadcast(src) if few else src, "source_id", "left")
    return rows.select("source_id", "target_id", "relationship_type", "source_path").orderBy("source_id", F.asc_nulls_first("relationship_type"))


def check(depth: int, top_k: int = 0, lift_cap: bool = False) -> None:
    if depth > MOST_DEPTH and not lift_cap:
        raise QueryError(f"depth is at most {MOST_DEPTH}")
    if top_k < 0:
        raise QueryError("the number of expanded rows cannot be negative")


def walk(seeds: DataFrame, edges: DataFrame, documents: DataFrame, depth: int, lift_cap: bool = False) -> DataFrame:
    """seeds(doc_id) -> (doc_id, expansion_depth): documents within ``depth`` hops, seeds left out.

    For seeds of any number. Each level joins the last level with the edges, then what it reaches with the
    documents (dangling targets end there). A document's depth is the least number of hops over all
    levels, so levels need not know what was seen before.
    """
    check(depth, 0, lift_cap)
    seeds = seeds.select("doc_id").distinct()
    known = documents.select(F.col("id").alias("doc_id"))
    out, level = seeds.where(F.lit(False)).withColumn("d", F.lit(0)), seeds
    for d in range(1, depth + 1):
        reached = level.select(F.col("doc_id").alias("source_id")).join(edges.select("source_id", F.col("target_id").alias("doc_id")), "source_id")
        level = reached.select("doc_id").distinct().join(known, "doc_id").distinct()
        out = out.unionByName(level.withColumn("d", F.lit(d)))
    return out.groupBy("doc_id").agg(F.min("d").alias("expansion_depth")).join(seeds, "doc_id", "left_anti")


def expand(seeds: DataFrame, edges: DataFrame, documents: DataFrame, depth: int = 1, top_k: int = 20, lift_cap: bool = False) -> DataFrame:
    """The walk's first top_k documents by depth, then id."""
    check(depth, top_k, lift_cap)
    return walk(seeds, edges, documents, depth, lift_cap).orderBy("expansion_depth", "doc_id").limit(top_k)


def expand_from(ids: list[str], edges: DataFrame, documents: DataFrame, depth: int = 1, top_k: int = 20, lift_cap: bool = False) -> list[tuple[str, int]]:
    """The same for a few seeds on the driver: [(doc_id, depth)].

    A level is a lookup of the last one. Once top_k documents are found deeper levels cannot matter,
    since order is by depth first. A level of more than FEW documents is walked as a table.
    """
    check(depth, top_k, lift_cap)
    spark, out, seen, level = edges.sparkSession, [], set(ids), sorted(set(ids))
    known = documents.select(F.col("id").alias("doc_id"))
    for d in range(1, depth + 1):
        if not level or len(out) >= top_k:
            break
        targets = having(edges, "source_id", level).select("target_id").distinct()
        there = matching(known, "doc_id", targets)[0].select("doc_id").distinct()
        got = [r[0] for r in there.limit(FEW + 1).collect()]
        if len(got) > FEW:
            first = spark.createDataFrame([(i, k) for i, k in out] or [], "doc_id string, expansion_depth int")
            past = spark.createDataFrame([(i,) for i in sorted(seen)], "doc_id string")
            near = there.join(F.broadcast(past), "doc_id", "left_anti").withColumn("expansion_depth", F.lit(d))
            far = walk(there, edges, documents, depth - d, lift_cap).join(F.broadcast(past), "doc_id", "left_anti").withColumn("expansion_depth", F.col("expansion_depth") + d)
            rows = first.unionByName(near).unionByName(far).orderBy("expansion_depth", "doc_id").limit(top_k)
            return [tuple(r) for r in rows.collect()]
        level = sorted(set(got) - seen)
        seen |= set(level)
        out += [(i, d) for i in level]
    return out[:top_k]
