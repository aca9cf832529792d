"""Queries against a store."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vaultmill.errors import QueryError
from vaultmill.operators import fuse, graph, lexical, semantic
from vaultmill.operators.embed import Embedder, encoder
from vaultmill.operators.parse import typed
from vaultmill.plans.store import Snapshot, Store
from vaultmill.schema import NEIGHBOR, RESULT

log = logging.getLogger(__name__)
PRUNE_FROM = 20_000_000  # terms of a corpus from which a query's postings are pruned by their blocks


class Engine:
    """Ranked retrieval with graph expansion, and neighbour lookup. Results are ordered DataFrames."""

    def __init__(self, spark: SparkSession, store: Store, embedder: Embedder, *, metric: str = "l2", strict_lexical: bool = True, prune_from: int = PRUNE_FROM):
        self.spark, self.store, self.embedder, self.prune_from = spark, store, embedder, prune_from
        self.metric, self.strict, self.encode = metric, strict_lexical, encoder(embedder)

    def stats(self, snap: Snapshot | None = None) -> DataFrame:
        """Corpus statistics; the store's list carries them."""
        return (snap or self.store.snapshot()).corpus()

    def lexical(self, text: str, top_k: int = 20, snap: Snapshot | None = None) -> DataFrame:
        if top_k > 0 and lexical.refused(text, self.strict):
            log.warning("the lexical query was refused, so only the semantic list counts: %r", text)
        snap = snap or self.store.snapshot()
        if snap.state["terms"] < self.prune_from:  # too small for three steps to pay
            return lexical.search(snap.table("postings"), snap.corpus(), text, top_k, self.strict)
        return lexical.pruned(snap.table("postings"), snap.table("blocks"), snap.corpus(), text, top_k, self.strict)

    def semantic(self, text: str, top_k: int = 20, snap: Snapshot | None = None) -> DataFrame:
        if top_k <= 0:
            return self.spark.createDataFrame([], "doc_id string, chunk_index int, semantic_rank int")
        vector = [float(x) for x in self.encode([text])[0]]
        return semantic.search((snap or self.store.snapshot()).table("chunks"), vector, top_k, self.metric)

    def query(self, text: str, *, lexical_top_k: int = 20, semantic_top_k: int = 20, final_top_k: int = 10, expand: bool = False, expand_depth: int = 1, expand_top_k: int = 20, lift_cap: bool = False, at: Snapshot | None = None) -> DataFrame:
        """Fused results, best first, then expanded documents by depth and id.

        What is ranked is bounded by the three numbers of rows, so it comes to the driver, and documents,
        edges and chunks are looked up by id from there: no table is shuffled. All tables are read from one
        state of the store (``at``, or the newest one), whatever is written meanwhile.
        """
        if expand:
            graph.check(expand_depth, expand_top_k, lift_cap)
        if at is None:
            with self.store.snapshot() as snap:
                return self.query(text, lexical_top_k=lexical_top_k, semantic_top_k=semantic_top_k, final_top_k=final_top_k, expand=expand, expand_depth=expand_depth, expand_top_k=expand_top_k, lift_cap=lift_cap, at=snap)
        documents, chunks = at.table("documents"), at.table("chunks")
        top = fuse.fuse(self.lexical(text, lexical_top_k, at), self.semantic(text, semantic_top_k, at), final_top_k).collect()
        rows = [(r["doc_id"], r["chunk_index"] or 0, r["signal"], round(r["rrf_score"], 6), r["lexical_rank"], r["semantic_rank"], 0) for r in top]
        if expand and expand_depth > 0 and rows:
            more = graph.expand_from([r[0] for r in rows], at.table("edges"), documents, expand_depth, expand_top_k, lift_cap)
            rows += [(i, 0, "expanded", 0.0, None, None, d) for i, d in more]
        found = {r["id"]: r for r in self.lookup(documents.select("id", "path", "title"), "id", [r[0] for r in rows])}
        lost = [r[0] for r in rows if r[0] not in found]
        if lost:
            raise QueryError(f"no documents row for the hit {lost[0]}")
        texts = {(r["doc_id"], r["chunk_index"]): r["text"] for r in self.lookup(self.chunk_texts(chunks, rows), "doc_id", [r[0] for r in rows])}
        out = [(i, k, found[i]["path"], found[i]["title"], s, score, lex, sem, texts.get((i, k)) or "", d) for i, k, s, score, lex, sem, d in rows]
        return self.spark.createDataFrame(sorted(out, key=lambda r: (r[9], -r[5], r[0])), RESULT).coalesce(1)

    @staticmethod
    def lookup(table: DataFrame, key: str, ids: list[str]) -> list[Row]:
        out: list[Row] = []
        for i in range(0, len(ids), graph.FEW):
            out += graph.having(table, key, ids[i : i + graph.FEW]).collect()
        return out

    @staticmethod
    def chunk_texts(chunks: DataFrame, rows: list[tuple]) -> DataFrame:
        return chunks.select("doc_id", "chunk_index", "text").where(F.col("chunk_index").isin(sorted({r[1] for r in rows})) if rows else F.lit(False))

    def neighbors(self, doc_id: str) -> DataFrame:
        """Outbound edges; an unknown id has none."""
        snap = self.store.snapshot()
        return graph.neighbors(snap.table("edges"), snap.table("documents"), doc_id).select(*NEIGHBOR.names)

    def having(self, path: str, kind: str, condition: Callable[[Column], Column]) -> DataFrame:
        """(id, path, title, value): documents whose front matter has a value of that type for which the condition holds."""
        documents = self.store.table("documents")
        rows = documents.select("id", "path", "title", typed(documents, path, kind).alias("value"))
        return rows.where(condition(F.col("value")))

    def backlinks(self, doc_id: str) -> DataFrame:
        snap = self.store.snapshot()
        return graph.backlinks(snap.table("edges"), snap.table("documents"), doc_id)

    def require(self, doc_id: str) -> None:
        if self.store.table("documents").where(F.col("id") == doc_id).limit(1).isEmpty():
            raise QueryError(f"unknown document {doc_id}")
