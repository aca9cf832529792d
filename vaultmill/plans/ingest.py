"""Incremental ingest: parse all, replace what changed, write the edges that differ.

Links resolve among the documents of a run. With ``whole_store_scope`` (micro-batches, which see a few files
at a time) they resolve among all stored documents as well, and stored links are taken up again if a
document of the batch may change where they lead: every link is watched under the keys that could do
that, and a batch looks up the keys of its new documents and of titles that changed.

Of a document whose text is as before nothing is written, unless one of its links leads elsewhere: a digest
of each source's resolved links is kept and compared.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from vaultmill.functions.text import doc_id
from vaultmill.operators import chunk, embed, graph, lexical, links
from vaultmill.operators.parse import LATE, fronted, parse, refuse_bad
from vaultmill.plans.store import Snapshot, Store
from vaultmill.schema import DOCUMENT, RESOLUTION, VERSION
from vaultmill.sources.vault import scan

log = logging.getLogger(__name__)
NEAR = 4  # digits of the ids by which files are dealt out


@dataclass
class Stats:
    total: int = 0
    ingested: int = 0
    skipped: int = 0
    failed: int = 0


def detect_changes(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds status (new, changed or same) and the created_at to keep, by content hash."""
    titled = [F.col("title").alias("old_title")] if "title" in stored.columns else []
    old = stored.select("id", F.col("content_hash").alias("__hash"), F.col("created_at").alias("__created"), *titled)
    j = parsed.join(old, "id", "left")
    status = F.when(F.col("__hash").isNull(), "new").when(F.col("__hash") == F.col("content_hash"), "same").otherwise("changed")
    return j.withColumn("status", status).withColumnRenamed("__created", "kept_created_at").drop("__hash")


def touched(fresh: DataFrame, snap: Snapshot) -> DataFrame:
    """The stored links (with the columns of the table links) of sources that fresh documents may concern."""
    moved = fresh.where(F.col("old_title").isNull() | (F.col("old_title") != F.col("title")))
    keys = links.announced(moved.select("path", "title", "old_title"))
    sources = snap.table("watches").join(keys, ["kind", "key"], "left_semi").select("source_id").distinct()
    sources = sources.join(fresh.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    return snap.table("links").join(sources, "source_id", "left_semi")


def ingest_files(files: DataFrame, store: Store, make_embedder: Callable[[], embed.Embedder], *, now: str | None = None, whole_store_scope: bool = False, strict: bool = False, keep_dates: bool = False) -> Stats:
    """files(path, content) into the store. A bad document is counted and keeps its stored version;
    with strict it is a ParseError, raised before anything is written. Dates in front matter make a document bad,
    or are kept as text with keep_dates. Files with modified and size have these
    recorded, the bad ones too, so that a stream need not read them again.
    """
    now = now or datetime.now(UTC).isoformat()
    with store.snapshot() as snap:
        kept: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return df

        def prepared(plain: bool) -> tuple[DataFrame, dict[str, int]]:
            # spread before the work: files may come in few partitions. Ids that begin alike stay together, so the bounds of a
            # block of postings are found where these are; with rows in the store a join asks for whole ids
            name = doc_id(F.col("path"))
            spread = files.repartition(name if snap.segments else F.substring(name, 1, NEAR))
            df = keep(detect_changes(parse(spread, keep_dates, plain), snap.table("documents")).withColumn("near", F.substring("id", 1, NEAR)))
            kind = F.when(F.col("error") == LATE, "late").when(F.col("error").isNotNull(), "failed").when(F.col("status") == "same", "same").otherwise("fresh")
            return df, {r["s"]: r["count"] for r in df.groupBy(kind.alias("s")).count().collect()}

        try:
            bad = F.col("error").isNotNull()
            parsed, counts = prepared(plain=not fronted(files))
            if "late" in counts:  # a file was changed between the two looks at it
                parsed, counts = prepared(plain=False)
            stats = Stats(sum(counts.values()), counts.get("fresh", 0), counts.get("same", 0), counts.get("failed", 0))
            if stats.failed:
                if strict:
                    refuse_bad(parsed)
                for r in parsed.where(bad).select("path", "error").toLocalIterator():  # a line for each
                    log.error("failed: %s: %s", r["path"], r["error"])
            if not stats.total:
                log.warning("no documents found")
                return stats
            good = parsed.where(~bad)
            fresh = good.where("status <> 'same'")
            scope, status = good.select("path", "title"), F.lit("same").alias("status")
            if whole_store_scope:
                stored = snap.table("documents").select("id", "path", "title").join(good.select("id"), "id", "left_anti")
                scope = scope.unionByName(stored.select("path", "title"))
                waiting = touched(fresh, snap)
                found = links.extract(fresh, "truth", "status", "near").unionByName(waiting.select("*", status, F.substring("source_id", 1, NEAR).alias("near")))
                questions = links.asked_in(fresh).unionByName(links.asked(waiting)).distinct()
            else:
                found, questions = links.extract(good, "truth", "status", "near"), links.asked_in(good)
            resolved = keep(links.resolve_keyed(links.keyed(found), scope, keep(questions)))
            # a source is written if it is fresh or its links resolve in another way than they did
            # (with the first digits of its id a source is known to be in one partition, so these are grouped there)
            digests = links.digests(resolved, "status", "near")
            again = stats.skipped or (whole_store_scope and snap.segments)  # else all sources are fresh
            if again:
                old = snap.table("digests").withColumnRenamed("digest", "__old")
                digests = digests.join(old, "source_id", "left").select("source_id", "status", "digest", ((F.col("status") != "same") | ~F.col("digest").eqNullSafe(F.col("__old"))).alias("written"))
                digests = keep(digests)
                left, moved = digests.agg(F.count_if(~F.col("written")), F.count_if(F.col("written") & (F.col("status") == "same"))).first()
            else:
                digests, left, moved = digests.withColumn("written", F.lit(True)), 0, 0
            differ = digests.where("written and status = 'same'").select("source_id")
            gone = fresh.select("id", F.lit(DOCUMENT).alias("what"))
            if moved:
                gone = gone.unionByName(differ.select(F.col("source_id").alias("id"), F.lit(RESOLUTION).alias("what")))
            versions = None
            if {"modified", "size"} <= set(files.columns):
                seen = files.select(doc_id(F.col("path")).alias("id"), "path", "modified", "size")
                versions = seen.join(snap.table("versions").select("id", "modified", "size"), ["id", "modified", "size"], "left_anti").select("id", "path", "modified", "size")
                gone = gone.unionByName(versions.select("id", F.lit(VERSION).alias("what")))
            if not stats.ingested and not moved and (versions is None or versions.isEmpty()):
                log.info("nothing has changed: %s", asdict(stats))
                return stats
            mine = resolved
            if left:
                own = F.col("status") != "same"
                mine = resolved.where(own)
                if moved:
                    some = F.broadcast(differ) if moved <= graph.SOME else differ
                    mine = mine.unionByName(resolved.where(~own).join(some, "source_id", "left_semi"))
            # chunks that need no vector are never sent to the model: unchanged documents are filtered before it
            chunks = embed.embedded(chunk.chunk_rows(fresh), make_embedder)
            documents = fresh.select("*", F.coalesce("kept_created_at", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at"))
            truths = fresh.select("id", "title", F.col("truth").alias("content"))
            tables = {
                "documents": documents, "truths": truths, "chunks": chunks, "postings": lexical.postings(truths, "title", "content"), "lengths": lexical.lengths(truths, "title", "content"),
                "links": resolved.where("status <> 'same'"), "edges": links.once(mine.select("source_id", "target_id", "relationship_type", "near")), "watches": links.watches(mine, "near"), "digests": digests.where("written"),
            }
            store.append(tables | ({"versions": versions} if versions is not None else {}), gone)
            log.info("ingested %s", asdict(stats))
            return stats
        finally:
            for df in kept:
                df.unpersist()


def ingest(spark: SparkSession, folder: str, store: Store, make_embedder: Callable[[], embed.Embedder] = embed.HashingEmbedder, **options) -> Stats:
    """All *.md files below a folder."""
    return ingest_files(scan(spark, folder), store, make_embedder, **options)
