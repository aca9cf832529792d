"""Continuous ingest (an extension): new and edited files of a folder, batch by batch.

Spark's file source reads a path once, so an edit of a file would never be seen. Here each trigger lists the
folder and joins the listing against the versions (path, time of change, size) that the store has
recorded; what is new or differs is read and goes through the incremental ingest, ``most`` files at a
time. A version is committed with the rows that it gave, in one list of the store, so a batch that is
repeated after a failure finds nothing left to do, and no other state is kept. Files that cannot
be parsed have their version recorded as well, and are tried again once they change. An edit that changes neither
time nor size of a file is not seen; files that are deleted stay in the store, as in the batch ingest.

Links resolve against the whole store, and stored links are taken up again when a batch brings what
they were waiting for, or makes a name ambiguous, so the edges after the last batch are those of one ingest of all
files. Each batch adds a segment to the store, which merges its newest ones when there are many.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from vaultmill.operators.embed import Embedder
from vaultmill.plans.ingest import ingest_files
from vaultmill.plans.store import Store
from vaultmill.sources.vault import listing, on_disk, read_among, read_listed

log = logging.getLogger(__name__)
MOST, NAMED = 1000, 1000  # files of one ingest; of those that are read by their names


def due(files: DataFrame, store: Store, after: str = "", most: int = MOST) -> DataFrame:
    """The listed files whose version the store has not seen, by path, ``most`` of them at most, behind a path."""
    seen = store.table("versions").select("path", "modified", "size")
    rows = files.where(F.col("path") > after).join(seen, ["path", "modified", "size"], "left_anti").select("uri", "path", "modified", "size")
    return rows if rows.limit(most + 1).count() <= most else rows.orderBy("path").limit(most)


def catch_up(spark: SparkSession, folder: str, store: Store, make_embedder: Callable[[], Embedder], most: int = MOST) -> int:
    """Takes in whatever is new or edited, and returns how many files that were. Each listed file is tried
    once; what changes meanwhile is for the next call. Files that tasks cannot open by themselves are read by
    their names, up to ``NAMED`` of them, more of them with the folder."""
    files, done, after = listing(spark, folder).persist(StorageLevel.MEMORY_AND_DISK), 0, ""
    by_tasks = on_disk(spark, folder) is not None
    try:
        while True:
            rows = due(files, store, after, most).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                n, last = rows.agg(F.count("*"), F.max("path")).first()
                if not n:
                    return done
                found = read_listed(spark, [tuple(r) for r in rows.collect()]) if n <= NAMED and not by_tasks else read_among(spark, folder, rows)
                ingest_files(found, store, make_embedder, whole_store_scope=True)
                done, after = done + n, last
            finally:
                rows.unpersist()
    finally:
        files.unpersist()


def watch(spark: SparkSession, folder: str, store: Store, make_embedder: Callable[[], Embedder], checkpoint: str, *, once: bool = False, every: str = "10 seconds", most: int = MOST) -> StreamingQuery:
    """A streaming query that catches up at every trigger; with once it does so a single time and ends."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def take(_: DataFrame, number: int) -> None:
        log.info("batch %d: %d files", number, catch_up(spark, folder, store, make_embedder, most))

    writer = ticks.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
