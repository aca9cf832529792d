"""Exact nearest neighbours over chunk embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vaultmill.functions.vectors import METRICS


def nearest(chunks: DataFrame, query: Sequence[float], top_k: int = 20, metric: str = "l2") -> DataFrame:
    """(doc_id, chunk_index, rank, distance): the top_k chunks by distance, then id and index."""
    dist = METRICS[metric](F.col("embedding"), query)
    rows = chunks.select("doc_id", "chunk_index", dist.alias("distance")).where("distance is not null")
    key = ("__tie", "doc_id", "chunk_index")  # rounded once a row: a sort makes its expressions anew for each comparison
    top = rows.withColumn("__tie", F.round("distance", 12)).orderBy(*key).limit(max(0, top_k))
    return top.select("doc_id", "chunk_index", "distance", F.row_number().over(W.orderBy(*key)).alias("rank"))


def best_per_document(near: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, semantic_rank): each document's first chunk, with the chunk's rank, so ranks may have gaps."""
    return near.groupBy("doc_id").agg(F.min(F.struct("rank", "chunk_index")).alias("m")).select("doc_id", F.col("m.chunk_index").alias("chunk_index"), F.col("m.rank").alias("semantic_rank"))


def search(chunks: DataFrame, query: Sequence[float], top_k: int = 20, metric: str = "l2") -> DataFrame:
    return best_per_document(nearest(chunks, query, top_k, metric))
