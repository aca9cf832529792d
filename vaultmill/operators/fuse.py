"""Reciprocal Rank Fusion of the lexical and the semantic list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RRF_K = 60  # fixed value


def signal() -> Column:
    lex, sem = F.col("lexical_rank").isNotNull(), F.col("semantic_rank").isNotNull()
    return F.when(lex & sem, "fused").when(lex, "lexical").otherwise("semantic")


def fuse(lexical: DataFrame, semantic: DataFrame, top_k: int = 10) -> DataFrame:
    """(doc_id, chunk_index, rrf_score, lexical_rank, semantic_rank, signal), best first."""
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col(c)), F.lit(0.0))
    j = lexical.select("doc_id", "lexical_rank").join(semantic.select("doc_id", "chunk_index", "semantic_rank"), "doc_id", "full_outer")
    j = j.withColumn("rrf_score", share("lexical_rank") + share("semantic_rank"))
    return j.select("doc_id", "chunk_index", "rrf_score", "lexical_rank", "semantic_rank", signal().alias("signal")).orderBy(F.desc("rrf_score"), "doc_id").limit(max(0, top_k))
