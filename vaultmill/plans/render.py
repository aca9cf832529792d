"""Results as text blocks and JSON. The layout of the blocks is a fixed format."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultmill.functions.text import excerpt


def _or(c: str, default: str) -> Column:
    return F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), default).otherwise(F.col(c).cast("string"))


def result_block(position: Column) -> Column:
    depth = F.when(F.col("expansion_depth") > 0, F.format_string("  depth=%d", "expansion_depth")).otherwise("")
    head = F.format_string("#%d  signal=%s  rrf_score=%s  lex_rank=%s  sem_rank=%s%s", position, F.col("signal"), F.format_string("%.6f", "rrf_score"), _or("lexical_rank", "-"), _or("semantic_rank", "-"), depth)
    return F.concat_ws("\n", head, F.concat(F.lit("    path: "), "path"), F.concat(F.lit("    title: "), "title"), F.concat(F.lit("    chunk_index: "), F.col("chunk_index").cast("string")), F.concat(F.lit("    excerpt: "), excerpt(F.col("chunk_text"))))


def neighbor_block(position: Column) -> Column:
    head = F.format_string("#%d  -> %s  rel=%s", position, F.col("target_id"), _or("relationship_type", "(no relationship)"))
    return F.concat_ws("\n", head, F.concat(F.lit("    target_path: "), _or("target_path", "(dangling)")))


def as_text(rows: DataFrame, block, empty: str) -> str:
    """Blocks of an ordered result of bounded size."""
    got = rows.collect()
    if not got:
        return empty
    at = rows.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(got)], "position int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
    return "\n".join(r[0] for r in at.coalesce(1).select(block(F.col("position")).alias("b"), "position").orderBy("position").select("b").collect())


def results_text(rows: DataFrame) -> str:
    return as_text(rows, result_block, "(no candidate found)")


def neighbors_text(rows: DataFrame) -> str:
    return as_text(rows, neighbor_block, "(no outbound edges)")


def as_json(rows: DataFrame) -> str:
    """A list of objects, nulls included."""
    return json.dumps([r.asDict() for r in rows.collect()], indent=2)
