"""Packing of paragraphs into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultmill.functions.text import BLANK, strip

MOST = 1000


def chunks(text: Column, most: int = MOST) -> Column:
    """Array of chunks: paragraphs joined by blank lines while they fit; longer paragraphs stay whole."""
    paragraphs = F.filter(F.transform(F.split(text, rf"\n{BLANK}*\n"), strip), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, p: Column) -> Column:
        fits = F.length(acc["open"]) + 2 + F.length(p) <= most
        done = F.when((acc["open"] == "") | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        joined = F.when(acc["open"] == "", p).when(fits, F.concat(acc["open"], F.lit("\n\n"), p)).otherwise(p)
        return F.struct(done.alias("done"), joined.alias("open"))

    return F.aggregate(paragraphs, empty, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def chunk_rows(docs: DataFrame, text: str = "truth", most: int = MOST) -> DataFrame:
    """docs(id, text) -> (doc_id, chunk_index, text)."""
    return docs.select(F.col("id").alias("doc_id"), F.posexplode(chunks(F.col(text), most)).alias("chunk_index", "text"))
