"""Exact nearest neighbours with cells that are skipped by the triangle inequality.

Centres come from a bounded sample of the vectors (``SAMPLE`` of them, a few rounds of averaging on the driver);
every row is assigned to its nearest centre, and each cell keeps its radius, the distance of its farthest row.
No row of a cell is nearer to a query than the distance of its centre less the radius. A search reads the
cells that come first by that bound until they hold enough rows, and then the cells whose bound is not
above the distance of the last row found. Rows are laid out by cell, so others are not read from disk.

For cosine the vectors are scaled to length one, where the distance d of the cosine is half the square of the
straight one. Rows that fit no cell (null, zero for cosine, another width than the sample, values that are not
numbers) are a cell of their own that is always read, so results are those of ``semantic.nearest`` for any rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultmill.operators import semantic

SAMPLE, CELLS, ROUNDS = 4096, 256, 6
APART = -1  # the cell of rows that fit none
SLACK = 1e-9


def matrix(vectors: list, width: int | None, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of that width (the first one's by default) as rows, scaled if asked, and which ones they are."""
    ok, rows = [], []
    for i, v in enumerate(vectors):
        if not v or any(x is None for x in v) or (width is not None and len(v) != width):
            continue
        x = np.array(v, float)
        size = math.sqrt(float(x @ x)) if np.isfinite(x).all() else math.nan
        if not math.isfinite(size) or (unit and size == 0):
            continue
        width = len(v)
        ok.append(i)
        rows.append(x / size if unit else x)
    return np.array(rows).reshape(len(rows), width or 0), np.array(ok, np.int64)


def centres_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """At most so many centres: rows spread over the sample, then moved to the mean of what is nearest to them."""
    centres = np.unique(sample, axis=0)
    centres = centres[:: max(1, math.ceil(len(centres) / cells))].copy()
    for _ in range(ROUNDS if len(centres) < len(sample) else 0):
        near = nearest_centre(sample, centres)[0]
        for k in np.unique(near):
            centres[k] = sample[near == k].mean(axis=0)
    return centres


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, distance) of each row's nearest centre. The distance is that of the difference, to the last digit."""
    near = np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)
    return near, np.sqrt(((rows - centres[near]) ** 2).sum(axis=1))


class CellIndex:
    """Rows with a column ``cell``, the cells' centres (a matrix), and their {cell: (radius, rows)}."""

    def __init__(self, rows: DataFrame, metric: str, centres: np.ndarray, cells: dict[int, tuple[float, int]]):
        self.rows, self.metric, self.centres, self.cells = rows, metric, centres, cells

    @classmethod
    def build(cls, chunks: DataFrame, path: str, metric: str = "l2", *, cells: int = CELLS, sample: int = SAMPLE) -> CellIndex:
        """Writes the index of chunks(doc_id, chunk_index, embedding) to a folder."""
        spark, unit = chunks.sparkSession, metric == "cosine"
        if metric not in ("l2", "cosine"):
            raise ValueError("metric is l2 or cosine")
        # a repeatable sample: the smallest hashes of what names a row
        first = chunks.where("embedding is not null").orderBy(F.xxhash64("doc_id", "chunk_index"), "doc_id", "chunk_index").limit(sample).select("embedding")
        centres = centres_of(matrix([r[0] for r in first.collect()], None, unit)[0], cells)
        shared = spark.sparkContext.broadcast(centres)  # ``cells`` vectors at most

        @F.arrow_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]))
        def place(vectors: pa.Array) -> pa.Array:
            cell, away = np.full(len(vectors), APART, np.int32), np.zeros(len(vectors))
            if len(shared.value):
                rows, at = matrix(vectors.to_pylist(), shared.value.shape[1], unit)
                if len(at):
                    cell[at], away[at] = nearest_centre(rows, shared.value)
            return pa.StructArray.from_arrays([pa.array(cell), pa.array(away)], ["cell", "away"])

        placed = chunks.select("*", place("embedding").alias("p")).select(*chunks.columns, F.col("p.cell").alias("cell"), F.col("p.away").alias("away"))
        placed.repartitionByRange("cell").sortWithinPartitions("cell", "doc_id", "chunk_index").write.parquet(f"{path}/rows")
        sizes = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.max("away"), F.count("*"))  # ``cells`` rows at most
        about = {"metric": metric, "centres": centres.tolist(), "cells": [list(r) for r in sizes.collect()]}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
        rows = spark.read.parquet(f"{path}/rows").drop("away")
        return cls(rows, about["metric"], np.array(about["centres"]), {c: (r, n) for c, r, n in about["cells"]})

    def reachable(self, query: Sequence[float], top_k: int) -> list[int]:
        """The cells that may hold one of the top_k rows, the one of the rows apart included."""
        every = sorted(self.cells)
        q, fits = matrix([list(query)], self.centres.shape[1] if len(self.centres) else None, self.metric == "cosine")
        if not len(fits) or not len(self.centres):
            return every
        gap = np.sqrt(((self.centres - q[0]) ** 2).sum(axis=1))
        least = {c: 0.0 if c == APART else max(0.0, float(gap[c]) - r) for c, (r, _) in self.cells.items()}
        first, n = [], 0
        for c in sorted((c for c in every if c != APART), key=lambda c: (least[c], gap[c])):
            if n >= top_k:
                break
            first.append(c)
            n += self.cells[c][1]
        # any rows give a distance that the last of the top_k does not exceed
        last = self.among(first, query, top_k).agg(F.max("distance"), F.count("*")).first()
        if last[1] < top_k:
            return every
        most = math.sqrt(2 * max(0.0, last[0])) if self.metric == "cosine" else last[0]
        return [c for c in every if least[c] <= most * (1 + SLACK) + SLACK ** 0.5 * (self.metric == "cosine") + SLACK]

    def among(self, cells: list[int], query: Sequence[float], top_k: int) -> DataFrame:
        return semantic.nearest(self.rows.where(F.col("cell").isin(cells)) if cells else self.rows.where(F.lit(False)), query, top_k, self.metric)

    def nearest(self, query: Sequence[float], top_k: int = 20) -> DataFrame:
        """(doc_id, chunk_index, rank, distance), equal to ``semantic.nearest`` over all rows."""
        return self.among(self.reachable(query, top_k) if top_k > 0 else [], query, top_k)

    def share(self, query: Sequence[float], top_k: int = 20) -> float:
        """The share of rows that a search reads in its second step."""
        total = sum(n for _, n in self.cells.values())
        return sum(self.cells[c][1] for c in self.reachable(query, top_k)) / total if total else 0.0
