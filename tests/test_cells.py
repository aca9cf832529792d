import math

import numpy as np
import pytest

from vaultmill.operators import semantic
from vaultmill.operators.cells import CellIndex, centres_of


def rows(seed=1, n=1200, dim=8):
    """Clusters of different spread, copies, ties, and rows that fit no cell."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim)) * 4
    out = [(f"d{i // 2}", i % 2, (centres[i % 20] + rng.normal(size=dim) * (0.05 + (i % 5) / 3)).astype(np.float32).tolist()) for i in range(n)]
    out += [(f"copy{i}", 0, out[7][2]) for i in range(30)]
    return out + [("null", 0, None), ("short", 0, [1.0, 2.0]), ("hole", 0, [None] + [1.0] * (dim - 1)), ("zero", 0, [0.0] * dim), ("nan", 0, [math.nan] * dim), ("empty", 0, [])]


def listed(df):
    got = df.orderBy("rank").collect()
    return [(r.doc_id, r.chunk_index, r["rank"]) for r in got], [r.distance for r in got]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_cells_lose_no_neighbour(spark, tmp_path, metric):
    data = rows()
    chunks = spark.createDataFrame(data, "doc_id string, chunk_index int, embedding array<float>")
    index = CellIndex.build(chunks, str(tmp_path / "i"), metric, cells=40)
    assert sum(n for _, n in index.cells.values()) == len(data) and len(index.cells) <= 41
    rng = np.random.default_rng(5)
    queries = [data[7][2], data[100][2], rng.normal(size=8).tolist(), [100.0] * 8, [1.0, 2.0], [0.0] * 8]
    for q in queries:
        for k in (1, 20):
            q = [float(x) for x in q]
            (want, far), (got, away) = listed(semantic.nearest(chunks, q, k, metric)), listed(index.nearest(q, k))
            assert got == want and np.allclose(away, far, equal_nan=True), (metric, k)
    share = index.share([float(x) for x in data[100][2]])
    assert share < 0.4
    again = CellIndex.open(spark, str(tmp_path / "i"))
    assert again.cells == index.cells and index.nearest([1.0] * 8, 0).count() == 0


def test_cells_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id string, chunk_index int, embedding array<float>")
    assert CellIndex.build(empty, str(tmp_path / "i")).nearest([1.0, 2.0]).count() == 0
    with pytest.raises(ValueError):
        CellIndex.build(empty, str(tmp_path / "j"), "dot")


def test_centres():
    sample = np.repeat(np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]]), 50, axis=0) + np.random.default_rng(2).normal(size=(150, 2)) * 0.1
    assert len(centres_of(sample, 3)) <= 3 and len(centres_of(sample[:2], 256)) == 2 and len(centres_of(np.zeros((0, 0)), 4)) == 0
