"""Pairs of near vectors against brute force: none is lost, whatever the cells and blocks."""

import numpy as np
import pytest

from fotoloom.functions.vectors import cosine_rows, dot_rows
from fotoloom.operators import vector_pairs


def brute(rows, least, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    square = dot_rows(x, x)
    out = set()
    for n, i in enumerate(ids):
        s = cosine_rows(np.broadcast_to(x[n], x.shape), x, np.broadcast_to(square[n], len(x)), square)
        best = sorted((-c, j) for c, j in zip(s.tolist(), ids.tolist()) if c >= least and j != i)[:k]
        out |= {(min(i, j), max(i, j)) for _, j in best}
    return out


def found(spark, rows, least=0.98, k=3, dim=16):
    df = vector_pairs.similar_pairs(spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in rows], "i bigint, v array<double>"), "i", "v", least, k, dim=dim)
    got = [(r.id1, r.id2) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_copies_meet_what_points_the_same_way(spark):
    """Twice the vector has the cosine 1 too, and its id is the smallest: it is the best of all 30 copies."""
    one = np.arange(1.0, 17.0)
    rows = [(0, one * 2), *[(i, one) for i in range(10, 40)]]
    assert found(spark, rows) == brute(rows, 0.98, 3) and (0, 39) in found(spark, rows)


@pytest.mark.parametrize(("least", "block"), [(0.98, 65_536), (0.9, 40), (0.0, 40)])
def test_no_pair_is_lost(spark, monkeypatch, least, block):
    monkeypatch.setattr(vector_pairs, "CELL_ROWS", 20)
    monkeypatch.setattr(vector_pairs, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    rows = []
    for i in range(300):
        v = centre[i % 6] + 0.4 * rng.normal(size=16)
        rows += [(2 * i, v), (2 * i + 1, v + np.linalg.norm(v) * rng.choice([0.1, 0.2]) * rng.normal(size=16) / 4)]
    want = brute(rows, least, 3)
    assert len(want) > 100 and found(spark, rows, least) == want


def test_cells_divide_where_it_copies_little():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(16, 64)), 500, axis=0) + 0.3 * rng.normal(size=(8000, 64))
    cells = vector_pairs.Cells((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), 20.0, 0.2)
    assert len(cells.centres) > 8 and cells.copies <= vector_pairs.MOST_COPIES
    x = rng.normal(size=(8000, 64))
    assert vector_pairs.Cells((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), 1.0, 0.2).blocks == [1]


def test_plan_is_small(spark, data):
    """The plan of before had 48 exchanges and 16 sort-merge joins on ten times sf0.1, and moved every vector four times."""
    df = vector_pairs.similar_pairs(spark.read.parquet(f"{data}/photo_index.parquet"), "image_id", "clip_embedding_siglip")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 and "Join" not in plan


def test_many_near_rows(monkeypatch):
    """So many near ones that single precision chooses first, and that candidates are checked in parts."""
    monkeypatch.setattr(vector_pairs, "CHECKED", 500)
    monkeypatch.setattr(vector_pairs, "PRODUCT", 10_000)
    rng = np.random.default_rng(7)
    x = 1 + 0.02 * rng.normal(size=(300, 24))
    ids = rng.permutation(300)
    got = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for i, j, _ in vector_pairs.near_rows(ids, x, 0.98, 3) for a, b in zip(i, j)}
    assert got == brute(list(zip(ids.tolist(), x)), 0.98, 3)
