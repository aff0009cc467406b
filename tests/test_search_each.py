"""The most similar rows of many rows, against brute force."""

import numpy as np
import pytest

from fotoloom.functions.vectors import cosine_rows, dot_rows
from fotoloom.operators import search
from fotoloom.session import Scratch


def brute(ids, x, asked, k, threshold):
    square, out = dot_rows(x, x), set()
    for n in asked:
        s = cosine_rows(np.broadcast_to(x[n], x.shape), x, np.broadcast_to(square[n], len(x)), square)
        best = sorted((-c, i) for c, i in zip(s.tolist(), ids.tolist()) if c >= threshold and i != ids[n])[:k]
        out |= {(int(ids[n]), i, -c) for c, i in best}
    return out


def rows(n, dim=12):
    """Loose vectors, close ones, copies, and copies of other lengths."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim))
    x[n // 4 : n // 2] = x[:7].repeat(n, axis=0)[: n // 2 - n // 4] + 0.001 * rng.normal(size=(n // 2 - n // 4, dim))
    x[n // 2 : n // 2 + 60] = x[3] * np.array([1, 2, 4])[np.arange(60) % 3, None]
    return rng.permutation(n), x


@pytest.mark.parametrize(("product", "checked"), [(8_400_000, 20_000), (3_000, 50)])
def test_best_of_slices(monkeypatch, product, checked):
    monkeypatch.setattr(search, "PRODUCT", product)
    monkeypatch.setattr(search, "CHECKED", checked)
    ids, x = rows(900)
    asked = np.flatnonzero(ids % 5 == 0)
    best = search.Best(ids[asked], x[asked], 4, 0.1)
    for at in range(0, 900, 250):
        best.add(ids[at : at + 250], x[at : at + 250])
    assert {(r.query_id, r.id, r.similarity) for r in best.result().itertuples()} == brute(ids, x, asked, 4, 0.1)


def test_blocks_and_shares(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_ROWS", 70)
    ids, x = rows(600)
    df = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist())], "i bigint, v array<double>").repartition(5)
    got = search.similar_to_each(df, "i", "v", df.filter("i % 3 = 0"), 4, 0.1, dim=12).collect()
    assert {(r.query_id, r.id, r.similarity) for r in got} == brute(ids, x, np.flatnonzero(ids % 3 == 0), 4, 0.1) and len(got) <= 800


def test_rows_are_stored_once(spark, data, monkeypatch):
    """However many blocks of queries there are, no row is copied for each; before, 16 blocks sent every row 16 times."""
    cut, stored = Scratch.cut, []
    monkeypatch.setattr(Scratch, "cut", lambda self, df: stored.append(cut(self, df)) or stored[-1])
    monkeypatch.setattr(search, "QUERY_ROWS", 2)
    faces = spark.read.parquet(f"{data}/faces.parquet").select("face_id", "face_embedding")
    plan = search.similar_to_each(faces, "face_id", "face_embedding", faces.filter("face_id % 20 = 0"), 10)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan and len(stored) == 2
    assert max(s.count() for s in stored) <= faces.count()
