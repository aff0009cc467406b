import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fotoloom.llm import similar

SCHEMA = "id bigint, v array<float>, q string, p string, shard int"  # the last three clash with names the operator uses


def vectors(n=600, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    x = np.concatenate([base + rng.normal(scale=s, size=base.shape) for s in (0, 0.05, 0.1, 0.3)])
    return x.astype(np.float32)


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in range(len(x)):
        cos = x @ x[i]
        near = sorted([(-round(float(c), 5), int(j)) for c, j in zip(cos, ids) if j != ids[i] and c >= least])[:k]
        out[int(ids[i])] = [j for _, j in near]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("blocks", [False, True])
def test_exact_with_relax_one(spark, monkeypatch, blocks):
    if blocks:  # a hot shard is searched block against block
        monkeypatch.setattr(similar, "MIN_SHARDS", 1)
        monkeypatch.setattr(similar, "BLOCK_ROWS", 200)
    x = vectors()
    ids = np.arange(len(x)) * 3
    got = similar.most_similar(frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)]), "id", "v", 5, 0.8, dim=16, relax=1.0).toPandas()
    want = brute(ids, x, 5, 0.8)
    mine = {q: set(g.p) for q, g in got.groupby("q")}
    assert {q: set(w) for q, w in want.items() if w} == mine
    assert (got.q != got.p).all()


def test_unusable_vectors_are_no_copies(spark):
    """More unusable vectors of one kind than a list of the best holds."""
    bad = [[0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] * 16, [-0.0] * 16]
    rows = [(40 * k + i, v) for k, v in enumerate(bad) for i in range(40)] + [(1000, [1.0] * 16), (1001, [2.0] * 16)]
    got = similar.similar_pairs(frame(spark, rows), "id", "v", 3, 0.9, dim=16).collect()
    assert [(r.id_lo, r.id_hi) for r in got] == [(1000, 1001)]


def test_copies_stay_few_however_many_shards(monkeypatch):
    """A vector goes to fewer than 4 shards from 8 to 2,048 of them, and near pairs still meet."""
    import pyarrow.parquet as pq

    x = similar.to_matrix(pd.Series(pq.read_table("/root/testdata/sf0.1/faces.parquet").slice(0, 20_000)["face_embedding"].to_pylist()), 128)
    x = x[x.any(axis=1)]
    i, j = np.nonzero(np.triu(x @ x.T, 1) >= 0.94)
    for shards in (8, 128, 2048):
        monkeypatch.setattr(similar, "SHARD_ROWS", len(x) // shards)
        monkeypatch.setattr(similar, "FANOUT", 4096)
        cells = similar.Cells(x, 1.0, float(np.sqrt(0.12)) / 16)
        where = [set() for _ in x]
        for leaf, idx in cells.route(x):
            for r in idx.tolist():
                where[r].add(leaf)
        assert len(cells.blocks) >= shards and sum(map(len, where)) < 4 * len(x)
        assert sum(bool(where[a] & where[b]) for a, b in zip(i.tolist(), j.tolist())) >= 0.97 * len(i)


def test_recall_of_the_default(spark, data):
    df = spark.read.parquet("/root/testdata/sf0.01/faces.parquet").select("face_id", "face_embedding")
    got = {(r.id_lo, r.id_hi) for r in similar.similar_pairs(df, "face_id", "face_embedding", 10, 0.94).collect()}
    rows = df.collect()
    x = similar.to_matrix(pd.Series([r.face_embedding for r in rows]), 128)
    ids = np.array([r.face_id for r in rows])
    i, j = np.nonzero(np.triu(x @ x.T, 1) >= 0.94)
    want = {(min(a, b), max(a, b)) for a, b in zip(ids[i].tolist(), ids[j].tolist())}
    assert len(got & want) >= 0.99 * len(want) and got <= want


def test_copies_and_bad_vectors(spark):
    one, other = [1.0] + [0.0] * 15, [0.0, 1.0] + [0.0] * 14
    rows = [(i, one) for i in range(40)] + [(100, other), (101, [x * 4 for x in other])]
    rows += [(200, None), (201, [0.0] * 16), (202, [1.0]), (203, [float("nan")] + [1.0] * 15), (204, [None] + [1.0] * 15), (None, one), (100, other)]
    got = similar.most_similar(frame(spark, rows), "id", "v", 3, 0.9, dim=16).collect()
    best = {}
    for r in got:
        best.setdefault(r.q, set()).add(r.p)
    assert {q for q in best} == set(range(40)) | {100, 101}
    assert best[0] == {1, 2, 3} and best[2] == {0, 1, 3} and best[39] == {0, 1, 2} and best[100] == {101} and best[101] == {100}


def test_empty(spark):
    assert similar.similar_pairs(frame(spark, [(1, None)]).filter("id > 1"), "id", "v", 3, 0.9, dim=16).count() == 0


@pytest.mark.parametrize("dim", [7, 128])
def test_pack_round_trip(dim):
    x = np.random.default_rng(1).normal(size=(50, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = similar.unpack(similar.raw_rows(pd.Series(similar.pack(x))), dim)
    assert np.abs(y @ y.T - x @ x.T).max() < 1e-3


def test_unit_vector_column(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])]
    got = [r.u for r in spark.createDataFrame(rows, "id int, v array<float>").orderBy("id").select(similar.unit_vector(F.col("v"), 2).alias("u")).collect()]
    assert got == [[0.6, 0.8], None, None, None]
