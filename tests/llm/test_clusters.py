import numpy as np
from pyspark.sql import functions as F

from fotoloom.llm import clusters

SCHEMA = "id bigint, v array<float>, c int, cell int, cluster_id string"


def sample(seed=0, groups=12, dim=64, noise=300):
    rng = np.random.default_rng(seed)
    rows, truth, i = [], {}, 0
    for g in range(groups):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        n = [4, 5, 6, 9, 30, 200][g % 6]
        ids = list(range(i, i + n))
        for k in ids:
            e = rng.normal(size=dim)
            rows.append((k, (centre + 0.5 * e / np.linalg.norm(e)) * rng.uniform(0.5, 4)))
        if n >= 5:
            truth[ids[0]] = set(ids)
        i += n
    rows += [(10_000 + k, rng.normal(size=dim)) for k in range(noise)]
    return rows, truth


def frame(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v], 1, 2, "x") for k, v in rows], SCHEMA)


def members(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster_id, set()).add(r.id)
    return out


def test_finds_planted_clusters(spark, monkeypatch):
    monkeypatch.setattr(clusters, "SAMPLE_ROWS", 200)
    monkeypatch.setattr(clusters, "CELL_ROWS", 150)
    rows, truth = sample()
    bad = [(20_000, None), (20_001, [0.0] * 64), (20_002, [1.0, 2.0]), (20_003, [float("nan")] + [1.0] * 63), (None, [1.0] * 64)]
    got = members(clusters.similarity_clusters(frame(spark, rows + bad), "id", "v", dim=64))
    right = sum(len(got.get(k, set()) & v) for k, v in truth.items())
    assert right >= 0.95 * sum(map(len, truth.values()))
    assert sum(map(len, got.values())) <= right + 5
    x = {k: np.asarray(v) / np.linalg.norm(v) for k, v in rows}
    for ids in got.values():  # what is reported meets the definition
        mean = np.mean([x[i] for i in ids], axis=0)
        mean /= np.linalg.norm(mean)
        assert min(x[i] @ mean for i in ids) >= 0.749


def test_copies_and_empty(spark):
    same = [(i, [1.0] + [0.0] * 63) for i in range(300)]
    assert members(clusters.similarity_clusters(frame(spark, same), "id", "v", dim=64)) == {0: set(range(300))}
    assert clusters.similarity_clusters(frame(spark, same).limit(0), "id", "v", dim=64).count() == 0


def test_profiles(spark):
    rows = [(1, 1, 0.9), (1, 2, 0.95), (1, 3, 0.95), (1, 4, 0.8), (9, 9, 0.9)]
    got = {r.cluster_id: r for r in clusters.cluster_profiles(spark.createDataFrame(rows, "cluster_id bigint, id bigint, cos float"), 2).collect()}
    assert (got[1].size, got[1].typical_ids, got[9].typical_ids) == (4, [2, 3], [9])


def test_hashed_features(spark):
    rows = [(["a", "b", None], [1.0, 2.0, 3.0]), (["a", "a"], [1.0, None]), ([], []), (None, None)]
    df = spark.createDataFrame(rows, "i array<string>, w array<double>").select(clusters.hashed_features(F.col("i"), F.col("w"), 8).alias("v"))
    got = [r.v for r in df.collect()]
    assert sorted(map(abs, got[0]))[-2:] in ([1.0, 2.0], [0.0, 3.0]) and sum(map(abs, got[1])) == 1.0 and got[2] == [0.0] * 8 and got[3] is None


def test_settle_refuses_what_has_strangers_near():
    rng = np.random.default_rng(1)
    c = np.eye(32)[0]
    x = clusters._unit(c + 0.1 * rng.normal(size=(20, 32)))
    assert clusters.settle(x, 0.75, 0.70, 5, c.astype(np.float32)) is not None
    angle = np.arccos(0.72)
    near = (np.cos(angle) * c + np.sin(angle) * np.eye(32)[1])[None, :].astype(np.float32)
    stranger = np.concatenate([clusters._unit(c + 0.01 * rng.normal(size=(200, 32))), near])
    assert clusters.settle(stranger, 0.75, 0.70, 5, c.astype(np.float32)) is None


def test_finds_small_clusters_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CELL_ROWS", 64)
    rng = np.random.default_rng(5)
    unit = lambda n: clusters._unit(rng.normal(size=(n, 128)))
    centres = unit(150)
    rows = [(5 * g + k, c + 0.65 * e) for g, c in enumerate(centres) for k, e in enumerate(unit(5))]
    rows += [(10_000 + k, v) for k, v in enumerate(unit(6000))]
    got = members(clusters.similarity_clusters(frame(spark, rows), "id", "v", dim=128))
    assert [g for g in range(150) if got.get(5 * g) != set(range(5 * g, 5 * g + 5))] == []
