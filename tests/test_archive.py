"""Every query against its SQL twin on the smallest tables, and operators against plain Python."""

import glob
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from fotoloom.operators import dedup, people, search
from fotoloom.plans import archive, problems, workflows

NAMES = [n for m in (archive, workflows, problems) for n in m.queries()]


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    c = duck.execute(sql)
    cols = [x[0] for x in c.description]
    want = [tuple(plain(r[cols.index(x)]) for x in sorted(cols)) for r in c.fetchall()]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).columns == ["image_id", "similarity"]


def test_components_are_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.group_id for r in dedup.components(spark.createDataFrame(pairs, "id1 bigint, id2 bigint")).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("most", [0, 3, 8])
def test_hash_pairs_are_brute_force(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(256) for _ in range(6)]
    values = [(i, b ^ sum(1 << rng.randrange(256) for _ in range(rng.randrange(6)))) for i, b in enumerate(base * 8)]
    rows = [(i, f"/a/{i}.jpg", f"{v & (2**256 - 1):064x}") for i, v in values] + [(900, "/a/x.jpg", None), (901, "/a/y.jpg", ""), (902, "/a/z.jpg", "zz")]
    got = {(r.id1, r.id2): r.distance for r in dedup.hash_pairs(spark.createDataFrame(rows, "image_id bigint, file_path string, phash string"), most).collect()}
    ints = {i: v & (2**256 - 1) for i, v in values}
    want = {(i, j): (ints[i] ^ ints[j]).bit_count() for i in ints for j in ints if i < j and (ints[i] ^ ints[j]).bit_count() <= most}
    assert got == want


def test_rank_fusion(spark):
    rng = random.Random(5)
    rows = [(m, i, round(rng.uniform(0, 0.5), 3)) for m in ("SigLIP", "ViT-L/14", "other") for i in range(40)]
    got = {r.image_id: (round(r.rrf, 9), r.votes) for r in search.fuse_ranks(spark.createDataFrame(rows, "model string, image_id bigint, similarity double"), top=20).collect()}
    score, votes = {}, {}
    for m, least in (("SigLIP", 0.06), ("ViT-L/14", 0.15), ("other", 0.10)):
        best = sorted([(-s, i) for x, i, s in rows if x == m and s >= 0.01])[:20]
        best = [(-s, i) for s, i in best if -s >= least]
        best = [(s, i) for s, i in best if s >= best[0][0] * 0.65]
        for n, (_, i) in enumerate(best, 1):
            score[i] = score.get(i, 0) + 1 / (60 + n)
            votes[i] = votes.get(i, 0) + 1
    top = max(score.values())
    assert got == {i: (round(s, 9), votes[i]) for i, s in score.items() if s >= 0.35 * top}


def test_plan_pushes_filters_down(spark, data):
    df = archive.queries()["recent_window"](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "clip_embedding" not in plan


def test_registered_queries_have_sql():
    missing = {*archive.queries(), *workflows.queries()} - {*archive.oracle_sql(), *workflows.oracle_sql()}
    assert not missing


def test_centroids_of_all_persons(spark, monkeypatch):
    monkeypatch.setattr(people, "CENTRE_ROWS", 2)
    axis = lambda *i: [1.0 if k in i else 0.0 for k in range(8)]
    rows = [(p, p, axis(p)) for p in range(1, 6)] + [(100 + p, None, axis(p)) for p in range(1, 6)]
    rows += [(200, None, axis(2, 5)), (201, None, axis(6)), (202, None, axis()), (203, None, None), (204, None, [1.0])]
    faces = spark.createDataFrame(rows, "face_id bigint, person_id bigint, face_embedding array<float>")
    got = {r.face_id: r.person_id for r in people.assign_by_centroid(faces, dim=8).collect()}
    assert got == {101: 1, 102: 2, 103: 3, 104: 4, 105: 5, 200: 2}


def test_albums_of_all_orders(spark, data):
    free = spark.read.parquet(f"{data}/orders.parquet").filter("1 + o_custkey % 200 = 5 or o_orderstatus = 'F'")
    assert entry.queries()["album_list"](spark, data).count() == free.count()
