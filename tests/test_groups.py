"""Groups of any size: hash links, row numbers, albums, faces that change persons."""

import importlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fotoloom.operators import dedup, hash_links, membership as mb, mutations as mu
from fotoloom.operators.ranking import numbered


def photos(spark, hashes, size=100):
    return spark.createDataFrame([(i, f"/a/{i}.jpg", h, size, "n", None, None) for i, h in enumerate(hashes)], "image_id bigint, file_path string, phash string, file_size bigint, file_name string, latitude double, longitude double")


def test_short_and_equal_hashes_are_no_hot_keys(spark):
    """5,000 short hashes that share all their zeros, and 5,000 equal ones."""
    short = [f"{(i * 0x9E3779B97F4A7C15) & (1 << 64) - 1:016x}" for i in range(1, 5001)]
    p = photos(spark, short + ["f" * 64] * 5000)
    pairs = dedup.hash_pairs(p, 6, expand=False)
    copies = pairs.filter("distance = 0")
    assert copies.count() == 4999 and copies.agg(F.min("id1"), F.max("id1")).first() == (5000, 5000)
    groups = {r.id: r.group_id for r in dedup.hash_groups(p, 6).collect()}
    assert all(groups[i] == 5000 for i in range(5000, 10_000))
    values = {i: int(h, 16) for i, h in enumerate(short)}
    near = {(r.id1, r.id2) for r in pairs.filter("distance > 0").collect()}
    assert all((values[a] ^ values[b]).bit_count() <= 6 for a, b in near)


@pytest.mark.parametrize("forest", [False, True])
def test_hot_bucket_is_divided(spark, monkeypatch, forest):
    monkeypatch.setattr(hash_links, "BUCKET_ROWS", 16)
    rows = [(i, f"{(1 << (i % 200)) | (1 << 255):064x}") for i in range(200)]
    links = {(r.a, r.b) for r in hash_links.near_hash_links(spark.createDataFrame(rows, "i bigint, h string"), "i", "h", 6, forest=forest).collect()}
    if forest:
        assert len(links) < 200 * 100 and {r.group_id for r in dedup.components(spark.createDataFrame(list(links), "a bigint, b bigint"), "a", "b").collect()} == {0}
    else:
        assert links == {(a, b) for a in range(200) for b in range(a + 1, 200)}


def test_parts_do_not_meet(spark):
    p = photos(spark, ["a" * 64, "a" * 64, "b" * 64]).withColumn("file_size", F.when(F.col("image_id") == 1, 7).otherwise(F.col("file_size")))
    assert dedup.size_hash_groups(p).count() == 0 and dedup.hash_groups(p, 0).count() == 2
    assert dedup.hash_groups(p.limit(0), 6).count() == 0 and dedup.hash_pairs(p.limit(0), 6, expand=False).count() == 0


def test_numbers_of_a_large_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    got = numbered(rows, ["k"], [F.desc("v")]).collect()
    for k in (None, "hot"):
        mine = sorted((r.rank, r.v) for r in got if r.k == k)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted((v for _, v in mine), reverse=True)
    assert len(got) == 5000 and numbered(rows.limit(0), [], [F.asc("v")]).count() == 0


def test_face_moves(spark):
    person = spark.createDataFrame([(1, 10), (2, None), (3, 99), (4, 12)], "person_id bigint, cover_face_id bigint")
    faces = spark.createDataFrame([(10, 1, 0.9), (11, 1, 0.5), (12, 4, 0.95), (13, None, None)], "face_id bigint, person_id bigint, det_score double")
    covers = lambda f, p: {r.person_id: r.cover_face_id for r in mu.assign_face(person, faces, f, p)[0].collect()}
    assert covers(10, 2) == {1: 11, 2: 10, 3: 99, 4: 12}  # the old person falls back to the other face
    assert covers(10, 3) == {1: 11, 2: None, 3: 10, 4: 12}  # the cover that was there is no face
    assert covers(10, 4) == {1: 11, 2: None, 3: 99, 4: 12}  # lower score
    assert covers(12, 1) == {1: 12, 2: None, 3: 99, 4: None} and covers(13, 1) == {1: 10, 2: None, 3: 99, 4: 12}
    assert covers(10, 77) == covers(77, 1) == {1: 10, 2: None, 3: 99, 4: 12}
    assert {r.face_id: r.person_id for r in mu.assign_face(person, faces, 10, 2)[1].collect()} == {10: 2, 11: 1, 12: 4, 13: None}


def test_album_covers(spark):
    links = spark.createDataFrame([(1, 5, 1), (1, 6, 3), (1, 7, 3), (2, 5, 1)], "album_id bigint, image_id bigint, added_at int")
    covers = spark.createDataFrame([(1, 5), (2, 5), (3, 8)], "album_id bigint, cover_image_id bigint")
    left, new = mb.removed(spark.createDataFrame([(1, 5), (2, 5), (3, 9), (1, 5)], "album_id bigint, image_id bigint"), links, covers)
    assert left.count() == 2 and {r.album_id: r.cover_image_id for r in new.collect()} == {1: 7, 2: None, 3: 8}
    assert {r.album_id: r.cover_image_id for r in mb.with_cover(1, 6, links, covers).collect()}[1] == 6
    assert {r.album_id: r.cover_image_id for r in mb.with_cover(1, 99, links, covers).collect()}[1] == 5


def test_errors_of_a_subpackage_come_out(monkeypatch):
    real = importlib.import_module

    def broken(name, *a):
        if name.startswith("fotoloom.llm"):
            raise ImportError("regex")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", broken)
    if importlib.util.find_spec("fotoloom.llm"):
        with pytest.raises(ImportError):
            entry.queries()


def test_a_hash_is_no_match_of_its_own():
    """The same id twice under one key gives no link."""
    import numpy as np

    rows = np.zeros((3, 5), np.int64)
    got = hash_links._links(np.array([5, 5, 9]), rows, np.array([1, 1, 1]), 6, True)[["a", "b"]]
    assert {tuple(r) for r in got.to_numpy().tolist()} == {(5, 9)}
