import json

import numpy as np
import pytest

from fotoloom.operators import dedup, search, vector_pairs
from fotoloom.plans import actions
from fotoloom.sources import media


@pytest.mark.parametrize(("broken", "kinds"), [
    ('{"actions": [{"type": "set_formats", "formats": ["jpg"]}, {"type": "drop_table"}], "message": "x"}', ["set_formats"]),
    ('{"actions": [{"type": "set_formats", "formats": ["jpg"]}, {"type": "text_search", "query": "a } \\" lake', ["set_formats", "text_search"]),
    ('{"actions": [{"type": "clear_filters"},', ["clear_filters"]), ("no json", []), ("", []), (None, []), ("[1]", []),
])
def test_actions(broken, kinds):
    assert [a["type"] for a in actions.parse_actions(broken)] == kinds


def test_spec_of():
    got, text = actions.spec_of(actions.parse_actions(json.dumps({"actions": [
        {"type": "text_search", "query": "lake"}, {"type": "set_persons", "person_ids": [1, 2], "mode": "and"}, {"type": "set_bounds", "min_lat": 1, "max_lat": 2, "min_lon": 3, "max_lon": 4},
        {"type": "set_date_range", "date_from": "2020-01-01"}]})))
    assert text == "lake" and got.persons == [1, 2] and got.person_mode == "and" and got.box == (1, 2, 3, 4) and got.date_from == "2020-01-01"
    assert actions.recentred((0, 2, 10, 14), 50, 8) == (49, 51, 6, 10)


def test_perceptual_hash_is_stable(spark):
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:200, 0:300]
    picture = np.sin(x / 40) + np.cos(y / 25) + np.sin((x + y) / 60)
    h = [int(media.perceptual_hash(p), 16) for p in (picture, picture * 3 + 5, picture[::2, ::2], picture + rng.normal(scale=0.01, size=picture.shape), rng.normal(size=(64, 64)))]
    assert (h[0] ^ h[1]).bit_count() == 0 and (h[0] ^ h[2]).bit_count() <= 40 and (h[0] ^ h[3]).bit_count() <= 60 and (h[0] ^ h[4]).bit_count() > 80
    files = spark.createDataFrame([("/a", bytearray(b"\x01" * 64)), ("/b", bytearray(b"bad")), ("/c", None)], "file_path string, content binary")
    decode = lambda raw: np.frombuffer(raw, np.uint8).reshape(8, 8) + np.arange(8)
    got = {r.file_path: r.phash for r in media.add_hashes(files, decode).collect()}
    assert len(got["/a"]) == 64 and got["/b"] == "" and got["/c"] == ""


def test_readers_and_encoders(spark):
    files = spark.createDataFrame([("/a", bytearray(b"x")), ("/b", None)], "file_path string, content binary")
    readers = [lambda raw: 1 / 0, lambda raw: {}, lambda raw: {"Make": "M", "ISO": 5}]
    got = {r.file_path: r.exif_data for r in media.add_exif(files, readers).collect()}
    assert json.loads(got["/a"]) == {"Make": "M", "ISO": "5"} and got["/b"] is None
    rows = media.encode(files, "file_path", "content", lambda values: np.array([[len(v), 1.0] for v in values])).collect()
    assert [(r.file_path, r.embedding) for r in rows] == [("/a", [1.0, 1.0])]
    faces = media.detect_faces(files, lambda raw: [{"box": [0, 0, 1, 1], "det_score": s, "embedding": [1.0]} for s in (0.3, 0.9)]).collect()
    assert len(faces) == 1 and abs(faces[0].det_score - 0.9) < 1e-6


def test_vector_pairs(spark):
    one = np.random.default_rng(1).normal(size=16)
    rows = [(i, one.tolist()) for i in range(30)] + [(100, (one * 2).tolist()), (200, None), (201, [0.0] * 16), (202, [1.0]), (None, one.tolist())]
    got = {(r.id1, r.id2) for r in vector_pairs.similar_pairs(spark.createDataFrame(rows, "i bigint, v array<double>"), "i", "v", 0.98, 3, dim=16).collect()}
    assert {(0, 1), (0, 2), (1, 2), (0, 29), (1, 29), (2, 29)} <= got and (28, 29) not in got
    assert all(x in {q for p in got for q in p} for x in [*range(30), 100])


def test_selectors(spark):
    assert dedup.picked_groups("1 3-5 x 8-") == [(1, 1), (3, 5)]
    report = spark.createDataFrame([(1, "KEEP", "/a/x.jpg"), (1, "DELETE", "/b/y.jpg"), (2, "KEEP", "/c/z.jpg")], "group_id bigint, action string, file_path string")
    assert sorted(r.dst for r in dedup.copy_plan(report, "1", "/t").collect()) == ["/t/1/01_KEEP_x.jpg", "/t/1/02_DELETE_y.jpg"]


def test_similar_to_modes(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "i bigint, v array<double>")
    assert [r.i for r in search.similar_to(df, "i", "v", 1, 2).collect()] == [2]
    assert [r.i for r in search.similar_to(df, "i", "v", 1, 1, drop_self="after").collect()] == []
    assert search.similar_to(df, "i", "v", 9, 2).count() == 0 and search.similar_to(df, "i", "v", 4, 2).count() == 0
