import gzip
import json

from pyspark.sql import functions as F

from fotoloom.functions import media
from fotoloom.operators import mutations as mu
from fotoloom.sources import files
from fotoloom.streaming import changes

LOG = [("a", 1, "CREATE"), ("a", 2, "MODIFY"), ("b", 3, "MODIFY"), ("c", 4, "CREATE"), ("c", 5, "DELETE"), ("d", 6, "DELETE"), ("d", 7, "CREATE"), ("e", 8, "DELETE"), ("e", 9, "MODIFY"), ("b", 10, "MODIFY")]
WANT = {"a": ("added", 2), "b": ("modified", 10), "c": ("deleted", 5), "d": ("added", 7), "e": ("modified", 9)}


def test_batch_fold(spark):
    df = spark.createDataFrame(LOG[::-1] + [(None, 1, "CREATE"), ("a", None, "DELETE")], "file_key string, usn bigint, reason string")
    assert {r.file_key: (r.change, r.last_usn) for r in changes.fold_changes(df).collect()} == WANT
    assert {r.file_key for r in changes.fold_changes(df, after=7).collect()} == {"e", "b"}


def test_stream_equals_batch(spark, tmp_path):
    src, n = tmp_path / "log", 0
    src.mkdir()
    for part in (LOG[:4], LOG[4:7], LOG[7:]):
        n += 1
        (src / f"{n}.json").write_text("".join(json.dumps({"file_key": k, "usn": u, "reason": r, "file_name": k}) + "\n" for k, u, r in part))
    stream = changes.stream_changes(changes.read_change_log(spark, str(src), 1))
    q = stream.writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("folded").groupBy("file_key").agg(F.max_by(F.struct("change", "last_usn"), "last_usn").alias("x")).select("file_key", "x.*")
    assert {r.file_key: (r.change, r.last_usn) for r in last.collect()} == WANT


def test_index_batches_resume(spark, tmp_path):
    src, done = tmp_path / "in", str(tmp_path / "done")
    src.mkdir()
    (src / "1.json").write_text('{"file_path": "/a"}\n{"file_path": "/b"}\n')
    stream = lambda: spark.readStream.schema("file_path string").json(str(src))
    for cp in ("cp1", "cp2"):  # a second run over the same input adds nothing
        q = changes.index_batches(stream(), lambda df: df.withColumn("ok", F.lit(True)), done, str(tmp_path / cp)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(done).count() == 2


def test_sessions_and_high_water(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "user_id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.user_id, r.touches) for r in changes.sessions(df).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert {r.user_id: str(r.last_sync) for r in changes.high_water(df).collect()}[1] == "2024-01-01 02:00:00"


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.JPG").write_bytes(b"abc")
    (tmp_path / "d" / "y.txt").write_bytes(b"")
    got = files.scan_files(spark, str(tmp_path / "d"), ["jpg"]).collect()
    assert [(r.file_path.endswith("d/x.JPG"), r.file_size) for r in got] == [(True, 3)]
    with gzip.open(tmp_path / "list.json.gz", "wt") as f:
        json.dump(["/a", "/b"], f)
    assert [r.file_path for r in files.read_path_list(spark, str(tmp_path / "list.json.gz")).collect()] == ["/a", "/b"]
    (tmp_path / "h.json").write_text('{"hashes": {"1": "ff", "2": "xyz", "q": "00"}, "failed": [7]}')
    hashes, failed = files.read_hash_update(spark, str(tmp_path / "h.json"))
    assert [tuple(r) for r in hashes.collect()] == [(1, "ff")] and [r.image_id for r in failed.collect()] == [7]
    old = spark.createDataFrame([("/a", 1, None), ("/b", 2, None), ("/c", 3, None)], "file_path string, file_size int, modified_at int")
    new = spark.createDataFrame([("/a", 1, None), ("/b", 2, 5), ("/d", 3, None)], "file_path string, file_size int, modified_at int")
    assert {r.file_path: r.change for r in files.snapshot_diff(old, new).collect()} == {"/b": "modified", "/c": "deleted", "/d": "added"}
    files.write_lines(spark.createDataFrame([(2, "b"), (1, "a")], "n int, line string"), str(tmp_path / "out"), ["n"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b"]


def test_mutations(spark):
    p = "image_id bigint, file_path string, width int, height int, exif_data string, phash string, index_failed boolean, fail_reason string, clip_embedding_siglip array<float>, latitude double, photo_date timestamp_ntz"
    photos = spark.createDataFrame([(1, "/a", 40, 30, None, None, True, "x", None, None, None), (2, "/b", 4, 3, '{"UserRotation": 270}', "aa", False, None, None, 1.0, None)], p)
    new = spark.createDataFrame([("/a", [1.0], None, '{"Make": "M"}'), ("/b", None, "bad", None)], "file_path string, clip_embedding_siglip array<float>, fail_reason string, exif_data string")
    got = {r.image_id: r for r in mu.index_result(photos, new).collect()}
    assert (got[1].index_failed, got[1].fail_reason, got[1].exif_data) == (False, None, '{"Make": "M"}')
    assert (got[2].index_failed, got[2].fail_reason) == (True, "bad")
    faces = spark.createDataFrame([(5, 1, 10.0, 5.0, 20.0, 15.0)], "face_id bigint, image_id bigint, bbox_x1 float, bbox_y1 float, bbox_x2 float, bbox_y2 float")
    turned, boxes = mu.rotate_photo(photos, faces, 1, 90)
    r = turned.filter("image_id = 1").first()
    assert (r.width, r.height, json.loads(r.exif_data)) == (30, 40, {"UserRotation": "90"})
    b = boxes.first()
    assert (b.bbox_x1, b.bbox_y1, b.bbox_x2, b.bbox_y2) == (15.0, 10.0, 25.0, 20.0)
    up = mu.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int"), spark.createDataFrame([(2, None, 9), (3, "c", 3), (3, "d", 4)], "k int, s string, n int"), "k", "n")
    assert sorted(map(tuple, up.collect())) == [(1, "a", 1), (2, "b", 9), (3, "d", 4)]
    h = mu.update_hashes(photos, spark.createDataFrame([(1, "ff"), (2, "??")], "image_id bigint, phash string"), spark.createDataFrame([(2,)], "image_id bigint"))
    assert {r.image_id: r.phash for r in h.collect()} == {1: "ff", 2: ""}


def test_positions_in_text(spark):
    texts = ["48.5, 9.25", "48°30'0\"N 9°15'0\"E", "https://maps.example/@-33.5,151.25,15z", "nowhere", "99, 9", None]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(media.parse_position(F.col("t")).alias("p")).collect()]
    assert [None if g is None else tuple(g) for g in got] == [(48.5, 9.25), (48.5, 9.25), (-33.5, 151.25), None, None, None]


def test_media_functions(spark):
    one = spark.range(1)
    c = F.lit

    def value(col):
        return one.select(col.alias("x")).first().x

    assert tuple(value(media.rotated_box(*[c(v) for v in (1.0, 2.0, 3.0, 5.0, 10.0, 20.0)], 270))) == (2.0, 7.0, 5.0, 9.0)
    assert tuple(value(media.fit_inside(c(400), c(100), 200))) == (200, 50) and tuple(value(media.fit_inside(c(40), c(10), 200))) == (40, 10)
    assert value(media.rotate(c(270), c(180))) == 90
    assert str(value(media.iso_timestamp(c("2024-05-06T07:08:09+03:00")))) == "2024-05-06 07:08:09" and value(media.iso_timestamp(c("soon"))) is None
    assert str(value(media.exif_date(c('{"DateTime": "2001/02/03 04:05:06", "DateTimeOriginal": "0000:00:00 00:00:00"}')))) == "2001-02-03 04:05:06"
    assert value(media.mapped_path(c("d:\\Photos\\a.jpg"), "D:/photos/", "/srv")) == "/srv/a.jpg" and value(media.mapped_path(c("/x/a.jpg"), "/photos", "/srv")) == "/x/a.jpg"
    assert value(media.video_kind(c(bytearray(b"\0\0\0\x14ftypqt  ")))) == "mov" and value(media.video_kind(c(bytearray(b"\0\0\0\x14ftypmp42")))) == "mp4" and value(media.video_kind(c(bytearray(b"abcdefghijkl")))) is None
    assert value(media.tag_name(c("  Old Mill "))) == "old mill" and value(media.tag_name(c("  "))) is None
    assert value(media.approximate_date(c("1950-01-01").cast("date"))) and not value(media.approximate_date(c("2001-01-01").cast("date")))
    assert value(media.clean_exif_value(c("\0 a\tb \x07"), 2)) == "ab" and value(media.clean_exif_value(c("\0"))) is None
    assert value(media.dms_to_decimal(c(33), c(30), c(0.0), c("s"))) == -33.5
    assert value(media.content_key(c("x"), 8)) == "11f6ad8e"
    assert media.grid_size(0) == 30.0 and media.grid_size(99) == 0.001


def test_report_file(spark, tmp_path):
    (tmp_path / "r.txt").write_text("Duplicates\n\n=== Group 1 (2 files) ===\nKEEP   [  1.5 MB] /a/b c.jpg\nDELETE [ 10.0 MB] /a/d.jpg\n\n=== Group 2 (1 files) ===\r\nKEEP   [  0.0 MB] /e.jpg\n")
    got = [(r.group_no, r.action, r.mb, r.file_path) for r in files.read_report(spark, str(tmp_path / "r.txt")).orderBy("group_no", "line_no").collect()]
    assert got == [(1, "KEEP", 1.5, "/a/b c.jpg"), (1, "DELETE", 10.0, "/a/d.jpg"), (2, "KEEP", 0.0, "/e.jpg")]


def test_paths_and_routes(spark):
    rows = [("a.jpg", 1.0, 2.0, "2020-05-01 00:00:00", "ff" * 20), ("b.png", None, None, None, "ee" * 20), ("Thumbs.db", 1.0, 1.0, None, ""), ("noext", 0.0, 0.0, None, "")]
    df = spark.createDataFrame(rows, "n string, lat double, lon double, taken string, sha string").withColumn("taken", F.col("taken").cast("timestamp_ntz"))
    assert [r.x for r in df.select(files.sort_route("n", "lat", "lon", "taken").alias("x")).collect()] == ["gps/2020/05", "type/png", "junk", "other"]
    up = [r.x for r in df.limit(2).select(files.upload_path("taken", "taken", "n", "sha").alias("x")).collect()]
    assert up == ["/uploads/2020/05/01/a.jpg", "/uploads/undated/" + "ee" * 8 + ".png"]


def test_delete_persons(spark):
    person = spark.createDataFrame([(1,), (2,)], "person_id bigint")
    faces = spark.createDataFrame([(5, 1), (6, 2), (7, None)], "face_id bigint, person_id bigint")
    rel = spark.createDataFrame([(1, 2), (2, None)], "person_id_from bigint, person_id_to bigint")
    p, f, r = mu.delete_persons(person, faces, rel, [1])
    assert [x.person_id for x in p.collect()] == [2] and {x.face_id: x.person_id for x in f.collect()} == {5: None, 6: 2, 7: None} and r.count() == 1
