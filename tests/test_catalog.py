from pyspark.sql import functions as F

from fotoloom.functions import media
from fotoloom.sources import files
from fotoloom.streaming import changes


def test_clean_exif(spark):
    tags = {"EXIF Make": " Nikon\x00 ", "Image Model": "", "Thumbnail Size": "x", "EXIF MakerNote 1": "y", "GPS Alt": "3", "Plain": "z" * 257}
    row = spark.createDataFrame([(tags,)], "t map<string,string>").select(media.clean_exif(F.col("t")).alias("t")).first()
    assert row.t == {"Make": "Nikon", "Alt": "3"}


def test_journal_that_wrapped_over(spark):
    log = spark.createDataFrame([("a", 50, "MODIFY"), ("b", 51, "CREATE")], "file_key string, usn bigint, reason string")
    old, new = (spark.createDataFrame(r, "file_key string, size int") for r in ([("a", 1), ("c", 1)], [("a", 2), ("b", 1)]))
    got, at = changes.changes_since(log, 49, old, new)
    assert {(r.file_key, r.change) for r in got.collect()} == {("a", "modified"), ("b", "added")} and at == 51
    got, at = changes.changes_since(log, 10, old, new)  # records 11 to 49 are gone
    assert {(r.file_key, r.change) for r in got.collect()} == {("a", "modified"), ("b", "added"), ("c", "deleted")} and at is None
    assert changes.changes_since(log.limit(0), 10, old, new)[1] == 10


def test_pages(spark):
    df = spark.range(10)
    assert [r.id for r in files.page_after(df, "id", 3, 2).collect()] == [4, 5] and [r.id for r in files.page_after(df, "id", None, 1).collect()] == [0]


def test_plugins(spark):
    from fotoloom.sources import plugins

    df = spark.createDataFrame([(1, "48.5, 9.25"), (2, "Rome"), (3, "nowhere"), (4, None)], "id bigint, t string")
    got = {r.id: (r.latitude, r.longitude) for r in plugins.located(df, "id", "t", lambda name: (41.9, 12.5) if name == "Rome" else None).collect()}
    assert got == {1: (48.5, 9.25), 2: (41.9, 12.5), 3: (None, None), 4: (None, None)}
    assert {r.id: r.t for r in plugins.translated(df, "id", "t", lambda texts: [x.upper() for x in texts]).collect()} == {1: "48.5, 9.25", 2: "ROME", 3: "NOWHERE", 4: None}


def test_task_queue(spark):
    seen = changes.index_all(spark, spark.range(5), {"vectors": lambda df: df, "hashes": lambda df: df.filter("id > 2")})
    assert seen == {"vectors": 5, "hashes": 2}


def test_exif_object(spark):
    rows = [('{"A": 1}',), ('"{\\"A\\": 1}"',), ('[1]',), ('"text"',), ("",), (None,), ('{"A": ',)]
    got = [r.x for r in spark.createDataFrame(rows, "e string").select(media.exif_object("e").alias("x")).collect()]
    assert got == ['{"A": 1}', '{"A": 1}', None, None, None, None, None]


def test_similar_to_each(spark):
    from fotoloom.operators import search

    rows = [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [1.0, 1.0], "x"), (3, [1.0, 1.0], "x"), (4, [0.0, 0.0], "x"), (5, None, "x"), (6, [1.0], "x"), (None, [1.0, 0.0], "x"), (7, [float("nan"), 1.0], "x"), (8, [4.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "i bigint, v array<double>, slice string")
    got = search.similar_to_each(df, "i", "v", df.filter("i in (1, 4, 7)"), 2, 0.1, dim=2)
    assert sorted((r.query_id, r.id) for r in got.collect()) == [(1, 2), (1, 8)]  # ties go to the smaller id
    assert search.similar_to_each(df, "i", "v", df.limit(0), 2, dim=2).count() == 0
