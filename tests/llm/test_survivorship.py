import datetime as dt

from pyspark.sql import functions as F

from fotoloom.llm import survivorship as sv

SCHEMA = "g bigint, i bigint, w int, s bigint, f string, exif string, t timestamp_ntz, field string, value string, __r string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def test_best_record(spark):
    rows = [(1, 1, 10, 5, "jpg", None, None), (1, 2, 10, 7, "jpg", None, None), (1, 3, None, 99, "nef", None, None), (2, 9, 4, 4, None, None, None), (2, 8, 4, 4, None, None, None),
            (2, 8, 4, 4, None, None, None), (None, 1, 9, 9, None, None, None), (3, None, 9, 9, None, None, None), (4, 5, None, None, None, None, None)]
    got = sv.best_record(frame(spark, rows), "g", "i", {"w": F.col("w"), "s": F.col("s")})
    assert {r.g: r.i for r in got.collect()} == {1: 2, 2: 8, 4: 5}
    assert got.columns == ["g", "i"]
    assert sv.best_record(frame(spark, rows).limit(0), "g", "i", {"w": F.col("w")}).count() == 0


def test_exif_entries(spark):
    texts = {
        '{"a": "1", "b": null, "c": "  ", "d": "N/A", "e": 5, "f": {"x": 1}, "g": "0000:00:00 00:00:00", "h": "\\u0000\\u0000", "i": "?"}': 3,
        '"{\\"a\\": \\"1\\", \\"b\\": \\"Unknown\\"}"': 1, "{}": 0, "null": 0, "": 0, "   ": 0, '{"a": "1"': 0, "[1, 2]": 0, "5": 0, '"x"': 0, None: 0,
        '{"k": "' + "long " * 50_000 + '"}': 1,
    }
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "t string, n int").select("t", "n", sv.n_speaking_entries(F.col("t")).alias("got"))
    assert [(r.t, r.got) for r in df.collect() if r.got != r.n] == []


def test_formats(spark):
    rows = spark.createDataFrame([(" .NEF",), ("heif",), ("JPEG ",), (".png",), ("gif",), (None,), ("",)], "f string")
    assert [r[0] for r in rows.select(sv.format_rank("f")).collect()] == [4, 3, 2, 1, 0, 0, 0]
    assert [r[0] for r in rows.select(sv.format_kind("f")).collect()] == ["raw", "heic", "jpg", "png", "other", "other", "other"]


def test_fuse_against_plain_python(spark):
    day = lambda n: dt.datetime(2024, 1, 1) - dt.timedelta(days=n)
    rows = [(1, 1, 10, None, "jpg", None, day(0)), (1, 2, 20, None, "jpg", None, day(0)), (1, 3, 20, None, None, None, day(0)), (1, 4, 10, None, "nef", None, day(3000)),
            (2, 5, None, None, None, None, day(1)), (3, 6, 7, None, "b", None, day(0)), (3, 7, 8, None, "a", None, day(0)), (3, 8, 8, None, "a", None, None), (None, 9, 1, None, None, None, day(0))]
    age = F.datediff(F.lit("2024-01-01").cast("date"), F.col("t"))
    got = sv.fuse(frame(spark, rows), "g", {"w": F.col("w"), "f": F.col("f")}, F.when(F.col("f") == "nef", 1.0).otherwise(0.5), age, 365.0).collect()
    assert {r.g: (r.w, r.f) for r in got} == {1: ("20", "jpg"), 2: (None, None), 3: ("8", "a")}
    assert sv.fuse(frame(spark, rows).limit(0), "g", {"w": F.col("w")}, F.lit(1.0), age, 365.0).count() == 0
