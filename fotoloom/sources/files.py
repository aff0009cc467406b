"""File scans, path lists, reports and change lists as DataFrames, and the matching sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from fotoloom.functions.media import base_name, extension


def scan_files(spark: SparkSession, root: str, formats: Sequence[str] | None = None, content: bool = False) -> DataFrame:
    """(file_path, file_size, modified_at[, content]) of the files below a folder; without ``content`` no bytes are read.

    Files that vanish during the scan are skipped.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    df = df.select(F.regexp_replace("path", "^file:(//)?", "").alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), *(["content"] if content else []))
    return df.filter(extension("file_path").isin([f.lower().lstrip(".") for f in formats])) if formats else df


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """(file_path) of a JSON array of paths, gzipped or not."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("file_path"))


def read_hash_update(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(image_id, phash) and (image_id) of failures, of a JSON object with hashes and failed; unreadable hashes are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "hashes map<string,string>, failed array<bigint>").alias("j"))
    hashes = rows.select(F.explode("j.hashes").alias("k", "phash")).select(F.col("k").try_cast("bigint").alias("image_id"), "phash")
    return hashes.filter(F.col("image_id").isNotNull() & F.col("phash").rlike("^[0-9a-fA-F]{0,64}$")), rows.select(F.explode("j.failed").alias("image_id"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "file_path", compare: Sequence[str] = ("file_size", "modified_at")) -> DataFrame:
    """(key, change) with change added, modified or deleted; comparison treats null as a value."""
    o = old.select(key, *[F.col(c).alias("__o_" + c) for c in compare], F.lit(True).alias("__o"))
    n = new.select(key, *[F.col(c).alias("__n_" + c) for c in compare], F.lit(True).alias("__n"))
    same = F.lit(True)
    for c in compare:
        same = same & F.col("__o_" + c).eqNullSafe(F.col("__n_" + c))
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "deleted").when(~same, "modified")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def resolve_names(names: DataFrame, paths: DataFrame) -> DataFrame:
    """(file_name, file_path): for each wanted name the last path, by order, that ends in it."""
    by_name = paths.select(base_name("file_path").alias("file_name"), "file_path").groupBy("file_name").agg(F.max("file_path").alias("file_path"))
    return names.select("file_name").distinct().join(by_name, "file_name")


def orphans(photos: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(image_id, file_path) of photos whose file is gone."""
    return photos.select("image_id", "file_path").join(on_disk.select("file_path"), "file_path", "left_anti")


def to_index(on_disk: DataFrame, photos: DataFrame) -> DataFrame:
    """Paths without vector and failure so far."""
    done = photos.filter("clip_embedding_siglip is not null or index_failed").select("file_path").distinct()
    return on_disk.select("file_path").join(done, "file_path", "left_anti")


def upload_path(captured: str, created: str, name: str, sha1: str, root: str = "/uploads"):
    """Where an upload goes: by the photo's day, else by its content."""
    day = F.coalesce(F.col(captured), F.col(created))
    dated = F.concat(F.lit(root + "/"), F.date_format(day, "yyyy/MM/dd/"), F.col(name))
    return F.when(day.isNotNull(), dated).otherwise(F.concat(F.lit(root + "/undated/"), F.substring(F.col(sha1), 1, 16), F.lit("."), extension(name)))


def sort_route(path: str, lat: str, lon: str, taken: str):
    """Target folder of a file: junk, then gps by month, then by type, then other."""
    ext = extension(path)
    junk = F.lower(base_name(path)).isin("thumbs.db", "desktop.ini", ".ds_store") | base_name(path).startswith("._")
    gps = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~((F.col(lat) == 0) & (F.col(lon) == 0))
    month = F.coalesce(F.date_format(taken, "yyyy/MM"), F.lit("undated"))
    return F.when(junk, "junk").when(gps, F.concat(F.lit("gps/"), month)).when(ext != "", F.concat(F.lit("type/"), ext)).otherwise("other")


def trash_plan(photos: DataFrame, root: str, trash: str) -> DataFrame:
    """(src, dst) of a move to the trash that keeps the path below ``root``."""
    below = F.regexp_replace("file_path", f"^{root.rstrip('/')}/", "")
    return photos.select(F.col("file_path").alias("src"), F.concat(F.lit(trash.rstrip("/") + "/"), below).alias("dst"))


def write_lines(lines: DataFrame, path: str, order: Sequence[str], line: str = "line") -> None:
    """Write lines in a total order; the files in name order are the text."""
    lines.orderBy(*order).select(line).write.mode("overwrite").text(path)


def write_by_person(crops: DataFrame, path: str) -> None:
    """Face crops, a folder per person."""
    crops.write.mode("overwrite").partitionBy("person_id").parquet(path)



def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(group_no, line_no, action, mb, file_path) of a written report, read whole so that each file line finds the header above it.

    A header is a line of equals signs around words with the group's number before a bracket; lines of
    another form are skipped, file lines before the first header have no group.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r", "").alias("t"))
    parts = text.select(F.posexplode(F.split("t", r"(?m)^(?==== )")).alias("i", "part"))
    lines = parts.select("i", F.regexp_extract("part", r"^=== [^\n]*?(\d+) \(", 1).try_cast("bigint").alias("group_no"), F.posexplode(F.split("part", "\n")).alias("line_no", "line"))
    p = r"^(KEEP|DELETE)\s+\[\s*([0-9.]+) MB\]\s(.*)$"
    get = lambda n: F.regexp_extract("line", p, n)
    return lines.filter(F.col("line").rlike(p)).select("group_no", "line_no", get(1).alias("action"), get(2).cast("double").alias("mb"), get(3).alias("file_path"))


def page_after(df: DataFrame, key: str, after: int | None, limit: int) -> DataFrame:
    """The next rows by key after the last one seen."""
    return (df if after is None else df.filter(F.col(key) > after)).orderBy(key).limit(limit)


def changed_or_unindexed(changed: DataFrame, on_disk: DataFrame, photos: DataFrame) -> DataFrame:
    """(file_path), each once: what a journal reports as added or modified, and what is on disk but not indexed."""
    return changed.filter("change <> 'deleted'").select("file_path").union(to_index(on_disk, photos)).distinct()


def trash_report(plan: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(src, line) of a move to the trash: where each file goes, or that it is not there."""
    there = on_disk.select(F.col("file_path").alias("src")).distinct().withColumn("__t", F.lit(True))
    line = F.when(F.col("__t"), F.concat(F.lit("MOVED "), "src", F.lit(" -> "), "dst")).otherwise(F.concat(F.lit("MISSING "), "src"))
    return plan.join(there, "src", "left").select("src", line.alias("line"))


def person_crops(faces: DataFrame, photos: DataFrame, person_id: int | None = None, pad: float = 0.2) -> DataFrame:
    """(person_id, face_id, file_path, l, t, r, b): what to cut out of which file for an export by person; ``write_by_person`` writes the cut pictures."""
    from fotoloom.functions.media import crop_box

    rows = faces.filter("person_id is not null" if person_id is None else F.col("person_id") == person_id)
    rows = rows.join(photos.filter("width is not null and height is not null").select("image_id", "file_path", "width", "height"), "image_id")
    box = crop_box(*[F.col(f"bbox_{x}").cast("double") for x in ("x1", "y1", "x2", "y2")], F.col("width"), F.col("height"), pad)
    return rows.select("person_id", "face_id", "file_path", box.alias("x")).select("person_id", "face_id", "file_path", F.col("x.left").alias("l"), F.col("x.top").alias("t"), F.col("x.right").alias("r"), F.col("x.bottom").alias("b"))
