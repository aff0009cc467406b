"""Counts over the archive: one pass of conditional aggregates each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fotoloom.functions import media, predicates as pr

_PERCENT = 1


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0)), _PERCENT), F.lit(0.0))


def _mean(degrees: str) -> Column:
    """Mean to six decimals, summed in millionths so that the order of the rows cannot show."""
    total = F.sum(F.round(F.col(degrees) * 1e6).cast("bigint"))
    return F.floor(total / F.count("*") + 0.5) / 1e6


def archive_stats(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """Photos, with vector, with hash, failed, and faces, as one row."""
    a = photos.agg(
        F.count("*").alias("photos"), F.count("clip_embedding_siglip").alias("with_vector"),
        F.count_if(F.length("phash") > 0).alias("with_hash"), F.count_if("index_failed").alias("failed"),
        F.count_if(pr.pending()).alias("pending"),
    )
    return a.crossJoin(faces.agg(F.count("*").alias("faces")))


def model_coverage(vectors: DataFrame) -> DataFrame:
    """(model, photos) of a long table (image_id, model, embedding): only models with vectors, most covered first."""
    n = vectors.filter("embedding is not null").groupBy("model").agg(F.count("*").alias("photos"))
    return n.orderBy(F.desc("photos"), "model")


def map_stats(photos: DataFrame) -> DataFrame:
    """Photos with position (0 counts) and date, their percentages, first and last day, and bounds."""
    gps = pr.has_gps()
    at = lambda f, c: f(F.when(gps, F.col(c)))
    total = F.count("*")
    return photos.agg(
        total.alias("total"), F.count_if(gps).alias("with_gps"), F.count("photo_date").alias("with_date"),
        _percent(F.count_if(gps), total).alias("gps_percent"), _percent(F.count("photo_date"), total).alias("date_percent"),
        F.min("photo_date").cast("date").alias("first_day"), F.max("photo_date").cast("date").alias("last_day"),
        at(F.min, "latitude").alias("min_lat"), at(F.max, "latitude").alias("max_lat"), at(F.min, "longitude").alias("min_lon"), at(F.max, "longitude").alias("max_lon"),
    )


def position_stats(photos: DataFrame) -> DataFrame:
    """Photos with and without position, where 0 is none."""
    none = pr.no_gps()
    return photos.agg(F.count("*").alias("total"), F.count_if(~none).alias("with_gps"), F.count_if(none).alias("without_gps"), F.count_if(pr.zero_gps()).alias("zero_gps"))


def hash_progress(photos: DataFrame) -> DataFrame:
    """An empty hash stands for a failed attempt: neither done nor pending."""
    h = F.col("phash")
    return photos.agg(F.count("*").alias("total"), F.count_if(h.isNotNull() & (h != "")).alias("done"), F.count_if(h.isNull()).alias("pending"), F.count_if(h == "").alias("failed"))


def index_progress(photos: DataFrame) -> DataFrame:
    done, total = F.count("clip_embedding_siglip"), F.count("*")
    return photos.agg(total.alias("total"), done.alias("indexed"), F.count_if(pr.pending()).alias("pending"), _percent(done, total).alias("percent"))


def face_stats(faces: DataFrame) -> DataFrame:
    total, known = F.count("*"), F.count("person_id")
    return faces.agg(
        total.alias("total"), known.alias("assigned"), (total - known).alias("unassigned"), F.countDistinct("person_id").alias("persons"),
        F.countDistinct("image_id").alias("photos"), _percent(known, total).alias("percent"),
    )


def exif_fill(photos: DataFrame) -> DataFrame:
    """Shares of photos with EXIF text, position and date."""
    total = F.count("*")
    return photos.agg(
        total.alias("total"), _percent(F.count("exif_data"), total).alias("exif_percent"), _percent(F.count_if(pr.has_gps()), total).alias("gps_percent"),
        _percent(F.count("photo_date"), total).alias("date_percent"),
    )


def failed_files(photos: DataFrame, limit: int = 100) -> DataFrame:
    """Failed photos by id with their reason and the count of all of them."""
    n = photos.filter("index_failed").agg(F.count("*").alias("total_failed"))
    rows = photos.filter("index_failed").select("image_id", "file_path", "fail_reason").orderBy("image_id").limit(limit)
    return rows.crossJoin(F.broadcast(n))


def grid_clusters(photos: DataFrame, zoom: int, preview_k: int = 1) -> DataFrame:
    """Photos with position by grid cell: count, mean position, cell bounds and the ids of the first ``preview_k`` photos."""
    g = media.grid_size(zoom)
    rows = photos.filter(pr.has_gps()).select("image_id", "latitude", "longitude", media.cell("latitude", g).alias("cell_y"), media.cell("longitude", g).alias("cell_x"))
    n = rows.groupBy("cell_y", "cell_x").agg(
        F.count("*").alias("photos"), _mean("latitude").alias("lat"), _mean("longitude").alias("lon"), F.min("image_id").alias("preview_id")
    )
    y, x = F.col("cell_y"), F.col("cell_x")
    n = n.select(
        "cell_y", "cell_x", "photos", "lat", "lon", "preview_id",
        F.round(y * g, 6).alias("min_lat"), F.round((y + 1) * g, 6).alias("max_lat"), F.round(x * g, 6).alias("min_lon"), F.round((x + 1) * g, 6).alias("max_lon"),
    )
    if preview_k == 1:
        return n
    w = Window.partitionBy("cell_y", "cell_x").orderBy("image_id")
    first = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= preview_k)
    lists = first.groupBy("cell_y", "cell_x").agg(F.array_sort(F.collect_list("image_id")).alias("preview_ids"))
    return n.drop("preview_id").join(lists, ["cell_y", "cell_x"])


def folder_counts(photos: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """(folder, photos) of photos without position, by path."""
    rows = photos.filter(pr.no_gps() & pr.in_formats("file_format", formats or [], "like"))
    return rows.groupBy(media.dir_name("file_path").alias("folder")).agg(F.count("*").alias("photos")).orderBy("folder")


def timeline(photos: DataFrame) -> DataFrame:
    """(month, photos) of dated photos."""
    return photos.filter("photo_date is not null").groupBy(F.date_format("photo_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("photos"))


def summary(photos: DataFrame, faces: DataFrame, tag: DataFrame, photo_tag: DataFrame, models: dict[str, str]) -> DataFrame:
    """(what, n): photos, those with a vector per model and of any, pending, faces, hashes, failures, and links per system tag (0 included)."""
    any_ = F.lit(False)
    for c in models.values():
        any_ = any_ | F.col(c).isNotNull()
    counts = {"photos": F.count("*"), "indexed": F.count_if(any_), "pending": F.count_if(~any_), "hashes": F.count_if(F.length("phash") > 0), "failed": F.count_if("index_failed")}
    counts |= {f"model {m}": F.count(c) for m, c in models.items()}
    row = photos.agg(*[n.alias(k) for k, n in counts.items()])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(f"`{k}`").alias("n")) for k in counts])).alias("x")).select("x.*")
    links = photo_tag.groupBy("tag_id").agg(F.count("image_id").alias("n"))
    tags = tag.filter("is_system").join(links, "tag_id", "left").select(F.concat(F.lit("tag "), "name").alias("what"), F.coalesce("n", F.lit(0)).alias("n"))
    return long.unionByName(faces.agg(F.count("*").alias("n")).select(F.lit("faces").alias("what"), "n")).unionByName(tags)


def scan_total(scan: DataFrame, size: str = "file_size") -> DataFrame:
    """Files of a scan and their bytes, as one row."""
    return scan.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))
