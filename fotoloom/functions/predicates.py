"""Composable filters of photo searches. Each takes a DataFrame, or is a boolean Column, and adds one restriction."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

#: Formats that searches know, fixed values.
KNOWN_FORMATS = ["jpg", "jpeg", "heic", "heif", "png", "nef", "cr2", "arw", "dng", "raf", "orf", "rw2", "webp", "bmp", "tiff", "tif"]
RAW_FORMATS = ["nef", "cr2", "arw", "dng", "raf", "orf", "rw2"]


def _day(text: str | None) -> date | None:
    try:
        return date.fromisoformat(text.strip()) if text else None
    except ValueError:
        return None


def in_dates(col: str, first: str | None = None, last: str | None = None, mode: str = "next_day") -> Column:
    """first <= col < last + 1 day; an unreadable bound is no bound. Mode inclusive_second ends at 23:59:59 instead."""
    out, a, b = F.lit(True), _day(first), _day(last)
    c = F.col(col)
    if a:
        out = out & (c >= F.lit(f"{a} 00:00:00").cast("timestamp_ntz"))
    if b and mode == "inclusive_second":
        out = out & (c <= F.lit(f"{b} 23:59:59").cast("timestamp_ntz"))
    elif b:
        out = out & (c < F.date_add(F.lit(str(b)).cast("date"), 1).cast("timestamp_ntz"))
    return out


def in_formats(col: str, formats: Sequence[str], mode: str = "known") -> Column:
    """known: only formats of KNOWN_FORMATS count, none left is no filter; listed: as given; like: with jpg=jpeg and heic=heif."""
    wanted = [f.strip().lower().lstrip(".") for f in formats]
    if mode == "known":
        wanted = [f for f in wanted if f in KNOWN_FORMATS]
        return F.lower(col).isin(wanted) if wanted else F.lit(True)
    if mode == "like":
        twins = {"jpg": "jpeg", "heic": "heif"}
        wanted += [twins[f] for f in wanted if f in twins]
    return F.lower(col).isin(wanted) if wanted else F.lit(True)


def in_box(min_lat: float | None, max_lat: float, min_lon: float, max_lon: float, lat: str = "latitude", lon: str = "longitude") -> Column:
    """Closed on all sides; active only with min_lat; no wrap at the 180th meridian."""
    return F.lit(True) if min_lat is None else F.col(lat).between(min_lat, max_lat) & F.col(lon).between(min_lon, max_lon)


def no_gps(lat: str = "latitude", lon: str = "longitude") -> Column:
    """Either coordinate is missing, no number, or 0."""
    a, o = F.col(lat), F.col(lon)
    return a.isNull() | o.isNull() | F.isnan(a) | F.isnan(o) | (a == 0) | (o == 0)


def has_gps(lat: str = "latitude", lon: str = "longitude") -> Column:
    """Both coordinates are there and numbers; 0 counts as a coordinate."""
    return F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)


def zero_gps(lat: str = "latitude", lon: str = "longitude") -> Column:
    return F.coalesce((F.col(lat) == 0) & (F.col(lon) == 0), F.lit(False))


def in_folder(path: str, folder: str) -> Column:
    """Direct children of a folder."""
    f = folder.rstrip("/")
    return F.col(path).startswith(f + "/") & ~F.substring(F.col(path), len(f) + 2, 1 << 30).contains("/")


def path_like(path: str, pattern: str) -> Column:
    """SQL LIKE with * as %."""
    return F.col(path).like(pattern.replace("*", "%"))


def contains_text(col: str, text: str) -> Column:
    """Case-insensitive substring; % and _ mean themselves."""
    return F.lower(col).contains(text.lower())


def recent(dated: str, created: str, cutoff: str) -> Column:
    """Dated on or after the cutoff, or undated and created on or after it."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    return (F.col(dated) >= at) | (F.col(dated).isNull() & (F.col(created) >= at))


def pending(vector: str = "clip_embedding_siglip", failed: str = "index_failed") -> Column:
    """Work to do: no vector and not failed."""
    return F.col(vector).isNull() & ~F.coalesce(F.col(failed), F.lit(False))


def having_any(photos: DataFrame, edges: DataFrame, key: str, ids: Sequence[int], on: str = "image_id") -> DataFrame:
    """Photos linked to any of the ids."""
    return photos.join(edges.filter(F.col(key).isin(list(ids))).select(on), on, "left_semi") if ids else photos


def having_all(photos: DataFrame, edges: DataFrame, key: str, ids: Sequence[int], on: str = "image_id") -> DataFrame:
    """Photos linked to every one of the ids (relational division); an id given twice can never be met."""
    if not ids:
        return photos
    full = edges.filter(F.col(key).isin(list(ids))).groupBy(on).agg(F.countDistinct(key).alias("n")).filter(F.col("n") == len(ids))
    return photos.join(full, on, "left_semi")


def having_each(photos: DataFrame, edges: DataFrame, key: str, ids: Sequence[int], on: str = "image_id") -> DataFrame:
    """Photos linked to every one of the ids, asked one by one; an id given twice counts once."""
    for i in dict.fromkeys(ids):
        photos = photos.join(edges.filter(F.col(key) == i).select(on), on, "left_semi")
    return photos


def having_none(photos: DataFrame, edges: DataFrame, key: str, ids: Sequence[int], on: str = "image_id") -> DataFrame:
    return photos.join(edges.filter(F.col(key).isin(list(ids))).select(on), on, "left_anti") if ids else photos


def visible(photos: DataFrame, photo_tag: DataFrame, tag: DataFrame, on: str = "image_id") -> DataFrame:
    """Photos without a system tag."""
    system = photo_tag.join(tag.filter("is_system").select("tag_id"), "tag_id", "left_semi").select(on)
    return photos.join(system, on, "left_anti")


def listed(photos: DataFrame, ids: DataFrame, on: str = "image_id") -> DataFrame:
    """Photos whose id is in a table of candidates; an empty table gives none."""
    return photos.join(ids.select(on), on, "left_semi")


def untagged(photos: DataFrame, photo_tag: DataFrame, faces: DataFrame | None = None, on: str = "image_id") -> DataFrame:
    """Photos without any tag and, if faces are given, without any face."""
    out = photos.join(photo_tag.select(on), on, "left_anti")
    return out if faces is None else out.join(faces.select(on), on, "left_anti")
