"""Albums, tags and access grants: many-to-many links and their questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fotoloom.operators.ranking import numbered


def album_list(album: DataFrame, album_photo: DataFrame, user_id: int | None = None, include_public: bool = True, search: str | None = None) -> DataFrame:
    """Albums with photo counts, latest first; a user sees their own and, if asked, public ones."""
    n = album_photo.groupBy("album_id").agg(F.countDistinct("image_id").alias("photo_count"))
    out = album
    if user_id is not None:
        out = out.filter((F.col("user_id") == user_id) | (F.lit(include_public) & F.col("is_public")))
    if search:
        out = out.filter(F.lower("title").contains(search.lower()))
    return out.join(n, "album_id", "left").withColumn("photo_count", F.coalesce("photo_count", F.lit(0))).orderBy(F.desc_nulls_last("updated_at"), "album_id")


def may_see(user: Column, is_admin: Column, owner: Column, is_public: Column, write: bool = False) -> Column:
    """Admins and owners always; others only read public albums."""
    return is_admin | (user == owner) | (F.lit(not write) & is_public)


def album_photos(album_id: int, album_photo: DataFrame, photos: DataFrame) -> DataFrame:
    rows = album_photo.filter(F.col("album_id") == album_id).select("image_id", "sort_order")
    return photos.join(rows, "image_id").orderBy("sort_order", "image_id")


def appended(album_id: int, image_ids: DataFrame, album_photo: DataFrame) -> DataFrame:
    """(album_id, image_id, sort_order) to add: photos not yet there, numbered on from the album's last."""
    here = album_photo.filter(F.col("album_id") == album_id)
    last = here.agg(F.coalesce(F.max("sort_order"), F.lit(0)).alias("last"))
    new = image_ids.groupBy("image_id").agg(F.min("position").alias("position")).join(here.select("image_id"), "image_id", "left_anti")
    new = numbered(new, [], [F.asc("position"), F.asc("image_id")], "n")
    return new.crossJoin(F.broadcast(last)).select(F.lit(album_id).alias("album_id"), "image_id", (F.col("last") + F.col("n")).cast("int").alias("sort_order"))


def tag_counts(tag: DataFrame, photo_tag: DataFrame, system_only: bool = False) -> DataFrame:
    """(tag_id, name, is_system, photos), tags without photos included, system tags first."""
    n = photo_tag.groupBy("tag_id").agg(F.countDistinct("image_id").alias("photos"))
    rows = tag.filter("is_system") if system_only else tag
    out = rows.select("tag_id", "name", "is_system").join(n, "tag_id", "left").withColumn("photos", F.coalesce("photos", F.lit(0)))
    return out.orderBy(F.desc("is_system"), "name", "tag_id")


def tags_of(image_id: int, photo_tag: DataFrame, tag: DataFrame, viewer_is_admin: bool) -> DataFrame:
    """A photo's tags, system tags first; only admins see those."""
    rows = tag.join(photo_tag.filter(F.col("image_id") == image_id).select("tag_id"), "tag_id", "left_semi")
    rows = rows if viewer_is_admin else rows.filter("not is_system")
    return rows.select("tag_id", "name", "is_system", "color").orderBy(F.desc("is_system"), "name", "tag_id")


def default_grants(users: DataFrame, section: DataFrame, function: DataFrame) -> DataFrame:
    """(user_id, function_code): functions of sections that are neither public nor for admins, for every user who is no admin."""
    open_ = section.filter("not is_public and not admin_only").select("section_code")
    return users.filter("not is_admin").select("user_id").crossJoin(function.join(open_, "section_code").select("function_code")).distinct()


def missing_grants(users: DataFrame, grants: DataFrame, function_code: str) -> DataFrame:
    """(user_id, function_code) for all users who lack one function."""
    has = grants.filter(F.col("function_code") == function_code).select("user_id")
    return users.select("user_id").join(has, "user_id", "left_anti").withColumn("function_code", F.lit(function_code))


def replaced_grants(user_id: int, requested: Sequence[str], function: DataFrame, grants: DataFrame) -> DataFrame:
    """All grants after one user's were replaced by the requested codes that exist."""
    valid = function.filter(F.col("function_code").isin(list(requested))).select(F.lit(user_id).cast("bigint").alias("user_id"), "function_code").distinct()
    return grants.filter(F.col("user_id") != user_id).select("user_id", "function_code").unionByName(valid)


def route_function(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Code of the first rule whose pattern the path matches from its start; null if none."""
    out = F.lit(None).cast("string")
    for pattern, code in reversed(rules):
        out = F.when(path.rlike(f"^(?:{pattern})"), code).otherwise(out)
    return out


def allowed(function: Column, is_admin: Column, is_public: Column, granted: Column) -> Column:
    """No function asked, an admin, a public section or a grant."""
    return function.isNull() | is_admin | F.coalesce(is_public, F.lit(False)) | F.coalesce(granted, F.lit(False))


def users_with_grants(users: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, display_name, functions): each user's function codes in order; empty without any."""
    lists = grants.select("user_id", "function_code").distinct().groupBy("user_id").agg(F.array_sort(F.collect_list("function_code")).alias("functions"))
    out = users.select("user_id", "display_name").join(lists, "user_id", "left")
    return out.withColumn("functions", F.coalesce("functions", F.array().cast("array<string>")))


def live_sessions(session: DataFrame, users: DataFrame, now: str, idle: str = "30 minutes") -> DataFrame:
    """Sessions whose last activity is not older than ``idle``, with their user."""
    at = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {idle}")
    return session.filter(F.col("last_active_at") >= at).join(users.select("user_id", "display_name", "is_admin"), "user_id")


def albums_of(image_id: int, album: DataFrame, album_photo: DataFrame) -> DataFrame:
    """The albums that hold a photo, by title."""
    held = album_photo.filter(F.col("image_id") == image_id).select("album_id")
    return album.join(held, "album_id", "left_semi").select("album_id", "title", "is_public").orderBy("title", "album_id")


def removed(requests: DataFrame, album_photo: DataFrame, covers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and (album_id, cover_image_id) after photos were taken out of albums, (album_id, image_id) each.

    A cover that was asked to be removed gives way to the photo added last of those that stay (ties: the
    larger id), or to none; other covers stay.
    """
    asked = requests.select("album_id", "image_id").distinct()
    left = album_photo.join(asked, ["album_id", "image_id"], "left_anti")
    lost = covers.join(asked.withColumnRenamed("image_id", "cover_image_id"), ["album_id", "cover_image_id"], "left_semi").select("album_id")
    latest = left.join(lost, "album_id", "left_semi").groupBy("album_id").agg(F.max_by("image_id", F.struct("added_at", "image_id")).alias("__new"))
    flagged = covers.join(lost.withColumn("__lost", F.lit(True)), "album_id", "left").join(latest, "album_id", "left")
    return left, flagged.select("album_id", F.when(F.col("__lost"), F.col("__new")).otherwise(F.col("cover_image_id")).alias("cover_image_id"))


def with_cover(album_id: int, image_id: int, album_photo: DataFrame, covers: DataFrame) -> DataFrame:
    """Covers after one was set, which only a photo of the album can be."""
    ok = album_photo.filter((F.col("album_id") == album_id) & (F.col("image_id") == image_id)).select("album_id").limit(1).withColumn("__ok", F.lit(True))
    return covers.join(ok, "album_id", "left").select("album_id", F.when(F.col("__ok"), F.lit(image_id)).otherwise(F.col("cover_image_id")).alias("cover_image_id"))


def checked_tags(tag: DataFrame, requested: Sequence[int], is_admin: bool) -> DataFrame:
    """(tag_id, name, verdict) of the requested tags that exist: 'denied' for a system tag unless an admin asks, else 'ok'.

    Unknown ids are ignored; an empty result means that none exists, and one 'denied' refuses the request.
    """
    denied = F.col("is_system") & F.lit(not is_admin)
    return tag.filter(F.col("tag_id").isin(list(requested))).select("tag_id", "name", F.when(denied, "denied").otherwise("ok").alias("verdict"))
