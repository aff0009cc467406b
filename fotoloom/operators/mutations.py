"""Changes as new tables: every function returns the table after the change and leaves the input alone.

A copy is written over, or beside, the old one by the caller; each plan is one join of old and new by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fotoloom.functions import media, predicates as pr
from fotoloom.operators.ranking import numbered


def _flag(keys: DataFrame, key: str, flag: str = "__hit") -> DataFrame:
    return keys.select(key).distinct().withColumn(flag, F.lit(True))


def upsert(old: DataFrame, new: DataFrame, key: str, order_by: str | None = None) -> DataFrame:
    """Rows of ``new`` replace or join those of ``old``; null new values keep the old ones. Of several new rows the last by ``order_by`` counts."""
    if order_by:
        w = Window.partitionBy(key).orderBy(F.desc_nulls_last(order_by))
        new = new.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    n = new.select(F.col(key), *[F.col(c).alias("__n_" + c) for c in new.columns if c != key])
    cols = [F.coalesce("__n_" + c, F.col(c)).alias(c) if c in new.columns and c != key else F.col(c) for c in old.columns]
    return old.join(n, key, "full_outer").select(*cols)


def index_result(old: DataFrame, new: DataFrame) -> DataFrame:
    """New vectors and failures by file_path: success clears the failure, failure keeps the vector; EXIF only fills an untouched photo."""
    n = new.select("file_path", F.col("clip_embedding_siglip").alias("__v"), F.col("fail_reason").alias("__f"), F.col("exif_data").alias("__e"))
    both = old.join(n, "file_path", "left")
    good, bad = F.col("__v").isNotNull(), F.col("__f").isNotNull() & F.col("__v").isNull()
    fill = F.col("exif_data").isNull() & (F.col("latitude").isNull() | F.col("photo_date").isNull())
    values: dict[str, Column] = {
        "clip_embedding_siglip": F.coalesce("__v", "clip_embedding_siglip"),
        "index_failed": F.when(good, False).when(bad, True).otherwise(F.col("index_failed")),
        "fail_reason": F.when(good, None).when(bad, F.substring("__f", 1, 512)).otherwise(F.col("fail_reason")),
        "exif_data": F.when(fill, F.col("__e")).otherwise(F.col("exif_data")),
    }
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in old.columns])


def fill_missing(old: DataFrame, new: DataFrame, key: str, columns: list[str], force: bool = False) -> DataFrame:
    """Fill nulls from ``new``; ``force`` lets new values win."""
    n = new.select(key, *[F.col(c).alias("__n_" + c) for c in columns])
    pick = lambda c: F.coalesce("__n_" + c, F.col(c)) if force else F.coalesce(F.col(c), F.col("__n_" + c))
    return old.join(n, key, "left").select(*[pick(c).alias(c) if c in columns else F.col(c) for c in old.columns])


def set_values(df: DataFrame, keys: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """The given columns of the rows whose key is listed."""
    hit = F.coalesce("__hit", F.lit(False))
    out = df.join(_flag(keys, key), key, "left")
    return out.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def add_tags(photo_tag: DataFrame, images: DataFrame, tags: DataFrame) -> DataFrame:
    """(image_id, tag_id) links to add: every image with every tag, without those that exist."""
    want = images.select("image_id").distinct().crossJoin(tags.select("tag_id").distinct())
    return want.join(photo_tag.select("image_id", "tag_id"), ["image_id", "tag_id"], "left_anti")


def remove_tags(photo_tag: DataFrame, images: DataFrame, tags: DataFrame) -> DataFrame:
    """The links without those of any of the images to any of the tags."""
    both = photo_tag.join(_flag(images, "image_id", "__i"), "image_id", "left").join(_flag(tags, "tag_id", "__t"), "tag_id", "left")
    return both.filter("not (coalesce(__i, false) and coalesce(__t, false))").select(*photo_tag.columns)


def delete_photos(photos: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str = "image_id") -> dict[str, DataFrame]:
    """Photos and everything that hangs on them without the given ids."""
    gone = gone.select(key).distinct()
    return {"photo_index": photos.join(gone, key, "left_anti")} | {k: v.join(gone, key, "left_anti") for k, v in children.items()}


def assign_faces(faces: DataFrame, assignment: DataFrame) -> DataFrame:
    """Faces with the person of (face_id, person_id) where one is given; a null person unassigns."""
    a = assignment.select("face_id", F.col("person_id").alias("__p"), F.lit(True).alias("__hit"))
    out = faces.join(a, "face_id", "left")
    return out.select(*[F.when(F.col("__hit"), F.col("__p")).otherwise(F.col(c)).alias(c) if c == "person_id" else F.col(c) for c in faces.columns])


def merge_persons(person: DataFrame, faces: DataFrame, relations: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faces move to the target; the source and its relations go; the target's cover stays."""
    moved = faces.withColumn("person_id", F.when(F.col("person_id") == source, F.lit(target).cast("bigint")).otherwise(F.col("person_id")))
    kept = relations.filter(~(F.col("person_id_from").eqNullSafe(F.lit(source)) | F.col("person_id_to").eqNullSafe(F.lit(source))))
    return person.filter(F.col("person_id") != source), moved, kept


def new_persons(person: DataFrame, names: DataFrame) -> DataFrame:
    """Names (trimmed, each once without case) that no person has yet."""
    want = names.select(F.trim("name").alias("name")).filter("name <> ''").withColumn("k", F.lower("name"))
    want = want.groupBy("k").agg(F.min("name").alias("name"))
    return want.join(person.select(F.lower(F.trim("name")).alias("k")), "k", "left_anti").select("name")


def place_photos(photos: DataFrame, lat: float, lon: float, ids: list[int] | None = None, folder: str | None = None) -> DataFrame:
    """Set a position: of the listed photos, or of the photos of a folder that have none."""
    hit = F.col("image_id").isin(ids) if ids is not None else pr.in_folder("file_path", folder) & pr.no_gps()
    hit = F.coalesce(hit, F.lit(False))
    return photos.withColumns({"latitude": F.when(hit, F.lit(lat)).otherwise(F.col("latitude")), "longitude": F.when(hit, F.lit(lon)).otherwise(F.col("longitude"))})


def update_hashes(photos: DataFrame, hashes: DataFrame, failed: DataFrame) -> DataFrame:
    """New hashes (image_id, phash) where readable; '' marks the failed ones."""
    ok = hashes.filter(F.col("phash").rlike("^[0-9a-fA-F]{1,64}$")).select("image_id", F.col("phash").alias("__h"))
    out = photos.join(ok.unionByName(failed.select("image_id", F.lit("").alias("__h"))).groupBy("image_id").agg(F.max("__h").alias("__h")), "image_id", "left")
    return out.select(*[F.coalesce("__h", "phash").alias("phash") if c == "phash" else F.col(c) for c in photos.columns])


def rotate_photo(photos: DataFrame, faces: DataFrame, image_id: int, degrees: int) -> tuple[DataFrame, DataFrame]:
    """Turn a photo and its face boxes clockwise by a multiple of 90 degrees; sides swap by 90 and 270."""
    this = F.col("image_id") == image_id
    exif = F.coalesce("exif_data", F.lit("{}"))
    turned = F.to_json(F.map_concat(F.map_filter(F.from_json(exif, "map<string,string>"), lambda k, v: k != "UserRotation"), F.create_map(F.lit("UserRotation"), media.rotate(media.rotation(exif), F.lit(degrees)).cast("string"))))
    swap = this & F.lit(degrees % 180 == 90)
    size = photos.filter(this).select("image_id", F.col("width").alias("__w"), F.col("height").alias("__h")).limit(1)
    out = photos.select(*[
        F.when(this, turned).otherwise(F.col(c)).alias(c) if c == "exif_data"
        else F.when(swap, F.col({"width": "height", "height": "width"}[c])).otherwise(F.col(c)).alias(c) if c in ("width", "height") else F.col(c)
        for c in photos.columns
    ])
    box = media.rotated_box(*[F.col(f"bbox_{x}") for x in ("x1", "y1", "x2", "y2")], F.col("__w"), F.col("__h"), degrees)
    hit = F.col("__w").isNotNull()
    joined = faces.join(F.broadcast(size), "image_id", "left").withColumn("__b", box)
    moved = joined.select(*[F.when(hit, F.col("__b")[c[5:]]).otherwise(F.col(c)).alias(c) if c.startswith("bbox_") else F.col(c) for c in faces.columns])
    return out, moved


def fixed_sizes(photos: DataFrame) -> DataFrame:
    """(image_id, width, height) of photos whose stored sides differ from those shown."""
    s = media.shown_size(F.col("width"), F.col("height"), F.col("exif_data"), F.col("file_format"))
    rows = photos.filter("width is not null and height is not null").select("image_id", "width", "height", s.alias("s"))
    return rows.filter("s.width <> width or s.height <> height").select("image_id", "s.width", "s.height")


def reset_failures(photos: DataFrame, ids: list[int] | None = None) -> DataFrame:
    hit = F.col("index_failed") if ids is None else F.col("index_failed") & F.col("image_id").isin(ids)
    return photos.withColumns({"index_failed": F.when(hit, False).otherwise(F.col("index_failed")), "fail_reason": F.when(hit, None).otherwise(F.col("fail_reason"))})


def mark_faces_indexed(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """Photos that have faces get faces_indexed 1."""
    return set_values(photos, faces.select("image_id"), "image_id", {"faces_indexed": F.lit(1)})


def delete_persons(person: DataFrame, faces: DataFrame, relations: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Persons go with their relations; their faces stay, unassigned."""
    gone = lambda c: F.coalesce(F.col(c).isin(ids), F.lit(False))
    free = faces.withColumn("person_id", F.when(~gone("person_id"), F.col("person_id")))
    return person.filter(~gone("person_id")), free, relations.filter(~gone("person_id_from") & ~gone("person_id_to"))


def raise_marks(users: DataFrame, uploads: DataFrame, key: str = "user_id", mark: str = "last_seen_at", at: str = "ts") -> DataFrame:
    """Users with a mark that follows their latest upload and never goes back."""
    latest = uploads.groupBy(key).agg(F.max(at).alias("__latest"))
    return users.join(latest, key, "left").select(*[F.greatest(F.col(mark), F.col("__latest").cast("timestamp_ntz")).alias(mark) if c == mark else F.col(c) for c in users.columns])


def assign_face(person: DataFrame, faces: DataFrame, face_id: int, person_id: int) -> tuple[DataFrame, DataFrame]:
    """Persons and faces after one face went to a person; unchanged if either does not exist.

    If the face was its old person's cover, their best other face takes its place, or none. The new
    person's cover becomes the face if there was none, if the cover's face is gone or if the face scores higher.
    """
    face = faces.filter(F.col("face_id") == face_id).select(F.col("person_id").alias("__old"), F.col("det_score").alias("__score")).limit(1)
    face = face.crossJoin(F.broadcast(person.filter(F.col("person_id") == person_id).select(F.lit(True).alias("__ok")).limit(1)))  # one row or none
    better = F.max_by("face_id", F.struct(F.coalesce("det_score", F.lit(-1.0)), -F.col("face_id")))
    owner = faces.join(F.broadcast(face), F.col("person_id") == F.col("__old")).filter(F.col("face_id") != face_id).agg(better.alias("__next"))
    target = person.filter(F.col("person_id") == person_id).select(F.col("cover_face_id").alias("face_id"))
    cover = faces.join(F.broadcast(target), "face_id").agg(F.count("*").alias("__there"), F.max("det_score").alias("__cover_score"))
    one = face.crossJoin(F.broadcast(owner)).crossJoin(F.broadcast(cover))
    p = person.join(F.broadcast(one), F.lit(True), "left")
    this = F.lit(face_id).cast("bigint")
    leaves = F.col("__ok") & (F.col("person_id") == F.col("__old")) & (F.col("__old") != person_id) & (F.col("cover_face_id") == face_id)
    higher = (F.col("__score") > 0) & (F.col("__cover_score").isNull() | (F.col("__score") > F.col("__cover_score")))
    gains = F.col("__ok") & (F.col("person_id") == person_id) & (F.col("cover_face_id").isNull() | (F.col("__there") == 0) | higher)
    new = F.when(leaves, F.col("__next")).when(gains, this).otherwise(F.col("cover_face_id")).alias("cover_face_id")
    out = p.select(*[new if c == "cover_face_id" else F.col(c) for c in person.columns])
    moved = faces.join(F.broadcast(face.select("__ok")), F.lit(True), "left")
    to = F.when(F.col("__ok") & (F.col("face_id") == face_id), F.lit(person_id).cast("bigint")).otherwise(F.col("person_id")).alias("person_id")
    return out, moved.select(*[to if c == "person_id" else F.col(c) for c in faces.columns])


def reindex_faces(faces: DataFrame, image_id: int, detected: DataFrame) -> DataFrame:
    """Faces after one photo's were replaced by newly detected ones, without person; assign them with ``people.assign_by_nearest``."""
    new = detected.select(*[F.lit(image_id).cast("bigint").alias(c) if c == "image_id" else F.lit(None).cast(faces.schema[c].dataType).alias(c) if c == "person_id" or c not in detected.columns else F.col(c) for c in faces.columns])
    return faces.filter(~F.col("image_id").eqNullSafe(F.lit(image_id))).unionByName(new)


#: Kinds of relation that may be added, fixed values.
RELATION_TYPES = ["parent", "spouse"]


def add_relations(relations: DataFrame, person: DataFrame, wanted: DataFrame) -> DataFrame:
    """Relations with the wanted (person_id_from, person_id_to, relation_type) of known persons and kinds that are not there yet, numbered on from the last."""
    key = ["person_id_from", "person_id_to", "relation_type"]
    new = wanted.select(*key).filter(F.col("relation_type").isin(RELATION_TYPES)).distinct().join(relations.select(*key), key, "left_anti")
    for end in key[:2]:
        new = new.join(person.select(F.col("person_id").alias(end)), end, "left_semi")
    last = relations.agg(F.coalesce(F.max("relation_id"), F.lit(0)).alias("__last"))
    new = numbered(new, [], [F.col(c).asc() for c in key], "__n").crossJoin(F.broadcast(last)).withColumn("relation_id", F.col("__last") + F.col("__n"))
    return relations.unionByName(new.select("relation_id", *key), allowMissingColumns=True)


def edit_photo(photos: DataFrame, image_id: int, changes: dict[str, object]) -> DataFrame:
    """A photo's date or position changed; a position with a null part is cleared whole."""
    changes = dict(changes)
    if {"latitude", "longitude"} & set(changes) and (changes.get("latitude") is None or changes.get("longitude") is None):
        changes |= {"latitude": None, "longitude": None}
    this = F.col("image_id") == image_id
    return photos.withColumns({c: F.when(this, F.lit(v).cast(photos.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})
