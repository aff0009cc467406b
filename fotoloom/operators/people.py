"""Persons, faces and their photos."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fotoloom.functions.vectors import centroids, unit_rows
from fotoloom.operators.search import similar_to_each, top_k
from fotoloom.session import parallelism

#: Centroids, and about as many unassigned faces, that a task multiplies.
CENTRE_ROWS, FACE_ROWS = 8_000, 20_000


def person_stats(person: DataFrame, faces: DataFrame) -> DataFrame:
    """Every person with faces, photos, the best face by score (ties: smaller id) and the cover: the chosen face or the best."""
    n = faces.filter("person_id is not null").groupBy("person_id").agg(
        F.count("*").alias("face_count"), F.countDistinct("image_id").alias("photo_count"),
        F.max_by("face_id", F.struct(F.coalesce("det_score", F.lit(-1.0)), -F.col("face_id"))).alias("best_face_id"),
    )
    out = person.join(n, "person_id", "left")
    return out.select(
        "person_id", "name", F.coalesce("face_count", F.lit(0)).alias("face_count"), F.coalesce("photo_count", F.lit(0)).alias("photo_count"),
        F.coalesce("cover_face_id", "best_face_id").alias("cover_face_id"), "best_face_id",
    )


def photos_of(person_id: int, faces: DataFrame, photos: DataFrame) -> DataFrame:
    """(image_id, file_path, photo_date, faces) of one person's photos."""
    n = faces.filter(F.col("person_id") == person_id).groupBy("image_id").agg(F.count("*").alias("faces"))
    return photos.select("image_id", "file_path", "photo_date").join(n, "image_id").orderBy(F.desc_nulls_last("photo_date"), F.desc("image_id"))


def sample_faces(faces: DataFrame, k: int = 5) -> DataFrame:
    """(person_id, face_id, rank): each person's k best faces by score; the rank limit is pushed below the shuffle."""
    w = Window.partitionBy("person_id").orderBy(F.desc_nulls_last("det_score"), F.asc("face_id"))
    ranked = faces.filter("person_id is not null").select("person_id", "face_id", "det_score", F.row_number().over(w).alias("rank"))
    return ranked.filter(F.col("rank") <= k).drop("det_score")


def similar_faces(faces: DataFrame, photos: DataFrame, person: DataFrame, query: list[float], k: int = 10, threshold: float = 0.5) -> DataFrame:
    """The k faces most similar to a vector with photo and, if known, person."""
    best = top_k(faces, "face_id", "face_embedding", query, k, threshold)
    rows = best.join(faces.select("face_id", "image_id", "person_id"), "face_id").join(photos.select("image_id", "file_path"), "image_id")
    return rows.join(person.select("person_id", F.col("name").alias("person_name")), "person_id", "left")


def assign_by_centroid(faces: DataFrame, person_ids: list[int] | None = None, threshold: float = 0.5, dim: int = 128) -> DataFrame:
    """(face_id, person_id): each unassigned face goes to the smallest person id whose centroid reaches the threshold.

    That is what going through the persons by id gives, as a face once taken is taken and no gain moves
    another centroid. A task holds a slice of the faces against a block of the centroids by matrix products;
    vectors that are zero, not ``dim`` long or not all numbers take no part.
    """
    known = faces.filter("person_id is not null")
    if person_ids is not None:
        known = known.filter(F.col("person_id").isin(person_ids))
    centre = centroids(known, "person_id", "face_embedding", dim).select(F.col("person_id").alias("p"), "centroid")
    free = faces.filter(F.col("person_id").isNull() & F.col("face_id").isNotNull() & (F.size("face_embedding") == dim)).select("face_id", "face_embedding")
    persons = known.select("person_id").distinct().count()
    blocks = max(1, -(-persons // CENTRE_ROWS))
    slices = max(parallelism(faces.sparkSession), -(-free.count() // FACE_ROWS))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    free = free.select("face_id", "face_embedding", part("face_id", slices).alias("slice"), every(blocks).alias("block"))
    centre = centre.select("p", "centroid", every(slices).alias("slice"), part("p", blocks).alias("block"))

    def first(f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"face_id": np.empty(0, np.int64), "p": np.empty(0, np.int64)})]
        if len(f) and len(c):
            c = c.sort_values("p")
            x, m = (unit_rows(v) for v in (f["face_embedding"], c["centroid"]))
            x32, m32 = x.astype(np.float32), m.astype(np.float32)
            step = max(64, 4_000_000 // len(m))
            for at in range(0, len(x), step):
                s = x32[at : at + step] @ m32.T
                ok = s >= threshold
                i, j = np.nonzero(np.abs(s - np.float32(threshold)) < 1e-4)  # single precision does not decide these
                ok[i, j] = (x[at + i] * m[j]).sum(axis=1) >= threshold
                hit = ok.any(axis=1)
                out.append(pd.DataFrame({"face_id": f.face_id.to_numpy()[at : at + step][hit], "p": c.p.to_numpy()[ok.argmax(axis=1)[hit]]}))
        return pd.concat(out)

    near = free.groupBy("slice", "block").cogroup(centre.groupBy("slice", "block")).applyInPandas(first, "face_id bigint, p bigint")
    return near.groupBy("face_id").agg(F.min("p").alias("person_id"))


def reassigned_covers(person: DataFrame, faces: DataFrame) -> DataFrame:
    """(person_id, old_cover, new_cover) where the best face differs from the cover; none without faces."""
    stats = person_stats(person, faces).select("person_id", F.col("best_face_id").alias("new_cover"))
    both = person.select("person_id", F.col("cover_face_id").alias("old_cover")).join(stats, "person_id")
    return both.filter(~F.col("old_cover").eqNullSafe(F.col("new_cover")))


def assign_by_nearest(faces: DataFrame, image_id: int, threshold: float = 0.6, dim: int = 128) -> DataFrame:
    """(face_id, person_id): each unassigned face of one photo goes to the person of its nearest assigned face, from the threshold on.

    The photo's faces are the query set, in blocks; all assigned faces are searched. Ties: the smaller face id.
    """
    usable = (F.size("face_embedding") == dim) & F.col("face_id").isNotNull()
    free = faces.filter(usable & (F.col("image_id") == image_id) & F.col("person_id").isNull()).select("face_id", "face_embedding")
    known = faces.filter(usable & F.col("person_id").isNotNull()).select("face_id", "face_embedding", "person_id")
    near = similar_to_each(known, "face_id", "face_embedding", free, 1, threshold, dim)
    best = near.select(F.col("query_id").alias("face_id"), F.col("id").alias("__k"))
    return best.join(known.select(F.col("face_id").alias("__k"), "person_id"), "__k").select("face_id", "person_id")


def faces_of(person_id: int, faces: DataFrame, photos: DataFrame, limit: int | None = None) -> DataFrame:
    """A person's faces with the day of their photo, latest first, then by score; faces of unknown photos are left out."""
    rows = faces.filter(F.col("person_id") == person_id).select("face_id", "image_id", "det_score").join(photos.select("image_id", "photo_date"), "image_id")
    rows = rows.orderBy(F.desc_nulls_last("photo_date"), F.desc_nulls_first("det_score"), "face_id")
    return rows if limit is None else rows.limit(limit)


def best_detection(detections: DataFrame, vector: str = "face_embedding") -> list[float] | None:
    """The vector of the face detected best in one picture (ties: smaller id); None without a face."""
    row = detections.filter(F.size(vector) > 0).agg(F.max_by(vector, F.struct(F.coalesce("det_score", F.lit(-1.0)), -F.col("face_id"))).alias("v")).first()
    return None if row.v is None else list(row.v)


def reset_covers(person: DataFrame, faces: DataFrame) -> DataFrame:
    """(person_id, old_cover, new_cover) of every cover that is not the person's best face; without faces the new one is null."""
    best = faces.filter("person_id is not null").groupBy("person_id").agg(F.max_by("face_id", F.struct(F.coalesce("det_score", F.lit(-1.0)), -F.col("face_id"))).alias("new_cover"))
    both = person.select("person_id", F.col("cover_face_id").alias("old_cover")).join(best, "person_id", "left")
    return both.filter(~F.col("old_cover").eqNullSafe(F.col("new_cover")))
