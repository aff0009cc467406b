"""Queries of what users of the archive do: changes to faces, albums, relations and tags, clean-up, indexing; with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fotoloom.functions import media, predicates as pr
from fotoloom.functions.hashing import clean_hash
from fotoloom.operators import dedup, family, membership as mb, mutations as mu, people, search, stats
from fotoloom.plans.archive import _FV, _GROUPS, _HASH, _HIDDEN, _KIND, _PV, _RANKED, _SCORED, _V, _scored as scored, first_vector
from fotoloom.plans.fixtures import Tables, ctes
from fotoloom.session import register_catalog
from fotoloom.sources import files
from fotoloom.streaming import changes

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function of the tables under its name, with its SQL twin."""

    def add(f: Callable[[Tables], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, d: f(Tables(spark, d))
        _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- persons and faces ----------------------------------------------------------------------------


@query("""SELECT face_id, image_id FROM faces JOIN photo_index USING (image_id) WHERE person_id = 7
 ORDER BY photo_date DESC NULLS LAST, det_score DESC NULLS FIRST, face_id LIMIT 50""")
def person_faces(t: Tables) -> DataFrame:
    return people.faces_of(7, t.faces, t.photo_index, 50).select("face_id", "image_id")


@query("""SELECT person_id, old_cover, new_cover FROM (SELECT p.person_id, p.cover_face_id AS old_cover,
 (SELECT face_id FROM faces b WHERE b.person_id = p.person_id ORDER BY coalesce(det_score, -1) DESC, face_id LIMIT 1) AS new_cover FROM person p) WHERE old_cover IS DISTINCT FROM new_cover""")
def reset_covers(t: Tables) -> DataFrame:
    return people.reset_covers(t.person, t.faces)


_BEST2 = "(SELECT face_id FROM faces WHERE person_id = 2 ORDER BY coalesce(det_score, -1) DESC, face_id LIMIT 1)"


def _moving(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Person 2's best face, made their cover, goes to person 7."""
    best = t.faces.filter("person_id = 2").agg(F.max_by("face_id", F.struct(F.coalesce("det_score", F.lit(-1.0)), -F.col("face_id")))).first()[0]
    person = t.person.withColumn("cover_face_id", F.when(F.col("person_id") == 2, F.lit(best)).otherwise(F.col("cover_face_id")))
    return mu.assign_face(person, t.faces, -1 if best is None else best, 7)


@query(f"""WITH m AS (SELECT face_id, det_score FROM faces WHERE face_id = {_BEST2}),
 c AS (SELECT f.face_id, f.det_score FROM faces f JOIN person p ON p.person_id = 7 AND f.face_id = p.cover_face_id)
 SELECT person_id, CASE WHEN person_id = 2 AND EXISTS (FROM m) THEN CASE WHEN EXISTS (SELECT 1 FROM person WHERE person_id = 7)
   THEN (SELECT face_id FROM faces WHERE person_id = 2 AND face_id <> {_BEST2} ORDER BY coalesce(det_score, -1) DESC, face_id LIMIT 1) ELSE (SELECT face_id FROM m) END
  WHEN person_id = 7 AND EXISTS (FROM m) AND (cover_face_id IS NULL OR NOT EXISTS (FROM c)
   OR ((SELECT det_score FROM m) > 0 AND ((SELECT det_score FROM c) IS NULL OR (SELECT det_score FROM m) > (SELECT det_score FROM c)))) THEN (SELECT face_id FROM m)
  WHEN person_id = 2 THEN NULL ELSE cover_face_id END AS cover_face_id FROM person""")
def covers_after_move(t: Tables) -> DataFrame:
    return _moving(t)[0].select("person_id", "cover_face_id")


@query(f"""SELECT CASE WHEN face_id = {_BEST2} AND EXISTS (SELECT 1 FROM person WHERE person_id = 7) THEN 7 ELSE person_id END AS person_id, count(*) AS faces FROM faces GROUP BY 1""")
def faces_after_move(t: Tables) -> DataFrame:
    return _moving(t)[1].groupBy("person_id").agg(F.count("*").alias("faces"))


_PHOTO = "(SELECT min(image_id) FROM fv WHERE person_id IS NOT NULL)"


@query(f"""WITH {_FV}, i AS (SELECT {_PHOTO} AS i), n AS (SELECT face_id + 1000000000 AS face_id, v FROM fv, i WHERE image_id = i),
 k AS (SELECT face_id AS f, person_id AS p, v FROM fv, i WHERE person_id IS NOT NULL AND image_id IS DISTINCT FROM i),
 s AS (SELECT n.face_id, k.p, row_number() OVER (PARTITION BY n.face_id ORDER BY list_cosine_similarity(n.v, k.v) DESC, k.f) AS r FROM n, k WHERE list_cosine_similarity(n.v, k.v) >= 0.6)
 SELECT n.face_id, s.p AS person_id FROM (SELECT face_id + 1000000000 AS face_id FROM faces, i WHERE image_id = i) n LEFT JOIN s ON s.face_id = n.face_id AND r = 1""")
def faces_reindexed(t: Tables) -> DataFrame:
    """One photo's faces found anew and assigned to the persons of the most similar faces elsewhere."""
    usable = (F.size("face_embedding") == 128) & F.exists("face_embedding", lambda x: x != 0)
    this = t.faces.filter(usable & F.col("person_id").isNotNull()).agg(F.min("image_id")).first()[0]
    detected = t.faces.filter(F.col("image_id") == this).withColumn("face_id", F.col("face_id") + 1000000000)
    after = mu.reindex_faces(t.faces, this, detected)
    done = mu.assign_faces(after, people.assign_by_nearest(after, this, 0.6))
    return done.filter(F.col("image_id") == this).select("face_id", "person_id")


@query(f"""WITH {_FV}, d AS (SELECT fv.* FROM fv JOIN faces USING (face_id) WHERE fv.image_id = (SELECT min(image_id) FROM fv) ORDER BY coalesce(det_score, -1) DESC, face_id LIMIT 1)
 SELECT fv.face_id, round(list_cosine_similarity(fv.v, d.v), 6) AS similarity FROM fv, d WHERE EXISTS (SELECT 1 FROM photo_index p WHERE p.image_id = fv.image_id) AND fv.face_id IN (
  SELECT fv.face_id FROM fv, d WHERE list_cosine_similarity(fv.v, d.v) >= 0.2 ORDER BY list_cosine_similarity(fv.v, d.v) DESC, fv.face_id LIMIT 10)""")
def uploaded_face(t: Tables) -> DataFrame:
    """The best face of an uploaded picture, here of a photo's detections, is searched for."""
    usable = t.faces.filter((F.size("face_embedding") == 128) & F.exists("face_embedding", lambda x: x != 0))
    first = usable.agg(F.min("image_id")).first()[0]
    q = people.best_detection(usable.filter(F.col("image_id") == first))
    return people.similar_faces(t.faces, t.photo_index, t.person, q, 10, 0.2).select("face_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH w AS (SELECT DISTINCT person_id_to AS person_id_from, person_id_from AS person_id_to, lower(trim(relation_type)) AS relation_type FROM person_relation),
 n AS (SELECT * FROM w WHERE relation_type IN ('parent', 'spouse') AND person_id_from IN (SELECT person_id FROM person) AND person_id_to IN (SELECT person_id FROM person)
  AND NOT EXISTS (SELECT 1 FROM person_relation r WHERE r.person_id_from = w.person_id_from AND r.person_id_to = w.person_id_to AND r.relation_type = w.relation_type))
 SELECT (SELECT max(relation_id) FROM person_relation) + row_number() OVER (ORDER BY person_id_from, person_id_to, relation_type) AS relation_id, person_id_from, person_id_to, relation_type FROM n
 UNION ALL SELECT relation_id, person_id_from, person_id_to, relation_type FROM person_relation""")
def relations_added(t: Tables) -> DataFrame:
    """Every relation wanted in the other direction too."""
    wanted = t.person_relation.select(F.col("person_id_to").alias("person_id_from"), F.col("person_id_from").alias("person_id_to"), F.lower(F.trim("relation_type")).alias("relation_type"))
    got = mu.add_relations(t.person_relation, t.person, wanted)
    return got.select("relation_id", "person_id_from", "person_id_to", "relation_type")


@query("""SELECT p.person_id, count(f.face_id) AS face_count, count(DISTINCT f.image_id) AS photo_count FROM person p LEFT JOIN faces f ON f.person_id = p.person_id GROUP BY p.person_id""")
def person_view(t: Tables) -> DataFrame:
    register_catalog(t.spark, t.dir)
    return t.spark.sql("SELECT person_id, face_count, photo_count FROM person_with_stats")


@query("SELECT p.person_id, (SELECT count(*) FROM faces f WHERE f.person_id = p.person_id) AS n FROM person p")
def face_count_function(t: Tables) -> DataFrame:
    register_catalog(t.spark, t.dir)
    return t.spark.sql("SELECT person_id, person_face_count(person_id) AS n FROM person")


@query("SELECT CASE WHEN person_id = 7 THEN NULL ELSE person_id END AS person_id, count(*) AS faces FROM faces GROUP BY 1")
def faces_after_person_deleted(t: Tables) -> DataFrame:
    _, faces, _ = mu.delete_persons(t.person, t.faces, t.person_relation, [7])
    return faces.groupBy("person_id").agg(F.count("*").alias("faces"))


@query("SELECT relation_id FROM person_relation WHERE coalesce(person_id_from, -1) <> 7 AND coalesce(person_id_to, -1) <> 7")
def relations_after_person_deleted(t: Tables) -> DataFrame:
    return mu.delete_persons(t.person, t.faces, t.person_relation, [7])[2].select("relation_id")


@query("SELECT image_id FROM photo_index WHERE image_id IN (SELECT image_id FROM faces WHERE person_id = 2) AND image_id IN (SELECT image_id FROM faces WHERE person_id = 7)")
def persons_each(t: Tables) -> DataFrame:
    return pr.having_each(t.photo_index.select("image_id"), t.faces, "person_id", [2, 7, 2])


# --- albums, tags and grants ----------------------------------------------------------------------


@query(f"""{ctes("album", "album_photo")} SELECT album_id, title, is_public FROM album WHERE album_id IN (SELECT album_id FROM album_photo WHERE image_id = 3)""")
def photo_albums(t: Tables) -> DataFrame:
    return mb.albums_of(3, t.album, t.album_photo)


_REMOVED = f"""{ctes("album_photo", "album_cover")}, q AS (SELECT DISTINCT album_id, image_id FROM album_photo WHERE image_id IN (SELECT image_id FROM faces WHERE person_id IS NOT NULL)),
 k AS (SELECT * FROM album_photo WHERE (album_id, image_id) NOT IN (SELECT (album_id, image_id) FROM q))"""


def _removed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Photos of known persons are taken out of all albums."""
    known = t.faces.filter("person_id is not null").select("image_id")
    return mb.removed(t.album_photo.join(known, "image_id", "left_semi"), t.album_photo, t.album_cover)


@query(f"{_REMOVED} SELECT album_id, count(*) AS photos FROM k GROUP BY album_id")
def albums_after_removal(t: Tables) -> DataFrame:
    return _removed(t)[0].groupBy("album_id").agg(F.count("*").alias("photos"))


@query(f"""{_REMOVED}, l AS (SELECT album_id, image_id, row_number() OVER (PARTITION BY album_id ORDER BY added_at DESC, image_id DESC) AS r FROM k)
 SELECT c.album_id, CASE WHEN q.image_id IS NULL THEN c.cover_image_id ELSE l.image_id END AS cover_image_id FROM album_cover c
 LEFT JOIN q ON q.album_id = c.album_id AND q.image_id = c.cover_image_id LEFT JOIN l ON l.album_id = c.album_id AND l.r = 1""")
def covers_after_removal(t: Tables) -> DataFrame:
    return _removed(t)[1]


@query("SELECT tag_id, name, CASE WHEN is_system THEN 'denied' ELSE 'ok' END AS verdict FROM tag WHERE tag_id IN (1, 2, 3, 4, 999)")
def checked_tags(t: Tables) -> DataFrame:
    return mb.checked_tags(t.tag, [1, 2, 3, 4, 999], False)


@query(f"""{ctes("grants")} SELECT user_id, function_code FROM grants WHERE user_id <> 6 UNION ALL SELECT 6, 'tags.edit' UNION ALL SELECT 6, 'faces.view'""")
def grants_replaced(t: Tables) -> DataFrame:
    return mb.replaced_grants(6, ["tags.edit", "faces.view", "no.such"], t.api_function, t.grants)


@query(f"""{ctes("album")} SELECT album_id, u.user_id, u.is_admin OR u.user_id = album.user_id OR is_public AS may_read, u.is_admin OR u.user_id = album.user_id AS may_write
 FROM album JOIN app_user u ON u.user_id = 1 + (album.user_id + 6) % 200""")
def album_rights(t: Tables) -> DataFrame:
    """What each album's neighbouring user may do."""
    u = t.app_user.select(F.col("user_id").alias("u"), "is_admin")
    rows = t.album.join(u, F.col("u") == 1 + (F.col("user_id") + 6) % 200)
    may = lambda write: mb.may_see(F.col("u"), F.col("is_admin"), F.col("user_id"), F.col("is_public"), write)
    return rows.select("album_id", F.col("u").alias("user_id"), may(False).alias("may_read"), may(True).alias("may_write"))


# --- statistics and searches ----------------------------------------------------------------------


@query(f"""WITH p AS (SELECT *, CASE WHEN width > height THEN {_V} END AS second FROM photo_index)
 SELECT 'photos' AS what, count(*) AS n FROM p UNION ALL SELECT 'indexed', count(*) FILTER ({_V} IS NOT NULL OR second IS NOT NULL) FROM p
 UNION ALL SELECT 'pending', count(*) FILTER ({_V} IS NULL AND second IS NULL) FROM p UNION ALL SELECT 'hashes', count(*) FILTER (phash <> '') FROM p
 UNION ALL SELECT 'failed', count(*) FILTER (index_failed) FROM p UNION ALL SELECT 'model SigLIP', count({_V}) FROM p UNION ALL SELECT 'model ViT-B/32', count(second) FROM p
 UNION ALL SELECT 'faces', count(*) FROM faces UNION ALL SELECT concat('tag ', name), (SELECT count(image_id) FROM photo_tag x WHERE x.tag_id = tag.tag_id) FROM tag WHERE is_system""")
def archive_summary(t: Tables) -> DataFrame:
    p = t.photo_index.withColumn("second", F.when(F.col("width") > F.col("height"), F.col(_V)))
    return stats.summary(p, t.faces, t.tag, t.photo_tag, {"SigLIP": _V, "ViT-B/32": "second"})


@query(f"""{ctes("scan_new")} SELECT count(*) AS files, sum(size)::BIGINT AS bytes FROM scan_new""")
def scan_total(t: Tables) -> DataFrame:
    return stats.scan_total(t.scan_new, "size")


@query(f"""WITH {_PV}, q AS (SELECT v FROM pv ORDER BY image_id LIMIT 1), b AS (SELECT image_id FROM photo_index WHERE latitude BETWEEN -60 AND 70 AND longitude BETWEEN -150 AND 170 AND {_HIDDEN})
 SELECT image_id, round(list_cosine_similarity(pv.v, q.v), 6) AS similarity FROM pv, q WHERE image_id IN (SELECT image_id FROM b) AND list_cosine_similarity(pv.v, q.v) >= 0.1
 ORDER BY list_cosine_similarity(pv.v, q.v) DESC, image_id LIMIT 100""")
def search_in_box(t: Tables) -> DataFrame:
    spec = search.Spec(box=(-60, 70, -150, 170), top_k=100)
    got = search.search_in_box(t.photo_index, _V, first_vector(t), spec, t.faces, t.photo_tag, t.tag, 0.1)
    return got.select("image_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_PV}, q AS (SELECT v FROM pv ORDER BY image_id LIMIT 1), k AS (SELECT image_id FROM pv, q WHERE list_cosine_similarity(pv.v, q.v) >= 0.2 ORDER BY list_cosine_similarity(pv.v, q.v) DESC, image_id LIMIT 50)
 SELECT file_path AS src, concat('/trash/', CASE WHEN starts_with(file_path, '/photos/') THEN file_path[9:] ELSE file_path END) AS dst FROM k JOIN photo_index USING (image_id)""")
def trash_candidates(t: Tables) -> DataFrame:
    best = search.top_k(t.photo_index, "image_id", _V, first_vector(t), 50, 0.2)
    return files.trash_plan(t.photo_index.join(best.select("image_id"), "image_id", "left_semi"), "/photos", "/trash")


@query("SELECT image_id FROM photo_index WHERE phash IS NULL AND image_id > 500 ORDER BY image_id LIMIT 100")
def pending_page(t: Tables) -> DataFrame:
    return files.page_after(t.photo_index.filter("phash is null").select("image_id"), "image_id", 500, 100)


def _each(vectors: str, i: str) -> str:
    return f"""WITH {vectors} SELECT query_id, {i}, round(s, 4) AS similarity FROM (SELECT q.{i} AS query_id, r.{i}, list_cosine_similarity(q.v, r.v) AS s,
  row_number() OVER (PARTITION BY q.{i} ORDER BY list_cosine_similarity(q.v, r.v) DESC, r.{i}) AS n FROM {vectors[:2]} q JOIN {vectors[:2]} r ON q.{i} <> r.{i}
  WHERE q.{i} % 20 = 0 AND list_cosine_similarity(q.v, r.v) >= 0.01) WHERE n <= 10"""


@query(_each(_PV, "image_id"))
def similar_by_id_each(t: Tables) -> DataFrame:
    """The 10 photos most similar to every photo whose id is divisible by 20."""
    got = search.similar_to_each(t.photo_index, "image_id", _V, t.photo_index.filter("image_id % 20 = 0"), 10)
    return got.select("query_id", F.col("id").alias("image_id"), F.round("similarity", 4).alias("similarity"))


@query(_each(_FV, "face_id"))
def face_topk_each(t: Tables) -> DataFrame:
    """The 10 faces most similar to every face whose id is divisible by 20."""
    got = search.similar_to_each(t.faces, "face_id", "face_embedding", t.faces.filter("face_id % 20 = 0"), 10)
    return got.select("query_id", F.col("id").alias("face_id"), F.round("similarity", 4).alias("similarity"))


@query(f"""WITH g AS (SELECT image_id, floor(latitude / 0.5)::BIGINT AS y, floor(longitude / 0.5)::BIGINT AS x FROM photo_index WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude))
 SELECT y AS cell_y, x AS cell_x, count(*) AS photos, array_to_string(list(image_id ORDER BY image_id)[:4], ',') AS previews FROM g GROUP BY y, x""")
def grid_previews(t: Tables) -> DataFrame:
    """Map cells of a near zoom with up to four photos each."""
    got = stats.grid_clusters(t.photo_index, 7, preview_k=4)
    return got.select("cell_y", "cell_x", "photos", F.array_join(F.transform("preview_ids", lambda x: x.cast("string")), ",").alias("previews"))


@query(f"""WITH {_FV}, q AS (SELECT face_id AS i, v FROM fv ORDER BY face_id LIMIT 1), k AS (SELECT face_id, i, list_cosine_similarity(fv.v, q.v) AS s FROM fv, q WHERE list_cosine_similarity(fv.v, q.v) >= 0.2 ORDER BY s DESC, face_id LIMIT 10)
 SELECT face_id, round(s, 4) AS similarity FROM k WHERE face_id <> i""")
def similar_face_by_id(t: Tables) -> DataFrame:
    """A stored face is searched for; it takes one of the ten places and is then left out."""
    this = t.faces.filter((F.size("face_embedding") == 128) & F.exists("face_embedding", lambda x: x != 0)).agg(F.min("face_id")).first()[0]
    return search.similar_to(t.faces, "face_id", "face_embedding", this, 10, 0.2, drop_self="after")


@query(f"""WITH {_SCORED},
 k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY s DESC, image_id) AS r FROM s WHERE s >= 0.2 QUALIFY r <= 500),
 m AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY s DESC, image_id) AS n FROM k WHERE s >= CASE model WHEN 'SigLIP' THEN 0.06 ELSE 0.18 END)
 SELECT DISTINCT image_id, 12 AS tag_id FROM m WHERE image_id NOT IN (SELECT image_id FROM photo_tag)""")
def models_to_tags(t: Tables) -> DataFrame:
    """Links to add when the best photos of several models, from a given similarity on and as far as untagged, get a tag."""
    fused = search.fuse_ranks(scored(t), threshold=0.2, relative_cutoff=0.0, rrf_cutoff=0.0, cap=None)
    return mu.add_tags(t.photo_tag, pr.untagged(fused, t.photo_tag), t.tag.filter("tag_id = 12"))


@query(f"""{ctes("grants")} SELECT u.user_id, p.name AS person_name, coalesce((SELECT string_agg(DISTINCT function_code, ',' ORDER BY function_code) FROM grants g WHERE g.user_id = u.user_id), '') AS functions
 FROM app_user u LEFT JOIN person p ON p.person_id = u.user_id""")
def users_with_persons(t: Tables) -> DataFrame:
    """Users with the person they are, here the one of the same id, and their functions."""
    got = mb.users_with_grants(t.app_user, t.grants).join(t.person.select(F.col("person_id").alias("user_id"), F.col("name").alias("person_name")), "user_id", "left")
    return got.select("user_id", "person_name", F.array_join("functions", ",").alias("functions"))


@query("""WITH e AS (SELECT DISTINCT person_id_from AS a, person_id_to AS b, lower(trim(relation_type)) AS k FROM person_relation WHERE person_id_from <> person_id_to AND relation_type IS NOT NULL)
 SELECT p.person_id, (SELECT count(*) FROM faces f WHERE f.person_id = p.person_id) AS face_count, (SELECT count(*) FROM e WHERE a = p.person_id AND k = 'parent') AS children,
 (SELECT count(*) FROM e WHERE b = p.person_id AND k = 'parent') AS parents FROM person p""")
def family_tree_persons(t: Tables) -> DataFrame:
    """The persons of the tree dump: their faces, children and parents; ``family_tree`` holds its links."""
    return family.tree_persons(t.person, t.faces, t.person_relation)


# --- duplicates -----------------------------------------------------------------------------------


@query(f"{_GROUPS} SELECT group_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, group_id) AS place FROM m GROUP BY group_id")
def groups_by_size(t: Tables) -> DataFrame:
    return dedup.by_size(dedup.hash_groups(t.photo_index, 6))


@query(f"""{_GROUPS} SELECT group_id, id, file_name, {_KIND} AS kind, file_size, latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) AS has_gps
 FROM m JOIN (SELECT *, lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) AS e FROM photo_index) ON image_id = id""")
def duplicate_details(t: Tables) -> DataFrame:
    return dedup.enriched(dedup.hash_groups(t.photo_index, 6), t.photo_index).select("group_id", "id", "file_name", "kind", "file_size", "has_gps")


@query(f"""{_GROUPS.replace(" FROM l a JOIN l b ON", " FROM l a JOIN l b ON a.file_size = b.file_size AND").replace("SELECT image_id, rpad", "SELECT image_id, file_size, rpad").replace("(SELECT image_id, regexp", "(SELECT image_id, file_size, regexp").replace("l AS (SELECT image_id, h, g,", "l AS (SELECT image_id, file_size, h, g,")}
 SELECT id, group_id, CASE WHEN id = group_id THEN 'KEEP' ELSE 'DELETE' END AS action FROM m""")
def size_hash_groups(t: Tables) -> DataFrame:
    got = dedup.size_hash_groups(t.photo_index, 6)
    return got.withColumn("action", F.when(F.col("id") == F.col("group_id"), "KEEP").otherwise("DELETE"))


_SHORT = _GROUPS.replace("rpad(x, 64, '0') AS h", "rpad(rpad(x, 64, '0')[:16], 64, '0') AS h").replace("<= 6)", "<= 1)")


@query(f"{_SHORT}, s AS (SELECT * FROM m), w AS ({_GROUPS} SELECT * FROM m) SELECT s.group_id, count(*) AS members, count(DISTINCT w.group_id) + count(*) FILTER (w.group_id IS NULL) AS parts, "
 "CASE WHEN count(DISTINCT w.group_id) + count(*) FILTER (w.group_id IS NULL) = 1 THEN 'kept' ELSE 'split' END AS verdict FROM s LEFT JOIN w ON w.id = s.id GROUP BY s.group_id")
def hash_width_comparison(t: Tables) -> DataFrame:
    """Groups by the first 64 bits of the hash against groups by all of it."""
    short = t.photo_index.withColumn("phash", F.substring(clean_hash("phash"), 1, 16))
    return dedup.compare_groupings(dedup.hash_groups(short, 1), dedup.hash_groups(t.photo_index, 6))


def _report(t: Tables) -> DataFrame:
    return dedup.parse_report(dedup.report_lines(dedup.ranked_groups(dedup.hash_groups(t.photo_index, 6), t.photo_index)))


@query(f"""{_RANKED}, d AS (SELECT file_path FROM k WHERE rank > 1), n AS ({ctes("scan_new")} SELECT * FROM scan_new)
 SELECT (SELECT count(*) FROM d) AS total, (SELECT count(*) FROM d WHERE file_path IN (SELECT file_path FROM n)) AS existing, (SELECT count(*) FROM photo_index WHERE file_path IN (SELECT file_path FROM d)) AS photos""")
def report_deletion(t: Tables) -> DataFrame:
    return dedup.report_deletion(_report(t), t.photo_index, t.scan_new)


@query(f"{_RANKED}, d AS (SELECT file_path FROM k WHERE rank > 1) SELECT image_id FROM photo_index p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.file_path = p.file_path)")
def without_reported(t: Tables) -> DataFrame:
    return dedup.without_reported(_report(t), t.photo_index).select("image_id")


@query(f"""WITH p AS (SELECT image_id, file_path, width, height FROM photo_index WHERE width IS NOT NULL AND height IS NOT NULL),
 c AS (SELECT person_id, face_id, file_path, width, height, bbox_x1::DOUBLE AS a, bbox_y1::DOUBLE AS b, bbox_x2::DOUBLE AS c, bbox_y2::DOUBLE AS d FROM faces JOIN p USING (image_id) WHERE person_id = 7)
 SELECT person_id, face_id, file_path, greatest(0, trunc(a - (c - a) * 0.2::DOUBLE)::INT) AS l, greatest(0, trunc(b - (d - b) * 0.2::DOUBLE)::INT) AS t, least(width, trunc(c + (c - a) * 0.2::DOUBLE)::INT) AS r, least(height, trunc(d + (d - b) * 0.2::DOUBLE)::INT) AS b FROM c""")
def person_crops(t: Tables) -> DataFrame:
    return files.person_crops(t.faces, t.photo_index, 7)


@query(f"""{ctes("scan_new")}, p AS (SELECT file_path AS src, concat('/trash/', CASE WHEN starts_with(file_path, '/photos/') THEN file_path[9:] ELSE file_path END) AS dst FROM photo_index WHERE index_failed)
 SELECT src, CASE WHEN src IN (SELECT file_path FROM scan_new) THEN concat('MOVED ', src, ' -> ', dst) ELSE concat('MISSING ', src) END AS line FROM p""")
def trash_report(t: Tables) -> DataFrame:
    return files.trash_report(files.trash_plan(t.photo_index.filter("index_failed"), "/photos", "/trash"), t.scan_new)


# --- indexing -------------------------------------------------------------------------------------


@query(f"""{ctes("scan_old", "scan_new")}, o AS (SELECT file_path, max(size) AS size FROM scan_old GROUP BY file_path), n AS (SELECT file_path, max(size) AS size FROM scan_new GROUP BY file_path),
 c AS (SELECT n.file_path FROM n LEFT JOIN o ON o.file_path = n.file_path WHERE o.file_path IS NULL OR o.size IS DISTINCT FROM n.size)
 SELECT file_path FROM c UNION SELECT file_path FROM n WHERE file_path NOT IN (SELECT file_path FROM photo_index WHERE ({_V} IS NOT NULL OR index_failed) AND file_path IS NOT NULL)""")
def changed_or_unindexed(t: Tables) -> DataFrame:
    old, new = (x.groupBy("file_path").agg(F.max("size").alias("size")) for x in (t.scan_old, t.scan_new))
    return files.changed_or_unindexed(files.snapshot_diff(old, new, compare=["size"]), new, t.photo_index)


@query(f"""{ctes("change_log")} SELECT count(*) AS changed, (SELECT max(usn) FROM change_log) AS next_usn FROM (SELECT DISTINCT file_key FROM change_log WHERE usn > 100 AND file_key IS NOT NULL)""")
def journal_position(t: Tables) -> DataFrame:
    scan = t.photo_index.select(F.col("image_id").alias("file_key"), F.col("file_size").alias("size"))
    got, nxt = changes.changes_since(t.change_log, 100, scan, scan)
    return got.agg(F.count("*").alias("changed")).withColumn("next_usn", F.lit(nxt))


_NEW_HASH = "CASE WHEN width > height THEN CASE WHEN image_id % 3 = 0 THEN '' ELSE lower(hex(image_id)) END ELSE phash END"


@query(f"SELECT image_id, {_NEW_HASH} AS phash FROM photo_index")
def hashes_updated(t: Tables) -> DataFrame:
    """New hashes of all landscape photos, every third of which could not be read."""
    wide = t.photo_index.filter("width > height")
    hashes = wide.filter("image_id % 3 <> 0").select("image_id", F.lower(F.hex("image_id")).alias("phash"))
    return mu.update_hashes(t.photo_index, hashes, wide.filter("image_id % 3 = 0").select("image_id")).select("image_id", "phash")


@query(f"""WITH n AS (SELECT file_path, any_value(file_size) AS s FROM photo_index WHERE {_V} IS NULL GROUP BY file_path)
 SELECT image_id, CASE WHEN n.s % 2 = 0 THEN false WHEN n.s IS NOT NULL AND {_V} IS NULL THEN true ELSE index_failed END AS index_failed FROM photo_index p LEFT JOIN n ON n.file_path = p.file_path
 WHERE (SELECT count(*) FROM photo_index x WHERE x.file_path = p.file_path) <= 1""")
def index_results(t: Tables) -> DataFrame:
    """The photos without vector are indexed: those of even size succeed, the others fail; copied paths aside."""
    once = t.photo_index.groupBy("file_path").count().filter("count = 1").select("file_path")
    p = t.photo_index.join(once, "file_path", "left_semi").unionByName(t.photo_index.filter("file_path is null"))
    new = p.filter(F.col(_V).isNull() & F.col("file_path").isNotNull() & F.col("file_size").isNotNull())
    even = F.col("file_size") % 2 == 0
    new = new.select("file_path", F.when(even, F.array(F.lit(1.0).cast("float"))).alias(_V), F.when(~even, F.lit("unreadable")).alias("fail_reason"), F.lit(None).cast("string").alias("exif_data"))
    return mu.index_result(p, new).select("image_id", "index_failed")


@query("""SELECT image_id, coalesce(photo_date, created_at) AS photo_date, width FROM photo_index""")
def dates_filled(t: Tables) -> DataFrame:
    """Missing photo dates filled from when the row was made; other columns stay."""
    new = t.photo_index.select("image_id", F.col("created_at").alias("photo_date"))
    return mu.fill_missing(t.photo_index.select("image_id", "photo_date", "width"), new, "image_id", ["photo_date"])


@query("SELECT image_id, CASE WHEN index_failed THEN false ELSE index_failed END AS index_failed, CASE WHEN index_failed THEN NULL ELSE fail_reason END AS fail_reason FROM photo_index")
def failures_reset(t: Tables) -> DataFrame:
    return mu.reset_failures(t.photo_index).select("image_id", "index_failed", "fail_reason")


@query("""SELECT image_id, CASE WHEN image_id = 5 THEN 48.5 ELSE latitude END AS latitude, CASE WHEN image_id = 5 THEN 9.25 ELSE longitude END AS longitude FROM photo_index""")
def photo_edited(t: Tables) -> DataFrame:
    return mu.edit_photo(t.photo_index, 5, {"latitude": 48.5, "longitude": 9.25}).select("image_id", "latitude", "longitude")


@query("""WITH s AS (SELECT width AS w, height AS h FROM photo_index WHERE image_id = (SELECT min(image_id) FROM faces WHERE image_id IN (SELECT image_id FROM photo_index WHERE width > 0 AND height > 0)))
 SELECT face_id, round(h - bbox_y2::DOUBLE, 3) AS x1, round(bbox_x1::DOUBLE, 3) AS y1, round(h - bbox_y1::DOUBLE, 3) AS x2, round(bbox_x2::DOUBLE, 3) AS y2 FROM faces, s
 WHERE image_id = (SELECT min(image_id) FROM faces WHERE image_id IN (SELECT image_id FROM photo_index WHERE width > 0 AND height > 0))""")
def photo_rotated(t: Tables) -> DataFrame:
    """Face boxes of one photo after a quarter turn."""
    this = t.faces.join(t.photo_index.filter("width > 0 and height > 0").select("image_id"), "image_id", "left_semi").agg(F.min("image_id")).first()[0]
    box = [F.col(f"bbox_{x}").cast("double").alias(f"bbox_{x}") for x in ("x1", "y1", "x2", "y2")]
    got = mu.rotate_photo(t.photo_index, t.faces.select("face_id", "image_id", *box), this, 90)[1].filter(F.col("image_id") == this)
    return got.select("face_id", *[F.round(F.col(f"bbox_{x}"), 3).alias(x) for x in ("x1", "y1", "x2", "y2")])


# --- scalar functions -----------------------------------------------------------------------------


@query("""SELECT image_id, replace(CASE WHEN starts_with(lower(replace(file_path, '\\', '/')), '/photos/20') THEN file_path ELSE file_path END, '\\', '/') AS plain,
 CASE WHEN starts_with(lower(replace(file_path, '\\', '/')), '/photos/') THEN concat('/mnt/archive', replace(file_path, '\\', '/')[8:]) ELSE replace(file_path, '\\', '/') END AS mapped,
 CASE WHEN starts_with(file_path, '/photos/') THEN file_path[9:] ELSE file_path END AS below FROM photo_index WHERE file_path IS NOT NULL""")
def path_forms(t: Tables) -> DataFrame:
    p = F.col("file_path")
    return t.photo_index.filter("file_path is not null").select(
        "image_id", F.regexp_replace(p, r"\\", "/").alias("plain"), media.mapped_path(p, "/PHOTOS", "/mnt/archive").alias("mapped"), media.relative_path(p, "/photos").alias("below")
    )


@query("""WITH p AS (SELECT image_id, round(floor(latitude * 1e4::DOUBLE) / 1e4::DOUBLE, 4) AS a, round(floor(longitude * 1e4::DOUBLE) / 1e4::DOUBLE, 4) AS o FROM photo_index
  WHERE NOT isnan(latitude) AND NOT isnan(longitude) AND abs(latitude) < 999 AND abs(longitude) < 999)
 SELECT image_id, CASE WHEN abs(a) <= 90 AND abs(o) <= 180 THEN a END AS lat, CASE WHEN abs(a) <= 90 AND abs(o) <= 180 THEN o END AS lon FROM p""")
def positions_read(t: Tables) -> DataFrame:
    """Positions to the ten-thousandth below, written as a pair, or as a map link for every other photo, and read again."""
    p = t.photo_index.filter("not isnan(latitude) and not isnan(longitude) and abs(latitude) < 999 and abs(longitude) < 999")
    a, o = (F.format_string("%.4f", F.floor(F.col(c) * 1e4) / 1e4) for c in ("latitude", "longitude"))
    text = F.when(F.col("image_id") % 2 == 0, F.concat(a, F.lit(", "), o)).otherwise(F.concat(F.lit("https://maps.example/@"), a, F.lit(","), o, F.lit(",15z")))
    at = media.parse_position(text)
    return p.select("image_id", F.round(at["latitude"], 4).alias("lat"), F.round(at["longitude"], 4).alias("lon"))


@query("""SELECT image_id, round(CASE WHEN latitude < 0 THEN -1 ELSE 1 END * (floor(abs(latitude)) + floor((abs(latitude) * 60) % 60) / 60.0::DOUBLE + 30 / 3600.0::DOUBLE), 5) AS lat
 FROM photo_index WHERE abs(latitude) <= 90""")
def dms_read(t: Tables) -> DataFrame:
    p = t.photo_index.filter("abs(latitude) <= 90")
    a = F.abs("latitude")
    return p.select("image_id", F.round(media.dms_to_decimal(F.floor(a), F.floor((a * 60) % 60), F.lit(30.0), F.when(F.col("latitude") < 0, "S").otherwise("N")), 5).alias("lat"))


@query("SELECT image_id, date_trunc('second', photo_date) AS at FROM photo_index WHERE photo_date IS NOT NULL")
def iso_times_read(t: Tables) -> DataFrame:
    """Times written in the ISO way with a zone, which is dropped, and read again."""
    text = F.concat(F.date_format("photo_date", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("image_id") % 2 == 0, "Z").otherwise("+02:00"))
    return t.photo_index.filter("photo_date is not null").select("image_id", media.iso_timestamp(text).alias("at"))


@query("""SELECT image_id, greatest(1, floor(width * least(1.0::DOUBLE, 400 / greatest(width, height)::DOUBLE)))::INT AS w, greatest(1, floor(height * least(1.0::DOUBLE, 400 / greatest(width, height)::DOUBLE)))::INT AS h
 FROM photo_index WHERE width > 0 AND height > 0""")
def preview_sizes(t: Tables) -> DataFrame:
    s = media.fit_inside(F.col("width"), F.col("height"), 400)
    return t.photo_index.filter("width > 0 and height > 0").select("image_id", s["width"].alias("w"), s["height"].alias("h"))


@query("SELECT image_id, sha1(file_path)[:16] AS k FROM photo_index WHERE file_path IS NOT NULL")
def content_keys(t: Tables) -> DataFrame:
    return t.photo_index.filter("file_path is not null").select("image_id", media.content_key(F.encode("file_path", "UTF-8")).alias("k"))


@query("SELECT tag_id, nullif(lower(trim(name)), '') AS name FROM tag")
def tag_names(t: Tables) -> DataFrame:
    return t.tag.select("tag_id", media.tag_name("name").alias("name"))


@query("SELECT person_id, month(birth_date) = 1 AND day(birth_date) = 1 AND birth_date < DATE '2000-01-01' AS unsure FROM person")
def unsure_births(t: Tables) -> DataFrame:
    return t.person.select("person_id", media.approximate_date(F.col("birth_date")).alias("unsure"))


@query("SELECT doc_id, nullif(trim(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g'))[:256], '') AS v FROM documents")
def values_cleaned(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", media.clean_exif_value(F.col("text")).alias("v"))


@query("""SELECT image_id, CASE WHEN lower(regexp_extract(file_path, '([^/\\\\]*)$', 1)) IN ('thumbs.db', 'desktop.ini', '.ds_store') OR starts_with(regexp_extract(file_path, '([^/\\\\]*)$', 1), '._') THEN 'junk'
 WHEN latitude IS NOT NULL AND longitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0) THEN concat('gps/', coalesce(strftime(photo_date, '%Y/%m'), 'undated'))
 WHEN lower(regexp_extract(regexp_extract(file_path, '([^/\\\\]*)$', 1), '\\.([^.]+)$', 1)) <> '' THEN concat('type/', lower(regexp_extract(regexp_extract(file_path, '([^/\\\\]*)$', 1), '\\.([^.]+)$', 1))) ELSE 'other' END AS route
 FROM photo_index WHERE file_path IS NOT NULL""")
def sorted_routes(t: Tables) -> DataFrame:
    p = t.photo_index.filter("file_path is not null")
    return p.select("image_id", files.sort_route("file_path", "latitude", "longitude", "photo_date").alias("route"))
