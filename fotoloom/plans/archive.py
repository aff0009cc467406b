"""Queries of the photo archive and their SQL twins, in the order of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fotoloom.functions import media, predicates as pr
from fotoloom.functions.vectors import centroids, cosine_to
from fotoloom.operators import dedup, family, membership as mb, mutations as mu, people, search, stats, vector_pairs
from fotoloom.plans.actions import photo_lines
from fotoloom.plans.fixtures import Tables, ctes
from fotoloom.sources import files
from fotoloom.streaming import changes

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the tables under its name, with its SQL twin."""

    def add(f: Callable[[Tables], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, d: f(Tables(spark, d))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_V = "clip_embedding_siglip"
#: EXIF as a JSON object's text, read through one level of JSON string, in the alias j of a first step e.
_EXIF = """e AS (SELECT *, CASE WHEN json_valid(exif_data) THEN CASE WHEN json_type(exif_data) = 'VARCHAR' THEN json_extract_string(exif_data, '$') ELSE exif_data END END AS text FROM photo_index),
 o AS (SELECT *, CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN text END AS j FROM e)"""
_OK = "len({v}) = 128 AND list_max(list_transform({v}, lambda x: abs(x))) > 0"
_PV = f"pv AS (SELECT image_id, {_V}::DOUBLE[] AS v FROM photo_index WHERE {_OK.format(v=_V)})"
_FV = f"fv AS (SELECT face_id, image_id, person_id, face_embedding::DOUBLE[] AS v FROM faces WHERE {_OK.format(v='face_embedding')})"
_HIDDEN = "image_id NOT IN (SELECT image_id FROM photo_tag JOIN tag USING (tag_id) WHERE is_system)"
_GPS = "latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)"
_DIR = "CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END"
_KIND = """CASE WHEN e IS NULL THEN '' WHEN e IN ('jpg', 'jpeg') THEN 'jpg' WHEN e IN ('heic', 'heif') THEN 'heic'
 WHEN e IN ('nef', 'cr2', 'arw', 'dng', 'raf', 'orf', 'rw2') THEN 'raw' ELSE e END"""


def first_vector(t: Tables) -> list[float]:
    """The query vector of the vector queries: that of the smallest image id with a usable one."""
    p = t.photo_index.select("image_id", _V).filter((F.size(_V) == 128) & F.exists(_V, lambda x: x != 0))
    return list(p.orderBy("image_id").first()[_V])


# --- filters, pages -------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT image_id, file_name, lower(file_format) AS fmt, exif_data FROM photo_index
 WHERE photo_date >= '2012-01-01' AND photo_date < TIMESTAMP '2020-12-31' + INTERVAL 1 DAY AND lower(file_format) IN ('jpg', 'heic', 'nef')
 AND latitude BETWEEN -60 AND 70 AND longitude BETWEEN -150 AND 170 AND {_HIDDEN}),
 g AS (SELECT * FROM p ORDER BY image_id DESC LIMIT 100)
 SELECT image_id, file_name, fmt, coalesce(TRY_CAST(CASE WHEN json_valid(exif_data) THEN json_extract_string(exif_data, '$.UserRotation') END AS INT), 0) AS rotation,
 coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM photo_tag JOIN tag USING (tag_id) WHERE photo_tag.image_id = g.image_id), '') AS tags FROM g""")
def filter_search(t: Tables) -> DataFrame:
    spec = search.Spec(date_from="2012-01-01", date_to="2020-12-31", formats=["jpg", ".HEIC", "nef", "exe"], box=(-60, 70, -150, 170), sort="id-desc")
    got = search.filter_search(t.photo_index, spec, t.faces, t.photo_tag, t.tag)
    names = F.array_join(F.array_sort(F.transform("tags", lambda x: x["name"])), ",")
    return got.select("image_id", "file_name", F.lower("file_format").alias("fmt"), "rotation", names.alias("tags"))


@query("""SELECT image_id FROM (SELECT image_id FROM photo_index WHERE photo_date <= TIMESTAMP '2015-06-30 23:59:59' ORDER BY photo_date DESC NULLS LAST, image_id DESC LIMIT 50 OFFSET 20)""")
def date_page(t: Tables) -> DataFrame:
    rows = t.photo_index.filter(pr.in_dates("photo_date", "not a date", "2015-06-30", "inclusive_second")).select("image_id", "photo_date")
    return search.page(rows, search.ordering("date-desc"), 50, 20).select("image_id")


@query("""SELECT image_id FROM photo_index WHERE lower(file_format) IN ('jpg', 'jpeg', 'heic', 'heif')""")
def formats_like(t: Tables) -> DataFrame:
    return t.photo_index.filter(pr.in_formats("file_format", ["jpg", "heic"], "like")).select("image_id")


@query("SELECT image_id FROM photo_index WHERE image_id IN (SELECT image_id FROM faces WHERE person_id IN (2, 7, 108))")
def persons_or(t: Tables) -> DataFrame:
    return pr.having_any(t.photo_index.select("image_id"), t.faces, "person_id", [2, 7, 108])


@query("SELECT image_id FROM photo_index WHERE image_id IN (SELECT image_id FROM faces WHERE person_id IN (2, 7) GROUP BY image_id HAVING count(DISTINCT person_id) = 2)")
def persons_and(t: Tables) -> DataFrame:
    return pr.having_all(t.photo_index.select("image_id"), t.faces, "person_id", [2, 7])


@query("SELECT image_id FROM photo_index WHERE image_id IN (SELECT image_id FROM photo_tag WHERE tag_id IN (4, 5) GROUP BY image_id HAVING count(DISTINCT tag_id) = 2)")
def tags_and(t: Tables) -> DataFrame:
    return pr.having_all(t.photo_index.select("image_id"), t.photo_tag, "tag_id", [4, 5])


@query("SELECT image_id FROM photo_index WHERE image_id NOT IN (SELECT image_id FROM photo_tag WHERE tag_id IN (1, 6))")
def tags_exclude(t: Tables) -> DataFrame:
    return pr.having_none(t.photo_index.select("image_id"), t.photo_tag, "tag_id", [1, 6])


@query(f"SELECT image_id FROM photo_index WHERE {_HIDDEN}")
def hidden_filter(t: Tables) -> DataFrame:
    return pr.visible(t.photo_index.select("image_id"), t.photo_tag, t.tag)


@query("""SELECT image_id FROM photo_index WHERE file_path LIKE '/photos/2021/%' AND image_id IN (SELECT image_id FROM faces WHERE det_score::DOUBLE >= 0.9::DOUBLE)""")
def path_and_candidates(t: Tables) -> DataFrame:
    ids = t.faces.filter("cast(det_score as double) >= 0.9D").select("image_id").distinct()
    return pr.listed(t.photo_index.filter(pr.path_like("file_path", "/photos/2021/*")).select("image_id"), ids)


@query("SELECT image_id FROM photo_index WHERE image_id NOT IN (SELECT image_id FROM photo_tag) AND image_id NOT IN (SELECT image_id FROM faces WHERE image_id IS NOT NULL)")
def untagged_faceless(t: Tables) -> DataFrame:
    return pr.untagged(t.photo_index.select("image_id"), t.photo_tag, t.faces)


@query("SELECT image_id FROM photo_index WHERE photo_date >= '2021-01-01' OR (photo_date IS NULL AND created_at >= '2021-01-01')")
def recent_window(t: Tables) -> DataFrame:
    return t.photo_index.filter(pr.recent("photo_date", "created_at", "2021-01-01")).select("image_id")


@query(f"SELECT image_id FROM photo_index WHERE {_V} IS NULL AND NOT coalesce(index_failed, false)")
def pending_vectors(t: Tables) -> DataFrame:
    return t.photo_index.filter(pr.pending()).select("image_id")


@query("SELECT image_id FROM photo_index WHERE phash IS NULL ORDER BY image_id LIMIT 100")
def pending_hashes(t: Tables) -> DataFrame:
    return t.photo_index.filter("phash is null").select("image_id").orderBy("image_id").limit(100)


@query(f"""SELECT image_id FROM photo_index WHERE NOT ({_GPS}) OR latitude = 0 OR longitude = 0""")
def without_gps(t: Tables) -> DataFrame:
    return t.photo_index.filter(pr.no_gps()).select("image_id")


@query("SELECT person_id, name FROM person WHERE contains(lower(name), 'el')")
def person_search(t: Tables) -> DataFrame:
    return t.person.filter(pr.contains_text("name", "EL")).select("person_id", "name")


@query("""SELECT file_path, image_id FROM photo_index WHERE file_path LIKE '/photos/2021/%' AND file_path NOT LIKE '/photos/2021/%/%'
 OR (starts_with(file_path, '/photos/2020/Fenselton/') AND NOT contains(file_path[length('/photos/2020/Fenselton/') + 1:], '/'))""")
def folder_children(t: Tables) -> DataFrame:
    p = t.photo_index
    return p.filter(pr.in_folder("file_path", "/photos/2021") | pr.in_folder("file_path", "/photos/2020/Fenselton/")).select("file_path", "image_id")


# --- vectors --------------------------------------------------------------------------------------


@query(f"""WITH {_PV}, q AS (SELECT v FROM pv ORDER BY image_id LIMIT 1)
 SELECT image_id, round(list_cosine_similarity(pv.v, q.v), 6) AS similarity FROM pv, q WHERE list_cosine_similarity(pv.v, q.v) >= 0.1
 ORDER BY list_cosine_similarity(pv.v, q.v) DESC, image_id LIMIT 100""")
def vector_topk(t: Tables) -> DataFrame:
    found = search.top_k(t.photo_index, "image_id", _V, first_vector(t), 100, 0.1)
    return found.select("image_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_PV}, q AS (SELECT image_id AS i, v FROM pv ORDER BY image_id LIMIT 1)
 SELECT image_id, round(s, 4) AS similarity FROM (SELECT image_id, list_cosine_similarity(pv.v, q.v) AS s FROM pv, q WHERE image_id <> q.i)
 WHERE s >= 0.01 ORDER BY s DESC, image_id LIMIT 50""")
def similar_by_id(t: Tables) -> DataFrame:
    this = t.photo_index.filter((F.size(_V) == 128) & F.exists(_V, lambda x: x != 0)).agg(F.min("image_id")).first()[0]
    return search.similar_to(t.photo_index, "image_id", _V, this, 50)


@query(f"""WITH {_FV}, q AS (SELECT face_id AS i, v FROM fv ORDER BY face_id LIMIT 1),
 k AS (SELECT face_id, image_id, person_id, list_cosine_similarity(fv.v, q.v) AS s, i FROM fv, q WHERE list_cosine_similarity(fv.v, q.v) >= 0.2 ORDER BY s DESC, face_id LIMIT 10)
 SELECT k.face_id, k.image_id, person.name AS person_name, round(s, 6) AS similarity FROM k JOIN photo_index USING (image_id) LEFT JOIN person USING (person_id)""")
def face_topk(t: Tables) -> DataFrame:
    f = t.faces.filter((F.size("face_embedding") == 128) & F.exists("face_embedding", lambda x: x != 0))
    q = list(f.select("face_id", "face_embedding").orderBy("face_id").first()["face_embedding"])
    got = people.similar_faces(t.faces, t.photo_index, t.person, q, 10, 0.2)
    return got.select("face_id", "image_id", "person_name", F.round("similarity", 6).alias("similarity"))


_SCORED = f"""{_PV}, q AS (SELECT v FROM pv ORDER BY image_id LIMIT 1),
 s AS (SELECT 'SigLIP' AS model, image_id, list_cosine_similarity(pv.v, q.v) AS s FROM pv, q
  UNION ALL SELECT 'ViT-B/32', image_id, list_cosine_similarity(list_reverse(pv.v), q.v) FROM pv, q)"""


def _scored(t: Tables) -> DataFrame:
    """Two models: the stored vectors, and the same with the entries in reverse."""
    q, p = first_vector(t), t.photo_index.select("image_id", _V)
    a = p.select(F.lit("SigLIP").alias("model"), "image_id", cosine_to(_V, q).alias("similarity"))
    b = p.select(F.lit("ViT-B/32").alias("model"), "image_id", cosine_to(F.reverse(_V), q).alias("similarity"))
    return a.unionByName(b)


@query(f"""WITH {_SCORED},
 k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY s DESC, image_id) AS r FROM s WHERE s >= 0.01 QUALIFY r <= 500),
 m AS (SELECT *, max(s) OVER (PARTITION BY model) AS top FROM k WHERE s >= CASE model WHEN 'SigLIP' THEN 0.06 ELSE 0.18 END),
 c AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY s DESC, image_id) AS n FROM m WHERE s >= top * 0.65),
 f AS (SELECT image_id, sum(1.0::DOUBLE / (60 + n)) AS rrf, count(*) AS votes, max(greatest(0.0, least(1.0, CASE model WHEN 'SigLIP' THEN (s - 0.06) / 0.32 ELSE (s - 0.18) / 0.27 END))) AS best FROM c GROUP BY image_id)
 SELECT image_id, round(rrf, 6) AS rrf, votes, round(best, 4) AS best FROM f WHERE rrf >= 0.35 * (SELECT max(rrf) FROM f) ORDER BY rrf DESC, image_id LIMIT 300""")
def rrf_search(t: Tables) -> DataFrame:
    got = search.fuse_ranks(_scored(t))
    return got.select("image_id", F.round("rrf", 6).alias("rrf"), "votes", F.round("best", 4).alias("best"))


@query(f"""WITH {_PV}, q AS (SELECT v FROM pv ORDER BY image_id LIMIT 1), s AS (SELECT image_id, list_cosine_similarity(pv.v, q.v) AS s FROM pv, q)
 SELECT image_id, round(s, 6) AS similarity FROM s WHERE s >= 0.1 AND s >= 0.3 * (SELECT max(s) FROM s WHERE s >= 0.1)""")
def adaptive_search(t: Tables) -> DataFrame:
    s = t.photo_index.select("image_id", cosine_to(_V, first_vector(t)).alias("similarity"))
    return search.adaptive_cut(s, 0.3, 0.1).select("image_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_PV}, q AS (SELECT v FROM pv ORDER BY image_id LIMIT 1),
 h AS (SELECT image_id FROM faces WHERE person_id = 7)
 SELECT image_id, round(list_cosine_similarity(pv.v, q.v), 6) AS similarity FROM pv, q WHERE image_id IN (SELECT image_id FROM h)
 ORDER BY list_cosine_similarity(pv.v, q.v) DESC, image_id LIMIT 40""")
def person_then_vector(t: Tables) -> DataFrame:
    photos = pr.having_any(t.photo_index.select("image_id", _V), t.faces, "person_id", [7])
    return search.top_k(photos, "image_id", _V, first_vector(t), 40).select("image_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_PV}, q AS (SELECT v FROM pv ORDER BY image_id LIMIT 1), s AS (SELECT image_id, list_cosine_similarity(pv.v, q.v) AS s FROM pv, q ORDER BY s DESC, image_id LIMIT 60),
 r AS (SELECT image_id, row_number() OVER (ORDER BY s DESC, image_id) AS rank FROM s)
 SELECT rank, image_id, file_name, round(1.0 - (rank - 1) / (2.0 * (SELECT count(*) FROM r)), 4) AS similarity FROM r JOIN photo_index USING (image_id) WHERE {_HIDDEN}""")
def ranked_lookup(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    best = search.top_k(t.photo_index, "image_id", _V, first_vector(t), 60)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "image_id"))).drop("similarity")  # 60 rows
    got = search.in_rank_order(t.photo_index.select("image_id", "file_name"), ranked)
    return pr.visible(got, t.photo_tag, t.tag).select(F.col("rank").cast("bigint").alias("rank"), "image_id", "file_name", "similarity")


@query(f"""WITH e AS (SELECT person_id, unnest(range(1, 129)) AS i, unnest(face_embedding::DOUBLE[]) AS x FROM faces WHERE person_id IS NOT NULL AND len(face_embedding) = 128)
 SELECT person_id, i AS place, floor(avg(x) * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT AS mean_millionths FROM e GROUP BY person_id, i""")
def person_centroids(t: Tables) -> DataFrame:
    c = centroids(t.faces, "person_id", "face_embedding", 128)
    return c.select("person_id", F.posexplode("centroid").alias("i", "x")).select("person_id", (F.col("i") + 1).cast("bigint").alias("place"), F.floor(F.col("x") * 1e6 + 0.5).alias("mean_millionths"))


@query(f"""WITH {_FV}, e AS (SELECT person_id, unnest(range(1, 129)) AS i, unnest(face_embedding::DOUBLE[]) AS x FROM faces WHERE person_id IS NOT NULL AND len(face_embedding) = 128),
 a AS (SELECT person_id, i, avg(x) AS x FROM e GROUP BY person_id, i), c AS (SELECT person_id AS p, list(x ORDER BY i) AS c FROM a GROUP BY person_id HAVING max(abs(x)) > 0)
 SELECT face_id, min(p) AS person_id FROM fv, c WHERE person_id IS NULL AND list_cosine_similarity(fv.v, c.c) >= 0.5 GROUP BY face_id""")
def centroid_assign(t: Tables) -> DataFrame:
    """All persons in turn."""
    return people.assign_by_centroid(t.faces)


@query(f"""WITH {_FV}, e AS (SELECT unnest(range(1, 129)) AS i, unnest(face_embedding::DOUBLE[]) AS x FROM faces WHERE person_id = 7 AND len(face_embedding) = 128),
 c AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM e GROUP BY i))
 SELECT face_id, 7::BIGINT AS person_id FROM fv, c WHERE person_id IS NULL AND list_cosine_similarity(fv.v, c.c) >= 0.5""")
def centroid_assign_person(t: Tables) -> DataFrame:
    """The faces one person gains."""
    return people.assign_by_centroid(t.faces, [7])


# --- joins and memberships ------------------------------------------------------------------------


@query("""SELECT p.person_id, p.name, count(f.face_id) AS face_count, count(DISTINCT f.image_id) AS photo_count,
 coalesce(p.cover_face_id, (SELECT face_id FROM faces b WHERE b.person_id = p.person_id ORDER BY coalesce(det_score, -1) DESC, face_id LIMIT 1)) AS cover_face_id
 FROM person p LEFT JOIN faces f USING (person_id) GROUP BY p.person_id, p.name, p.cover_face_id""")
def person_stats(t: Tables) -> DataFrame:
    return people.person_stats(t.person, t.faces).drop("best_face_id")


@query("""SELECT person_id, old_cover, new_cover FROM (SELECT p.person_id, p.cover_face_id AS old_cover,
 (SELECT face_id FROM faces b WHERE b.person_id = p.person_id ORDER BY coalesce(det_score, -1) DESC, face_id LIMIT 1) AS new_cover FROM person p) WHERE old_cover IS DISTINCT FROM new_cover""")
def person_cover(t: Tables) -> DataFrame:
    return people.reassigned_covers(t.person, t.faces)


@query("SELECT image_id, file_path, count(*) AS faces FROM faces JOIN photo_index USING (image_id) WHERE person_id = 7 GROUP BY image_id, file_path")
def person_photos(t: Tables) -> DataFrame:
    return people.photos_of(7, t.faces, t.photo_index).drop("photo_date")


@query("SELECT person_id, face_id, row_number() OVER (PARTITION BY person_id ORDER BY det_score DESC NULLS LAST, face_id) AS rank FROM faces WHERE person_id IS NOT NULL QUALIFY rank <= 5")
def sample_faces(t: Tables) -> DataFrame:
    return people.sample_faces(t.faces).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""{ctes("album", "album_photo")} SELECT album_id, title, count(DISTINCT image_id) AS photo_count FROM album LEFT JOIN album_photo USING (album_id)
 WHERE user_id = 5 OR is_public GROUP BY album_id, title""")
def album_list(t: Tables) -> DataFrame:
    return mb.album_list(t.album, t.album_photo, 5).select("album_id", "title", "photo_count")


@query(f"""{ctes("album_photo")} SELECT image_id, sort_order, file_name FROM album_photo JOIN photo_index USING (image_id) WHERE album_id = 3 AND {_HIDDEN}""")
def album_photos(t: Tables) -> DataFrame:
    rows = pr.visible(mb.album_photos(3, t.album_photo, t.photo_index), t.photo_tag, t.tag)
    return rows.select("image_id", "sort_order", "file_name")


@query(f"""{ctes("album_photo")}, h AS (SELECT image_id FROM album_photo WHERE album_id = 3)
 SELECT 3 AS album_id, image_id, (SELECT coalesce(max(sort_order), 0) FROM album_photo WHERE album_id = 3) + row_number() OVER (ORDER BY image_id) AS sort_order
 FROM (SELECT DISTINCT image_id FROM faces WHERE person_id = 2) WHERE image_id NOT IN (SELECT image_id FROM h)""")
def album_append(t: Tables) -> DataFrame:
    want = t.faces.filter("person_id = 2").select("image_id", F.col("image_id").alias("position"))
    got = mb.appended(3, want, t.album_photo)
    return got.select(F.col("album_id").cast("int").alias("album_id"), "image_id", F.col("sort_order").cast("bigint").alias("sort_order"))


@query("SELECT tag_id, name, is_system, count(DISTINCT image_id) AS photos FROM tag LEFT JOIN photo_tag USING (tag_id) GROUP BY ALL")
def tag_counts(t: Tables) -> DataFrame:
    return mb.tag_counts(t.tag, t.photo_tag)


@query("SELECT tag_id, name FROM tag WHERE NOT is_system AND tag_id IN (SELECT tag_id FROM photo_tag WHERE image_id = (SELECT min(image_id) FROM photo_tag))")
def photo_tags(t: Tables) -> DataFrame:
    this = t.photo_tag.agg(F.min("image_id")).first()[0]
    return mb.tags_of(this, t.photo_tag, t.tag, viewer_is_admin=False).select("tag_id", "name")


@query(f"""{ctes("section", "api_function")} SELECT DISTINCT user_id, function_code FROM app_user, api_function JOIN section USING (section_code)
 WHERE NOT is_admin AND NOT is_public AND NOT admin_only""")
def default_grants(t: Tables) -> DataFrame:
    return mb.default_grants(t.app_user, t.section, t.api_function)


@query(f"""{ctes("grants")} SELECT user_id, 'albums.view' AS function_code FROM app_user WHERE user_id NOT IN (SELECT user_id FROM grants WHERE function_code = 'albums.view')""")
def missing_grants(t: Tables) -> DataFrame:
    return mb.missing_grants(t.app_user, t.grants, "albums.view")


@query(f"""{ctes("section", "api_function")} SELECT section_code, string_agg(function_code, ',' ORDER BY function_code) AS functions FROM section JOIN api_function USING (section_code) GROUP BY section_code""")
def section_functions(t: Tables) -> DataFrame:
    rows = t.api_function.groupBy("section_code").agg(F.array_join(F.array_sort(F.collect_list("function_code")), ",").alias("functions"))
    return rows.join(t.section.select("section_code"), "section_code")


@query(f"""{ctes("section", "api_function", "grants")}, a AS (SELECT user_id, is_admin, event_type, event_id FROM events JOIN app_user USING (user_id)),
 r AS (SELECT *, CASE event_type WHEN 'click' THEN 'faces.view' WHEN 'purchase' THEN 'albums.view' WHEN 'view' THEN 'search.text' END AS f FROM a)
 SELECT event_id, f IS NULL OR is_admin OR coalesce(is_public, false) OR g.user_id IS NOT NULL AS allowed FROM r
 LEFT JOIN api_function ON function_code = f LEFT JOIN section USING (section_code) LEFT JOIN (SELECT DISTINCT * FROM grants) g ON g.user_id = r.user_id AND g.function_code = f""")
def route_permissions(t: Tables) -> DataFrame:
    rules = [("/faces/click", "faces.view"), ("/albums/purchase", "albums.view"), ("/search/view", "search.text")]
    path = F.when(F.col("event_type") == "click", "/faces/click").when(F.col("event_type") == "purchase", "/albums/purchase").when(F.col("event_type") == "view", "/search/view").otherwise("/other")
    r = t.events.select("event_id", "user_id", mb.route_function(path, rules).alias("function_code")).join(t.app_user.select("user_id", "is_admin"), "user_id")
    f = t.api_function.join(t.section, "section_code").select("function_code", "is_public")
    g = t.grants.distinct().withColumn("granted", F.lit(True))
    r = r.join(f, "function_code", "left").join(g, ["user_id", "function_code"], "left")
    return r.select("event_id", mb.allowed(F.col("function_code"), F.col("is_admin"), F.col("is_public"), F.col("granted")).alias("allowed"))


_REL = """rel AS (SELECT DISTINCT person_id_from AS a, person_id_to AS b, lower(trim(relation_type)) AS kind FROM person_relation
 WHERE person_id_from IS NOT NULL AND person_id_to IS NOT NULL AND relation_type IS NOT NULL AND person_id_from <> person_id_to), par AS (SELECT a, b FROM rel WHERE kind = 'parent')"""


@query(f"WITH {_REL} SELECT DISTINCT x.b AS person_id, y.b AS sibling_id FROM par x JOIN par y ON x.a = y.a WHERE x.b <> y.b")
def siblings(t: Tables) -> DataFrame:
    return family.siblings(t.person_relation)


@query(f"WITH {_REL} SELECT DISTINCT x.a AS person_id, y.b AS grandchild_id FROM par x JOIN par y ON x.b = y.a")
def grandchildren(t: Tables) -> DataFrame:
    return family.grandchildren(t.person_relation)


@query(f"""WITH {_REL} SELECT DISTINCT * FROM (SELECT a AS person_id, CASE kind WHEN 'parent' THEN 'child' WHEN 'spouse' THEN 'spouse' END AS role, b AS other_id FROM rel
 UNION ALL SELECT b, CASE kind WHEN 'parent' THEN 'parent' WHEN 'spouse' THEN 'spouse' END, a FROM rel) WHERE role IS NOT NULL""")
def family_context(t: Tables) -> DataFrame:
    return family.family_context(t.person_relation)


@query(f"""WITH {_REL} SELECT direction, kind AS relation_type, other_id, name FROM (SELECT 'to' AS direction, kind, b AS other_id FROM rel WHERE a = 2
 UNION ALL SELECT 'from', kind, a FROM rel WHERE b = 2) LEFT JOIN person ON person_id = other_id""")
def relations_of_person(t: Tables) -> DataFrame:
    return family.relations_of(2, t.person_relation, t.person)


# --- aggregates -----------------------------------------------------------------------------------


@query(f"""SELECT count(*) AS photos, count({_V}) AS with_vector, count(*) FILTER (length(phash) > 0) AS with_hash, count(*) FILTER (index_failed) AS failed,
 count(*) FILTER ({_V} IS NULL AND NOT coalesce(index_failed, false)) AS pending, (SELECT count(*) FROM faces) AS faces FROM photo_index""")
def photo_stats(t: Tables) -> DataFrame:
    return stats.archive_stats(t.photo_index, t.faces)


@query(f"""WITH v AS (SELECT 'SigLIP' AS model, {_V} AS e FROM photo_index UNION ALL SELECT 'face', face_embedding FROM faces UNION ALL SELECT 'none', NULL FROM tag)
 SELECT model, count(*) AS photos FROM v WHERE e IS NOT NULL GROUP BY model""")
def model_coverage(t: Tables) -> DataFrame:
    a = t.photo_index.select("image_id", F.lit("SigLIP").alias("model"), F.col(_V).alias("embedding"))
    b = t.faces.select("image_id", F.lit("face").alias("model"), F.col("face_embedding").alias("embedding"))
    c = t.tag.select(F.lit(None).cast("bigint").alias("image_id"), F.lit("none").alias("model"), F.lit(None).cast("array<float>").alias("embedding"))
    return stats.model_coverage(a.unionByName(b).unionByName(c))


@query(f"""SELECT count(*) AS total, count(*) FILTER ({_GPS}) AS with_gps, count(photo_date) AS with_date, round(100.0 * count(*) FILTER ({_GPS}) / count(*), 1) AS gps_percent,
 round(100.0 * count(photo_date) / count(*), 1) AS date_percent, min(photo_date)::DATE AS first_day, max(photo_date)::DATE AS last_day,
 min(latitude) FILTER ({_GPS}) AS min_lat, max(latitude) FILTER ({_GPS}) AS max_lat, min(longitude) FILTER ({_GPS}) AS min_lon, max(longitude) FILTER ({_GPS}) AS max_lon FROM photo_index""")
def map_stats(t: Tables) -> DataFrame:
    return stats.map_stats(t.photo_index)


@query(f"""WITH g AS (SELECT *, {_GPS} AND latitude <> 0 AND longitude <> 0 AS ok FROM photo_index) SELECT count(*) AS total, count(*) FILTER (ok) AS with_gps,
 count(*) FILTER (NOT coalesce(ok, false)) AS without_gps, count(*) FILTER (latitude = 0 AND longitude = 0) AS zero_gps FROM g""")
def position_stats(t: Tables) -> DataFrame:
    return stats.position_stats(t.photo_index)


@query("SELECT count(*) AS total, count(*) FILTER (phash <> '') AS done, count(*) FILTER (phash IS NULL) AS pending, count(*) FILTER (phash = '') AS failed FROM photo_index")
def hash_progress(t: Tables) -> DataFrame:
    return stats.hash_progress(t.photo_index)


@query(f"SELECT count(*) AS total, count({_V}) AS indexed, count(*) FILTER ({_V} IS NULL AND NOT coalesce(index_failed, false)) AS pending, round(100.0 * count({_V}) / count(*), 1) AS percent FROM photo_index")
def index_progress(t: Tables) -> DataFrame:
    return stats.index_progress(t.photo_index)


@query("""SELECT count(*) AS total, count(person_id) AS assigned, count(*) - count(person_id) AS unassigned, count(DISTINCT person_id) AS persons,
 count(DISTINCT image_id) AS photos, round(100.0 * count(person_id) / count(*), 1) AS percent FROM faces""")
def face_stats(t: Tables) -> DataFrame:
    return stats.face_stats(t.faces)


@query(f"SELECT count(*) AS total, round(100.0 * count(exif_data) / count(*), 1) AS exif_percent, round(100.0 * count(*) FILTER ({_GPS}) / count(*), 1) AS gps_percent, round(100.0 * count(photo_date) / count(*), 1) AS date_percent FROM photo_index")
def exif_fill(t: Tables) -> DataFrame:
    return stats.exif_fill(t.photo_index)


@query("SELECT image_id, file_path, fail_reason, (SELECT count(*) FROM photo_index WHERE index_failed) AS total_failed FROM photo_index WHERE index_failed ORDER BY image_id LIMIT 100")
def failed_files(t: Tables) -> DataFrame:
    return stats.failed_files(t.photo_index)


@query(f"""WITH g AS (SELECT *, floor(latitude / 5.0)::BIGINT AS y, floor(longitude / 5.0)::BIGINT AS x FROM photo_index WHERE {_GPS})
 SELECT y AS cell_y, x AS cell_x, count(*) AS photos, floor(sum(round(latitude * 1e6::DOUBLE)::BIGINT)::DOUBLE / count(*) + 0.5::DOUBLE) / 1e6::DOUBLE AS lat, floor(sum(round(longitude * 1e6::DOUBLE)::BIGINT)::DOUBLE / count(*) + 0.5::DOUBLE) / 1e6::DOUBLE AS lon, min(image_id) AS preview_id,
 y * 5.0::DOUBLE AS min_lat, (y + 1) * 5.0::DOUBLE AS max_lat, x * 5.0::DOUBLE AS min_lon, (x + 1) * 5.0::DOUBLE AS max_lon FROM g GROUP BY y, x""")
def grid_clusters(t: Tables) -> DataFrame:
    return stats.grid_clusters(t.photo_index, 4)


@query(f"""WITH p AS (SELECT regexp_replace(file_path, '\\\\', '/', 'g') AS p FROM photo_index WHERE (NOT ({_GPS}) OR latitude = 0 OR longitude = 0) AND lower(file_format) IN ('jpg', 'jpeg'))
 SELECT {_DIR} AS folder, count(*) AS photos FROM p GROUP BY folder""")
def folder_counts(t: Tables) -> DataFrame:
    return stats.folder_counts(t.photo_index, ["jpg"])


@query("SELECT strftime(photo_date, '%Y-%m') AS month, count(*) AS photos FROM photo_index WHERE photo_date IS NOT NULL GROUP BY month")
def timeline_months(t: Tables) -> DataFrame:
    return stats.timeline(t.photo_index)


@query(f"""SELECT image_id, (SELECT count(*) FROM photo_index WHERE photo_date >= '2018-01-01' AND photo_date <= '2019-12-31 23:59:59' AND {_HIDDEN}) AS total
 FROM photo_index WHERE photo_date >= '2018-01-01' AND photo_date <= '2019-12-31 23:59:59' AND {_HIDDEN} ORDER BY photo_date DESC, image_id DESC LIMIT 60""")
def timeline_page(t: Tables) -> DataFrame:
    rows = t.photo_index.filter(pr.in_dates("photo_date", "2018-01-01", "2019-12-31", "inclusive_second")).select("image_id", "photo_date")
    rows = pr.visible(rows, t.photo_tag, t.tag)
    got = search.page(rows, search.ordering("date-desc"), 60)
    return got.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).select("image_id", "total")


# --- scalar functions -----------------------------------------------------------------------------


@query(rf"""WITH p AS (SELECT image_id, regexp_replace(file_path, '\\', '/', 'g') AS p, file_size FROM photo_index),
 n AS (SELECT *, regexp_extract(p, '([^/]*)$', 1) AS base_name FROM p), x AS (SELECT *, lower(regexp_extract(base_name, '\.([^.]+)$', 1)) AS e FROM n)
 SELECT image_id, base_name, {_DIR} AS folder, e AS ext, {_KIND} AS kind, CASE WHEN file_size < 1024 THEN printf('%d B', file_size) WHEN file_size < 1048576 THEN printf('%.1f KB', file_size / 1024.0::DOUBLE)
 WHEN file_size < 1073741824 THEN printf('%.1f MB', file_size / 1048576.0::DOUBLE) ELSE printf('%.1f GB', file_size / 1073741824.0::DOUBLE) END AS shown FROM x WHERE file_size IS NOT NULL""")
def file_facts(t: Tables) -> DataFrame:
    p = F.col("file_path")
    return t.photo_index.filter("file_size is not null").select(
        "image_id", media.base_name(p).alias("base_name"), media.dir_name(p).alias("folder"), media.extension(p).alias("ext"),
        media.format_group(media.extension(p)).alias("kind"), media.human_size(F.col("file_size")).alias("shown"),
    )


@query(rf"""WITH {_EXIF}, j AS (SELECT image_id, width, height, j, regexp_replace(lower(trim(file_format)), '^\.', '') AS f FROM o WHERE width IS NOT NULL AND height IS NOT NULL),
 s AS (SELECT *, (coalesce(TRY_CAST(json_extract_string(j, '$.Orientation') AS INT) BETWEEN 5 AND 8, false) AND coalesce(f, '') NOT IN ('nef', 'cr2', 'arw', 'dng', 'raf', 'orf', 'rw2'))
  <> (coalesce(TRY_CAST(json_extract_string(j, '$.UserRotation') AS INT), 0) IN (90, 270)) AS swap FROM j)
 SELECT image_id, height AS width, width AS height FROM s WHERE swap AND width <> height""")
def fixed_sizes(t: Tables) -> DataFrame:
    return mu.fixed_sizes(t.photo_index.withColumn("exif_data", media.exif_object("exif_data")))


@query("""SELECT face_id, greatest(0, trunc(x1 - dx)::INT) AS l, greatest(0, trunc(y1 - dy)::INT) AS t, least(width, trunc(x2 + dx)::INT) AS r, least(height, trunc(y2 + dy)::INT) AS b
 FROM (SELECT face_id, bbox_x1::DOUBLE AS x1, bbox_y1::DOUBLE AS y1, bbox_x2::DOUBLE AS x2, bbox_y2::DOUBLE AS y2, (bbox_x2::DOUBLE - bbox_x1) * 0.2::DOUBLE AS dx, (bbox_y2::DOUBLE - bbox_y1) * 0.2::DOUBLE AS dy, image_id FROM faces)
 JOIN photo_index USING (image_id) WHERE width IS NOT NULL AND height IS NOT NULL""")
def face_crops(t: Tables) -> DataFrame:
    f = t.faces.select("face_id", "image_id", *[F.col(f"bbox_{x}").cast("double").alias(x) for x in ("x1", "y1", "x2", "y2")])
    p = t.photo_index.filter("width is not null and height is not null").select("image_id", "width", "height")
    box = media.crop_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")])
    return f.join(p, "image_id").select("face_id", box.alias("b")).select("face_id", F.col("b.left").alias("l"), F.col("b.top").alias("t"), F.col("b.right").alias("r"), F.col("b.bottom").alias("b"))


# --- hashes and duplicates ------------------------------------------------------------------------

_HASH = rf"""h AS (SELECT image_id, rpad(x, 64, '0') AS h, {_KIND} AS g FROM (SELECT image_id, regexp_replace(lower(phash), '^\s*(0x)?|\s+$', '', 'g') AS x,
  lower(regexp_extract(file_path, '\.([^./]+)$', 1)) AS e FROM photo_index) WHERE regexp_full_match(x, '[0-9a-f]{{1,64}}')),
 l AS (SELECT image_id, h, g, [('0x' || h[i + 1 : i + 16])::UBIGINT FOR i IN [0, 16, 32, 48]] AS v FROM h),
 pairs AS (SELECT a.image_id AS id1, b.image_id AS id2, list_sum([bit_count(xor(a.v[i], b.v[i])) FOR i IN [1, 2, 3, 4]])::INT AS distance FROM l a JOIN l b ON a.image_id < b.image_id AND a.g = b.g
  WHERE list_sum([bit_count(xor(a.v[i], b.v[i])) FOR i IN [1, 2, 3, 4]]) <= 6)"""


_COPIES = "SELECT min(id1) AS id1, id2 FROM pairs WHERE distance = 0 GROUP BY id2"


@query(f"WITH {_HASH} {_COPIES}")
def phash_exact_pairs(t: Tables) -> DataFrame:
    """Each photo of the same hash as one of a smaller id, with the smallest of them."""
    return dedup.hash_pairs(t.photo_index, 0, expand=False).select("id1", "id2")


@query(f"""WITH {_HASH}, c AS ({_COPIES}) SELECT id1, id2, distance FROM pairs WHERE id1 NOT IN (SELECT id2 FROM c) AND id2 NOT IN (SELECT id2 FROM c)
 UNION ALL SELECT id1, id2, 0 FROM c""")
def phash_near_pairs(t: Tables) -> DataFrame:
    """All pairs of different hashes by their smallest photos, and each copy with the smallest photo of its hash."""
    return dedup.hash_pairs(t.photo_index, 6, expand=False)


@query(f"""WITH {_HASH.replace("AND a.g = b.g", "")}, c AS ({_COPIES}) SELECT id1, id2, distance FROM pairs WHERE id1 NOT IN (SELECT id2 FROM c) AND id2 NOT IN (SELECT id2 FROM c)
 UNION ALL SELECT id1, id2, 0 FROM c""")
def phash_near_pairs_all_types(t: Tables) -> DataFrame:
    return dedup.hash_pairs(t.photo_index, 6, same_format=False, expand=False)


_GROUPS = f"""WITH RECURSIVE {_HASH}, e AS (SELECT id1 AS a, id2 AS b FROM pairs UNION ALL SELECT id2, id1 FROM pairs),
 r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a AS id, least(a, min(b)) AS group_id FROM r GROUP BY a)"""


@query(f"{_GROUPS} SELECT id, group_id FROM m")
def duplicate_groups(t: Tables) -> DataFrame:
    return dedup.hash_groups(t.photo_index, 6)


def _ranked(t: Tables) -> DataFrame:
    return dedup.ranked_groups(dedup.hash_groups(t.photo_index, 6), t.photo_index)


_RANKED = f"""{_GROUPS}, k AS (SELECT group_id, id, file_path, file_size, row_number() OVER (PARTITION BY group_id ORDER BY file_size DESC NULLS LAST, file_path, id) AS rank
 FROM m JOIN photo_index ON image_id = id)"""


@query(f"{_RANKED} SELECT group_id, id, rank, CASE WHEN rank = 1 THEN 'KEEP' ELSE 'DELETE' END AS action FROM k")
def duplicate_ranking(t: Tables) -> DataFrame:
    return _ranked(t).select("group_id", "id", F.col("rank").cast("bigint").alias("rank"), "action")


@query(f"{_RANKED} SELECT count(DISTINCT group_id) AS groups, count(*) FILTER (rank > 1) AS surplus, round(coalesce(sum(file_size) FILTER (rank > 1), 0) / 1048576.0::DOUBLE, 1) AS surplus_mb FROM k")
def duplicate_stats(t: Tables) -> DataFrame:
    return dedup.group_stats(_ranked(t))


@query(f"{_RANKED} SELECT group_id, CASE WHEN rank = 1 THEN 'KEEP' ELSE 'DELETE' END AS action, file_path FROM k")
def report_round_trip(t: Tables) -> DataFrame:
    """A report written as lines and read again."""
    return dedup.parse_report(dedup.report_lines(_ranked(t))).select("group_id", "action", "file_path")


@query("""WITH s AS (SELECT image_id AS id, file_size, regexp_replace(lower(trim(file_format)), '^\\.', '') AS e FROM photo_index WHERE file_size IS NOT NULL),
 k AS (SELECT id, file_size, """ + _KIND + """ AS kind FROM s) SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY file_size, kind) AS n FROM k) WHERE n > 1""")
def size_buckets(t: Tables) -> DataFrame:
    return dedup.size_buckets(t.photo_index)


@query(f"""WITH {_HASH}, z AS (SELECT image_id FROM photo_index WHERE latitude = 0 AND longitude = 0), d AS (SELECT image_id, latitude, longitude FROM photo_index WHERE {_GPS} AND NOT (latitude = 0 AND longitude = 0)),
 b AS (SELECT id1 AS t, id2 AS d, distance FROM pairs UNION ALL SELECT id2, id1, distance FROM pairs)
 SELECT t AS image_id, d AS donor_id, latitude, longitude, distance FROM (SELECT b.t, b.d, b.distance, d.latitude, d.longitude, row_number() OVER (PARTITION BY b.t ORDER BY distance, b.d) AS r
  FROM b JOIN z ON z.image_id = b.t JOIN d ON d.image_id = b.d) WHERE r = 1""")
def gps_transfer(t: Tables) -> DataFrame:
    return dedup.transfer_positions(t.photo_index)


_COS = "array_cosine_similarity(a.v, b.v)"


@query(f"""WITH v AS (SELECT image_id, lower(file_format) AS f, {_V}::DOUBLE[128] AS v FROM photo_index WHERE {_OK.format(v=_V)}),
 c AS (SELECT a.image_id AS q, b.image_id AS p, a.f = b.f AS same, {_COS} AS s FROM v a JOIN v b ON a.image_id <> b.image_id WHERE {_COS} >= 0.98),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS r FROM c) WHERE r <= 10)
 SELECT DISTINCT least(q, p) AS id1, greatest(q, p) AS id2 FROM k WHERE same""")
def knn_pairs(t: Tables) -> DataFrame:
    return vector_pairs.duplicate_pairs(t.photo_index, _V).select("id1", "id2")


@query(f"""{_RANKED}, p AS (SELECT image_id, v FROM l) SELECT k.file_path, list_sum([bit_count(xor(a.v[i], b.v[i])) FOR i IN [1, 2, 3, 4]])::INT AS distance,
 list_sum([bit_count(xor(a.v[i], b.v[i])) FOR i IN [1, 2, 3, 4]]) > 3 AS restore FROM k JOIN k t ON t.group_id = k.group_id AND t.rank = 1 JOIN p a ON a.image_id = k.id JOIN p b ON b.image_id = t.id
 WHERE k.rank > 1 AND k.file_path IN (SELECT file_path FROM photo_index GROUP BY file_path HAVING count(*) = 1) AND t.file_path IN (SELECT file_path FROM photo_index GROUP BY file_path HAVING count(*) = 1)""")
def report_check(t: Tables) -> DataFrame:
    """Each DELETE of a report against its KEEP; only paths that stand for one photo."""
    once = t.photo_index.groupBy("file_path").count().filter("count = 1").select("file_path")
    photos = t.photo_index.join(once, "file_path", "left_semi")
    got = dedup.verify_report(dedup.parse_report(dedup.report_lines(_ranked(t))), photos, 3)
    return got.filter("distance is not null")


@query(f"""{_GROUPS}, x AS (SELECT group_no AS g, image_id AS id FROM dup_report WHERE group_no IS NOT NULL AND image_id IS NOT NULL GROUP BY ALL)
 SELECT g AS group_id, count(*) AS members, count(DISTINCT group_id) + count(DISTINCT CASE WHEN group_id IS NULL THEN x.id END) AS parts,
 CASE WHEN count(DISTINCT group_id) + count(DISTINCT CASE WHEN group_id IS NULL THEN x.id END) = 1 THEN 'kept' ELSE 'split' END AS verdict FROM x LEFT JOIN m ON m.id = x.id GROUP BY g""")
def group_comparison(t: Tables) -> DataFrame:
    old = t.dup_report.select(F.col("group_no").alias("group_id"), F.col("image_id").alias("id")).dropna().distinct()
    return dedup.compare_groupings(old, dedup.hash_groups(t.photo_index, 6))


_AT = f"""x AS (SELECT DISTINCT group_no AS g, image_id, latitude, longitude, {_GPS} AND NOT (latitude = 0 AND longitude = 0) AS ok FROM dup_report JOIN photo_index USING (image_id) WHERE group_no IS NOT NULL)"""


@query(f"""WITH {_AT} SELECT x.image_id AS id, d.latitude, d.longitude FROM x JOIN (SELECT g, arg_min(latitude, image_id) AS latitude, arg_min(longitude, image_id) AS longitude FROM x WHERE ok GROUP BY g) d USING (g)
 WHERE x.latitude = 0 AND x.longitude = 0""")
def group_positions(t: Tables) -> DataFrame:
    m = t.dup_report.select(F.col("group_no").alias("group_id"), F.col("image_id").alias("id")).dropna().distinct()
    return dedup.share_positions(m, t.photo_index)


@query(f"""WITH {_AT} SELECT g AS group_id FROM x GROUP BY g HAVING NOT bool_or(coalesce(ok, false))""")
def groups_without_position(t: Tables) -> DataFrame:
    m = t.dup_report.select(F.col("group_no").alias("group_id"), F.col("image_id").alias("id")).dropna().distinct()
    return dedup.groups_without_position(m, t.photo_index)


@query(f"""WITH {_FV}, q AS (SELECT face_id AS q, v AS qv FROM fv WHERE person_id IS NULL AND image_id = (SELECT min(image_id) FROM faces WHERE person_id IS NULL))
 SELECT q AS face_id, arg_max(person_id, (s, -face_id)) AS person_id FROM (SELECT q, face_id, person_id, list_cosine_similarity(v, qv) AS s FROM fv, q WHERE person_id IS NOT NULL) WHERE s >= 0.3 GROUP BY q""")
def nearest_assign(t: Tables) -> DataFrame:
    this = t.faces.filter("person_id is null").agg(F.min("image_id")).first()[0]
    return people.assign_by_nearest(t.faces, this, 0.3)


@query("""WITH n AS (SELECT image_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS persons FROM faces JOIN person USING (person_id) GROUP BY image_id),
 g AS (SELECT image_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS tags FROM photo_tag JOIN tag USING (tag_id) GROUP BY image_id)
 SELECT image_id, concat_ws(chr(10), 'File: ' || file_name, 'Taken: ' || strftime(photo_date, '%Y-%m-%d %H:%M'),
 CASE WHEN NOT isnan(latitude) AND NOT isnan(longitude) THEN printf('Position: %.6f, %.6f', latitude, longitude) END, 'Size: ' || concat_ws(' x ', width::VARCHAR, height::VARCHAR), 'Persons: ' || persons, 'Tags: ' || tags) AS lines
 FROM photo_index LEFT JOIN n USING (image_id) LEFT JOIN g USING (image_id) WHERE width IS NOT NULL AND file_name <> ''""")
def photo_context(t: Tables) -> DataFrame:
    names = lambda df, key: df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("x"))
    persons = names(t.faces.join(t.person.select("person_id", "name"), "person_id"), "image_id").withColumnRenamed("x", "persons")
    tags = names(t.photo_tag.join(t.tag.select("tag_id", "name"), "tag_id"), "image_id").withColumnRenamed("x", "tags")
    rows = t.photo_index.filter("width is not null and file_name <> ''")
    rows = rows.join(persons, "image_id", "left").join(tags, "image_id", "left")
    return rows.select("image_id", photo_lines(F.col("persons"), F.col("tags")).alias("lines"))


# --- sources, changes -----------------------------------------------------------------------------


@query(f"""{ctes("scan_old", "scan_new")}
 SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'deleted' ELSE 'modified' END AS change
 FROM scan_old o FULL JOIN scan_new n ON o.file_path = n.file_path WHERE o.file_path IS NULL OR n.file_path IS NULL OR o.size IS DISTINCT FROM n.size""")
def snapshot_diff(t: Tables) -> DataFrame:
    return files.snapshot_diff(t.scan_old, t.scan_new, compare=["size"])


@query(f"""{ctes("scan_new")} SELECT image_id, file_path FROM photo_index WHERE file_path NOT IN (SELECT file_path FROM scan_new)""")
def orphan_paths(t: Tables) -> DataFrame:
    return files.orphans(t.photo_index, t.scan_new)


@query(f"""{ctes("scan_new")} SELECT file_path FROM scan_new WHERE file_path NOT IN (SELECT file_path FROM photo_index WHERE {_V} IS NOT NULL OR index_failed)""")
def paths_to_index(t: Tables) -> DataFrame:
    return files.to_index(t.scan_new, t.photo_index)


@query("""WITH b AS (SELECT regexp_extract(file_path, '([^/]*)$', 1) AS file_name, max(file_path) AS file_path FROM photo_index GROUP BY 1) SELECT * FROM b WHERE file_name IN (SELECT file_name FROM photo_index)""")
def name_resolution(t: Tables) -> DataFrame:
    return files.resolve_names(t.photo_index.select("file_name"), t.photo_index)


@query(f"""{ctes("change_log")}, a AS (SELECT file_key, max(usn) AS last_usn, max(usn) FILTER (reason <> 'MODIFY') AS hard_usn, arg_max(reason, usn) FILTER (reason <> 'MODIFY') AS hard FROM change_log GROUP BY file_key)
 SELECT file_key, last_usn, CASE WHEN hard IS NULL THEN 'modified' WHEN hard = 'CREATE' THEN 'added' WHEN last_usn > hard_usn THEN 'modified' ELSE 'deleted' END AS change FROM a""")
def change_fold(t: Tables) -> DataFrame:
    return changes.fold_changes(t.change_log)


@query("SELECT user_id, max(ts)::DATE AS last_day FROM events GROUP BY user_id")
def user_high_water(t: Tables) -> DataFrame:
    return changes.high_water(t.events).select("user_id", F.col("last_sync").cast("date").alias("last_day"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT user_id, count(*) AS touches, n AS session_no FROM s GROUP BY user_id, n""")
def session_runs(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("start")
    got = changes.sessions(t.events)
    return got.select("user_id", "touches", F.row_number().over(w).cast("bigint").alias("session_no"))


@query(f"""WITH {_PV}, q AS (SELECT v FROM pv ORDER BY image_id LIMIT 1), s AS (SELECT image_id, list_cosine_similarity(pv.v, q.v) AS s FROM pv, q),
 k AS (SELECT image_id FROM s WHERE s >= 0.06 AND s >= 0.55 * (SELECT max(s) FROM s)) SELECT image_id, 12 AS tag_id FROM k
 WHERE image_id NOT IN (SELECT image_id FROM photo_tag)""")
def vector_to_tags(t: Tables) -> DataFrame:
    """Links to add when a search's best photos, as far as untagged, get a tag."""
    s = t.photo_index.select("image_id", cosine_to(_V, first_vector(t)).alias("similarity"))
    best = pr.untagged(search.adaptive_cut(s, 0.55, 0.06), t.photo_tag)
    return mu.add_tags(t.photo_tag, best, t.tag.filter("tag_id = 12"))


@query(f"""{ctes("grants")} SELECT user_id, display_name, coalesce((SELECT string_agg(DISTINCT function_code, ',' ORDER BY function_code) FROM grants g WHERE g.user_id = u.user_id), '') AS functions FROM app_user u""")
def users_with_grants(t: Tables) -> DataFrame:
    return mb.users_with_grants(t.app_user, t.grants).withColumn("functions", F.array_join("functions", ","))


@query("SELECT user_id, username FROM app_user WHERE last_seen_at >= TIMESTAMP '2023-06-01 12:00:00' - INTERVAL 100 DAY")
def live_sessions(t: Tables) -> DataFrame:
    s = t.app_user.select("user_id", "username", F.col("last_seen_at").alias("last_active_at"))
    return mb.live_sessions(s, t.app_user, "2023-06-01 12:00:00", "100 days").select("user_id", "username")


@query(f"""WITH {_EXIF}, j AS (SELECT image_id, trim(json_extract_string(j, '$.DateTimeOriginal')) AS d FROM o)
 SELECT image_id, try_strptime(d, '%Y:%m:%d %H:%M:%S')::DATE AS taken FROM j WHERE try_strptime(d, '%Y:%m:%d %H:%M:%S') IS NOT NULL""")
def exif_dates(t: Tables) -> DataFrame:
    return t.photo_index.select("image_id", media.exif_date(media.exif_object("exif_data")).cast("date").alias("taken")).filter("taken is not null")


@query(f"""WITH {_REL} SELECT a AS parent_id, b AS child_id, p.name AS parent_name, c.name AS child_name FROM par LEFT JOIN person p ON p.person_id = a LEFT JOIN person c ON c.person_id = b""")
def family_tree(t: Tables) -> DataFrame:
    e = family.clean_relations(t.person_relation).filter("relation_type = 'parent'")
    side = lambda key, name: t.person.select(F.col("person_id").alias(key), F.col("name").alias(name))
    e = e.select(F.col("person_id_from").alias("parent_id"), F.col("person_id_to").alias("child_id"))
    return e.join(side("parent_id", "parent_name"), "parent_id", "left").join(side("child_id", "child_name"), "child_id", "left")


@query("""SELECT user_id, greatest(last_seen_at, m)::DATE AS last_day FROM app_user LEFT JOIN (SELECT user_id, max(ts) AS m FROM events GROUP BY user_id) USING (user_id)""")
def raised_marks(t: Tables) -> DataFrame:
    return mu.raise_marks(t.app_user, t.events).select("user_id", F.col("last_seen_at").cast("date").alias("last_day"))


# --- mutations ------------------------------------------------------------------------------------


@query("""WITH i AS (SELECT DISTINCT image_id FROM faces WHERE person_id = 7), g AS (SELECT unnest([4, 9, 9]) AS tag_id)
 SELECT image_id, tag_id FROM i, (SELECT DISTINCT tag_id FROM g) WHERE (image_id, tag_id) NOT IN (SELECT (image_id, tag_id) FROM photo_tag)""")
def tags_to_add(t: Tables) -> DataFrame:
    tags = t.tag.filter("tag_id in (4, 9)").select("tag_id")
    return mu.add_tags(t.photo_tag, t.faces.filter("person_id = 7"), tags)


@query("SELECT image_id, tag_id FROM photo_tag WHERE NOT (tag_id IN (4, 5) AND image_id IN (SELECT image_id FROM faces WHERE person_id = 7))")
def tags_after_removal(t: Tables) -> DataFrame:
    tags = t.tag.filter("tag_id in (4, 5)").select("tag_id")
    return mu.remove_tags(t.photo_tag, t.faces.filter("person_id = 7"), tags).select("image_id", "tag_id")


@query("SELECT face_id, CASE person_id WHEN 7 THEN 2 ELSE person_id END AS person_id FROM faces")
def merged_persons(t: Tables) -> DataFrame:
    return mu.merge_persons(t.person, t.faces, t.person_relation, 7, 2)[1].select("face_id", "person_id")


@query("""WITH n AS (SELECT trim(display_name) AS name FROM app_user WHERE trim(display_name) <> '') SELECT min(name) AS name FROM n WHERE lower(name) NOT IN (SELECT lower(trim(name)) FROM person WHERE name IS NOT NULL) GROUP BY lower(name)""")
def new_persons(t: Tables) -> DataFrame:
    return mu.new_persons(t.person, t.app_user.select(F.col("display_name").alias("name")))


@query("""SELECT image_id, CASE WHEN hit THEN 48.5 WHEN latitude IS NULL THEN -999 WHEN isnan(latitude) THEN -998 ELSE round(latitude, 6) END AS lat FROM (SELECT image_id, latitude,
 starts_with(file_path, '/photos/2020/Fenselton/') AND NOT contains(file_path[length('/photos/2020/Fenselton/') + 1:], '/')
 AND (latitude IS NULL OR longitude IS NULL OR isnan(latitude) OR isnan(longitude) OR latitude = 0 OR longitude = 0) AS hit FROM photo_index)""")
def placed_folder(t: Tables) -> DataFrame:
    rows = mu.place_photos(t.photo_index, 48.5, 9.2, folder="/photos/2020/Fenselton")
    return rows.select("image_id", F.when(F.isnan("latitude"), F.lit(-998.0)).otherwise(F.round(F.coalesce("latitude", F.lit(-999.0)), 6)).alias("lat"))


@query("SELECT image_id, CASE WHEN image_id IN (SELECT image_id FROM faces) THEN 1 ELSE faces_indexed END AS faces_indexed FROM photo_index")
def faces_flagged(t: Tables) -> DataFrame:
    return mu.mark_faces_indexed(t.photo_index.select("image_id", "faces_indexed"), t.faces)


@query("""SELECT image_id FROM photo_index WHERE image_id NOT IN (SELECT image_id FROM dup_report WHERE image_id IS NOT NULL)""")
def after_delete(t: Tables) -> DataFrame:
    return mu.delete_photos(t.photo_index.select("image_id"), {}, t.dup_report)["photo_index"]
