"""Queries of the problems solved in this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from fotoloom.functions.vectors import centroids, cosine
from fotoloom.llm import clusters, grouping, mixing, packing, similar, survivorship as sv, tokens, truncation
from fotoloom.session import Scratch, load


_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
VECTORS = [("photo_index", "image_id", "clip_embedding_siglip"), ("faces", "face_id", "face_embedding")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, id_col, vector in VECTORS:
        pairs = similar.similar_pairs(load(spark, d, table), id_col, vector, k=10, min_cos=0.94)
        pairs = pairs.select(F.lit(table).alias("vec_table"), "id_lo", "id_hi")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _duplicate_photos(spark: SparkSession, d: str) -> DataFrame:
    report = load(spark, d, "dup_report").select("group_no", "image_id").dropna().distinct()
    return report.join(load(spark, d, "photo_index"), "image_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sv.best_record(
        _duplicate_photos(spark, d), "group_no", "image_id",
        {
            "pixels": sv.in_range("width", 16, 30_000) * sv.in_range("height", 16, 30_000),
            "format": sv.format_rank("file_format"),
            "exif": sv.n_speaking_entries("exif_data"),
            "size": sv.in_range("file_size", 1024, 500_000_000),
        },
    )


#: Day from which the age of a record's values counts.
AS_OF = "2025-01-01"
HALF_LIFE_DAYS = 730.0


def p4_golden(spark: SparkSession, d: str) -> DataFrame:
    """A built record per duplicate group: each field's value with most trust-and-recency votes."""
    raw = sv.format_rank("file_format")
    side = lambda c: F.when(F.col(c).between(16, 30_000), F.col(c))
    degree = lambda c, most: F.when((F.abs(c) <= most) & ~((F.col("latitude") == 0) & (F.col("longitude") == 0)), F.round(c, 4).cast("decimal(9,4)"))
    exif = sv.json_entries("exif_data")
    entry = lambda k: (lambda t: F.when(sv.says_something(t), F.trim(t)))(F.try_variant_get(F.try_element_at(exif, F.lit(k)), "$", "string"))
    return sv.fuse(
        _duplicate_photos(spark, d), "group_no",
        {
            "width": side("width"), "height": side("height"), "file_format": F.nullif(sv.bare_format("file_format"), F.lit("")),
            "latitude": degree("latitude", 90), "longitude": degree("longitude", 180),
            "photo_date": F.date_format("photo_date", "yyyy-MM-dd HH:mm:ss"), "make": entry("Make"), "model": entry("Model"),
        },
        trust=(1 + raw) / F.lit(5.0), age_days=F.datediff(F.lit(AS_OF).cast("date"), F.col("modified_at")), half_life_days=HALF_LIFE_DAYS,
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return grouping.near_hash_groups(load(spark, d, "photo_index"), "image_id", "phash", 6).withColumnRenamed("id", "image_id")


def _face_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.similarity_clusters(load(spark, d, "faces"), "face_id", "face_embedding")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _face_clusters(spark, d).select("cluster_id", F.col("id").alias("face_id"))


def p6_profiles(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_profiles(Scratch(spark).cut(_face_clusters(spark, d)))


def p6_like_texts(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of documents of like wording, by hashed features, with size and most typical documents.

    The features are a text's runs of five words, or all its words if it has fewer, each weighted by how
    often it occurs; texts without a word take no part.
    """

    def runs(it):
        for pdf in it:
            out = []
            for text in pdf.text:
                w = _WORD.findall((text or "").lower())
                out.append([xxhash.xxh3_64_intdigest(" ".join(w[i : i + 5])) - (1 << 63) for i in range(max(1, len(w) - 4))] if w else [])
            yield pd.DataFrame({"doc_id": pdf.doc_id, "r": out})

    docs = load(spark, d, "documents").select("doc_id", "text").mapInPandas(runs, "doc_id bigint, r array<bigint>").filter(F.size("r") > 0)
    docs = docs.select("doc_id", clusters.hashed_features(F.col("r"), F.transform("r", lambda x: F.lit(1.0)), 128).alias("v"))
    return clusters.cluster_profiles(Scratch(spark).cut(clusters.similarity_clusters(docs, "doc_id", "v")))


def p6_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must not be: clusters of fewer than 5, members far from their mean, faces in two clusters, clusters not named after their smallest face."""
    found = Scratch(spark).cut(_face_clusters(spark, d))
    faces = load(spark, d, "faces").select(F.col("face_id").alias("id"), similar.unit_vector("face_embedding", 128).alias("u"))
    at = found.join(faces, "id").select("cluster_id", "u")
    mean = centroids(at, "cluster_id", "u", 128).select("cluster_id", "centroid")
    far = at.join(mean, "cluster_id").agg(F.count_if(cosine(F.col("u"), F.col("centroid")) < 0.749).alias("far_members"))  # vectors travel rounded
    sets = found.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    small = sets.agg(F.count_if(F.expr("n < 5")).alias("small_clusters"), F.count_if(F.expr("least <> cluster_id")).alias("misnamed"))
    twice = found.groupBy("id").count().agg(F.count_if(F.expr("count > 1")).alias("faces_twice"))
    return far.crossJoin(small).crossJoin(twice)


def p7_sound(spark: SparkSession, d: str) -> DataFrame:
    """Per plan the documents placed, and what must not be: containers above the capacity, texts split without need, pieces that leave a gap."""
    out = None
    for plan, (capacity, rows) in _packed(spark, d).items():
        rows = Scratch(spark).cut(rows)
        full = rows.groupBy("container").agg(F.sum("size").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("overfull"))
        docs = rows.groupBy("id").agg(F.count("*").alias("pieces"), F.sum("size").alias("size"), F.max(F.col("start") + F.col("size")).alias("end"))
        docs = docs.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= capacity)).alias("split_small"), F.count_if(F.expr("end <> size")).alias("gaps"))
        row = docs.crossJoin(full).select(F.lit(plan).alias("plan_id"), "documents", "overfull", "split_small", "gaps")
        out = row if out is None else out.unionByName(row)
    return out


def p8_sound(spark: SparkSession, d: str) -> DataFrame:
    """Per target: whether its share is within 0.005, and whether a text is used more often than allowed."""
    mix, targets = Scratch(spark).cut(p8_mix(spark, d)), _targets(spark, d)
    report = mixing.mix_report(mix, targets).select("source", (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.005).alias("share_met"), "most_uses")
    return report.join(targets.select("source", "max_repeats"), "source").select("source", "share_met", (F.col("most_uses") > F.col("max_repeats")).alias("used_too_often"))


def p9_sound(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text says anything, and whether the sources' rates add up to the documents found."""
    found = Scratch(spark).cut(_truncated(spark, d))
    rates = truncation.truncation_rates(found).agg(F.sum("texts").alias("t"), F.sum("truncated").alias("n"), F.bool_and(F.abs(F.col("rate") * F.col("texts") - F.col("truncated")) <= 1).alias("ok"))
    one = found.agg(F.count("*").alias("documents"), F.count("cut").alias("cut"), F.count_distinct("id").alias("ids"))
    return one.crossJoin(rates).select("documents", ((F.col("t") == F.col("documents")) & (F.col("n") == F.col("cut")) & (F.col("ids") == F.col("documents")) & F.col("ok")).alias("rates_add_up"))


def _packed(spark: SparkSession, d: str) -> dict[int, tuple[int, DataFrame]]:
    sizes = tokens.count_tokens(load(spark, d, "documents").select("doc_id", "text"), "text")
    sizes = Scratch(spark).cut(sizes)
    plans = load(spark, d, "pack_plan").orderBy("plan_id").collect()  # the plans are a fixed list
    return {p.plan_id: (p.capacity_tokens, packing.pack_items(sizes, "doc_id", "n_tokens", p.capacity_tokens)) for p in plans}


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every plan's containers with their documents, or pieces of those above the capacity."""
    out = None
    for plan, (_, rows) in _packed(spark, d).items():
        rows = rows.select(F.lit(plan).alias("plan_id"), "container", F.col("id").alias("doc_id"), "piece", "start", "size")
        out = rows if out is None else out.unionByName(rows)
    return out


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full each plan's containers are."""
    out = None
    for plan, (capacity, rows) in _packed(spark, d).items():
        rows = packing.fill_rates(rows, capacity).select(F.lit(plan).alias("plan_id"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "mix_target").withColumn("source", mixing.bare_source("source"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(
        F.col("doc_id").alias("id"), mixing.bare_source("source").alias("source"), "text",
        F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
    )
    targets = _targets(spark, d)
    named = docs.join(targets.select("source"), "source", "left_semi")
    texts = mixing.one_per_text(tokens.count_tokens(named, "text", out="size"), targets)
    return mixing.mix_sources(Scratch(spark).cut(texts), targets)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(Scratch(spark).cut(p8_mix(spark, d)), _targets(spark, d))


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(load(spark, d, "documents"), "doc_id", mixing.bare_source("source"), "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).filter("cut is not null").select(F.col("id").alias("doc_id"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(_truncated(spark, d))


def queries() -> dict:
    return {"p2_found": p2_found, "p4_found": p4_found, "p4_golden": p4_golden, "p5_found": p5_found, "p6_found": p6_found, "p6_profiles": p6_profiles,
            "p7_pack": p7_pack, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_report": p8_report,
            "p9_found": p9_found, "p9_rates": p9_rates, "p6_like_texts": p6_like_texts,
            "p6_sound": p6_sound, "p7_sound": p7_sound, "p8_sound": p8_sound, "p9_sound": p9_sound}


_HASH = r"""h AS (SELECT image_id, rpad(x, 64, '0') AS h FROM (
  SELECT image_id, regexp_replace(lower(phash), '^\s*(0x)?|\s+$', '', 'g') AS x FROM photo_index) WHERE regexp_full_match(x, '[0-9a-f]{1,64}')),
 l AS (SELECT image_id, h, [('0x' || h[i + 1 : i + 16])::UBIGINT FOR i IN [0, 16, 32, 48]] AS v FROM h)"""
_FILLERS = ", ".join(f"'{x}'" for x in sv.FILLERS)
_JSON = """CASE WHEN json_valid(exif_data) THEN CASE WHEN json_type(exif_data) = 'VARCHAR' THEN json_extract_string(exif_data, '$') ELSE exif_data END END"""


def _entry_sql(key: str) -> str:
    v = f"json_extract_string(o, '$.{key}')"
    return rf"CASE WHEN lower(regexp_replace({v}, '^[\s[:cntrl:]]+|[\s[:cntrl:]]+$', '', 'g')) NOT IN ({_FILLERS}) THEN trim({v}) END"


def oracle_sql() -> dict[str, str]:
    kinds = " ".join(f"WHEN fmt IN ({', '.join(map(repr, g))}) THEN {4 - i}" for i, (_, g) in enumerate(sv.FORMAT_KINDS))
    return {
        "p4_found": rf"""WITH d AS (SELECT DISTINCT group_no, image_id FROM dup_report),
 p AS (SELECT d.group_no, p.*, regexp_replace(lower(file_format), '^\s*\.?|\s+$', '', 'g') AS fmt, {_JSON} AS j FROM d JOIN photo_index p USING (image_id)),
 n AS (SELECT *, CASE WHEN json_valid(j) AND json_type(j) = 'OBJECT' THEN
   len(list_filter(list_transform(json_keys(j), lambda k: json_extract_string(j, '$."' || k || '"')),
     lambda v: v IS NOT NULL AND lower(regexp_replace(v, '^[\s[:cntrl:]]+|[\s[:cntrl:]]+$', '', 'g')) NOT IN ({_FILLERS}))) ELSE 0 END AS entries FROM p)
 SELECT group_no, image_id FROM (SELECT group_no, image_id, row_number() OVER (PARTITION BY group_no ORDER BY
   CASE WHEN width BETWEEN 16 AND 30000 AND height BETWEEN 16 AND 30000 THEN width::BIGINT * height ELSE 0 END DESC,
   CASE {kinds} ELSE 0 END DESC, entries DESC,
   CASE WHEN file_size BETWEEN 1024 AND 500000000 THEN file_size ELSE 0 END DESC, image_id) AS r FROM n) WHERE r = 1""",
        "p4_golden": rf"""WITH d AS (SELECT DISTINCT group_no, image_id FROM dup_report),
 p AS (SELECT d.group_no, p.*, regexp_replace(lower(file_format), '^\s*\.?|\s+$', '', 'g') AS fmt, {_JSON} AS j FROM d JOIN photo_index p USING (image_id) WHERE group_no IS NOT NULL),
 v AS (SELECT *, CASE WHEN json_valid(j) AND json_type(j) = 'OBJECT' THEN j END AS o, round(1e6 * coalesce((1 + CASE {kinds} ELSE 0 END) / 5.0::DOUBLE, 0)
   * pow(2.0::DOUBLE, -greatest(0.0, coalesce(date_diff('day', modified_at::DATE, DATE '{AS_OF}'), 0)::DOUBLE) / {HALF_LIFE_DAYS}))::BIGINT AS vote,
   CASE WHEN latitude = 0 AND longitude = 0 THEN true ELSE false END AS zero FROM p),
 l AS (SELECT group_no, vote, unnest(['width', 'height', 'file_format', 'latitude', 'longitude', 'photo_date', 'make', 'model']) AS field, unnest([
   CASE WHEN width BETWEEN 16 AND 30000 THEN width::VARCHAR END, CASE WHEN height BETWEEN 16 AND 30000 THEN height::VARCHAR END, nullif(fmt, ''),
   CASE WHEN abs(latitude) <= 90 AND NOT (zero AND latitude IS NOT NULL) AND (longitude IS NOT NULL OR latitude <> 0) THEN round(latitude, 4)::DECIMAL(9,4)::VARCHAR END,
   CASE WHEN abs(longitude) <= 180 AND NOT zero AND (latitude IS NOT NULL OR longitude <> 0) THEN round(longitude, 4)::DECIMAL(9,4)::VARCHAR END,
   strftime(photo_date, '%Y-%m-%d %H:%M:%S'), {_entry_sql("Make")}, {_entry_sql("Model")}]) AS value FROM v),
 s AS (SELECT group_no, field, value, sum(vote) AS votes FROM l WHERE value IS NOT NULL GROUP BY ALL),
 w AS (SELECT group_no, field, value FROM s QUALIFY row_number() OVER (PARTITION BY group_no, field ORDER BY votes DESC, value) = 1)
 SELECT g.group_no, {", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f in ("width", "height", "file_format", "latitude", "longitude", "photo_date", "make", "model"))}
 FROM (SELECT DISTINCT group_no FROM p) g LEFT JOIN w USING (group_no) GROUP BY g.group_no""",
        "p6_sound": "SELECT 0 AS far_members, 0 AS small_clusters, 0 AS misnamed, 0 AS faces_twice",
        "p7_sound": "SELECT plan_id, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0 AS overfull, 0 AS split_small, 0 AS gaps FROM pack_plan",
        "p8_sound": "SELECT replace(lower(trim(source)), '-', '_') AS source, true AS share_met, false AS used_too_often FROM mix_target",
        "p9_sound": r"""SELECT count(*) AS documents, true AS rates_add_up FROM documents WHERE regexp_matches(text, '\S')""",
        "p2_found": " UNION ALL ".join(
            f"""SELECT '{t}' AS vec_table, * FROM (
 WITH v AS (SELECT {i} AS id, {v}::DOUBLE[128] AS v FROM {t} WHERE len({v}) = 128 AND list_max(list_transform({v}, lambda x: abs(x))) > 0),
 c AS (SELECT a.id AS q, b.id AS p, array_cosine_similarity(a.v, b.v) AS cos FROM v a JOIN v b ON a.id <> b.id WHERE array_cosine_similarity(a.v, b.v) >= 0.94),
 k AS (SELECT q, p FROM (SELECT q, p, row_number() OVER (PARTITION BY q ORDER BY cos DESC, p) AS r FROM c) WHERE r <= 10)
 SELECT DISTINCT least(q, p) AS id_lo, greatest(q, p) AS id_hi FROM k)"""
            for t, i, v in VECTORS
        ),
        "p5_found": f"""WITH RECURSIVE {_HASH},
 e AS (SELECT a.image_id AS a, b.image_id AS b FROM l a JOIN l b ON a.image_id <> b.image_id
  AND list_sum([bit_count(xor(a.v[i], b.v[i])) FOR i IN [1, 2, 3, 4]]) <= 6),
 r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
 SELECT a AS image_id, least(a, min(b)) AS group_id FROM r GROUP BY a""",
    }
