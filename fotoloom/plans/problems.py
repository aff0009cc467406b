"""Queries of the general problems (hierarchies, places) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fotoloom.operators.hierarchy import closure, hierarchy, roots
from fotoloom.operators.spatial import great_circle_m, has_position, near_positions, points_in_regions, regions
from fotoloom.session import load


def parent_links(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "person_relation").filter(F.lower(F.trim("relation_type")) == "parent").select("person_id_from", "person_id_to")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = closure(parent_links(spark, d), "person_id_from", "person_id_to")
    return pairs.select("ancestor_id", F.col("node_id").alias("person_id"), "steps")


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(parent_links(spark, d), "person_id_from", "person_id_to").withColumnRenamed("node_id", "person_id")


def p1_self_descent(spark: SparkSession, d: str) -> DataFrame:
    """Persons who descend from themselves, with the length of the shortest cycle through them."""
    pairs = closure(parent_links(spark, d), "person_id_from", "person_id_to")
    return pairs.filter("ancestor_id = node_id").select(F.col("node_id").alias("person_id"), F.col("steps").alias("cycle_steps"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = points_in_regions(load(spark, d, "photo_index"), "image_id", regions(load(spark, d, "place")), unique_points=True)
    return found.select(F.col("region_id").alias("place_id"), F.col("point_id").alias("image_id"))


#: How far outside a place a photo still counts as near.
NEAR_M = 1000.0
#: How far another photo may be to be a neighbour.
NEIGHBOUR_M = 200.0


def p3_near(spark: SparkSession, d: str) -> DataFrame:
    """Photos in or within NEAR_M of a circle or an outline, with the distance to its centre or nearest edge (0 inside) in whole metres."""
    found = points_in_regions(load(spark, d, "photo_index"), "image_id", regions(load(spark, d, "place"), margin_m=NEAR_M), metres=True, unique_points=True)
    return found.select(F.col("region_id").alias("place_id"), F.col("point_id").alias("image_id"), F.round("metres").cast("bigint").alias("metres"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """For every photo whose id is divisible by 20 how many other photos lie within NEIGHBOUR_M, and at how many positions; none without any."""
    photos = load(spark, d, "photo_index")
    near = near_positions(photos, "image_id", photos.filter("image_id % 20 = 0"), "image_id", NEIGHBOUR_M)
    return near.groupBy(F.col("query_id").alias("image_id")).agg(F.count("*").alias("positions"), F.sum("n").alias("photos"))


def p1_roots(spark: SparkSession, d: str) -> DataFrame:
    """Every person's roots, persons without parents their own, with depth and the shortest way down; persons without links are roots too."""
    return roots(parent_links(spark, d), "person_id_from", "person_id_to", load(spark, d, "person").select("person_id")).withColumnRenamed("node_id", "person_id")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_self_descent": p1_self_descent, "p1_roots": p1_roots, "p3_found": p3_found, "p3_near": p3_near, "p3_neighbours": p3_neighbours}


_EDGES = """e AS (SELECT DISTINCT person_id_from AS a, person_id_to AS b FROM person_relation
  WHERE lower(trim(relation_type)) = 'parent' AND person_id_from IS NOT NULL AND person_id_to IS NOT NULL)"""
_CLOSURE = f"""WITH RECURSIVE {_EDGES}, r(a, b, n) AS (
  SELECT a, b, 1::BIGINT FROM e UNION SELECT r.a, e.b, r.n + 1 FROM r JOIN e ON r.b = e.a
  WHERE r.n < (SELECT count(*) FROM e)),
 c AS (SELECT a, b, min(n) AS n FROM r GROUP BY a, b)"""
_PATHS = f"""WITH RECURSIVE {_EDGES}, w(a, b, n, path) AS (
  SELECT a, b, 1::BIGINT, [a, b] FROM e UNION SELECT a, b, n, path FROM (SELECT w.a, e.b, w.n + 1 AS n, list_append(w.path, e.b) AS path,
    row_number() OVER (PARTITION BY w.a, e.b ORDER BY list_append(w.path, e.b)) AS r FROM w JOIN e ON w.b = e.a
    WHERE NOT list_contains(w.path[2:], e.b)) WHERE r = 1),
 k AS (SELECT a, b, n, path FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n, path) AS r FROM w) WHERE r = 1)"""
_M = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(p.latitude - c.latitude) / 2), 2) + cos(radians(p.latitude)) * cos(radians(c.latitude)) * pow(sin(radians(p.longitude - c.longitude) / 2), 2))))"
_PHOTOS = """p AS (SELECT image_id, latitude, longitude FROM photo_index WHERE NOT isnan(latitude) AND NOT isnan(longitude)
  AND NOT (latitude = 0 AND longitude = 0) AND abs(latitude) <= 90 AND abs(longitude) <= 180)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_CLOSURE} SELECT a AS ancestor_id, b AS person_id, n AS steps FROM c",
        "p1_self_descent": f"{_CLOSURE} SELECT a AS person_id, n AS cycle_steps FROM c WHERE a = b",
        "p1_hierarchy": f"""{_PATHS},
 n AS (SELECT a AS x FROM e UNION SELECT b FROM e), o AS (SELECT x FROM n WHERE x NOT IN (SELECT b FROM e)),
 f AS (SELECT b, a, n, path, row_number() OVER (PARTITION BY b ORDER BY n, a, path) AS r, count(*) OVER (PARTITION BY b) AS roots FROM k WHERE a IN (SELECT x FROM o))
 SELECT x AS person_id, coalesce(f.a, o.x) AS root_id, CASE WHEN o.x IS NOT NULL THEN 1 ELSE coalesce(f.roots, 0) END AS n_roots, CASE WHEN o.x IS NOT NULL THEN 0 ELSE f.n END AS depth,
  CASE WHEN o.x IS NOT NULL THEN n.x::VARCHAR ELSE array_to_string(f.path, '/') END AS path,
  (SELECT count(*) FROM k WHERE k.b = n.x AND k.a <> n.x) AS n_ancestors, (SELECT count(*) FROM k WHERE k.a = n.x AND k.b <> n.x) AS n_descendants,
  EXISTS (SELECT 1 FROM k WHERE k.a = n.x AND k.b = n.x) AS in_cycle FROM n LEFT JOIN o USING (x) LEFT JOIN f ON f.b = n.x AND f.r = 1""",
        "p1_roots": f"""{_PATHS},
 n AS (SELECT a AS x FROM e UNION SELECT b FROM e UNION SELECT person_id FROM person), o AS (SELECT x FROM n WHERE x NOT IN (SELECT b FROM e))
 SELECT x AS person_id, x AS root_id, 0 AS depth, x::VARCHAR AS path FROM o
 UNION ALL SELECT b, a, n, array_to_string(path, '/') FROM k WHERE a IN (SELECT x FROM o)""",
        "p3_neighbours": f"""WITH {_PHOTOS}, c AS (SELECT latitude, longitude, min(image_id) AS near_id, count(*) AS n FROM p GROUP BY latitude, longitude),
 j AS (SELECT p.image_id, c.near_id, c.n - CASE WHEN p.latitude = c.latitude AND p.longitude = c.longitude THEN 1 ELSE 0 END AS n FROM p, c WHERE p.image_id % 20 = 0 AND {_M} <= {NEIGHBOUR_M})
 SELECT image_id, count(*) AS positions, sum(n)::BIGINT AS photos FROM j WHERE n > 0 GROUP BY image_id""",
        "p3_found": f"""WITH {_PHOTOS},
 edge AS (SELECT place_id, unnest(outline) AS v, unnest(list_append(outline[2:], outline[1])) AS w FROM place WHERE place_kind = 'outline')
 SELECT c.place_id, p.image_id FROM p, place c WHERE c.place_kind = 'circle' AND {_M} <= c.radius_m
 UNION SELECT place_id, image_id FROM (
  SELECT e.place_id, p.image_id FROM p, edge e
  WHERE (e.v.latitude > p.latitude) <> (e.w.latitude > p.latitude)
   AND p.longitude < e.v.longitude + (p.latitude - e.v.latitude) * (e.w.longitude - e.v.longitude) / (e.w.latitude - e.v.latitude))
 GROUP BY place_id, image_id HAVING count(*) % 2 = 1""",
        "p3_near": f"""WITH {_PHOTOS},
 edge AS (SELECT place_id, unnest(outline) AS v, unnest(list_append(outline[2:], outline[1])) AS w FROM place WHERE place_kind = 'outline'),
 e AS (SELECT place_id, image_id, p.latitude, p.longitude, v.latitude AS y, v.longitude AS x, w.latitude - v.latitude AS ey, w.longitude - v.longitude AS ex,
   p.longitude + 360 * round(((v.longitude + w.longitude) / 2 - p.longitude) / 360) AS s, pow(cos(radians(p.latitude)), 2) AS k,
   (v.latitude > p.latitude) <> (w.latitude > p.latitude)
    AND p.longitude < v.longitude + (p.latitude - v.latitude) * (w.longitude - v.longitude) / (w.latitude - v.latitude) AS crossed FROM p, edge),
 n AS (SELECT *, CASE WHEN ex = 0 AND ey = 0 THEN 0 ELSE greatest(0.0, least(1.0, ((s - x) * ex * k + (latitude - y) * ey) / (ex * ex * k + ey * ey))) END AS t FROM e),
 o AS (SELECT place_id, image_id, CASE WHEN count(*) FILTER (crossed) % 2 = 1 THEN 0 ELSE min({_M.replace("p.longitude", "s").replace("p.", "").replace("c.latitude", "(y + t * ey)").replace("c.longitude", "(x + t * ex)")}) END AS m
  FROM n GROUP BY place_id, image_id)
 SELECT place_id, image_id, round(m)::BIGINT AS metres FROM o WHERE m <= {NEAR_M}
 UNION ALL SELECT c.place_id, p.image_id, round({_M})::BIGINT FROM p, place c WHERE c.place_kind = 'circle' AND {_M} <= c.radius_m + {NEAR_M}""",
    }


__all__ = ["queries", "oracle_sql", "parent_links", "has_position"]
