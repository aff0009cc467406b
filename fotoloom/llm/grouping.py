"""Consolidating pairwise matches into groups.

``near_hash_links`` of the core finds the links between hashes that differ in few bits;
``low_diameter_groups`` closes links over chains by low-diameter decomposition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fotoloom.functions.hashing import clean_hash
from fotoloom.operators.hash_links import BUCKET_ROWS, near_hash_links
from fotoloom.session import Scratch

__all__ = ["BUCKET_ROWS", "low_diameter_groups", "near_hash_groups", "near_hash_links"]


def low_diameter_groups(links: DataFrame, a: str, b: str, beta: float = 0.3, hops: int = 3, seed: int = 11) -> DataFrame:
    """(id, group_id) of every linked id; group_id is the smallest id linked directly or through others.

    Level by level: each vertex starts a cluster after a waiting time shortened by an exponentially
    distributed shift of rate ``beta`` and joins the cluster that reaches it first, over at most
    ``hops`` links; clusters become the vertices of the next level and links between clusters its links,
    until none is left. The assignments of all levels are then composed. Links with a null end are
    dropped; an id linked only to itself is its own group; no links give an empty result.
    """
    s = Scratch(links.sparkSession)
    links = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).dropna()
    first = s.cut(links.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    edges = s.cut(links.filter("u <> v").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct())
    assign, level = None, 0
    while not edges.isEmpty():
        unit = (F.pmod(F.xxhash64("id", F.lit(seed + level)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        state = edges.select(F.col("u").alias("id")).distinct().select("id", F.struct((F.log(unit) / beta).alias("t"), F.col("id").alias("c")).alias("best"))
        for _ in range(hops):
            told = edges.join(state, edges.u == state.id).select(F.col("v").alias("id"), F.struct((F.col("best.t") + 1).alias("t"), F.col("best.c").alias("c")).alias("best"))
            state = state.unionByName(told).groupBy("id").agg(F.min("best").alias("best"))
        cluster = s.cut(state.select("id", F.col("best.c").alias("c")))
        if assign is None:
            assign = cluster
        else:
            moved = cluster.select(F.col("id").alias("c"), F.col("c").alias("c2"))
            assign = s.cut(assign.join(moved, "c", "left").select("id", F.coalesce("c2", "c").alias("c")))
        cu, cv = (cluster.select(F.col("id").alias(x), F.col("c").alias("c" + x)) for x in "uv")
        new = s.cut(edges.join(cu, "u").join(cv, "v").filter("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct())
        s.free(edges)
        edges, level = new, level + 1
    if assign is None:
        return first.select("id", F.col("id").alias("group_id"))
    root = F.coalesce("c", "id")
    all_ids = s.cut(first.join(assign, "id", "left").select("id", root.alias("c")))
    least = all_ids.groupBy("c").agg(F.min("id").alias("group_id"))
    return all_ids.join(least, "c").select("id", "group_id")


def near_hash_groups(photos: DataFrame, id_col: str, hash_col: str, most: int) -> DataFrame:
    """(id, group_id) of all rows whose hash lies within ``most`` bits of another row's, closed over chains.

    Equal hashes are one class with its smallest id; only classes are compared. Rows without a readable
    hash (``clean_hash``) or without id take no part; a repeated row with the same id is one row.
    """
    s = Scratch(photos.sparkSession)
    clean = s.cut(photos.select(F.col(id_col).cast("bigint").alias("id"), clean_hash(hash_col).alias("h")).dropna())
    classes = s.cut(clean.groupBy("h").agg(F.min("id").alias("rep"), F.max("id").alias("last")))
    groups = low_diameter_groups(near_hash_links(classes, "rep", "h", most), "a", "b")
    of_class = classes.join(groups, classes.rep == groups.id, "left").select(
        "h", F.coalesce("group_id", F.when(F.col("last") > F.col("rep"), F.col("rep"))).alias("group_id")
    ).dropna()
    return clean.join(of_class, "h").select("id", "group_id").distinct()
