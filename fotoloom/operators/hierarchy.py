"""Parent-child links to full hierarchies by pointer doubling.

Round k joins the pairs exactly 2**k links apart with all pairs found so far and so finds every
pair up to 2**(k+1) links apart: the number of rounds is the logarithm of the depth, and each pair is
found with its smallest number of links. A node that descends from itself shows as a pair with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fotoloom.session import Scratch


def _edges(links: DataFrame, parent: str, child: str) -> DataFrame:
    return (
        links.select(F.col(parent).cast("bigint").alias("ancestor_id"), F.col(child).cast("bigint").alias("node_id"))
        .dropna()
        .distinct()
    )


def closure(links: DataFrame, parent: str, child: str, with_path: bool = False) -> DataFrame:
    """All (ancestor_id, node_id, steps) with the smallest number of links, cycles included.

    Null ends are dropped, repeated links count once, a self link gives (x, x, 1), an empty table gives
    an empty result; further columns are ignored. ``with_path`` adds ``path``, the nodes from ancestor
    to node along the shortest way (of ties the smallest, element by element).
    """
    s = Scratch(links.sparkSession)
    first = _edges(links, parent, child).withColumn("steps", F.lit(1).cast("bigint"))
    if with_path:
        first = first.withColumn("path", F.array("ancestor_id", "node_id"))
    found = frontier = s.cut(first)
    done, n = [found], 1
    while True:
        left = frontier.filter(F.col("steps") == n).select(
            "ancestor_id", F.col("node_id").alias("mid"), *([F.col("path").alias("p1")] if with_path else [])
        )
        right = found.select(
            F.col("ancestor_id").alias("mid"), "node_id", F.col("steps").alias("s2"),
            *([F.col("path").alias("p2")] if with_path else []),
        )
        pairs = left.join(right, "mid")
        steps = (F.col("s2") + n).alias("steps")
        if with_path:
            path = F.concat("p1", F.slice("p2", 2, F.size("p2") - 1)).alias("path")
            pairs = pairs.select("ancestor_id", "node_id", F.struct(steps, path).alias("best"))
            pairs = pairs.groupBy("ancestor_id", "node_id").agg(F.min("best").alias("best"))
            pairs = pairs.select("ancestor_id", "node_id", "best.steps", "best.path")
        else:
            pairs = pairs.select("ancestor_id", "node_id", steps).groupBy("ancestor_id", "node_id").agg(F.min("steps").alias("steps"))
        new = s.cut(pairs.join(found.select("ancestor_id", "node_id"), ["ancestor_id", "node_id"], "left_anti"))
        if new.isEmpty():
            return found
        done.append(new)
        found, frontier, n = found.unionByName(new), new, 2 * n


def hierarchy(links: DataFrame, parent: str, child: str) -> DataFrame:
    """One row per node: root_id, n_roots, depth, path, n_ancestors, n_descendants, in_cycle.

    A root is a node without parent; root_id is the nearest (of ties the smallest id), depth the links
    to it, path the nodes from it joined by '/'. A root is its own root at depth 0. Nodes above which
    there are only cycles have no root: root_id, depth and path are null. in_cycle marks nodes that are
    their own ancestor; they do not count among their own ancestors and descendants.
    """
    spark = links.sparkSession
    s = Scratch(spark)
    pairs = s.cut(closure(links, parent, child, with_path=True))
    ones = pairs.filter("steps = 1")
    nodes = ones.select("node_id").union(ones.select("ancestor_id")).distinct()
    roots = nodes.join(ones.select("node_id").distinct(), "node_id", "left_anti")
    apart = F.col("ancestor_id") != F.col("node_id")
    up = pairs.groupBy("node_id").agg(
        F.count_if(apart).alias("n_ancestors"), F.max(~apart).alias("in_cycle")
    )
    down = pairs.filter(apart).groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("n_descendants"))
    from_root = (
        pairs.join(roots.withColumnRenamed("node_id", "ancestor_id"), "ancestor_id", "left_semi")
        .groupBy("node_id")
        .agg(F.min(F.struct("steps", "ancestor_id", "path")).alias("r"), F.count("*").alias("n_roots"))
    )
    own = roots.withColumn("own", F.lit(True))
    text = F.array_join(F.transform("r.path", lambda x: x.cast("string")), "/")
    is_root = F.coalesce("own", F.lit(False))
    return (
        nodes.join(up, "node_id", "left").join(down, "node_id", "left").join(from_root, "node_id", "left").join(own, "node_id", "left")
        .select(
            "node_id",
            F.when(is_root, F.col("node_id")).otherwise(F.col("r.ancestor_id")).alias("root_id"),
            F.when(is_root, 1).otherwise(F.coalesce("n_roots", F.lit(0))).cast("bigint").alias("n_roots"),
            F.when(is_root, 0).otherwise(F.col("r.steps")).cast("bigint").alias("depth"),
            F.when(is_root, F.col("node_id").cast("string")).otherwise(text).alias("path"),
            F.coalesce("n_ancestors", F.lit(0)).alias("n_ancestors"),
            F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"),
            F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
        )
    )


def roots(links: DataFrame, parent: str, child: str, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, root_id, depth, path): every node under each of its roots, with the shortest way (of ties the smallest) joined by '/'.

    A root is a node without parent and its own root at depth 0; ids of ``nodes`` (one column) that no link
    names are roots too. Nodes above which there are only cycles have no row; null ids take no part.
    """
    s = Scratch(links.sparkSession)
    pairs = s.cut(closure(links, parent, child, with_path=True))
    ones = pairs.filter("steps = 1")
    every = ones.select("node_id").union(ones.select("ancestor_id"))
    if nodes is not None:
        every = every.union(nodes.select(F.col(nodes.columns[0]).cast("bigint"))).dropna()
    tops = every.distinct().join(ones.select("node_id").distinct(), "node_id", "left_anti")
    text = F.array_join(F.transform("path", lambda x: x.cast("string")), "/")
    below = pairs.join(tops.withColumnRenamed("node_id", "ancestor_id"), "ancestor_id", "left_semi")
    below = below.select("node_id", F.col("ancestor_id").alias("root_id"), F.col("steps").alias("depth"), text.alias("path"))
    own = tops.select("node_id", F.col("node_id").alias("root_id"), F.lit(0).cast("bigint").alias("depth"), F.col("node_id").cast("string").alias("path"))
    return own.unionByName(below)
