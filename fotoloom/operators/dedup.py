"""Duplicate photos: pairs by perceptual hash, groups by components, ranking, reports, transfer of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fotoloom.functions.hashing import clean_hash, hamming, lanes
from fotoloom.functions.media import extension, format_group
from fotoloom.functions.predicates import has_gps
from fotoloom.operators.hash_links import near_hash_links
from fotoloom.operators.ranking import numbered
from fotoloom.session import Scratch


def hash_rows(photos: DataFrame, same_format: bool = True, id_col: str = "image_id", hash_col: str = "phash", part: Column | None = None) -> DataFrame:
    """(id, h, g) of the photos with a readable hash; g is the part they meet in: the one given, the format group, or one for all."""
    g = part if part is not None else format_group(extension("file_path")) if same_format else F.lit("")
    rows = photos.select(F.col(id_col).cast("bigint").alias("id"), clean_hash(hash_col).alias("h"), F.coalesce(g, F.lit("")).alias("g"))
    return rows.filter("id is not null and h is not null")


def hash_classes(rows: DataFrame) -> DataFrame:
    """(h, g, rep, n): each distinct hash and group with its smallest id and number of photos, combined before the shuffle."""
    return rows.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n"))


def class_pairs(classes: DataFrame, most: int) -> DataFrame:
    """(id1, id2, distance), id1 < id2: all pairs of classes of one group whose hashes differ in 1 to ``most`` bits, by their smallest ids."""
    return near_hash_links(classes, "rep", "h", most, F.col("g"), forest=False).toDF("id1", "id2", "distance")


def hash_pairs(photos: DataFrame, most: int, same_format: bool = True, id_col: str = "image_id", hash_col: str = "phash", expand: bool = True) -> DataFrame:
    """(id1, id2, distance), id1 < id2, of photos within ``most`` bits; same format group unless told otherwise.

    Photos of equal hash and group are one class. ``expand`` writes out all pairs of photos, k (k - 1) / 2
    of k copies: only for inputs known to have few; without it there are the pairs of classes, by their
    smallest ids, and each copy paired with the smallest id of its class at distance 0. Unreadable hashes
    take no part.
    """
    s = Scratch(photos.sparkSession)
    rows = s.cut(hash_rows(photos, same_format, id_col, hash_col).distinct())
    classes = s.cut(hash_classes(rows))
    pairs = class_pairs(classes, most)
    of_class = rows.join(classes.filter("n > 1").select("h", "g", "rep"), ["h", "g"])
    if not expand:
        copies = of_class.filter("id <> rep").select(F.col("rep").alias("id1"), F.col("id").alias("id2"), F.lit(0).alias("distance"))
        return pairs.unionByName(copies)
    member = rows.join(classes.select("h", "g", "rep"), ["h", "g"]).select("rep", "id")
    a, b = (member.select(F.col("rep").alias(f"id{i}"), F.col("id").alias(x)) for i, x in ((1, "a"), (2, "b")))
    wide = pairs.join(a, "id1").join(b, "id2").select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "distance")
    two = of_class.select("rep", F.col("id").alias("id1")).join(of_class.select("rep", F.col("id").alias("id2")), "rep").filter("id1 < id2")
    return wide.unionByName(two.select("id1", "id2", F.lit(0).alias("distance")))


def hash_groups(
    photos: DataFrame, most: int, same_format: bool = True, id_col: str = "image_id", hash_col: str = "phash", part: Column | None = None
) -> DataFrame:
    """(id, group_id) of the photos within ``most`` bits of another, closed over chains; group_id is the smallest id.

    Classes are linked by spanning forests, never by all pairs, and closed by ``components``; the members of
    a class follow its smallest id.
    """
    s = Scratch(photos.sparkSession)
    rows = s.cut(hash_rows(photos, same_format, id_col, hash_col, part).distinct())
    classes = s.cut(hash_classes(rows))
    groups = components(near_hash_links(classes, "rep", "h", most, F.col("g")), "a", "b")
    of_class = classes.join(groups, classes.rep == groups.id, "left").select("h", "g", F.coalesce("group_id", F.when(F.col("n") > 1, F.col("rep"))).alias("group_id"))
    return rows.join(of_class.dropna(), ["h", "g"]).select("id", "group_id")


def components(pairs: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """(id, group_id): the smallest id linked directly or through others.

    Alternates large-star (link each vertex's larger neighbours to its smallest) and small-star (the
    smaller ones and itself) until nothing changes; each round is written, so lineage stays short. A hub's
    links are combined to their minimum before they are shuffled; the join that follows has one row per
    vertex on its other side, so AQE broadcasts that side or splits the hub's links over several tasks.
    """
    s = Scratch(pairs.sparkSession)
    e = s.cut(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna().distinct())
    every = s.cut(e.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    e = s.cut(e.filter("u <> v"))

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            d = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            d = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = d.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        links = d.join(low, "u")
        if large:
            return links.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        own = low.filter("u <> m").select("u", F.col("m").alias("v"))
        return links.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).filter("u <> v").distinct()

    def signature(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.sum(F.xxhash64("v", "u") % (1 << 40))).first())

    # After the first round links point from larger to smaller ids, so equal signatures mean equal links.
    before = None
    while before != (now := signature(e)):
        before, old = now, e
        e = s.cut(star(star(old, True), False))
        s.free(old)
    low = e.groupBy("u").agg(F.min("v").alias("group_id")).withColumnRenamed("u", "id")
    return every.join(low, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def ranked_groups(members: DataFrame, photos: DataFrame, order: str = "phash") -> DataFrame:
    """(group_id, id, rank, action, ...): KEEP the first of each group, DELETE the rest.

    Orders: clip (larger file, longer path, path), phash (larger file, path), size (smaller id).
    """
    by: dict[str, list[Column]] = {
        "clip": [F.desc_nulls_last("file_size"), F.desc(F.length("file_path")), F.asc("file_path")],
        "phash": [F.desc_nulls_last("file_size"), F.asc("file_path")],
        "size": [],
    }
    rows = members.join(photos.select(F.col("image_id").alias("id"), "file_path", "file_size"), "id")
    rows = numbered(rows, ["group_id"], [*by[order], F.asc("id")])
    return rows.withColumn("action", F.when(F.col("rank") == 1, "KEEP").otherwise("DELETE"))


def group_stats(ranked: DataFrame) -> DataFrame:
    """One row: groups, surplus files and the MB they take."""
    extra = F.col("rank") > 1
    return ranked.agg(
        F.countDistinct("group_id").alias("groups"), F.count_if(extra).alias("surplus"),
        F.round(F.coalesce(F.sum(F.when(extra, F.col("file_size"))), F.lit(0)) / 1048576.0, 1).alias("surplus_mb"),
    )


def report_lines(ranked: DataFrame) -> DataFrame:
    """(group_id, line_no, line): a header per group, then a line per file, KEEP first."""
    head = ranked.groupBy("group_id").agg(F.count("*").alias("n")).select(
        "group_id", F.lit(0).alias("line_no"), F.format_string("=== Group %d (%d files) ===", "group_id", "n").alias("line")
    )
    size = F.coalesce(F.col("file_size"), F.lit(0)) / 1048576.0
    files = ranked.select("group_id", F.col("rank").alias("line_no"), F.format_string("%-6s [%6.1f MB] %s", "action", size, "file_path").alias("line"))
    return head.unionByName(files)


def parse_report(lines: DataFrame, line: str = "line", group: str = "group_id") -> DataFrame:
    """(group, action, mb, file_path) of the file lines of a report."""
    p = r"^(KEEP|DELETE)\s+\[\s*([0-9.]+) MB\]\s(.*)$"
    hit = F.col(line).rlike(p)
    return lines.filter(hit).select(
        group, F.regexp_extract(line, p, 1).alias("action"), F.regexp_extract(line, p, 2).cast("double").alias("mb"), F.regexp_extract(line, p, 3).alias("file_path")
    )


def size_buckets(photos: DataFrame) -> DataFrame:
    """(id, file_size, kind, n) of photos that share size and format group with another."""
    rows = photos.filter("file_size is not null").select(F.col("image_id").alias("id"), "file_size", format_group("file_format").alias("kind"))
    n = rows.groupBy("file_size", "kind").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(n, ["file_size", "kind"]).select("id", "file_size", "kind", "n")


def transfer_positions(photos: DataFrame, most: int = 6) -> DataFrame:
    """(image_id, donor_id, latitude, longitude, distance): for photos at exactly (0, 0) the position of the nearest hash.

    Same format group, at most ``most`` bits, ties to the smaller donor id.
    """
    s = Scratch(photos.sparkSession)
    zero = F.coalesce((F.col("latitude") == 0) & (F.col("longitude") == 0), F.lit(False))
    placed = has_gps() & ~zero
    at = photos.filter(zero | placed).select("image_id", zero.alias("zero"), "latitude", "longitude").withColumnRenamed("image_id", "id")
    rows = s.cut(hash_rows(photos).distinct().join(at, "id"))
    donor = F.min(F.when(~F.col("zero"), F.struct("id", "latitude", "longitude"))).alias("donor")
    classes = s.cut(rows.groupBy("h", "g").agg(F.min("id").alias("rep"), F.bool_or("zero").alias("asks"), donor))
    pairs = class_pairs(classes, most)
    both = pairs.unionByName(pairs.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "distance"))
    both = both.unionByName(classes.select(F.col("rep").alias("id1"), F.col("rep").alias("id2"), F.lit(0).alias("distance")))
    donors = classes.filter("donor is not null").select(F.col("rep").alias("id2"), "donor")
    asking = classes.filter("asks").select(F.col("rep").alias("id1"), "h", "g")
    best = both.join(asking, "id1").join(donors, "id2").groupBy("h", "g").agg(F.min(F.struct("distance", F.col("donor.id").alias("d"), "donor.latitude", "donor.longitude")).alias("m"))
    targets = rows.filter("zero").join(best, ["h", "g"])
    return targets.select(F.col("id").alias("image_id"), F.col("m.d").alias("donor_id"), F.col("m.latitude").alias("latitude"), F.col("m.longitude").alias("longitude"), F.col("m.distance").alias("distance"))


def verify_report(rows: DataFrame, photos: DataFrame, most: int) -> DataFrame:
    """(file_path, distance, restore) of a report's DELETE lines: how far the file is from its group's KEEP, null if either hash is unreadable."""
    h = photos.select("file_path", lanes(clean_hash("phash")).alias("l"))
    at = rows.select("group_id", "action", "file_path").join(h, "file_path", "left")
    keep = at.filter("action = 'KEEP'").select("group_id", F.col("l").alias("k"))
    d = F.when(F.col("l")[0].isNotNull() & F.col("k")[0].isNotNull(), hamming(F.col("l"), F.col("k")))
    return at.filter("action = 'DELETE'").join(keep, "group_id", "left").select("file_path", d.alias("distance"), F.coalesce(d > most, F.lit(False)).alias("restore"))


def compare_groupings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(group_id, members, parts, verdict): how the old groups fare under a new grouping; ids in no new group stand alone."""
    both = old.select("group_id", "id").join(new.select("id", F.col("group_id").alias("n")), "id", "left")
    alone = F.when(F.col("n").isNull(), F.col("id"))
    got = both.groupBy("group_id").agg(F.count("*").alias("members"), (F.countDistinct("n") + F.countDistinct(alone)).alias("parts"))
    return got.withColumn("verdict", F.when(F.col("parts") == 1, "kept").otherwise("split"))


def share_positions(members: DataFrame, photos: DataFrame) -> DataFrame:
    """(id, latitude, longitude) for members at exactly (0, 0): the position of their group's smallest id that has one."""
    at = members.join(photos.select(F.col("image_id").alias("id"), "latitude", "longitude"), "id")
    zero = F.coalesce((F.col("latitude") == 0) & (F.col("longitude") == 0), F.lit(False))
    good = at.filter(has_gps() & ~zero).groupBy("group_id").agg(F.min(F.struct("id", "latitude", "longitude")).alias("g"))
    return at.filter(zero).join(good, "group_id").select("id", F.col("g.latitude").alias("latitude"), F.col("g.longitude").alias("longitude"))


def groups_without_position(members: DataFrame, photos: DataFrame) -> DataFrame:
    """(group_id) of groups in which no photo has a position."""
    at = members.join(photos.select(F.col("image_id").alias("id"), "latitude", "longitude"), "id")
    placed = has_gps() & ~((F.col("latitude") == 0) & (F.col("longitude") == 0))
    return at.groupBy("group_id").agg(F.bool_or(placed).alias("p")).filter("not p").select("group_id")


def picked_groups(text: str) -> list[tuple[int, int]]:
    """Ranges of a selector such as '1 3-5 8'; unreadable parts are skipped."""
    out = []
    for part in text.split():
        a, _, b = part.partition("-")
        if a.isdigit() and (b.isdigit() or not _):
            out.append((int(a), int(b or a)))
    return out


def copy_plan(report: DataFrame, selector: str, target: str, group: str = "group_id") -> DataFrame:
    """(group, src, dst) to copy the files of chosen groups, numbered within the group, KEEP first."""
    want = F.lit(False)
    for a, b in picked_groups(selector):
        want = want | F.col(group).between(a, b)
    w = Window.partitionBy(group).orderBy(F.desc("action"), "file_path")
    rows = report.filter(want).withColumn("n", F.row_number().over(w))
    name = F.element_at(F.split("file_path", "/"), -1)
    dst = F.concat(F.lit(target.rstrip("/") + "/"), F.col(group).cast("string"), F.lit("/"), F.format_string("%02d_%s_", "n", "action"), name)
    return rows.select(group, F.col("file_path").alias("src"), dst.alias("dst"))


def size_hash_groups(photos: DataFrame, most: int = 6, same_format: bool = True) -> DataFrame:
    """(id, group_id) of photos that agree in size (and format group) and lie within ``most`` bits of another such photo, closed over chains.

    The size is part of every bucket, so only photos of one size meet; group_id, the smallest id, is the one to keep.
    """
    sized = photos.filter("file_size is not null").withColumn("__part", F.concat_ws("/", F.col("file_size").cast("string"), format_group(extension("file_path")) if same_format else F.lit("")))
    return hash_groups(sized, most, part=F.col("__part"))


def by_size(groups: DataFrame) -> DataFrame:
    """(group_id, n, place): the groups, largest first, ties by their smallest id."""
    n = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    return numbered(n, [], [F.desc("n"), F.asc("group_id")], "place")


def enriched(groups: DataFrame, photos: DataFrame) -> DataFrame:
    """Groups with each photo's name, format group, size and whether it has a position."""
    p = photos.select(F.col("image_id").alias("id"), "file_name", format_group(extension("file_path")).alias("kind"), "file_size", F.coalesce(has_gps(), F.lit(False)).alias("has_gps"))
    return groups.join(p, "id")


def report_deletion(report: DataFrame, photos: DataFrame, on_disk: DataFrame) -> DataFrame:
    """A dry run: how many paths a report deletes, how many of them are there, and how many photos would go."""
    paths = report.filter("action = 'DELETE'").select("file_path")
    there = on_disk.select("file_path").distinct().withColumn("__t", F.lit(True))
    total = paths.join(there, "file_path", "left").agg(F.count("*").alias("total"), F.count("__t").alias("existing"))
    return total.crossJoin(photos.join(paths, "file_path", "left_semi").agg(F.count("*").alias("photos")))


def without_reported(report: DataFrame, photos: DataFrame) -> DataFrame:
    """Photos after a report's DELETE lines were carried out."""
    return photos.join(report.filter("action = 'DELETE'").select("file_path"), "file_path", "left_anti")
