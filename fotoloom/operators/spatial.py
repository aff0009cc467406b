"""Points in or near regions: sample-driven quadtree, boundary replication, R-tree probing, exact refinement.

Every point belongs to exactly one quadtree leaf; a region goes to each leaf its box touches. A region
that crosses the 180th meridian has two boxes, which may meet in one leaf, and the point itself is the
reference point: its leaf alone reports the pair, so no pair comes out of two leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

EARTH_RADIUS_M = 6371008.8
#: Rows that one task should hold; leaves that cannot be split further are cut into slices of this size.
LEAF_ROWS = 25_000
REGION_ROWS = 20_000
#: Bound of the sample that shapes the quadtree and so of the leaves sent to the tasks.
SAMPLE_ROWS = 40_000
MAX_DEPTH = 20
_FANOUT = 16


def has_position(lat: str = "latitude", lon: str = "longitude"):
    """Both coordinates are numbers on the globe and not both 0."""
    a, o = F.col(lat), F.col(lon)
    number = a.isNotNull() & o.isNotNull() & ~F.isnan(a) & ~F.isnan(o)
    return number & ~((a == 0) & (o == 0)) & (F.abs(a) <= 90) & (F.abs(o) <= 180)


def great_circle_m(lat1, lon1, lat2, lon2):
    """Haversine distance as a Column."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _np_distance(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


class Quadtree:
    """Leaves over the globe in Z-order, made from a sample so that each holds about as many rows."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, weight: float, leaf_rows: int):
        code = np.sort(self.code(lat, lon))
        self.start, self.depth, self.rows = [], [], []
        todo = [(0, 0, 0, len(code))]
        while todo:
            first, depth, lo, hi = todo.pop()
            if depth == MAX_DEPTH or (hi - lo) * weight <= leaf_rows:
                self.start.append(first), self.depth.append(depth), self.rows.append((hi - lo) * weight)
                continue
            step = 1 << 2 * (MAX_DEPTH - depth - 1)
            cuts = [lo, *(lo + np.searchsorted(code[lo:hi], first + step * np.arange(1, 4))), hi]
            todo += [(first + step * q, depth + 1, int(cuts[q]), int(cuts[q + 1])) for q in range(4)]
        order = np.argsort(self.start)
        self.start = np.array(self.start, dtype=np.int64)[order]
        self.depth = np.array(self.depth)[order]
        self.slices = np.maximum(1, np.ceil(np.array(self.rows)[order] / leaf_rows)).astype(np.int32)
        x, y = self._spread(self.start), self._spread(self.start >> 1)
        side = 1 << (MAX_DEPTH - self.depth)
        unit = np.array([360.0, 180.0]) / (1 << MAX_DEPTH)
        self.box = np.stack([x * unit[0] - 180, y * unit[1] - 90, (x + side) * unit[0] - 180, (y + side) * unit[1] - 90], 1)

    @staticmethod
    def _spread(code: np.ndarray) -> np.ndarray:
        out = np.zeros_like(code)
        for b in range(MAX_DEPTH):
            out |= ((code >> (2 * b)) & 1) << b
        return out

    @staticmethod
    def code(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        n = 1 << MAX_DEPTH
        x = np.clip((np.asarray(lon) + 180) / 360 * n, 0, n - 1).astype(np.int64)
        y = np.clip((np.asarray(lat) + 90) / 180 * n, 0, n - 1).astype(np.int64)
        out = np.zeros(len(x), dtype=np.int64)
        for b in range(MAX_DEPTH):
            out |= ((x >> b) & 1) << (2 * b) | ((y >> b) & 1) << (2 * b + 1)
        return out

    def leaf(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, self.code(lat, lon), side="right") - 1

    def touched(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of (box, leaf) that meet. A box whose corners lie inside one leaf meets that one alone; only the others are held against all leaves."""
        corner = [self.leaf(np.clip(boxes[:, y], -90, 90), np.clip(boxes[:, x], -180, 180)) for x in (0, 2) for y in (1, 3)]
        own, b = corner[0], self.box
        at = b[own]
        inside = np.all([c == own for c in corner], axis=0) & (at[:, 0] < boxes[:, 0]) & (at[:, 1] < boxes[:, 1]) & (at[:, 2] > boxes[:, 2]) & (at[:, 3] > boxes[:, 3])
        row, leaf = [np.flatnonzero(inside)], [own[inside]]
        for i in np.flatnonzero(~inside).tolist():
            x0, y0, x1, y1 = boxes[i]
            hit = np.flatnonzero((b[:, 0] <= x1) & (b[:, 2] >= x0) & (b[:, 1] <= y1) & (b[:, 3] >= y0))
            row.append(np.full(len(hit), i)), leaf.append(hit)
        return np.concatenate(row), np.concatenate(leaf)


class RTree:
    """Boxes (x0, y0, x1, y1) packed by sort-tile-recursive; probed with all points at once."""

    def __init__(self, box: np.ndarray):
        n = len(box)
        strips = max(1, int(np.ceil(np.sqrt(n / _FANOUT))))
        by_x = np.argsort(box[:, 0] + box[:, 2], kind="stable")
        strip = np.empty(n, dtype=np.int64)
        strip[by_x] = np.arange(n) * strips // max(1, n)
        self.order = np.lexsort((box[:, 1] + box[:, 3], strip))
        self.levels = [box[self.order]]
        while len(self.levels[-1]) > _FANOUT:
            b = self.levels[-1]
            at = np.arange(0, len(b), _FANOUT)
            self.levels.append(np.concatenate([np.minimum.reduceat(b[:, :2], at), np.maximum.reduceat(b[:, 2:], at)], 1))

    def probe(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of (point, box) that meet."""
        top = self.levels[-1]
        p, b = np.repeat(np.arange(len(x)), len(top)), np.tile(np.arange(len(top)), len(x))
        for i, level in enumerate(reversed(self.levels)):
            if i:
                p, b = np.repeat(p, _FANOUT), (b[:, None] * _FANOUT + np.arange(_FANOUT)).ravel()
                keep = b < len(level)
                p, b = p[keep], b[keep]
            q = level[b]
            keep = (x[p] >= q[:, 0]) & (x[p] <= q[:, 2]) & (y[p] >= q[:, 1]) & (y[p] <= q[:, 3])
            p, b = p[keep], b[keep]
        return p, self.order[b]


def _inside(px: np.ndarray, py: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Even-odd rule; the ring closes itself, a repeated first point adds an edge of no length."""
    x2, y2 = np.roll(xs, -1), np.roll(ys, -1)
    cross = (ys[:, None] > py) != (y2[:, None] > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = xs[:, None] + (py - ys[:, None]) * ((x2 - xs) / (y2 - ys))[:, None]
    return (np.count_nonzero(cross & (px < at), axis=0) % 2) == 1


def _edge_distance(px: np.ndarray, py: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Metres to the ring, whose edges are straight in degrees: the great-circle distance to the point of each edge
    that is nearest in the plane whose longitudes shrink as at the point; an edge may be met across longitude 180."""
    least = np.full(len(px), np.inf)
    for x, y, ex, ey in zip(xs, ys, np.roll(xs, -1) - xs, np.roll(ys, -1) - ys):
        at = px + 360 * np.round((x + ex / 2 - px) / 360)
        k = np.cos(np.radians(py)) ** 2
        long = ex * ex * k + ey * ey
        t = np.clip(((at - x) * ex * k + (py - y) * ey) / np.where(long > 0, long, 1), 0, 1)
        least = np.minimum(least, _np_distance(y + t * ey, x + t * ex, py, at))
    return least


def regions(places: DataFrame, region_id: str = "place_id", kind: str = "place_kind", margin_m: float = 0.0) -> DataFrame:
    """Normalise places to (region_id, lat, lon, radius_m, xs, ys, x0, y0, x1, y1, margin_m), a row per box.

    Circles with null, negative or non-number fields and outlines of fewer than three points hold no
    point and are left out; ``margin_m`` widens circles and outlines.
    """
    pad = 1e-9
    circle = places.filter(
        (F.col(kind) == "circle") & (F.col("radius_m") >= 0) & ~F.isnan("radius_m") & (F.abs("latitude") <= 90)
        & F.col("longitude").isNotNull() & ~F.isnan("longitude") & F.col(region_id).isNotNull()
    ).select(
        F.col(region_id).alias("region_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        (F.col("radius_m") + margin_m).alias("radius_m"),
    )
    angle = F.col("radius_m") / EARTH_RADIUS_M
    circle = circle.withColumn("d", F.degrees(angle) + pad)
    polar = (F.abs("lat") + F.col("d")) >= 90
    circle = circle.withColumn(
        "w", F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians("lat"))))) + pad)
    )
    box = lambda x0, x1: F.struct(x0.alias("x0"), x1.alias("x1"))
    lo, hi = F.col("lon") - F.col("w"), F.col("lon") + F.col("w")
    west, east = F.lit(-180.0), F.lit(180.0)
    boxes = lambda whole, lo, hi: F.explode(
        F.when(whole, F.array(box(west, east)))
        .when(lo < -180, F.array(box(west, hi), box(lo + 360, east)))
        .when(hi > 180, F.array(box(lo, east), box(west, hi - 360)))
        .otherwise(F.array(box(lo, hi)))
    )
    circle = circle.withColumn("b", boxes(F.col("w") >= 180, lo, hi)).select(
        "region_id", "lat", "lon", "radius_m", F.lit(None).cast("array<double>").alias("xs"), F.lit(None).cast("array<double>").alias("ys"),
        "b.x0", (F.col("lat") - F.col("d")).alias("y0"), "b.x1", (F.col("lat") + F.col("d")).alias("y1"),
    )
    ring = F.filter("outline", lambda p: p.isNotNull() & p["latitude"].isNotNull() & p["longitude"].isNotNull())
    outline = places.filter((F.col(kind) == "outline") & F.col(region_id).isNotNull()).select(
        F.col(region_id).alias("region_id"), F.transform(ring, lambda p: p["longitude"]).alias("xs"), F.transform(ring, lambda p: p["latitude"]).alias("ys")
    )
    null = F.lit(None).cast("double")
    outline = outline.filter(F.size("xs") >= 3).select(
        "region_id", null.alias("lat"), null.alias("lon"), null.alias("radius_m"), "xs", "ys",
        F.array_min("xs").alias("x0"), F.array_min("ys").alias("y0"), F.array_max("xs").alias("x1"), F.array_max("ys").alias("y1"),
    )
    if margin_m:
        angle = margin_m / EARTH_RADIUS_M
        d = float(np.degrees(angle)) + pad
        far = F.greatest(F.abs("y0"), F.abs("y1"))  # the latitude where the margin is widest in degrees
        w = F.when(far + d >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(float(np.sin(angle))) / F.cos(F.radians(far))))) + pad)
        lo, hi = F.col("x0") - w, F.col("x1") + w
        outline = outline.withColumn("b", boxes((hi - lo >= 360) | ((lo < -180) & (hi > 180)), lo, hi)).select(
            "region_id", "lat", "lon", "radius_m", "xs", "ys", "b.x0", (F.col("y0") - d).alias("y0"), "b.x1", (F.col("y1") + d).alias("y1")
        )
    return circle.unionByName(outline).withColumn("margin_m", F.lit(float(margin_m)))


def _mixed(ids: pd.Series) -> np.ndarray:
    """A number from 0 that spreads ids evenly."""
    return (ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(34)).astype(np.int64)


def points_in_regions(
    points: DataFrame, point_id: str, region_rows: DataFrame, lat: str = "latitude", lon: str = "longitude", metres: bool = False, unique_points: bool = False
) -> DataFrame:
    """Every (region_id, point_id) where the point lies in the region (see ``regions``), each once.

    With ``metres`` also the distance to a circle's centre or an outline's nearest edge (0 inside).

    Points without a position (``has_position``) and null ids take no part; a repeated point id gives
    one row (``unique_points`` says that there is none, which saves a shuffle of the result); empty
    inputs give an empty result; further columns of ``points`` are not read.
    """
    spark = points.sparkSession
    pts = points.filter(has_position(lat, lon) & F.col(point_id).isNotNull()).select(
        F.col(point_id).cast("bigint").alias("point_id"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x")
    )
    total = pts.count()
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    sample = pts.select("x", "y").sample(share, seed=7).limit(2 * SAMPLE_ROWS).toPandas()
    tree = Quadtree(sample.y.to_numpy(), sample.x.to_numpy(), 1 / share, LEAF_ROWS)
    shared = spark.sparkContext.broadcast(tree)

    def leaves(it):
        for r in it:
            i, leaf = shared.value.touched(r[["x0", "y0", "x1", "y1"]].to_numpy(np.float64))
            yield r.iloc[i].assign(leaf=leaf.astype(np.int32))

    boxes = region_rows.mapInPandas(leaves, T.StructType([*region_rows.schema.fields, T.StructField("leaf", T.IntegerType())]))
    held = {r[0]: r[1] for r in boxes.select("leaf").groupBy("leaf").count().collect()}  # a row per leaf at most
    parts = np.array([-(-held.get(i, 0) // REGION_ROWS) for i in range(len(tree.start))], dtype=np.int64)
    cuts = spark.sparkContext.broadcast((tree.slices.astype(np.int64), parts))

    # A task is (leaf, slice of its points, slice of its regions): either side is copied only as often
    # as the other is sliced, and both slices are bounded. Leaves without any region need no task.
    def copies(leaf: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.repeat(np.arange(len(leaf)), many)
        return i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)

    def point_tasks(it):
        slices, parts = cuts.value
        for p in it:
            leaf = shared.value.leaf(p.y.to_numpy(), p.x.to_numpy())
            i, k = copies(leaf, parts[leaf])
            own = (_mixed(p.point_id) % slices[leaf] * parts[leaf])[i]
            yield p.iloc[i].assign(leaf=leaf[i].astype(np.int32), task=(own + k).astype(np.int32))

    def region_tasks(it):
        slices, parts = cuts.value
        for r in it:
            leaf = r.leaf.to_numpy()
            i, k = copies(leaf, slices[leaf])
            own = (_mixed(r.region_id) % np.maximum(1, parts[leaf]))[i]
            yield r.iloc[i].assign(task=(k * parts[leaf][i] + own).astype(np.int32))

    pts = pts.mapInPandas(point_tasks, "point_id bigint, y double, x double, leaf int, task int")
    boxes = boxes.mapInPandas(region_tasks, T.StructType([*boxes.schema.fields, T.StructField("task", T.IntegerType())]))

    def probe(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"region_id": np.empty(0, np.int64), "point_id": np.empty(0, np.int64), "metres": np.empty(0)})
        if p.empty or r.empty:
            return none
        x, y = p.x.to_numpy(), p.y.to_numpy()
        at, hit = RTree(r[["x0", "y0", "x1", "y1"]].to_numpy()).probe(x, y)
        order = np.argsort(hit, kind="stable")
        at, hit = at[order], hit[order]
        lat0, lon0, rad = (r[c].to_numpy(dtype=np.float64) for c in ("lat", "lon", "radius_m"))
        ok, far, margin = np.zeros(len(at), dtype=bool), np.zeros(len(at)), r.margin_m.to_numpy(dtype=np.float64)
        round_ = ~np.isnan(rad[hit])
        far[round_] = _np_distance(lat0[hit[round_]], lon0[hit[round_]], y[at[round_]], x[at[round_]])
        ok[round_] = far[round_] <= rad[hit[round_]]
        edge = np.flatnonzero(np.diff(hit)) + 1
        for part in np.split(np.arange(len(hit)), edge):
            if len(part) and np.isnan(rad[hit[part[0]]]):
                i = hit[part[0]]
                xs, ys = np.asarray(r["xs"].iloc[i], float), np.asarray(r["ys"].iloc[i], float)
                ok[part] = _inside(x[at[part]], y[at[part]], xs, ys)
                if margin[i] > 0:
                    out = part[~ok[part]]
                    far[out] = _edge_distance(x[at[out]], y[at[out]], xs, ys)
                    ok[out] = far[out] <= margin[i]
        # Two boxes of one region that meet in a leaf may both report the point.
        out = pd.DataFrame({"region_id": r.region_id.to_numpy()[hit[ok]], "point_id": p.point_id.to_numpy()[at[ok]], "metres": far[ok]})
        return out.drop_duplicates(["region_id", "point_id"])

    out = T.StructType([T.StructField("region_id", T.LongType()), T.StructField("point_id", T.LongType()), T.StructField("metres", T.DoubleType())])
    found = pts.groupBy("leaf", "task").cogroup(boxes.groupBy("leaf", "task")).applyInPandas(probe, out)
    found = found if metres else found.select("region_id", "point_id")
    return found if unique_points else found.dropDuplicates(["region_id", "point_id"])


def near_points(points: DataFrame, point_id: str, queries: DataFrame, query_id: str, radius_m: float) -> DataFrame:
    """Every (query_id, point_id) not farther apart than radius_m, for inputs whose positions hold few points each; a query never meets itself.

    ``queries`` is a stated set of locations with latitude and longitude; all points are searched.
    """
    found = points_in_regions(points, point_id, _circles(queries, query_id, radius_m))
    return found.select(F.col("region_id").alias("query_id"), "point_id").filter("query_id <> point_id")


def _circles(queries: DataFrame, query_id: str, radius_m: float) -> DataFrame:
    asked = queries.filter(has_position() & F.col(query_id).isNotNull()).select(
        F.col(query_id).cast("bigint").alias("place_id"), F.lit("circle").alias("place_kind"), "latitude", "longitude",
        F.lit(float(radius_m)).alias("radius_m"), F.lit(None).cast("array<struct<latitude:double,longitude:double>>").alias("outline"),
    )
    return regions(asked.distinct()).filter("radius_m is not null")


def near_positions(points: DataFrame, point_id: str, queries: DataFrame, query_id: str, radius_m: float) -> DataFrame:
    """(query_id, near_id, n): for every query the positions not farther away than radius_m.

    ``queries`` is a stated set of locations with latitude and longitude; all points are searched. Points
    at one and the same position are one class, named by its smallest id and with its number of points,
    so that a spot with a third of all points is one row; a query itself is not counted. Rows without
    position or id take no part, of rows of one id and position one counts.
    """
    spots = points.filter(has_position() & F.col(point_id).isNotNull()).select(F.col(point_id).cast("bigint").alias("id"), "latitude", "longitude")
    spots = spots.groupBy("latitude", "longitude").agg(F.min("id").alias("near_id"), F.count_distinct("id").alias("n"))
    asked = queries.filter(has_position() & F.col(query_id).isNotNull()).select(F.col(query_id).cast("bigint").alias("q"), "latitude", "longitude").distinct()
    found = points_in_regions(spots.select("near_id", "latitude", "longitude"), "near_id", _circles(queries, query_id, radius_m), unique_points=True)
    own = asked.join(spots, ["latitude", "longitude"]).select(F.col("q").alias("region_id"), F.col("near_id").alias("point_id"), F.lit(1).alias("__own"))
    found = found.join(spots.select(F.col("near_id").alias("point_id"), "n"), "point_id").join(own, ["region_id", "point_id"], "left")
    n = F.col("n") - F.coalesce("__own", F.lit(0))
    return found.select(F.col("region_id").alias("query_id"), F.col("point_id").alias("near_id"), n.alias("n")).filter("n > 0")
