import numpy as np

from fotoloom.operators import spatial as sp

POINT = "image_id bigint, latitude double, longitude double, x double, leaf int, task int"
PLACE = "place_id bigint, place_kind string, latitude double, longitude double, radius_m double, outline array<struct<latitude double, longitude double>>, d int"


def brute(points, places):
    out = set()
    for pid, kind, la, lo, rad, ring, _ in places:
        for i, y, x, *_ in points:
            if None in (i, y, x) or np.isnan(y) or np.isnan(x) or (y == 0 and x == 0) or abs(y) > 90 or abs(x) > 180:
                continue
            if kind == "circle" and None not in (la, lo, rad):
                hit = sp._np_distance(la, lo, y, x) <= rad
            elif kind == "outline" and ring:
                ys, xs = np.array([p[0] for p in ring]), np.array([p[1] for p in ring])
                hit = bool(sp._inside(np.array([x]), np.array([y]), xs, ys)[0])
            else:
                hit = False
            if hit:
                out.add((pid, i))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sp, "LEAF_ROWS", 40)
    monkeypatch.setattr(sp, "REGION_ROWS", 3)
    rng = np.random.default_rng(1)
    pts = [(i, float(y), float(x), 0.0, 0, 0) for i, (y, x) in enumerate(zip(rng.normal(50, 5, 400), rng.normal(10, 8, 400)))]
    pts += [(1000 + i, 50.0, 10.0, 0.0, 0, 0) for i in range(200)]  # a third of all points in one place
    pts += [(2000, 12.3, 179.99, 0.0, 0, 0), (2001, 12.3, -179.99, 0.0, 0, 0), (2002, 89.99, 100.0, 0.0, 0, 0), (2003, 0.0, 0.0, 0.0, 0, 0), (2004, None, 1.0, 0.0, 0, 0),
            (2005, float("nan"), 1.0, 0.0, 0, 0), (2006, 95.0, 1.0, 0.0, 0, 0), (None, 50.0, 10.0, 0.0, 0, 0), (1000, 50.0, 10.0, 0.0, 0, 0)]
    places = [(1, "circle", 12.3, 179.995, 5000.0, None, 0), (2, "circle", 89.97, 40.0, 5000.0, None, 0), (3, "circle", 50.0, 10.0, 300000.0, None, 0),
              (4, "circle", None, 10.0, 5.0, None, 0), (5, "circle", 50.0, 10.0, -5.0, None, 0), (6, "outline", None, None, None, [(45.0, 5.0), (55.0, 5.0), (50.0, 20.0)], 0),
              (7, "outline", None, None, None, [(45.0, 5.0), (55.0, 5.0)], 0), (8, "outline", None, None, None, None, 0),
              (9, "outline", None, None, None, [(52.0, 9.0), (52.0, 12.0), (49.0, 12.0), (49.0, 9.0), (52.0, 9.0)], 0), (10, "unknown", 50.0, 10.0, 1e6, None, 0)]
    places += [(20 + i, "circle", 50.0, 10.0, 1000.0 * i, None, 0) for i in range(8)]
    got = sp.points_in_regions(spark.createDataFrame(pts, POINT), "image_id", sp.regions(spark.createDataFrame(places, PLACE)))
    rows = [(r.region_id, r.point_id) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(pts, [p for p in places if p[0] not in (5, 7)])


def test_near_points(spark):
    pts = spark.createDataFrame([(1, 50.0, 10.0), (2, 50.001, 10.0), (3, 51.0, 10.0)], "image_id bigint, latitude double, longitude double")
    got = {(r.query_id, r.point_id) for r in sp.near_points(pts, "image_id", pts, "image_id", 200).collect()}
    assert got == {(1, 2), (2, 1)}


def test_empty(spark):
    none, place = spark.createDataFrame([], POINT), spark.createDataFrame([(1, "circle", 1.0, 1.0, 5.0, None, 0)], PLACE)
    assert sp.points_in_regions(none, "image_id", sp.regions(place)).count() == 0
    some = spark.createDataFrame([(1, 1.0, 1.0, 0.0, 0, 0)], POINT)
    assert sp.points_in_regions(some, "image_id", sp.regions(place.limit(0))).count() == 0


def test_near_outlines(spark):
    square = [(10.0, 179.9), (10.0, 179.995), (10.1, 179.995), (10.1, 179.9)]
    pts = [(1, 10.05, 179.95), (2, 10.105, 179.95), (3, 10.05, -179.999), (4, 10.05, -179.9), (5, 10.12, 179.95), (6, 10.0001, 179.8995)]
    pts = spark.createDataFrame([(*p, 0.0, 0, 0) for p in pts], POINT)
    place = spark.createDataFrame([(1, "outline", None, None, None, square, 0)], PLACE)
    got = {r.point_id: round(r.metres) for r in sp.points_in_regions(pts, "image_id", sp.regions(place, margin_m=1000.0), metres=True).collect()}
    assert got == {1: 0, 2: 556, 3: 657, 6: 55}
