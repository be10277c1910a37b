"""Nearest airports by rings that follow the density."""

import math
import random

from aerodeck.operators import select


def _km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def _both(spark, points, airports, radius, limit):
    p = spark.createDataFrame(points, "pid long, lat double, lon double")
    a = spark.createDataFrame(airports, "icao string, lat double, lon double")
    got = {(r.pid, r.rank): r.icao for r in select.nearest_airports(p, a, radius, limit).collect()}
    want = {}
    for i, lat, lon in points:
        if lat is None or lon is None:
            continue
        near = sorted((_km(lat, lon, b, c), n) for n, b, c in airports if b is not None and _km(lat, lon, b, c) <= radius)
        want |= {(i, k + 1): n for k, (_, n) in enumerate(near[:limit])}
    return got, want


def test_equal_to_brute_force_over_dense_sparse_poles_and_date_line(spark):
    rnd = random.Random(3)
    airports = [(f"D{i:04}", 50 + rnd.random() * 3, 8 + rnd.random() * 3) for i in range(1500)]
    airports += [(f"W{i:04}", rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(400)]
    airports += [("P1", 89.9, 10.0), ("P2", 89.5, -170.0), ("P3", -90.0, 0.0), ("L1", 0.0, 179.9), ("L2", 0.0, -179.9), ("N1", None, None)]
    airports += [(f"T{i}", 20.0, 20.0) for i in range(8)]
    points = [(i, 49 + rnd.random() * 5, 7 + rnd.random() * 5) for i in range(60)]
    points += [(100 + i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(60)]
    points += [(200, 90.0, 0.0), (201, -89.0, 179.0), (202, 0.1, 180.0), (203, 0.1, -180.0), (204, 20.0, 20.0), (205, None, 1.0), (206, 79.0, 5.0)]
    for radius, limit in ((60, 16), (500, 4), (3000, 4), (12000, 3)):
        got, want = _both(spark, points, airports, radius, limit)
        assert got == want, (radius, limit)


def test_candidates_follow_density_not_radius(spark):
    airports = spark.range(40000).selectExpr("concat('A', id) AS icao", "30 + (id div 200) * 0.2 AS lat", "0.2 * (id % 200) AS lon")
    points = spark.range(500).selectExpr("id AS pid", "40 + (id div 25) * 0.91 AS lat", "10 + (id % 25) * 0.83 AS lon")
    pairs = select.nearest_candidates(points, airports, 3000, 4).count()
    assert pairs <= 500 * 200  # 12,000 and more of the 40,000 airports lie within the radius of each point


def test_empty_sides(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0)], "pid long, lat double, lon double")
    a = spark.createDataFrame([], "icao string, lat double, lon double")
    assert select.nearest_airports(p, a, 500, 4).count() == 0
    assert select.nearest_airports(p.filter("pid < 0"), spark.createDataFrame([("A", 1.0, 1.0)], "icao string, lat double, lon double"), 500, 4).count() == 0


def test_candidates_follow_density_at_the_pole(spark):
    airports = spark.range(9000).selectExpr("concat('A', id) AS icao", "81 + (id div 900) * 0.9 AS lat", "0.4 * (id % 900) AS lon")
    points = spark.range(100).selectExpr("id AS pid", "81.3 + (id div 10) * 0.8 AS lat", "36.0 * (id % 10) AS lon")
    assert select.nearest_candidates(points, airports, 2000, 4).count() <= 100 * 200
