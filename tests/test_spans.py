"""Spans against exact areas, cells and point tests."""

import math
import random

from pyspark.sql import functions as F

from aerodeck.functions import shapes
from aerodeck.operators import overlay, spans
from aerodeck.operators.spatial import edges_of

KIND = f"icao string, fid int, geom {shapes.GEOM}"


def polys(spark, rows):
    return spark.createDataFrame([("A", fid, [[(float(x), float(y)) for x, y in [*ring, ring[0]]] for ring in rings]) for fid, rings in rows], KIND)


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def turned(ring, degrees, cx=0.0, cy=0.0):
    s, k = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
    return [(cx + (x - cx) * k - (y - cy) * s, cy + (x - cx) * s + (y - cy) * k) for x, y in ring]


def areas(df):
    return {r.fid: r.a for r in df.groupBy("fid").agg(F.sum("area").alias("a")).collect()}


def test_areas_of_rectangles_are_exact(spark):
    rows = [(1, [box(0, 0, 100, 60)]), (2, [turned(box(300, 50, 80, 40), 33, 300, 50)]), (3, [box(-50, -50, 30, 30), box(-45, -45, 10, 10)[::-1]])]
    s = spans.of_polygons(polys(spark, rows), ["fid"])
    got = areas(spans.measured(s, ["icao", "fid"]))
    assert abs(got[1] - 6000) < 1e-6 and abs(got[2] - 3200) < 1.0 and abs(got[3] - 800) < 1e-6
    rings = spans.polygons(s, ["icao", "fid"])
    traced = areas(rings)
    assert all(abs(traced[f] - got[f]) < 1e-6 for f in got)
    assert {r.fid: len(r.geom) for r in rings.collect()} == {1: 1, 2: 1, 3: 2}  # the hole stays a hole
    assert rings.filter(shapes.signed_area(F.col("geom")[0]) <= 0).count() == 0


def test_difference_and_intersection(spark):
    own = polys(spark, [(1, [box(0, 0, 100, 60)]), (2, [box(500, 0, 40, 40)]), (3, [box(0, 0, 20, 20)])])
    cut = polys(spark, [(9, [box(30, -10, 20, 100)]), (8, [box(40, 10, 25, 20)]), (7, [box(-1, -1, 25, 25)])])
    got = spans.remainders(own, cut, ["fid"]).collect()
    by = {f: sorted(round(r.area, 6) for r in got if r.fid == f) for f in (1, 2, 3)}
    # 24 x 24 of the corner, a bar of 20 x 60 and 15 x 20 beside it are cut from the first.
    assert by == {1: [30 * 60 - 24 * 24, 50 * 60 - 15 * 20], 2: [1600.0], 3: []}
    assert next(r for r in got if r.fid == 2).geom == own.filter("fid = 2").first().geom
    inside = spans.common(spans.of_polygons(own, ["fid"]), spans.cover(cut), ["fid"])
    assert {f: round(a, 6) for f, a in areas(spans.measured(inside, ["icao", "fid"])).items()} == {1: 24 * 24 + 20 * 60 + 15 * 20, 3: 400.0}


def test_random_overlays_against_points(spark):
    r = random.Random(5)
    shape = lambda: turned(box(r.uniform(-300, 300), r.uniform(-300, 300), r.uniform(5, 200), r.uniform(5, 200)), r.uniform(0, 90))
    own, cut = [(i, [shape()]) for i in range(12)], [(i, [shape()]) for i in range(12)]
    rest = spans.minus(spans.of_polygons(polys(spark, own), ["fid"], 2.0), spans.cover(polys(spark, cut), 2.0), ["fid"]).collect()

    def inside(ring, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    for _ in range(3000):
        fid, x, row = r.randrange(12), r.uniform(-400, 400), r.randrange(-200, 200)
        y = (row + 0.5) * 2.0
        want = inside(own[fid][1][0], x, y) and not any(inside(rings[0], x, y) for _, rings in cut)
        assert want == any(s.fid == fid and s.row == row and s.x0 < x < s.x1 for s in rest)
    for fid in {s.fid for s in rest}:
        mine = [(s.row, s.x0, s.x1) for s in rest if s.fid == fid]
        rings = spans.rings_of(mine, 2.0)
        area = sum(p[0] * q[1] - q[0] * p[1] for poly in rings for ring in poly for p, q in zip(ring, ring[1:])) / 2
        assert abs(area - 2.0 * sum(b - a for _, a, b in mine)) < 1e-6


def test_offsets_have_round_corners(spark):
    w = 3.5
    el = [(0, 0), (100, 0), (100, 30), (40, 30), (40, 90), (0, 90)]
    rows = [(1, [box(0, 0, 100, 60)]), (2, [turned(box(0, 0, 100, 60), 27)]), (3, [el]), (4, [turned(el, 61)])]
    df = polys(spark, rows)
    both = spans.of_polygons(df, ["fid"], 0.5).unionByName(spans.of_buffers(edges_of(df, ["icao", "fid"]), ["icao", "fid"], w, 0.5))
    got = areas(spans.measured(spans.united(both, ["icao", "fid"]), ["icao", "fid"], 0.5))
    rect = 6000 + 320 * w + math.pi * w * w
    ell = 3000 + 40 * 60 + 380 * w + math.pi * w * w * 5 / 4 - w * w  # five outer corners and an inner one
    for fid, want in ((1, rect), (2, rect), (3, ell), (4, ell)):
        own = 6000 if fid < 3 else 5400
        assert abs((got[fid] - own) / (want - own) - 1) < 0.005


def test_buffers_of_single_segments(spark):
    rows = [("A", i, *p) for i, p in enumerate([(0.0, 0.0, 50.0, 0.0), (0.0, 0.0, 0.0, 50.0), (3.0, 4.0, 33.0, 44.0), (33.0, 4.0, 3.0, 44.0), (7.0, 7.0, 7.0, 7.0)])]
    segs = spark.createDataFrame(rows, "icao string, fid int, ax double, ay double, bx double, by double")
    got = areas(spans.measured(spans.of_buffers(segs, ["icao", "fid"], 10.0, 0.25), ["icao", "fid"], 0.25))
    for _, fid, ax, ay, bx, by in rows:
        want = 20 * math.hypot(bx - ax, by - ay) + math.pi * 100
        assert abs(got[fid] / want - 1) < 0.002


def test_nothing(spark):
    none = polys(spark, [])
    some = polys(spark, [(1, [box(0, 0, 5, 5)])])
    assert spans.remainders(none, some, ["fid"]).count() == 0 and spans.polygons(spans.of_polygons(none, ["fid"]), ["icao", "fid"]).count() == 0
    assert spans.remainders(some, none, ["fid"]).first().area == 25.0


def test_hulls_of_interleaved_points(spark):
    """200,000 points of three keys in turn: one round leaves less than one in a hundred, and the hull is exact."""
    r = random.Random(1)
    cloud = lambda k: (r.gauss(0, 100), r.gauss(0, 50)) if k == 0 else (r.uniform(-5, 5), r.uniform(-5, 5)) if k == 1 else (lambda a, d: (d * math.cos(a), d * math.sin(a)))(r.uniform(0, 7), 90 * math.sqrt(r.random()))
    rows = [(None if i % 3 == 2 else f"k{i % 3}", *cloud(i % 3)) for i in range(200_000)]
    df = spark.createDataFrame(rows, "icao string, x double, y double").repartition(7).cache()
    assert overlay.outermost(df, ["icao"]).count() < 2000
    got = {k.icao: k.geom[0] for k in overlay.hull(df, ["icao"]).collect()}
    for key in {k for k, *_ in rows}:
        pts = sorted({(x, y) for k, x, y in rows if k == key})

        def chain(points):
            out = []
            for p in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        assert [(p.x, p.y) for p in got[key]][:-1] == chain(pts) + chain(pts[::-1])
    df.unpersist()


def test_hulls_of_few_and_flat_points(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 0.0, 0.0), ("c", 1.0, 0.0), ("c", 0.0, 1.0), ("c", 0.0, 1.0), ("c", 0.2, 0.2)], "icao string, x double, y double")
    got = {k.icao: [(p.x, p.y) for p in k.geom[0]] for k in overlay.hull(df, ["icao"]).collect()}
    assert got == {"c": [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]}
