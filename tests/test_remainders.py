"""Layers that keep what lies outside other surfaces, on small airports with known areas."""

import math

from pyspark.sql import functions as F

from aerodeck.functions import shapes
from aerodeck.operators import pavement, spans, structures

AREA = f"icao string, aid long, kind string, name string, surface int, source string, geom {shapes.GEOM}"
PAVED = f"icao string, pid string, class string, geom {shapes.GEOM}"


def ring(x, y, w, h):
    return [[(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]]


def areas(spark, *rows):
    return spark.createDataFrame([("A", i, kind, f"n{i}", 4, "osm", ring(*box)) for i, (kind, box) in enumerate(rows)], AREA)


def paved(spark, *rows):
    return spark.createDataFrame([("A", f"p{i}", cls, ring(*box)) for i, (cls, box) in enumerate(rows)], PAVED)


def sizes(df, *keys):
    return sorted((*(r[k] for k in keys), round(r.a, 3)) for r in df.select(*keys, shapes.geom_area("geom").alias("a")).collect())


def test_mapped_aprons_keep_what_scenery_leaves(spark):
    a = areas(spark, ("apron", (0, 0, 100, 100)), ("apron", (300, 0, 50, 50)), ("apron", (600, 0, 40, 40)), ("apron", (0, 300, 60, 40)), ("water", (0, 0, 90, 90)))
    p = paved(spark, ("apron", (40, -10, 20, 200)), ("taxiway", (600, 0, 40, 28)), ("taxiway", (0, 300, 60, 15)))
    got = pavement.osm_supplement(a, p)
    # Two parts, an untouched one, one of 480 square metres that is too small, and one of 60 x 25.
    assert sizes(got, "aid") == [(0, 4000.0), (0, 4000.0), (1, 2500.0), (3, 1500.0)]
    overlap = spans.common(spans.of_polygons(got, ["aid", "part"]), spans.cover(p), ["aid", "part"])
    assert overlap.count() == 0


def test_sites_keep_a_quarter_and_parts_of_400(spark):
    a = areas(spark, ("construction", (0, 0, 100, 50)), ("construction", (200, 0, 100, 50)), ("construction", (400, 0, 100, 50)))
    p = paved(spark, ("apron", (0, 0, 80, 50)), ("apron", (230, 0, 66, 50)))
    ids = a.select("icao", F.col("aid").alias("fid"))
    # 20 % left: gone; a part of 1,500 and one of 200 of 34 %: the large one stays; untouched: whole.
    assert sizes(structures.build_constructionarea(a, ids, p), "name") == [("n1", 1500.0), ("n2", 5000.0)]


def test_roads_stay_near_and_off_pavement(spark):
    roads = spark.createDataFrame([("A", 1, "East", 6.0, False, "osm", [[(0.0, 0.0), (200.0, 0.0)]]), ("A", 2, "Gone", None, False, "osm", [[(0.0, 500.0), (50.0, 500.0)]])], f"icao string, fid int, name string, width_m double, bridge boolean, source string, geom {shapes.GEOM}")
    near = structures.spans_within(spark.createDataFrame([("A", ring(0, -20, 120, 40), 10.0)], f"icao string, geom {shapes.GEOM}, margin double"), 0.5)
    none = spark.createDataFrame([], "icao string, ax double, ay double, bx double, by double")
    from_pavement = spark.createDataFrame([], f"icao string, name string, surftype int, width double, bridge boolean, source string, geom {shapes.GEOM}")
    got = structures.build_serviceroad(roads, roads.select("icao", "fid"), near, paved(spark, ("apron", (50, -50, 10, 100))), none, from_pavement, 0.5)
    left, right = sorted(r[1] for r in sizes(got, "name"))
    assert abs(left - (50 * 6 + math.pi * 9 / 2)) < 0.4 and abs(right - 70 * 6) < 0.4


def test_water_is_clipped_to_the_extent(spark):
    a = areas(spark, ("water", (80, 0, 100, 40)), ("water", (1000, 0, 50, 50)))
    ext = spark.createDataFrame([("A", ring(0, 0, 100, 100), 20.0)], f"icao string, geom {shapes.GEOM}, margin double")
    rows = spark.createDataFrame([], f"icao string, feattype int, idrwy string, name string, surftype int, source string, geom {shapes.GEOM}")
    assert sizes(structures.build_water(a, a.select("icao", F.col("aid").alias("fid")), ext, rows), "name") == [("n0", 1600.0)]


def test_shoulders_go_round_the_united_pavement(spark):
    tw = paved(spark, ("taxiway", (0, 0, 100, 20)), ("apron", (90, 0, 60, 20)), ("road", (300, 0, 20, 20)))
    pieces = tw.withColumn("fid", F.col("pid"))
    runway = paved(spark, ("runway", (-50, -30, 300, 30)))
    mids = spark.createDataFrame([("A", 1, "B", 50.0, 21.0), ("A", 2, "B", 60.0, 22.0), ("A", 3, "C", 55.0, 21.5)], "icao string, eid int, name string, x double, y double")
    got = pavement.build_taxiwayshoulder(pieces, runway, mids).collect()
    w = pavement.TAXIWAY_SHOULDER_M
    want = 150 * w + 2 * 20 * w + math.pi * w * w / 2  # the side along the runway is the runway's
    assert len(got) == 1 and got[0].idlin == "B" and abs(got[0].area - want) < 0.01 * want
