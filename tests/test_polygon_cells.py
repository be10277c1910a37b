"""Polygons are laid out only in cells that can hold a point inside, and what no feature comes near is not shuffled."""

from pyspark.sql import functions as F

from aerodeck.functions import shapes
from aerodeck.operators import spatial, structures


def crossings(rings, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for r in rings for a, b in zip(r, r[1:]))


def test_slanted_strips_cost_cells_along_their_course(spark):
    strip = spark.range(1).select(F.lit("A").alias("icao"), F.lit(1).alias("fid"), F.array(shapes.rect_along(F.lit(-1500.0), F.lit(-1500.0), F.lit(45.0), F.lit(4200.0), F.lit(60.0))).alias("geom"))
    assert strip.transform(lambda p: spatial.polygon_cells(p, ["icao", "fid"], 200.0)).count() < 60  # 1,000 sides before: each in every column of the box


def test_cells_agree_with_parity(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    polys = {1: [square(-410.0, 390.0), square(-200.0, 200.0)[::-1]], 2: [[(0.0, 0.0), (900.0, 1e-9), (850.0, 700.0), (300.0, 120.0), (-500.0, 600.0), (0.0, 0.0)]], 3: [[(0.0, 200.0), (400.0, 200.0), (400.0, 400.0), (0.0, 200.0)]], 4: [[]]}
    p = spark.createDataFrame([("A", k, [[dict(zip("xy", v)) for v in r] for r in g]) for k, g in polys.items()], f"icao string, fid int, geom {shapes.GEOM}")
    spots = [(i, (i * 37 % 1400) - 600 + 0.0, (i * 91 % 1200) - 500 + 0.0) for i in range(900)] + [(1000 + i, 200.0 * (i % 5), 200.0 * (i // 5)) for i in range(20)]
    got = spatial.points_in_polygons(spark.createDataFrame([("A", *s) for s in spots], "icao string, sid int, x double, y double"), p, ["sid"], ["fid"])
    want = {(i, k) for i, x, y in spots for k, g in polys.items() if crossings(g, x, y) % 2}
    assert {(r.sid, r.fid) for r in got.collect()} == want and len(want) > 300


def test_only_what_is_near_is_shuffled(spark):
    box = lambda df: df.withColumn("geom", F.array(shapes.rect_along("x", "y", F.lit(20.0), F.lit(80.0), F.lit(40.0))))
    many = box(spark.range(20000).select(F.lit("A").alias("icao"), (F.col("id") % 200 * 400.0).alias("x"), (F.floor(F.col("id") / 200) * 400.0).alias("y")))
    few = box(spark.createDataFrame([("A", 1, 4010.0, 4110.0), ("A", 2, 4190.0, 4200.0), ("B", 3, 4010.0, 4110.0)], "icao string, fid int, x double, y double"))
    assert structures._distinct_near(many, few, 50.0).count() < 40
    near = lambda many_: sorted(tuple(r) for r in structures._features_near(few, ["fid"], many, 50.0, many=many_).collect())
    assert near(True) == near(False) == [("A", 1)]
    lines = lambda few_: spatial.lines_near(spatial.edges_of(few, ["icao", "fid"]), ["fid"], spatial.edges_of(many, ["icao"]), 50.0, few=few_)
    back = lambda few_: spatial.lines_near(spatial.edges_of(many, ["icao", "x", "y"]), ["x", "y"], spatial.edges_of(few, ["icao"]), 50.0, few=few_)
    assert [r.fid for r in lines("lines").collect()] == [r.fid for r in lines(None).collect()] == [1]
    assert sorted(map(tuple, back("targets").collect())) == sorted(map(tuple, back(None).collect())) != []
