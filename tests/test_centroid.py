"""A ring is worked out once a row, however many vertices its centroid and area visit."""

from pyspark.sql import functions as F

from aerodeck.functions import shapes


def test_centroid_names_its_ring_once(spark):
    df = spark.createDataFrame([(3.0, 4.0), (7.0, 9.0)], "x double, y double")
    ring = shapes.rect_along("x", "y", F.lit(90.0), F.hypot("x", F.lit(12.5)), F.lit(2.0))
    made = df.select(shapes.ring_centroid(ring).alias("m"), shapes.ring_area(ring).alias("a"))
    assert made._jdf.queryExecution().analyzed().toString().lower().count("hypot") == 2 * ring._jc.toString().lower().count("hypot")
    for x, row in zip((3.0, 7.0), made.collect()):
        length = (x * x + 12.5 * 12.5) ** 0.5
        assert abs(row.m.x - x - length / 2) < 1e-9 and abs(row.a - 2 * length) < 1e-9


def test_flat_ring_has_its_first_vertex(spark):
    row = spark.sql("SELECT array(named_struct('x', 1d, 'y', 2d), named_struct('x', 3d, 'y', 4d), named_struct('x', 1d, 'y', 2d)) AS r, cast(null AS array<struct<x:double,y:double>>) AS n")
    got = row.select(shapes.ring_centroid("r").alias("m"), shapes.ring_area("n").alias("a"), shapes.ring_centroid("n").x.alias("c")).first()
    assert (got.m.x, got.m.y, got.a, got.c) == (1.0, 2.0, None, None)
