"""Segments that meet on a cell border up to rounding are met."""

import math

from aerodeck.operators import spatial


def test_touch_on_a_cell_border(spark):
    end = math.nextafter(250.0, 0)
    rows = [("A", 1, 1, -1000.0, 0.0, end, 0.0), ("A", 2, 1, 250.0, -10.0, 250.0, 10.0), ("A", 3, 1, 0.0, 100.0, 10.0, 100.0)]
    s = spark.createDataFrame(rows, "icao string, way long, seq int, ax double, ay double, bx double, by double")
    assert [(r.a_way, r.b_way, r.y) for r in spatial.crossings(s, ["seq"]).collect()] == [(1, 2, 0.0)]
