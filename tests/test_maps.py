"""Map extracts: outlines over tile borders, tiles and slim properties."""

import math

from pyspark.sql import functions as F

from aerodeck.functions import shapes
from aerodeck.operators import maps


def _polys(spark, rows):
    df = spark.createDataFrame(rows, "icao string, x double, y double, h double, len double, wid double")
    return df.select("icao", F.array(shapes.rect_along("x", "y", "h", "len", "wid")).alias("geom"))


def _length(lines):
    pts = {}
    for r in lines.collect():
        pts.setdefault((r.icao, r.tile_x, r.tile_y, r.line), []).append((r.seq, r.x, r.y))
    total = {}
    for k, p in pts.items():
        p = sorted(p)
        total[k[0]] = total.get(k[0], 0) + sum(math.dist(a[1:], b[1:]) for a, b in zip(p, p[1:]))
    return total


def test_outline_has_no_side_where_a_tile_border_only_cuts(spark):
    frame = [("A", 5.0, 0.0, 0.0, 700.0, 10.0), ("A", 695.0, 0.0, 0.0, 700.0, 10.0), ("A", 350.0, 0.0, 0.0, 10.0, 700.0), ("A", 350.0, 690.0, 0.0, 10.0, 700.0)]  # a frame over nine tiles, with a hole
    side = [("B", 150.0, 0.0, 0.0, 300.0, 300.0), ("B", 375.0, 100.0, 0.0, 50.0, 150.0)]  # sides that lie on a tile border, half covered from the other side
    got = _length(maps.outline(maps.tile_parts(_polys(spark, frame + side + side), square=True)))
    assert abs(got["A"] - (4 * 700 + 4 * 680)) < 1e-6
    assert abs(got["B"] - (4 * 300 + 2 * 150)) < 1e-6


def test_slanted_outline_and_area(spark):
    polys = _polys(spark, [("A", -200.3, -150.2, 30.0, 500.0, 80.0)])
    parts = maps.tile_parts(polys)
    area = parts.agg(F.sum("area")).first()[0]
    assert abs(area - 40000) < 40
    assert abs(_length(maps.outline(parts))["A"] - 1160) < 12  # half a row where a side bends or meets a border


def test_tiles_hold_pieces_of_their_first_vertex_and_labels(spark):
    pieces = spark.createDataFrame([("A", "guide", 1, 0, 0, 10.4, 10.5), ("A", "guide", 1, 0, 1, 350.6, -20.5), ("A", "guide", 2, 0, 0, 1.0, 1.0), ("A", "guide", 3, 0, 0, 1.0, 1.0), ("A", "guide", 3, 0, 1, 30000.0, 1.0)],
                                   "icao string, layer string, fid long, piece long, seq int, x double, y double")
    labels = spark.createDataFrame([("A", 1, "T1", -0.6, 5.0), ("A", 3, "G1", 20.0, 20.0)], "icao string, kind int, label string, x double, y double")
    fills = maps.tile_parts(_polys(spark, [("A", 10.0, 0.0, 0.0, 40.0, 20.0)])).withColumn("layer", F.lit("apron"))
    got = {(r.tile_x, r.tile_y): r for r in maps.tile_extract(pieces, labels, fills).collect()}
    assert set(got) == {(0, 0), (-1, 0)}
    home = got[0, 0]
    assert (home.min_x, home.min_y, home.max_x, home.max_y) == (0, -21, 351, 40)
    assert [(n.fid, [(p.x, p.y) for p in n.points]) for n in home.lines] == [(1, [(10, 11), (351, -21)])]
    assert [n.label for n in home.labels] == ["G1"] and [n.layer for n in home.fills] == ["apron"]
    assert [(n.x, n.label) for n in got[-1, 0].labels] == [(-1, "T1")] and got[-1, 0].lines == []


def test_slim_drops_nulls_and_other_layers(spark):
    f = spark.createDataFrame([("A", "taxiwayelement", 1, "B", None), ("A", "taxiwayelement", 2, None, 4), ("A", "asrnnode", 3, "C", 1), ("A", "water", 4, "D", 1)], "icao string, layer string, fid long, idlin string, surftype int")
    assert {(r.fid, r.value) for r in maps.slim(f, "viewer", ["fid"]).collect()} == {(1, '{"idlin":"B"}'), (2, "{}"), (4, "{}")}
