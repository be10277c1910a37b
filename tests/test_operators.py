"""Operators on small fixtures: published examples, chunked scans, geometry identities, streams."""

from pyspark.sql import functions as F

from aerodeck.functions import geo, shapes, text
from aerodeck.operators import conflate, measure, ordered, overlay, structures
from aerodeck.plans import spatial
from aerodeck.plans.registry import Inputs
from aerodeck.sources import scenery
from aerodeck.sources.osm import assemble_rings
from aerodeck.streaming import feeds
from tests.harness import ROOT


def test_chunked_scan_equals_window(spark):
    df = spark.range(2000).select((F.col("id") % 3 * F.col("id") % 2).alias("k"), F.col("id").alias("o"), (F.col("id") * 7 % 13).alias("v"), F.when(F.col("id") % 17 == 0, F.col("id")).alias("s"))
    specs = dict(rk=ordered.rank(), lg=ordered.lag("v"), ld=ordered.lead("v"), rs=ordered.running("v"), fl=ordered.fill("s"))
    plain = ordered.scan(df, ["k"], ["o"], **specs)
    chunked = ordered.scan(df, ["k"], ["o"], hot_rows=1, chunks=7, **specs)
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert key(plain) == key(chunked)


def test_chunked_scan_keeps_null_keys_and_ties(spark):
    df = spark.range(300).select(F.when(F.col("id") % 2 == 0, F.lit(1)).alias("k"), F.col("id").alias("o"), F.lit(0.25).alias("v"), F.lit(None).cast("long").alias("s"))
    specs = dict(rk=ordered.rank(), lg=ordered.lag("o"), ld=ordered.lead("o"), rs=ordered.running("v"), fl=ordered.fill("s"))
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert key(ordered.scan(df, ["k"], ["o"], **specs)) == key(ordered.scan(df, ["k"], ["o"], hot_rows=1, chunks=5, **specs))


def test_land_blocks_with_low_elevations(spark):
    text = "I\n1000 version\n\n1 16 1 0 KAAA Alpha Field\n100 x\n1 17 0 0 KBBB Beta\n16 0 0 0 KCCC Sea\n1 1 1 0 KDDD Delta\n99\n"
    chunks = spark.createDataFrame([("f", c) for c in text.split("\n1 ")] + [("g", "17 5 0 0 KEEE Heliport\n99\n")], "path string, value string")
    assert sorted(r.icao for r in scenery.airport_blocks(chunks).collect()) == ["KAAA", "KBBB", "KCCC", "KDDD", "KEEE"]


def test_dense_lines_and_chained_runways(spark):
    dense = spark.range(1000).select(F.lit("A").alias("icao"), F.lit(1).alias("fid"), F.col("id").alias("seq"), (F.col("id") * 0.9).alias("x"), F.lit(0.0).alias("y"))
    # Every second vertex is a metre or more from the last kept one; a piece of 84 steps of 1.8 m passes 150 m.
    pieces = measure.cut_pieces(dense, ["icao", "fid"])
    assert {r.seq for r in pieces.select("seq").distinct().collect()} == set(range(0, 1000, 2))
    assert {r.piece: r["count"] for r in pieces.groupBy("piece").count().collect()} == {**{i: 85 for i in range(5)}, 5: 80}
    short = spark.createDataFrame([("A", None, i, x, 0.0) for i, x in enumerate([0.0, 0.95, 1.05, None, 160.0])] + [("B", 1, 0, 5.0, 5.0)], "icao string, fid int, seq int, x double, y double")
    assert [(r.seq, r.piece) for r in measure.cut_pieces(short, ["icao", "fid"]).orderBy("piece", "seq").collect()] == [(0, 0), (2, 0), (4, 0)]
    chain = spark.createDataFrame([("A", i, "09/27", 40.0 * i, 0.0) for i in range(4)], "icao string, rid int, idrwy string, ax double, ay double")
    assert sorted(r.rid for r in conflate.drop_repeated_runways(chain, ["rid"]).collect()) == [0, 2]


def test_deicing_clusters_stay_in_their_airport(spark):
    box = lambda x, y, s: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]
    rows = [("A", 1, box(0.0, 0.0, 500.0)), ("A", 2, box(200.0, 200.0, 20.0)), ("A", 3, box(9000.0, 0.0, 20.0)), ("B", 1, box(9000.0, 0.0, 20.0)), ("B", 3, box(9010.0, 0.0, 20.0))]
    got = structures.deicing_clusters(spark.createDataFrame(rows, "icao string, aid long, geom array<array<struct<x:double,y:double>>>"))
    assert sorted((r.icao, r.aid, r.cluster) for r in got.collect()) == [("A", 1, 1), ("A", 2, 1), ("A", 3, 3), ("B", 1, 1), ("B", 3, 1)]


def test_segments_inside_wide_rectangles(spark):
    segs = spark.createDataFrame([("A", 1, 0, 100.0, 420.0, 160.0, 480.0)], "icao string, fid int, seq int, ax double, ay double, bx double, by double")
    wide = spark.createDataFrame([("A", 0.0, 0.0, 2000.0, 0.0, 1000.0)], "icao string, ax double, ay double, bx double, by double, width_m double")
    assert [r.inside for r in overlay.split_lines(segs, ["fid"], wide).collect()] == [True]


def test_sign_examples(spark):
    rows = spark.createDataFrame([("{@Y}A{^r}{@@}B{^l}",), ("{@R}25L-07R{@L}M23",), ("{@B}1{@@}7",)], "raw string").select(*[c.alias(n) for n, c in text.decode_sign("raw").items()]).collect()
    assert [tuple(r) for r in rows] == [("A→", "B←", 2), ("25L-07RM23", None, 1), ("1", "7", 4)]


def test_projection_round_trip(spark):
    x, y = geo.forward(F.lit(77.12), F.lit(28.58), F.lit(77.1031), F.lit(28.5665))
    lon, lat = geo.inverse("x", "y", F.lit(77.1031), F.lit(28.5665))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).select(lon.alias("lon"), lat.alias("lat")).first()
    assert abs(r.lon - 77.12) < 1e-9 and abs(r.lat - 28.58) < 1e-9


def test_crossing_strips_share_a_square(spark):
    a, b = shapes.rect_along(F.lit(0.0), F.lit(-500.0), F.lit(0.0), F.lit(1000.0), F.lit(60.0)), shapes.rect_along(F.lit(-500.0), F.lit(0.0), F.lit(90.0), F.lit(1000.0), F.lit(60.0))
    rest = F.aggregate(shapes.subtract_convex(a, b), F.lit(0.0), lambda s, p: s + shapes.ring_area(p))
    r = spark.range(1).select(shapes.ring_area(shapes.clip_convex(a, b)).alias("cut"), rest.alias("rest")).first()
    assert abs(r.cut - 3600) < 1e-6 and abs(r.cut + r.rest - 60000) < 1e-6


def test_every_route_edge_is_a_centreline(spark):
    t = Inputs(spark, f"{ROOT}/sf0.001")
    lines = spatial.taxi_lines(t)
    edges = t.b_edge.filter("from_id <> to_id")
    assert lines.select("icao", "way").distinct().count() == edges.select("icao", "eid").distinct().count() > 0


def test_ring_fragments_join(spark):
    f = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 0, 1, 1.0, 0.0), (1, 1, 0, 1.0, 1.0), (1, 1, 1, 1.0, 0.0), (1, 2, 0, 1.0, 1.0), (1, 2, 1, 0.0, 0.0)], "grp int, frag int, seq int, x double, y double")
    v = assemble_rings(f).orderBy("seq").collect()
    assert len(v) == 4 and (v[0].x, v[0].y) == (v[-1].x, v[-1].y)


def test_progress_stream_equals_batch(spark, tmp_path):
    ev = spark.range(500).select(F.timestamp_seconds(F.col("id") * 60 + 1704067200).alias("ts"), F.when(F.col("id") % 5 == 0, "error").otherwise("done").alias("status"))
    path = str(tmp_path / "ev")
    ev.write.parquet(path)
    stream = feeds.progress_stream(spark.readStream.schema(ev.schema).parquet(path))
    q = stream.writeStream.outputMode("update").format("memory").queryName("progress_rows").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("progress_rows").collect()))
    assert got == sorted(map(tuple, feeds.progress_stream(spark.read.parquet(path)).collect()))
