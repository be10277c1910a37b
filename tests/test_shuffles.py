"""What is laid out in cells is joined by a shuffle: broadcast, it would pass whole through the driver."""

from pyspark.sql import functions as F

from aerodeck.functions import shapes
from aerodeck.operators import lines, network, overlay, spatial, structures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    p = spark.createDataFrame([("A", 1, 10.0, 10.0), ("A", 2, 900.0, 40.0)], "icao string, pid long, x double, y double")
    s = spark.createDataFrame([("A", "w", 1, 0.0, 0.0, 1000.0, 5.0), ("A", "v", 1, 500.0, -50.0, 500.0, 50.0)], "icao string, way string, seq int, ax double, ay double, bx double, by double")
    g = p.select("icao", F.col("pid").alias("fid"), F.array(shapes.rect_along("x", "y", F.lit(0.0), F.lit(50.0), F.lit(20.0))).alias("geom"))
    return p, s, g


def test_cells_are_never_broadcast(spark):
    p, s, g = tables(spark)
    box = {n: v for n, v in shapes.bounds("geom").items()}
    sides = [g.select("icao", F.col("fid").alias(f"{k}_fid"), *[v.alias(f"{k}_{n}") for n, v in box.items()]) for k in "lr"]
    made = [spatial.near_pairs(p, s, 20.0), spatial.crossings(s, ["seq"]), spatial.lines_near(s, ["way"], s, 10.0), spatial.box_pairs(*sides, 100.0), overlay.covered_share(g, g, ["fid"], 1.0),
            overlay.remainder(g, g, ["fid"]), lines.first_crossing(s.withColumn("from_m", F.lit(0.0)), ["icao", "way"], s)]
    for df in made:
        assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" in plan(df)
    assert "SortMergeJoin" in plan(spatial.points_in_polygons(p, g, ["pid"], ["fid"]))
    assert made[1].count() == 1


def test_rounds_are_never_broadcast(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(network, "durable", lambda df: seen.append(plan(df)) or df.localCheckpoint())
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    assert {tuple(r) for r in network.components(pairs).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert len(seen) > 2 and not any("BroadcastHashJoin" in s for s in seen)
    g = tables(spark)[2].withColumnRenamed("fid", "aid")
    assert structures.deicing_clusters(g).count() == 2
