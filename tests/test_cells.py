"""Cells that follow the number of segments: the same nearest segments, laid out in fewer rows."""

from pyspark.sql import functions as F

from aerodeck.operators import spatial


def test_wide_cells_give_the_same_nearest_in_fewer_rows(spark):
    few = spark.range(60).select(F.lit("A").alias("icao"), F.col("id").alias("eid"), (F.col("id") * 71 % 4000 - 2000.0).alias("ax"), (F.col("id") * 113 % 4000 - 2000.0).alias("ay"),
                                 (F.col("id") * 937 % 4000 - 2000.0).alias("bx"), (F.col("id") * 577 % 4000 - 2000.0).alias("by"))
    many = spark.range(1200).select(F.lit("B").alias("icao"), F.col("id").alias("eid"), (F.col("id") * 7.0 - 4000).alias("ax"), F.lit(-30.0).alias("ay"), (F.col("id") * 7.0 - 3700).alias("bx"), F.lit(90.0).alias("by"))
    segs = few.unionByName(many)
    points = spark.range(400).select(F.when(F.col("id") % 4 == 0, "B").when(F.col("id") % 4 == 1, "C").otherwise("A").alias("icao"), "id", (F.col("id") * 53 % 4000 - 1999.6).alias("x"), (F.col("id") * 97 % 4000 - 1999.7).alias("y"))
    get = lambda wide: sorted((r.id, r.eid, r.dist) for r in spatial.nearest(points, segs, 250.0, ["eid"], ["eid"], cell=250.0, wide=wide).collect() if r.eid is not None)
    assert get(True) == get(False) and len(get(True)) > 100
    assert {r.icao: r._cell for r in spatial.wide_cells(segs, 250.0).collect()} == {"A": 2000.0, "B": 500.0}
    sized = few.join(spatial.shuffled(spatial.wide_cells(segs, 250.0)), "icao")
    assert spatial.segment_cells(sized, F.col("_cell"), 250.0).count() * 4 < spatial.segment_cells(few, 250.0, 250.0).count()
