"""Only what lies beside a polygon is laid out or cuts it."""

from pyspark.sql import functions as F

from aerodeck.functions import shapes
from aerodeck.operators import pavement, spans


def boxes(spark, rows):
    df = spark.createDataFrame(rows, "icao string, pid long, x double, y double, hd double, len double, wid double")
    return df.withColumn("geom", F.array(shapes.rect_along("x", "y", "hd", "len", "wid")))


def test_far_pavement_is_not_laid_out(spark):
    polys = boxes(spark, [("A", 1, 0.0, 0.0, 0.0, 40.0, 20.0)])
    others = boxes(spark, [("A", 2, 0.0, 30.0, 0.0, 50.0, 60.0), ("A", 3, 3000.0, 0.0, 0.0, 40.0, 20.0), ("B", 4, 0.0, 0.0, 0.0, 40.0, 20.0)])
    assert spans.beside(others, polys).count() == 1
    got = spans.remainders(polys, others, ["pid"]).collect()
    assert [(r.pid, round(r.area), round(r.own)) for r in got] == [(1, 600, 800)]


def test_runway_whose_box_only_meets_does_not_split(spark):
    runway = boxes(spark, [("A", 9, 0.0, 0.0, 45.0, 1000.0, 30.0)]).withColumn("idrwy", F.lit("04/22")).withColumnRenamed("pid", "rid")
    pieces = boxes(spark, [("A", 1, 400.0, 40.0, 0.0, 40.0, 40.0), ("A", 2, 300.0, 290.0, 0.0, 20.0, 20.0), ("A", 3, 300.0, 240.0, 0.0, 140.0, 40.0)])
    out = pavement.without_runways(pieces, runway).withColumn("area", shapes.geom_area("geom"))
    got = {r.pid: (r.n, round(r.area)) for r in out.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area")).collect()}
    assert got[1] == (1, 1600)
    assert got.get(2, (0, 0))[1] < 400 and 3 in got and got[3][1] < 5600
