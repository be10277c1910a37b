"""Rows of polygons are worked out where they stand: no sort of sides, and blocks travel instead of spans."""

from pyspark.sql import functions as F

from aerodeck.functions import shapes
from aerodeck.operators import overlay, spans


def rings(spark):
    square = lambda a, b: [dict(x=a, y=a), dict(x=b, y=a), dict(x=b, y=b), dict(x=a, y=b), dict(x=a, y=a)]
    saw = [dict(x=float(i), y=300.0 if i % 2 else -7.5) for i in range(40)] + [dict(x=39.0, y=-100.25), dict(x=0.0, y=-100.25), dict(x=0.0, y=-7.5)]
    return spark.createDataFrame([("A", 1, [square(-50.5, 150.0), square(0.0, 70.0)[::-1]]), ("A", 2, [saw]), ("B", 1, [square(0.25, 0.5)]), ("B", 2, [square(5.0, 6.0)])], f"icao string, fid int, geom {shapes.GEOM}")


def rows_of(geom, step):
    out = []
    for row in range(-200, 400):
        y = (row + 0.5) * step
        xs = sorted(a.x + (y - a.y) * (b.x - a.x) / (b.y - a.y) for r in geom for a, b in zip(r, r[1:]) if (a.y > y) != (b.y > y))
        out += [(row, round(p, 6), round(q, 6)) for p, q in zip(xs[::2], xs[1::2]) if q > p]
    return out


def test_rows_of_polygons(spark):
    p = rings(spark)
    made = spans.of_polygons(p, ["fid"])
    want = sorted((r.icao, r.fid, *s) for r in p.collect() for s in rows_of(r.geom, 1.0))
    assert sorted((r.icao, r.fid, r.row, round(r.x0, 6), round(r.x1, 6)) for r in made.collect()) == want and len(want) > 500
    for df in (made, overlay.row_spans(p, ["fid"], 2.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan.replace("array_sort", "")


def test_cover_is_shuffled_in_blocks(spark):
    p = rings(spark)
    area = {r.icao: r.area for r in spans.measured(spans.cover(p.filter("fid = 1").unionByName(p.filter("fid = 1"))), ["icao"]).collect()}
    assert area == {"A": 200.5 * 201 - 4900}
    got = sorted((r.icao, r.row, round(r.x0, 6), round(r.x1, 6)) for r in spans.cover(p).collect())
    one = spans.united(spans.of_polygons(p, ["fid"]), ["icao"])
    assert got == sorted((r.icao, r.row, round(r.x0, 6), round(r.x1, 6)) for r in one.collect())
    plan = spans.cover(p).groupBy("icao").agg(F.count("row"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(icao") == 3  # copies of polygons, blocks, the sum
