"""Cells in the bits of numbers are the cells of the cover, and few rows are shuffled for them."""

from pyspark.sql import functions as F

from aerodeck.functions import shapes
from aerodeck.operators import overlay


def polygons(spark):
    rows = [("A", i, float(i * 137 % 900 - 450), float(i * 211 % 700 - 350), float(i % 4 * 30), 40.0 + i * 9, 20.0 + i * 5) for i in range(30)] + [("A", 99, -450.0, -350.0, 0.0, 40.0, 20.0), ("B", 1, -64.0, 0.0, 90.0, 128.0, 8.0)]
    p = spark.createDataFrame(rows, "icao string, pid long, x double, y double, hd double, len double, wid double")
    return p.select("icao", "pid", F.array(shapes.rect_along("x", "y", "hd", "len", "wid")).alias("geom"))


def test_bits_count_the_cells_of_the_cover(spark):
    p = polygons(spark)
    for cell in (1.0, 7.0):
        want = {}
        for r in overlay.cover(p, ["pid"], cell).collect():
            want.setdefault((r.icao, r.pid), set()).add((r.cx, r.cy))
        assert min(c[0] for cells in want.values() for c in cells) < 0
        areas = {r.icao: r.area for r in overlay.union_area(p, cell).collect()}
        for icao in "AB":
            assert areas[icao] == len(set().union(*[v for k, v in want.items() if k[0] == icao])) * cell * cell
        odd = set().union(*[v for k, v in want.items() if k[0] == "A" and k[1] % 2])
        got = {(r.icao, r.pid): (r.cells, r.covered) for r in overlay.covered_share(p.filter("pid % 2 = 0"), p.filter("icao = 'A' AND pid % 2 = 1"), ["pid"], cell).collect()}
        assert got == {k: (len(v), len(v & odd)) for k, v in want.items() if k[1] % 2 == 0}


def test_rows_do_not_grow_with_the_cells(spark):
    p = polygons(spark)
    rows = {cell: overlay.union_bits(p, cell).count() for cell in (1.0, 0.5)}
    cells = {cell: overlay.cover_set(p, cell).count() for cell in (1.0, 0.5)}
    assert rows[1.0] * 8 < cells[1.0] and rows[0.5] < 4 * rows[1.0]
