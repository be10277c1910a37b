"""Positions in scenery headers."""

from aerodeck.sources import scenery


def test_zero_is_a_position(spark):
    block = "1 10 0 0 X1 Field\n1302 datum_lat 0\n1302 datum_lon 65"
    other = "1 10 0 0 X2 Field\n1302 datum_lat 4.5"
    third = "1 10 0 0 X3 Field\n1302 datum_lat x\n1302 datum_lon 9"
    b = spark.createDataFrame([("f", "X1", block), ("f", "X2", other), ("f", "X3", third)], "path string, icao string, block string")
    got = {r.icao: (r.lat, r.lon) for r in scenery.headers(scenery.coded_lines(b)).collect()}
    assert got == {"X1": (0.0, 65.0), "X2": (None, None), "X3": (None, None)}
