"""Rings of scenery text: the text is taken apart once, and hot airports have the rows of others."""

from aerodeck.sources import scenery

BLOCK = """1 10 0 0 X001 Field
110 1 0.25 0 Main Apron
111 0.1 0.1
111 0.1
112 0.1 0.2 0.3 0.4 3 102
113 0.2 0.2 51
111 0.5 0.5
115 0.6 0.6
110 2 0.25 0 Two nodes
111 0.1 0.1
113 0.1 0.2
120 Line 7
111 1.0 1.0 4
113 1.0 1.1 4 101
111 2.0 2.0
116 2.0 2.1 0 0
111 2.5 2.5
100 no header of nodes
111 9.0 9.0
130 Edge
111 3.0 3.0
111 3.0 3.1
113 3.1 3.1"""


def coded(spark):
    return scenery.coded_lines(spark.createDataFrame([("X001", BLOCK), ("X002", "1 10 0 0 X002 Bare\n120\n111 7.0 7.0\n115 7.0 7.1")], "icao string, block string"))


def test_text_is_taken_apart_once(spark):
    for made in (scenery.painted_lines(scenery.rings(coded(spark))), scenery.pavements(coded(spark), scenery.rings(coded(spark)))[1]):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate ") == 1 and "Join" not in plan


def test_rows_and_hot_airports(spark):
    plain = scenery.rings(coded(spark))
    got = sorted((r.icao, r.line_no, r.obj, r.ring, r.closed, r.n_nodes) for r in plain.collect())
    assert got == [("X001", 2, 1, 0, True, 3), ("X001", 4, 1, 0, True, 3), ("X001", 5, 1, 0, True, 3), ("X001", 6, 1, 1, False, 2), ("X001", 7, 1, 1, False, 2), ("X001", 9, 8, 0, True, 2), ("X001", 10, 8, 0, True, 2),
                   ("X001", 12, 11, 0, True, 2), ("X001", 13, 11, 0, True, 2), ("X001", 14, 11, 1, False, 2), ("X001", 15, 11, 1, False, 2), ("X001", 16, 11, 2, False, 1),
                   ("X001", 20, 19, 0, True, 3), ("X001", 21, 19, 0, True, 3), ("X001", 22, 19, 0, True, 3), ("X002", 2, 1, 0, False, 2), ("X002", 3, 1, 0, False, 2)]
    row = plain.filter("line_no = 4 AND icao = 'X001'").first()
    assert (row.lat, row.ctrl_lon, row.line, row.light) == (0.1, 0.4, 3, 102)
    hot = scenery.rings(coded(spark), hot_rows=1)
    assert sorted(map(str, hot.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    attributes, vertices = scenery.pavements(coded(spark), hot)
    assert [r.name for r in attributes.collect()] == ["Main Apron"] and vertices.count() == 5
    assert sorted({(r.obj, r.name) for r in scenery.painted_lines(hot).filter("icao = 'X001'").collect()}) == [(11, "Line 7")]
    assert scenery.painted_lines(plain).filter("icao = 'X002'").first().name is None
