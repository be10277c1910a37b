"""Rings of groups in one row are those of the rounds, without tables between."""

from aerodeck.sources import osm

FRAGMENTS = [
    # A square of four sides, two of them reversed.
    *[(1, f, s, x, y) for f, line in enumerate([[(0, 0), (5, 0), (10, 0)], [(10, 10), (10, 5), (10, 0)], [(10, 10), (0, 10)], [(0, 0), (0, 10)]]) for s, (x, y) in enumerate(line)],
    # An open chain whose smallest fragment runs against its neighbours, and a closed way of its own.
    *[(2, f, s, x, y) for f, line in [(7, [(5, 0), (0, 0)]), (8, [(5, 0), (5, 5)]), (9, [(5, 5), (9, 9), (9, 5)]), (3, [(20, 20), (30, 20), (30, 30), (20, 20)])] for s, (x, y) in enumerate(line)],
    # A fork: three fragments end at one place; two rings in one group; a pair that is too short.
    *[(3, f, s, x, y) for f, line in [(1, [(0, 0), (1, 0)]), (2, [(1, 0), (1, 1)]), (4, [(1, 0), (2, 2)]), (5, [(1, 1), (0, 0)])] for s, (x, y) in enumerate(line)],
    *[(4, f, s, x, y) for f, line in [(1, [(0, 0), (4, 0), (4, 4)]), (2, [(4, 4), (0, 0)]), (3, [(9, 9), (8, 9)]), (6, [(8, 9), (8, 8), (9, 9)]), (7, [(50, 50), (51, 50)])] for s, (x, y) in enumerate(line)],
]


def table(spark):
    return spark.createDataFrame([(g, f, s, float(x), float(y)) for g, f, s, x, y in FRAGMENTS], "grp long, frag int, seq int, x double, y double")


def rows(df):
    return sorted(tuple(r) for r in df.select("grp", "ring", "seq", "x", "y").collect())


def test_rows_equal_rounds_without_tables(spark, monkeypatch):
    f = table(spark)
    far = rows(osm.assemble_rings(f, shared=0))
    mixed = rows(osm.assemble_rings(f, shared=9))
    monkeypatch.setattr(osm, "durable", None)
    near = osm.assemble_rings(f)
    assert rows(near) == far == mixed and {r[:2] for r in far} >= {(1, 0), (2, 3), (2, 7), (4, 1), (4, 3)}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
