"""Chosen queries equal their SQL twins on the smallest tables."""

import pytest

from aerodeck.plans import ORACLES, QUERIES
from tests.harness import ROOT, compare, engine

PICKS = ["FLAGSHIP_airport_neighbours", "P25_sign_text", "F02_exclusions", "J09_runway_overlaps", "J15_voted_edge_name", "J20_conflated_stands", "A08_line_measures", "W05_closed_rings", "G03_split_lines", "G06_convex_hull",
         "L29_runwaymarking", "N06_components", "S13_children_of_parents", "V03_unique_ids"]


@pytest.mark.parametrize("name", PICKS)
def test_matches_sql(spark, name):
    folder = f"{ROOT}/sf0.001"
    state, _, _, note = compare(spark, engine(folder), name, QUERIES[name], ORACLES[name], folder)
    assert state in ("ok", "EMPTY"), note


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
