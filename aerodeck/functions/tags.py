"""What a map element is, from its tags: ordered tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import tag_surface
from .geo import c

# Structure codes by tag value.
BUILDING_BY_AEROWAY = {"terminal": 1, "hangar": 2, "tower": 3, "control_tower": 3, "fuel": 5}
BUILDING_BY_BUILDING = {"terminal": 1, "hangar": 2, "control_tower": 3, "parking": 6, "garage": 6, "garages": 6,
                        "industrial": 7, "warehouse": 7}
POINT_BY_MAN_MADE = {"tower": 1, "communications_tower": 1, "water_tower": 1, "lighthouse": 1, "mast": 2, "flagpole": 2,
                     "chimney": 3, "antenna": 7, "storage_tank": 9, "silo": 9, "utility_pole": 5}
LINE_BY_BARRIER = {"fence": 1, "chain_link": 1, "wall": 2, "retaining_wall": 2, "city_wall": 2, "hedge": 5}
AREA_BY_AEROWAY = {"aerodrome": "aerodrome", "apron": "apron", "taxiway": "taxiway", "runway": "runway",
                   "stopway": "stopway", "blast_pad": "blastpad", "blastpad": "blastpad", "helipad": "helipad",
                   "parking_position": "stand", "terminal": "building", "hangar": "building", "tower": "building",
                   "control_tower": "building", "fuel": "building"}
AIRSIDE_ROADS = ["service", "unclassified", "living_street", "track"]
NO_ROAD_SERVICES = ["parking_aisle", "driveway", "drive-through", "emergency_access"]
SELECTED_MAN_MADE = ["tower", "mast", "chimney", "antenna", "storage_tank", "silo", "communications_tower",
                     "water_tower", "lighthouse"]


def tag(tags, k: str) -> Column:
    """Tag value, null when missing or empty."""
    return F.nullif(c(tags)[k], F.lit(""))


def has(tags, k: str) -> Column:
    return F.coalesce(F.map_contains_key(c(tags), k), F.lit(False))


def _is(v: Column, *values) -> Column:
    return F.coalesce(v.isin(*values), F.lit(False))


def _map(table: dict, v: Column) -> Column:
    from .text import lookup
    return lookup(table, v)


def building_kind(tags) -> Column:
    control = _is(tag(tags, "man_made"), "tower") & F.coalesce(tag(tags, "tower:type").contains("control"), F.lit(False))
    return (F.when(_map(BUILDING_BY_AEROWAY, tag(tags, "aeroway")).isNotNull(), _map(BUILDING_BY_AEROWAY, tag(tags, "aeroway")))
            .when(_map(BUILDING_BY_BUILDING, tag(tags, "building")).isNotNull(), _map(BUILDING_BY_BUILDING, tag(tags, "building")))
            .when(_is(tag(tags, "man_made"), "storage_tank", "silo"), 5).when(control, 3).otherwise(4))


def point_kind(tags) -> Column:
    """Point structure code; null for anything that is not one."""
    aeroway = tag(tags, "aeroway")
    by_aeroway = F.when(aeroway == "windsock", 6).when(aeroway.isin("tower", "control_tower"), 1)
    mapped = F.coalesce(_map(POINT_BY_MAN_MADE, tag(tags, "man_made")),
                        F.when(_is(tag(tags, "power"), "tower", "pole", "portal"), 5))
    return F.when(aeroway.isNotNull(), by_aeroway).otherwise(mapped)


def line_kind(tags) -> Column:
    power = tag(tags, "power")
    return F.coalesce(_map(LINE_BY_BARRIER, tag(tags, "barrier")), F.when(power.isin("line", "minor_line"), 3),
                      F.when(power == "cable", 4), F.when(tag(tags, "aerialway").isNotNull(), 4))


def is_deicing(tags) -> Column:
    named = F.coalesce(F.lower(tag(tags, "name")).rlike("deic|de-ic"), F.lit(False))
    return (_is(tag(tags, "apron"), "deicing") | _is(tag(tags, "deicing"), "yes")
            | _is(tag(tags, "aeroway"), "deicing") | named)


def light_kind(tags) -> Column:
    """Light object code of a node; individually mapped edge lights give null."""
    a = tag(tags, "aeroway")
    nav = F.lower(F.coalesce(tag(tags, "navigationaid"), F.lit("")))
    aid = (F.when(nav.contains("papi"), 1).when(nav.contains("vasi"), 2)
           .when(nav.contains("als") | nav.contains("approach"), 8).when(nav.contains("reil"), 7))
    return (F.when(a.isin("beacon", "aerodrome_beacon"), 5).when(a == "papi", 1).when(a == "vasi", 2)
            .when(a == "navigationaid", aid))


def hold_kind(tags) -> Column:
    kind = tag(tags, "holding_position:type")
    return (F.when(_is(kind, "ils", "cat_ii", "cat_iii", "cat_ii_iii"), "ils_hold")
            .when(_is(kind, "intermediate", "taxiway"), "intersection_hold").otherwise("runway_hold"))


def is_airside_road(tags) -> Column:
    return _is(tag(tags, "highway"), *AIRSIDE_ROADS) & ~_is(tag(tags, "service"), *NO_ROAD_SERVICES)


def is_area(tags, nodes) -> Column:
    """A closed way counts as an area unless its tags say otherwise."""
    n = c(nodes)
    closed = (F.size(n) >= 4) & (n[0] == F.element_at(n, -1))
    linear = _is(tag(tags, "aeroway"), "runway", "taxiway", "taxilane") | has(tags, "barrier") | has(tags, "highway") | has(tags, "power")
    return closed & F.when(has(tags, "area"), c(tags)["area"] != "no").otherwise(~linear)


def node_collection(tags) -> Column:
    """Which source collection a tagged node feeds."""
    a = tag(tags, "aeroway")
    return (F.when(a == "parking_position", "stand").when(a == "holding_position", "hold")
            .when(a.isin("beacon", "aerodrome_beacon", "papi", "vasi"), "light")
            .when(a == "navigationaid", F.when(light_kind(tags).isNotNull(), "light"))
            .when(a == "helipad", "helipad").when(a == "aerodrome", "header")
            .when(point_kind(tags).isNotNull(), "point_structure"))


def line_collection(tags) -> Column:
    """Which source collection an open (or linear) way feeds."""
    a = tag(tags, "aeroway")
    return (F.when(a.isin("taxiway", "taxilane"), "taxi_centerline").when(a == "runway", "runway")
            .when(a == "stopway", None)
            .when(tag(tags, "highway").isNotNull(), F.when(is_airside_road(tags), "road_center"))
            .when(line_kind(tags).isNotNull(), "line_structure"))


def area_collection(tags) -> Column:
    """Which source collection an area feeds; area kinds keep their own name."""
    by_aeroway = _map(AREA_BY_AEROWAY, tag(tags, "aeroway"))
    is_building = (has(tags, "building") & ~_is(tag(tags, "building"), "no")) | _is(tag(tags, "man_made"), "storage_tank")
    water = _is(tag(tags, "natural"), "water") | has(tags, "water") | _is(tag(tags, "landuse"), "reservoir", "basin")
    site = _is(tag(tags, "landuse"), "construction") | has(tags, "construction")
    parking = _is(tag(tags, "amenity"), "parking") & ~_is(tag(tags, "parking"), "multi-storey")
    return (F.when((by_aeroway == "apron") & is_deicing(tags), "deicing").when(by_aeroway.isNotNull(), by_aeroway)
            .when(is_deicing(tags), "deicing").when(is_building, "building").when(water, "water")
            .when(site, "construction").when(parking, "service_area"))


def is_relevant(tags, kind) -> Column:
    """Airport-relevant elements: the selection applied when extracting a region."""
    k, a = c(kind), tag(tags, "aeroway")
    wr, way = k.isin("way", "relation"), k == "way"
    return F.coalesce(
        (a.isNotNull() & (a != "navigationaid"))
        | ((k == "node") & (a == "navigationaid") & F.coalesce(tag(tags, "navigationaid").rlike("papi|vasi|als|reil"), F.lit(False)))
        | (wr & has(tags, "building"))
        | _is(tag(tags, "man_made"), *SELECTED_MAN_MADE)
        | (way & _is(tag(tags, "barrier"), "fence", "wall"))
        | (way & _is(tag(tags, "power"), "line", "minor_line"))
        | (way & is_airside_road(tags))
        | (wr & (_is(tag(tags, "natural"), "water") | has(tags, "water")
                 | _is(tag(tags, "landuse"), "construction", "reservoir", "basin")
                 | has(tags, "construction") | has(tags, "deicing"))), F.lit(False))


def surface_of(tags) -> Column:
    s = tag(tags, "surface")
    return F.when(s.isNotNull(), tag_surface(s))
