"""Fixed dimension tables: layers, code lists, legends and client translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geo import c
from .text import lookup

# The 45 layers in output order with their geometry kind.
LAYERS = [
    ("atcblindspot", "surface"), ("aerodromereferencepoint", "point"), ("aerodromesign", "point"),
    ("aerodromesurfacelighting", "point"), ("apronelement", "surface"), ("arrestinggearlocation", "curve"),
    ("arrestingsystemlocation", "surface"), ("asrnedge", "curve"), ("asrnnode", "point"), ("blastpad", "surface"),
    ("bridgeside", "curve"), ("constructionarea", "surface"), ("deicingarea", "surface"), ("deicinggroup", "surface"),
    ("finalapproachandtakeoffarea", "surface"), ("frequencyarea", "surface"), ("helipadthreshold", "point"),
    ("hotspot", "surface"), ("landandholdshortoperationlocation", "curve"), ("paintedcenterline", "curve"),
    ("parkingstandarea", "surface"), ("parkingstandlocation", "point"), ("positionmarking", "point"),
    ("runwaycenterlinepoint", "point"), ("runwaydisplacedarea", "surface"), ("runwayelement", "surface"),
    ("runwayexitline", "curve"), ("runwayintersection", "surface"), ("runwaymarking", "surface"),
    ("runwayshoulder", "surface"), ("runwaythreshold", "point"), ("serviceroad", "surface"),
    ("standguidanceline", "curve"), ("stopway", "surface"), ("surveycontrolpoint", "point"),
    ("taxiwayelement", "surface"), ("taxiwayguidanceline", "curve"), ("taxiwayholdingposition", "curve"),
    ("taxiwayintersectionmarking", "curve"), ("taxiwayshoulder", "surface"), ("touchdownliftoffarea", "surface"),
    ("verticallinestructure", "curve"), ("verticalpointstructure", "point"),
    ("verticalpolygonalstructure", "surface"), ("water", "surface"),
]
# Layers a moving map does not draw (the other 34 form the map profile).
NOT_IN_MAP = {
    "atcblindspot", "aerodromesurfacelighting", "arrestinggearlocation", "arrestingsystemlocation", "deicinggroup",
    "landandholdshortoperationlocation", "positionmarking", "runwaycenterlinepoint", "surveycontrolpoint",
    "verticallinestructure", "verticalpointstructure",
}
# Feature-class number of the 36 layers of the client schema.
FEATURE_NUMBERS = {
    "runwayelement": 0, "runwayintersection": 1, "runwaythreshold": 2, "runwaymarking": 3, "paintedcenterline": 4,
    "landandholdshortoperationlocation": 5, "arrestinggearlocation": 6, "runwayshoulder": 7, "stopway": 8,
    "runwaydisplacedarea": 9, "finalapproachandtakeoffarea": 11, "touchdownliftoffarea": 12, "helipadthreshold": 13,
    "taxiwayelement": 14, "taxiwayshoulder": 15, "taxiwayguidanceline": 16, "taxiwayintersectionmarking": 17,
    "taxiwayholdingposition": 18, "runwayexitline": 19, "frequencyarea": 20, "apronelement": 21,
    "standguidanceline": 22, "parkingstandlocation": 23, "parkingstandarea": 24, "deicingarea": 25,
    "aerodromereferencepoint": 26, "verticalpolygonalstructure": 27, "verticalpointstructure": 28,
    "verticallinestructure": 29, "constructionarea": 30, "blastpad": 33, "serviceroad": 34, "water": 35,
    "hotspot": 37, "asrnedge": 39, "asrnnode": 40,
}
UNKNOWN, NOT_APPLICABLE = -32767, -32765

# Code lists with their legend labels.
LEGEND = {
    "surftype": ["unknown", "concrete grooved", "concrete", "asphalt grooved", "asphalt", "sand/dirt", "bare earth",
                 "snow/ice", "water", "grass", "aggregate friction seal coat", "gravel", "macadam", "metal", "mats",
                 "brick/pavers"],
    "status": ["unknown", "open", "closed", "under construction"],
    "rwymktyp": ["unknown", "none", "basic", "non-precision", "precision"],
    "marktype": [None, "threshold bar", "designation", "centerline stripe", "aiming point", "touchdown zone",
                 "side stripe", "displaced threshold arrow", "chevron"],
    "catstop": ["unknown", "CAT I", "CAT II", "CAT III", "CAT II/III", "no ILS"],
    "taxiwayelement.feattype": ["unknown", "parallel", "rapid exit", "exit", "turnaround", "apron taxiway",
                                "stand taxilane", "bridge"],
    "apronelement.feattype": ["unknown", "parking", "cargo", "general aviation", "maintenance", "military", "deicing",
                              "fuel", "helicopter"],
    "nodetype": ["unknown", "taxiway", "runway", "stand", "parking", "holding position", "runway exit", "deicing",
                 "helipad"],
    "edgetype": ["unknown", "taxiway", "runway", "stand", "parking", "runway exit", "deicing"],
    "direc": ["unknown", "bidirectional", "forward (start to end)", "backward"],
    "signtype": ["unknown", "mandatory", "information/direction", "location", "distance remaining", "destination"],
    "lstype": ["unknown", "PAPI", "VASI", "APAPI", "runway guard", "beacon", "windsock", "REIL", "approach"],
    "plysttyp": ["unknown", "terminal", "hangar", "control tower", "building", "fuel farm", "parking garage",
                 "industrial"],
    "pntsttyp": ["unknown", "tower", "mast", "chimney", "tree", "pole", "windsock", "antenna", "navaid", "tank"],
    "linsttyp": ["unknown", "fence", "wall", "power line", "cable", "hedge"],
    "thrtype": [None, "threshold", "displaced threshold", "runway end", "intersection"],
    "station": [None, "recorded (ATIS/AWOS)", "unicom/CTAF", "clearance delivery", "ground", "tower", "approach",
                "departure"],
}
# Surface code by scenery code, and by surface tag.
SCENERY_SURFACE = {1: 4, **{k: 4 for k in range(20, 39)}, 2: 2, **{k: 2 for k in range(50, 58)},
                   3: 9, 4: 6, 5: 11, 12: 5, 13: 8, 14: 7}
TAG_SURFACE = {
    "asphalt": 4, "paved": 4, "tarmac": 4, "concrete": 2, "concrete:plates": 2, "concrete:lanes": 2,
    "grass": 9, "turf": 9, "gravel": 11, "fine_gravel": 11, "compacted": 11, "pebblestone": 11,
    "dirt": 6, "earth": 6, "ground": 6, "unpaved": 6, "mud": 6, "sand": 5, "water": 8, "snow": 7, "ice": 7,
    "metal": 13, "metal_grid": 13, "paving_stones": 15, "sett": 15, "cobblestone": 15,
}
# Marking, station, visual aid and stand kind codes of scenery rows.
SCENERY_MARKING = {0: 1, 1: 2, 2: 3, 3: 4, 4: 2, 5: 2, 6: 2, 7: 2}
STATIONS = {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 5: 6, 6: 7}
VISUAL_AIDS = {1: 2, 5: 2, 2: 1, 3: 1, 4: 1, 6: 4, 7: 3, 8: 3}
STAND_KINDS = {"gate": "gate", "hangar": "hangar", "tie_down": "tie_down", "tie-down": "tie_down"}
STAND_KIND_CODES = {"gate": 1, "hangar": 2, "misc": 3, "tie_down": 4}
# Wingspan and side clearance by aerodrome code letter.
WINGSPANS = {"A": 15.0, "B": 24.0, "C": 36.0, "D": 52.0, "E": 65.0, "F": 80.0}
CLEARANCES = {"A": 3.0, "B": 3.0, "C": 4.5}
# Meaning of painted line codes, and which light codes count as lit.
LINE_MEANINGS = {
    0: "ignore", 1: "center", 51: "center", 60: "center", 7: "center_ils", 57: "center_ils",
    8: "lane", 9: "lane", 58: "lane", 59: "lane", 4: "runway_hold", 54: "runway_hold", 62: "runway_hold",
    6: "ils_hold", 56: "ils_hold", 64: "ils_hold", 5: "intersection_hold", 55: "intersection_hold",
    63: "intersection_hold", 3: "ignore", 53: "ignore", 30: "ignore", 31: "ignore", 32: "ignore",
    20: "ignore", 21: "ignore", 23: "ignore", 24: "ignore", 25: "ignore", 22: "road_center",
}
LIT_LIGHTS = [101, 105, 107, 108]
HOLD_LIGHTS = [103, 104]

# Client code for each of our codes, per attribute; the default comes last.
CLIENT_CODES = {
    "surftype": ({**{k: k for k in range(1, 12)}, 12: 17, 13: 13, 14: 22, 15: 16}, UNKNOWN),
    "gsurftyp": ({1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7, 11: 8, 13: 9, 15: 11, 12: 12, 14: 17}, UNKNOWN),
    "status": ({2: 0, 3: 0}, 1),
    "catstop": ({1: 1, 2: 2, 3: 2, 4: 2, 5: 0}, UNKNOWN),
    "direc": ({1: 0, 2: 1, 3: 2}, UNKNOWN),
    "style": ({2: 1, 3: 2}, 0),
    "vasis": ({1: 1, 3: 2, 2: 3}, 0),
    "plysttyp": ({1: 1, 2: 2, 3: 3, 5: 5}, 4),
    "pntsttyp": ({1: 3, 2: 3, 7: 3, 3: 1, 4: 5, 5: 6, 6: 4, 8: 9}, UNKNOWN),
    "linsttyp": ({3: 1, 4: 2, 5: 3, 2: 4}, UNKNOWN),
    "nodetype": ({1: 0, 5: 1, 2: 3, 6: 3, 4: 7, 3: 9, 7: 8}, 0),
    "edgetype": ({1: 0, 2: 1, 5: 2, 4: 3, 6: 5, 3: 7}, 0),
}
# Why a layer is empty, by layer; several depend on the contributing sources.
EMPTY_REASONS = {
    **dict.fromkeys(["hotspot", "atcblindspot"],
                    "no free worldwide source; supply via overrides/<ICAO>/<layer>.geojson"),
    **dict.fromkeys(["surveycontrolpoint", "positionmarking"], "surveyor data only; supply via overrides"),
    **dict.fromkeys(["landandholdshortoperationlocation", "arrestinggearlocation", "arrestingsystemlocation"],
                    "not published for this airport (FAA NASR covers US airports only)"),
    "stopway": "no stopway in sources (FAA declared distances / OSM aeroway=stopway)",
    **dict.fromkeys(["deicingarea", "deicinggroup"], "no deicing pad tagged in OSM"),
    "constructionarea": "no construction area in OSM",
    "water": "no water within the airport extent",
    "bridgeside": "no bridged taxiway in OSM",
    **dict.fromkeys(["asrnnode", "asrnedge"], "no taxi routing network (X-Plane) and no OSM taxiways"),
    **dict.fromkeys(["finalapproachandtakeoffarea", "touchdownliftoffarea", "helipadthreshold"],
                    "no helipad in sources"),
    "runwayshoulder": "runways have no shoulder in the X-Plane data",
    "runwaydisplacedarea": "no displaced thresholds",
    "blastpad": "no blastpads",
    "runwayintersection": "runways do not cross",
}
OSM_LAYERS = ["verticalpolygonalstructure", "verticalpointstructure", "verticallinestructure", "serviceroad"]
SCENERY_LAYERS = ["aerodromesign", "aerodromesurfacelighting", "frequencyarea"]
OSM_EMPTY = ("nothing matching within the airport extent in OSM", "OSM source not used")
SCENERY_EMPTY = ("not present in the X-Plane scenery", "X-Plane source not available")


def layer_registry(spark: SparkSession) -> DataFrame:
    """45 rows: layer, order, geometry kind, map profile flag, client feature number."""
    rows = [(n, i + 1, k, n not in NOT_IN_MAP, FEATURE_NUMBERS.get(n)) for i, (n, k) in enumerate(LAYERS)]
    return spark.createDataFrame(rows, "layer string, ord int, kind string, in_map boolean, feature_no int")


def code_legend(spark: SparkSession) -> DataFrame:
    """One row per attribute code: attr, code, label."""
    rows = [(a, i, v) for a, labels in LEGEND.items() for i, v in enumerate(labels) if v is not None]
    return spark.createDataFrame(rows, "attr string, code int, label string")


def code_translate(spark: SparkSession) -> DataFrame:
    rows = [(a, k, v) for a, (m, _) in CLIENT_CODES.items() for k, v in m.items()]
    return spark.createDataFrame(rows, "attr string, code int, client int")


def client_code(attr: str, code) -> Column:
    table, default = CLIENT_CODES[attr]
    return F.coalesce(lookup(table, c(code).cast("int")), F.lit(default))


def scenery_surface(code) -> Column:
    return F.coalesce(lookup(SCENERY_SURFACE, c(code).cast("int")), F.lit(0))


def tag_surface(value) -> Column:
    return F.coalesce(lookup(TAG_SURFACE, F.lower(c(value))), F.lit(0))


def line_meaning(code) -> Column:
    """Meaning of a painted line code; ``geometric`` where its shape decides."""
    return F.coalesce(lookup(LINE_MEANINGS, c(code).cast("int")), F.lit("geometric"))


def empty_reason(layer, has_scenery, has_osm) -> Column:
    n = c(layer)
    return (F.when(n.isin(OSM_LAYERS), F.when(c(has_osm), OSM_EMPTY[0]).otherwise(OSM_EMPTY[1]))
            .when(n.isin(SCENERY_LAYERS), F.when(c(has_scenery), SCENERY_EMPTY[0]).otherwise(SCENERY_EMPTY[1]))
            .otherwise(F.coalesce(lookup(EMPTY_REASONS, n), F.lit("no data in sources"))))


def stand_letter(size, types, kind) -> Column:
    """Code letter of a stand: published, else from aircraft types, else from its kind."""
    t = c(types)
    return (F.when(c(size).isNotNull(), c(size))
            .when(F.array_contains(t, "heavy"), "E").when(F.array_contains(t, "jets"), "C")
            .when(F.array_contains(t, "turboprops"), "B")
            .when(c(kind) == "gate", "C").when(c(kind) == "tie_down", "A").otherwise("B"))


def wingspan(letter) -> Column:
    return F.coalesce(lookup(WINGSPANS, letter), F.lit(36.0))


def clearance(letter) -> Column:
    return F.coalesce(lookup(CLEARANCES, letter), F.lit(7.5))


def restriction_wingspan(restriction) -> Column:
    return lookup(WINGSPANS, F.regexp_extract(F.upper(c(restriction)), "^TAXIWAY_([A-F])$", 1))


def width_wingspan(width) -> Column:
    """Wingspan class a centreline width allows."""
    ws = F.least(F.greatest((c(width) - 2) * 2, F.lit(15.0)), F.lit(80.0))
    return (F.when(c(width).isNull(), None).when(ws >= 65, 80.0).when(ws >= 52, 65.0).when(ws >= 36, 52.0)
            .when(ws >= 24, 36.0).otherwise(24.0))
