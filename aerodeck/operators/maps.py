"""Map extracts: labels, extents, tiles and the filters that keep them small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import shapes, text
from ..functions.geo import c
from . import spans

TILE_M = 300.0
MAX_M = 20000.0
MIN_BUILDING_M2 = 300.0


def drop_outliers(vertex: DataFrame, max_m: float = MAX_M) -> DataFrame:
    return vertex.filter((F.abs("x") <= max_m) & (F.abs("y") <= max_m))


def depicted_buildings(buildings: DataFrame) -> DataFrame:
    """Terminals, named landmarks and anything of 300 square metres or more."""
    return buildings.filter((F.col("plysttyp") == 1) | F.col("name").isNotNull() | (F.col("area") >= MIN_BUILDING_M2))


def largest_per_name(df: DataFrame, name: str, measure: str, values: list[str], tie: str) -> DataFrame:
    """The largest piece of each name and its measure; ties go to the smallest ``tie``."""
    best = F.min_by(F.struct(measure, *values), F.struct((-c(measure)).alias("m"), c(tie).alias("t")))
    return df.filter(c(name).isNotNull()).groupBy("icao", name).agg(best.alias("_b")).select("icao", name, "_b.*")


def movement_extent(runways: DataFrame, pavement: DataFrame) -> DataFrame:
    """Runway box grown by pavement that stays within 0.6 of its size, padded by 5 %."""
    box = ["min_x", "min_y", "max_x", "max_y"]
    w = runways.groupBy("icao").agg(F.min("min_x").alias("a"), F.min("min_y").alias("b"), F.max("max_x").alias("c"), F.max("max_y").alias("d"))
    rw, rh = 0.6 * F.greatest(F.col("c") - F.col("a"), F.lit(1500.0)), 0.6 * F.greatest(F.col("d") - F.col("b"), F.lit(1500.0))
    near = pavement.join(w, "icao").filter((F.col("min_x") >= F.col("a") - rw) & (F.col("min_y") >= F.col("b") - rh) & (F.col("max_x") <= F.col("c") + rw) & (F.col("max_y") <= F.col("d") + rh))
    both = runways.select("icao", *box).unionByName(near.select("icao", *box))
    e = both.groupBy("icao").agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
    pad = 0.05 * F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(200.0))
    return e.select("icao", (F.col("min_x") - pad).alias("min_x"), (F.col("min_y") - pad).alias("min_y"), (F.col("max_x") + pad).alias("max_x"), (F.col("max_y") + pad).alias("max_y"))


def frequencies(df: DataFrame) -> DataFrame:
    return df.select("icao", "name", "mhz").distinct().orderBy("icao", "name", "mhz")


def runway_table(elements: DataFrame, legend: DataFrame) -> DataFrame:
    """One row per runway pair: longest piece, metres and feet, surface label."""
    best = largest_per_name(elements, "idrwy", "length", ["width", "surftype"], "width")
    # The legend is a fixed dimension of about a hundred rows.
    surf = F.broadcast(legend.filter("attr = 'surftype'").select(F.col("code").alias("surftype"), F.upper("label").alias("surface")))
    feet = lambda v: F.round(F.col(v) * 3.28084).cast("bigint")
    return best.join(surf, "surftype", "left").select("icao", "idrwy", "length", "width", feet("length").alias("length_ft"), feet("width").alias("width_ft"), "surface")


def label_position(x, y, bearing, back: float = 55.0) -> tuple[Column, Column]:
    b = F.radians(F.coalesce(c(bearing), F.lit(0.0)))
    return c(x) - F.sin(b) * back, c(y) - F.cos(b) * back


def label_set(guides: DataFrame, thresholds: DataFrame, stands: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Map labels: taxiways on their longest line (>= 40 m), runway ends 55 m out, stands, landmarks.

    ``guides``: icao, fid, idlin, length, mid_x, mid_y; ``thresholds``: icao, idthr, x, y,
    brngtrue; ``stands``: icao, idstd, x, y; ``landmarks``: icao, fid, name, area, x, y.
    """
    twy = largest_per_name(guides, "idlin", "length", ["mid_x", "mid_y"], "fid").filter(F.col("length") >= 40.0)
    twy = twy.select("icao", F.lit(1).alias("kind"), F.col("idlin").alias("label"), F.col("mid_x").alias("x"), F.col("mid_y").alias("y"))
    lx, ly = label_position("x", "y", "brngtrue")
    rwy = thresholds.select("icao", F.lit(2).alias("kind"), F.col("idthr").alias("label"), lx.alias("x"), ly.alias("y"))
    std = stands.select("icao", F.lit(3).alias("kind"), text.tidy_stand("idstd").alias("label"), "x", "y")
    named = landmarks.withColumn("name", text.tidy_name("name")).filter("name <> ''")
    term = largest_per_name(named, "name", "area", ["x", "y"], "fid").select("icao", F.lit(4).alias("kind"), F.col("name").alias("label"), "x", "y")
    rows = twy.unionByName(rwy).unionByName(std).unionByName(term)
    rows = rows.withColumn("label", text.decode_entities(F.trim("label"))).filter((F.col("label") != ""))
    return drop_outliers(rows)


def geometry_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long vertex table of a feature table: keys, ring, seq, x, y."""
    return df.select(*keys, F.posexplode("geom").alias("ring", "_r")).select(*keys, "ring", F.posexplode("_r").alias("seq", "_p")).select(*keys, "ring", "seq", "_p.x", "_p.y")


# Layers of the two slim extracts, and the properties each keeps.
SLIM_LAYERS = {
    "viewer": ["aerodromereferencepoint", "runwayelement", "runwaydisplacedarea", "blastpad", "stopway", "runwayshoulder", "taxiwayelement", "taxiwayshoulder", "apronelement", "serviceroad",
               "verticalpolygonalstructure", "water", "constructionarea", "deicingarea", "taxiwayguidanceline", "standguidanceline", "runwayexitline", "taxiwayholdingposition",
               "taxiwayintersectionmarking", "paintedcenterline", "parkingstandlocation", "runwaythreshold", "runwaymarking", "aerodromesign", "hotspot", "bridgeside", "finalapproachandtakeoffarea"],
    "chart": ["aerodromereferencepoint", "runwayelement", "runwaydisplacedarea", "blastpad", "stopway", "taxiwayelement", "apronelement", "verticalpolygonalstructure", "water",
              "taxiwayguidanceline", "runwayexitline", "taxiwayholdingposition", "parkingstandlocation", "runwaythreshold", "frequencyarea", "hotspot", "verticalpointstructure", "constructionarea"],
}
SLIM_PROPERTIES = {
    "runwayelement": ["idrwy", "width", "length", "surftype"], "taxiwayelement": ["idlin"], "apronelement": ["idapron"], "verticalpolygonalstructure": ["plysttyp", "name"], "taxiwayguidanceline": ["idlin"],
    "runwayexitline": ["idlin", "idrwy"], "taxiwayholdingposition": ["idrwy", "catstop"], "parkingstandlocation": ["idstd", "brngtrue"], "runwaymarking": ["marktype", "text"], "hotspot": ["idhot"],
    "runwaythreshold": ["idthr", "idrwy", "brngtrue", "tora", "lda", "width", "rwymktyp"], "aerodromesign": ["msgfront", "signtype", "signdir"], "frequencyarea": ["frq", "station", "name"],
    "aerodromereferencepoint": ["idarpt", "iata", "name", "city", "country", "elev", "lat", "lon", "transalt"], "verticalpointstructure": ["pntsttyp", "name"],
}


def slim(features: DataFrame, extract: str, keep: list[str]) -> DataFrame:
    """Features of the layers of an extract with their few properties as JSON; null properties are left out.

    ``features``: icao, layer, the columns of ``keep`` and attributes of any layer; only columns some layer keeps are read.
    """
    wanted = SLIM_LAYERS[extract]
    value = F.lit("{}")
    for layer in wanted:
        names = [n for n in SLIM_PROPERTIES.get(layer, []) if n in features.columns]
        if names:
            value = F.when(F.col("layer") == layer, F.to_json(F.struct(*names), {"ignoreNullFields": "true"})).otherwise(value)
    return features.filter(F.col("layer").isin(wanted)).select("icao", "layer", *keep, value.alias("value"))


def tile_parts(polys: DataFrame, step: float = spans.STEP, tile: float = TILE_M, key: str = "icao", square: bool = False) -> DataFrame:
    """(key, tile_x, tile_y, part, geom, area): the union of all polygons of a key as rings with holes, tile by tile.

    Rings are walked within a tile, so the work of one row is bounded by the tile and not by the airport. Areas are
    those of the spans; corners are off by up to half a row, or exact with ``square`` where all sides follow the axes.
    """
    cut = spans.bucketed(spans.cover(polys, step, key), tile).withColumnRenamed("_b", "tile_x").withColumn("tile_y", F.floor((F.col("row") + 0.5) * step / tile).cast("int"))
    return spans.polygons(cut, [key, "tile_x", "tile_y"], step, square)


def outline(parts: DataFrame, tile: float = TILE_M, key: str = "icao") -> DataFrame:
    """(key, tile_x, tile_y, line, seq, x, y): the outline of the united polygons as lines that end at tile borders.

    ``parts``: rings from ``tile_parts``. A side on a tile border is a cut where the neighbour tile is covered too:
    sides of both tiles meet in one interval sum along the border, and only what occurs once is outline.
    """
    ring = parts.select(key, "tile_x", "tile_y", "part", F.posexplode("geom").alias("ring", "_r"))
    n = F.size("_r") - 1
    side = F.zip_with(F.slice("_r", 1, n), F.slice("_r", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    e = ring.select(key, "tile_x", "tile_y", "part", "ring", F.posexplode(side).alias("seq", "_e")).select(
        key, "tile_x", "tile_y", "part", "ring", "seq", F.col("_e.a.x").alias("ax"), F.col("_e.a.y").alias("ay"), F.col("_e.b.x").alias("bx"), F.col("_e.b.y").alias("by"))
    on = lambda p, q, t: (F.col(p) == F.col(q)) & F.col(p).isin(F.col(t) * tile, (F.col(t) + 1) * tile)
    e = e.withColumn("axis", F.when(on("ax", "bx", "tile_x"), "v").when(on("ay", "by", "tile_y"), "h"))
    # Sides inside a tile: runs of one ring without a border side between them.
    by_ring = W.partitionBy(key, "tile_x", "tile_y", "part", "ring").orderBy("seq")
    inner = e.filter("axis IS NULL").withColumn("_run", F.col("seq") - F.row_number().over(by_ring))
    name = F.concat_ws("/", F.lit("r"), "part", "ring", "_run")
    own = inner.withColumn("line", name)
    first = own.withColumn("_first", F.row_number().over(W.partitionBy(key, "tile_x", "tile_y", "line").orderBy("seq"))).filter("_first = 1")
    ids = [key, "tile_x", "tile_y", "line"]
    drawn = first.select(*ids, F.lit(-1).alias("seq"), F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(own.select(*ids, "seq", F.col("bx").alias("x"), F.col("by").alias("y")))
    # Sides on a border: +1 where one begins, -1 where it ends, for the tiles of both sides.
    v = F.col("axis") == "v"
    b = e.filter("axis IS NOT NULL").select(key, "axis", F.when(v, F.col("ax")).otherwise(F.col("ay")).alias("at"), F.explode(F.array(
        F.struct(F.when(v, F.least("ay", "by")).otherwise(F.least("ax", "bx")).alias("p"), F.lit(1).alias("d")), F.struct(F.when(v, F.greatest("ay", "by")).otherwise(F.greatest("ax", "bx")).alias("p"), F.lit(-1).alias("d")))).alias("_p"))
    at = W.partitionBy(key, "axis", "at").orderBy("p")
    steps = b.groupBy(key, "axis", "at", "_p.p").agg(F.sum("_p.d").alias("d"))
    once = steps.withColumn("n", F.sum("d").over(at)).withColumn("q", F.lead("p").over(at)).filter("n = 1")
    ends = once.select(key, F.concat_ws("/", "axis", "at", "p").alias("line"), F.posexplode(F.array(F.when(v, shapes.pt("at", "p")).otherwise(shapes.pt("p", "at")), F.when(v, shapes.pt("at", "q")).otherwise(shapes.pt("q", "at")))).alias("seq", "_v"),
                       *[F.floor(F.when(a, F.col("at")).otherwise(F.col("p")) / tile).cast("int").alias(t) for a, t in ((v, "tile_x"), (~v, "tile_y"))])
    return drawn.unionByName(ends.select(*ids, "seq", "_v.x", "_v.y"))


def line_pieces(pieces: DataFrame, size: float = TILE_M, limit: float = MAX_M) -> DataFrame:
    """(icao, tile_x, tile_y, layer, box, points): pieces of lines in whole metres, at the tile of their first vertex.

    ``pieces``: icao, layer, fid, piece, seq, x, y. Pieces of one vertex or with a vertex too far out are left out.
    """
    p = pieces.groupBy("icao", "layer", "fid", "piece").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("_p"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("_far"))
    p = p.filter((F.col("_far") <= limit) & (F.size("_p") >= 2))
    whole = lambda n: F.transform("_p", lambda q: F.round(q[n]).cast("bigint"))
    p = p.withColumn("_x", whole("x")).withColumn("_y", whole("y"))
    return p.select("icao", F.floor(F.col("_p")[0].x / size).alias("tile_x"), F.floor(F.col("_p")[0].y / size).alias("tile_y"), "layer", F.array_min("_x").alias("min_x"), F.array_min("_y").alias("min_y"),
                    F.array_max("_x").alias("max_x"), F.array_max("_y").alias("max_y"), F.struct("layer", "fid", "piece", F.arrays_zip(F.col("_x").alias("x"), F.col("_y").alias("y")).alias("points")).alias("line"))


def tile_extract(pieces: DataFrame, labels: DataFrame, fills: DataFrame | None = None, size: float = TILE_M) -> DataFrame:
    """One row a tile of an airport: box of all it holds, fills, lines and labels, each in a fixed order.

    ``labels``: icao, kind, label, x, y. ``fills``: icao, tile_x, tile_y, layer, geom, already cut to tiles.
    """
    x, y = F.round("x").cast("bigint"), F.round("y").cast("bigint")
    parts = [line_pieces(pieces, size).drop("layer").withColumnsRenamed({"line": "_l"}),
             labels.select("icao", F.floor(F.col("x") / size).alias("tile_x"), F.floor(F.col("y") / size).alias("tile_y"), x.alias("min_x"), y.alias("min_y"), x.alias("max_x"), y.alias("max_y"), F.struct(x.alias("x"), y.alias("y"), "label", "kind").alias("_t"))]
    if fills is not None:
        whole = F.transform("geom", lambda r: F.transform(r, lambda p: F.struct(F.round(p.x).cast("bigint").alias("x"), F.round(p.y).cast("bigint").alias("y"))))
        box = shapes.bounds("geom")
        parts.append(fills.select("icao", F.col("tile_x").cast("bigint").alias("tile_x"), F.col("tile_y").cast("bigint").alias("tile_y"), *[F.round(v).cast("bigint").alias(n) for n, v in box.items()], F.struct("layer", whole.alias("rings")).alias("_f")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    lists = [F.array_sort(F.collect_list(c)).alias(n) for c, n in (("_f", "fills"), ("_l", "lines"), ("_t", "labels")) if c in rows.columns]
    return rows.groupBy("icao", "tile_x", "tile_y").agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), *lists)
