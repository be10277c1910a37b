"""Everything else: reference point, extent, capture rule, buildings, roads, areas, deicing, bridges, stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, shapes
from ..functions.geo import rnd, unit
from . import overlay, spans
from .conflate import merge_stands, unique_names
from .measure import offset_lines
from .network import components
from .ordered import rank, scan
from .pavement import TAXIWAY_WIDTH_M, big_enough
from .spatial import SEG, box_cells, edges_of, in_cells, lines_near, points_in_polygons, shuffled, within

EXTENT_M = 200.0
NEAR_RUNWAY_M, NEAR_MOVEMENT_M = 90.0, 50.0
LANDMARKS = (1, 2, 3)
DEICE_M = 60.0
# Cells in which polygons near features are told from the rest, and cells for the one or two large polygons of an airport.
BESIDE_M, LARGE_M = 500.0, 2500.0


def build_aerodromereferencepoint(headers: DataFrame) -> DataFrame:
    """``headers``: icao, published (bool), scenery (bool) and the header fields with lat0, lon0."""
    src = F.when(F.col("published") & F.col("scenery"), "xplane").otherwise("derived")
    return headers.select("icao", "iata", "name", "city", "country", "region", F.col("elev_ft").alias("elev"), F.lit(None).cast("double").alias("geound"), F.col("mag_var").alias("magvar"),
                          F.col("trans_alt_ft").alias("transalt"), F.col("trans_level").alias("translvl"), F.col("lat0").alias("lat"), F.col("lon0").alias("lon"), src.alias("source"), shapes.point_geom(F.lit(0.0), F.lit(0.0)).alias("geom"))


def extent(headers: DataFrame, outlines: DataFrame, surfaces: DataFrame, points: DataFrame) -> DataFrame:
    """Member polygons of an airport's extent with the margin that applies to each.

    ``outlines``: aerodrome areas and boundaries (margin 0); the hull of pavement, runways
    and stands gets 200 m; an airport with neither gets a 2,500 m circle.
    """
    verts = surfaces.select("icao", F.explode(F.col("geom")[0]).alias("p")).select("icao", "p.x", "p.y").unionByName(points.select("icao", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    h = overlay.hull(verts, ["icao"]).withColumn("margin", F.lit(EXTENT_M))
    members = outlines.select("icao", "geom", F.lit(0.0).alias("margin")).unionByName(h.select("icao", "geom", "margin"))
    bare = headers.select("icao").join(members.select("icao").distinct(), "icao", "left_anti")
    ring = bare.select("icao", F.array(shapes.circle(F.lit(0.0), F.lit(0.0), F.lit(2500.0), 32)).alias("geom"), F.lit(0.0).alias("margin"))
    return members.unionByName(ring).withColumn("mid", F.xxhash64("geom"))


def _distinct_near(polys: DataFrame, near: DataFrame | None, d: float) -> DataFrame:
    """Distinct polygons (icao, geom, _g), where ``near`` is given only those whose box comes within ``d`` of one of its boxes."""
    p = polys.select("icao", "geom")
    if near is not None:
        p = in_cells(box_cells(p, BESIDE_M), box_cells(near.select("icao", "geom"), BESIDE_M, d)).select("icao", "geom")
    return p.withColumn("_g", F.xxhash64("geom")).dropDuplicates(["icao", "_g"])


def _points_near(points: DataFrame, pid: list[str], polys: DataFrame, d: float, many: bool = False) -> DataFrame:
    """(icao, pid) of points inside or within ``d`` of polygons (icao, geom); ``many`` polygons, or a few large ones."""
    uniq = _distinct_near(polys, points.select("icao", shapes.point_geom("x", "y").alias("geom")) if many else None, d)
    inside = points_in_polygons(points, uniq, pid, ["_g"], cell=200.0 if many else LARGE_M).select("icao", *pid)
    if d <= 0:
        return inside.distinct()
    close = within(points, edges_of(uniq, ["icao"]), d, cell=250.0 if many else LARGE_M).select("icao", *pid)
    return inside.unionByName(close).distinct()


def _features_near(features: DataFrame, fid: list[str], polys: DataFrame, d: float, many: bool = False) -> DataFrame:
    """(icao, fid) of lines or polygons touching or within ``d`` of polygons (icao, geom); ``many`` polygons, or a few large ones.

    Either an edge comes close, or one lies wholly inside the other.
    """
    uniq = _distinct_near(polys, features if many else None, d)
    edges = lines_near(edges_of(features, ["icao", *fid]), fid, edges_of(uniq, ["icao"]), d, None if many else LARGE_M, few="lines" if many else None)
    first = features.select("icao", *fid, F.col("geom")[0][0].x.alias("x"), F.col("geom")[0][0].y.alias("y"))
    within_them = points_in_polygons(first, uniq, fid, ["_g"], cell=200.0 if many else LARGE_M).select("icao", *fid)
    closed = features.filter(F.size(F.col("geom")[0]) >= 4)
    probe = uniq.select("icao", "_g", F.col("geom")[0][0].x.alias("x"), F.col("geom")[0][0].y.alias("y"))
    around_them = points_in_polygons(probe, closed, ["_g"], fid).select("icao", *fid)
    return edges.unionByName(within_them).unionByName(around_them).distinct()


def capture(df: DataFrame, fid: list[str], movement: DataFrame, runways: DataFrame, fallback: DataFrame, kind: str = "feature",
            d_mov: float = NEAR_MOVEMENT_M, d_rwy: float = NEAR_RUNWAY_M) -> DataFrame:
    """Ids within 90 m of a runway or 50 m of other movement area; airports without either use the extent."""
    near = _points_near if kind == "point" else _features_near
    have = movement.select("icao").unionByName(runways.select("icao")).distinct()
    bare = df.join(have, "icao", "left_anti")
    hit = near(df, fid, movement, d_mov, many=True).unionByName(near(df, fid, runways, d_rwy, many=True))
    return hit.unionByName(in_extent(bare, fid, fallback, kind)).distinct()


def in_extent(df: DataFrame, fid: list[str], ext: DataFrame, kind: str = "feature") -> DataFrame:
    near = _points_near if kind == "point" else _features_near
    return near(df, fid, ext.filter("margin = 0"), 0.0).unionByName(near(df, fid, ext.filter("margin > 0"), EXTENT_M)).distinct()


def build_verticalpolygonalstructure(buildings: DataFrame, captured: DataFrame, extended: DataFrame) -> DataFrame:
    """Captured buildings, and landmarks anywhere in the extent; only landmarks keep a name."""
    landmark = F.col("kind").isin(*LANDMARKS)
    ids = captured.withColumn("_c", F.lit(True))
    b = buildings.join(ids, ["icao", "fid"], "left").join(extended.withColumn("_e", F.lit(True)), ["icao", "fid"], "left")
    b = b.filter(F.coalesce("_c", F.lit(False)) | (landmark & F.coalesce("_e", F.lit(False))))
    null = F.lit(None).cast("double")
    return b.select("icao", "fid", F.col("kind").alias("plysttyp"), F.when(landmark, F.col("name")).alias("name"), F.col("height_m").alias("height"), "levels", null.alias("elev"), F.lit(None).cast("string").alias("material"), "source", "geom")


def build_verticalpointstructure(points: DataFrame, captured: DataFrame) -> DataFrame:
    p = points.join(captured, ["icao", "fid"], "left_semi")
    return p.select("icao", "fid", F.col("kind").alias("pntsttyp"), "name", F.col("height_m").alias("height"), F.lit(None).cast("double").alias("elev"), F.lit(None).cast("boolean").alias("lighting"), "source", shapes.point_geom("x", "y").alias("geom"))


def build_verticallinestructure(lines: DataFrame, captured: DataFrame) -> DataFrame:
    p = lines.join(captured, ["icao", "fid"], "left_semi")
    return p.select("icao", "fid", F.col("kind").alias("linsttyp"), "name", F.col("height_m").alias("height"), F.lit(None).cast("double").alias("elev"), "source", "geom")


def build_serviceroad(roads: DataFrame, captured: DataFrame, near: DataFrame, pavement: DataFrame, painted: DataFrame, from_pavement: DataFrame, step: float = spans.STEP) -> DataFrame:
    """Road pavement; captured roads as round buffers, what of them lies near and off pavement; painted roadways elsewhere.

    ``roads``: icao, fid, name, width_m, bridge, source, geom (line); ``near``: spans of step ``step`` that roads
    are clipped to. Parts below 4 square metres go.
    """
    r = roads.join(captured, ["icao", "fid"], "left_semi").withColumn("w", F.coalesce("width_m", F.lit(5.0)))
    line = edges_of(r, ["icao", "fid", "w"]).withColumn("half", F.col("w") / 2)
    buffers = spans.united(spans.of_buffers(line, ["icao", "fid"], "half", step), ["icao", "fid"])
    rest = spans.minus(spans.common(buffers, near, ["fid"]), spans.cover(pavement, step), ["fid"])
    parts = spans.polygons(rest, ["icao", "fid"], step).filter(big_enough("area", "road"))
    cols = ["icao", "name", "surftype", "width", "bridge", "source", "geom"]
    own = parts.join(r.select("icao", "fid", "name", "w", "bridge", "source"), ["icao", "fid"]).select("icao", "name", F.lit(4).alias("surftype"), F.col("w").alias("width"), "bridge", "source", "geom")
    bare = painted.join(roads.select("icao").distinct(), "icao", "left_anti")
    paint = overlay.strips(bare, 6.0).select("icao", F.lit(None).cast("string").alias("name"), F.lit(4).alias("surftype"), F.lit(6.0).alias("width"), F.lit(False).alias("bridge"), F.lit("xplane").alias("source"), "geom")
    return from_pavement.select(cols).unionByName(own.select(cols)).unionByName(paint.select(cols))


def build_water(areas: DataFrame, captured: DataFrame, ext: DataFrame, water_rows: DataFrame, step: float = 5.0) -> DataFrame:
    """Parts of captured mapped water inside the extent; water runways."""
    w = areas.filter("kind = 'water'").withColumnRenamed("aid", "fid").join(captured, ["icao", "fid"], "left_semi")
    inside = spans.common(spans.of_polygons(w, ["fid"], step), spans_within(ext, step), ["fid"])
    parts = spans.polygons(inside, ["icao", "fid"], step).filter("area >= 0.5")
    own = parts.join(w.drop("geom"), ["icao", "fid"]).select("icao", F.lit(1).alias("feattype"), F.lit(None).cast("string").alias("idrwy"), "name", F.lit(8).alias("surftype"), "source", "geom")
    return own.unionByName(water_rows)


def spans_within(members: DataFrame, step: float) -> DataFrame:
    """Spans of all that lies in a member (icao, margin, geom) or within its margin."""
    edges = edges_of(members.filter("margin > 0"), ["icao", "margin"])
    return spans.united(spans.cover(members, step).unionByName(spans.of_buffers(edges, ["icao"], "margin", step)), ["icao"])


def build_constructionarea(areas: DataFrame, captured: DataFrame, pavement: DataFrame, step: float = spans.STEP) -> DataFrame:
    """Parts of mapped sites outside pavement, of more than 400 square metres, where a quarter of the site is left."""
    s = areas.filter("kind = 'construction'").withColumnRenamed("aid", "fid").join(captured, ["icao", "fid"], "left_semi")
    rest = spans.remainders(s, pavement, ["fid"], step)
    enough = rest.groupBy("icao", "fid").agg((F.sum("area") / F.max("own")).alias("left")).filter("left >= 0.25").select("icao", "fid")
    parts = rest.filter(big_enough("area", "construction")).join(enough, ["icao", "fid"], "left_semi")
    return parts.select("icao", "fid", "part", "geom").join(s.drop("geom"), ["icao", "fid"]).select("icao", "name", F.lit(3).alias("status"), F.lit(None).cast("string").alias("pendate"), "source", "geom")


def deicing_clusters(polys: DataFrame, d: float = DEICE_M) -> DataFrame:
    """Clusters of polygons within ``d`` of each other: icao, aid, cluster (its smallest aid)."""
    e = edges_of(polys, ["icao", "aid"])
    from .spatial import segment_cells
    a = segment_cells(e.select("icao", F.col("aid").alias("a"), *SEG), max(d, 100.0), d)
    b = segment_cells(e.select("icao", F.col("aid").alias("b"), *SEG), max(d, 100.0)).select("icao", "cx", "cy", "b", *[F.col(n).alias(f"o{n}") for n in SEG])
    from ..functions.geo import seg_seg_dist
    near = a.join(shuffled(b), ["icao", "cx", "cy"]).filter((F.col("a") < F.col("b")) & (seg_seg_dist(*SEG, *[f"o{n}" for n in SEG]) <= d)).select("icao", "a", "b").distinct()
    # One may also lie wholly inside the other.
    corner = polys.select("icao", F.col("aid").alias("a"), F.col("geom")[0][0].x.alias("x"), F.col("geom")[0][0].y.alias("y"))
    inside = points_in_polygons(corner, polys.select("icao", F.col("aid").alias("b"), "geom"), ["a"], ["b"]).filter("a <> b").select("icao", "a", "b")
    node = lambda n: F.struct("icao", F.col(n).alias("aid")).alias(n)  # noqa: E731  ids are unique within an airport only
    lab = components(near.unionByName(inside).select(node("a"), node("b"))).select("node.icao", "node.aid", F.col("label.aid").alias("cluster"))
    return polys.select("icao", "aid").join(lab, ["icao", "aid"], "left").select("icao", "aid", F.coalesce("cluster", "aid").alias("cluster"))


def deicing_layers(areas: DataFrame, captured: DataFrame) -> dict[str, DataFrame]:
    """Deicing areas with their group, and one hull per group; one name for both."""
    p = areas.filter("kind = 'deicing'").join(captured.withColumnRenamed("fid", "aid"), ["icao", "aid"], "left_semi")
    m = p.join(deicing_clusters(p), ["icao", "aid"])
    groups = m.groupBy("icao", "cluster").agg(F.count(F.lit(1)).alias("members"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("aid"))).alias("_n"))
    groups = scan(groups, ["icao"], ["cluster"], _k=rank()).withColumn("deicegrp", F.coalesce("_n", F.concat(F.lit("DEICE "), F.col("_k").cast("string"))))
    hulls = overlay.hull(m.select("icao", "cluster", F.explode(F.col("geom")[0]).alias("p")).select("icao", "cluster", "p.x", "p.y"), ["icao", "cluster"])
    area = m.join(groups.select("icao", "cluster", "deicegrp"), ["icao", "cluster"])
    return {
        "deicingarea": area.select("icao", "aid", F.col("name").alias("idapron"), "deicegrp", F.col("surface").alias("surftype"), F.lit(1).alias("status"), "source", "geom"),
        "deicinggroup": groups.join(hulls, ["icao", "cluster"]).select("icao", "deicegrp", "members", F.lit("derived").alias("source"), "geom"),
    }


def mapped_pads(areas: DataFrame, captured: DataFrame, kind: str) -> DataFrame:
    """Captured stopway or blastpad areas from the map."""
    a = areas.filter(F.col("kind") == kind).join(captured.withColumnRenamed("fid", "aid"), ["icao", "aid"], "left_semi")
    null = F.lit(None)
    return a.select("icao", F.col("reference").alias("idrwy"), null.cast("string").alias("idthr"), F.col("surface").alias("surftype"), null.cast("double").alias("length"), null.cast("double").alias("width"), "source", "geom")


def build_hotspot(areas: DataFrame, captured: DataFrame) -> DataFrame:
    a = areas.filter("kind = 'hotspot'").join(captured.withColumnRenamed("fid", "aid"), ["icao", "aid"], "left_semi")
    return a.select("icao", F.col("name").alias("idhot"), "name", F.col("reference").alias("description"), "source", "geom")


def build_bridgeside(lines: DataFrame) -> DataFrame:
    """Both sides of bridged taxiways, (width + 6) / 2 from the centreline.

    ``lines``: vertices (icao, fid, seq, x, y, name, width_m, bridge, source).
    """
    b = lines.filter("bridge").withColumn("side", F.explode(F.array(F.lit(1), F.lit(2))))
    half = (F.coalesce("width_m", F.lit(TAXIWAY_WIDTH_M)) + 6) / 2 * F.when(F.col("side") == 1, -1.0).otherwise(1.0)
    o = offset_lines(b.withColumn("_off", half), ["icao", "fid", "side"], F.col("_off"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("seq", "ox", "oy"))), lambda s: shapes.pt(s.ox, s.oy))
    g = o.groupBy("icao", "fid", "side").agg(F.array(line).alias("geom"), F.first("name", True).alias("name"), F.first("source").alias("source"), F.count(F.lit(1)).alias("n"))
    return g.filter("n >= 2").select("icao", "fid", F.col("name").alias("idlin"), "side", "name", "source", "geom")


def build_frequencyarea(freqs: DataFrame, boundary: DataFrame, ext: DataFrame) -> DataFrame:
    """The boundary (else the largest extent member) once per frequency."""
    big = ext.groupBy("icao").agg(F.max_by("geom", shapes.geom_area("geom")).alias("_x"))
    area = freqs.join(boundary.select("icao", F.col("geom").alias("_b")), "icao", "left").join(big, "icao", "left")
    return area.select("icao", rnd("mhz", 3).alias("frq"), "station", "name", F.lit("xplane").alias("source"), F.coalesce("_b", "_x").alias("geom"))


def stand_layers(stands: DataFrame, aprons: DataFrame) -> dict[str, DataFrame]:
    """Merged, named and sized stands with their apron, and their areas.

    ``stands``: icao, sid, name, x, y, heading, kind, size_code, operation, airlines, types,
    jetway, outline (ring or null), source; ``aprons``: icao, fid, idapron, geom.
    """
    s = unique_names(merge_stands(stands), ["source_ord", "sid"]) if "source_ord" in stands.columns else unique_names(merge_stands(stands), ["sid"])
    on = points_in_polygons(s, aprons, ["sid"], ["fid"]).join(aprons.select("icao", "fid", "idapron"), ["icao", "fid"]).groupBy("icao", "sid").agg(F.min_by("idapron", "fid").alias("idapron"))
    s = s.join(on, ["icao", "sid"], "left").withColumn("letter", codes.stand_letter("size_code", "types", "kind")).withColumn("wingspan", codes.wingspan("letter"))
    null_b = F.lit(None).cast("boolean")
    blank = lambda v: F.nullif(v, F.lit(""))
    from ..functions.text import lookup
    loc = s.select("icao", "sid", F.col("name").alias("idstd"), "idapron", rnd("heading").alias("brngtrue"), "wingspan", blank(F.array_join("types", "|")).alias("acft"), "jetway", *[null_b.alias(n) for n in ("gndpower", "fuel", "docking", "towing")],
                   F.col("operation").alias("restacft"), blank(F.array_join("airlines", " ")).alias("airlines"), lookup(codes.STAND_KIND_CODES, "kind").alias("pmtyp"), F.lit(1).alias("status"), "source", shapes.point_geom("x", "y").alias("geom"))
    h = F.coalesce("heading", F.lit(0.0))
    long = F.greatest(F.col("wingspan") * 1.15, F.lit(12.0))
    ux, uy = unit(h)
    box = shapes.rect_centered(F.col("x") - ux * long * 0.1, F.col("y") - uy * long * 0.1, h, long, F.col("wingspan") + 2 * codes.clearance("letter"))
    ring = F.when(F.size("outline") >= 4, shapes.oriented("outline"))
    area = s.select("icao", "sid", F.col("name").alias("idstd"), "idapron", F.lit(None).cast("int").alias("surftype"), "wingspan", F.lit(1).alias("status"), F.when(F.col("outline").isNotNull(), F.col("source")).otherwise("derived").alias("source"),
                    F.array(F.coalesce(ring, box)).alias("geom"), "jetway")
    return {"parkingstandlocation": loc, "parkingstandarea": area}


