"""Runway family: geometry, elements, thresholds, areas beyond the ends, overlaps, shoulders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes, text
from ..functions.geo import c, dist, heading, reverse_heading, right_of, rnd, unit
from .conflate import drop_repeated_runways, fallback
from .spatial import box_pairs

RUNWAY_SHOULDER_M = 7.5
# Threshold types, light object types, status.
THRESHOLD, DISPLACED, END, CROSSING = 1, 2, 3, 4
REIL, APPROACH = 7, 8
OPEN = 1
END_FIELDS = {"ident": "string", "displaced": "double", "blastpad": "double", "marking": "int", "approach": "int", "tdz": "boolean",
              "reil": "int", "stopway": "double", "tora": "double", "toda": "double", "asda": "double", "lda": "double", "tdze": "double"}


def _field(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def drop_degenerate(runways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runways of at least 30 m by 1 m, and the rejected ones with a warning."""
    bad = (dist("ax", "ay", "bx", "by") < 30.0) | (F.col("width_m") < 1.0)
    note = F.concat(F.lit("runway "), "ident0", F.lit("/"), "ident1", F.lit(" degenerate, skipped"))
    return runways.filter(~bad), runways.filter(bad).withColumn("warning", note)


def runway_geometry(runways: DataFrame, dedupe: bool = True) -> DataFrame:
    """Runways of the scenery (others only where it has none) with heading, thresholds and outline."""
    scenery, other = runways.filter("source = 'xplane'"), runways.filter("source <> 'xplane'")
    kept, _ = drop_degenerate(fallback(scenery, other))
    g = kept.withColumn("length", dist("ax", "ay", "bx", "by")).withColumn("heading", heading("ax", "ay", "bx", "by"))
    g = g.withColumn("idrwy", text.pair_id("ident0", "ident1"))
    ux, uy = unit("heading")
    for k, (x, y, s) in enumerate((("ax", "ay", 1), ("bx", "by", -1))):
        d = F.least(f"displaced{k}", F.col("length") / 2) * s
        g = g.withColumn(f"t{k}x", F.col(x) + ux * d).withColumn(f"t{k}y", F.col(y) + uy * d)
    g = g.withColumn("geom", F.array(shapes.rect_along("ax", "ay", "heading", "length", "width_m")))
    return drop_repeated_runways(g, ["rid"]) if dedupe else g


def runway_ends(rw: DataFrame) -> DataFrame:
    """One row per runway end; with geometry present also position, threshold and landing direction."""
    shaped = "heading" in rw.columns
    ends = []
    for k in (0, 1):
        x, y = (("ax", "ay"), ("bx", "by"))[k]
        cols = [F.lit(k).alias("end_no"), F.col(x).alias("ex"), F.col(y).alias("ey")]
        cols += [_field(rw, f"{n}{k}", t).alias(n if n not in ("stopway", "tora", "toda", "asda", "lda") else f"{n}_m") for n, t in END_FIELDS.items()]
        if shaped:
            cols += [F.col(f"t{k}x").alias("tx"), F.col(f"t{k}y").alias("ty"), F.col(f"t{1 - k}x").alias("ox"), F.col(f"t{1 - k}y").alias("oy"),
                     (F.col("heading") if k == 0 else reverse_heading("heading")).alias("hdg")]
        ends.append(F.struct(*cols))
    keep = ["icao", "rid", "source", "width_m", "surface"] + (["idrwy", "length"] if shaped else [])
    out = rw.select(*keep, F.explode(F.array(*ends)).alias("_e")).select(*keep, "_e.*").withColumnRenamed("tdze", "tdze_ft")
    if shaped:
        out = out.withColumn("shift", dist("ex", "ey", "tx", "ty")).withColumn("gap", dist("tx", "ty", "ox", "oy"))
    return out


def attach_visual_aid(ends: DataFrame, lights: DataFrame) -> DataFrame:
    """First PAPI, VASI or APAPI whose runway is this end (case-insensitive)."""
    first = lights.filter(F.col("kind").isin(1, 2, 3)).groupBy("icao", F.upper("runway").alias("_key")).agg(F.min_by("kind", "line_no").alias("vasis"))
    return ends.withColumn("_key", F.upper("ident")).join(first, ["icao", "_key"], "left").drop("_key")


def runway_overlaps(rw: DataFrame, cell: float = 500.0) -> DataFrame:
    """Overlap polygons (> 1 square metre) of runway pairs, each pair once in designator order."""
    box = shapes.bounds("geom")
    base = rw.select("icao", "rid", "idrwy", "surface", "geom", *[v.alias(n) for n, v in box.items()])
    side = {p: base.select("icao", *[F.col(n).alias(f"{p}_{n}") for n in base.columns if n != "icao"]) for p in "lr"}
    pairs = box_pairs(side["l"], side["r"], cell).filter(F.struct("l_idrwy", "l_rid") < F.struct("r_idrwy", "r_rid"))
    ring = shapes.clip_convex(F.col("l_geom")[0], F.col("r_geom")[0])
    out = pairs.withColumn("ring", ring).filter(F.size("ring") >= 4).withColumn("area", shapes.ring_area("ring")).filter(F.col("area") > 1.0)
    return out.select("icao", "l_rid", "r_rid", F.concat("l_idrwy", F.lit("+"), "r_idrwy").alias("idrwi"), F.col("l_surface").alias("surface"),
                      "area", F.array("ring").alias("geom"))


def build_runwayelement(rw: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Runway rectangles minus the overlaps; split pieces keep the runway's attributes."""
    cuts = (overlaps.select("icao", F.col("l_rid").alias("rid"), F.col("r_rid").alias("other"), F.col("geom")[0].alias("cut"))
            .unionByName(overlaps.select("icao", F.col("r_rid").alias("rid"), F.col("l_rid").alias("other"), F.col("geom")[0].alias("cut"))))
    per = cuts.groupBy("icao", "rid").agg(F.array_sort(F.collect_list(F.struct("other", "cut"))).alias("_c")).select("icao", "rid", F.transform("_c", lambda s: s["cut"]).alias("cuts"))
    j = rw.join(per, ["icao", "rid"], "left")
    pieces = F.when(F.col("cuts").isNull(), F.array(F.col("geom")[0])).otherwise(shapes.subtract_all(F.col("geom")[0], "cuts"))
    return j.withColumn("_p", F.explode(pieces)).select(
        "icao", "rid", "idrwy", F.col("surface").alias("surftype"), rnd("width_m").alias("width"), rnd("length").alias("length"), F.lit(OPEN).alias("status"),
        F.lit(None).cast("string").alias("pcn"), F.col("centerline_lights").alias("rwelight"), (F.col("edge_lights") > 0).alias("edgelght"),
        rnd("heading").alias("brngtrue"), "source", F.array("_p").alias("geom"))


def build_runwaythreshold(ends: DataFrame, lights: DataFrame, headers: DataFrame) -> DataFrame:
    """``headers``: icao, elev_ft (fallback elevation)."""
    e = attach_visual_aid(ends, lights).join(headers.select("icao", "elev_ft"), "icao", "left")
    tora = F.col("length")
    return e.select(
        "icao", "rid", F.col("ident").alias("idthr"), "idrwy", F.when(F.col("shift") > 0.5, DISPLACED).otherwise(THRESHOLD).alias("thrtype"), rnd("hdg").alias("brngtrue"),
        F.lit(None).cast("double").alias("brngmag"), rnd("width_m").alias("width"), rnd(F.coalesce("tora_m", tora)).alias("tora"), rnd(F.coalesce("toda_m", tora)).alias("toda"),
        rnd(F.coalesce("asda_m", tora + F.coalesce("stopway_m", F.lit(0.0)))).alias("asda"), rnd(F.coalesce("lda_m", "gap")).alias("lda"), F.coalesce("tdze_ft", "elev_ft").alias("tdze"),
        F.col("marking").alias("rwymktyp"), F.col("approach").alias("tohlight"), F.col("tdz").alias("tdzlight"), "reil", "vasis", F.lit(OPEN).alias("status"), "source",
        shapes.point_geom("tx", "ty").alias("geom"))


def build_runwaycenterlinepoint(ends: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Physical end, then the displaced or plain threshold, per end; centres of overlaps."""
    points = F.array(F.struct(F.lit(END).alias("feattype"), F.col("ex").alias("x"), F.col("ey").alias("y")),
                     F.struct(F.when(F.col("shift") > 0.5, DISPLACED).otherwise(THRESHOLD).alias("feattype"), F.col("tx").alias("x"), F.col("ty").alias("y")))
    own = ends.withColumn("_p", F.explode(points)).select("icao", "idrwy", F.col("ident").alias("idthr"), "_p.feattype", rnd("hdg").alias("brngtrue"), "source",
                                                          shapes.point_geom("_p.x", "_p.y").alias("geom"))
    mid = shapes.ring_centroid(F.col("geom")[0])
    cross = overlaps.select("icao", F.col("idrwi").alias("idrwy"), F.lit(None).cast("string").alias("idthr"), F.lit(CROSSING).alias("feattype"),
                            F.lit(None).cast("double").alias("brngtrue"), F.lit("derived").alias("source"), F.array(F.array(mid)).alias("geom"))
    return own.unionByName(cross)


def build_runwayintersection(overlaps: DataFrame) -> DataFrame:
    return overlaps.select("icao", "idrwi", F.col("idrwi").alias("idrwy"), F.col("surface").alias("surftype"), F.lit(OPEN).alias("status"), F.lit("derived").alias("source"), "geom")


def _beyond(ends: DataFrame, length: str, hdg: Column, source: Column) -> DataFrame:
    ring = shapes.rect_along("ex", "ey", hdg, F.col(length), "width_m")
    return ends.filter(F.col(length) > 0.5).select("icao", "idrwy", F.col("ident").alias("idthr"), F.col("surface").alias("surftype"), rnd(length).alias("length"),
                                                   rnd("width_m").alias("width"), source.alias("source"), F.array(ring).alias("geom"))


def build_runwaydisplacedarea(ends: DataFrame) -> DataFrame:
    return _beyond(ends, "shift", F.col("hdg"), F.col("source"))


def build_blastpad(ends: DataFrame) -> DataFrame:
    return _beyond(ends, "blastpad", reverse_heading("hdg"), F.col("source"))


def build_stopway(ends: DataFrame) -> DataFrame:
    return _beyond(ends, "stopway_m", reverse_heading("hdg"), F.lit("faa_nasr"))


def build_paintedcenterline(rw: DataFrame) -> DataFrame:
    return rw.select("icao", "rid", "idrwy", F.lit(0.9).alias("width"), rnd(dist("t0x", "t0y", "t1x", "t1y")).alias("length"), F.lit("derived").alias("source"),
                     shapes.line_geom(("t0x", "t0y"), ("t1x", "t1y")).alias("geom"))


def build_runwayshoulder(rw: DataFrame, width: float = RUNWAY_SHOULDER_M) -> DataFrame:
    """Two strips along the edges where a shoulder surface is given."""
    s = rw.filter(F.col("shoulder_surface").isNotNull()).withColumn("w", F.coalesce("shoulder_width_m", F.lit(width)))
    s = s.withColumn("side", F.explode(F.array(F.lit(-1.0), F.lit(1.0))))
    rx, ry = right_of(*unit("heading"))
    off = F.col("side") * (F.col("width_m") / 2 + F.col("w") / 2)
    ring = shapes.rect_between(F.col("ax") + rx * off, F.col("ay") + ry * off, F.col("bx") + rx * off, F.col("by") + ry * off, "w")
    return s.select("icao", "rid", "idrwy", F.col("shoulder_surface").alias("surftype"), rnd("w").alias("width"), F.lit("derived").alias("source"), F.array(ring).alias("geom"))


def end_lights(ends: DataFrame) -> DataFrame:
    """Approach lights 30 m before the threshold; identifier light pairs outside the edges."""
    ux, uy = unit("hdg")
    base = [c("icao"), c("idrwy"), c("ident").alias("idthr"), rnd("hdg").alias("brngtrue"), c("source")]
    app = ends.filter(F.col("approach") > 0).select(*base, F.lit(APPROACH).alias("lstype"), F.col("approach").alias("alstype"),
                                                    shapes.point_geom(F.col("tx") - ux * 30, F.col("ty") - uy * 30).alias("geom"))
    rx, ry = right_of(ux, uy)
    pair = ends.filter(F.col("reil") > 0).withColumn("side", F.explode(F.array(F.lit(-1.0), F.lit(1.0))))
    off = F.col("side") * (F.col("width_m") / 2 + 12)
    reil = pair.select(*base, F.lit(REIL).alias("lstype"), F.lit(None).cast("int").alias("alstype"), shapes.point_geom(F.col("tx") + rx * off, F.col("ty") + ry * off).alias("geom"))
    return app.unionByName(reil)


def end_pairs(ends: DataFrame) -> DataFrame:
    """Designator -> pair id, first runway wins; and the end itself for lines across it."""
    return ends.groupBy("icao", F.upper("ident").alias("end_key")).agg(F.min_by(F.struct("idrwy", "ident", "ex", "ey", "tx", "ty", "hdg", "width_m", "length"), F.struct("idrwy", "rid", "end_no")).alias("e"))


def build_aerodromesurfacelighting(ends: DataFrame, lights: DataFrame) -> DataFrame:
    """``lights``: icao, x, y, kind, heading, angle, runway, name, source; joined with their runway pair."""
    own = end_lights(ends).withColumn("angle", F.lit(None).cast("double")).withColumn("name", F.lit(None).cast("string"))
    pairs = end_pairs(ends).select("icao", "end_key", F.col("e.idrwy").alias("idrwy"))
    obj = lights.withColumn("end_key", F.upper("runway")).join(pairs, ["icao", "end_key"], "left")
    obj = obj.select("icao", "idrwy", F.col("runway").alias("idthr"), F.col("heading").alias("brngtrue"), "source", F.col("kind").alias("lstype"), F.lit(None).cast("int").alias("alstype"),
                     shapes.point_geom("x", "y").alias("geom"), "angle", "name")
    return own.unionByName(obj)


def across_runway(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows naming a runway end (``runway_end``), joined with that end."""
    return rows.withColumn("end_key", F.upper("runway_end")).join(end_pairs(ends), ["icao", "end_key"]).drop("end_key")


def _across(x, y, h, width) -> Column:
    rx, ry = right_of(*unit(h))
    half = c(width) / 2
    return shapes.line_geom((c(x) - rx * half, c(y) - ry * half), (c(x) + rx * half, c(y) + ry * half))


def build_arrestinggearlocation(arresting: DataFrame, ends: DataFrame) -> DataFrame:
    a = across_runway(arresting, ends)
    ux, uy = unit("e.hdg")
    d = F.coalesce("distance_m", F.lit(0.0))
    line = _across(F.col("e.ex") + ux * d, F.col("e.ey") + uy * d, "e.hdg", "e.width_m")
    return a.select("icao", "e.idrwy", F.col("e.ident").alias("idthr"), F.col("kind").alias("feattype"), F.col("distance_m").alias("distance"), "source", line.alias("geom"))


def build_arrestingsystemlocation(arresting: DataFrame, ends: DataFrame) -> DataFrame:
    """120 m bed beyond the end for EMAS, else a 20 m box across the cable."""
    a = across_runway(arresting, ends)
    ux, uy = unit("e.hdg")
    d = F.coalesce("distance_m", F.lit(0.0)) - 10
    emas = F.upper("kind").contains("EMAS")
    bed = shapes.rect_along("e.ex", "e.ey", reverse_heading("e.hdg"), 120.0, "e.width_m")
    box = shapes.rect_along(F.col("e.ex") + ux * d, F.col("e.ey") + uy * d, "e.hdg", 20.0, F.col("e.width_m") + 10)
    return a.select("icao", "e.idrwy", F.col("e.ident").alias("idthr"), F.col("kind").alias("astype"), F.when(emas, 120.0).otherwise(20.0).alias("aslength"),
                    F.col("e.width_m").alias("aslwidth"), F.lit("derived").alias("source"), F.array(F.when(emas, bed).otherwise(box)).alias("geom"))


def build_landandholdshortoperationlocation(lahso: DataFrame, ends: DataFrame) -> DataFrame:
    a = across_runway(lahso, ends)
    ux, uy = unit("e.hdg")
    d = F.least("available_m", "e.length")
    line = _across(F.col("e.tx") + ux * d, F.col("e.ty") + uy * d, "e.hdg", "e.width_m")
    return a.select("icao", "e.idrwy", F.col("e.ident").alias("idthr"), F.lit(1).alias("lahsotyp"), rnd("available_m").alias("lda"), F.col("crossing").alias("idcross"), "source", line.alias("geom"))


def build_runwaymarking(ends: DataFrame) -> DataFrame:
    from .marking import marking_rows
    e = ends.select("icao", "rid", "idrwy", F.col("ident").alias("idthr"), "marking", F.col("width_m").alias("width"), "tx", "ty", "hdg", rnd("gap", 6).alias("lda"),
                    rnd("shift", 6).alias("displaced"), F.coalesce("blastpad", F.lit(0.0)).alias("blastpad"))
    return marking_rows(e).withColumnRenamed("marking", "rwymktyp").withColumn("source", F.lit("derived"))


def water_runways(rows: DataFrame) -> DataFrame:
    """``rows``: icao, width_m, ident0, ident1, ax, ay, bx, by."""
    idrwy = text.pair_id("ident0", "ident1")
    ring = shapes.rect_between("ax", "ay", "bx", "by", F.greatest("width_m", F.lit(10.0)))
    return rows.filter(dist("ax", "ay", "bx", "by") > 30.0).select(
        "icao", F.lit(2).alias("feattype"), idrwy.alias("idrwy"), F.concat(F.lit("Water runway "), idrwy).alias("name"), F.lit(8).alias("surftype"), F.lit("xplane").alias("source"), F.array(ring).alias("geom"))


def helipad_layers(pads: DataFrame, areas: DataFrame, headers: DataFrame) -> dict[str, DataFrame]:
    """``pads``: icao, hid, ident, x, y, heading, length_m, width_m, surface, source."""
    sized = (F.col("length_m") > 1) & (F.col("width_m") > 1)
    p = pads.withColumn("len", F.when(sized, F.col("length_m")).otherwise(25.0)).withColumn("wid", F.when(sized, F.col("width_m")).otherwise(25.0))
    own = areas.filter("kind = 'helipad'").groupBy("icao", F.col("name").alias("ident")).agg(F.min_by("geom", "aid").alias("_g"))
    p = p.join(own, ["icao", "ident"], "left").join(headers.select("icao", "elev_ft"), "icao", "left")
    fato = F.coalesce("_g", F.array(shapes.rect_centered("x", "y", "heading", "len", "wid")))
    tlof = F.array(shapes.rect_centered("x", "y", "heading", F.col("len") * 0.6, F.col("wid") * 0.6))
    ux, uy = unit("heading")
    thr = shapes.point_geom(F.col("x") - ux * F.col("len") / 2, F.col("y") - uy * F.col("len") / 2)
    return {
        "finalapproachandtakeoffarea": p.select("icao", "ident", F.col("surface").alias("surftype"), F.col("len").alias("length"), F.col("wid").alias("width"), F.col("heading").alias("brngtrue"), "source", fato.alias("geom")),
        "touchdownliftoffarea": p.select("icao", "ident", F.col("surface").alias("surftype"), (F.col("len") * 0.6).alias("length"), (F.col("wid") * 0.6).alias("width"), F.col("heading").alias("brngtrue"), F.lit("derived").alias("source"), tlof.alias("geom")),
        "helipadthreshold": p.select("icao", "ident", F.col("heading").alias("brngtrue"), F.col("elev_ft").alias("elev"), F.lit("derived").alias("source"), thr.alias("geom")),
    }




def helipad_outline(pads: DataFrame, areas: DataFrame) -> DataFrame:
    """First mapped area of the same name as each helipad."""
    first = areas.groupBy("icao", "name").agg(F.min("aid").alias("aid"))
    return pads.join(first, ["icao", "name"], "left")
