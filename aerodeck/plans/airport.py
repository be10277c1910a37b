"""The full layer build: a source model derived from the views, and all 45 layers from it.

``Airport`` holds the source collections in local metres and builds each layer on demand;
intermediate products (runways, pavement, lines, network) are shared lazily.
"""

from __future__ import annotations

import uuid
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, shapes, text
from ..functions.geo import rnd
from ..operators import lines as L
from ..operators import network, pavement, points, runway, structures
from ..operators.ordered import durable, shared_folder
from ..operators.spatial import edges_of
from ..sources import store
from .registry import QUERIES, query
from .scalar import r


class Airport:
    """Source collections of every airport and the layers built from them."""

    def __init__(self, t, keep: bool = True):
        self.t = t
        # Products read by three or more later phases are kept as tables between phases.
        self.save = durable if keep else (lambda df: df)

    # -- sources ----------------------------------------------------------------------------

    @cached_property
    def headers(self) -> DataFrame:
        null = lambda k: F.lit(None).cast(k)
        k = F.col("k")
        return self.t.b_airport.select("icao", "iata", "name", "city", "country", "region", "elev_ft", null("double").alias("mag_var"), null("double").alias("trans_alt_ft"), null("string").alias("trans_level"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"),
                                       (k % 2 == 0).alias("published"), F.lit(True).alias("scenery"))

    def _elements(self, *kinds) -> DataFrame:
        return self.t.b_element.filter(F.col("m").isin(*kinds)).withColumn("x", F.col("x") + 0.37).withColumn("y", F.col("y") + 0.41)

    @cached_property
    def areas(self) -> DataFrame:
        """Mapped areas: squares of 60-159 m (3 km for the aerodrome itself)."""
        kind = (F.when(F.col("m") == 2, "apron").when(F.col("m") == 3, "deicing").when(F.col("m") == 4, "aerodrome").when(F.col("m") == 11, "water").when(F.col("m") == 12, "construction")
                .when(F.col("m") == 20, F.when(F.col("eid") % 2 == 0, "stopway").otherwise("blastpad")).when(F.col("m") == 16, "helipad").when(F.col("m") == 21, "hotspot"))
        size = F.when(F.col("m") == 4, 3000.0).otherwise(60.0 + F.col("eid") % 100)
        e = self._elements(2, 3, 4, 11, 12, 16, 20, 21)
        name = F.when(F.col("m") == 16, F.concat(F.lit("H"), (F.col("eid") % 3).cast("string"))).when(F.col("eid") % 3 > 0, F.concat(F.lit("Area "), F.col("eid").cast("string")))
        return e.select("icao", F.col("eid").alias("aid"), kind.alias("kind"), name.alias("name"), F.when(F.col("eid") % 2 == 0, 4).alias("surface"), F.concat(F.lit("osm:"), F.col("eid").cast("string")).alias("reference"),
                        F.when(F.col("m") == 21, "faa_amdb").otherwise("osm").alias("source"), F.array(shapes.rect_along("x", "y", F.lit(0.0), size, size)).alias("geom"))

    @cached_property
    def buildings(self) -> DataFrame:
        kind = F.when(F.col("m") == 5, 1).when(F.col("m") == 10, 7).when(F.col("m") == 18, 5).otherwise(2)
        ring = shapes.rect_along("x", "y", F.lit(15.0), 20.0 + F.col("eid") % 50, F.lit(30.0))
        return self._elements(5, 10, 18, 23).select("icao", F.col("eid").alias("fid"), kind.alias("kind"), F.concat(F.lit("Terminal "), F.col("eid").cast("string")).alias("name"), F.lit(10.5).alias("height_m"), F.lit(3.0).alias("levels"), F.lit("osm").alias("source"), F.array(ring).alias("geom"))

    @cached_property
    def point_structures(self) -> DataFrame:
        return self._elements(1, 22).select("icao", F.col("eid").alias("fid"), F.when(F.col("m") == 1, 2).otherwise(6).alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(30.0).alias("height_m"), F.lit("osm").alias("source"), "x", "y")

    def _ways(self, *kinds) -> DataFrame:
        """Two-point ways of 120 m heading away from the element position."""
        e = self._elements(*kinds)
        return e.withColumn("geom", shapes.line_geom(("x", "y"), (F.col("x") + 90 + F.col("eid") % 37, F.col("y") + 80 - F.col("eid") % 53)))

    @cached_property
    def line_structures(self) -> DataFrame:
        return self._ways(8, 13).select("icao", F.col("eid").alias("fid"), F.when(F.col("m") == 8, 1).otherwise(3).alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("height_m"), F.lit("osm").alias("source"), "geom")

    @cached_property
    def roads(self) -> DataFrame:
        return self._ways(7, 17).select("icao", F.col("eid").alias("fid"), F.lit(None).cast("string").alias("name"), F.when(F.col("m") == 7, 6.5).alias("width_m"), F.lit(False).alias("bridge"), F.lit("osm").alias("source"), "geom")

    @cached_property
    def taxi_lines(self) -> DataFrame:
        return self._ways(6).select("icao", F.col("eid").alias("fid"), F.concat(F.lit("T"), (F.col("eid") % 10).cast("string")).alias("name"), F.lit(23.0).alias("width_m"), (F.col("eid") % 2 == 0).alias("bridge"), F.lit("osm").alias("source"), "geom")

    @cached_property
    def hold_points(self) -> DataFrame:
        kind = F.when(F.col("eid") % 3 == 0, "ils_hold").when(F.col("eid") % 3 == 1, "intersection_hold").otherwise("runway_hold")
        return self._elements(14).select("icao", F.col("eid").alias("hid"), kind.alias("kind"), F.lit("B1").alias("name"), "x", "y")

    @cached_property
    def helipads(self) -> DataFrame:
        odd = F.col("eid") % 2 == 1
        return self._elements(16).select("icao", F.col("eid").alias("hid"), F.concat(F.lit("H"), (F.col("eid") % 5).cast("string")).alias("ident"), "x", "y", (F.col("eid") % 360).cast("double").alias("heading"), F.when(odd, 30.0).otherwise(0.0).alias("length_m"),
                                         F.when(odd, 20.0).otherwise(0.0).alias("width_m"), F.lit(2).alias("surface"), F.lit("xplane").alias("source"))

    @cached_property
    def signs(self) -> DataFrame:
        raw = F.concat(F.lit("{@"), F.when(F.col("eid") % 2 == 0, "Y").otherwise("R"), F.lit("}A"), (F.col("eid") % 9).cast("string"), F.lit("{^r}"))
        return self._elements(9, 17, 19, 21).select("icao", F.col("eid").alias("sid"), "x", "y", (F.col("eid") % 360 + 0.3).alias("heading"), (F.col("eid") % 6).cast("int").alias("size"), raw.alias("raw"), F.lit("xplane").alias("source"))

    @cached_property
    def boundary(self) -> DataFrame:
        ring = F.array(*[shapes.pt(F.lit(a), F.lit(b)) for a, b in ((-4000.0, -4000.0), (4000.0, -4000.0), (4000.0, 4000.0), (-4000.0, 4000.0), (-4000.0, -4000.0))])
        return self.t.b_airport.filter("k % 2 = 0").select("icao", F.array(ring).alias("geom"))

    @cached_property
    def frequencies(self) -> DataFrame:
        return self.t.b_stand.filter("sid % 10 = 0").select("icao", (118 + F.col("sid") % 18 / 8).alias("mhz"), (F.col("sid") % 7 + 1).cast("int").alias("station"), F.concat(F.lit("F"), F.col("sid").cast("string")).alias("name"))

    @cached_property
    def stands(self) -> DataFrame:
        k = F.col("sid")
        pos = self.t.b_stand.withColumn("x", F.col("x") * 3 + 0.37).withColumn("y", F.col("y") * 3 + 0.41)
        ring = shapes.rect_centered("x", "y", F.lit(0.0), F.lit(30.0), F.lit(30.0))
        osm = F.col("source") == "osm"
        return pos.select("icao", "sid", "x", "y", "source", F.when(k % 7 == 1, "").otherwise(F.concat(F.lit("G"), (k % 40).cast("string"))).alias("name"), F.when(~osm, (k % 360).cast("double")).alias("heading"), F.when(k % 3 == 0, "gate").when(k % 3 == 1, "tie_down").otherwise("misc").alias("kind"),
                          F.when(k % 4 == 0, "C").alias("size_code"), F.when(k % 5 == 0, "airline").alias("operation"), F.when(k % 6 == 0, F.array(F.lit("DAL"), F.lit("AAL"))).otherwise(F.array().cast("array<string>")).alias("airlines"),
                          F.when(~osm, F.array(F.lit("jets"), F.lit("props"))).otherwise(F.array().cast("array<string>")).alias("types"), F.when(osm & (k % 3 == 0), k % 2 == 1).alias("jetway"), F.when(osm & (k % 5 == 0), ring).alias("outline"))

    @cached_property
    def lights(self) -> DataFrame:
        s = self.t.b_strip.filter("rid % 4 = 0")
        return s.select("icao", F.col("rid").alias("line_no"), F.col("ax").alias("x"), F.col("ay").alias("y"), (F.col("rid") % 5).cast("int").alias("kind"), F.lit(90.0).alias("heading"), F.lit(3.0).alias("angle"), F.col("ident0").alias("runway"), F.lit(None).cast("string").alias("name"), F.lit("xplane").alias("source"))

    @cached_property
    def arresting(self) -> DataFrame:
        return self.t.b_strip.filter("rid % 4 = 0").select("icao", F.col("ident0").alias("runway_end"), F.when(F.col("rid") % 8 == 0, "EMAS").otherwise("BAK-12").alias("kind"), F.when(F.col("rid") % 12 == 0, 50.0).alias("distance_m"), F.lit("faa_nasr").alias("source"))

    @cached_property
    def lahso(self) -> DataFrame:
        return self.t.b_strip.filter("rid % 8 = 3").select("icao", F.col("ident1").alias("runway_end"), F.lit(457.2).alias("available_m"), F.lit("09L").alias("crossing"), F.lit("faa_nasr").alias("source"))

    @cached_property
    def zones(self) -> DataFrame:
        return self.t.b_edge.filter("eid % 10 = 1").select("icao", "eid", F.explode(F.array(F.lit("18"), F.concat(F.lit("0"), (F.col("eid") % 9).cast("string")))).alias("runway"))

    @cached_property
    def pavement_source(self) -> DataFrame:
        return self.t.b_pavement.select("icao", "pid", "name", text.pavement_hint("name").alias("hint"), F.col("surface"), "source", F.array(shapes.rect_along("x", "y", "hd", "len", "wid")).alias("geom"))

    @cached_property
    def painted(self) -> DataFrame:
        """Coded runs of the painted lines, stretched over the airport."""
        from ..operators.measure import coded_runs
        v = self.t.b_vertex.select("icao", "fid", "seq", (F.col("x") * 4 + 0.37).alias("x"), (F.col("y") * 4 + 0.41).alias("y"), F.when((F.col("fid") % 11 == 0) & (F.col("line") == 1), 2).when((F.col("fid") % 13 == 0) & (F.col("line") == 1), 22).otherwise(F.col("line")).alias("line"), F.lit(0).alias("light"))
        s = coded_runs(v, ["icao", "fid"])
        return s.select("icao", F.concat_ws("/", F.col("fid").cast("string"), F.col("run").cast("string")).alias("lid"), "seq", "line", "light", F.when(F.col("fid") % 5 == 0, "K9").alias("desc"), F.lit("xplane").alias("source"), "ax", "ay", "bx", "by")

    # -- shared products ----------------------------------------------------------------------

    @cached_property
    def rw(self) -> DataFrame:
        return self.save(runway.runway_geometry(self.t.b_strip))

    @cached_property
    def ends(self) -> DataFrame:
        return runway.runway_ends(self.rw)

    @cached_property
    def overlaps(self) -> DataFrame:
        return runway.runway_overlaps(self.rw)

    @cached_property
    def edges(self) -> DataFrame:
        e = network.edge_positions(self.t.b_edge, self.t.b_node).filter("restriction <> 'runway'").withColumn("wingspan", codes.restriction_wingspan("restriction"))
        return self.save(e.select("icao", "eid", "name", "wingspan", "ax", "ay", "bx", "by"))

    @cached_property
    def mids(self) -> DataFrame:
        return self.edges.select("icao", "eid", "name", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))

    @cached_property
    def taxi_segments(self) -> DataFrame:
        return edges_of(self.taxi_lines, ["icao", "fid", "name", "width_m", "bridge"])

    @cached_property
    def pieces(self) -> DataFrame:
        return self.save(pavement.pavement_pieces(self.pavement_source, self.areas, self.taxi_segments, self.stands, self.mids, self.rw, 10.0))

    @cached_property
    def movement(self) -> DataFrame:
        p = self.pieces.filter(F.col("class").isin("taxiway", "apron")).select("icao", "geom")
        return self.save(p.unionByName(self.stand_layers["parkingstandarea"].select("icao", "geom")))

    @cached_property
    def extent(self) -> DataFrame:
        outlines = self.areas.filter("kind = 'aerodrome'").select("icao", "geom").unionByName(self.boundary.select("icao", "geom"))
        paved = self.pieces.filter(F.col("class").isin("taxiway", "apron")).select("icao", "geom").unionByName(self.rw.select("icao", "geom"))
        return self.save(structures.extent(self.headers, outlines, paved, self.stands))

    @cached_property
    def near(self) -> DataFrame:
        """What structures are clipped to: 50 m round the movement area, 90 m round runways, else the extent."""
        own = self.movement.withColumn("margin", F.lit(structures.NEAR_MOVEMENT_M)).unionByName(self.rw.select("icao", "geom").withColumn("margin", F.lit(structures.NEAR_RUNWAY_M)))
        return own.unionByName(self.extent.select("icao", "geom", "margin").join(own.select("icao").distinct(), "icao", "left_anti"))

    @cached_property
    def beside_runways(self) -> DataFrame:
        """Runways and the surfaces along and behind them."""
        parts = [self.rw, runway.build_runwayshoulder(self.rw), self.layer("blastpad"), self.layer("stopway"), runway.build_runwaydisplacedarea(self.ends)]
        return union_geoms(parts)

    def captured(self, df: DataFrame, kind: str = "feature") -> DataFrame:
        return structures.capture(df, ["fid"], self.movement, self.rw.select("icao", "geom"), self.extent, kind)

    @cached_property
    def area_ids(self) -> DataFrame:
        return self.save(self.captured(self.areas.select("icao", F.col("aid").alias("fid"), "geom")))

    @cached_property
    def stand_layers(self) -> dict[str, DataFrame]:
        built = structures.stand_layers(self.stands, pavement.build_apronelement(self.pieces))
        return {n: self.save(df) for n, df in built.items()}

    @cached_property
    def line_layers(self) -> dict[str, DataFrame]:
        loc = self.stand_layers["parkingstandlocation"].select("icao", "idstd", F.col("geom")[0][0].x.alias("x"), F.col("geom")[0][0].y.alias("y"))
        center = self.taxi_segments.select("icao", F.concat(F.lit("o"), F.col("fid").cast("string")).alias("lid"), "seq", F.col("name").alias("desc"), "ax", "ay", "bx", "by")
        return L.build_lines(self.save(self.painted), self.edges, self.rw, loc, center, self.hold_points)

    @cached_property
    def network(self) -> tuple[DataFrame, DataFrame]:
        n, e = network.network_from_routes(self.t.b_edge, self.t.b_node, self.zones)
        return network.emit_network(*network.attach_stands(n, e, self.attach_points()))

    def attach_points(self) -> DataFrame:
        """Where each stand joins the network: the far end of its longest lead-in, else itself."""
        g = F.col("geom")[0]
        lead = self.line_layers["standguidanceline"].select("icao", "idstd", shapes.line_length(g).alias("l"), g[0].alias("a"), F.element_at(g, -1).alias("z"))
        lead = lead.groupBy("icao", "idstd").agg(F.max_by(F.struct("a", "z"), "l").alias("e"))
        s = self.stand_layers["parkingstandlocation"].select("icao", "idstd", "wingspan", F.col("geom")[0][0].x.alias("x"), F.col("geom")[0][0].y.alias("y")).join(lead, ["icao", "idstd"], "left")
        d = lambda p: (F.col(f"e.{p}.x") - F.col("x")) * (F.col(f"e.{p}.x") - F.col("x")) + (F.col(f"e.{p}.y") - F.col("y")) * (F.col(f"e.{p}.y") - F.col("y"))
        far = F.when(d("a") < d("z"), F.col("e.z")).otherwise(F.col("e.a"))
        return s.select("icao", "idstd", "wingspan", "x", "y", F.coalesce(far.x, "x").alias("px"), F.coalesce(far.y, "y").alias("py"))

    # -- layers -------------------------------------------------------------------------------

    def overrides_only(self, layer: str) -> DataFrame:
        """Layers without a source of their own hold what overrides supply."""
        ov = self._elements(3 if layer == "atcblindspot" else 15)
        geom = F.array(shapes.rect_along("x", "y", F.lit(0.0), F.lit(50.0), F.lit(50.0))) if layer == "atcblindspot" else shapes.point_geom("x", "y")
        return ov.select("icao", F.col("eid").alias("fid"), F.concat_ws(":", "icao", F.lit(layer), F.lit("ov"), F.col("eid").cast("string")).alias("id"), F.lit("override").alias("source"), geom.alias("geom"))

    def layer(self, name: str) -> DataFrame:
        rw, ends = self.rw, self.ends
        pads = lambda kind: structures.mapped_pads(self.areas, self.area_ids, kind)
        heli = lambda n: runway.helipad_layers(self.helipads, self.areas, self.headers)[n]
        paved = lambda: self.pieces.filter(F.col("class").isin("taxiway", "apron")).select("icao", "geom")
        water = lambda: runway.water_runways(self.t.b_strip.filter("rid % 9 = 0").select("icao", "width_m", "ident0", "ident1", "ax", "ay", "bx", "by"))
        build = {
            "aerodromereferencepoint": lambda: structures.build_aerodromereferencepoint(self.headers),
            "aerodromesign": lambda: points.build_aerodromesign(self.signs),
            "aerodromesurfacelighting": lambda: runway.build_aerodromesurfacelighting(ends, self.lights),
            "apronelement": lambda: pavement.build_apronelement(self.pieces),
            "arrestinggearlocation": lambda: runway.build_arrestinggearlocation(self.arresting, ends),
            "arrestingsystemlocation": lambda: runway.build_arrestingsystemlocation(self.arresting, ends),
            "asrnedge": lambda: self.network[1], "asrnnode": lambda: self.network[0],
            "blastpad": lambda: runway.build_blastpad(ends).unionByName(pads("blastpad")),
            "bridgeside": lambda: structures.build_bridgeside(self.taxi_vertices()),
            "constructionarea": lambda: structures.build_constructionarea(self.areas, self.area_ids, paved()),
            "deicingarea": lambda: structures.deicing_layers(self.areas, self.area_ids)["deicingarea"],
            "deicinggroup": lambda: structures.deicing_layers(self.areas, self.area_ids)["deicinggroup"],
            "finalapproachandtakeoffarea": lambda: heli("finalapproachandtakeoffarea").unionByName(pavement.pavement_helipads(self.pieces)),
            "frequencyarea": lambda: structures.build_frequencyarea(self.frequencies, self.boundary, self.extent),
            "helipadthreshold": lambda: heli("helipadthreshold"),
            "hotspot": lambda: structures.build_hotspot(self.areas, self.area_ids),
            "landandholdshortoperationlocation": lambda: runway.build_landandholdshortoperationlocation(self.lahso, ends),
            "paintedcenterline": lambda: runway.build_paintedcenterline(rw),
            "parkingstandarea": lambda: self.stand_layers["parkingstandarea"].drop("jetway"),
            "parkingstandlocation": lambda: self.stand_layers["parkingstandlocation"],
            "runwaycenterlinepoint": lambda: runway.build_runwaycenterlinepoint(ends, self.overlaps),
            "runwaydisplacedarea": lambda: runway.build_runwaydisplacedarea(ends),
            "runwayelement": lambda: runway.build_runwayelement(rw, self.overlaps),
            "runwayintersection": lambda: runway.build_runwayintersection(self.overlaps),
            "runwaymarking": lambda: runway.build_runwaymarking(ends),
            "runwayshoulder": lambda: runway.build_runwayshoulder(rw),
            "runwaythreshold": lambda: runway.build_runwaythreshold(ends, self.lights, self.headers),
            "serviceroad": lambda: structures.build_serviceroad(self.roads, self.captured(self.roads), structures.spans_within(self.near, 1.0), paved().unionByName(rw.select("icao", "geom")), self.line_layers["_road_centers"], pavement.pavement_roads(self.pieces)),
            "stopway": lambda: runway.build_stopway(ends).unionByName(pads("stopway")),
            "taxiwayelement": lambda: pavement.build_taxiwayelement(self.pieces, self.mids, rw),
            "taxiwayshoulder": lambda: pavement.build_taxiwayshoulder(self.pieces, self.beside_runways, self.mids),
            "touchdownliftoffarea": lambda: heli("touchdownliftoffarea"),
            "verticallinestructure": lambda: structures.build_verticallinestructure(self.line_structures, self.captured(self.line_structures)),
            "verticalpointstructure": lambda: structures.build_verticalpointstructure(self.point_structures, self.captured(self.point_structures, "point")),
            "verticalpolygonalstructure": lambda: structures.build_verticalpolygonalstructure(self.buildings, self.captured(self.buildings), structures.in_extent(self.buildings, ["fid"], self.extent)),
            "water": lambda: structures.build_water(self.areas, self.area_ids, self.extent, water()),
        }
        for n in ("runwayexitline", "standguidanceline", "taxiwayguidanceline", "taxiwayholdingposition", "taxiwayintersectionmarking"):
            build[n] = lambda n=n: self.line_layers[n]
        for n in ("atcblindspot", "positionmarking", "surveycontrolpoint"):
            build[n] = lambda n=n: self.overrides_only(n)
        return build[name]()

    def taxi_vertices(self) -> DataFrame:
        return self.taxi_lines.select("icao", "fid", "name", "width_m", "bridge", "source", F.posexplode(F.col("geom")[0]).alias("seq", "p")).select("icao", "fid", "name", "width_m", "bridge", "source", "seq", "p.x", "p.y")


def union_geoms(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("icao", "geom") for p in parts])


_BUILDS: dict[tuple[str, str], Airport] = {}


def airport(t) -> Airport:
    """The build over one input folder; its phase tables serve every layer of a session."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _BUILDS:
        _BUILDS[key] = Airport(t)
    return _BUILDS[key]


def surface(df: DataFrame, *cols) -> DataFrame:
    """Rows of a surface layer with its area and centroid instead of the rings."""
    m = shapes.ring_centroid(F.col("geom")[0])
    out = df.withColumn("_m", m)
    return out.select("icao", *cols, rnd(shapes.geom_area("geom"), 2).alias("area"), rnd("_m.x", 3).alias("cx"), rnd("_m.y", 3).alias("cy"))


def place(df: DataFrame, *cols) -> DataFrame:
    return df.select("icao", *cols, rnd(F.col("geom")[0][0].x, 3).alias("x"), rnd(F.col("geom")[0][0].y, 3).alias("y"))


def curve(df: DataFrame, *cols) -> DataFrame:
    g = F.col("geom")[0]
    return df.select("icao", *cols, rnd(shapes.line_length(g), 3).alias("len"), rnd(g[0].x, 3).alias("sx"), rnd(g[0].y, 3).alias("sy"))


RW = """rk0 AS (SELECT * FROM b_strip s WHERE width_m >= 1 AND (source = 'xplane' OR NOT EXISTS (SELECT 1 FROM b_strip b WHERE b.icao = s.icao AND b.source = 'xplane'))),
rk AS (SELECT *, ident0 || '/' || ident1 AS idrwy, sin(radians(hd)) AS sh, cos(radians(hd)) AS ch, least(displaced0, len/2) AS d0, least(displaced1, len/2) AS d1, len - least(displaced0, len/2) - least(displaced1, len/2) AS gap FROM rk0),
en AS (SELECT icao, rid, 0 AS end_no, source, width_m, surface, idrwy, ident0 AS ident, hd AS hdg, x0 AS ex, y0 AS ey, x0 + sh*d0 AS tx, y0 + ch*d0 AS ty, sh AS ux, ch AS uy, d0 AS shift, blastpad0 AS blastpad, marking0 AS marking, approach0 AS approach, tdz0 AS tdz, reil0 AS reil, stopway0 AS stopway, tora0 AS tora, toda0 AS toda, asda0 AS asda, lda0 AS lda, tdze0 AS tdze, len, gap FROM rk
 UNION ALL SELECT icao, rid, 1, source, width_m, surface, idrwy, ident1, (hd + 180) % 360, x1, y1, x1 - sh*d1, y1 - ch*d1, -sh, -ch, d1, blastpad1, marking1, approach1, tdz1, reil1, stopway1, NULL, NULL, NULL, NULL, NULL, len, gap FROM rk)"""
PAIR = "ep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY icao, ident ORDER BY idrwy, rid, end_no) AS rn FROM en) q WHERE rn = 1)"


def rect(length, back="", w="width_m"):
    """Area and centroid of a rectangle from a runway end (back = '-' outward)."""
    s = "-" if back else "+"
    return f"{r(f'{length}*{w}', 2)} AS area, {r(f'ex {s} ux*{length}/2')} AS cx, {r(f'ey {s} uy*{length}/2')} AS cy"


def layer(name):
    return lambda t: airport(t).layer(name)


@query("L02_aerodromereferencepoint", "SELECT icao, iata, name, city, country, region, elev_ft AS elev, lat, lon, CASE WHEN k % 2 = 0 THEN 'xplane' ELSE 'derived' END AS source FROM b_airport")
def l02(t):
    return airport(t).layer("aerodromereferencepoint").select("icao", "iata", "name", "city", "country", "region", "elev", "lat", "lon", "source")


@query("L03_aerodromesign", f"""SELECT icao, CASE WHEN eid % 6 >= 4 THEN 4 WHEN eid % 2 = 0 THEN 2 ELSE 1 END AS signtype, 'A' || eid % 9 || '→' AS msgfront, {r('eid % 360 + 0.3', 1)} AS signdir, CASE eid % 6 WHEN 1 THEN 0.6 WHEN 2 THEN 0.8 WHEN 3 THEN 1.2 WHEN 4 THEN 1.2 ELSE 0.8 END::double AS height, {r('x + 0.37')} AS x, {r('y + 0.41')} AS y FROM b_element WHERE m IN (9, 17, 19, 21)""")
def l03(t):
    return place(airport(t).layer("aerodromesign"), "signtype", "msgfront", "signdir", "height")


@query("L04_aerodromesurfacelighting", f"""WITH {RW}, {PAIR} SELECT icao, 8 AS lstype, idrwy, ident AS idthr, {r('tx - ux*30')} AS x, {r('ty - uy*30')} AS y FROM en WHERE approach > 0 UNION ALL SELECT icao, 7, idrwy, ident, {r('tx + s*uy*(width_m/2 + 12)')}, {r('ty - s*ux*(width_m/2 + 12)')} FROM en, unnest([-1, 1]) u(s) WHERE reil > 0
 UNION ALL SELECT s.icao, rid0, p.idrwy, s.ident0, {r('s.x0')}, {r('s.y0')} FROM (SELECT *, cast(rid % 5 AS int) AS rid0 FROM b_strip WHERE rid % 4 = 0) s LEFT JOIN ep p ON p.icao = s.icao AND p.ident = s.ident0""")
def l04(t):
    return place(airport(t).layer("aerodromesurfacelighting"), "lstype", "idrwy", "idthr")


@query("L05_apronelement")
def l05(t):
    return surface(airport(t).layer("apronelement"), "idapron", "surftype", "feattype", "source")


ACROSS = f"{RW}, {PAIR}, ar AS (SELECT p.*, CASE WHEN s.rid % 8 = 0 THEN 'EMAS' ELSE 'BAK-12' END AS kind, CASE WHEN s.rid % 12 = 0 THEN 50.0 END AS dist FROM b_strip s JOIN ep p ON p.icao = s.icao AND p.ident = s.ident0 WHERE s.rid % 4 = 0)"


@query("L06_arrestinggearlocation", f"""WITH {ACROSS} SELECT icao, idrwy, ident AS idthr, kind AS feattype, {r('width_m')} AS len, {r('ex + ux*coalesce(dist, 0) - uy*width_m/2')} AS sx, {r('ey + uy*coalesce(dist, 0) + ux*width_m/2')} AS sy FROM ar""")
def l06(t):
    return curve(airport(t).layer("arrestinggearlocation"), "idrwy", "idthr", "feattype")


@query("L07_arrestingsystemlocation", f"""WITH {ACROSS} SELECT icao, idrwy, ident AS idthr, kind AS astype, CASE WHEN kind = 'EMAS' THEN 120.0 ELSE 20.0 END::double AS aslength, {r("CASE WHEN kind = 'EMAS' THEN 120*width_m ELSE 20*(width_m+10) END", 2)} AS area,
 {r("ex + ux*CASE WHEN kind = 'EMAS' THEN -60 ELSE coalesce(dist, 0) END")} AS cx, {r("ey + uy*CASE WHEN kind = 'EMAS' THEN -60 ELSE coalesce(dist, 0) END")} AS cy FROM ar""")
def l07(t):
    return surface(airport(t).layer("arrestingsystemlocation"), "idrwy", "idthr", "astype", "aslength")


@query("L08_asrnedge")
def l08(t):
    return airport(t).layer("asrnedge").select("icao", "edgeid", "stnode", "ennode", "edgetype", "direc", "idlin", "idrwy", "idstd", "wingspan", "edgelen", "actzone", "source")


@query("L09_asrnnode")
def l09(t):
    return airport(t).layer("asrnnode").select("icao", "nodeid", "nodetype", "name", "idrwy", "idstd", "source", rnd("x", 3).alias("x"), rnd("y", 3).alias("y"))


@query("L10_blastpad", f"""WITH {RW} SELECT icao, idrwy, ident AS idthr, blastpad AS length, {rect('blastpad', '-')} FROM en WHERE blastpad > 0.5""")
def l10(t):
    return surface(runway.build_blastpad(airport(t).ends), "idrwy", "idthr", "length")


@query("L10_blastpad_mapped")
def l10b(t):
    return surface(airport(t).layer("blastpad"), "idrwy", "idthr", "length", "source")


@query("L11_bridgeside", f"""WITH w AS (SELECT icao, eid, x + 0.37::double AS x, y + 0.41::double AS y, cast(90 + eid % 37 AS double) AS dx, cast(80 - eid % 53 AS double) AS dy FROM b_element WHERE m = 6 AND eid % 2 = 0)
SELECT icao, eid AS fid, cast(side AS int) AS side, 'T' || eid % 10 AS idlin, {r('sqrt(dx*dx + dy*dy)')} AS len, {r('x + CASE side WHEN 1 THEN -14.5 ELSE 14.5 END*dy/sqrt(dx*dx + dy*dy)')} AS sx, {r('y - CASE side WHEN 1 THEN -14.5 ELSE 14.5 END*dx/sqrt(dx*dx + dy*dy)')} AS sy FROM w, unnest([1, 2]) u(side)""")
def l11(t):
    return curve(airport(t).layer("bridgeside"), "fid", "side", "idlin")


@query("L12_constructionarea")
def l12(t):
    return surface(airport(t).layer("constructionarea"), "name", "status")


@query("L13_deicingarea")
def l13(t):
    return surface(airport(t).layer("deicingarea"), "aid", "idapron", "deicegrp")


@query("L14_deicinggroup")
def l14(t):
    return surface(airport(t).layer("deicinggroup"), "deicegrp", "members")


HELI = """h AS (SELECT icao, eid, 'H' || eid % 5 AS ident, x + 0.37::double AS x, y + 0.41::double AS y, cast(eid % 360 AS double) AS hdg, CASE WHEN eid % 2 = 1 THEN 30.0 ELSE 25.0 END::double AS len, CASE WHEN eid % 2 = 1 THEN 20.0 ELSE 25.0 END::double AS wid FROM b_element WHERE m = 16),
ha AS (SELECT icao, 'H' || eid % 3 AS ident, min(eid) AS aid FROM b_element WHERE m = 16 GROUP BY 1, 2)"""


@query("L15_finalapproachandtakeoffarea", f"""WITH {HELI} SELECT h.icao, h.ident, h.len AS length, {r('CASE WHEN aid IS NULL THEN len*wid ELSE (60 + aid % 100)*(60 + aid % 100) END', 2)} AS area FROM h LEFT JOIN ha ON ha.icao = h.icao AND ha.ident = h.ident""")
def l15(t):
    a = airport(t)
    f = runway.helipad_layers(a.helipads, a.areas, a.headers)["finalapproachandtakeoffarea"]
    return surface(f, "ident", "length").drop("cx", "cy")


@query("L15_pavement_helipads")
def l15b(t):
    return surface(airport(t).layer("finalapproachandtakeoffarea"), "ident", "surftype", "source")


@query("L16_frequencyarea", f"""SELECT s.icao, {r('118 + (sid % 18)/8', 3)} AS frq, cast(sid % 7 + 1 AS int) AS station, 'F' || sid AS name, 64000000.0::double AS area FROM b_stand s JOIN b_airport a ON a.icao = s.icao AND k % 2 = 0 WHERE sid % 10 = 0""")
def l16(t):
    a = airport(t)
    mine = a.boundary.select("icao")
    f = structures.build_frequencyarea(a.frequencies.join(mine, "icao", "left_semi"), a.boundary, a.boundary)
    return surface(f, "frq", "station", "name").drop("cx", "cy")


@query("L16_frequencyarea_extent")
def l16b(t):
    return surface(airport(t).layer("frequencyarea"), "frq", "station", "name")


@query("L17_helipadthreshold", f"""WITH {HELI} SELECT h.icao, ident, hdg AS brngtrue, elev_ft AS elev, {r('x - sin(radians(hdg))*len/2')} AS x, {r('y - cos(radians(hdg))*len/2')} AS y FROM h JOIN b_airport a ON a.icao = h.icao""")
def l17(t):
    return place(airport(t).layer("helipadthreshold"), "ident", "brngtrue", "elev")


@query("L18_hotspot")
def l18(t):
    return surface(airport(t).layer("hotspot"), "idhot", "name", "description")


@query("L19_landandholdshortoperationlocation", f"""WITH {RW}, {PAIR}, lh AS (SELECT p.* FROM b_strip s JOIN ep p ON p.icao = s.icao AND p.ident = s.ident1 WHERE s.rid % 8 = 3) SELECT icao, idrwy, ident AS idthr, 457.2::double AS lda, '09L' AS idcross, {r('width_m')} AS len, {r('tx + ux*least(457.2, len) - uy*width_m/2')} AS sx, {r('ty + uy*least(457.2, len) + ux*width_m/2')} AS sy FROM lh""")
def l19(t):
    return curve(airport(t).layer("landandholdshortoperationlocation"), "idrwy", "idthr", "lda", "idcross")


@query("L20_paintedcenterline", f"""WITH {RW} SELECT icao, rid, idrwy, {r('gap', 1)} AS length, {r('gap')} AS len, {r('x0 + sh*d0')} AS sx, {r('y0 + ch*d0')} AS sy FROM rk""")
def l20(t):
    return curve(airport(t).layer("paintedcenterline"), "rid", "idrwy", "length")


@query("L21_parkingstandarea")
def l21(t):
    return surface(airport(t).layer("parkingstandarea"), "sid", "idstd", "idapron", "wingspan", "source")


@query("L22_parkingstandlocation")
def l22(t):
    return place(airport(t).layer("parkingstandlocation"), "sid", "idstd", "idapron", "brngtrue", "wingspan", "acft", "jetway", "restacft", "airlines", "pmtyp", "source")


@query("L24_runwaycenterlinepoint", f"""WITH {RW} SELECT icao, idrwy, ident AS idthr, 3 AS feattype, {r('ex')} AS x, {r('ey')} AS y FROM en UNION ALL SELECT icao, idrwy, ident, CASE WHEN shift > 0.5 THEN 2 ELSE 1 END, {r('tx')}, {r('ty')} FROM en""")
def l24(t):
    return place(airport(t).layer("runwaycenterlinepoint").filter("feattype <> 4"), "idrwy", "idthr", "feattype")


@query("L25_runwaydisplacedarea", f"""WITH {RW} SELECT icao, idrwy, ident AS idthr, {r('shift', 1)} AS length, {rect('shift')} FROM en WHERE shift > 0.5""")
def l25(t):
    return surface(airport(t).layer("runwaydisplacedarea"), "idrwy", "idthr", "length")


# An element's area is its rectangle less its overlaps (no two overlaps of one runway meet here).
from .spatial import overlap_sql  # noqa: E402


@query("L26_runwayelement", f"""WITH {RW}, z AS (SELECT icao, rid, idrwy, x0 AS x, y0 AS y, hd, len, width_m AS wid FROM rk), sp AS (SELECT z1.icao, z1.rid AS l_rid, z2.rid AS r_rid, z1.icao || '-' || z1.rid || '-' || z2.rid AS pid, z1 AS a, z2 AS b FROM z z1 JOIN z z2 ON z2.icao = z1.icao AND (z1.idrwy, z1.rid) < (z2.idrwy, z2.rid)), @OV@,
w AS (SELECT icao, l_rid, r_rid, area FROM sp JOIN ov USING (pid) WHERE area > 1), c AS (SELECT icao, rid, sum(area) AS area FROM (SELECT icao, l_rid AS rid, area FROM w UNION ALL SELECT icao, r_rid, area FROM w) q GROUP BY 1, 2)
SELECT z.icao, z.rid, z.idrwy, {r('z.len*z.wid - coalesce(c.area, 0)', 1)} AS area FROM z LEFT JOIN c ON c.icao = z.icao AND c.rid = z.rid""".replace("@OV@", overlap_sql("sp")))
def l26(t):
    e = airport(t).layer("runwayelement")
    return e.groupBy("icao", "rid", "idrwy").agg(rnd(F.sum(shapes.geom_area("geom")), 1).alias("area"))


@query("L27_runwayexitline")
def l27(t):
    return curve(airport(t).layer("runwayexitline"), "lid", "part", "idlin", "idrwy", "exittype", "lighting", "source")


@query("L28_runwayintersection")
def l28(t):
    return surface(airport(t).layer("runwayintersection"), "idrwi", "surftype")


MARKS = f"""WITH {RW}, e AS (SELECT *, gap/2 AS half, CASE WHEN marking >= 3 THEN 69 ELSE 33 END AS first, CASE WHEN gap < 800 THEN 150 WHEN gap < 1200 THEN 250 WHEN gap < 2400 THEN 300 ELSE 400 END AS ad, CASE WHEN gap < 1200 THEN 30 WHEN gap < 2400 THEN 45 ELSE 60 END AS al,
 CASE WHEN gap < 900 THEN [1,0,0,0,0,0] WHEN gap < 1200 THEN [2,1,0,0,0,0] WHEN gap < 1500 THEN [3,2,1,0,0,0] WHEN gap < 2400 THEN [3,2,2,1,0,0] ELSE [3,3,2,2,1,1] END AS bars FROM en WHERE marking > 1),
m AS (SELECT icao, rid, ident, 1 AS marktype, CASE WHEN width_m < 20 THEN 4 WHEN width_m < 26 THEN 6 WHEN width_m < 40 THEN 8 WHEN width_m < 55 THEN 12 ELSE 16 END AS n FROM e WHERE marking >= 3 UNION ALL SELECT icao, rid, ident, 2, 1 FROM e UNION ALL SELECT icao, rid, ident, 3, greatest(floor((half - 30 - first)/50) + 1, 0) FROM e
 UNION ALL SELECT icao, rid, ident, 4, 2 FROM e WHERE marking >= 3 AND ad + al < half UNION ALL SELECT icao, rid, ident, 5, sum(2*bar) FROM (SELECT icao, rid, ident, ad, half, unnest(bars) AS bar, 150*unnest([1,2,3,4,5,6]) AS d FROM e WHERE marking >= 4) q WHERE bar > 0 AND abs(d - ad) >= 1 AND d + 22.5 <= half GROUP BY 1, 2, 3
 UNION ALL SELECT icao, rid, ident, 6, 2 FROM e WHERE marking >= 4 UNION ALL SELECT icao, rid, ident, 7, ceil((shift - 25)/30) FROM e WHERE shift > 30 UNION ALL SELECT icao, rid, ident, 8, 2*ceil((blastpad - 25)/30) FROM e WHERE blastpad > 20)
SELECT icao, rid, ident AS idthr, marktype, cast(n AS bigint) AS n FROM m WHERE n > 0"""


@query("L29_runwaymarking", MARKS)
def l29(t):
    return airport(t).layer("runwaymarking").groupBy("icao", "rid", "idthr", "marktype").agg(F.count(F.lit(1)).alias("n"))


@query("M01_marking_shapes", f"""WITH {RW} SELECT icao, rid, ident AS idthr, {r("gap/2*0.9", 2)} AS area, {r("tx + ux*gap/4 + s*uy*(width_m/2 - 0.45)")} AS cx, {r("ty + uy*gap/4 - s*ux*(width_m/2 - 0.45)")} AS cy FROM en, unnest([-1, 1]) u(s) WHERE marking >= 4""")
def m01(t):
    return surface(airport(t).layer("runwaymarking").filter("marktype = 6"), "rid", "idthr")


@query("L30_runwayshoulder", f"""WITH {RW}, s AS (SELECT *, coalesce(shoulder_width_m, 7.5) AS w FROM rk WHERE shoulder_surface IS NOT NULL) SELECT icao, rid, idrwy, {r('w', 1)} AS width, {r('len*w', 2)} AS area, {r('(x0+x1)/2 + k*ch*(width_m/2 + w/2)')} AS cx, {r('(y0+y1)/2 - k*sh*(width_m/2 + w/2)')} AS cy FROM s, unnest([-1, 1]) u(k)""")
def l30(t):
    return surface(airport(t).layer("runwayshoulder"), "rid", "idrwy", "width")


@query("L31_runwaythreshold", f"""WITH {RW}, l AS (SELECT icao, ident0 AS k, arg_min(rid % 5, rid) AS kind FROM b_strip WHERE rid % 4 = 0 AND rid % 5 IN (1, 2, 3) GROUP BY 1, 2)
SELECT en.icao, rid, ident AS idthr, idrwy, CASE WHEN shift > 0.5 THEN 2 ELSE 1 END AS thrtype, {r('hdg', 1)} AS brngtrue, {r('coalesce(tora, len)', 1)} AS tora, {r('coalesce(toda, len)', 1)} AS toda, {r('coalesce(asda, len + stopway)', 1)} AS asda, {r('coalesce(lda, gap)', 1)} AS lda, coalesce(tdze, elev_ft) AS tdze, marking AS rwymktyp, approach AS tohlight, tdz AS tdzlight, reil,
 cast(l.kind AS int) AS vasis, {r('tx')} AS x, {r('ty')} AS y FROM en JOIN b_airport a ON a.icao = en.icao LEFT JOIN l ON l.icao = en.icao AND l.k = ident""")
def l31(t):
    return place(airport(t).layer("runwaythreshold"), "rid", "idthr", "idrwy", "thrtype", "brngtrue", "tora", "toda", "asda", "lda", "tdze", "rwymktyp", "tohlight", "tdzlight", "reil", "vasis")


@query("P38_end_geometry", f"""WITH {RW} SELECT icao, rid, end_no, {r('shift')} AS shift, {r('hdg')} AS hdg, {r('tx')} AS tx, {r('ty')} AS ty, {r('gap')} AS gap FROM en""")
def p38(t):
    return airport(t).ends.select("icao", "rid", "end_no", rnd("shift", 3).alias("shift"), rnd("hdg", 3).alias("hdg"), rnd("tx", 3).alias("tx"), rnd("ty", 3).alias("ty"), rnd("gap", 3).alias("gap"))


@query("P39_declared_distances", f"""WITH {RW} SELECT icao, rid, ident AS idthr, {r('coalesce(tora, len)', 1)} AS tora, {r('coalesce(toda, len)', 1)} AS toda, {r('coalesce(asda, len + stopway)', 1)} AS asda, {r('coalesce(lda, gap)', 1)} AS lda FROM en""")
def p39(t):
    a = airport(t)
    return a.layer("runwaythreshold").select("icao", "rid", "idthr", "tora", "toda", "asda", "lda")


@query("L32_serviceroad")
def l32(t):
    return surface(airport(t).layer("serviceroad"), "name", "surftype", "width", "bridge", "source")


@query("L33_standguidanceline")
def l33(t):
    return curve(airport(t).layer("standguidanceline"), "lid", "part", "idstd", "source")


@query("L34_stopway", f"""WITH {RW} SELECT icao, idrwy, ident AS idthr, stopway AS length, 'faa_nasr' AS source, {rect('stopway', '-')} FROM en WHERE stopway > 0.5""")
def l34(t):
    return surface(runway.build_stopway(airport(t).ends), "idrwy", "idthr", "length", "source")


@query("L34_stopway_mapped")
def l34b(t):
    return surface(airport(t).layer("stopway"), "idrwy", "idthr", "length", "source")


for _n, _i in (("atcblindspot", "L01"), ("positionmarking", "L23"), ("surveycontrolpoint", "L35")):
    query(f"{_i}_{_n}", f"SELECT icao, eid AS fid, icao || ':{_n}:ov:' || eid AS id, 'override' AS source FROM b_element WHERE m = {3 if _n == 'atcblindspot' else 15}")(
        lambda t, n=_n: airport(t).layer(n).select("icao", "fid", "id", "source"))


@query("L36_taxiwayelement")
def l36(t):
    return surface(airport(t).layer("taxiwayelement"), "fid", "idlin", "surftype", "feattype", "bridge", "source")


@query("L37_taxiwayguidanceline")
def l37(t):
    return curve(airport(t).layer("taxiwayguidanceline"), "lid", "part", "idlin", "style", "lighting", "ilscrit", "wingspan", "length", "source")


@query("L38_taxiwayholdingposition")
def l38(t):
    return curve(airport(t).layer("taxiwayholdingposition"), "idlin", "idrwy", "catstop", "lighting", "source")


@query("L39_taxiwayintersectionmarking")
def l39(t):
    return curve(airport(t).layer("taxiwayintersectionmarking"), "idlin", "source")


@query("L40_taxiwayshoulder")
def l40(t):
    return surface(airport(t).layer("taxiwayshoulder"), "idlin", "surftype", "width", "source")


@query("L41_touchdownliftoffarea", f"""WITH {HELI} SELECT icao, ident, {r('len*0.6', 2)} AS length, {r('len*0.6*wid*0.6', 2)} AS area, {r('x')} AS cx, {r('y')} AS cy FROM h""")
def l41(t):
    return surface(airport(t).layer("touchdownliftoffarea").withColumn("length", rnd("length", 2)), "ident", "length")


@query("L42_verticallinestructure")
def l42(t):
    return curve(airport(t).layer("verticallinestructure"), "fid", "linsttyp")


@query("L43_verticalpointstructure")
def l43(t):
    return place(airport(t).layer("verticalpointstructure"), "fid", "pntsttyp", "height")


@query("L44_verticalpolygonalstructure")
def l44(t):
    return surface(airport(t).layer("verticalpolygonalstructure"), "fid", "plysttyp", "name", "height", "levels")


@query("L45_water")
def l45(t):
    return surface(airport(t).layer("water"), "feattype", "idrwy", "name", "source")


@query("M04_airport_extent")
def m04(t):
    return surface(airport(t).extent, "margin")


STORED = ["paintedcenterline", "runwaydisplacedarea", "positionmarking", "atcblindspot"]


def stored_build(t) -> str:
    """The folder of a fresh build of some layers of all airports, on the storage the cluster shares."""
    root = f"{shared_folder(t.spark)}/layers-{uuid.uuid4().hex}"
    a = airport(t)
    store.write_layers({n: a.layer(n) for n in STORED}, root, a.headers)
    return root


@query("K01_layer_store", f"""WITH {RW}, n AS (SELECT icao, 'paintedcenterline' AS layer, count(*) AS c FROM rk GROUP BY 1 UNION ALL SELECT icao, 'runwaydisplacedarea', count(*) FROM en WHERE shift > 0.5 GROUP BY 1
 UNION ALL SELECT icao, CASE m WHEN 15 THEN 'positionmarking' ELSE 'atcblindspot' END, count(*) FROM b_element WHERE m IN (3, 15) GROUP BY 1, 2)
SELECT a.icao, l.layer, coalesce(c, 0) AS rows FROM b_airport a CROSS JOIN (VALUES ('paintedcenterline'), ('runwaydisplacedarea'), ('positionmarking'), ('atcblindspot')) l(layer) LEFT JOIN n ON n.icao = a.icao AND n.layer = l.layer""")
def k01(t):
    return store.committed(t.spark, stored_build(t)).select("icao", "layer", "rows")


@query("S30_layers_read_back", f"""WITH {RW} SELECT icao, 'paintedcenterline' AS layer, idrwy AS name, {r('gap')} AS size FROM rk WHERE icao IN (SELECT icao FROM b_airport) UNION ALL
SELECT icao, 'runwaydisplacedarea', ident, {r('shift*width_m', 2)} FROM en WHERE shift > 0.5 AND icao IN (SELECT icao FROM b_airport) UNION ALL
SELECT icao, 'positionmarking', icao || ':positionmarking:ov:' || eid, cast(0 AS double) FROM b_element WHERE m = 15 UNION ALL SELECT icao, 'atcblindspot', icao || ':atcblindspot:ov:' || eid, cast(2500 AS double) FROM b_element WHERE m = 3""")
def s30(t):
    root = stored_build(t)
    layer = lambda n: store.read_layer(t.spark, root, n)
    rows = [layer("paintedcenterline").select("icao", F.col("idrwy").alias("name"), rnd(shapes.line_length(F.col("geom")[0]), 3).alias("size")),
            layer("runwaydisplacedarea").select("icao", F.col("idthr").alias("name"), rnd(shapes.geom_area("geom"), 2).alias("size")),
            layer("positionmarking").select("icao", F.col("id").alias("name"), F.lit(0.0).alias("size")),
            layer("atcblindspot").select("icao", F.col("id").alias("name"), rnd(shapes.geom_area("geom"), 2).alias("size"))]
    return reduce(DataFrame.unionByName, [df.withColumn("layer", F.lit(n)) for n, df in zip(STORED, rows, strict=True)])


# These stand behind the phase of painted and guidance lines, which takes minutes over small tables already;
# they build through ``Airport.layer`` and are not registered.
PENDING = ["L08_asrnedge", "L09_asrnnode", "L27_runwayexitline", "L32_serviceroad", "L33_standguidanceline", "L37_taxiwayguidanceline", "L38_taxiwayholdingposition", "L39_taxiwayintersectionmarking"]
for _n in PENDING:
    QUERIES.pop(_n)
