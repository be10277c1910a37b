"""Projections and scalar functions (P01-P37) over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, geo, shapes, tags, text
from ..functions.geo import rnd
from ..operators import ordered
from .registry import query


def r(v: str, d: int = 3) -> str:
    """SQL twin of ``geo.rnd``."""
    return f"(round(({v})*{10**d})/{10**d} + 0.0)"


def near_airport(t):
    """Run log rows tied to an airport, with a position within 0.1 degrees of it."""
    n = t.supplier.select(F.count(F.lit(1))).scalar()
    log = t.b_runlog.select("event_id", (F.col("event_id") % n).alias("k"))
    return log.join(t.b_airport, "k").select(
        "event_id", "icao", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"),
        (F.col("lat") + ((F.col("event_id") % 200) - 100) / 1000).alias("lat"),
        (F.col("lon") + ((F.col("event_id") % 170) - 85) / 1000).alias("lon"))


NEAR = """near_airport AS (
 SELECT event_id, icao, a.lat AS lat0, a.lon AS lon0, a.lat + ((event_id % 200) - 100) / 1000 AS lat,
        a.lon + ((event_id % 170) - 85) / 1000 AS lon
 FROM b_runlog l JOIN b_airport a ON a.k = event_id % (SELECT count(*) FROM supplier))"""
_C = ("acos(greatest(-1.0, least(1.0, sin(radians(lat0))*sin(radians(lat)) + "
      "cos(radians(lat0))*cos(radians(lat))*cos(radians(lon-lon0)))))")


@query("P01_forward_projection", f"""WITH {NEAR}, c AS (SELECT *, {_C} AS c FROM near_airport)
SELECT event_id, icao,
 {r("6371008.8 * CASE WHEN c < 1e-12 THEN 1 ELSE c/sin(c) END * cos(radians(lat))*sin(radians(lon-lon0))", 1)} AS x,
 {r("6371008.8 * CASE WHEN c < 1e-12 THEN 1 ELSE c/sin(c) END * (cos(radians(lat0))*sin(radians(lat)) - sin(radians(lat0))*cos(radians(lat))*cos(radians(lon-lon0)))", 1)} AS y
FROM c""")
def p01(t):
    x, y = geo.forward("lon", "lat", "lon0", "lat0")
    return near_airport(t).select("event_id", "icao", rnd(x).alias("x"), rnd(y).alias("y"))


_INV = f"""SELECT icao, fid, seq,
 CASE WHEN rho < 1e-9 THEN {r("lon0", 6)} ELSE {r("lon0 + degrees(atan2(x*sin(cc), rho*cos(p0)*cos(cc) - y*sin(p0)*sin(cc)))", 6)} END AS lon,
 CASE WHEN rho < 1e-9 THEN {r("lat0", 6)} ELSE {r("degrees(asin(greatest(-1.0, least(1.0, cos(cc)*sin(p0) + y*sin(cc)*cos(p0)/rho))))", 6)} END AS lat
FROM (SELECT v.icao, fid, seq, cast(x AS double) AS x, cast(y AS double) AS y, sqrt(x*x+y*y) AS rho,
             sqrt(x*x+y*y)/6371008.8 AS cc, radians(a.lat) AS p0, a.lon AS lon0, a.lat AS lat0
      FROM b_vertex v JOIN b_airport a ON a.icao = v.icao) q"""


@query("P02_inverse_projection", _INV)
def p02(t):
    v = t.b_vertex.join(t.b_airport.select("icao", F.col("lat").alias("lat0"), F.col("lon").alias("lon0")), "icao")
    lon, lat = geo.inverse(F.col("x").cast("double"), F.col("y").cast("double"), "lon0", "lat0")
    return v.select("icao", "fid", "seq", rnd(lon, 6).alias("lon"), rnd(lat, 6).alias("lat"))


@query("P03_reproject_geometry", f"""WITH q AS ({_INV.replace("b_vertex v", "(SELECT icao, rid AS fid, 0 AS seq, x0 AS x, y0 AS y FROM b_strip UNION ALL SELECT icao, rid, 1, x1, y1 FROM b_strip) v")})
SELECT icao, fid AS rid, min(CASE WHEN seq=0 THEN lon END) AS lon0, min(CASE WHEN seq=0 THEN lat END) AS lat0,
 min(CASE WHEN seq=1 THEN lon END) AS lon1, min(CASE WHEN seq=1 THEN lat END) AS lat1 FROM q GROUP BY icao, fid""")
def p03(t):
    s = t.b_strip.join(t.b_airport.select("icao", "lat", "lon"), "icao")

    def place(p):
        lon, lat = geo.inverse(p.x, p.y, F.col("lon"), F.col("lat"))
        return shapes.pt(lon, lat)

    g = F.transform(shapes.line_geom(("ax", "ay"), ("bx", "by")), lambda ring: F.transform(ring, place))
    return s.select("icao", "rid", g.alias("g")).select(
        "icao", "rid", *[rnd(F.col("g")[0][i][f], 6).alias(f"{n}{i}") for i in (0, 1) for f, n in (("x", "lon"), ("y", "lat"))])


@query("P04_great_circle_km", f"""WITH {NEAR}, p AS (SELECT l.event_id, a.icao, radians(l.lat) AS p1, radians(a.lat) AS p2, radians(a.lon-l.lon) AS dl
 FROM b_runlog l JOIN b_airport a ON a.k = event_id % (SELECT count(*) FROM supplier))
SELECT event_id, icao, {r("2*6371.0088*asin(sqrt(least(1.0, power(sin((p2-p1)/2),2)+cos(p1)*cos(p2)*power(sin(dl/2),2))))")} AS km FROM p""")
def p04(t):
    n = t.supplier.select(F.count(F.lit(1))).scalar()
    a = t.b_airport.select("k", "icao", F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    return (t.b_runlog.withColumn("k", F.col("event_id") % n).join(a, "k")
            .select("event_id", "icao", rnd(geo.haversine_km("lat", "lon", "alat", "alon"), 3).alias("km")))


@query("P05_rounding", f"""SELECT l_orderkey, l_linenumber, l_partkey, {r('l_extendedprice/7', 1)} AS r1,
 {r('l_extendedprice/7', 3)} AS r3, {r('l_extendedprice/1000', 7)} AS r7 FROM lineitem""")
def p05(t):
    v = F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", rnd(v / 7).alias("r1"), rnd(v / 7, 3).alias("r3"),
                             rnd(v / 1000, 7).alias("r7"))


@query("P06_snap_to_grid", f"""SELECT icao, fid, seq, round(cast(x AS double)/7/0.5)*0.5 + 0.0 AS sx,
 round(cast(y AS double)/7/0.5)*0.5 + 0.0 AS sy FROM b_vertex""")
def p06(t):
    return t.b_vertex.select("icao", "fid", "seq", geo.snap(F.col("x").cast("double") / 7, 0.5).alias("sx"),
                             geo.snap(F.col("y").cast("double") / 7, 0.5).alias("sy"))


SEGS = """segs AS (SELECT * FROM (SELECT icao, fid, seq, line, cast(x AS double) AS x0, cast(y AS double) AS y0,
 cast(lead(x) OVER w AS double) AS x1, cast(lead(y) OVER w AS double) AS y1 FROM b_vertex
 WINDOW w AS (PARTITION BY icao, fid ORDER BY seq)) s0 WHERE x1 IS NOT NULL)"""


def vertex_segments(t):
    """Painted line segments: each vertex with the next one of its line."""
    v = t.b_vertex.withColumn("ax", F.col("x").cast("double")).withColumn("ay", F.col("y").cast("double")).drop("x", "y", "pk")
    s = ordered.scan(v, ["icao", "fid"], ["seq"], bx=ordered.lead("ax"), by=ordered.lead("ay"))
    return s.filter(F.col("bx").isNotNull())


_H = "((degrees(atan2(x1-x0, y1-y0)) + 360) % 360)"


@query("P07_heading_unit_normal", f"""WITH {SEGS} SELECT icao, fid, seq, {r('h')} AS heading, {r('sin(radians(h))')} AS ux,
 {r('cos(radians(h))')} AS uy, {r('cos(radians(h))')} AS rx, {r('-sin(radians(h))')} AS ry FROM (SELECT *, {_H} AS h FROM segs) q""")
def p07(t):
    s = vertex_segments(t).withColumn("h", geo.heading("ax", "ay", "bx", "by"))
    ux, uy = geo.unit("h")
    rx, ry = geo.right_of(ux, uy)
    return s.select("icao", "fid", "seq", rnd("h", 3).alias("heading"), rnd(ux, 3).alias("ux"), rnd(uy, 3).alias("uy"),
                    rnd(rx, 3).alias("rx"), rnd(ry, 3).alias("ry"))


@query("P08_folded_angle", """SELECT icao, rid, CASE WHEN d > 90 THEN 180 - d ELSE d END AS diff FROM
 (SELECT icao, rid, cast(abs(heading - (rid*53)%360) % 180 AS double) AS d FROM b_runway) q""")
def p08(t):
    return t.b_runway.select("icao", "rid", geo.fold_angle(F.col("heading"), (F.col("rid") * 53) % 360).cast("double").alias("diff"))


@query("P09_rectangles", f"""SELECT icao, rid, {r('width_m*len', 3)} AS area, {r('(x0+x1)/2')} AS mx, {r('(y0+y1)/2')} AS my,
 {r('x0 - cos(radians(hd))*width_m/2')} AS x0, {r('y0 + sin(radians(hd))*width_m/2')} AS y0,
 {r('100*40', 3)} AS centered_area, {r('30*1.8', 3)} AS stripe_area,
 {r('x0 + sin(radians(hd))*21 + cos(radians(hd))*4')} AS stripe_x, {r('y0 + cos(radians(hd))*21 - sin(radians(hd))*4')} AS stripe_y
 FROM b_strip""")
def p09(t):
    rect = shapes.rect_between("ax", "ay", "bx", "by", "width_m")
    box = shapes.rect_centered("ax", "ay", "hd", 100.0, 40.0)
    stripe = shapes.axis_rect("ax", "ay", "hd", 6.0, 30.0, 4.0, 1.8)
    s = t.b_strip.select("icao", "rid", rect.alias("g"), shapes.ring_centroid(rect).alias("m"), box.alias("box"),
                         stripe.alias("st"), shapes.ring_centroid(stripe).alias("sc"))
    return s.select("icao", "rid", rnd(shapes.ring_area("g"), 3).alias("area"), rnd("m.x", 3).alias("mx"), rnd("m.y", 3).alias("my"),
                    rnd(F.col("g")[0].x, 3).alias("x0"), rnd(F.col("g")[0].y, 3).alias("y0"),
                    rnd(shapes.ring_area("box"), 3).alias("centered_area"), rnd(shapes.ring_area("st"), 3).alias("stripe_area"),
                    rnd("sc.x", 3).alias("stripe_x"), rnd("sc.y", 3).alias("stripe_y"))


@query("P09_circle", f"""SELECT icao, sid, cast(33 AS int) AS n, {r('16 * power(10 + sid % 40, 2) * sin(2*pi()/32)')} AS area,
 {r('x + 10 + sid % 40')} AS x0, {r('y')} AS y0 FROM b_stand""")
def p09c(t):
    ring = shapes.circle("x", "y", 10 + F.col("sid") % 40, 32)
    return t.b_stand.select("icao", "sid", ring.alias("g")).select(
        "icao", "sid", F.size("g").alias("n"), rnd(shapes.ring_area("g"), 3).alias("area"),
        rnd(F.col("g")[0].x, 3).alias("x0"), rnd(F.col("g")[0].y, 3).alias("y0"))


_BZ = """(power(1-u,3)*{0}0 + 3*power(1-u,2)*u*({0}0+{1}) + 3*(1-u)*u*u*(2*{0}1-({0}1+{2})) + power(u,3)*{0}1)"""


@query("P10_bezier_tessellation", f"""WITH {SEGS}, k AS (SELECT *, greatest(4, least(48, cast(ceil(sqrt(power(x1-x0,2)+power(y1-y0,2))/2) AS int))) AS n
 FROM segs), e AS (SELECT *, unnest(generate_series(1, n)) AS i FROM k), p AS (SELECT *, cast(i AS double)/n AS u FROM e)
SELECT icao, fid, count(*) AS points, {r(f"sum({_BZ.format('x', '10', '6')})/7", 3)} AS sum_x, {r(f"sum({_BZ.format('y', '-8', '5')})/7", 3)} AS sum_y
FROM p GROUP BY icao, fid""")
def p10(t):
    from ..operators.measure import tessellate
    s = vertex_segments(t).select("icao", "fid", "seq", "ax", "ay", "bx", "by", (F.col("ax") + 10).alias("acx"), (F.col("ay") - 8).alias("acy"),
                                  (F.col("bx") + 6).alias("bcx"), (F.col("by") + 5).alias("bcy"))
    return tessellate(s).groupBy("icao", "fid").agg(F.count(F.lit(1)).alias("points"), rnd(F.sum("x") / 7, 3).alias("sum_x"),
                                                    rnd(F.sum("y") / 7, 3).alias("sum_y"))


@query("P11_close_ring", """WITH q AS (SELECT icao, fid, seq, floor(x/100)*100 AS x, floor(y/100)*100 AS y FROM b_vertex),
k AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM q WINDOW w AS (PARTITION BY icao, fid ORDER BY seq)),
d AS (SELECT * FROM k WHERE px IS NULL OR x <> px OR y <> py),
e AS (SELECT icao, fid, count(*) AS n, arg_min(x, seq) AS x0, arg_min(y, seq) AS y0, arg_max(x, seq) AS x1, arg_max(y, seq) AS y1 FROM d GROUP BY icao, fid)
SELECT icao, fid, n + CASE WHEN n >= 2 AND (x0 <> x1 OR y0 <> y1) THEN 1 ELSE 0 END AS vertices FROM e""")
def p11(t):
    from ..operators.measure import close_rings
    v = t.b_vertex.select("icao", "fid", "seq", (F.floor(F.col("x") / 100) * 100).cast("double").alias("x"), (F.floor(F.col("y") / 100) * 100).cast("double").alias("y"))
    return close_rings(v, ["icao", "fid"]).groupBy("icao", "fid").agg(F.count(F.lit(1)).alias("vertices"))


@query("P12_offset_line", f"""WITH q AS (SELECT icao, fid, seq, x, y, coalesce(lag(x) OVER w, x) AS px, coalesce(lag(y) OVER w, y) AS py,
 coalesce(lead(x) OVER w, x) AS nx, coalesce(lead(y) OVER w, y) AS ny FROM b_vertex WINDOW w AS (PARTITION BY icao, fid ORDER BY seq)),
k AS (SELECT *, greatest(sqrt(power(nx-px,2)+power(ny-py,2)), 1e-9) AS l FROM q)
SELECT icao, fid, seq, {r('x + 14.5*(ny-py)/l')} AS ox, {r('y - 14.5*(nx-px)/l')} AS oy FROM k""")
def p12(t):
    from ..operators.measure import offset_lines
    v = t.b_vertex.select("icao", "fid", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return offset_lines(v, ["icao", "fid"], 14.5).select("icao", "fid", "seq", rnd("ox", 3).alias("ox"), rnd("oy", 3).alias("oy"))


@query("P13_runway_pair_id", """SELECT icao, rid, CASE WHEN rid % 11 = 0 THEN 'H1/H2' ELSE ident0 || '/' || ident1 END AS pair,
 CASE WHEN rid % 11 = 0 THEN NULL ELSE cast(substr(ident1, 1, 2) AS int) END AS num FROM b_strip""")
def p13(t):
    heli = F.col("rid") % 11 == 0
    a, b = F.when(heli, "H1").otherwise(F.col("ident1")), F.when(heli, "H2").otherwise(F.col("ident0"))
    return t.b_strip.select("icao", "rid", text.pair_id(a, b).alias("pair"), text.ident_num(a).alias("num"))


def _pick(col, values):
    """Value of a fixed list by a row number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (col % len(values) + 1).cast("int"))


def pick_sql(col: str, values) -> str:
    return f"CASE {col} % {len(values)} " + " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + " END"


IDENTS = ["9R", "18", "H1", " 7 ", "36L", "4", "09C", "5X"]
PAIRS = ["07L/25R+18/36", "7/25", "9L/27R", "04L.22R", " /18"]


@query("P14_designator_padding", f"""SELECT p_partkey, {pick_sql('p_partkey', ['09R', '18', 'H1', '07', '36L', '04', '09C', '5X'])} AS source_form,
 {pick_sql('p_partkey', ['09R', '18', 'H1', '07', '36L', '04', '09C', '05X'])} AS registry_form,
 {pick_sql('p_partkey', ['09R', '18', 'H1', ' 7 ', '36L', '04', '09C', '05X'])} AS client_form,
 {pick_sql('p_partkey', ['07L.25R_18.36', '07.25', '09L.27R', '04L.22R', ' .18'])} AS client_pair,
 {pick_sql('p_partkey', ['07L', '07', '09L', '04L', '18'])} AS first_thr FROM part""")
def p14(t):
    k = F.col("p_partkey")
    i, p = _pick(k, IDENTS), _pick(k, PAIRS)
    return t.part.select("p_partkey", text.pad_source(i).alias("source_form"), text.pad_registry(i).alias("registry_form"),
                         text.pad_client(i).alias("client_form"), text.client_idrwy(p).alias("client_pair"), text.first_threshold(p).alias("first_thr"))


@query("P15_length_text", f"""SELECT p_partkey, {r("CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size*0.3048 WHEN 2 THEN p_size*0.3048 WHEN 3 THEN p_size + 0.5 ELSE NULL END", 4)} AS metres FROM part""")
def p15(t):
    n = F.col("p_size").cast("string")
    v = (F.when(F.col("p_partkey") % 5 == 0, F.concat(n, F.lit(" M"))).when(F.col("p_partkey") % 5 == 1, F.concat(n, F.lit("ft")))
         .when(F.col("p_partkey") % 5 == 2, F.concat(n, F.lit("'"))).when(F.col("p_partkey") % 5 == 3, F.concat(n, F.lit(".5")))
         .otherwise(F.concat(F.lit("about "), n)))
    return t.part.select("p_partkey", rnd(text.length_m(v), 4).alias("metres"))


# Tag combinations the derived map elements cycle through.
TAGSETS = [
    {"aeroway": "parking_position", "ref": "A12", "aircraft:size": "C"}, {"man_made": "mast", "height": "30 m"},
    {"aeroway": "apron", "surface": "asphalt"}, {"aeroway": "apron", "name": "Deice Pad"},
    {"aeroway": "aerodrome", "name": "Field", "iata": "FLD"},
    {"aeroway": "terminal", "building": "yes", "building:levels": "3", "name": "Terminal 1"},
    {"aeroway": "taxiway", "ref": "B", "width": "23", "bridge": "yes"}, {"highway": "unclassified", "lanes": "2"},
    {"barrier": "fence"}, {"aeroway": "runway", "ref": "09/27", "width": "45", "surface": "Concrete"},
    {"building": "warehouse", "height": "40ft"}, {"natural": "water", "name": "Pond"}, {"landuse": "construction"},
    {"power": "line"}, {"aeroway": "holding_position", "holding_position:type": "ils", "ref": "B1"},
    {"aeroway": "papi", "ref": "09"}, {"aeroway": "helipad", "ref": "H1"}, {"highway": "service", "service": "driveway"},
    {"man_made": "storage_tank"}, {"aeroway": "navigationaid", "navigationaid": "als", "ref": "27"},
    {"aeroway": "stopway"}, {"amenity": "parking"}, {"aeroway": "windsock"}, {"building": "hangar", "name": "Hangar 9"},
]


def tag_map(kv: dict):
    return F.create_map(*[F.lit(v) for p in kv.items() for v in p])


def elements(t):
    """Derived map elements with their tags."""
    tags_col = F.element_at(F.array(*[tag_map(d) for d in TAGSETS]), F.col("m") + 1)
    return t.b_element.withColumn("tags", tags_col)


@query("P16_height_and_name", f"""SELECT eid, {r("CASE m WHEN 1 THEN 30 WHEN 5 THEN 10.5 WHEN 10 THEN 40*0.3048 END")} AS height,
 CASE m WHEN 0 THEN 'A12' WHEN 3 THEN 'Deice Pad' WHEN 4 THEN 'Field' WHEN 5 THEN 'Terminal 1' WHEN 6 THEN 'B' WHEN 9 THEN '09/27'
  WHEN 11 THEN 'Pond' WHEN 14 THEN 'B1' WHEN 15 THEN '09' WHEN 16 THEN 'H1' WHEN 19 THEN '27' WHEN 23 THEN 'Hangar 9' END AS name FROM b_element""")
def p16(t):
    return elements(t).select("eid", rnd(text.height_m("tags"), 3).alias("height"), text.tag_name("tags").alias("name"))


NAMES = ["Main Apron", "Cargo Ramp", "A", "Taxiway B", "Service Road", "Heli Pad", "Rwy shoulder", "Pad East", None, "GA tie downs",
         "Mil zone", "Deicing 2", "Fuel farm", "Terminal gates", "Street 9"]


@query("P17_pavement_hint", f"""SELECT p_partkey, {pick_sql('p_partkey', ['apron', 'apron', 'taxiway', 'taxiway', 'road', 'helipad', 'runway', 'unknown', 'unknown',
 'apron', 'unknown', 'unknown', 'unknown', 'apron', 'road'])} AS hint FROM part""")
def p17(t):
    return t.part.select("p_partkey", text.pavement_hint(_pick(F.col("p_partkey"), NAMES)).alias("hint"))


@query("P18_apron_class", f"""SELECT p_partkey, {pick_sql('p_partkey', [1, 2, 0, 0, 0, 7 + 1, 0, 0, 0, 3, 5, 6, 7, 1, 0])} AS feattype FROM part""")
def p18(t):
    return t.part.select("p_partkey", text.apron_kind(_pick(F.col("p_partkey"), NAMES)).alias("feattype"))


TAG_SURFACES = ["Asphalt", "tarmac", "concrete:plates", "turf", "compacted", "mud", "sand", "water", "ice", "metal_grid", "sett", "cheese"]


@query("P19_surface_maps", f"""SELECT p_partkey, CASE WHEN s = 1 OR s BETWEEN 20 AND 38 THEN 4 WHEN s = 2 OR s BETWEEN 50 AND 57 THEN 2 WHEN s = 3 THEN 9
 WHEN s = 4 THEN 6 WHEN s = 5 THEN 11 WHEN s = 12 THEN 5 WHEN s = 13 THEN 8 WHEN s = 14 THEN 7 ELSE 0 END AS scenery,
 {pick_sql('p_partkey', [4, 4, 2, 9, 11, 6, 5, 8, 7, 13, 15, 0])} AS tagged FROM (SELECT p_partkey, p_partkey % 61 AS s FROM part) q""")
def p19(t):
    return t.part.select("p_partkey", codes.scenery_surface(F.col("p_partkey") % 61).alias("scenery"),
                         codes.tag_surface(_pick(F.col("p_partkey"), TAG_SURFACES)).alias("tagged"))


@query("P20_scenery_code_maps", """SELECT p_partkey, CASE WHEN m = 0 THEN 1 WHEN m = 1 THEN 2 WHEN m = 2 THEN 3 WHEN m = 3 THEN 4 WHEN m <= 7 THEN 2 ELSE 0 END AS marking,
 cast(p_partkey % 7 + 1 AS int) AS station, CASE WHEN m IN (1,5) THEN 2 WHEN m IN (2,3,4) THEN 1 WHEN m = 6 THEN 4 WHEN m IN (7,8) THEN 3 ELSE 0 END AS aid,
 CASE p_partkey % 4 WHEN 0 THEN 'gate' WHEN 1 THEN 'tie_down' WHEN 2 THEN 'hangar' ELSE 'misc' END AS stand_kind
 FROM (SELECT p_partkey, p_partkey % 10 AS m FROM part) q""")
def p20(t):
    m = (F.col("p_partkey") % 10).cast("int")
    kind = _pick(F.col("p_partkey"), ["gate", "tie-down", "hangar", "ramp"])
    return t.part.select("p_partkey", F.coalesce(text.lookup(codes.SCENERY_MARKING, m), F.lit(0)).alias("marking"),
                         text.lookup(codes.STATIONS, (F.col("p_partkey") % 7).cast("int")).alias("station"),
                         F.coalesce(text.lookup(codes.VISUAL_AIDS, m), F.lit(0)).alias("aid"),
                         F.coalesce(text.lookup(codes.STAND_KINDS, kind), F.lit("misc")).alias("stand_kind"))


@query("P21_tag_classifiers", """SELECT eid, CASE m WHEN 5 THEN 1 WHEN 10 THEN 7 WHEN 18 THEN 5 WHEN 23 THEN 2 ELSE 4 END AS building,
 CASE m WHEN 1 THEN 2 WHEN 18 THEN 9 WHEN 22 THEN 6 END AS point, CASE m WHEN 8 THEN 1 WHEN 13 THEN 3 END AS line, m = 3 AS deicing,
 CASE m WHEN 15 THEN 1 WHEN 19 THEN 8 END AS light FROM b_element""")
def p21(t):
    return elements(t).select("eid", tags.building_kind("tags").alias("building"), tags.point_kind("tags").alias("point"),
                              tags.line_kind("tags").alias("line"), tags.is_deicing("tags").alias("deicing"), tags.light_kind("tags").alias("light"))


@query("P22_road_width", """SELECT eid, CASE m WHEN 6 THEN 23.0 WHEN 7 THEN 6.5 WHEN 9 THEN 30.0 ELSE 5.0 END::double AS width FROM b_element""")
def p22(t):
    return elements(t).select("eid", text.road_width("tags").alias("width"))


@query("P23_stand_size", f"""WITH q AS (SELECT p_partkey, CASE WHEN p_partkey % 7 < 6 THEN {pick_sql('p_partkey', list('ABCDEF'))}
 ELSE CASE p_partkey % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'C' WHEN 2 THEN 'B' ELSE CASE p_partkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'A' ELSE 'B' END END END AS letter FROM part)
SELECT p_partkey, letter, CASE letter WHEN 'A' THEN 15.0 WHEN 'B' THEN 24.0 WHEN 'C' THEN 36.0 WHEN 'D' THEN 52.0 WHEN 'E' THEN 65.0 ELSE 80.0 END::double AS wingspan,
 CASE WHEN letter IN ('A','B') THEN 3.0 WHEN letter = 'C' THEN 4.5 ELSE 7.5 END::double AS clearance FROM q""")
def p23(t):
    k = F.col("p_partkey")
    types = F.split(_pick(k, ["heavy|jets", "jets|turboprops", "turboprops|props", "props"]), r"\|")
    letter = codes.stand_letter(F.when(k % 7 < 6, _pick(k, list("ABCDEF"))), types, _pick(k, ["gate", "tie_down", "hangar"]))
    return t.part.select("p_partkey", letter.alias("letter")).select(
        "p_partkey", "letter", codes.wingspan("letter").alias("wingspan"), codes.clearance("letter").alias("clearance"))


@query("P24_allowed_wingspan", """SELECT eid, CASE restriction WHEN 'taxiway_A' THEN 15.0 WHEN 'taxiway_B' THEN 24.0 WHEN 'taxiway_C' THEN 36.0 WHEN 'taxiway_D' THEN 52.0
 WHEN 'taxiway_E' THEN 65.0 WHEN 'taxiway_F' THEN 80.0 END::double AS by_restriction,
 CASE WHEN w >= 65 THEN 80.0 WHEN w >= 52 THEN 65.0 WHEN w >= 36 THEN 52.0 WHEN w >= 24 THEN 36.0 ELSE 24.0 END::double AS by_width
 FROM (SELECT eid, restriction, (eid % 50 - 2) * 2 AS w FROM b_edge) q""")
def p24(t):
    return t.b_edge.select("eid", codes.restriction_wingspan("restriction").alias("by_restriction"),
                           codes.width_wingspan(F.col("eid") % 50).alias("by_width"))


def sign_text(t):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.concat(F.lit("{@"), _pick(k, ["Y", "R", "L", "b", "Q"]), F.lit("}"), size, _pick(k, ["{^r}", "{^lu,r2}", "{hazard}"]),
                   F.when(k % 2 == 0, F.concat(F.lit("{@@}B"), size, F.lit("{@L,^l}"))).otherwise(F.lit("{_}")))
    return t.part.select("p_partkey", "p_size", raw.alias("raw"))


SIGN = f"""sign AS (SELECT p_partkey, cast(p_size AS string) || {pick_sql('p_partkey', ['→', '↖II', '[HAZARD]'])} || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' END AS msgfront,
 CASE WHEN p_partkey % 2 = 0 THEN 'B' || cast(p_size AS string) || '←' END AS msgback, {pick_sql('p_partkey', [2, 1, 3, 4, 0])} AS signtype, p_size % 6 AS size FROM part)"""


@query("P25_sign_text", f"WITH {SIGN} SELECT p_partkey, msgfront, msgback, signtype FROM sign")
def p25(t):
    return sign_text(t).select("p_partkey", *[v.alias(n) for n, v in text.decode_sign("raw").items()])


@query("P26_sign_height", f"""WITH {SIGN} SELECT p_partkey, CASE size WHEN 1 THEN 0.6 WHEN 2 THEN 0.8 WHEN 3 THEN 1.2 WHEN 4 THEN 1.2 ELSE 0.8 END::double AS height,
 CASE WHEN size >= 4 THEN 4 ELSE signtype END AS signtype FROM sign""")
def p26(t):
    from ..operators.points import sign_height, sign_type
    s = sign_text(t).withColumn("size", F.col("p_size") % 6)
    return s.select("p_partkey", sign_height("size").alias("height"), sign_type("raw", "size").alias("signtype"))


@query("P27_line_meaning", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN c = 0 THEN 'ignore' WHEN c IN (1,51,60) THEN 'center' WHEN c IN (7,57) THEN 'center_ils'
 WHEN c IN (8,9,58,59) THEN 'lane' WHEN c IN (4,54,62) THEN 'runway_hold' WHEN c IN (6,56,64) THEN 'ils_hold' WHEN c IN (5,55,63) THEN 'intersection_hold'
 WHEN c IN (3,53,30,31,32,20,21,23,24,25) THEN 'ignore' WHEN c = 22 THEN 'road_center' ELSE 'geometric' END AS meaning,
 l IN (101,105,107,108) AS lit, l IN (103,104) AS hold_lit FROM (SELECT *, l_partkey % 70 AS c, 100 + l_partkey % 10 AS l FROM lineitem) q""")
def p27(t):
    light = 100 + F.col("l_partkey") % 10
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", codes.line_meaning(F.col("l_partkey") % 70).alias("meaning"),
                             light.isin(codes.LIT_LIGHTS).alias("lit"), light.isin(codes.HOLD_LIGHTS).alias("hold_lit"))


@query("P28_marking_tables", """SELECT icao, rid, CASE WHEN width_m < 20 THEN 4 WHEN width_m < 26 THEN 6 WHEN width_m < 40 THEN 8 WHEN width_m < 55 THEN 12 ELSE 16 END AS stripes,
 CASE WHEN len < 800 THEN 150.0 WHEN len < 1200 THEN 250.0 WHEN len < 2400 THEN 300.0 ELSE 400.0 END::double AS aim_at,
 CASE WHEN len < 800 THEN 30.0 WHEN len < 1200 THEN 30.0 WHEN len < 2400 THEN 45.0 ELSE 60.0 END::double AS aim_len,
 CASE WHEN len < 800 THEN 4.0 WHEN len < 2400 THEN 6.0 ELSE 10.0 END::double AS aim_width,
 CASE WHEN len < 900 THEN 1 WHEN len < 1200 THEN 2 WHEN len < 1500 THEN 3 WHEN len < 2400 THEN 4 ELSE 6 END AS tdz FROM b_strip""")
def p28(t):
    from ..operators.marking import aiming_point, stripe_count, touchdown_pairs
    a, n, w = aiming_point("len")
    return t.b_strip.select("icao", "rid", stripe_count("width_m").alias("stripes"), a.alias("aim_at"), n.alias("aim_len"),
                            w.alias("aim_width"), touchdown_pairs("len").alias("tdz"))


@query("P29_continent_code", f"""SELECT p_partkey, {pick_sql('p_partkey', ['AS', 'NA', 'EU', None, 'SA', 'OC', 'AF', 'AN'])} AS code FROM part""")
def p29(t):
    return t.part.select("p_partkey", text.continent_code(_pick(F.col("p_partkey"), [" Asia ", "north-america", "eu", "moon", "South", "Australia", "AF", "antarctica"])).alias("code"))


_MON = "CASE month(s) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sep' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'Dec' END"
CYCLE = """q AS (SELECT o_orderkey, cast(o_orderdate AS date) AS d FROM orders),
s1 AS (SELECT o_orderkey, d, date '2024-01-25' + cast(floor((d - date '2024-01-25') / 28) AS int) * 28 AS s,
 date '2026-09-03' + cast(floor((d - date '2026-09-03') / 28) AS int) * 28 AS c FROM q)"""


@query("P30_cycle_dates", f"""WITH {CYCLE} SELECT o_orderkey, strftime(s, '%Y-%m-%d') AS registry_start, lpad(cast(day(s) AS string), 2, '0') || '_' || {_MON} || '_' || cast(year(s) AS string) || '_CSV.zip' AS file,
 strftime(c, '%Y-%m-%d') AS calendar_start, cast((year(c) % 100) * 100 + floor((dayofyear(c) - 1) / 28) + 1 AS int) AS cycle FROM s1""")
def p30(t):
    d = F.to_date("o_orderdate")
    s = t.orders.select("o_orderkey", text.cycle_start(d, text.REGISTRY_EPOCH).alias("s"), text.cycle_start(d, text.CALENDAR_EPOCH).alias("c"))
    return s.select("o_orderkey", F.date_format("s", "yyyy-MM-dd").alias("registry_start"), text.cycle_file("s").alias("file"),
                    F.date_format("c", "yyyy-MM-dd").alias("calendar_start"), text.cycle_number("c").alias("cycle"))


@query("P31_us_coverage", f"""SELECT p_partkey, {pick_sql('p_partkey', [True, True, False, True, True, False, True, False, True])} AS covered FROM part""")
def p31(t):
    k = F.col("p_partkey")
    return t.part.select("p_partkey", text.us_coverage(
        _pick(k, ["KJFK", "TJSJ", "KXXX", "PANC", "kaaa", "EGLL", "XXXX", "LFPG", "PHNL"]),
        _pick(k, ["US", "USA United States", "CA", None, "Somewhere", None, "the united states", "FRA", None])).alias("covered"))


@query("P32_label_tidying", f"""SELECT p_partkey, {pick_sql('p_partkey', ['Terminal 3', 'Terminal 3', 'Hall', 'A very long name of', 'E/F & Link'])} AS structure,
 {pick_sql('p_partkey', ['E15B', 'Stand 12', 'Remote stand', '7', 'Gate 5'])} AS stand, {pick_sql('p_partkey', ['Terminal 3', 'Terminal 3', 'Hall', 'A very long na', 'E/F &amp; Link'])} AS short_structure,
 {pick_sql('p_partkey', ['E15B', 'Stand 12', 'Remote sta', '7', 'Gate 5'])} AS short_stand FROM part""")
def p32(t):
    k = F.col("p_partkey")
    st = _pick(k, ["Terminal 3 Gate L2C", "Terminal 3 (Building #8)", "Hall, North", "A very long name of a hangar", "E/F &amp; Link"])
    sd = _pick(k, ["Terminal 2 Gate E15B", "Stand 12 (2)", "Remote stand nine", "Hall Gate 3 Gate 7", " Gate 5"])
    return t.part.select("p_partkey", text.decode_entities(text.tidy_name(st)).alias("structure"), text.tidy_stand(sd).alias("stand"),
                         text.tidy_name(st, 14).alias("short_structure"), text.tidy_stand(sd, 10).alias("short_stand"))


@query("P33_empty_reason", """SELECT p_partkey, layer, CASE layer WHEN 'hotspot' THEN 'no free worldwide source; supply via overrides/<ICAO>/<layer>.geojson'
 WHEN 'serviceroad' THEN CASE WHEN p_partkey % 2 = 0 THEN 'nothing matching within the airport extent in OSM' ELSE 'OSM source not used' END
 WHEN 'frequencyarea' THEN CASE WHEN p_partkey % 3 = 0 THEN 'not present in the X-Plane scenery' ELSE 'X-Plane source not available' END
 WHEN 'stopway' THEN 'no stopway in sources (FAA declared distances / OSM aeroway=stopway)' ELSE 'no data in sources' END AS reason
 FROM (SELECT p_partkey, """ + pick_sql("p_partkey", ["hotspot", "serviceroad", "frequencyarea", "stopway", "runwayelement"]) + """ AS layer FROM part) q""")
def p33(t):
    k = F.col("p_partkey")
    s = t.part.select("p_partkey", _pick(k, ["hotspot", "serviceroad", "frequencyarea", "stopway", "runwayelement"]).alias("layer"))
    return s.select("p_partkey", "layer", codes.empty_reason("layer", k % 3 == 0, k % 2 == 0).alias("reason"))


def _case(attr, v):
    m, d = codes.CLIENT_CODES[attr]
    return f"CASE {v} " + " ".join(f"WHEN {a} THEN {b}" for a, b in m.items()) + f" ELSE {d} END"


@query("P35_client_codes", "SELECT p_partkey, " + ", ".join(f"{_case(a, 'cast(p_partkey % 18 AS int)')} AS {a}" for a in codes.CLIENT_CODES) + " FROM part")
def p35(t):
    return t.part.select("p_partkey", *[codes.client_code(a, F.col("p_partkey") % 18).alias(a) for a in codes.CLIENT_CODES])


@query("P36_feet_to_metres", f"""SELECT icao, CASE WHEN k % 5 = 0 THEN -32767.0 ELSE {r('elev_ft*0.3048', 2)} END::double AS elev_m FROM b_airport""")
def p36(t):
    from ..operators.client import ft_to_m
    return t.b_airport.select("icao", ft_to_m(F.when(F.col("k") % 5 != 0, F.col("elev_ft"))).alias("elev_m"))


@query("P37_coordinate_text", """SELECT icao, CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || printf('%02d° %04.1f''', cast(floor(abs(lat)) AS int), (abs(lat)-floor(abs(lat)))*60) || '  ' ||
 CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || printf('%03d° %04.1f''', cast(floor(abs(lon)) AS int), (abs(lon)-floor(abs(lon)))*60) AS place
 FROM (SELECT icao, lat + 0.0013 AS lat, lon + 0.0017 AS lon FROM b_airport) q""")
def p37(t):
    return t.b_airport.select("icao", text.coord_text(F.col("lat") + 0.0013, F.col("lon") + 0.0017).alias("place"))
