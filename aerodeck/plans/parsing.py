"""Source queries (S01-S30): texts rendered from the derived views, parsed back by the scanners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes, tags
from ..functions.geo import rnd
from ..operators import conflate
from ..operators.ordered import durable
from ..sources import geojson, osm, scenery, tables
from .registry import query
from .relational import registry_tables
from .scalar import TAGSETS, elements, pick_sql, r


def s(v):
    return F.col(v).cast("string") if isinstance(v, str) else v.cast("string")


def row(*fields):
    """One scenery row of space-separated fields."""
    return F.concat_ws(" ", *[F.lit(f) if isinstance(f, str) else f.cast("string") for f in fields])


def deg(v):
    """Metres as small decimal degrees, so parsed numbers are exact to check."""
    return F.format_string("%.5f", v / 100000)


def scenery_lines(t, wanted=None):
    """Scenery rows of every airport as (icao, part, o1, o2, line), part giving the order.

    ``wanted`` names the row families a query needs; the airport header is always there.
    """
    c = F.col
    x, y = (c("x").cast("double"), c("y").cast("double"))
    parts = []

    def add(df, part, o1, o2, line):
        if part == 0 or not wanted or part in wanted:
            parts.append(df.select("icao", F.lit(part).alias("part"), o1.cast("bigint").alias("o1"), o2.cast("bigint").alias("o2"), line.alias("line")))

    zero = F.lit(0)
    a = t.b_airport
    add(a, 0, zero, zero, row("1", c("elev_ft"), "0", "0", c("icao"), c("name")))
    add(a, 1, zero, F.lit(0), row("1302", "city", c("city")))
    add(a, 1, zero, F.lit(1), row("1302", "country", c("country")))
    add(a, 1, zero, F.lit(2), row("1302", "datum_lat", F.format_string("%.2f", "lat")))
    add(a.filter("k % 3 > 0"), 1, zero, F.lit(3), row("1302", "datum_lon", F.format_string("%.2f", "lon")))
    add(a.filter("iata IS NOT NULL"), 1, zero, F.lit(4), row("1302", "iata_code", c("iata")))
    st = t.b_strip
    end = lambda k, x_, y_: [F.regexp_replace(f"ident{k}", "^0", ""), deg(c(y_)), deg(c(x_)), c(f"displaced{k}"), c(f"blastpad{k}"), c(f"marking{k}") - 1, c(f"approach{k}"), c(f"tdz{k}").cast("int"), c(f"reil{k}")]
    full = row("100", c("width_m"), c("surface"), F.coalesce("shoulder_surface", F.lit(0)), "0.25", c("centerline_lights").cast("int"), c("edge_lights"), "0", *end(0, "ax", "ay"), *end(1, "bx", "by"))
    add(st, 2, c("rid"), zero, F.when(c("rid") % 25 == 7, row("100", c("width_m"), "1", "x")).otherwise(full))
    add(st.filter("rid % 9 = 0"), 3, c("rid"), zero, row("101", c("width_m"), "0", F.lit("4"), deg(c("ay")), deg(c("ax")), F.lit("22"), deg(c("by")), deg(c("bx"))))
    add(st.filter("rid % 5 = 0"), 4, c("rid"), zero, row("102", "H1", deg(c("ay")), deg(c("ax")), c("hd"), "25", "bad", "2", "0", "0"))
    vv = t.b_vertex.withColumn("_last", F.max("seq").over(W.partitionBy("icao", "fid")))
    is_last = c("seq") == c("_last")
    node = (F.when(is_last & (c("fid") % 3 == 0), row("113", deg(y), deg(x), c("line"), "101")).when(is_last, row("115", deg(y), deg(x)))
            .when(c("seq") == 2, row("112", deg(y), deg(x), deg(y + 5), deg(x + 7), c("line"), "102")).otherwise(row("111", deg(y), deg(x), c("line"))))
    head = F.when(c("fid") % 4 == 0, "120").otherwise(row("120", "Line", c("fid")))
    one = lambda o2, line: F.struct(o2.cast("bigint").alias("o2"), line.alias("line"))
    # The last node of a line brings the header row with it, so the vertices are read once.
    painted = vv.select("icao", "fid", F.explode(F.when(is_last, F.array(one(F.lit(-1), head), one(c("seq"), node))).otherwise(F.array(one(c("seq"), node)))).alias("_l"))
    add(painted, 5, c("fid"), c("_l.o2"), c("_l.line"))
    p = t.b_pavement
    add(p, 6, c("pid"), zero, row("110", c("surface"), "0.25", "0", F.coalesce("name", F.lit(""))))
    for i, (dx, dy) in enumerate([(0, 0), (50, 0), (50, 50), (0, 50)]):
        add(p.filter("pid % 6 > 0") if i < 2 else p, 6, c("pid"), F.lit(i + 1), row("113" if i == 3 else "111", deg(y + dy), deg(x + dx)))
    for i, (dx, dy) in enumerate([(10, 10), (20, 10), (20, 20)]):
        add(p.filter("pid % 5 = 0"), 6, c("pid"), F.lit(i + 6), row("113" if i == 2 else "111", deg(y + dy), deg(x + dx)))
    for ring in (0, 1):
        for i, (dx, dy) in enumerate([(0, 0), (9, 0), (9, 9)]):
            add(a, 7, F.lit(ring), F.lit(i + 1), row("113" if i == 2 else "111", F.lit(f"{dy + ring}"), F.lit(f"{dx}")))
        add(a, 7, F.lit(ring), zero, row("130", "Boundary"))
    so = t.b_stand
    add(so, 8, c("sid"), zero, row("1300", deg(y), deg(x), c("sid") % 360, F.when(c("sid") % 3 == 0, "gate").when(c("sid") % 3 == 1, "tie-down").otherwise("ramp"), "jets|heavy", F.when(c("sid") % 4 > 0, F.concat(F.lit("Stand "), s("sid"))).otherwise("")))
    add(so.filter("sid % 2 = 0"), 8, c("sid"), F.lit(1), row("1301", "c", "airline", "dal", F.when(c("sid") % 8 == 0, "aal").otherwise("klm")))
    n = t.b_node
    add(n, 9, c("nid"), zero, row("1201", deg(y), deg(x), "both", c("nid"), c("name")))
    e = t.b_edge
    add(e, 10, c("eid"), zero, row("1202", c("from_id"), c("to_id"), F.when(c("oneway"), "oneway").otherwise("twoway"), c("restriction"), F.coalesce("name", F.lit(""))))
    add(e.filter("eid % 10 = 1"), 10, c("eid"), F.lit(1), row("1204", "departure", F.concat(F.lit("9L,"), (c("eid") % 36).cast("string"))))
    add(so.filter("sid % 10 = 0"), 11, c("sid"), zero, F.when(c("sid") % 20 == 0, row("1050", F.lit(118000) + c("sid") % 900, "ATIS")).otherwise(row("54", F.lit(11800) + c("sid") % 90, "TWR", "North")))
    add(t.b_element, 12, c("eid"), zero, F.when(c("m") % 4 == 0, row("18", deg(y), deg(x), "1", "BCN")).when(c("m") % 4 == 1, row("19", deg(y), deg(x), "1", "WS", "A"))
        .when(c("m") % 4 == 2, row("20", deg(y), deg(x), c("eid") % 360, "0", c("m") % 5, "{@Y}A{^r}")).otherwise(row("21", deg(y), deg(x), c("m") % 9, "90", "3.0", "9R", "PAPI-4L")))
    add(a, 13, zero, zero, F.lit("1200"))
    return reduce(lambda p1, p2: p1.unionByName(p2), parts)


def blocks(t, *wanted):
    """Airport blocks as the reader cuts them: one text per airport, kept as a table."""
    ln = scenery_lines(t, wanted).groupBy("icao").agg(F.array_sort(F.collect_list(F.struct("part", "o1", "o2", "line"))).alias("l"))
    return durable(ln.select(F.lit("custom/apt.dat").alias("path"), "icao", F.array_join(F.transform("l", lambda v: v.line), "\n").alias("block")))


def lines(t, *wanted):
    return scenery.coded_lines(blocks(t, *wanted))


@query("S01_airport_blocks", """SELECT icao, 4 AS fields FROM b_airport""")
def s01(t):
    small = t.b_airport.select("k", "icao", F.concat(F.lit("77 0 0 "), F.col("icao"), F.lit(" Field\n100 30 1\n")).alias("b"))
    even = small.filter("k % 2 = 0").select((F.col("k") / 2).cast("bigint").alias("g"), F.col("b").alias("b0"))
    odd = small.filter("k % 2 = 1").select(((F.col("k") - 1) / 2).cast("bigint").alias("g"), F.col("b").alias("b1"))
    file = even.join(odd, "g", "left").select(F.lit("f").alias("path"), F.concat("b0", F.coalesce(F.concat(F.lit("\n17 "), "b1"), F.lit("")), F.lit("\n99\n")).alias("value"))
    head = t.region.filter("r_regionkey = 0").select(F.lit("f").alias("path"), F.lit("I\n1200 Version - made here\n").alias("value"))
    b = scenery.airport_blocks(file.unionByName(head))
    return b.select("icao", (F.size(F.split(F.split("block", "\n")[0], " ")) - 2).alias("fields"))


@query("S02_pick_airport", "SELECT icao, name FROM b_airport WHERE icao = 'X007'")
def s02(t):
    return scenery.headers(scenery.coded_lines(scenery.pick_airport(blocks(t, 1), "x007"))).select("icao", "name")


@query("S03_first_file_wins", "SELECT icao, CASE WHEN k % 3 = 0 THEN 'Custom/a' WHEN k % 3 = 1 THEN 'Custom/b' ELSE 'default' END AS path FROM b_airport")
def s03(t):
    b = t.b_airport.select("icao", "k", F.explode(F.array(F.lit("default"), F.lit("Custom/b"), F.lit("Custom/a"))).alias("path"))
    b = b.filter("path = 'default' OR (path = 'Custom/b' AND k % 3 < 2) OR (path = 'Custom/a' AND k % 3 = 0)")
    return scenery.first_file_wins(b.withColumn("block", F.lit("x")).drop("k"), F.when(F.col("path").startswith("Custom"), 0).otherwise(2)).select("icao", "path")


@query("S04_row_dispatch", """SELECT icao, code, n FROM (SELECT icao, 1202 AS code, count(*) AS n FROM b_edge GROUP BY icao UNION ALL SELECT icao, 1201, count(*) FROM b_node GROUP BY icao UNION ALL SELECT icao, 1300, count(*) FROM b_stand GROUP BY icao UNION ALL SELECT icao, 110, count(*) FROM b_pavement GROUP BY icao UNION ALL SELECT icao, 100, count(*) FROM b_strip GROUP BY icao) q""")
def s04(t):
    return lines(t, 2, 6, 8, 9, 10).filter(F.col("code").isin(100, 110, 1201, 1202, 1300)).groupBy("icao", "code").agg(F.count(F.lit(1)).alias("n"))


@query("S05_runway_rows", f"""SELECT icao, ident0, ident1, width_m, CASE surface WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 9 WHEN 4 THEN 6 ELSE 0 END AS surface, CASE WHEN shoulder_surface IS NOT NULL THEN 2 END AS shoulder_surface, centerline_lights, edge_lights, displaced0, blastpad1, approach0, tdz1, reil0,
 CASE marking1 WHEN 0 THEN 0 ELSE marking1 END AS marking1, {r("round(y0)/100000", 5)} AS lat0, {r("round(x1)/100000", 5)} AS lon1 FROM b_strip WHERE rid % 25 <> 7""".replace("round(y0)/100000", "y0/100000").replace("round(x1)/100000", "x1/100000"))
def s05(t):
    ok, _ = scenery.runways(lines(t, 2))
    return ok.select("icao", "ident0", "ident1", "width_m", "surface", "shoulder_surface", "centerline_lights", "edge_lights", "displaced0", "blastpad1", "approach0", "tdz1", "reil0", "marking1", rnd("lat0", 5).alias("lat0"), rnd("lon1", 5).alias("lon1"))


@query("S05_short_rows", "SELECT icao, 'short runway row: 100 ' || cast(width_m AS string) || ' 1 x' AS message FROM b_strip WHERE rid % 25 = 7")
def s05b(t):
    _, short = scenery.runways(lines(t, 2))
    return short.select("icao", "message")


@query("S06_water_runways", f"SELECT icao, width_m, '4' AS ident0, '22' AS ident1, {r('y0/100000', 5)} AS lat0, {r('x1/100000', 5)} AS lon1 FROM b_strip WHERE rid % 9 = 0")
def s06(t):
    return scenery.water_runways(lines(t, 3)).select("icao", "width_m", "ident0", "ident1", rnd("lat0", 5).alias("lat0"), rnd("lon1", 5).alias("lon1"))


@query("S07_helipads", "SELECT icao, 'H1' AS ident, hd AS heading, 25.0::double AS length_m, 0.0::double AS width_m, 2 AS surface FROM b_strip WHERE rid % 5 = 0")
def s07(t):
    return scenery.helipads(lines(t, 4)).select("icao", "ident", "heading", "length_m", "width_m", "surface")


@query("S08_pavement_rings", """SELECT icao, CASE WHEN pid % 5 = 0 AND pid % 6 > 0 THEN 1 WHEN pid % 6 = 0 THEN 9 ELSE 0 END AS holes, count(*) AS n, CASE WHEN pid % 6 = 0 THEN 0 ELSE 4 END AS outer_nodes FROM b_pavement WHERE pid % 6 > 0 GROUP BY 1, 2, 4""")
def s08(t):
    ln = lines(t, 6)
    _, v = scenery.pavements(ln, scenery.rings(ln))
    p = v.groupBy("icao", "obj").agg(F.max("ring").alias("holes"), F.count_if(F.col("ring") == 0).cast("int").alias("outer_nodes"))
    return p.groupBy("icao", "holes", "outer_nodes").agg(F.count(F.lit(1)).alias("n"))


@query("S08_painted_lines", """SELECT icao, CASE WHEN fid % 4 > 0 THEN 'Line ' || fid END AS name, count(*) AS nodes, fid % 3 = 0 AS closed, cast(sum(CASE WHEN seq = mx AND fid % 3 > 0 THEN 0 ELSE line END) AS bigint) AS codes FROM (SELECT *, max(seq) OVER (PARTITION BY icao, fid) AS mx FROM b_vertex) q GROUP BY icao, fid""")
def s08b(t):
    v = scenery.painted_lines(scenery.rings(lines(t, 5)))
    return v.groupBy("icao", "obj").agg(F.first("name").alias("name"), F.count(F.lit(1)).alias("nodes"), F.first("closed").alias("closed"), F.sum("line").alias("codes")).drop("obj")


@query("S08_boundary", "SELECT icao, 3 AS nodes, 9.0::double AS top FROM b_airport")
def s08c(t):
    b = scenery.boundary(scenery.rings(lines(t, 7)))
    return b.groupBy("icao").agg(F.count(F.lit(1)).cast("int").alias("nodes"), F.max("lat").alias("top"))


@query("S09_node_rows", f"""SELECT icao, {r('y/100000.0::double', 5)} AS lat, {r('x/100000.0::double', 5)} AS lon, CASE WHEN seq = 2 AND seq < mx THEN {r('(x+7)/100000.0::double', 5)} END AS ctrl_lon, CASE WHEN seq = mx AND fid % 3 > 0 THEN 0 ELSE line END AS line,
 CASE WHEN seq = mx AND fid % 3 = 0 THEN 101 WHEN seq = 2 AND seq < mx THEN 102 ELSE 0 END AS light FROM (SELECT *, max(seq) OVER (PARTITION BY icao, fid) AS mx FROM b_vertex) q""")
def s09(t):
    v = scenery.painted_lines(scenery.rings(lines(t, 5)))
    return v.select("icao", rnd("lat", 5).alias("lat"), rnd("lon", 5).alias("lon"), rnd("ctrl_lon", 5).alias("ctrl_lon"), "line", "light")


@query("S10_point_objects", """SELECT icao, CASE m % 4 WHEN 0 THEN 'beacon' WHEN 1 THEN 'windsock' WHEN 2 THEN 'sign' ELSE 'aid' END AS what, CASE m % 4 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN m % 5 ELSE CASE m % 9 WHEN 1 THEN 2 WHEN 5 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 6 THEN 4 WHEN 7 THEN 3 WHEN 8 THEN 3 ELSE 0 END END AS code,
 CASE m % 4 WHEN 0 THEN 'BCN' WHEN 1 THEN 'WS A' WHEN 2 THEN '{@Y}A{^r}' ELSE '09R' END AS note FROM b_element""")
def s10(t):
    ln = lines(t, 12)
    what = lambda df, w, code, note: df.select("icao", F.lit(w).alias("what"), F.col(code).alias("code"), F.col(note).alias("note"))
    return (what(scenery.beacons(ln), "beacon", "kind", "name").unionByName(what(scenery.windsocks(ln), "windsock", "kind", "name"))
            .unionByName(what(scenery.signs(ln), "sign", "size", "raw")).unionByName(what(scenery.visual_aids(ln), "aid", "kind", "runway")))


@query("S11_frequencies", """SELECT icao, CASE WHEN sid % 20 = 0 THEN 1 ELSE 5 END AS station, CASE WHEN sid % 20 = 0 THEN (118000 + sid % 900)/1000 ELSE (11800 + sid % 90)/100 END AS mhz, CASE WHEN sid % 20 = 0 THEN 'ATIS' ELSE 'TWR North' END AS name FROM b_stand WHERE sid % 10 = 0""")
def s11(t):
    return scenery.frequencies(lines(t, 11)).select("icao", "station", "mhz", "name")


@query("S12_route_rows", "SELECT icao, from_id, to_id, oneway, restriction, name FROM b_edge")
def s12(t):
    return scenery.route_edges(lines(t, 10)).select("icao", "from_id", "to_id", "oneway", "restriction", "name")


@query("S13_children_of_parents", """SELECT e.icao, from_id, to_id, z AS runway FROM b_edge e, unnest(['09L', CASE WHEN eid % 36 < 10 THEN '0' ELSE '' END || cast(eid % 36 AS string)]) u(z) WHERE eid % 10 = 1""")
def s13(t):
    ln = lines(t, 10)
    return scenery.active_zones(ln).join(scenery.route_edges(ln), ["icao", "eid"]).select("icao", "from_id", "to_id", "runway")


@query("S13_stand_details", """SELECT icao, CASE WHEN sid % 4 > 0 THEN 'Stand ' || sid ELSE '' END AS name, CASE sid % 3 WHEN 0 THEN 'gate' WHEN 1 THEN 'tie_down' ELSE 'misc' END AS kind, CASE WHEN sid % 2 = 0 THEN 'C' END AS size_code, CASE WHEN sid % 2 = 0 THEN 'DAL ' || CASE WHEN sid % 8 = 0 THEN 'AAL' ELSE 'KLM' END ELSE '' END AS airlines FROM b_stand""")
def s13b(t):
    return scenery.stands(lines(t, 8)).select("icao", "name", "kind", "size_code", F.array_join("airlines", " ").alias("airlines"))


@query("S14_header_values", "SELECT icao, iata, name, city, country, elev_ft, CASE WHEN k % 3 > 0 THEN round(lat*100)/100 END AS lat, CASE WHEN k % 3 > 0 THEN round(lon*100)/100 END AS lon FROM b_airport WHERE true")
def s14(t):
    return scenery.headers(lines(t, 1)).select("icao", "iata", "name", "city", "country", "elev_ft", "lat", "lon")


# ---- map elements -------------------------------------------------------------------------

def xml_docs(t):
    """Node elements as XML text, entities escaped."""
    kv = F.transform(F.map_entries("tags"), lambda e: F.concat(F.lit('<tag k="'), e["key"], F.lit('" v="'), F.replace(F.concat(e["value"], F.lit(" & co")), F.lit("&"), F.lit("&amp;")), F.lit('"/>')))
    return elements(t).select("eid", "m", F.concat(F.lit('<node id="'), s("eid"), F.lit('" lat="'), deg(F.col("y")), F.lit('" lon="'), deg(F.col("x")), F.lit('">'), F.array_join(kv, ""), F.lit("</node>")).alias("value"))


@query("S15_element_xml", f"""SELECT eid, {r('y/100000', 5)} AS lat, {pick_sql('m', [len(d) for d in TAGSETS])} AS tags, {pick_sql('m', [(d['aeroway'] + ' & co') if 'aeroway' in d else None for d in TAGSETS])} AS aeroway FROM b_element""")
def s15(t):
    n = xml_docs(t).select("m", F.from_xml("value", osm.XML_SCHEMAS["node"]).alias("n")).select("m", "n.*")
    return n.select(F.col("_id").alias("eid"), rnd("_lat", 5).alias("lat"), F.size(osm._tag_map("tag")).alias("tags"), osm._tag_map("tag")["aeroway"].alias("aeroway"))


@query("S16_element_json", """SELECT icao, CASE WHEN k % 9 = 0 THEN 'runtime error: Query timed out' WHEN k % 9 = 1 THEN 'not an element list' END AS reason, CASE WHEN k % 9 > 1 THEN n ELSE 0 END AS elements FROM b_airport JOIN (SELECT icao, count(*) AS n FROM b_element GROUP BY icao) q USING (icao)""")
def s16(t):
    el = elements(t).groupBy("icao").agg(F.collect_list(F.struct(F.lit("node").alias("type"), F.col("eid").alias("id"), F.col("y").alias("lat"), F.col("x").alias("lon"), "tags")).alias("elements"))
    j = el.join(t.b_airport.select("icao", "k"), "icao")
    remark = F.when(F.col("k") % 9 == 0, "runtime error: Query timed out")
    docs = j.select("icao", F.when(F.col("k") % 9 == 1, "<html>busy</html>").otherwise(F.to_json(F.struct("elements", remark.alias("remark")))).alias("value"))
    ok, bad = osm.elements_from_json(docs)
    n = ok.groupBy("icao").agg(F.count(F.lit(1)).alias("elements"))
    return j.select("icao").join(n, "icao", "left").join(bad, "icao", "left").select("icao", "reason", F.coalesce("elements", F.lit(0)).alias("elements"))


@query("S17_later_tile_wins", "SELECT c_custkey AS id, arg_max(c_acctbal, tile) AS v, max(tile) AS tile FROM (SELECT *, unnest(generate_series(0, c_custkey % 3)) AS tile FROM customer) q GROUP BY 1")
def s17(t):
    e = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c_custkey") % 3)).alias("tile"))
    return osm.latest_elements(e).select("id", "v", "tile")


@query("S19_relevant_elements", "SELECT eid, m NOT IN (8, 13, 7, 17, 10, 23, 11, 12, 21) AS as_node, m NOT IN (17, 19, 21) AS as_way FROM b_element")
def s19(t):
    e = elements(t)
    return e.select("eid", tags.is_relevant("tags", F.lit("node")).alias("as_node"), tags.is_relevant("tags", F.lit("way")).alias("as_way"))


@query("M03_tag_collections", """SELECT eid, CASE m WHEN 0 THEN 'stand' WHEN 1 THEN 'point_structure' WHEN 4 THEN 'header' WHEN 14 THEN 'hold' WHEN 15 THEN 'light' WHEN 16 THEN 'helipad' WHEN 18 THEN 'point_structure' WHEN 19 THEN 'light' WHEN 22 THEN 'point_structure' END AS as_node,
 CASE m WHEN 6 THEN 'taxi_centerline' WHEN 7 THEN 'road_center' WHEN 8 THEN 'line_structure' WHEN 9 THEN 'runway' WHEN 13 THEN 'line_structure' END AS as_line, CASE m WHEN 0 THEN 'stand' WHEN 2 THEN 'apron' WHEN 3 THEN 'deicing' WHEN 4 THEN 'aerodrome' WHEN 5 THEN 'building' WHEN 6 THEN 'taxiway' WHEN 9 THEN 'runway' WHEN 10 THEN 'building'
 WHEN 11 THEN 'water' WHEN 12 THEN 'construction' WHEN 16 THEN 'helipad' WHEN 18 THEN 'building' WHEN 20 THEN 'stopway' WHEN 21 THEN 'service_area' WHEN 23 THEN 'building' END AS as_area FROM b_element""")
def m03(t):
    return elements(t).select("eid", tags.node_collection("tags").alias("as_node"), tags.line_collection("tags").alias("as_line"), tags.area_collection("tags").alias("as_area"))


@query("M03_collection_rows", """WITH c AS (SELECT m, eid, eid % 2 = 0 AS closed FROM b_element) SELECT 'stands' AS collection, count(*) FILTER (WHERE m = 0) AS n FROM c UNION ALL SELECT 'holds', count(*) FILTER (WHERE m = 14) FROM c UNION ALL SELECT 'lights', count(*) FILTER (WHERE m IN (15, 19)) FROM c UNION ALL SELECT 'helipads', count(*) FILTER (WHERE m = 16) FROM c
 UNION ALL SELECT 'point_structures', count(*) FILTER (WHERE m IN (1, 18, 22)) FROM c UNION ALL SELECT 'taxi_centerlines', count(*) FILTER (WHERE m = 6) FROM c UNION ALL SELECT 'runways', count(*) FILTER (WHERE m = 9) FROM c UNION ALL SELECT 'roads', count(*) FILTER (WHERE m = 7) FROM c
 UNION ALL SELECT 'line_structures', count(*) FILTER (WHERE m IN (8, 13)) FROM c UNION ALL SELECT 'buildings', count(*) FILTER (WHERE closed AND m IN (5, 10, 18, 23)) FROM c UNION ALL SELECT 'areas', count(*) FILTER (WHERE closed AND m IN (2, 3, 4, 11, 12, 16, 20, 21)) FROM c UNION ALL SELECT 'headers', count(*) FILTER (WHERE m = 4) FROM c""")
def m03b(t):
    e = F.col("eid")
    n = elements(t).withColumnRenamed("eid", "id")
    w = elements(t).select(e.alias("id"), F.array(e, e + 1, e + 2, F.when(e % 2 == 0, e).otherwise(e + 3)).alias("nodes"), "tags")
    got = osm.osm_collections(n, w)
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("collection"), "n") for k, df in got.items()])


# ---- tables -------------------------------------------------------------------------------

@query("S20_text_index", "SELECT icao, round(lat*100)/100 AS lat, round(lon*100)/100 AS lon, elev_ft, CASE WHEN k % 4 = 0 THEN 18000.0::double END AS trans_alt_ft, CASE WHEN k % 5 > 0 THEN 'FL' || k END AS trans_level FROM b_airport WHERE k % 7 > 0")
def s20(t):
    k = F.col("k")
    full = row(F.lower("icao"), "K2", F.format_string("%.2f", "lat"), F.format_string("%.2f", "lon"), F.col("elev_ft"), "C", "9000", "0", F.when(k % 4 == 0, "18000").otherwise("-1"), F.when(k % 5 > 0, F.concat(F.lit("FL"), s("k"))).otherwise("-1"))
    ln = t.b_airport.select((k + 2).cast("int").alias("line_no"), F.when(k % 7 == 0, row(F.col("icao"), "K2", "1")).otherwise(full).alias("value"))
    head = t.region.filter("r_regionkey < 2").select(F.col("r_regionkey").cast("int").alias("line_no"), F.lit("XAAA K2 1 1 1 1 1 1 1 1").alias("value"))
    return tables.text_index(ln.unionByName(head)).select("icao", "lat", "lon", "elev_ft", "trans_alt_ft", "trans_level")


@query("S21_airport_table", """SELECT CASE k % 3 WHEN 0 THEN icao WHEN 1 THEN 'G' || substr(icao, 2) ELSE 'I' || substr(icao, 2) END AS icao, name, lat, lon, upper(continent) AS continent FROM b_airport WHERE k % 11 > 0 AND length(icao) = 4""")
def s21(t):
    k = F.col("k")
    tail = F.substring("icao", 2, 9)
    df = t.b_airport.select(F.concat(F.lit("I"), tail).alias(" Ident"), F.when(k % 3 < 2, F.concat(F.lit("G"), tail)).otherwise(" ").alias("gps_code"), F.when(k % 3 == 0, F.lower("icao")).alias("icao_code"), "name", F.when(k % 11 > 0, s("lat")).otherwise("n/a").alias("LATITUDE_DEG "), s("lon").alias("longitude_deg"),
                            F.lower("continent").alias("continent"), F.col("kind").alias("type"), F.col("iata").alias("iata_code"))
    return tables.airports(df).select("icao", "name", "lat", "lon", "continent")


@query("S22_runway_table", "SELECT icao, cast(length_ft AS double) AS length_ft, closed, '' AS le_ident FROM b_runway")
def s22(t):
    df = t.b_runway.select(F.lower("icao").alias("airport_ident"), s("length_ft").alias("length_ft"), F.when(F.col("closed"), "1").otherwise("0").alias("closed"))
    return tables.index_runways(df).select("icao", "length_ft", "closed", "le_ident")


@query("S23_scenery_list", """SELECT icao, CASE WHEN k % 2 = 0 THEN 'known' ELSE 'xplane' END AS source, k * 10 AS scenery_id FROM b_airport WHERE k % 2 = 0 OR k % 5 > 0""")
def s23(t):
    k = F.col("k")
    a = F.struct(F.lower("icao").alias("AirportCode"), F.col("name").alias("AirportName"), (k * 10).alias("RecommendedSceneryId"), F.when(k % 5 > 0, F.col("lat")).alias("Latitude"), F.when(k % 5 > 0, F.col("lon")).alias("Longitude"))
    docs = t.b_airport.groupBy("country").agg(F.to_json(F.struct(F.collect_list(a).alias("airports"))).alias("value"))
    idx = t.b_airport.filter("k % 2 = 0").select("icao", "name", "lat", "lon", "elev_ft", F.lit("known").alias("source"))
    return tables.attach_scenery(idx, tables.scenery_list(docs)).select("icao", "source", "scenery_id")


@query("S24_registry_tables", f"""SELECT icao, 'end' AS part, ident0 AS end_key, {r('floor(len)*0.3048')} AS metres FROM b_strip UNION ALL SELECT icao, 'lahso', ident0, {r('1500*0.3048')} FROM b_strip WHERE rid % 4 = 0
 UNION ALL SELECT icao, CASE WHEN rid % 8 = 0 THEN 'EMAS' ELSE 'BAK-12' END, ident0, NULL FROM b_strip WHERE rid % 4 = 0""")
def s24(t):
    base, ends, ars = registry_tables(t)
    base = tables.by_header(base.withColumnsRenamed({"ICAO_ID": " icao_id", "SITE_NO": "Site_No "}), tables.REGISTRY_BASE)
    ends = tables.by_header(ends.drop("LAHSO_DESC"), tables.REGISTRY_ENDS)
    e = conflate.registry_ends(base, ends)
    arr = tables.registry_arresting(base, tables.by_header(ars, tables.REGISTRY_ARRESTING))
    return (e.select("icao", F.lit("end").alias("part"), "end_key", rnd("tora_m", 3).alias("metres")).unionByName(tables.registry_lahso(e).select("icao", F.lit("lahso").alias("part"), F.col("runway_end").alias("end_key"), rnd("available_m", 3).alias("metres")))
            .unionByName(arr.select("icao", F.col("kind").alias("part"), F.col("runway_end").alias("end_key"), F.lit(None).cast("double").alias("metres"))))


def geojson_docs(t):
    """One feature collection per airport: stands as points, pavement as polygons with a hole."""
    sq = lambda d: F.array(*[F.array(F.col("x").cast("double") + a * d, F.col("y").cast("double") + b * d) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    k = F.col("sid") % 3
    geom = (F.when(k == 0, F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("coordinates"))))
            .when(k == 1, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(sq(100), sq(10)).alias("coordinates"))))
            .otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(sq(100)), F.array(sq(50))).alias("coordinates")))))
    props = F.concat(F.lit('{"HOT_ID":'), s("sid"), F.lit(',"SURFACE":"4 ","CS_TEXT":" Caution ","DESIGNATOR":null}'))
    f = t.b_stand.select("icao", F.struct("sid", F.concat(F.lit('{"type":"Feature","id":"f'), s("sid"), F.lit('","geometry":'), geom, F.lit(',"properties":'), props, F.lit("}")).alias("j")).alias("f"))
    return f.groupBy("icao").agg(F.concat(F.lit('{"type":"FeatureCollection","replace":true,"features":['), F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda v: v.j), ","), F.lit("]}")).alias("value"))


@query("S25_feature_collections", """SELECT icao, 'f' || sid AS id, CASE sid % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind, true AS replace, CASE sid % 3 WHEN 0 THEN 1 ELSE 10 END AS vertices, cast(CASE sid % 3 WHEN 0 THEN x WHEN 1 THEN x + 100 ELSE x + 100 END AS double) AS max_x FROM b_stand""")
def s25(t):
    f = geojson.features(geojson_docs(t))
    v = geojson.vertices(f, ["icao", "id", "kind", "replace"])
    return v.groupBy("icao", "id", "kind", "replace").agg(F.count(F.lit(1)).cast("int").alias("vertices"), F.max("x").alias("max_x"))


@query("S26_service_layers", """SELECT icao, CASE WHEN k % 3 = 0 THEN 'hotspot' WHEN k % 3 = 1 THEN 'windsock' ELSE 'apron' END AS target, CASE WHEN k % 3 = 0 THEN 'HS' || sid END AS name, CASE WHEN k % 3 = 2 THEN 4 END AS surface, CASE WHEN k % 3 = 0 THEN 'Caution' END AS reference FROM b_stand JOIN b_airport USING (icao)
 WHERE k % 10 > 0 AND CASE WHEN k % 3 = 1 THEN sid % 3 = 0 ELSE sid % 3 > 0 END""")
def s26(t):
    k = F.col("k")
    docs = geojson_docs(t).join(t.b_airport.select("icao", "k"), "icao")
    docs = docs.select("icao", F.when(k % 3 == 0, "AM_Hotspot").when(k % 3 == 1, "AM_Wind_Indicator").otherwise("AM_Apron").alias("service"), F.when(k % 10 == 0, '{"error":{"code":400}}').otherwise(F.col("value")).alias("value"))
    return geojson.service_rows(geojson.features(docs)).select("icao", "target", "name", "surface", "reference")


@query("S27_override_files", """SELECT icao, CASE WHEN k % 4 = 3 THEN 'unknown layer name' ELSE CASE k % 4 WHEN 0 THEN 'hotspot' WHEN 1 THEN 'surveycontrolpoint' ELSE 'water' END END AS layer, CASE WHEN k % 4 = 3 THEN 1 ELSE n END AS n FROM b_airport JOIN (SELECT icao, count(*) AS n FROM b_stand GROUP BY icao) q USING (icao)""")
def s27(t):
    k = F.col("k")
    d = geojson_docs(t).join(t.b_airport.select("icao", "k"), "icao")
    name = F.when(k % 4 == 0, "hotspot.geojson").when(k % 4 == 1, "SurveyControlPoint.json").when(k % 4 == 2, "water.GeoJSON").otherwise("lava.geojson")
    known, unknown = geojson.override_files(d.select(F.concat(F.lit("file:/overrides/"), F.lower("icao"), F.lit("/"), name).alias("path"), "value"), codes.layer_registry(t.spark))
    return known.groupBy("icao", "layer").agg(F.count(F.lit(1)).alias("n")).unionByName(unknown.select("icao", F.col("warning").alias("layer"), F.lit(1).cast("bigint").alias("n")))


@query("S28_code_lists", """SELECT country AS path, icao, cast(row_number() OVER (PARTITION BY country ORDER BY k) AS int) AS pos FROM b_airport WHERE length(icao) <= 4""")
def s28(t):
    g = t.b_airport.groupBy("country").agg(F.array_sort(F.collect_list(F.struct("k", "icao", "name"))).alias("l"))
    n = F.substring("country", -1, 1).cast("int")
    csv = F.concat(F.lit("name,ICAO,x\n"), F.array_join(F.transform("l", lambda v: F.concat(F.lit("n,"), F.lower(v.icao), F.lit(",1"))), "\n"))
    free = F.concat(F.lit("# my airports XXXX\n"), F.array_join(F.transform("l", lambda v: F.concat(v.icao, F.lit(" ; # note ABCD\n, "))), ""))
    return tables.code_list(g.select(F.col("country").alias("path"), F.when(n % 2 == 0, csv).otherwise(free).alias("value"))).select("path", "icao", "pos")


@query("S29_flight_plans", """WITH p AS (SELECT o_orderkey AS id, 'A' || lpad(cast(o_orderkey % 900 AS string), 3, '0') AS o, 'B' || lpad(cast(o_custkey % 900 AS string), 3, '0') AS d, CASE WHEN o_orderkey % 3 = 0 THEN ['A' || lpad(cast(o_orderkey % 900 AS string), 3, '0'), 'C000'] WHEN o_orderkey % 3 = 1 THEN ['D111'] ELSE [] END AS alt FROM orders WHERE o_orderkey % 10 > 0),
c AS (SELECT id, o, d, CASE WHEN o_orderkey3 = 0 THEN 'C000' WHEN o_orderkey3 = 1 THEN 'D111' END AS a FROM (SELECT *, id % 3 AS o_orderkey3 FROM p) q)
SELECT id, 0 AS pos, o AS icao FROM c UNION ALL SELECT id, 1, d FROM c UNION ALL SELECT id, 2, a FROM c WHERE a IS NOT NULL UNION ALL SELECT o_orderkey, -1, 'rejected: Fail' FROM orders WHERE o_orderkey % 10 = 0""")
def s29(t):
    k = F.col("o_orderkey")
    o = F.concat(F.lit("A"), F.lpad(s(k % 900), 3, "0"))
    d = F.concat(F.lit("B"), F.lpad(s(F.col("o_custkey") % 900), 3, "0"))
    j = lambda v: F.concat(F.lit('{"icao_code":"'), v, F.lit('"}'))
    alt = F.when(k % 3 == 0, F.concat(F.lit(',"alternate":['), j(o), F.lit(","), j(F.lit("c000")), F.lit("]"))).when(k % 3 == 1, F.concat(F.lit(',"alternate":'), j(F.lit("D111")))).otherwise("")
    docs = t.orders.select(k.alias("id"), F.concat(F.lit('{"fetch":{"status":"'), F.when(k % 10 == 0, "Fail").otherwise("Success"), F.lit('"},"origin":'), j(o), F.lit(',"destination":'), j(d), alt, F.lit("}")).alias("value"))
    ok, bad = tables.flight_plans(docs)
    return ok.select("id", "pos", "icao").unionByName(bad.select("id", F.lit(-1).alias("pos"), F.concat(F.lit("rejected: "), "reason").alias("icao")))


