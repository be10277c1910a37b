"""Filters, equi-joins, aggregations, windows, search and set operations (F, J, A, W, T, U)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes, geo, tags
from ..functions.geo import rnd
from ..operators import conflate, measure, ordered, select
from .registry import query
from .scalar import SEGS, TAGSETS, _pick, elements, pick_sql, r, vertex_segments

KM = "2*6371.0088*asin(sqrt(least(1.0, power(sin(({2}-{0})/2),2)+cos({0})*cos({2})*power(sin(({3}-{1})/2),2))))"


def km_sql(lat1, lon1, lat2, lon2):
    return KM.format(f"radians({lat1})", f"radians({lon1})", f"radians({lat2})", f"radians({lon2})")


STATS = """stats AS (SELECT icao, count(*) FILTER (WHERE NOT closed) AS n_open, max(length_ft) FILTER (WHERE NOT closed) AS longest_ft FROM b_runway GROUP BY icao),
idx AS (SELECT a.*, n_open, longest_ft FROM b_airport a LEFT JOIN stats s ON s.icao = a.icao)"""


@query("FLAGSHIP_airport_neighbours", f"""WITH {STATS}, d AS (SELECT a.icao, b.icao AS other, {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM b_airport a JOIN b_airport b ON a.icao <> b.icao),
n AS (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY km, other) AS rn FROM d WHERE km <= 3000)
SELECT i.icao, n_open, longest_ft, other, cast(rn AS int) AS rank, {r('km / 1.852', 2)} AS distance_nm FROM idx i LEFT JOIN n ON n.icao = i.icao AND rn <= 3""")
def flagship(t):
    a = t.b_airport
    near = select.nearest_airports(a.withColumnRenamed("icao", "pid"), a, 3000, 4)
    near = near.filter(F.col("pid") != F.col("icao")).select("pid", "icao", "km", "distance_nm")
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("pid").orderBy("km", "icao"))).filter("rank <= 3")
    return (select.with_stats(a.select("icao"), t.b_runway)
            .join(near.select(F.col("pid").alias("icao"), F.col("icao").alias("other"), "rank", "distance_nm"), "icao", "left"))


CRITERIA = {"country": "NATION_3", "countries": ["nation_1", "NATION_2"], "continents": ["asia", "EUROPE"], "min_runways": 18, "region": "nation_4-",
            "prefix": "x00", "near": (10.0, 20.0, 5000.0), "bbox": (-60.0, -40.0, 60.0, 40.0), "kinds": ["large", "medium"], "min_runway_ft": 11000,
            "iata": ["i3", "I99"], "search": "international", "all": True}


@query("F01_selection_criteria", f"""WITH {STATS} SELECT icao, upper(country) = 'NATION_3' AS country, upper(country) IN ('NATION_1','NATION_2') AS countries, upper(continent) IN ('ASIA','EUROPE') AS continents,
 coalesce(n_open >= 18, false) AS min_runways, region LIKE 'NATION_4-%' AS region, icao LIKE 'X00%' AS prefix, {km_sql('10', '20', 'lat', 'lon')} <= 5000 AS near,
 lon BETWEEN -60 AND 60 AND lat BETWEEN -40 AND 40 AS bbox, kind IN ('large_airport','medium_airport') AS kinds, coalesce(longest_ft >= 11000, false) AS min_runway_ft,
 coalesce(iata IN ('I3','I99'), false) AS iata, name LIKE '%International%' AS search, true AS "all" FROM idx""")
def f01(t):
    df = select.with_stats(t.b_airport, t.b_runway)
    return df.select("icao", *[select.criterion(n, v).alias(n) for n, v in CRITERIA.items()])


@query("F01_selection_combined", f"""WITH {STATS} SELECT icao FROM idx WHERE kind IN ('large_airport','medium_airport') AND n_open >= 15 AND longest_ft >= 9000 AND lat BETWEEN -60 AND 60""")
def f01b(t):
    return select.select_airports(t.b_airport, t.b_runway, kinds=["large", "medium"], min_runways=15, min_runway_ft=9000, bbox=(-180, -60, 180, 60)).select("icao")


@query("F02_exclusions", """SELECT icao FROM b_airport a WHERE NOT EXISTS (SELECT 1 FROM (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'x' || lpad(cast(s_suppkey AS string), greatest(3, length(cast(s_suppkey AS string)))::int, '0')
 WHEN s_suppkey = 41 THEN 'X04' END AS e FROM supplier) q WHERE CASE WHEN length(e) >= 4 THEN a.icao = upper(e) ELSE a.icao LIKE upper(e) || '%' END)""")
def f02(t):
    e = t.b_airport.select(F.when(F.col("k") % 9 == 0, F.lower("icao")).when(F.col("k") == 41, F.lit("X04")).alias("entry")).dropna()
    return select.exclude(t.b_airport.select("icao"), e)


@query("F03_area_list", f"""WITH {STATS} SELECT icao FROM idx WHERE n_open >= 5 AND kind IN ('large_airport','medium_airport') AND longest_ft >= 8000 AND (upper(continent) IN ('AS','EU') OR upper(country) IN ('NATION_7'))""")
def f03(t):
    idx = t.b_airport.withColumn("continent", F.when(F.col("continent") == "ASIA", "as").when(F.col("continent") == "EUROPE", "EU").otherwise("NA"))
    return select.select_areas(idx, t.b_runway, ["Asia", "eu", "nation_7"], ["large", "medium"], 5, 8000).select("icao")


# The views keep full continent names, so the twin states them.
from . import registry as _registry, views as _views  # noqa: E402
_registry.ORACLES["F03_area_list"] = _views.with_views(f"""WITH {STATS} SELECT icao FROM idx WHERE n_open >= 5 AND kind IN ('large_airport','medium_airport') AND longest_ft >= 8000
 AND (continent IN ('ASIA','EUROPE') OR country = 'NATION_7')""")


@query("F04_degenerate_runways", """SELECT icao, rid, CASE WHEN width_m < 1 OR len < 30 THEN 'runway ' || ident0 || '/' || ident1 || ' degenerate, skipped' END AS warning FROM b_strip""")
def f04(t):
    from ..operators.runway import drop_degenerate
    kept, rejects = drop_degenerate(t.b_strip)
    return kept.select("icao", "rid", F.lit(None).cast("string").alias("warning")).unionByName(rejects.select("icao", "rid", "warning"))


@query("F05_minimum_areas", """SELECT icao, pid, CASE WHEN a >= 5 THEN len(list_filter([2.0, 4.0, 5.0, 400.0, 500.0], lambda k: a >= k)) ELSE 0 END AS passed
 FROM (SELECT icao, pid, len*wid/20 AS a FROM b_pavement) q""")
def f05(t):
    from ..operators.pavement import MIN_AREAS, big_enough
    df = t.b_pavement.withColumn("a", F.col("len") * F.col("wid") / 20)
    keep = ["pavement", "road", "shoulder", "construction", "osm_apron"]
    assert set(keep) <= set(MIN_AREAS)
    n = sum((big_enough("a", k).cast("int") for k in keep[1:]), big_enough("a", keep[0]).cast("int"))
    return df.select("icao", "pid", n.cast("bigint").alias("passed"))


_registry.ORACLES["F05_minimum_areas"] = _views.with_views("""SELECT icao, pid, cast((a >= 2)::int + (a >= 4)::int + (a >= 5)::int + (a > 400)::int + (a > 500)::int AS bigint) AS passed
 FROM (SELECT icao, pid, len*wid/20 AS a FROM b_pavement) q""")


@query("F06_airside_roads", "SELECT eid, m = 7 AS road FROM b_element")
def f06(t):
    return elements(t).select("eid", tags.is_airside_road("tags").alias("road"))


@query("F07_closed_way_is_area", "SELECT eid, eid % 2 = 0 AND m NOT IN (6, 7, 8, 9, 13, 17) AS area FROM b_element")
def f07(t):
    e = F.col("eid")
    nodes = F.array(e, e + 1, e + 2, F.when(e % 2 == 0, e).otherwise(e + 3))
    return elements(t).select("eid", tags.is_area("tags", nodes).alias("area"))


@query("F10_outlier_vertices", "SELECT icao, fid, seq FROM b_vertex WHERE abs(x*80) <= 20000 AND abs(y*80) <= 20000")
def f10(t):
    from ..operators.maps import drop_outliers
    return drop_outliers(t.b_vertex.withColumn("x", F.col("x") * 80).withColumn("y", F.col("y") * 80)).select("icao", "fid", "seq")


@query("F11_small_buildings", "SELECT pid FROM b_pavement WHERE len*wid >= 6000 OR pid % 10 < 8 OR pid % 7 = 1")
def f11(t):
    from ..operators.maps import depicted_buildings
    b = t.b_pavement.select("pid", (F.col("len") * F.col("wid") / 20).alias("area"), "name", (F.col("pid") % 7).alias("plysttyp"))
    return depicted_buildings(b).select("pid")


RUNS = """b1 AS (SELECT *, lag(line) OVER (PARTITION BY icao, fid ORDER BY seq) AS pl FROM segs),
runs AS (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> line THEN 1 ELSE 0 END) OVER (PARTITION BY icao, fid ORDER BY seq) AS run FROM b1)"""


def painted_runs(t):
    v = t.b_vertex.select("icao", "fid", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "line", F.lit(0).alias("light"))
    return measure.coded_runs(v, ["icao", "fid"])


@query("W05_coded_runs", f"""WITH {SEGS}, {RUNS} SELECT icao, fid, cast(run AS bigint) AS run, line, count(*) AS segments, {r('sum(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))/7')} AS length
 FROM runs WHERE line <> 0 GROUP BY icao, fid, run, line""")
def w05(t):
    return painted_runs(t).groupBy("icao", "fid", "run", "line").agg(F.count(F.lit(1)).alias("segments"), rnd(F.sum(geo.dist("ax", "ay", "bx", "by")) / 7, 3).alias("length"))


@query("W05_closed_rings", """WITH v AS (SELECT icao, fid, seq, line, count(*) OVER (PARTITION BY icao, fid) AS n FROM b_vertex),
b1 AS (SELECT *, lag(line) OVER (PARTITION BY icao, fid ORDER BY seq) AS pl FROM v WHERE n >= 2),
r0 AS (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> line THEN 1 ELSE 0 END) OVER (PARTITION BY icao, fid ORDER BY seq) AS run FROM b1),
e AS (SELECT icao, fid, max(run) AS last, arg_min(line, seq) AS la, arg_max(line, seq) AS lz FROM r0 GROUP BY icao, fid),
w AS (SELECT r0.icao, r0.fid, line, CASE WHEN run = last AND last > 1 AND la = lz AND line <> 0 THEN 1 ELSE run END AS run FROM r0 JOIN e ON e.icao = r0.icao AND e.fid = r0.fid)
SELECT icao, fid, cast(run AS bigint) AS run, line, count(*) AS segments FROM w WHERE line <> 0 GROUP BY icao, fid, run, line""")
def w05c(t):
    v = t.b_vertex.select("icao", "fid", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "line", F.lit(0).alias("light"))
    return measure.coded_runs(v, ["icao", "fid"], closed=True).groupBy("icao", "fid", "run", "line").agg(F.count(F.lit(1)).alias("segments"))


@query("F12_short_runs", f"""WITH {SEGS}, {RUNS}, q AS (SELECT icao, fid, run, line, sum(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))/400) AS length FROM runs WHERE line <> 0 GROUP BY icao, fid, run, line)
SELECT icao, fid, cast(run AS bigint) AS run, line FROM q WHERE length > 0.2""")
def f12(t):
    from ..operators.lines import keep_runs
    runs = painted_runs(t).groupBy("icao", "fid", "run", "line").agg(F.sum(geo.dist("ax", "ay", "bx", "by") / 400).alias("length"))
    return keep_runs(runs.withColumn("light", F.lit(0))).select("icao", "fid", "run", "line")


@query("F13_layer_subset", """SELECT layer, fid FROM b_feature WHERE layer IN ('asrnnode', 'runwayelement', 'taxiwayelement')""")
def f13(t):
    from ..operators.lookups import pick_layers
    reg = pick_layers(codes.layer_registry(t.spark), "map", include=None, exclude=["parkingstandlocation"])
    return t.b_feature.join(F.broadcast(reg.select("layer")), "layer", "left_semi").select("layer", "fid")


@query("F14_not_built", """SELECT a.icao, CASE WHEN k % 5 = 1 THEN 'retry' ELSE 'new' END AS state FROM b_airport a WHERE k % 5 > 0 AND NOT EXISTS (SELECT 1 FROM b_stand s WHERE s.icao = a.icao AND s.sid % 3 = 0 AND k % 5 > 1)""")
def f14(t):
    from ..operators.progress import not_built
    manifest = t.b_stand.filter("sid % 3 = 0").select("icao").distinct().join(t.b_airport.select("icao", "k"), "icao").filter("k % 5 <> 1").select("icao")
    manifest = manifest.unionByName(t.b_airport.filter("k % 5 = 0").select("icao")).distinct()
    log = t.b_airport.select("icao", F.when(F.col("k") % 5 == 1, "failed").alias("error"))
    return not_built(t.b_airport.select("icao"), manifest, log)


# ---- equi joins ---------------------------------------------------------------------------

EDGE_POS = """ep AS (SELECT e.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM b_edge e JOIN b_node a ON a.icao = e.icao AND a.nid = from_id JOIN b_node b ON b.icao = e.icao AND b.nid = to_id)"""


def edge_positions(t):
    from ..operators.network import edge_positions as pos
    return pos(t.b_edge, t.b_node)


@query("J01_edge_positions", f"""WITH {EDGE_POS} SELECT icao, eid, (x0+x1)/2 AS mx, (y0+y1)/2 AS my FROM ep""")
def j01(t):
    return edge_positions(t).select("icao", "eid", ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my"))


def ways(t):
    """Ways over the node table, one per order: four nodes, one unknown, some closed."""
    n = t.supplier.select(F.count(F.lit(1))).scalar()
    c0 = F.col("o_custkey")
    nodes = F.array(c0, c0 + n, F.lit(-1), c0 + 2 * n, F.when(F.col("o_orderkey") % 2 == 0, c0).otherwise(c0 + 3 * n))
    return t.orders.select(F.col("o_orderkey").alias("way"), nodes.alias("nodes"))


WAYS = """ways AS (SELECT o_orderkey AS way, [o_custkey, o_custkey + n, -1, o_custkey + 2*n, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 3*n END] AS nodes
 FROM (SELECT *, (SELECT count(*) FROM supplier) AS n FROM orders) q),
wv AS (SELECT way, pos - 1 AS pos, x, y FROM (SELECT way, generate_subscripts(nodes, 1) AS pos, unnest(nodes) AS nid FROM ways) u JOIN b_node USING (nid))"""


@query("J02_way_vertices", f"WITH {WAYS} SELECT way, cast(row_number() OVER (PARTITION BY way ORDER BY pos) AS int) AS seq, x, y FROM wv")
def j02(t):
    from ..sources.osm import way_vertices
    return way_vertices(ways(t), t.b_node.select("nid", "x", "y")).select("way", "seq", "x", "y")


def registry_tables(t):
    """Registry tables in the published column names, from the derived runways."""
    base = t.b_airport.select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("SITE_NO"), F.col("icao").alias("ICAO_ID"), F.concat(F.lit("F"), F.col("k").cast("string")).alias("ARPT_ID"))
    s = t.b_strip.join(t.b_airport.select("icao", "k"), "icao").withColumn("SITE_NO", F.concat(F.lit("S"), F.col("k").cast("string")))
    ft = lambda v: F.floor(F.col("len") + v).cast("bigint").cast("string")
    blank = F.lit("")
    ends = s.select("SITE_NO", "rid", F.regexp_replace("ident0", "^0", "").alias("RWY_END_ID"), ft(0).alias("TKOF_RUN_AVBL"), ft(100).alias("TKOF_DIST_AVBL"),
                    F.when(F.col("rid") % 2 == 0, ft(50)).otherwise(ft(0)).alias("ACLT_STOP_DIST_AVBL"), F.when(F.col("rid") % 3 == 0, blank).otherwise(ft(-200)).alias("LNDG_DIST_AVBL"),
                    F.when(F.col("rid") % 4 == 0, F.lit("1500")).otherwise(blank).alias("LAHSO_ALD"), F.when(F.col("rid") % 8 == 0, "9l").alias("RWY_END_INTERSECT_LAHSO"), F.lit("point").alias("LAHSO_DESC"),
                    F.lit("12.5").alias("TDZ_ELEV"))
    ars = s.filter("rid % 4 = 0").select("SITE_NO", "rid", F.col("ident0").alias("RWY_END_ID"), F.when(F.col("rid") % 8 == 0, "EMAS").otherwise("BAK-12").alias("ARREST_DEVICE_CODE"))
    return base, ends, ars


@query("J03_registry_ends", f"""SELECT icao, rid, ident0 AS end_key, {r('floor(len)*0.3048')} AS tora_m, {r('floor(len+100)*0.3048')} AS toda_m, CASE WHEN rid % 2 = 0 THEN {r('floor(len+50)*0.3048')} ELSE {r('floor(len)*0.3048')} END AS asda_m,
 CASE WHEN rid % 3 <> 0 THEN {r('floor(len-200)*0.3048')} END AS lda_m, CASE WHEN rid % 2 = 0 THEN {r('50*0.3048')} END AS stopway_m, CASE WHEN rid % 8 = 0 THEN '09L' ELSE 'point' END AS crossing FROM b_strip""")
def j03(t):
    base, ends, _ = registry_tables(t)
    e = conflate.registry_ends(base, ends.withColumnRenamed("rid", "RID")) if False else None
    out = conflate.registry_ends(base, ends)
    # One registry row per runway end: carry the row number through by joining on the designator rank.
    del e
    return out.select("icao", "end_key", *[rnd(n, 3).alias(n) for n in ("tora_m", "toda_m", "asda_m", "lda_m", "stopway_m")], "crossing")


_registry.ORACLES["J03_registry_ends"] = _registry.ORACLES["J03_registry_ends"].replace("SELECT icao, rid, ident0 AS end_key", "SELECT icao, ident0 AS end_key")


def strip_ends(t):
    """Both ends of each derived runway, one row per end."""
    from ..operators.runway import runway_ends
    return runway_ends(t.b_strip)


@query("J04_enrich_ends", f"""WITH e AS (SELECT icao, rid, 0 AS end_no, ident0 AS ident, tora0 AS tora, stopway0 AS sw, tdze0 AS tdze FROM b_strip UNION ALL SELECT icao, rid, 1, ident1, NULL, stopway1, NULL FROM b_strip),
g AS (SELECT icao, ident0 AS k, max(floor(len)*0.3048) AS tora, max(CASE WHEN rid % 2 = 0 THEN 50*0.3048 END) AS sw FROM b_strip GROUP BY icao, ident0)
SELECT e.icao, rid, end_no, {r('CASE WHEN g.k IS NOT NULL THEN g.tora ELSE e.tora END')} AS tora_m, {r('coalesce(g.sw, e.sw)')} AS stopway_m, CASE WHEN g.k IS NOT NULL THEN 12.5 ELSE e.tdze END AS tdze_ft
FROM e LEFT JOIN g ON g.icao = e.icao AND g.k = e.ident""")
def j04(t):
    base, ends, _ = registry_tables(t)
    reg = conflate.registry_ends(base, ends).groupBy("icao", "end_key").agg(*[F.max(n).alias(n) for n in ("tora_m", "toda_m", "asda_m", "lda_m", "stopway_m", "tdze_ft")])
    return conflate.enrich_ends(strip_ends(t), reg).select("icao", "rid", "end_no", rnd("tora_m", 3).alias("tora_m"), rnd("stopway_m", 3).alias("stopway_m"), "tdze_ft")


@query("J05_merge_index", """SELECT a.icao, CASE WHEN k % 3 <> 0 THEN 'aptmeta' ELSE 'ourairports' END AS source, CASE WHEN k % 3 <> 0 THEN k % 2 ELSE k % 7 END AS region,
 CASE WHEN k % 5 <> 0 THEN name END AS name, CASE WHEN k % 3 <> 0 AND k % 4 = 0 THEN elev_ft WHEN k % 5 <> 0 THEN elev_ft + 1 END AS elev_ft FROM b_airport a WHERE k % 3 <> 0 OR k % 5 <> 0""")
def j05(t):
    a = t.b_airport.filter("k % 3 <> 0").select("icao", F.lit("aptmeta").alias("source"), (F.col("k") % 2).alias("region"), F.lit(None).cast("string").alias("name"), F.when(F.col("k") % 4 == 0, F.col("elev_ft")).alias("elev_ft"))
    b = t.b_airport.filter("k % 5 <> 0").select("icao", F.lit("ourairports").alias("source"), (F.col("k") % 7).alias("region"), "name", (F.col("elev_ft") + 1).alias("elev_ft"))
    return conflate.merge_index(a, b, fill=["name", "elev_ft"], keep=["source", "region"])


def light_objects(t):
    """Visual aids tied to runway ends by designator; every fifth runway has none."""
    return t.b_strip.filter("rid % 5 > 0").select("icao", F.col("rid").alias("line_no"), F.lower("ident0").alias("runway"), (F.col("rid") % 5).cast("int").alias("kind"))


@query("J06_visual_aids", """WITH l AS (SELECT icao, ident0 AS k, arg_min(rid % 5, rid) FILTER (WHERE rid % 5 IN (1,2,3)) AS kind FROM b_strip WHERE rid % 5 > 0 GROUP BY icao, ident0)
SELECT s.icao, rid, cast(kind AS int) AS vasis FROM b_strip s LEFT JOIN l ON l.icao = s.icao AND l.k = s.ident0""")
def j06(t):
    from ..operators.runway import attach_visual_aid
    ends = t.b_strip.select("icao", "rid", F.col("ident0").alias("ident"))
    return attach_visual_aid(ends, light_objects(t)).select("icao", "rid", "vasis")


@query("J08_relation_members", f"""WITH {WAYS} SELECT way // 3 AS relation, CASE WHEN way % 3 = 2 THEN 'inner' ELSE 'outer' END AS role, count(*) AS vertices, cast(sum(x) AS bigint) AS sum_x
 FROM wv WHERE way % 3 < 3 GROUP BY 1, 2""")
def j08(t):
    from ..sources.osm import relation_vertices
    w = ways(t)
    member = F.struct(F.lit("way").alias("type"), F.col("way").alias("ref"), F.when(F.col("way") % 3 == 2, "inner").otherwise("outer").alias("role"))
    rel = w.groupBy(F.floor(F.col("way") / 3).alias("relation")).agg(F.collect_list(member).alias("members"))
    v = relation_vertices(rel, w, t.b_node.select("nid", "x", "y"))
    return v.groupBy("relation", "role").agg(F.count(F.lit(1)).alias("vertices"), F.sum("x").alias("sum_x"))


@query("J24_referential_check", "SELECT eid, 'ennode' AS side FROM b_edge e WHERE NOT EXISTS (SELECT 1 FROM b_node n WHERE n.nid = e.to_id + e.eid % 2 * 900000000)")
def j24(t):
    from ..operators.validate import missing_nodes
    e = t.b_edge.select("icao", "eid", F.col("from_id").alias("stnode"), (F.col("to_id") + F.col("eid") % 2 * 900000000).alias("ennode"))
    return missing_nodes(e, t.b_node.select("icao", F.col("nid").alias("nodeid"))).select("eid", "side")


@query("J26_airports_in_radius", f"""WITH q AS (SELECT event_id, l.lat, l.lon, icao, {km_sql('l.lat', 'l.lon', 'a.lat', 'a.lon')} AS km FROM b_runlog l CROSS JOIN b_airport a WHERE abs(l.lat - a.lat) <= 15),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, icao) AS rn FROM q WHERE km <= 1500)
SELECT event_id, icao, cast(rn AS int) AS rank, {r('km/1.852', 2)} AS distance_nm FROM k WHERE rn <= 4""")
def j26(t):
    return (select.nearest_airports(t.b_runlog.withColumnRenamed("event_id", "pid"), t.b_airport, 1500, 4)
            .select(F.col("pid").alias("event_id"), "icao", "rank", "distance_nm"))


# ---- aggregations -------------------------------------------------------------------------

@query("A01_feature_counts", "SELECT coalesce(icao, '*') AS icao, coalesce(layer, '*') AS layer, count(*) AS n FROM b_feature GROUP BY ROLLUP (icao, layer)")
def a01(t):
    from ..operators.manifest import feature_counts
    return feature_counts(t.b_feature)


@query("A02_layer_sources", "SELECT icao, layer, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM b_feature GROUP BY icao, layer")
def a02(t):
    from ..operators.manifest import layer_sources
    return layer_sources(t.b_feature).select("icao", "layer", F.array_join("sources", "+").alias("sources"))


@query("A03_warning_lists", """SELECT icao, count(*) AS n, string_agg('runway ' || ident0 || '/' || ident1 || ' degenerate, skipped', '; ' ORDER BY rid) AS warnings FROM b_strip WHERE width_m < 1 GROUP BY icao""")
def a03(t):
    from ..operators.manifest import message_lists
    from ..operators.runway import drop_degenerate
    _, rejects = drop_degenerate(t.b_strip)
    m = message_lists(rejects.select("icao", F.col("rid").alias("seq"), F.col("warning").alias("message")))
    return m.select("icao", F.size("messages").cast("bigint").alias("n"), F.array_join("messages", "; ").alias("warnings"))


BOX = """pos AS (SELECT icao, lon, lat FROM (SELECT v.icao, a.lon + v.x/1000000.0::double AS lon, a.lat + v.y/1000000.0::double AS lat FROM b_stand v JOIN b_airport a ON a.icao = v.icao WHERE k % 4 > 0
 UNION ALL SELECT v.icao, a.lon + v.x/1000000.0::double, a.lat + v.y/1000000.0::double FROM b_node v JOIN b_airport a ON a.icao = v.icao WHERE k % 4 > 0) q),
box AS (SELECT a.icao, coalesce(min(p.lon), min(a.lon)) AS w, coalesce(min(p.lat), min(a.lat)) AS s, coalesce(max(p.lon), max(a.lon)) AS e, coalesce(max(p.lat), max(a.lat)) AS n, min(a.lat) AS lat, min(a.lon) AS lon,
 count(p.lon) > 0 AS mapped FROM b_airport a LEFT JOIN pos p ON p.icao = a.icao GROUP BY a.icao)"""


def airport_boxes(t):
    from ..operators.manifest import airport_bbox
    a = t.b_airport.select("icao", "k", "lat", "lon")
    parts = []
    for src in (t.b_stand, t.b_node):
        p = src.join(a, "icao").filter("k % 4 > 0")
        parts.append(p.select("icao", (F.col("lon") + F.col("x") / 1000000.0).alias("lon"), (F.col("lat") + F.col("y") / 1000000.0).alias("lat")))
    return airport_bbox(a.select("icao", "lat", "lon"), *parts)


@query("A04_bounding_box", f"WITH {BOX} SELECT icao, {r('w', 7)} AS west, {r('s', 7)} AS south, {r('e', 7)} AS east, {r('n', 7)} AS north FROM box")
def a04(t):
    return airport_boxes(t).select("icao", *[rnd(n, 7).alias(n) for n in ("west", "south", "east", "north")])


@query("A05_query_box", f"""WITH {BOX}, q AS (SELECT *, CASE WHEN mapped THEN 0.0045 ELSE 3/111.195 END AS dlat FROM box), z AS (SELECT *, dlat / greatest(cos(radians(lat)), 0.2) AS dlon FROM q)
SELECT icao, {r('CASE WHEN mapped THEN w ELSE lon END - dlon', 6)} AS west, {r('CASE WHEN mapped THEN s ELSE lat END - dlat', 6)} AS south, {r('CASE WHEN mapped THEN e ELSE lon END + dlon', 6)} AS east, {r('CASE WHEN mapped THEN n ELSE lat END + dlat', 6)} AS north FROM z""")
def a05(t):
    from ..operators.manifest import query_box
    return query_box(airport_boxes(t), 3.0).select("icao", *[rnd(n, 6).alias(n) for n in ("west", "south", "east", "north")])


@query("A06_runway_stats", f"WITH {STATS} SELECT icao, n_open, longest_ft FROM stats")
def a06(t):
    return select.runway_stats(t.b_runway)


@query("A07_reference_point", f"""SELECT a.icao, {r('CASE WHEN k % 3 = 0 THEN lat ELSE my END', 4)} AS y, {r('CASE WHEN k % 3 = 0 THEN lon ELSE mx END', 4)} AS x, CASE WHEN k % 3 = 0 THEN 'published' ELSE 'runway' END AS basis FROM b_airport a LEFT JOIN
 (SELECT icao, arg_max((x0+x1)/2, len*1000000 - rid) AS mx, arg_max((y0+y1)/2, len*1000000 - rid) AS my FROM b_strip GROUP BY icao) q ON q.icao = a.icao""")
def a07(t):
    from ..operators.manifest import reference_point
    hdr = t.b_airport.select("icao", F.when(F.col("k") % 3 == 0, F.col("lat")).alias("lat"), F.when(F.col("k") % 3 == 0, F.col("lon")).alias("lon"))
    ends = t.b_strip.select("icao", "rid", F.col("ax").alias("alon"), F.col("ay").alias("alat"), F.col("bx").alias("blon"), F.col("by").alias("blat"))
    return reference_point(hdr, ends, None).select("icao", rnd("lat", 4).alias("y"), rnd("lon", 4).alias("x"), "basis")


@query("A08_line_measures", f"""WITH {SEGS}, l AS (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS len FROM segs), k AS (SELECT *, sum(len) OVER (PARTITION BY icao, fid ORDER BY seq) AS cum, sum(len) OVER (PARTITION BY icao, fid) AS total FROM l),
h AS (SELECT *, row_number() OVER (PARTITION BY icao, fid ORDER BY seq) AS rn, (total/2 - (cum - len))/len AS u FROM k WHERE cum >= total/2 AND len > 0)
SELECT a.icao, a.fid, {r('a.length/7')} AS length7, {r('a.longest/7')} AS longest7, {r('(x0 + u*(x1-x0))/7', 2)} AS mid_x, {r('(y0 + u*(y1-y0))/7', 2)} AS mid_y
FROM (SELECT icao, fid, sum(len) AS length, max(len) AS longest FROM l GROUP BY icao, fid) a LEFT JOIN h ON h.icao = a.icao AND h.fid = a.fid AND rn = 1""")
def a08(t):
    v = t.b_vertex.select("icao", "fid", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return measure.measure_lines(v, ["icao", "fid"]).select("icao", "fid", rnd(F.col("length") / 7, 3).alias("length7"), rnd(F.col("longest") / 7, 3).alias("longest7"),
                                                            rnd(F.col("mid_x") / 7, 2).alias("mid_x"), rnd(F.col("mid_y") / 7, 2).alias("mid_y"))


def square_vertices(t):
    """Outer square and square hole of each stand as closed rings on the vertex table."""
    k = F.col("sid") % 50
    rings = F.array(*[F.struct(F.lit(ring).alias("ring"), F.lit(i).alias("seq"), (F.col("x") + dx * s).cast("double").alias("x"), (F.col("y") + dy * s).cast("double").alias("y"))
                      for ring, s in ((0, 100 + k), (1, 20 + k)) for i, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])])
    return t.b_stand.select("icao", F.col("sid").alias("fid"), F.explode(rings).alias("v")).select("icao", "fid", "v.*")


@query("A09_polygon_measures", f"""WITH q AS (SELECT icao, sid AS fid, cast(x AS double) AS x, cast(y AS double) AS y, cast(100 + sid % 50 AS double) AS a, cast(20 + sid % 50 AS double) AS b FROM b_stand)
SELECT icao, fid, a*a - b*b AS area, {r('x + (a*a*a - b*b*b)/2/(a*a - b*b)', 2)} AS cx, {r('y + (a*a*a - b*b*b)/2/(a*a - b*b)', 2)} AS cy, x + a/2 AS mean_x, y + a/2 AS mean_y FROM q""")
def a09(t):
    m = measure.measure_polygons(square_vertices(t), ["icao", "fid"])
    return m.select("icao", "fid", "area", rnd("cx", 2).alias("cx"), rnd("cy", 2).alias("cy"), "mean_x", "mean_y")


@query("A10_majority_name", f"""WITH {EDGE_POS}, c AS (SELECT icao, from_id, name, count(*) AS n FROM ep WHERE name IS NOT NULL GROUP BY icao, from_id, name)
SELECT icao, from_id, name, n FROM (SELECT *, row_number() OVER (PARTITION BY icao, from_id ORDER BY n DESC, name) AS rn FROM c) q WHERE rn = 1""")
def a10(t):
    from ..operators.network import majority
    return majority(edge_positions(t), ["icao", "from_id"], "name").select("icao", "from_id", "name", F.col("votes").alias("n"))


@query("A11_joined_names", "SELECT icao, from_id, string_agg(DISTINCT name, '/' ORDER BY name) AS names FROM b_edge WHERE name IS NOT NULL GROUP BY icao, from_id")
def a11(t):
    from ..operators.network import join_names
    return join_names(t.b_edge, ["icao", "from_id"], "name", "/").withColumnRenamed("name", "names")


NODE_TYPES = """inc AS (SELECT icao, from_id AS nid, restriction, eid FROM b_edge WHERE from_id <> to_id UNION ALL SELECT icao, to_id, restriction, eid FROM b_edge WHERE from_id <> to_id),
fl AS (SELECT icao, nid, bool_or(restriction = 'runway') AS rw, bool_or(restriction <> 'runway' AND eid % 10 = 1) AS ex, bool_or(restriction <> 'runway' AND eid % 10 <> 1) AS tw FROM inc GROUP BY icao, nid)"""


@query("A12_node_types", f"WITH {NODE_TYPES} SELECT icao, nid, CASE WHEN rw AND (ex OR tw) THEN 6 WHEN rw THEN 2 WHEN ex AND tw THEN 5 ELSE 1 END AS nodetype FROM fl")
def a12(t):
    from ..operators.network import node_types
    et = F.when(F.col("restriction") == "runway", 2).when(F.col("eid") % 10 == 1, 5).otherwise(1)
    e = t.b_edge.filter("from_id <> to_id").select("icao", F.col("from_id").alias("a"), F.col("to_id").alias("b"), et.alias("edgetype"))
    return node_types(e).withColumnRenamed("node", "nid")


@query("A13_largest_per_name", """SELECT icao, name, arg_max(x, len*wid*1000000 - pid) AS x, arg_max(y, len*wid*1000000 - pid) AS y, max(len*wid) AS area FROM b_pavement WHERE name IS NOT NULL GROUP BY icao, name""")
def a13(t):
    from ..operators.maps import largest_per_name
    p = t.b_pavement.withColumn("area", F.col("len") * F.col("wid"))
    return largest_per_name(p, "name", "area", ["x", "y"], "pid").select("icao", "name", "x", "y", "area")


@query("A17_movement_extent", f"""WITH w AS (SELECT icao, min(least(x0,x1)) AS a, min(least(y0,y1)) AS b, max(greatest(x0,x1)) AS c, max(greatest(y0,y1)) AS d FROM b_strip GROUP BY icao),
k AS (SELECT *, 0.6*greatest(c-a, 1500) AS rw, 0.6*greatest(d-b, 1500) AS rh FROM w),
p AS (SELECT icao, x*2 - 30 AS px0, y*2 - 30 AS py0, x*2 + 30 AS px1, y*2 + 30 AS py1 FROM b_pavement), g AS (SELECT p.* FROM p JOIN k ON k.icao = p.icao WHERE px0 >= a - rw AND py0 >= b - rh AND px1 <= c + rw AND py1 <= d + rh),
m AS (SELECT icao, min(px0) AS px0, min(py0) AS py0, max(px1) AS px1, max(py1) AS py1 FROM g GROUP BY icao),
e AS (SELECT k.icao, least(a, px0) AS a, least(b, py0) AS b, greatest(c, px1) AS c, greatest(d, py1) AS d FROM k LEFT JOIN m ON m.icao = k.icao), z AS (SELECT *, 0.05*greatest(c-a, d-b, 200) AS pad FROM e)
SELECT icao, {r('a-pad')} AS min_x, {r('b-pad')} AS min_y, {r('c+pad')} AS max_x, {r('d+pad')} AS max_y FROM z""")
def a17(t):
    from ..operators.maps import movement_extent
    rw = t.b_strip.select("icao", F.least("ax", "bx").alias("min_x"), F.least("ay", "by").alias("min_y"), F.greatest("ax", "bx").alias("max_x"), F.greatest("ay", "by").alias("max_y"))
    p = t.b_pavement.select("icao", (F.col("x") * 2 - 30).alias("min_x"), (F.col("y") * 2 - 30).alias("min_y"), (F.col("x") * 2 + 30).alias("max_x"), (F.col("y") * 2 + 30).alias("max_y"))
    return movement_extent(rw, p).select("icao", *[rnd(n, 3).alias(n) for n in ("min_x", "min_y", "max_x", "max_y")])


@query("A18_frequency_list", "SELECT DISTINCT icao, 'FREQ ' || cast(sid % 7 AS string) AS name, 118 + cast(sid % 5 AS double) / 8 AS mhz FROM b_stand ORDER BY icao, name")
def a18(t):
    from ..operators.maps import frequencies
    f = t.b_stand.select("icao", F.concat(F.lit("FREQ "), (F.col("sid") % 7).cast("string")).alias("name"), (118 + (F.col("sid") % 5) / 8).alias("mhz"))
    return frequencies(f)


@query("A19_file_sizes")
def a19(t):
    from ..operators.progress import file_sizes
    return file_sizes(t.spark, t.folder)


@query("A20_batch_progress", """WITH s AS (SELECT count(*) AS total FROM b_airport), l AS (SELECT k, arg_max(status, event_id) AS status, max(event_id) AS last FROM (SELECT event_id % (SELECT count(*) FROM supplier) AS k, status, event_id FROM b_runlog) q GROUP BY k),
c AS (SELECT count(*) FILTER (WHERE status <> 'error') AS done, count(*) FILTER (WHERE status = 'error') AS failed FROM l), e AS (SELECT cast(epoch(max(ts)) - epoch(min(ts)) AS bigint) AS elapsed FROM b_runlog)
SELECT total, done, failed, greatest(total - done - failed, 0) AS remaining, elapsed, CASE WHEN elapsed > 60 THEN round(done / elapsed * 3600 * 1000) / 1000 ELSE 0 END AS per_hour FROM s, c, e""")
def a20(t):
    from ..operators.progress import progress
    n = t.supplier.select(F.count(F.lit(1))).scalar()
    log = t.b_runlog.withColumn("k", F.col("event_id") % n).join(t.b_airport.select("k", "icao"), "k")
    return progress(log.select("icao", "event_id", "status", "ts"), t.b_airport.select("icao")).withColumn("per_hour", rnd("per_hour", 3))


@query("A21_proportional_shares")
def a21(t):
    return select.proportional_list(t.b_airport, t.b_runway, 60)


@query("A21_largest_remainder", """WITH c AS (SELECT continent, country, count(*) AS n FROM b_airport GROUP BY 1, 2), e AS (SELECT *, (60 * n) / cast(sum(n) OVER () AS double) AS exact, sum(n) OVER () AS tot FROM c), g AS (SELECT *, cast(floor(exact) AS bigint) AS got FROM e),
k AS (SELECT *, row_number() OVER (ORDER BY exact - got DESC, continent, country) AS rn, least(60, tot) - sum(got) OVER () AS short FROM g) SELECT continent, country, n, got + CASE WHEN rn <= short THEN 1 ELSE 0 END AS slots FROM k""")
def a21b(t):
    counts = t.b_airport.groupBy("continent", "country").agg(F.count(F.lit(1)).alias("n"))
    return select.apportion(counts, F.lit(60), [], ["continent", "country"])


@query("A22_reason_sets", f"""WITH {STATS}, b AS (SELECT icao, country, continent, name, kind, coalesce(n_open, 0) AS n_open, coalesce(longest_ft, 0) AS longest_ft FROM idx),
w AS (SELECT icao, country, 'large' AS why FROM b WHERE kind = 'large_airport' AND country < 'NATION_2' UNION ALL SELECT icao, country, 'international' FROM b WHERE name LIKE '%International%' AND country < 'NATION_2' UNION ALL SELECT icao, country, '2+ runways' FROM b WHERE n_open >= 19),
m AS (SELECT country, arg_min(icao, -longest_ft*1000000 - n_open*1000) AS icao FROM b WHERE country NOT IN (SELECT country FROM w) GROUP BY country)
SELECT icao, string_agg(DISTINCT why, ' + ' ORDER BY why) AS why FROM (SELECT icao, why FROM w UNION ALL SELECT icao, 'main airport of ' || country FROM m) q GROUP BY icao""")
def a22(t):
    low = F.col("country") < "NATION_2"
    idx = t.b_airport.withColumn("kind", F.when(low, F.col("kind")).otherwise("small_airport")).withColumn("name", F.when(low, F.col("name")).otherwise("x"))
    return select.reason_list(idx, t.b_runway.withColumn("closed", F.col("closed")))


_registry.ORACLES["A22_reason_sets"] = _views.with_views(f"""WITH {STATS}, b AS (SELECT icao, country, name, kind, coalesce(n_open, 0) AS n_open, coalesce(longest_ft, 0) AS longest_ft FROM idx),
w AS (SELECT icao, country, 'large' AS why FROM b WHERE kind = 'large_airport' AND country < 'NATION_2' UNION ALL SELECT icao, country, 'international' FROM b WHERE name LIKE '%International%' AND country < 'NATION_2' UNION ALL SELECT icao, country, '2+ runways' FROM b WHERE n_open >= 2),
m AS (SELECT country, icao, row_number() OVER (PARTITION BY country ORDER BY longest_ft DESC, n_open DESC, icao) AS rn FROM b WHERE country NOT IN (SELECT country FROM w))
SELECT icao, string_agg(DISTINCT why, ' + ' ORDER BY why) AS why FROM (SELECT icao, why FROM w UNION ALL SELECT icao, 'main airport of ' || country FROM m WHERE rn = 1) q GROUP BY icao""")

# ---- windows ------------------------------------------------------------------------------

FEATURE_IDS = "ids AS (SELECT *, row_number() OVER (PARTITION BY icao, layer ORDER BY round(x*10), round(y*10), coalesce(idlin, ''), fid) AS n FROM b_feature)"


@query("W01_stable_ids", f"WITH {FEATURE_IDS} SELECT icao, layer, fid, icao || ':' || layer || ':' || n AS id FROM ids")
def w01(t):
    return conflate.assign_ids(t.b_feature.withColumn("id", F.lit(None).cast("string"))).select("icao", "layer", "fid", "id")


def overrides(t):
    """Override rows: stands of some airports appended, nodes of others replaced."""
    n = t.b_stand.filter("sid % 20 = 0").select("icao", F.lit("parkingstandlocation").alias("layer"), F.col("sid").alias("fid"), F.lit(False).alias("replace"))
    m = t.b_node.filter("nid % 11 = 0").select("icao", F.lit("asrnnode").alias("layer"), F.col("nid").alias("fid"), F.lit(True).alias("replace"))
    return n.unionByName(m).withColumn("id", F.when(F.col("fid") % 3 == 0, F.concat(F.lit("own"), F.col("fid").cast("string"))))


OVERRIDES = f"""{FEATURE_IDS}, ov AS (SELECT icao, 'parkingstandlocation' AS layer, sid AS fid, false AS rep FROM b_stand WHERE sid % 20 = 0 UNION ALL SELECT icao, 'asrnnode', nid, true FROM b_node WHERE nid % 11 = 0),
kept AS (SELECT * FROM ids i WHERE NOT EXISTS (SELECT 1 FROM ov WHERE rep AND ov.icao = i.icao AND ov.layer = i.layer)), base AS (SELECT icao, layer, count(*) AS n FROM kept GROUP BY icao, layer)"""


@query("W02_override_ids", f"""WITH {OVERRIDES} SELECT o.icao, o.layer, o.fid, CASE WHEN o.fid % 3 = 0 THEN 'own' || o.fid ELSE o.icao || ':' || o.layer || ':ov' || (coalesce(b.n, 0) + row_number() OVER (PARTITION BY o.icao, o.layer ORDER BY o.fid)) END AS id
 FROM ov o LEFT JOIN base b ON b.icao = o.icao AND b.layer = o.layer""")
def w02(t):
    f = conflate.assign_ids(t.b_feature.withColumn("id", F.lit(None).cast("string")))
    return conflate.apply_overrides(f, overrides(t)).filter("source = 'override'").select("icao", "layer", "fid", "id")


@query("U04_apply_overrides", f"""WITH {OVERRIDES} SELECT icao, layer, source, count(*) AS n FROM (SELECT icao, layer, source FROM kept UNION ALL SELECT icao, layer, 'override' FROM ov) q GROUP BY icao, layer, source""")
def u04(t):
    f = conflate.assign_ids(t.b_feature.withColumn("id", F.lit(None).cast("string")))
    return conflate.apply_overrides(f, overrides(t)).groupBy("icao", "layer", "source").agg(F.count(F.lit(1)).alias("n"))


@query("W03_unique_stand_names", """WITH q AS (SELECT icao, sid, CASE WHEN sid % 3 = 0 THEN '' ELSE name END AS name FROM b_stand), a AS (SELECT *, CASE WHEN name = '' THEN 'STAND ' || row_number() OVER (PARTITION BY icao, name = '' ORDER BY sid) ELSE name END AS nm FROM q),
k AS (SELECT *, row_number() OVER (PARTITION BY icao, nm ORDER BY sid) AS c FROM a) SELECT icao, sid, nm || CASE WHEN c > 1 THEN ' (' || c || ')' ELSE '' END AS name FROM k""")
def w03(t):
    s = t.b_stand.withColumn("name", F.when(F.col("sid") % 3 == 0, F.lit(" ")).otherwise(F.col("name")))
    return conflate.unique_names(s, ["sid"]).select("icao", "sid", "name")


@query("W04_apron_numbers", """SELECT icao, pid, coalesce(name, 'APRON ' || row_number() OVER (PARTITION BY icao ORDER BY pid)) AS idapron FROM b_pavement WHERE name IS NULL OR name LIKE '%Apron%' OR name LIKE '%Ramp%'""")
def w04(t):
    from ..operators.pavement import number_aprons
    p = t.b_pavement.filter(F.col("name").isNull() | F.col("name").rlike("Apron|Ramp"))
    return number_aprons(p, ["pid"]).select("icao", "pid", "idapron")


@query("W06_cut_at_measure", f"""WITH {SEGS}, l AS (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS len FROM segs), k AS (SELECT *, sum(len) OVER (PARTITION BY icao, fid ORDER BY seq) AS cum FROM l), c AS (SELECT *, CASE WHEN fid % 3 = 0 THEN 47.0 ELSE 90.0 END AS cut FROM k)
SELECT icao, fid, count(*) AS segments, {r('sum(least(cum, cut) - (cum - len))/7')} AS kept FROM c WHERE cum - len < cut GROUP BY icao, fid""")
def w06(t):
    s = vertex_segments(t)
    cuts = s.filter("fid % 3 = 0").select("icao", "fid", F.explode(F.array(F.lit(47.0), F.lit(80.0))).alias("measure"))
    out = measure.cut_at(s, ["icao", "fid"], cuts, 90.0)
    return out.groupBy("icao", "fid").agg(F.count(F.lit(1)).alias("segments"), rnd(F.sum(F.col("to_m") - F.col("from_m")) / 7, 3).alias("kept"))


@query("W07_first_positions", "SELECT l_orderkey, l_suppkey, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2")
def w07(t):
    return select.first_positions(t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("pos")), ["l_orderkey", "l_suppkey"])


@query("W08_retention_plan", """WITH f AS (SELECT icao, count(*) * 1000 + 7 AS bytes, min(sid) AS modified FROM b_stand GROUP BY icao), d AS (SELECT 'event' || event_id AS icao, 100 AS bytes, event_id AS modified FROM b_runlog),
u AS (SELECT 0 AS tier, * FROM f WHERE icao <> 'X003' UNION ALL SELECT 1, * FROM d), k AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY tier, modified, icao ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM u),
t AS (SELECT (SELECT sum(bytes) FROM f) + (SELECT sum(bytes) FROM d) AS total)
SELECT icao, bytes FROM k, t WHERE total - prior > total * 2 // 3""")
def w08(t):
    from ..operators.progress import retention_plan
    a = t.b_stand.groupBy("icao").agg((F.count(F.lit(1)) * 1000 + 7).alias("bytes"), F.min("sid").alias("modified")).withColumn("tier", F.lit(0))
    d = t.b_runlog.select(F.concat(F.lit("event"), F.col("event_id").cast("string")).alias("icao"), F.lit(100).cast("bigint").alias("bytes"), F.col("event_id").alias("modified"), F.lit(1).alias("tier"))
    files = a.unionByName(d.select(a.columns))
    limit = files.select(F.floor(F.sum("bytes") * 2 / 3)).scalar()
    return retention_plan(files, limit, keep="X003").select("icao", "bytes")


@query("W09_latest_finished", "SELECT event_id, vehicle, status FROM b_runlog WHERE status <> 'error' ORDER BY ts DESC, event_id DESC LIMIT 12")
def w09(t):
    from ..operators.progress import latest
    return latest(t.b_runlog.filter("status <> 'error'"), ["ts", "event_id"], 12).select("event_id", "vehicle", "status")


@query("W10_line_pieces", """SELECT icao, fid, piece, points FROM (WITH RECURSIVE v AS (SELECT icao, fid, cast(x*3 AS double) AS x, cast(y*3 AS double) AS y, row_number() OVER (PARTITION BY icao, fid ORDER BY seq) AS rn FROM b_vertex),
k AS (SELECT icao, fid, rn, x AS lx, y AS ly, cast(0 AS double) AS len, cast(0 AS bigint) AS piece, true AS kept, false AS cut FROM v WHERE rn = 1 UNION ALL
 SELECT icao, fid, rn, CASE WHEN d < 1 THEN lx ELSE x END, CASE WHEN d < 1 THEN ly ELSE y END, CASE WHEN d < 1 THEN len WHEN len + d >= 150 THEN 0 ELSE len + d END, CASE WHEN d >= 1 AND len + d >= 150 THEN piece + 1 ELSE piece END, d >= 1, d >= 1 AND len + d >= 150
 FROM (SELECT v.*, k.lx, k.ly, k.len, k.piece, sqrt((v.x-k.lx)*(v.x-k.lx)+(v.y-k.ly)*(v.y-k.ly)) AS d FROM k JOIN v ON v.icao = k.icao AND v.fid = k.fid AND v.rn = k.rn + 1) j),
e AS (SELECT icao, fid, CASE WHEN cut THEN piece - 1 ELSE piece END AS piece FROM k WHERE kept UNION ALL SELECT icao, fid, piece FROM k WHERE cut)
SELECT icao, fid, piece, count(*) AS points FROM e GROUP BY icao, fid, piece HAVING count(*) > 1) z""")
def w10(t):
    v = t.b_vertex.select("icao", "fid", "seq", (F.col("x") * 3).cast("double").alias("x"), (F.col("y") * 3).cast("double").alias("y"))
    return measure.cut_pieces(v, ["icao", "fid"]).groupBy("icao", "fid", "piece").agg(F.count(F.lit(1)).alias("points"))


@query("W11_repeated_runways", """SELECT icao, rid, idrwy FROM (WITH RECURSIVE q AS (SELECT icao, rid, ident0 || '/' || ident1 AS idrwy, x0/50 AS x, y0/50 AS y FROM b_strip), n AS (SELECT *, row_number() OVER (PARTITION BY icao, idrwy ORDER BY rid) AS rn FROM q),
k AS (SELECT icao, idrwy, rid, rn, x AS kx, y AS ky, true AS kept FROM n WHERE rn = 1 UNION ALL SELECT n.icao, n.idrwy, n.rid, n.rn, CASE WHEN sqrt((n.x-k.kx)*(n.x-k.kx)+(n.y-k.ky)*(n.y-k.ky)) < 50 THEN k.kx ELSE n.x END, CASE WHEN sqrt((n.x-k.kx)*(n.x-k.kx)+(n.y-k.ky)*(n.y-k.ky)) < 50 THEN k.ky ELSE n.y END, sqrt((n.x-k.kx)*(n.x-k.kx)+(n.y-k.ky)*(n.y-k.ky)) >= 50
FROM k JOIN n ON n.icao = k.icao AND n.idrwy = k.idrwy AND n.rn = k.rn + 1) SELECT icao, rid, idrwy FROM k WHERE kept) z""")
def w11(t):
    s = t.b_strip.select("icao", "rid", F.concat("ident0", F.lit("/"), "ident1").alias("idrwy"), (F.col("ax") / 50).alias("ax"), (F.col("ay") / 50).alias("ay"))
    return conflate.drop_repeated_runways(s, ["rid"]).select("icao", "rid", "idrwy")


# ---- sort, search, set operations -----------------------------------------------------------

@query("T01_sorted_selection", "SELECT icao FROM b_airport ORDER BY icao LIMIT 40 OFFSET 5")
def t01(t):
    return t.b_airport.select("icao").orderBy("icao").offset(5).limit(40)


@query("T02_ranked_search", """SELECT icao, rank FROM (SELECT icao, CASE WHEN lower(icao) = 'x01' OR lower(iata) = 'x01' THEN 0 WHEN lower(icao) LIKE 'x01%' THEN 1 WHEN lower(name) LIKE '%x01%' THEN 2 WHEN lower(city) LIKE '%x01%' THEN 3 END AS rank FROM b_airport) q
 WHERE rank IS NOT NULL ORDER BY rank, icao LIMIT 25""")
def t02(t):
    return select.search_ranked(t.b_airport, "x01 ").select("icao", "rank")


@query("T03_prefix_search", """SELECT icao, name FROM b_airport WHERE (kind <> 'small_airport' OR k % 2 = 0) AND (icao LIKE 'SUPPLIER#0000000%' OR upper(iata) LIKE 'SUPPLIER#0000000%' OR upper(name) LIKE 'SUPPLIER#0000000%')""")
def t03(t):
    built = t.b_airport.filter("k % 2 = 0")
    return select.search_prefix(t.b_airport, built, "Supplier#0000000").select("icao", "name")


@query("T04_priority_order", f"""WITH {STATS} SELECT icao, CASE country WHEN 'NATION_5' THEN 1 WHEN 'NATION_9' THEN 2 ELSE 3 END AS priority, row_number() OVER (ORDER BY CASE country WHEN 'NATION_5' THEN 1 WHEN 'NATION_9' THEN 2 ELSE 3 END, continent, country, n_open DESC, icao) AS pos FROM idx""")
def t04(t):
    df = select.priority_order(select.with_stats(t.b_airport, t.b_runway), ["NATION_5", "NATION_9"])
    o = df.select("icao", "priority", F.lit(1).alias("g"), "continent", "country", (-F.col("n_open")).alias("o"))
    return ordered.scan(o, ["g"], ["priority", "continent", "country", "o", "icao"], pos=ordered.rank()).select("icao", "priority", "pos")


@query("T05_rank_in_country", f"""WITH {STATS} SELECT icao, country, cast(row_number() OVER (PARTITION BY country ORDER BY kind <> 'large_airport', name NOT LIKE '%International%', coalesce(n_open, 0) DESC, coalesce(longest_ft, 0) DESC, icao) AS int) AS rank FROM idx""")
def t05(t):
    return select.rank_in_country(t.b_airport, t.b_runway)


@query("U01_absorb_sources", """SELECT icao, CASE WHEN k % 2 = 0 THEN 'a' WHEN k % 3 = 0 THEN 'b' ELSE 'c' END AS name, CASE WHEN k % 5 = 0 THEN 1.0 ELSE elev_ft END AS elev_ft FROM b_airport""")
def u01(t):
    a = t.b_airport.filter("k % 2 = 0 OR k % 5 = 0").select("icao", F.when(F.col("k") % 2 == 0, "a").alias("name"), F.when(F.col("k") % 5 == 0, 1.0).alias("elev_ft"))
    b = t.b_airport.select("icao", F.when(F.col("k") % 3 == 0, "b").alias("name"))
    d = t.b_airport.select("icao", F.lit("c").alias("name"), "elev_ft")
    return conflate.merge_headers(a, b.withColumn("elev_ft", F.lit(None).cast("double")), d, fields=["name", "elev_ft"])


@query("U02_source_fallback", """SELECT icao, rid, CASE WHEN k % 4 = 0 THEN 'file' WHEN k % 4 IN (1, 2) THEN 'gateway' ELSE 'local' END AS origin FROM b_strip JOIN b_airport USING (icao)""")
def u02(t):
    s = t.b_strip.select("icao", "rid").join(t.b_airport.select("icao", "k"), "icao")
    parts = [s.filter(f).select("icao", "rid", F.lit(o).alias("origin")) for f, o in (("k % 4 = 0", "file"), ("k % 4 < 3", "gateway"), ("true", "local"))]
    return conflate.first_source(*parts).select("icao", "rid", "origin")


@query("U03_collection_fallback", """SELECT icao, rid FROM b_strip WHERE source = 'xplane' AND rid % 3 = 0 UNION ALL SELECT s.icao, rid FROM b_strip s WHERE source = 'osm' AND NOT EXISTS (SELECT 1 FROM b_strip b WHERE b.icao = s.icao AND b.source = 'xplane' AND b.rid % 3 = 0)""")
def u03(t):
    s = t.b_strip.select("icao", "rid", "source")
    return conflate.fallback(s.filter("source = 'xplane' AND rid % 3 = 0"), s.filter("source = 'osm'")).select("icao", "rid")


@query("U05_union_of_selections", "SELECT icao FROM b_airport WHERE country IN ('NATION_1', 'NATION_2') OR kind = 'large_airport'")
def u05(t):
    picks = [select.select_airports(t.b_airport, t.b_runway, country=c).select("icao") for c in ("NATION_1", "nation_2")]
    picks.append(select.select_airports(t.b_airport, t.b_runway, kinds=["large"]).select("icao"))
    return conflate.union_sources(*picks).distinct().orderBy("icao")


assert _pick and pick_sql and TAGSETS
