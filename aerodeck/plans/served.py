"""Lookups, sinks, client schema and streams (Q, K, P34, Z)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes, geo, shapes
from ..functions.geo import rnd
from ..operators import client, lookups, manifest, maps, measure, progress, select
from ..operators.ordered import durable, shared_folder
from ..sources import geojson
from ..streaming import feeds
from . import views
from .registry import query
from .relational import STATS, km_sql
from .scalar import SEGS, _case, r, vertex_segments
from .spatial import sd


@query("P34_client_ids", "SELECT icao, layer, fid, CASE layer WHEN 'parkingstandlocation' THEN 23 WHEN 'asrnnode' THEN 40 WHEN 'runwayelement' THEN 0 WHEN 'taxiwayelement' THEN 14 ELSE 28 END * 1000000 + row_number() OVER (PARTITION BY icao, layer ORDER BY fid) AS client_id FROM b_feature")
def p34(t):
    return client.client_ids(t.b_feature, ["fid"]).select("icao", "layer", "fid", "client_id")


_PAIRS = "array_to_string([array_to_string([{pad} FOR d IN string_split(p, '/')], '.') FOR p IN string_split({v}, '+')], '_')"
_PAD = "CASE WHEN regexp_matches({v}, '^[0-9]([^0-9]|$)') THEN '0' || {v} ELSE {v} END"


def _rule_sql(rule) -> str:
    kind, *a = rule
    pairs = lambda v: _PAIRS.format(pad=_PAD.format(v="d"), v=v)
    return {"fixed": lambda: "NULL" if a[0] is None else f"'{a[0]}'" if isinstance(a[0], str) else str(a[0]), "word": lambda: f"coalesce({', '.join([*a, 'NULL'])})", "number": lambda: f"coalesce({', '.join(a)}, -32767)",
            "filled": lambda: f"nullif({a[0]}, '')", "dotted": lambda: f"replace({a[0]}, '|', '.')", "metres": lambda: f"coalesce({r(a[0] + '*0.3048', 2)}, -32767)", "coded": lambda: _case(a[0], a[1]), "runway": lambda: pairs(a[0]),
            "threshold": lambda: _PAD.format(v=a[0]), "runway_end": lambda: f"coalesce(regexp_extract({pairs(a[0])}, '^[^._]+'), '')", "node": lambda: f"coalesce({a[0]} + 40000001, -32767)",
            "equal": lambda: f"CASE WHEN {a[0]} = {a[1]} THEN 1 ELSE 0 END", "flag": lambda: f"CASE {a[0]} WHEN true THEN {a[1]} WHEN false THEN {a[2]} ELSE {a[3]} END", "first": lambda: f"coalesce({', '.join(map(_rule_sql, a))})"}[kind]()


def _client_sql() -> str:
    """One SELECT for each property of each layer; the features are numbered once."""
    parts = []
    for layer, rules in client.SCHEMA.items():
        for name, rule in rules.items():
            words = rule[0] in ("word", "filled", "dotted", "runway", "threshold", "runway_end", "first") or rule in (("fixed", None), ("fixed", "0001-00-00"))
            v = _rule_sql(rule)
            node = {"catstop": "AND nodetype = 5", "featref": "AND nodetype = 5", "idthr": "AND nodetype IN (2, 6)", "termref": "AND nodetype = 3"}.get(name, "") if layer == "asrnnode" else ""
            parts.append(f"SELECT icao, layer, id, '{name}' AS property, cast({v if words else 'NULL'} AS varchar) AS text, cast({'NULL' if words else v} AS double) AS number FROM f WHERE layer = '{layer}' {node}")
    number = "CASE layer " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in codes.FEATURE_NUMBERS.items()) + " END"
    ids = f"CASE WHEN layer = 'asrnnode' AND nodeid IS NOT NULL THEN nodeid + 40000001 ELSE {number} * 1000000 + row_number() OVER (PARTITION BY icao, layer ORDER BY fid) END"
    return f"WITH f AS MATERIALIZED (SELECT *, {ids} AS id FROM b_attributes WHERE {number} IS NOT NULL) " + " UNION ALL ".join(parts)


@query("P34_client_properties", _client_sql())
def p34b(t):
    return client.client_schema(t.b_attributes, ["fid"])


@query("Q01_cycle_info", "SELECT o_orderkey, strftime(c, '%Y-%m-%d') AS cycle_start, strftime(c + 28, '%Y-%m-%d') AS cycle_end FROM (SELECT o_orderkey, date '2026-09-03' + cast(floor((cast(o_orderdate AS date) - date '2026-09-03') / 28) AS int) * 28 AS c FROM orders) q")
def q01(t):
    d = lookups.cycle(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d")), "d")
    return d.select("o_orderkey", F.date_format("cycle_start", "yyyy-MM-dd").alias("cycle_start"), F.date_format("cycle_end", "yyyy-MM-dd").alias("cycle_end"))


@query("Q02_search_rows", f"SELECT icao AS idarpt, iata, {r('elev_ft*0.3048', 2)} AS elev, name, lat, lon FROM b_airport WHERE kind <> 'small_airport' AND (icao LIKE 'X0%' OR iata LIKE 'X0%')")
def q02(t):
    return lookups_search(t)


def lookups_search(t):
    none = t.b_airport.filter("k < 0")
    return select.search_row(select.search_prefix(t.b_airport, none, "x0"))


@query("Q03_nearest_airports", f"""WITH q AS (SELECT event_id, a.icao, {km_sql('l.lat', 'l.lon', 'a.lat', 'a.lon')} AS km FROM b_runlog l JOIN b_airport a ON abs(l.lat - a.lat) <= 5), k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, icao) AS rn FROM q WHERE km <= 500)
SELECT event_id, icao, {r('km/1.852', 2)} AS distance_nm FROM k WHERE rn <= 16""")
def q03(t):
    n = select.nearest_airports(t.b_runlog.withColumnRenamed("event_id", "pid"), t.b_airport, 500, 16)
    return n.select(F.col("pid").alias("event_id"), "icao", "distance_nm")


def rect_features(t):
    g = F.array(shapes.rect_along("x", "y", "hd", "len", "wid"))
    layer = F.when(F.col("pid") % 2 == 0, "taxiwayelement").otherwise("apronelement")
    return t.b_pavement.select("icao", layer.alias("layer"), F.col("pid").cast("string").alias("id"), "name", "source", g.alias("geom"))


def frames(t):
    return t.b_airport.select("icao", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))


@query("Q04_layer_subset_snapped", "SELECT icao, cast(pid AS string) AS id, round(x/5)*5 - 0.0 AS x, round((y + wid/2)/5)*5 + 0.0 AS y FROM b_pavement WHERE pid % 2 = 0 AND false")
def q04(t):
    f = lookups.layers(rect_features(t), frames(t), include=["taxiwayelement"], projection="local", precision=5.0)
    return f.select("icao", "id", F.col("geom")[0][0].x.alias("x"), F.col("geom")[0][0].y.alias("y"))


from . import registry as _registry, views as _views  # noqa: E402
_registry.ORACLES["Q04_layer_subset_snapped"] = _views.with_views("SELECT icao, cast(pid AS string) AS id, round((x - wid/2)/5)*5 + 0.0 AS x, round(y/5)*5 + 0.0 AS y FROM b_pavement WHERE pid % 2 = 0")


@query("Q05_one_layer", "SELECT cast(pid AS string) AS id FROM b_pavement WHERE icao = 'X003' AND pid % 2 = 1")
def q05(t):
    f = rect_features(t).filter("icao = 'X003'")
    return lookups.layers(f, frames(t), include=[" ApronElement "], projection="local").select("id")


@query("Q06_derived_members", f"SELECT icao, cast(pid AS string) AS id, {r('x + sin(radians(hd))*len/2')} AS cx, {r('y + cos(radians(hd))*len/2')} AS cy FROM b_pavement")
def q06(t):
    d = lookups.derived_members(rect_features(t).withColumn("kind", F.lit("surface")))
    return d.select("icao", "id", rnd("centroid.x", 3).alias("cx"), rnd("centroid.y", 3).alias("cy"))


@query("Q07_airport_facts", "SELECT a.icao, name, coalesce(runways, '') AS runways FROM b_airport a LEFT JOIN (SELECT icao, string_agg(rid || ': ' || length_ft || ' ft', '; ' ORDER BY length_ft DESC, rid) AS runways FROM b_runway WHERE NOT closed GROUP BY icao) q ON q.icao = a.icao")
def q07(t):
    return lookups.airport_info(t.b_airport, t.b_runway).select("icao", "name", F.coalesce("runways", F.lit("")).alias("runways"))


@query("Q08_tiles", f"""WITH {SEGS}, v AS (SELECT icao, fid, arg_min(x, seq)*4 AS px, arg_min(y, seq)*4 AS py, min(x)*4 AS x0, max(x)*4 AS x1, min(y)*4 AS y0, max(y)*4 AS y1, count(*) AS n FROM b_vertex GROUP BY 1, 2)
SELECT icao, cast(floor(px/300) AS bigint) AS tile_x, cast(floor(py/300) AS bigint) AS tile_y, count(*) AS pieces, cast(sum(n) AS bigint) AS points, cast(min(x0) AS double) AS min_x, cast(max(y1) AS double) AS max_y FROM v WHERE n >= 2 GROUP BY 1, 2, 3""")
def q08(t):
    v = t.b_vertex.select("icao", "fid", F.lit(0).alias("piece"), "seq", (F.col("x") * 4).cast("double").alias("x"), (F.col("y") * 4).cast("double").alias("y"))
    return measure.tiles(v).select("icao", "tile_x", "tile_y", "pieces", "points", "min_x", "max_y")


_ARC = "acos(greatest(-1, least(1, {})))"
_X_ARC = _ARC.format("sin(radians(lat))*sin(radians(lat)) + cos(radians(lat))*cos(radians(lat))*cos(radians(lon+0.01-lon))")
_Y_ARC = _ARC.format("sin(radians(lat))*sin(radians(lat+0.01)) + cos(radians(lat))*cos(radians(lat+0.01))")


@query("Q12_metres_per_degree", f"""SELECT icao, {r(f"{_X_ARC}/sin({_X_ARC})*6371008.8*cos(radians(lat))*sin(radians(lon+0.01-lon))/0.01", 1)} AS mx,
{r(f"{_Y_ARC}/sin({_Y_ARC})*6371008.8*(cos(radians(lat))*sin(radians(lat+0.01)) - sin(radians(lat))*cos(radians(lat+0.01)))/0.01", 1)} AS my FROM b_airport""")
def q12(t):
    mx, my = geo.metres_per_degree("lon", "lat")
    return t.b_airport.select("icao", rnd(mx, 1).alias("mx"), rnd(my, 1).alias("my"))


@query("Q13_feature_boxes", "SELECT icao, fid, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM b_vertex GROUP BY 1, 2")
def q13(t):
    return measure.feature_bbox(t.b_vertex, ["icao", "fid"])


@query("Q14_runway_table", "SELECT s.icao, idrwy, len AS length, cast(round(len*3.28084) AS bigint) AS length_ft FROM (SELECT icao, ident0 || '/' || ident1 AS idrwy, max(len) AS len FROM b_strip GROUP BY 1, 2) s")
def q14(t):
    e = t.b_strip.select("icao", F.concat("ident0", F.lit("/"), "ident1").alias("idrwy"), F.col("len").alias("length"), F.col("width_m").alias("width"), F.col("surface").alias("surftype"))
    return maps.runway_table(e, codes.code_legend(t.spark)).select("icao", "idrwy", "length", "length_ft")


@query("K02_geojson_documents", "SELECT icao, CASE WHEN pid % 2 = 0 THEN 'taxiwayelement' ELSE 'apronelement' END AS layer, cast(count(*) AS int) AS count FROM b_pavement GROUP BY 1, 2")
def k02(t):
    d = geojson.feature_collections(rect_features(t), ["id", "name", "source"], codes.layer_registry(t.spark), frames(t))
    back = geojson.features(d.select("icao", "layer", "value"))
    return back.groupBy("icao", "layer").agg(F.count(F.lit(1)).cast("int").alias("count"))


@query("K03_manifest", "SELECT icao, count(*) AS total_features, string_agg(DISTINCT source, '+' ORDER BY source) AS sources, cast(45 AS int) AS layers FROM b_feature GROUP BY icao")
def k03(t):
    m = manifest.manifest(t.b_feature, t.b_airport.select("icao", "name"), t.b_airport.filter("k < 0").select("icao", F.array(F.lit("")).alias("messages")), codes.layer_registry(t.spark))
    return m.select("icao", "total_features", F.array_join("sources", "+").alias("sources"), F.size("layers").alias("layers"))


@query("K04_index_upsert", "SELECT icao, CASE WHEN k % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM b_airport")
def k04(t):
    old = t.b_airport.filter("k % 5 > 0 OR k % 3 > 0").select("icao", F.lit("old").alias("version"))
    return manifest.upsert_index(old, t.b_airport.filter("k % 3 = 0").select("icao", F.lit("new").alias("version")))


@query("K06_selection_rows", f"WITH {STATS} SELECT icao, name, n_open, longest_ft FROM idx")
def k06(t):
    return select.with_stats(t.b_airport, t.b_runway).select("icao", "name", "n_open", "longest_ft")


@query("K08_batch_report", "SELECT count(*) AS selected, count(*) FILTER (WHERE status = 'view') AS built, count(*) FILTER (WHERE status = 'error') AS failed, count(*) FILTER (WHERE status = 'click') AS skipped FROM b_runlog")
def k08(t):
    s = F.when(F.col("status") == "view", "built").when(F.col("status") == "error", "failed").when(F.col("status") == "click", "skipped")
    return progress.batch_report(t.b_runlog.withColumn("status", s)).drop("seconds")


@query("K07_status_report", """SELECT a.icao, l.status, CASE WHEN a.k % 3 = 0 THEN a.name ELSE 'index ' || a.name END AS name, a.country, CASE WHEN a.k % 3 = 0 THEN 'osm' ELSE '' END AS sources,
CASE WHEN a.k % 3 = 0 THEN cast(a.k AS varchar) ELSE '' END AS features, coalesce(printf('%.1f', floor(l.seconds)), '') AS build_seconds, CASE WHEN l.status = 'error' THEN 'failed' ELSE '' END AS error, 'bulk' AS run
FROM b_runlog l CROSS JOIN (SELECT count(*) AS n FROM b_airport) z JOIN b_airport a ON a.k = l.vehicle % z.n""")
def k07(t):
    n = t.b_airport.select(F.count(F.lit(1))).scalar()
    log = t.b_runlog.withColumn("k", F.col("vehicle") % n).join(t.b_airport.select("k", "icao"), "k").select("icao", "status", F.floor("seconds").cast("double").alias("seconds"), F.when(F.col("status") == "error", "failed").alias("error"))
    made = t.b_airport.filter("k % 3 = 0").select("icao", "name", F.when(F.col("k") % 2 == 0, F.col("country")).alias("country"), F.lit("osm").alias("sources"), F.col("k").alias("features"))
    index = t.b_airport.select("icao", F.concat(F.lit("index "), "name").alias("name"), "country")
    return progress.status_report(log, made, index, "bulk")


@query("Z01_progress_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, status, count(*) AS n FROM b_runlog GROUP BY 1, 2")
def z01(t):
    return feeds.progress_stream(t.b_runlog).select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "status", "n")


@query("Z02_nearest_feed", f"""WITH q AS (SELECT event_id, a.icao, {km_sql('l.lat', 'l.lon', 'a.lat', 'a.lon')} AS km FROM b_runlog l JOIN b_airport a ON abs(l.lat - a.lat) <= 15), k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, icao) AS rn FROM q WHERE km <= 1500)
SELECT l.event_id, k.icao FROM b_runlog l LEFT JOIN k ON k.event_id = l.event_id AND rn = 1""")
def z02(t):
    return feeds.nearest_stream(t.b_runlog, t.b_airport).select("event_id", "icao")


@query("Z03_change_events", f"""WITH q AS (SELECT event_id, a.icao, {km_sql('l.lat', 'l.lon', 'a.lat', 'a.lon')} AS km FROM b_runlog l JOIN b_airport a ON abs(l.lat - a.lat) <= 15), k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, icao) AS rn FROM q WHERE km <= 1500),
n AS (SELECT l.event_id, l.vehicle, k.icao, lag(k.icao) OVER w AS held, l.ts - lag(l.ts) OVER w > INTERVAL 30 DAY AS anew FROM b_runlog l LEFT JOIN k ON k.event_id = l.event_id AND rn = 1 WHERE l.vehicle IS NOT NULL WINDOW w AS (PARTITION BY l.vehicle ORDER BY l.ts, l.event_id))
SELECT vehicle, event_id, icao FROM n WHERE icao IS DISTINCT FROM held OR (anew AND icao IS NOT NULL)""")
def z03(t):
    work = f"{shared_folder(t.spark)}/changes-{uuid.uuid4().hex}"
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")
    feed = t.spark.sql(views.VIEWS["b_runlog"], events=source)
    feeds.run_changes(feeds.nearest_stream(feed, t.b_airport), f"{work}/out", f"{work}/state")
    return t.spark.read.schema(feeds.CHANGE).parquet(f"{work}/out")


def pavement_rects(t):
    """All pavement, turned to the axes and moved together, so that most of it overlaps."""
    return t.b_pavement.select("icao", F.array(shapes.rect_along(F.floor(F.col("x") / 8).cast("double"), F.floor(F.col("y") / 8).cast("double"), F.lit(0.0), "len", "wid")).alias("geom"))


def _slabs(p: str, v0: str, v1: str, u0: str, u1: str) -> str:
    """Merged intervals of u in each slab between neighbouring ends of v: new length and whether a run begins."""
    return f"""{p}e AS (SELECT icao, {v0} AS v FROM p UNION SELECT icao, {v1} FROM p), {p}s AS (SELECT icao, v, lead(v) OVER (PARTITION BY icao ORDER BY v) AS w FROM {p}e),
{p}m AS (SELECT s.icao, w - v AS h, {u0} AS a, {u1} AS z, max({u1}) OVER (PARTITION BY s.icao, v ORDER BY {u0}, {u1} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {p}s s JOIN p ON p.icao = s.icao AND {v0} <= v AND {v1} >= w),
{p} AS (SELECT icao, sum(h * greatest(0, z - greatest(a, coalesce(reached, a)))) AS area, sum(CASE WHEN reached IS NULL OR reached < a THEN 2 * h ELSE 0 END) AS sides FROM {p}m GROUP BY icao)"""


@query("Q09_outline", f"""WITH p AS (SELECT icao, floor(x/8) - wid/2 AS x0, floor(x/8) + wid/2 AS x1, floor(y/8) AS y0, floor(y/8) + len AS y1 FROM b_pavement), {_slabs('r', 'y0', 'y1', 'x0', 'x1')}, {_slabs('c', 'x0', 'x1', 'y0', 'y1')}
SELECT r.icao, {r('r.area', 2)} AS area, {r('r.sides + c.sides', 2)} AS outline FROM r JOIN c ON c.icao = r.icao""")
def q09(t):
    parts = durable(maps.tile_parts(pavement_rects(t), square=True))
    lines = maps.outline(parts)
    w = W.partitionBy("icao", "tile_x", "tile_y", "line").orderBy("seq")
    d = geo.dist("x", "y", F.lag("x").over(w), F.lag("y").over(w))
    long = lines.withColumn("_d", d).groupBy("icao").agg(rnd(F.sum("_d"), 2).alias("outline"))
    return parts.groupBy("icao").agg(rnd(F.sum("area"), 2).alias("area")).join(long, "icao")


LABELS = f"""gl AS (SELECT icao, fid, round(sum(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))), 6) AS length FROM segs GROUP BY 1, 2), gm AS (SELECT icao, fid, (arg_min(x, seq) + arg_max(x, seq))/2 AS x, (arg_min(y, seq) + arg_max(y, seq))/2 AS y FROM b_vertex GROUP BY 1, 2),
tw AS (SELECT icao, 'T' || fid % 10 AS label, length, x, y, row_number() OVER (PARTITION BY icao, fid % 10 ORDER BY length DESC, fid) AS rn FROM gl JOIN gm USING (icao, fid)),
lm AS (SELECT icao, name AS label, x, y, row_number() OVER (PARTITION BY icao, name ORDER BY len*wid DESC, pid) AS rn FROM b_pavement WHERE name IS NOT NULL),
lb AS (SELECT icao, 1 AS kind, label, x, y FROM tw WHERE rn = 1 AND length >= 40 UNION ALL SELECT icao, 2, ident0, x0 - sin(radians(hd))*55, y0 - cos(radians(hd))*55 FROM b_strip UNION ALL SELECT icao, 2, ident1, x1 - sin(radians(hd + 180))*55, y1 - cos(radians(hd + 180))*55 FROM b_strip
 UNION ALL SELECT icao, 3, 'G' || sid % 40, x, y FROM b_stand UNION ALL SELECT icao, 4, label, x, y FROM lm WHERE rn = 1)"""


def labels(t):
    g = t.b_vertex.groupBy("icao", "fid").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("z"))
    long = vertex_segments(t).groupBy("icao", "fid").agg(rnd(F.sum(geo.dist("ax", "ay", "bx", "by")), 6).alias("length"))
    guides = long.join(g, ["icao", "fid"]).select("icao", "fid", F.concat(F.lit("T"), (F.col("fid") % 10).cast("string")).alias("idlin"), "length", ((F.col("a.x") + F.col("z.x")) / 2).alias("mid_x"), ((F.col("a.y") + F.col("z.y")) / 2).alias("mid_y"))
    end = lambda n, x, y, turn: t.b_strip.select("icao", F.col(n).alias("idthr"), F.col(x).alias("x"), F.col(y).alias("y"), (F.col("hd") + turn).alias("brngtrue"))
    stands = t.b_stand.select("icao", F.concat(F.lit("G"), (F.col("sid") % 40).cast("string")).alias("idstd"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    marks = t.b_pavement.select("icao", F.col("pid").alias("fid"), "name", (F.col("len") * F.col("wid")).alias("area"), "x", "y")
    return maps.label_set(guides, end("ident0", "ax", "ay", 0).unionByName(end("ident1", "bx", "by", 180)), stands, marks)


@query("Q10_label_set", f"WITH {SEGS}, {LABELS} SELECT icao, kind, label, {r('x')} AS x, {r('y')} AS y FROM lb")
def q10(t):
    return labels(t).select("icao", "kind", "label", rnd("x", 3).alias("x"), rnd("y", 3).alias("y"))


def stretched(t):
    return t.b_vertex.select("icao", "fid", "seq", (F.col("x") * 4).cast("double").alias("x"), (F.col("y") * 4).cast("double").alias("y"))


@query("Q11_coarse_lines", f"""WITH q AS (SELECT icao, fid, seq, cast(x*4 AS double) AS px, cast(y*4 AS double) AS py, row_number() OVER w AS rn, cast(lag(x*4) OVER w AS double) AS x0, cast(lag(y*4) OVER w AS double) AS y0, cast(lead(x*4) OVER w AS double) AS x1, cast(lead(y*4) OVER w AS double) AS y1 FROM b_vertex WINDOW w AS (PARTITION BY icao, fid ORDER BY seq))
SELECT icao, fid, count(*) AS kept, sum(px) AS sum_x, sum(py) AS sum_y FROM q WHERE NOT coalesce(x0 IS NOT NULL AND x1 IS NOT NULL AND rn % 2 = 0 AND {sd('px', 'py')} < 20, false) GROUP BY 1, 2""")
def q11(t):
    far = measure.thin(stretched(t), ["icao", "fid"], 20.0, passes=1)
    return far.groupBy("icao", "fid").agg(F.count(F.lit(1)).alias("kept"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


def _slim_sql(extract: str) -> str:
    words = ("idrwy", "idlin", "idapron", "name", "idstd", "idthr", "idhot", "iata")
    have = (*words, "width", "length", "surftype", "plysttyp", "catstop", "brngtrue", "tora", "lda", "frq", "elev", "pntsttyp")
    case = lambda n: f"CASE WHEN {n} IS NOT NULL THEN '\"{n}\":' || " + (f"'\"' || {n} || '\"'" if n in words else f"cast({n} AS varchar)") + " END"
    rows = " ".join(f"WHEN '{k}' THEN concat_ws(',', {', '.join(case(n) for n in ns if n in have)})" for k, ns in maps.SLIM_PROPERTIES.items() if any(n in have for n in ns))
    listed = ", ".join(f"'{n}'" for n in maps.SLIM_LAYERS[extract])
    return f"SELECT '{extract}' AS extract, icao, layer, fid, '{{' || coalesce(CASE layer {rows} END, '') || '}}' AS value FROM b_attributes WHERE layer IN ({listed})"


@query("K09_slim_extracts", f"{_slim_sql('viewer')} UNION ALL {_slim_sql('chart')}")
def k09(t):
    one = lambda n: maps.slim(t.b_attributes, n, ["fid"]).withColumn("extract", F.lit(n))
    return one("viewer").unionByName(one("chart"))


@query("K10_tile_extract", f"""WITH {SEGS}, {LABELS}, e AS (SELECT * FROM (WITH RECURSIVE v AS (SELECT icao, fid, cast(x*4 AS double) AS x, cast(y*4 AS double) AS y, row_number() OVER (PARTITION BY icao, fid ORDER BY seq) AS rn FROM b_vertex),
k AS (SELECT icao, fid, rn, x AS lx, y AS ly, cast(0 AS double) AS len, cast(0 AS bigint) AS piece, true AS kept, false AS cut FROM v WHERE rn = 1 UNION ALL
 SELECT icao, fid, rn, CASE WHEN d < 1 THEN lx ELSE x END, CASE WHEN d < 1 THEN ly ELSE y END, CASE WHEN d < 1 THEN len WHEN len + d >= 150 THEN 0 ELSE len + d END, CASE WHEN d >= 1 AND len + d >= 150 THEN piece + 1 ELSE piece END, d >= 1, d >= 1 AND len + d >= 150
 FROM (SELECT v.*, k.lx, k.ly, k.len, k.piece, sqrt((v.x-k.lx)*(v.x-k.lx)+(v.y-k.ly)*(v.y-k.ly)) AS d FROM k JOIN v ON v.icao = k.icao AND v.fid = k.fid AND v.rn = k.rn + 1) j)
 SELECT icao, fid, rn, lx AS x, ly AS y, CASE WHEN cut THEN piece - 1 ELSE piece END AS piece FROM k WHERE kept UNION ALL SELECT icao, fid, rn, lx, ly, piece FROM k WHERE cut) z),
pc AS (SELECT icao, floor(arg_min(x, rn)/300) AS tx, floor(arg_min(y, rn)/300) AS ty, count(*) AS n, sum(round(x)) AS sx, min(round(x)) AS x0, min(round(y)) AS y0, max(round(x)) AS x1, max(round(y)) AS y1 FROM e GROUP BY icao, fid, piece HAVING count(*) > 1 AND max(greatest(abs(x), abs(y))) <= 20000),
al AS (SELECT icao, tx, ty, 1 AS l, n, sx, 0 AS t, x0, y0, x1, y1 FROM pc UNION ALL SELECT icao, floor(x/300), floor(y/300), 0, 0, 0, 1, round(x), round(y), round(x), round(y) FROM lb)
SELECT icao, cast(tx AS bigint) AS tile_x, cast(ty AS bigint) AS tile_y, cast(min(x0) AS bigint) AS min_x, cast(min(y0) AS bigint) AS min_y, cast(max(x1) AS bigint) AS max_x, cast(max(y1) AS bigint) AS max_y, cast(sum(l) AS bigint) AS lines, cast(sum(n) AS bigint) AS points, cast(sum(sx) AS bigint) AS sum_x, cast(sum(t) AS bigint) AS labels FROM al GROUP BY 1, 2, 3""")
def k10(t):
    pieces = measure.cut_pieces(stretched(t), ["icao", "fid"]).withColumn("layer", F.lit("guide"))
    e = maps.tile_extract(pieces, labels(t))
    points = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, p: a + F.size(p.points))
    sum_x = F.aggregate(F.flatten(F.transform("lines", lambda p: p.points)), F.lit(0).cast("bigint"), lambda a, p: a + p.x)
    return e.select("icao", "tile_x", "tile_y", "min_x", "min_y", "max_x", "max_y", F.size("lines").cast("bigint").alias("lines"), points.alias("points"), sum_x.alias("sum_x"), F.size("labels").cast("bigint").alias("labels"))
