"""Spatial joins, overlay, network, validation and capture queries (J, G, A, N, V, F08-F09, M02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, geo, shapes, text
from ..functions.geo import rnd
from ..operators import lines, maps, measure, network, ordered, overlay, pavement, runway, spatial, structures, validate
from .registry import query
from .relational import EDGE_POS, RUNS, edge_positions, light_objects, painted_runs, registry_tables, square_vertices, strip_ends
from .scalar import SEGS, r, vertex_segments


def sd(px, py, x0="x0", y0="y0", x1="x1", y1="y1"):
    """SQL point-segment distance, operation for operation the library's."""
    dx, dy = f"({x1}-{x0})", f"({y1}-{y0})"
    l2 = f"({dx}*{dx}+{dy}*{dy})"
    t = f"(CASE WHEN {l2} < 1e-12 THEN 0.0::double ELSE least(greatest((({px}-{x0})*{dx}+({py}-{y0})*{dy})/{l2}, 0.0), 1.0) END)"
    return f"sqrt(({x0}+{t}*{dx}-{px})*({x0}+{t}*{dx}-{px})+({y0}+{t}*{dy}-{py})*({y0}+{t}*{dy}-{py}))"


def stands(t):
    """Stand positions moved off the integer grid, so no point sits on an edge."""
    return t.b_stand.withColumn("x", F.col("x") * 3 + 0.37).withColumn("y", F.col("y") * 3 + 0.41)


ST = "st AS (SELECT icao, sid, x*3 + 0.37::double AS x, y*3 + 0.41::double AS y, source, name FROM b_stand)"


def pavement_polys(t):
    return (t.b_pavement.withColumn("geom", F.array(shapes.rect_along("x", "y", "hd", "len", "wid")))
            .withColumn("hint", text.pavement_hint("name")))


def in_rect(px, py, p="p."):
    u = f"(({px}-{p}x)*sin(radians({p}hd))+({py}-{p}y)*cos(radians({p}hd)))"
    v = f"(({px}-{p}x)*cos(radians({p}hd))-({py}-{p}y)*sin(radians({p}hd)))"
    return u, v


def inside_sql(px, py, p="p."):
    u, v = in_rect(px, py, p)
    return f"({u} > 0 AND {u} < {p}len AND abs({v}) < {p}wid/2)"


def rect_dist(px, py, p="p."):
    u, v = in_rect(px, py, p)
    du, dv = f"greatest(-{u}, {u}-{p}len, 0)", f"greatest(abs({v})-{p}wid/2, 0)"
    return f"sqrt({du}*{du}+{dv}*{dv})"


STRIP_RECT = "sr AS (SELECT icao, rid, x0 AS x, y0 AS y, hd, len, width_m AS wid FROM b_strip WHERE width_m >= 1)"


def strip_polys(t):
    return t.b_strip.filter("width_m >= 1").withColumn("heading", F.col("hd")).withColumn("length", F.col("len")).withColumn(
        "idrwy", text.pair_id("ident0", "ident1")).withColumn("geom", F.array(shapes.rect_along("ax", "ay", "hd", "len", "width_m")))


def edges_named(t):
    return (edge_positions(t).filter("restriction <> 'runway'").withColumn("wingspan", codes.restriction_wingspan("restriction"))
            .select("icao", "eid", "name", "wingspan", "ax", "ay", "bx", "by"))


@query("J07_lines_across_runways", f"""WITH g AS (SELECT icao, ident0 AS k, arg_min(rid, (ident0 || '/' || ident1) || lpad(cast(rid AS string), 9, '0')) AS rid FROM b_strip GROUP BY icao, ident0),
q AS (SELECT s.icao, s.rid, g.rid AS at FROM b_strip s JOIN g ON g.icao = s.icao AND g.k = s.ident0 WHERE s.rid % 4 = 0), e AS (SELECT q.icao, q.rid, b.* EXCLUDE (icao, rid) FROM q JOIN b_strip b ON b.rid = q.at)
SELECT icao, rid, {r('x0 - cos(radians(hd))*width_m/2')} AS ax, {r('y0 + sin(radians(hd))*width_m/2')} AS ay, {r('x0 + cos(radians(hd))*width_m/2')} AS bx, {r('y0 - sin(radians(hd))*width_m/2')} AS by FROM e""".replace(" AS by FROM e", ' AS "by" FROM e'))
def j07(t):
    ends = runway.runway_ends(runway.runway_geometry(t.b_strip.withColumn("source", F.lit("xplane")).withColumn("width_m", F.greatest("width_m", F.lit(1.0))), dedupe=False))
    ends = ends.join(t.b_strip.select("icao", "rid", F.col("width_m").alias("_w")), ["icao", "rid"]).withColumn("width_m", F.col("_w")).drop("_w").filter("end_no = 0")
    rows = t.b_strip.filter("rid % 4 = 0").select("icao", "rid", F.lower("ident0").alias("runway_end"), F.lit("BAK-12").alias("kind"), F.lit(None).cast("double").alias("distance_m"), F.lit("faa_nasr").alias("source"))
    a = runway.across_runway(rows, ends)
    rx, ry = geo.right_of(*geo.unit("e.hdg"))
    half = F.col("e.width_m") / 2
    return a.select("icao", "rid", rnd(F.col("e.ex") - rx * half, 3).alias("ax"), rnd(F.col("e.ey") - ry * half, 3).alias("ay"), rnd(F.col("e.ex") + rx * half, 3).alias("bx"), rnd(F.col("e.ey") + ry * half, 3).alias("by"))


def _corners(alias):
    """SQL corners of a strip rectangle, counter-clockwise, as four (x, y) pairs."""
    c = f"cos(radians({alias}.hd))*{alias}.wid/2"
    s = f"sin(radians({alias}.hd))*{alias}.wid/2"
    ex, ey = f"({alias}.x+sin(radians({alias}.hd))*{alias}.len)", f"({alias}.y+cos(radians({alias}.hd))*{alias}.len)"
    return [(f"{alias}.x-{c}", f"{alias}.y+{s}"), (f"{alias}.x+{c}", f"{alias}.y-{s}"), (f"{ex}+{c}", f"{ey}-{s}"), (f"{ex}-{c}", f"{ey}+{s}")]


def overlap_sql(pairs: str, a: str = "a", b: str = "b") -> str:
    """CTEs ending in ``ov(key columns, area)``: overlap of two rectangles by Green's theorem.

    Every edge of either rectangle is clipped to the other in its axes; the pieces bound the
    overlap, so half the sum of their cross products is its area.
    """
    def edges(own, other):
        c = _corners(own)
        return " UNION ALL ".join(
            f"SELECT pid, {c[i][0]} AS x0, {c[i][1]} AS y0, {c[(i + 1) % 4][0]} AS x1, {c[(i + 1) % 4][1]} AS y1, {other}.x AS ox, {other}.y AS oy, {other}.hd AS ohd, {other}.len AS olen, {other}.wid AS owid FROM {pairs}"
            for i in range(4))
    return f"""ed AS ({edges(a, b)} UNION ALL {edges(b, a)}),
lc AS (SELECT pid, x0, y0, x1, y1, (x0-ox)*sin(radians(ohd))+(y0-oy)*cos(radians(ohd)) AS u0, (x0-ox)*cos(radians(ohd))-(y0-oy)*sin(radians(ohd)) AS v0,
 (x1-ox)*sin(radians(ohd))+(y1-oy)*cos(radians(ohd)) AS u1, (x1-ox)*cos(radians(ohd))-(y1-oy)*sin(radians(ohd)) AS v1, olen, owid/2 AS h FROM ed),
iv AS (SELECT pid, x0, y0, x1, y1, greatest(0, CASE WHEN abs(u1-u0) < 1e-9 THEN CASE WHEN u0 BETWEEN 0 AND olen THEN 0 ELSE 2 END ELSE least((0-u0)/(u1-u0), (olen-u0)/(u1-u0)) END,
  CASE WHEN abs(v1-v0) < 1e-9 THEN CASE WHEN v0 BETWEEN -h AND h THEN 0 ELSE 2 END ELSE least((-h-v0)/(v1-v0), (h-v0)/(v1-v0)) END) AS t0,
 least(1, CASE WHEN abs(u1-u0) < 1e-9 THEN CASE WHEN u0 BETWEEN 0 AND olen THEN 1 ELSE -1 END ELSE greatest((0-u0)/(u1-u0), (olen-u0)/(u1-u0)) END,
  CASE WHEN abs(v1-v0) < 1e-9 THEN CASE WHEN v0 BETWEEN -h AND h THEN 1 ELSE -1 END ELSE greatest((-h-v0)/(v1-v0), (h-v0)/(v1-v0)) END) AS t1 FROM lc),
ov AS (SELECT pid, sum((x0+t0*(x1-x0))*(y0+t1*(y1-y0)) - (x0+t1*(x1-x0))*(y0+t0*(y1-y0)))/2 AS area FROM iv WHERE t1 > t0 GROUP BY pid)"""


STRIP_PAIRS = f"""{STRIP_RECT}, sp AS (SELECT a.icao, a.rid AS l_rid, b.rid AS r_rid, a.icao || '-' || a.rid || '-' || b.rid AS pid, a AS a, b AS b FROM (SELECT s.*, ident0 || '/' || ident1 AS idrwy FROM sr s JOIN b_strip USING (icao, rid)) a0
 JOIN sr a ON a.icao = a0.icao AND a.rid = a0.rid JOIN (SELECT s.*, ident0 || '/' || ident1 AS idrwy FROM sr s JOIN b_strip USING (icao, rid)) b0 ON b0.icao = a0.icao AND (a0.idrwy < b0.idrwy OR (a0.idrwy = b0.idrwy AND a0.rid < b0.rid))
 JOIN sr b ON b.icao = b0.icao AND b.rid = b0.rid)"""


@query("J09_runway_overlaps", f"""WITH {STRIP_PAIRS}, {overlap_sql('sp')} SELECT icao, l_rid, r_rid, {r('area', 2)} AS area FROM sp JOIN ov USING (pid) WHERE area > 1""")
def j09(t):
    return runway.runway_overlaps(strip_polys(t)).select("icao", "l_rid", "r_rid", rnd("area", 2).alias("area"))


@query("J10_line_crossings", f"""WITH {SEGS}, g AS (SELECT icao, fid AS way, seq, x0*3+y0/7 AS x0, y0*3-x0/5 AS y0, x1*3+y1/7 AS x1, y1*3-x1/5 AS y1 FROM segs),
p AS (SELECT a.icao, a.way AS a_way, b.way AS b_way, a.seq AS a_seq, b.seq AS b_seq, a.x0, a.y0, a.x1, a.y1, (a.x1-a.x0)*(b.y1-b.y0)-(a.y1-a.y0)*(b.x1-b.x0) AS den, ((b.x0-a.x0)*(b.y1-b.y0)-(b.y0-a.y0)*(b.x1-b.x0)) AS tn, ((b.x0-a.x0)*(a.y1-a.y0)-(b.y0-a.y0)*(a.x1-a.x0)) AS un
 FROM g a JOIN g b ON a.icao = b.icao AND a.way < b.way)
SELECT icao, a_way, b_way, a_seq, b_seq, {r('x0 + tn/den*(x1-x0)', 2)} AS x, {r('y0 + tn/den*(y1-y0)', 2)} AS y FROM p WHERE abs(den) >= 1e-12 AND tn/den BETWEEN 0 AND 1 AND un/den BETWEEN 0 AND 1""")
def j10(t):
    s = vertex_segments(t).withColumnRenamed("fid", "way")
    for a, b in (("ax", "ay"), ("bx", "by")):
        s = s.withColumn("_u", F.col(a) * 3 + F.col(b) / 7).withColumn("_v", F.col(b) * 3 - F.col(a) / 5).drop(a, b).withColumnRenamed("_u", a).withColumnRenamed("_v", b)
    return spatial.crossings(s, ["seq"]).select("icao", "a_way", "b_way", "a_seq", "b_seq", rnd("x", 2).alias("x"), rnd("y", 2).alias("y"))


@query("J11_stand_to_apron", f"""WITH {ST} SELECT st.icao, sid, min(pid) AS pid FROM st JOIN b_pavement p ON p.icao = st.icao AND {inside_sql('st.x', 'st.y')} GROUP BY st.icao, sid""")
def j11(t):
    hits = spatial.points_in_polygons(stands(t), pavement_polys(t), ["sid"], ["pid"])
    return hits.groupBy("icao", "sid").agg(F.min("pid").alias("pid"))


MIDS = f"{EDGE_POS}, mid AS (SELECT icao, eid, name, (x0+x1)/2*2 + 0.37::double AS x, (y0+y1)/2*2 + 0.41::double AS y FROM ep WHERE restriction <> 'runway')"


def mids(t):
    e = edge_positions(t).filter("restriction <> 'runway'")
    return e.select("icao", "eid", "name", ((F.col("ax") + F.col("bx")) / 2 * 2 + 0.37).alias("x"), ((F.col("ay") + F.col("by")) / 2 * 2 + 0.41).alias("y"))


@query("J12_counts_on_pavement", f"""WITH {ST}, {MIDS}, a AS (SELECT p.icao, p.pid, count(*) AS n FROM st JOIN b_pavement p ON p.icao = st.icao AND {inside_sql('st.x', 'st.y')} GROUP BY 1, 2),
b AS (SELECT p.icao, p.pid, count(*) AS n FROM mid JOIN b_pavement p ON p.icao = mid.icao AND {inside_sql('mid.x', 'mid.y')} GROUP BY 1, 2) SELECT icao, pid, coalesce(a.n, 0) AS stands, coalesce(b.n, 0) AS edges FROM a FULL JOIN b USING (icao, pid)""")
def j12(t):
    p = pavement_polys(t)
    a = spatial.points_in_polygons(stands(t), p, ["sid"], ["pid"]).groupBy("icao", "pid").agg(F.count(F.lit(1)).alias("stands"))
    b = spatial.points_in_polygons(mids(t), p, ["eid"], ["pid"]).groupBy("icao", "pid").agg(F.count(F.lit(1)).alias("edges"))
    return a.join(b, ["icao", "pid"], "full").na.fill(0)


@query("J13_touching_runways", f"""WITH {STRIP_RECT}, c AS (SELECT p.icao, p.pid, unnest([0, 0, 1, 1]) AS ku, unnest([-1, 1, 1, -1]) AS kv, p.x, p.y, p.hd, p.len, p.wid FROM b_pavement p),
k AS (SELECT icao, pid, x + sin(radians(hd))*len*ku + cos(radians(hd))*wid/2*kv AS px, y + cos(radians(hd))*len*ku - sin(radians(hd))*wid/2*kv AS py FROM c),
hit1 AS (SELECT DISTINCT k.icao, pid FROM k JOIN sr p ON p.icao = k.icao WHERE {rect_dist('px', 'py')} <= 1),
hit2 AS (SELECT DISTINCT p.icao, p.pid FROM b_pavement p JOIN (SELECT icao, unnest([0, 0, 1, 1]) AS ku, unnest([-1, 1, 1, -1]) AS kv, * EXCLUDE (icao) FROM sr) s ON s.icao = p.icao WHERE {rect_dist("(s.x + sin(radians(s.hd))*s.len*ku + cos(radians(s.hd))*s.wid/2*kv)", "(s.y + cos(radians(s.hd))*s.len*ku - sin(radians(s.hd))*s.wid/2*kv)")} <= 1),
pr AS (SELECT p.icao, p.pid AS k, p.icao || '-' || p.pid || '-' || s.rid AS pid, p AS a, s AS b FROM b_pavement p0 JOIN (SELECT icao, pid, x, y, hd, len, wid FROM b_pavement) p ON p.pid = p0.pid JOIN sr s ON s.icao = p.icao), {overlap_sql('pr')},
hit3 AS (SELECT DISTINCT icao, k AS pid FROM pr JOIN ov USING (pid) WHERE area > 1e-6)
SELECT icao, pid FROM hit1 UNION SELECT icao, pid FROM hit2 UNION SELECT icao, pid FROM hit3""")
def j13(t):
    p, s = pavement_polys(t), strip_polys(t)
    return structures._features_near(p.select("icao", "pid", "geom"), ["pid"], s.select("icao", "geom"), 1.0, many=True)


@query("J14_within_distance", f"""WITH {ST}, {SEGS} SELECT icao, sid FROM st WHERE EXISTS (SELECT 1 FROM segs s WHERE s.icao = st.icao AND {sd('st.x/3', 'st.y/3')} <= 20)""")
def j14(t):
    p = stands(t).withColumn("x", F.col("x") / 3).withColumn("y", F.col("y") / 3)
    return spatial.within(p, vertex_segments(t), 20.0).select("icao", "sid")


SAMPLES = f"""{SEGS}, v AS (SELECT icao, fid, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY icao, fid) AS n, x + 0.37::double AS x, y + 0.41::double AS y FROM b_vertex WINDOW w AS (PARTITION BY icao, fid ORDER BY seq)),
smp AS (SELECT * FROM v WHERE n >= 2 AND (n <= 3 OR i IN (0, n // 2, n - 1)))"""


def shifted_segments(t):
    s = vertex_segments(t)
    for n in ("ax", "bx"):
        s = s.withColumn(n, F.col(n) + 0.37)
    for n in ("ay", "by"):
        s = s.withColumn(n, F.col(n) + 0.41)
    return s


@query("J15_voted_edge_name", f"""WITH {SAMPLES}, {EDGE_POS}, e AS (SELECT * FROM ep WHERE restriction <> 'runway' AND name IS NOT NULL),
d AS (SELECT s.icao, s.fid, s.i, e.name, e.eid, {sd('s.x', 's.y')} AS d FROM smp s JOIN e ON e.icao = s.icao),
b AS (SELECT *, row_number() OVER (PARTITION BY icao, fid, i ORDER BY d, eid) AS rn FROM d WHERE d <= 40), k AS (SELECT icao, fid, name, count(*) AS n FROM b WHERE rn = 1 GROUP BY 1, 2, 3)
SELECT icao, fid, name FROM (SELECT *, row_number() OVER (PARTITION BY icao, fid ORDER BY n DESC, name) AS rn FROM k) q WHERE rn = 1""")
def j15(t):
    keys = ["icao", "fid"]
    s = lines.with_measures(shifted_segments(t), keys)
    facts = s.groupBy(*keys).agg((F.count(F.lit(1)) + 1).alias("n"))
    v = lines.vote_edge_name(lines.samples(s, keys, facts), edges_named(t).filter("name IS NOT NULL"), keys, 40.0)
    return v.select("icao", "fid", F.col("edge_name").alias("name"))


@query("J16_nearest_runway", f"""WITH {ST}, d AS (SELECT st.icao, sid, rid, ident0 || '/' || ident1 AS idrwy, {sd('st.x', 'st.y')} AS d FROM st JOIN b_strip s ON s.icao = st.icao AND width_m >= 1),
b AS (SELECT *, row_number() OVER (PARTITION BY icao, sid ORDER BY d, idrwy, rid) AS rn FROM d WHERE d <= 500) SELECT st.icao, st.sid, idrwy, {r('d')} AS dist FROM st LEFT JOIN b ON b.icao = st.icao AND b.sid = st.sid AND rn = 1""")
def j16(t):
    return lines.nearest_runway(stands(t), strip_polys(t), 500.0, "x", "y").select("icao", "sid", "idrwy", rnd("rwy_dist", 3).alias("dist"))


@query("J17_nearest_direction", f"""WITH {ST}, {SEGS}, g AS (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS l FROM segs), d AS (SELECT st.icao, sid, (x1-x0)/l AS ux, (y1-y0)/l AS uy, {sd('st.x', 'st.y')} AS d FROM st JOIN g ON g.icao = st.icao WHERE l > 0.01),
b AS (SELECT *, row_number() OVER (PARTITION BY icao, sid ORDER BY d, ux, uy) AS rn FROM d WHERE d < 60) SELECT st.icao, st.sid, {r('coalesce(ux, 1)')} AS ux, {r('coalesce(uy, 0)')} AS uy FROM st LEFT JOIN b ON b.icao = st.icao AND b.sid = st.sid AND rn = 1""")
def j17(t):
    size = geo.dist("ax", "ay", "bx", "by")
    s = vertex_segments(t).filter(size > 0.01).withColumn("ux", (F.col("bx") - F.col("ax")) / size).withColumn("uy", (F.col("by") - F.col("ay")) / size)
    return lines.nearest_direction(stands(t), s).select("icao", "sid", rnd("ux", 3).alias("ux"), rnd("uy", 3).alias("uy"))


@query("J18_stand_to_edge", f"""WITH {ST}, {EDGE_POS}, d AS (SELECT st.icao, sid, eid, {sd('st.x', 'st.y')} AS d FROM st JOIN ep ON ep.icao = st.icao AND restriction <> 'runway'), b AS (SELECT *, row_number() OVER (PARTITION BY icao, sid ORDER BY d, eid) AS rn FROM d WHERE d <= 250)
SELECT icao, sid, eid, {r('d')} AS dist FROM b WHERE rn = 1""")
def j18(t):
    n = spatial.nearest(stands(t), edges_named(t), 250.0, ["eid"], ["eid"], cell=250.0, wide=True)
    return n.filter("eid IS NOT NULL").select("icao", "sid", "eid", rnd("dist", 3).alias("dist"))


@query("J19_line_end_to_stand", f"""WITH {ST}, f AS (SELECT icao, fid, arg_min(x, seq)*3 AS fx, arg_min(y, seq)*3 AS fy, arg_max(x, seq)*3 AS lx, arg_max(y, seq)*3 AS ly, count(*) AS n FROM b_vertex GROUP BY 1, 2),
d AS (SELECT f.icao, fid, sid, least(sqrt(power(st.x-fx,2)+power(st.y-fy,2)), sqrt(power(st.x-lx,2)+power(st.y-ly,2))) AS d FROM f JOIN st ON st.icao = f.icao WHERE n >= 2), b AS (SELECT *, row_number() OVER (PARTITION BY icao, fid ORDER BY d, sid) AS rn FROM d WHERE d < 20)
SELECT icao, fid, sid, {r('d')} AS dist FROM b WHERE rn = 1""")
def j19(t):
    v = t.b_vertex.groupBy("icao", "fid").agg(F.min_by(F.struct((F.col("x") * 3).alias("x"), (F.col("y") * 3).alias("y")), "seq").alias("a"), F.max_by(F.struct((F.col("x") * 3).alias("x"), (F.col("y") * 3).alias("y")), "seq").alias("z"), F.count(F.lit(1)).alias("n"))
    tips = v.filter("n >= 2").select("icao", "fid", F.explode(F.array("a", "z")).alias("e")).select("icao", "fid", F.col("e.x").cast("double").alias("x"), F.col("e.y").cast("double").alias("y"))
    n = spatial.nearest(tips, spatial.as_segments(stands(t)), 20.0, ["sid"], ["sid"], strict=True).filter("sid IS NOT NULL")
    return n.groupBy("icao", "fid").agg(F.min(F.struct("dist", "sid")).alias("b")).select("icao", "fid", "b.sid", rnd("b.dist", 3).alias("dist"))


def stand_rows(t):
    s = stands(t)
    ring = shapes.rect_centered("x", "y", F.lit(0.0), F.lit(30.0), F.lit(30.0))
    return (s.withColumn("jetway", F.when((F.col("source") == "osm") & (F.col("sid") % 3 == 0), F.col("sid") % 2 == 1))
            .withColumn("outline", F.when((F.col("source") == "osm") & (F.col("sid") % 5 == 0), ring)).withColumn("name", F.when(F.col("sid") % 7 == 1, "").otherwise(F.col("name"))))


STAND_PAIRS = f"""{ST}, s2 AS (SELECT *, CASE WHEN sid % 7 = 1 THEN '' ELSE name END AS nm FROM st), x AS (SELECT * FROM s2 WHERE source = 'xplane'), o AS (SELECT * FROM s2 WHERE source <> 'xplane'),
m0 AS (SELECT o.icao, o.sid, x.sid AS target, sqrt((x.x-o.x)*(x.x-o.x)+(x.y-o.y)*(x.y-o.y)) AS d FROM o JOIN x ON x.icao = o.icao), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY icao, sid ORDER BY d, target) AS rn FROM m0 WHERE d < 25) q WHERE rn = 1)"""


@query("J20_conflated_stands", f"""WITH {STAND_PAIRS} SELECT icao, sid FROM x UNION ALL SELECT icao, sid FROM o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.icao = o.icao AND m.sid = o.sid) AND (nm <> '' OR NOT EXISTS (SELECT 1 FROM x WHERE x.icao = o.icao))""")
def j20(t):
    from ..operators.conflate import merge_stands
    return merge_stands(stand_rows(t)).select("icao", "sid")


@query("J21_stand_attributes", f"""WITH {STAND_PAIRS}, j AS (SELECT icao, target, sid % 2 = 1 AS jetway, row_number() OVER (PARTITION BY icao, target ORDER BY d, sid) AS k FROM m WHERE sid % 3 = 0), g AS (SELECT DISTINCT icao, target FROM m WHERE sid % 5 = 0)
SELECT x.icao, x.sid, j.jetway, g.target IS NOT NULL AS has_outline FROM x LEFT JOIN j ON j.icao = x.icao AND j.target = x.sid AND k = 1 LEFT JOIN g ON g.icao = x.icao AND g.target = x.sid""")
def j21(t):
    from ..operators.conflate import merge_stands
    return merge_stands(stand_rows(t)).filter("source = 'xplane'").select("icao", "sid", "jetway", F.col("outline").isNotNull().alias("has_outline"))


@query("J22_unpainted_holds", f"""WITH {ST}, {SEGS} SELECT icao, sid FROM st WHERE NOT EXISTS (SELECT 1 FROM segs s WHERE s.icao = st.icao AND line = 4 AND {sd('st.x/3', 'st.y/3')} < 15)""")
def j22(t):
    p = stands(t).withColumn("x", F.col("x") / 3).withColumn("y", F.col("y") / 3)
    return spatial.within(p, vertex_segments(t).filter("line = 4"), 15.0, "left_anti", strict=True).select("icao", "sid")


@query("J23_hole_to_outer", f"""WITH {ST} SELECT st.icao AS grp, sid AS "inner", min(pid) AS "outer" FROM st JOIN b_pavement p ON p.icao = st.icao AND {inside_sql('st.x', 'st.y')} GROUP BY 1, 2""")
def j23(t):
    from ..sources.osm import holes_to_outers
    ring = shapes.rect_along("x", "y", F.lit(0.0), F.lit(5.0), F.lit(5.0))
    inner = stands(t).select(F.col("icao").alias("grp"), F.col("sid").alias("ring"), F.array(F.concat(F.array(shapes.pt("x", "y")), ring)).alias("geom"))
    outer = pavement_polys(t).select(F.col("icao").alias("grp"), F.col("pid").alias("ring"), "geom")
    return holes_to_outers(outer, inner)


@query("J25_stray_thresholds", f"""WITH {STRIP_RECT}, {ST} SELECT icao, sid AS tid FROM st WHERE NOT EXISTS (SELECT 1 FROM sr p WHERE p.icao = st.icao AND ({rect_dist('st.x', 'st.y')} < 1 OR {inside_sql('st.x', 'st.y')}))""")
def j25(t):
    return validate.stray_thresholds(stands(t).withColumnRenamed("sid", "tid"), strip_polys(t).select("icao", "geom")).select("icao", "tid")


@query("J27_helipad_outlines", """SELECT h.icao, eid, p.pid AS aid FROM b_element h LEFT JOIN (SELECT icao, name, min(pid) AS pid FROM b_pavement GROUP BY 1, 2) p ON p.icao = h.icao AND p.name = CASE h.eid % 3 WHEN 0 THEN 'Heli Pad' WHEN 1 THEN 'A' ELSE 'H9' END""")
def j27(t):
    pads = t.b_element.select("icao", "eid", F.when(F.col("eid") % 3 == 0, "Heli Pad").when(F.col("eid") % 3 == 1, "A").otherwise("H9").alias("name"))
    return runway.helipad_outline(pads, t.b_pavement.select("icao", "name", F.col("pid").alias("aid"))).select("icao", "eid", "aid")


# ---- capture ------------------------------------------------------------------------------

CAPTURE = f"""{STRIP_RECT}, el AS (SELECT icao, eid, m, x + 0.37::double AS x, y + 0.41::double AS y FROM b_element),
cap AS (SELECT * FROM el WHERE EXISTS (SELECT 1 FROM sr p WHERE p.icao = el.icao AND {rect_dist('el.x', 'el.y')} <= 90) OR EXISTS (SELECT 1 FROM b_pavement p WHERE p.icao = el.icao AND {rect_dist('el.x', 'el.y')} <= 50))"""


def element_points(t):
    return t.b_element.select("icao", F.col("eid").alias("fid"), "m", (F.col("x") + 0.37).alias("x"), (F.col("y") + 0.41).alias("y"))


def box_extent(t, half=2500.0):
    ring = F.array(*[shapes.pt(F.lit(a), F.lit(b)) for a, b in ((-half, -half), (half, -half), (half, half), (-half, half), (-half, -half))])
    return t.b_airport.select("icao", F.array(ring).alias("geom"), F.lit(0.0).alias("margin")).withColumn("mid", F.xxhash64("geom"))


@query("F08_capture_rule", f"WITH {CAPTURE} SELECT icao, eid AS fid FROM cap")
def f08(t):
    return structures.capture(element_points(t), ["fid"], pavement_polys(t).select("icao", "geom"), strip_polys(t).select("icao", "geom"), box_extent(t), "point")


@query("F09_landmark_exception", f"""WITH {CAPTURE} SELECT icao, eid AS fid, CASE WHEN m = 5 THEN 1 WHEN m = 23 THEN 2 ELSE 4 END AS plysttyp, CASE WHEN m IN (5, 23) THEN 'E' || eid END AS name FROM el
 WHERE EXISTS (SELECT 1 FROM cap WHERE cap.eid = el.eid) OR (m IN (5, 23) AND abs(x) < 2500 AND abs(y) < 2500)""")
def f09(t):
    p = element_points(t)
    cap = structures.capture(p, ["fid"], pavement_polys(t).select("icao", "geom"), strip_polys(t).select("icao", "geom"), box_extent(t), "point")
    ext = structures.in_extent(p, ["fid"], box_extent(t), "point")
    b = p.select("icao", "fid", F.when(F.col("m") == 5, 1).when(F.col("m") == 23, 2).otherwise(4).alias("kind"), F.concat(F.lit("E"), F.col("fid").cast("string")).alias("name"), F.lit(None).cast("double").alias("height_m"), F.lit(None).cast("double").alias("levels"),
                 F.lit("osm").alias("source"), shapes.point_geom("x", "y").alias("geom"))
    return structures.build_verticalpolygonalstructure(b, cap, ext).select("icao", "fid", "plysttyp", "name")


# ---- overlay --------------------------------------------------------------------------------

PAV_STRIP = f"{STRIP_RECT}, pr AS (SELECT p.icao, p.pid AS fid, s.rid, p.icao || '-' || p.pid || '-' || s.rid AS pid, p AS a, s AS b FROM (SELECT icao, pid, x, y, hd, len, wid FROM b_pavement) p JOIN sr s ON s.icao = p.icao)"


def pavement_strip_pairs(t):
    left = pavement._box(pavement_polys(t), "l", ["pid", "geom"])
    right = pavement._box(strip_polys(t), "r", ["rid", "geom"])
    return spatial.box_pairs(left, right, 500.0)


@query("G01_convex_intersection", f"WITH {PAV_STRIP}, {overlap_sql('pr')} SELECT icao, fid, rid, {r('area', 1)} AS area FROM pr JOIN ov USING (pid) WHERE area > 0.5")
def g01(t):
    ring = shapes.clip_convex(F.col("l_geom")[0], F.col("r_geom")[0])
    return pavement_strip_pairs(t).select("icao", F.col("l_pid").alias("fid"), F.col("r_rid").alias("rid"), shapes.ring_area(ring).alias("a")).filter("a > 0.5").select("icao", "fid", "rid", rnd("a", 1).alias("area"))


@query("G02_convex_difference", f"""WITH {PAV_STRIP}, {overlap_sql('pr')} SELECT icao, fid, rid, {r('(a).len*(a).wid - area', 1)} AS area FROM pr JOIN ov USING (pid) WHERE area > 0.5""")
def g02(t):
    p = pavement_strip_pairs(t)
    cut = shapes.ring_area(shapes.clip_convex(F.col("l_geom")[0], F.col("r_geom")[0]))
    rest = F.aggregate(shapes.subtract_convex(F.col("l_geom")[0], F.col("r_geom")[0]), F.lit(0.0), lambda a, ring: a + shapes.ring_area(ring))
    return p.select("icao", F.col("l_pid").alias("fid"), F.col("r_rid").alias("rid"), cut.alias("c"), rest.alias("a")).filter("c > 0.5").select("icao", "fid", "rid", rnd("a", 1).alias("area"))


def spread_segments(t):
    """Painted segments stretched over the airport, off the grid."""
    s = vertex_segments(t)
    return s.select("icao", "fid", "seq", "line", *[(F.col(n) * 4 + k).alias(n) for n, k in (("ax", 0.37), ("ay", 0.41), ("bx", 0.37), ("by", 0.41))])


SPREAD = f"{SEGS}, sg AS (SELECT icao, fid, seq, line, x0*4+0.37::double AS x0, y0*4+0.41::double AS y0, x1*4+0.37::double AS x1, y1*4+0.41::double AS y1 FROM segs)"
_U = "((g.{0}-p.x)*sin(radians(p.hd))+(g.{1}-p.y)*cos(radians(p.hd)))"
_V = "((g.{0}-p.x)*cos(radians(p.hd))-(g.{1}-p.y)*sin(radians(p.hd)))"


@query("G03_split_lines", f"""WITH {SPREAD}, {STRIP_RECT}, l AS (SELECT g.icao, g.fid, g.seq, {_U.format('x0', 'y0')} AS u0, {_V.format('x0', 'y0')} AS v0, {_U.format('x1', 'y1')} AS u1, {_V.format('x1', 'y1')} AS v1, p.len, p.wid/2 AS h FROM sg g JOIN sr p ON p.icao = g.icao),
iv AS (SELECT icao, fid, seq, greatest(0, least((0-u0)/(u1-u0), (len-u0)/(u1-u0)), least((-h-v0)/(v1-v0), (h-v0)/(v1-v0))) AS t0, least(1, greatest((0-u0)/(u1-u0), (len-u0)/(u1-u0)), greatest((-h-v0)/(v1-v0), (h-v0)/(v1-v0))) AS t1 FROM l WHERE abs(u1-u0) >= 1e-12 AND abs(v1-v0) >= 1e-12
 UNION ALL SELECT icao, fid, seq, greatest(0, least((0-u0)/(u1-u0), (len-u0)/(u1-u0))), least(1, greatest((0-u0)/(u1-u0), (len-u0)/(u1-u0))) FROM l WHERE abs(u1-u0) >= 1e-12 AND abs(v1-v0) < 1e-12 AND abs(v0) <= h
 UNION ALL SELECT icao, fid, seq, greatest(0, least((-h-v0)/(v1-v0), (h-v0)/(v1-v0))), least(1, greatest((-h-v0)/(v1-v0), (h-v0)/(v1-v0))) FROM l WHERE abs(u1-u0) < 1e-12 AND abs(v1-v0) >= 1e-12 AND u0 BETWEEN 0 AND len),
k AS (SELECT *, max(t1) OVER (PARTITION BY icao, fid, seq ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM iv WHERE t1 - t0 > 1e-9), c AS (SELECT icao, fid, seq, sum(greatest(t1 - greatest(t0, coalesce(m, 0)), 0)) AS share FROM k GROUP BY 1, 2, 3)
SELECT g.icao, g.fid, {r('sum(coalesce(share, 0)*sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))/7', 2)} AS inside_len, {r('sum((1-coalesce(share, 0))*sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))/7', 2)} AS outside_len FROM sg g LEFT JOIN c ON c.icao = g.icao AND c.fid = g.fid AND c.seq = g.seq GROUP BY 1, 2""")
def g03(t):
    parts = overlay.split_lines(spread_segments(t), ["fid"], strip_polys(t).select("icao", "ax", "ay", "bx", "by", "width_m"))
    size = geo.dist("ax", "ay", "bx", "by")
    total = lambda inside: rnd(F.sum(F.when(F.col("inside") == inside, size).otherwise(0.0)) / 7, 2)
    return parts.groupBy("icao", "fid").agg(total(True).alias("inside_len"), total(False).alias("outside_len"))


CELL = 10
COVER = f"""cv AS (SELECT p.icao, p.pid, cx, cy FROM (SELECT *, cast(floor((x - 200)/{CELL}) AS int) AS a, cast(floor((y - 200)/{CELL}) AS int) AS b FROM b_pavement) p, generate_series(a, a + 40) g(cx), generate_series(b, b + 40) h(cy)
 WHERE {inside_sql(f'((cx+0.5)*{CELL})', f'((cy+0.5)*{CELL})')})"""


def odd_pavement(t, k):
    p = pavement_polys(t).withColumn("x", F.col("x") + 0.37).withColumn("y", F.col("y") + 0.41)
    return p.withColumn("geom", F.array(shapes.rect_along("x", "y", "hd", "len", "wid"))).filter(F.col("pid") % 2 == k)


COVER_SHIFT = COVER.replace("FROM b_pavement) p", "FROM (SELECT icao, pid, x + 0.37::double AS x, y + 0.41::double AS y, hd, len, wid FROM b_pavement) z) p")


@query("G04_cell_cover", f"""WITH {COVER_SHIFT}, o AS (SELECT DISTINCT icao, cx, cy FROM cv WHERE pid % 2 = 1) SELECT cv.icao, pid, count(*) AS cells, count(o.icao) AS covered FROM cv LEFT JOIN o ON o.icao = cv.icao AND o.cx = cv.cx AND o.cy = cv.cy WHERE pid % 2 = 0 GROUP BY 1, 2""")
def g04(t):
    return overlay.covered_share(odd_pavement(t, 0), odd_pavement(t, 1), ["pid"], float(CELL)).select("icao", "pid", "cells", "covered")


@query("A23_overlap_share", f"""WITH {COVER_SHIFT}, o AS (SELECT DISTINCT icao, cx, cy FROM cv WHERE pid % 2 = 1), k AS (SELECT cv.icao, pid, count(*) AS cells, count(o.icao) AS covered FROM cv LEFT JOIN o ON o.icao = cv.icao AND o.cx = cv.cx AND o.cy = cv.cy WHERE pid % 2 = 0 GROUP BY 1, 2)
SELECT icao, pid, {r('covered/cells', 4)} AS share, covered/cells > 0.5 AS mostly FROM k""")
def a23(t):
    return overlay.covered_share(odd_pavement(t, 0), odd_pavement(t, 1), ["pid"], float(CELL)).select("icao", "pid", rnd("share", 4).alias("share"), (F.col("share") > 0.5).alias("mostly"))


@query("A16_union_area", f"WITH {COVER_SHIFT} SELECT icao, count(DISTINCT (cx, cy)) * {float(CELL * CELL)}::double AS area FROM cv GROUP BY icao")
def a16(t):
    p = odd_pavement(t, 0).unionByName(odd_pavement(t, 1))
    return overlay.union_area(p, float(CELL))


@query("G05_point_in_polygon", f"WITH {ST} SELECT st.icao, sid, pid FROM st JOIN b_pavement p ON p.icao = st.icao AND {inside_sql('st.x', 'st.y')}")
def g05(t):
    return spatial.points_in_polygons(stands(t), pavement_polys(t), ["sid"], ["pid"])


@query("G05_holes_respected", """SELECT o.icao, s.sid, o.sid AS fid FROM b_stand o JOIN b_stand s ON s.icao = o.icao AND s.x + 0.37 > o.x AND s.x + 0.37 < o.x + 100 + o.sid % 50 AND s.y + 0.41 > o.y AND s.y + 0.41 < o.y + 100 + o.sid % 50
 WHERE NOT (s.x + 0.37 < o.x + 20 + o.sid % 50 AND s.y + 0.41 < o.y + 20 + o.sid % 50)""")
def g05h(t):
    v = square_vertices(t)
    ring = v.groupBy("icao", "fid", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda s: shapes.pt(s.x, s.y)).alias("r"))
    polys = ring.groupBy("icao", "fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "r"))), lambda s: s.r).alias("geom"))
    p = t.b_stand.select("icao", "sid", (F.col("x") + 0.37).alias("x"), (F.col("y") + 0.41).alias("y"))
    return spatial.points_in_polygons(p, polys, ["sid"], ["fid"])


HULL = """hp AS (SELECT DISTINCT icao, x, y FROM b_stand), he AS (SELECT a.icao, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, a.x*b.y - b.x*a.y AS c FROM hp a JOIN hp b ON b.icao = a.icao AND (a.x <> b.x OR a.y <> b.y)
 WHERE NOT EXISTS (SELECT 1 FROM hp p WHERE p.icao = a.icao AND ((b.x-a.x)*(p.y-a.y)-(b.y-a.y)*(p.x-a.x) < 0 OR ((b.x-a.x)*(p.y-a.y)-(b.y-a.y)*(p.x-a.x) = 0 AND (p.x-a.x)*(p.x-b.x)+(p.y-a.y)*(p.y-b.y) > 0))))"""


@query("G06_convex_hull", f"WITH {HULL} SELECT icao, count(*) AS corners, cast(sum(c) AS double)/2 AS area FROM he GROUP BY icao")
def g06(t):
    h = overlay.hull(t.b_stand, ["icao"], batch=64)
    return h.select("icao", (F.size(F.col("geom")[0]) - 1).cast("bigint").alias("corners"), shapes.ring_area(F.col("geom")[0]).alias("area"))


@query("A15_hull_per_name", """WITH hp AS (SELECT DISTINCT icao, name, x, y FROM b_stand), he AS (SELECT a.icao, a.name, a.x*b.y - b.x*a.y AS c FROM hp a JOIN hp b ON b.icao = a.icao AND b.name = a.name AND (a.x <> b.x OR a.y <> b.y)
 WHERE NOT EXISTS (SELECT 1 FROM hp p WHERE p.icao = a.icao AND p.name = a.name AND ((b.x-a.x)*(p.y-a.y)-(b.y-a.y)*(p.x-a.x) < 0 OR ((b.x-a.x)*(p.y-a.y)-(b.y-a.y)*(p.x-a.x) = 0 AND (p.x-a.x)*(p.x-b.x)+(p.y-a.y)*(p.y-b.y) > 0))))
SELECT icao, name, cast(sum(c) AS double)/2 AS area FROM he GROUP BY 1, 2 HAVING count(*) > 2""")
def a15(t):
    return overlay.hull(t.b_stand, ["icao", "name"]).select("icao", "name", shapes.ring_area(F.col("geom")[0]).alias("area"))


@query("G07_line_strips", f"WITH {SEGS} SELECT icao, fid, count(*) * 3 AS shapes, {r('sum(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))*23 + 2 * 8*11.5*11.5*sin(2*pi()/16))/7', 2)} AS area FROM segs GROUP BY 1, 2")
def g07(t):
    s = overlay.strips(vertex_segments(t), 23.0)
    return s.groupBy("icao", "fid").agg(F.count(F.lit(1)).alias("shapes"), rnd(F.sum(shapes.ring_area(F.col("geom")[0])) / 7, 2).alias("area"))


@query("G08_thinned_lines", f"""WITH q AS (SELECT icao, fid, seq, cast(x AS double) AS px, cast(y AS double) AS py, row_number() OVER w AS rn, cast(lag(x) OVER w AS double) AS x0, cast(lag(y) OVER w AS double) AS y0, cast(lead(x) OVER w AS double) AS x1, cast(lead(y) OVER w AS double) AS y1 FROM b_vertex WINDOW w AS (PARTITION BY icao, fid ORDER BY seq))
SELECT icao, fid, count(*) AS kept FROM q WHERE NOT coalesce(x0 IS NOT NULL AND x1 IS NOT NULL AND rn % 2 = 0 AND {sd('px', 'py')} < 4.1, false) GROUP BY 1, 2""")
def g08(t):
    v = t.b_vertex.select("icao", "fid", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return measure.thin(v, ["icao", "fid"], 4.1, passes=1).groupBy("icao", "fid").agg(F.count(F.lit(1)).alias("kept"))


@query("G09_ring_orientation", """SELECT icao, pid, len*wid AS outer_area, -len*wid/16 AS hole_area FROM b_pavement""")
def g09(t):
    r0 = F.reverse(shapes.rect_along("x", "y", "hd", "len", "wid"))
    hole = shapes.rect_along("x", "y", "hd", F.col("len") / 4, F.col("wid") / 4)
    g = t.b_pavement.select("icao", "pid", shapes.orient_geom(F.array(r0, hole)).alias("g"))
    return g.select("icao", "pid", rnd(shapes.signed_area(F.col("g")[0]), 4).alias("outer_area"), rnd(shapes.signed_area(F.col("g")[1]), 4).alias("hole_area"))


@query("G10_distances_and_crossings", f"""WITH {SEGS}, p AS (SELECT a.icao, a.fid, a.seq, a.x0 AS px, a.y0 AS py, b.x0, b.y0, b.x1, b.y1 FROM segs a JOIN segs b ON b.icao = a.icao AND b.fid = a.fid AND b.seq > a.seq) SELECT icao, fid, count(*) AS pairs, {r(f"sum({sd('px', 'py')})/7")} AS total FROM p GROUP BY 1, 2""")
def g10(t):
    s = vertex_segments(t)
    a = s.select("icao", "fid", F.col("seq").alias("s0"), F.col("ax").alias("px"), F.col("ay").alias("py"))
    p = a.join(s, ["icao", "fid"]).filter("seq > s0")
    return p.groupBy("icao", "fid").agg(F.count(F.lit(1)).alias("pairs"), rnd(F.sum(geo.seg_dist("px", "py", "ax", "ay", "bx", "by")) / 7, 3).alias("total"))


def ring_fragments(t):
    """Way fragments of one ring per order: four sides of a square, some reversed, one missing for some."""
    k = F.col("o_orderkey")
    corners = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    sides = []
    for i in range(4):
        a, b = corners[i], corners[i + 1]
        m = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
        pts = [a, m, b] if i % 2 == 0 else [b, m, a]
        for j, (x, y) in enumerate(pts):
            sides.append(F.struct(F.lit(i).alias("frag"), F.lit(j).alias("seq"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")))
    f = t.orders.select(k.alias("grp"), F.explode(F.array(*sides)).alias("s")).select("grp", "s.*").filter(~((F.col("grp") % 4 == 1) & (F.col("frag") == 2)))
    return f.withColumn("x", F.col("x") + F.col("grp") % 100).withColumn("y", F.col("y") + F.col("grp") % 77)


@query("G11_ring_assembly", """SELECT o_orderkey AS grp, cast(0 AS int) AS ring, CASE WHEN o_orderkey % 4 = 1 THEN 8 ELSE 9 END AS vertices, CASE WHEN o_orderkey % 4 = 1 THEN 100.0 ELSE 100.0 END::double AS area FROM orders""")
def g11(t):
    from ..sources.osm import assemble_rings
    v = assemble_rings(ring_fragments(t))
    ring = v.groupBy("grp", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda s: shapes.pt(s.x, s.y)).alias("r"))
    return ring.select("grp", "ring", F.size("r").alias("vertices"), rnd(shapes.ring_area("r"), 3).alias("area"))


@query("G12_disjoint_rings", """SELECT icao, pid, CASE WHEN pid % 2 = 0 THEN 1 ELSE 2 END AS parts, len*wid + CASE WHEN pid % 2 = 0 THEN -len*wid/16 ELSE len*wid/16 END AS area FROM b_pavement""")
def g12(t):
    outer = shapes.rect_along("x", "y", "hd", "len", "wid")
    far = F.when(F.col("pid") % 2 == 0, 0.0).otherwise(500.0)
    ux, uy = geo.unit("hd")
    hole = shapes.rect_along(F.col("x") + far + ux * F.col("len") / 4, F.col("y") + far + uy * F.col("len") / 4, "hd", F.col("len") / 4, F.col("wid") / 4)
    p = t.b_pavement.select("icao", "pid", F.array(outer, hole).alias("geom"))
    s = overlay.split_disjoint_rings(p, ["pid"])
    return s.groupBy("icao", "pid").agg(F.count(F.lit(1)).cast("int").alias("parts"), rnd(F.sum(shapes.geom_area("geom")), 4).alias("area"))


# ---- clusters and network ---------------------------------------------------------------------

@query("N06_components", """WITH RECURSIVE e AS (SELECT DISTINCT from_id AS a, from_id + s AS b FROM (SELECT o_custkey AS from_id, (SELECT count(*) FROM supplier) * (1 + o_orderkey % 2) AS s, (SELECT count(*) FROM customer) AS n FROM orders WHERE o_orderkey % 5 = 0) q WHERE from_id + s < n),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS node, a AS reach FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.reach) SELECT node, min(reach) AS label FROM w GROUP BY node""")
def n06(t):
    n, m = (df.select(F.count(F.lit(1))).scalar() for df in (t.supplier, t.customer))
    e = t.orders.filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + n * (1 + F.col("o_orderkey") % 2)).alias("b"))
    return network.components(e.filter(F.col("b") < m).distinct())


@query("A14_deicing_clusters")
def a14(t):
    p = pavement_polys(t).select("icao", F.col("pid").alias("aid"), "geom")
    return structures.deicing_clusters(p).groupBy("icao", "cluster").agg(F.count(F.lit(1)).alias("members"))


def zones(t):
    return t.b_edge.filter("eid % 10 = 1").select("icao", "eid", F.explode(F.array(F.lit("18"), F.concat(F.lit("0"), (F.col("eid") % 9).cast("string")))).alias("runway"))


@query("N01_network_from_routes", f"""WITH {EDGE_POS} SELECT icao, cast(eid AS string) AS eid, 'n' || from_id AS a, 'n' || to_id AS b, CASE WHEN restriction = 'runway' THEN 2 WHEN eid % 10 = 1 THEN 5 ELSE 1 END AS edgetype, CASE WHEN oneway THEN 2 ELSE 1 END AS direc,
 CASE WHEN restriction <> 'runway' THEN name END AS name, CASE WHEN eid % 10 = 1 THEN '0' || eid % 9 || ',18' END AS actzone FROM ep WHERE from_id <> to_id""")
def n01(t):
    _, e = network.network_from_routes(t.b_edge, t.b_node, zones(t))
    return e.select("icao", "eid", "a", "b", "edgetype", "direc", "name", "actzone")


def taxi_lines(t):
    """Mapped centrelines: one per route edge, as two-point ways."""
    e = edge_positions(t).filter("from_id <> to_id")
    ends = F.array(F.struct(F.lit(0).alias("seq"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit(1).alias("seq"), F.col("bx").alias("x"), F.col("by").alias("y")))
    v = e.select("icao", F.concat(F.lit("w"), F.col("eid").cast("string")).alias("way"), "name", (F.lit(20.0) + F.col("eid") % 20).alias("width_m"), F.lit(None).cast("string").alias("runway"), F.explode(ends).alias("p"))
    return v.select("icao", "way", "p.seq", "p.x", "p.y", "name", "width_m", "runway")


@query("N02_network_from_lines")
def n02(t):
    _, e, _ = network.network_from_lines(taxi_lines(t), strip_polys(t))
    return e.groupBy("icao", "edgetype").agg(F.count(F.lit(1)).alias("edges"))


def stand_attach(t):
    return stands(t).filter("source = 'xplane'").select("icao", F.col("sid").cast("string").alias("idstd"), F.col("x"), F.col("y"), F.col("x").alias("px"), F.col("y").alias("py"), F.lit(36.0).alias("wingspan"))


@query("N03_attach_stands", f"""WITH {ST}, {EDGE_POS}, d AS (SELECT st.icao, sid, {sd('st.x', 'st.y')} AS d FROM st JOIN ep ON ep.icao = st.icao AND restriction <> 'runway' AND from_id <> to_id WHERE source = 'xplane'), m AS (SELECT icao, sid, min(d) AS d FROM d GROUP BY 1, 2), n AS (SELECT icao, count(*) AS n FROM m WHERE d <= 250 AND d >= 0.5 GROUP BY icao) SELECT icao, n AS stand_edges FROM n""")
def n03(t):
    n, e = network.network_from_routes(t.b_edge, t.b_node, zones(t))
    _, out = network.attach_stands(n, e, stand_attach(t))
    return out.filter("edgetype = 3").groupBy("icao").agg(F.count(F.lit(1)).alias("stand_edges"))


@query("N04_node_classes", """WITH inc AS (SELECT icao, from_id AS nid, restriction, eid FROM b_edge WHERE from_id <> to_id UNION ALL SELECT icao, to_id, restriction, eid FROM b_edge WHERE from_id <> to_id),
fl AS (SELECT icao, nid, bool_or(restriction = 'runway') AS rw, bool_or(restriction <> 'runway' AND eid % 10 = 1) AS ex, bool_or(restriction <> 'runway' AND eid % 10 <> 1) AS tw FROM inc GROUP BY icao, nid)
SELECT icao, CASE WHEN rw AND (ex OR tw) THEN 6 WHEN rw THEN 2 WHEN ex AND tw THEN 5 ELSE 1 END AS nodetype, count(*) AS n FROM fl GROUP BY 1, 2""")
def n04(t):
    _, e = network.network_from_routes(t.b_edge, t.b_node, zones(t))
    return network.node_types(e).groupBy("icao", "nodetype").agg(F.count(F.lit(1)).alias("n"))


@query("N05_emit_network", f"""WITH {EDGE_POS}, e AS (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY cast(eid AS string)) - 1 AS edgeid FROM ep WHERE from_id <> to_id), u AS (SELECT DISTINCT n.icao, n.nid, n.x, n.y FROM b_node n WHERE EXISTS (SELECT 1 FROM e WHERE e.icao = n.icao AND (from_id = n.nid OR to_id = n.nid))),
n AS (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY x, y, 'n' || nid) - 1 AS nodeid FROM u) SELECT e.icao, edgeid, a.nodeid AS stnode, b.nodeid AS ennode, {r('sqrt(cast((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) AS double))', 1)} AS edgelen FROM e JOIN n a ON a.icao = e.icao AND a.nid = from_id JOIN n b ON b.icao = e.icao AND b.nid = to_id""")
def n05(t):
    n, e = network.network_from_routes(t.b_edge, t.b_node, zones(t))
    n = n.withColumn("idstd", F.lit(None).cast("string")).withColumn("nodetype", F.lit(None).cast("int"))
    _, edges = network.emit_network(n, e)
    return edges.select("icao", "edgeid", "stnode", "ennode", "edgelen")


# ---- classification and validation -------------------------------------------------------------

@query("M02_geometric_line_class", f"""WITH {SEGS}, g AS (SELECT icao, fid, seq, x0, y0, x1, y1, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS l FROM segs), k AS (SELECT *, sum(l) OVER (PARTITION BY icao, fid ORDER BY seq) AS cum, sum(l) OVER (PARTITION BY icao, fid) AS tot FROM g),
f AS (SELECT icao, fid, arg_min(x0, seq) AS fx, arg_min(y0, seq) AS fy, arg_max(x1, seq) AS lx, arg_max(y1, seq) AS ly, max(tot) AS len, arg_min(x0 + (tot/2 - (cum - l))/l*(x1-x0), seq) FILTER (WHERE cum >= tot/2 AND l > 0) AS mx, arg_min(y0 + (tot/2 - (cum - l))/l*(y1-y0), seq) FILTER (WHERE cum >= tot/2 AND l > 0) AS my FROM k GROUP BY 1, 2),
{EDGE_POS}, d AS (SELECT f.*, eid, degrees(atan2(y1-y0, x1-x0)) AS dir, {sd('mx', 'my')} AS d FROM f JOIN ep ON ep.icao = f.icao AND restriction <> 'runway' WHERE len >= 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY icao, fid ORDER BY d, eid) AS rn FROM d WHERE d <= 4) q WHERE rn = 1),
c AS (SELECT *, abs(degrees(atan2(ly-fy, lx-fx)) - dir) % 180 AS a FROM b), z AS (SELECT *, least(a, 180 - a) AS diff, EXISTS (SELECT 1 FROM b_strip s WHERE s.icao = c.icao AND s.width_m >= 1 AND {sd('c.mx', 'c.my', 's.x0', 's.y0', 's.x1', 's.y1')} < 350) AS near FROM c)
SELECT f.icao, f.fid, CASE WHEN z.fid IS NULL THEN 'ignore' WHEN diff > 60 AND z.len < 90 THEN CASE WHEN near THEN 'runway_hold' ELSE 'intersection_hold' END WHEN diff < 30 AND z.len >= 5 THEN 'center' ELSE 'ignore' END AS meaning FROM f LEFT JOIN z ON z.icao = f.icao AND z.fid = f.fid""")
def m02(t):
    keys = ["icao", "lid"]
    s = vertex_segments(t).withColumnRenamed("fid", "lid")
    facts = lines.line_facts(lines.with_measures(s, keys), keys).withColumn("line", F.lit(2))
    return lines.classify_lines(facts, edges_named(t), strip_polys(t)).select("icao", F.col("lid").alias("fid"), "meaning")


def checked(t):
    """Features with planted faults: short curves, non-finite vertices, missing and repeated ids."""
    reg = codes.layer_registry(t.spark)
    v = t.b_vertex.select("icao", F.when(F.col("fid") % 3 == 0, "taxiwayguidanceline").when(F.col("fid") % 3 == 1, "taxiwayelement").otherwise("nosuchlayer").alias("layer"), "fid", F.lit(0).alias("ring"), "seq",
                          F.when((F.col("fid") % 10 == 9) & (F.col("seq") == 3), F.lit(float("nan"))).otherwise(F.col("x").cast("double")).alias("x"), F.col("y").cast("double").alias("y"))
    return v, reg


@query("V01_V02_geometry_checks", """WITH q AS (SELECT icao, CASE fid % 3 WHEN 0 THEN 'taxiwayguidanceline' WHEN 1 THEN 'taxiwayelement' ELSE 'nosuchlayer' END AS layer, fid, count(*) AS n, bool_or(fid % 10 = 9 AND seq = 3) AS bad FROM b_vertex GROUP BY icao, fid)
SELECT icao, layer, fid, issue FROM (SELECT *, CASE WHEN fid % 3 = 2 OR n < CASE fid % 3 WHEN 0 THEN 2 ELSE 4 END THEN 'geometry kind mismatch or degenerate' WHEN bad THEN 'non-finite coordinate' END AS issue FROM q) z WHERE issue IS NOT NULL""")
def v01(t):
    v, reg = checked(t)
    return validate.geometry_issues(v, reg)


@query("V03_unique_ids", """WITH q AS (SELECT icao, layer, CASE WHEN fid % 50 = 7 THEN NULL ELSE 'id' || (fid // 3) END AS id FROM b_feature) SELECT icao, layer, NULL AS id, 'feature without id' AS issue FROM q WHERE id IS NULL UNION ALL
 SELECT icao, layer, id, 'duplicate id' FROM (SELECT icao, layer, id, unnest(generate_series(2, count(*))) FROM q WHERE id IS NOT NULL GROUP BY icao, layer, id HAVING count(*) > 1) z""")
def v03(t):
    f = t.b_feature.select("icao", "layer", F.when(F.col("fid") % 50 != 7, F.concat(F.lit("id"), F.floor(F.col("fid") / 3).cast("string"))).alias("id"))
    return validate.id_issues(f)


@query("V04_edge_endpoints", "SELECT e.icao, eid, 'stnode' AS side FROM b_edge e WHERE from_id % 17 = 0 UNION ALL SELECT icao, eid, 'ennode' FROM b_edge WHERE to_id % 17 = 0")
def v04(t):
    n = t.b_node.filter("nid % 17 <> 0").select("icao", F.col("nid").alias("nodeid"))
    return validate.missing_nodes(t.b_edge.select("icao", "eid", F.col("from_id").alias("stnode"), F.col("to_id").alias("ennode")), n).select("icao", "eid", "side")


@query("V05_thresholds_on_runways", f"""WITH {STRIP_RECT}, e AS (SELECT icao, rid*2 AS tid, x0 + CASE WHEN rid % 6 = 0 THEN 40 ELSE 0 END AS x, y0 AS y FROM b_strip UNION ALL SELECT icao, rid*2 + 1, x1, y1 FROM b_strip) SELECT icao, tid FROM e WHERE NOT EXISTS (SELECT 1 FROM sr p WHERE p.icao = e.icao AND {rect_dist('e.x', 'e.y')} < 1)""")
def v05(t):
    ends = strip_ends(t).select("icao", (F.col("rid") * 2 + F.col("end_no")).alias("tid"), (F.col("ex") + F.when((F.col("rid") % 6 == 0) & (F.col("end_no") == 0), 40.0).otherwise(0.0)).alias("x"), F.col("ey").alias("y"))
    return validate.stray_thresholds(ends, strip_polys(t).select("icao", "geom")).select("icao", "tid")


LAYER_VALUES = ", ".join(f"('{n}')" for n, _ in codes.LAYERS)


@query("V06_expected_layers", f"SELECT icao, layer FROM b_airport, (VALUES {LAYER_VALUES}) l(layer) WHERE NOT EXISTS (SELECT 1 FROM b_feature f WHERE f.icao = b_airport.icao AND f.layer = l.layer)")
def v06(t):
    names = F.array(*[F.lit(n) for n, _ in codes.LAYERS])
    return validate.missing_layers(t.b_feature, t.b_airport.select("icao", F.explode(names).alias("layer")))


@query("A24_validation_report")
def a24(t):
    v, reg = checked(t)
    f = v.select("icao", "layer", "fid").distinct().withColumn("id", F.when(F.col("fid") % 50 != 7, F.concat(F.lit("id"), F.floor(F.col("fid") / 3).cast("string"))))
    e = t.b_edge.select("icao", "eid", F.col("from_id").alias("stnode"), F.col("to_id").alias("ennode"))
    _, issues = validate.validate(f, v, reg, e, t.b_node.filter("nid % 17 <> 0").select("icao", F.col("nid").alias("nodeid")), stands(t).withColumnRenamed("sid", "tid"), strip_polys(t).select("icao", "geom"))
    return validate.report(issues)


@query("S18_adaptive_tiles", """WITH q AS (SELECT event_id, (lon + 180)/360 AS u, (lat + 90)/180 AS v FROM b_runlog), l AS (SELECT event_id, lv, cast(floor(u * power(2, lv)) AS int) AS tx, cast(floor(v * power(2, lv)) AS int) AS ty FROM q, generate_series(0, 5) g(lv)),
c AS (SELECT *, count(*) OVER (PARTITION BY lv, tx, ty) AS n FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY lv) AS rn FROM c WHERE n <= 300 OR lv = 5) SELECT event_id, cast(lv AS int) AS level, tx, ty, n AS n_tile FROM b WHERE rn = 1""")
def s18(t):
    p = t.b_runlog.select("event_id", ((F.col("lon") + 180) / 360).alias("x"), ((F.col("lat") + 90) / 180).alias("y"))
    return overlay.quad_tiles(p, 300, 5).select("event_id", "level", "tx", "ty", "n_tile")


assert all((RUNS, light_objects, painted_runs, registry_tables, maps, ordered))
