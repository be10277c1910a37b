"""Deterministic views that cast the given tables as airport data.

The text runs unchanged on Spark (placeholders bound to DataFrames) and on an SQL engine
(placeholders bound to common table expressions). Only arithmetic both engines agree on.
Positions named x, y are metres in the local frame of the airport.
"""

from __future__ import annotations

import re

from ..functions.codes import FEATURE_NUMBERS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

_CODE = "concat('X', lpad(cast({k} AS string), cast(greatest(3, length(cast({k} AS string))) AS int), '0'))"


def _code(k: str) -> str:
    return _CODE.replace("{k}", k)


_PICK = "CASE ln " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate([*FEATURE_NUMBERS, "bridgeside"])) + " END"
_N = "(SELECT count(*) FROM {supplier})"

VIEWS: dict[str, str] = {
    "b_airport": f"""
SELECT {_code('s_suppkey')} AS icao, s_suppkey AS k,
       CASE s_suppkey % 4 WHEN 0 THEN concat(s_name, ' International') ELSE s_name END AS name,
       concat('City ', cast(s_nationkey AS string)) AS city, n_name AS country, r_name AS continent,
       concat(n_name, '-', cast(s_suppkey % 3 AS string)) AS region,
       CASE WHEN s_suppkey % 3 = 0 THEN concat('I', cast(s_suppkey AS string)) END AS iata,
       CASE s_suppkey % 3 WHEN 0 THEN 'large_airport' WHEN 1 THEN 'medium_airport' ELSE 'small_airport' END AS kind,
       cast((s_suppkey * 7919) % 17000 AS double) / 100 - 85 AS lat,
       cast((s_suppkey * 104729) % 36000 AS double) / 100 - 180 AS lon,
       cast((s_suppkey * 37) % 9000 AS double) AS elev_ft
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    "b_runway": f"""
SELECT {_code('k')} AS icao, rid, length_ft, closed, heading, width_m, cx, cy
FROM (SELECT p_partkey % {_N} AS k, p_partkey AS rid, 2000 + p_size * 200 AS length_ft, p_partkey % 7 = 0 AS closed,
             (p_partkey * 37) % 180 AS heading, CASE p_partkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 45 ELSE 60 END AS width_m,
             (p_partkey * 131) % 1001 - 500 AS cx, (p_partkey * 177) % 1001 - 500 AS cy
      FROM {{part}}) t""",
    # Runway rows with everything a scenery row carries; local metres.
    "b_strip": f"""
SELECT {_code('k')} AS icao, rid, CASE WHEN rid % 10 = 9 THEN 'osm' ELSE 'xplane' END AS source,
       CASE WHEN rid % 50 = 49 THEN 0.5 ELSE cast(30 + (rid % 3) * 15 AS double) END AS width_m,
       cast(rid % 5 AS int) AS surface, CASE WHEN rid % 3 = 0 THEN 2 END AS shoulder_surface,
       CASE WHEN rid % 6 = 0 THEN cast(5 AS double) END AS shoulder_width_m,
       rid % 2 = 0 AS centerline_lights, cast(rid % 3 AS int) AS edge_lights,
       cx - sin(radians(hd)) * len / 2 AS x0, cy - cos(radians(hd)) * len / 2 AS y0,
       cx + sin(radians(hd)) * len / 2 AS x1, cy + cos(radians(hd)) * len / 2 AS y1,
       concat(lpad(cast(1 + cast(floor(hd / 10) AS int) AS string), 2, '0'), side0) AS ident0,
       concat(cast(19 + cast(floor(hd / 10) AS int) AS string), side1) AS ident1,
       cast(((rid * 7) % 5) * 50 AS double) AS displaced0, cast(((rid * 11) % 4) * 40 AS double) AS displaced1,
       cast((rid % 3) * 30 AS double) AS blastpad0, cast(((rid + 1) % 3) * 30 AS double) AS blastpad1,
       cast(rid % 5 AS int) AS marking0, cast((rid + 2) % 5 AS int) AS marking1,
       cast(rid % 4 AS int) AS approach0, cast((rid + 1) % 4 AS int) AS approach1,
       rid % 2 = 0 AS tdz0, rid % 5 = 0 AS tdz1,
       CASE WHEN rid % 3 = 0 THEN 1 ELSE 0 END AS reil0, CASE WHEN rid % 4 = 0 THEN 1 ELSE 0 END AS reil1,
       cast((rid % 4) * 20 AS double) AS stopway0, cast(0 AS double) AS stopway1,
       CASE WHEN rid % 6 = 0 THEN len - 100 END AS tora0, CASE WHEN rid % 6 = 0 THEN len + 60 END AS toda0,
       CASE WHEN rid % 6 = 1 THEN len - 40 END AS asda0, CASE WHEN rid % 6 = 2 THEN len - 300 END AS lda0,
       CASE WHEN rid % 6 = 3 THEN cast(rid % 900 AS double) END AS tdze0, len, hd
FROM (SELECT p_partkey % {_N} AS k, p_partkey AS rid, cast((p_partkey * 37) % 180 AS double) AS hd,
             cast(600 + p_size * 50 AS double) AS len,
             (p_partkey * 131) % 12001 - 6000 AS cx, (p_partkey * 177) % 12001 - 6000 AS cy,
             CASE p_partkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'C' ELSE 'R' END AS side0,
             CASE p_partkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'C' ELSE 'L' END AS side1
      FROM {{part}}) t""",
    "b_vertex": f"""
SELECT {_code('k')} AS icao, fid, seq, pk, seq * 40 + pk % 20 AS x, fid % 2001 - 1000 + pk % 30 AS y, line
FROM (SELECT l_orderkey % {_N} AS k, l_orderkey AS fid, l_linenumber AS seq, min(l_partkey) AS pk,
             CASE min(l_returnflag) WHEN 'A' THEN 1 WHEN 'N' THEN 4 ELSE 0 END AS line
      FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) t""",
    "b_stand": f"""
SELECT {_code('k')} AS icao, sid, x, y, source, name
FROM (SELECT o_orderkey % {_N} AS k, o_orderkey AS sid, (o_orderkey * 71) % 2001 - 1000 AS x,
             (o_orderkey * 113) % 2001 - 1000 AS y,
             CASE WHEN o_orderkey % 2 = 0 THEN 'xplane' ELSE 'osm' END AS source, o_orderpriority AS name
      FROM {{orders}}) t""",
    # Routing nodes and edges; both ends of an edge lie in the same airport.
    "b_node": f"""
SELECT {_code('k')} AS icao, nid, x, y, name
FROM (SELECT c_custkey % {_N} AS k, c_custkey AS nid, (c_custkey * 53) % 4001 - 2000 AS x,
             (c_custkey * 97) % 4001 - 2000 AS y, c_mktsegment AS name FROM {{customer}}) t""",
    "b_edge": f"""
SELECT {_code('from_id % s_n')} AS icao, eid, from_id, (from_id + s_n * (eid % 15)) % c_n AS to_id, status,
       CASE WHEN status = 'P' AND eid % 2 = 0 THEN NULL ELSE substr(priority, 3, 1) END AS name,
       CASE eid % 8 WHEN 0 THEN 'runway' WHEN 1 THEN 'taxiway' WHEN 2 THEN 'taxiway_A' WHEN 3 THEN 'taxiway_B'
            WHEN 4 THEN 'taxiway_C' WHEN 5 THEN 'taxiway_D' WHEN 6 THEN 'taxiway_E' ELSE 'taxiway_F' END AS restriction,
       eid % 5 = 0 AS oneway
FROM (SELECT o_orderkey AS eid, o_custkey AS from_id, o_orderstatus AS status, o_orderpriority AS priority,
             {_N} AS s_n, (SELECT count(*) FROM {{customer}}) AS c_n FROM {{orders}}) t""",
    # Pavement: one strip per order, axis-aligned or turned by 30 degrees.
    "b_pavement": f"""
SELECT {_code('k')} AS icao, pid, x, y, cast((pid % 2) * 30 AS double) AS hd,
       cast(40 + pid % 160 AS double) AS len, cast(20 + pid % 60 AS double) AS wid,
       cast(pid % 5 AS int) AS surface, CASE WHEN pid % 9 = 8 THEN 'osm' ELSE 'xplane' END AS source,
       CASE pid % 10 WHEN 0 THEN 'Main Apron' WHEN 1 THEN 'Cargo Ramp' WHEN 2 THEN 'A' WHEN 3 THEN 'Taxiway B'
            WHEN 4 THEN 'Service Road' WHEN 5 THEN 'Heli Pad' WHEN 6 THEN 'Runway Pavement' WHEN 7 THEN 'Pad East'
            ELSE NULL END AS name
FROM (SELECT o_orderkey % {_N} AS k, o_orderkey AS pid, cast((o_orderkey * 71) % 8001 - 4000 AS double) AS x,
             cast((o_orderkey * 113) % 8001 - 4000 AS double) AS y FROM {{orders}}) t""",
    "b_runlog": """
SELECT event_id, ts, user_id AS vehicle, event_type AS status, value AS seconds,
       cast((event_id * 6151) % 17000 AS double) / 100 - 85 AS lat,
       cast((event_id * 7727) % 36000 AS double) / 100 - 180 AS lon FROM {events}""",
    # Tagged map elements: one per customer, cycling through tag combinations.
    "b_element": f"""
SELECT {_code('k')} AS icao, eid, cast((eid * 53) % 6001 - 3000 AS double) AS x,
       cast((eid * 97) % 6001 - 3000 AS double) AS y, m, seg
FROM (SELECT c_custkey % {_N} AS k, c_custkey AS eid, cast(c_custkey % 24 AS int) AS m, c_mktsegment AS seg
      FROM {{customer}}) t""",
    # Built features of five layers, enough for counting, ids, manifests and lookups.
    "b_feature": """
SELECT icao, 'parkingstandlocation' AS layer, sid AS fid, source, cast(x AS double) AS x, cast(y AS double) AS y, name AS idlin FROM {b_stand}
UNION ALL SELECT icao, 'asrnnode', nid, 'xplane', cast(x AS double), cast(y AS double), NULL FROM {b_node}
UNION ALL SELECT icao, 'runwayelement', rid, source, (x0 + x1) / 2, (y0 + y1) / 2, NULL FROM {b_strip}
UNION ALL SELECT icao, 'taxiwayelement', pid, source, x, y, name FROM {b_pavement}
UNION ALL SELECT icao, 'verticalpointstructure', eid, 'osm', x, y, NULL FROM {b_element}""",
    # Built features of every layer the client schema serves, their attributes side by side, with gaps.
    "b_attributes": f"""
SELECT icao, {_PICK} AS layer, fid, CASE WHEN q % 5 > 0 THEN concat('N', cast(q % 97 AS string)) WHEN q % 2 = 0 THEN '' END AS name,
       CASE WHEN q % 3 = 0 THEN concat('I', cast(q % 89 AS string)) END AS iata, CASE WHEN q % 4 > 0 THEN cast(q % 9000 AS double) END AS elev,
       CASE q % 4 WHEN 0 THEN '7L/25R' WHEN 1 THEN '07L/25R+18/36' WHEN 2 THEN '9/27' END AS idrwy, CASE q % 3 WHEN 0 THEN '7L/25R+9/27' WHEN 1 THEN '01/19+04/22' END AS idrwi,
       CASE q % 4 WHEN 0 THEN '9R' WHEN 1 THEN '27' WHEN 2 THEN '4' END AS idthr, CASE WHEN q % 2 = 0 THEN '9L/27R' END AS idcross,
       CASE WHEN q % 3 > 0 THEN concat('T', cast(q % 30 AS string)) END AS idlin, CASE WHEN q % 4 = 1 THEN concat('Apron ', cast(q % 8 AS string)) END AS idapron,
       CASE WHEN q % 2 = 1 THEN concat('G', cast(q % 60 AS string)) END AS idstd, CASE q % 3 WHEN 0 THEN 'A320|B738|CRJ9' WHEN 1 THEN 'C172' END AS acft,
       CASE WHEN q % 3 = 1 THEN concat('H', cast(q % 4 AS string)) END AS ident, CASE WHEN q % 2 = 0 THEN 'D1' END AS deicegrp, CASE WHEN q % 2 = 0 THEN concat('HS', cast(q % 6 AS string)) END AS idhot,
       CASE WHEN q % 3 > 0 THEN cast(q % 60 AS double) + 0.5 END AS width, CASE WHEN q % 3 > 1 THEN cast(q % 4000 AS double) END AS length, CASE WHEN q % 2 > 0 THEN cast(q % 900 AS double) END AS tdze,
       CASE WHEN q % 5 > 1 THEN cast(q % 360 AS double) + 0.25 END AS brngtrue, CASE WHEN q % 3 = 0 THEN cast(q % 360 AS double) END AS brngmag, CASE WHEN q % 2 = 0 THEN cast(q % 4001 AS double) END AS tora,
       CASE WHEN q % 3 = 0 THEN cast(q % 4002 AS double) END AS toda, CASE WHEN q % 4 = 0 THEN cast(q % 4003 AS double) END AS asda, CASE WHEN q % 5 = 0 THEN cast(q % 4004 AS double) END AS lda,
       CASE WHEN q % 4 > 0 THEN cast(q % 66 AS double) END AS wingspan, CASE WHEN q % 3 > 0 THEN 118 + cast(q % 18 AS double) / 8 END AS frq, CASE WHEN q % 3 > 0 THEN cast(q % 90 AS double) END AS height,
       CASE WHEN q % 6 > 0 THEN cast(q % 700 AS double) END AS edgelen, CASE WHEN q % 20 < 17 THEN cast(q % 20 AS int) END AS surftype, CASE WHEN q % 6 < 5 THEN cast(q % 6 AS int) END AS status,
       CASE WHEN q % 7 < 6 THEN cast(q % 7 AS int) END AS vasis, CASE WHEN q % 5 > 0 THEN cast(q % 5 AS int) END AS thrtype, CASE WHEN q % 5 > 0 THEN cast(q % 5 AS int) END AS style,
       CASE WHEN q % 5 > 0 THEN cast(q % 5 AS int) END AS direc, CASE WHEN q % 7 > 0 THEN cast(q % 7 AS int) END AS catstop, CASE WHEN q % 9 > 0 THEN cast(q % 9 AS int) END AS plysttyp,
       CASE WHEN q % 11 > 0 THEN cast(q % 11 AS int) END AS pntsttyp, CASE WHEN q % 7 > 0 THEN cast(q % 7 AS int) END AS linsttyp, CASE WHEN q % 8 > 0 THEN cast(q % 8 AS int) END AS edgetype,
       CASE WHEN q % 10 > 0 THEN cast(q % 10 AS int) END AS nodetype, CASE q % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bridge, CASE q % 3 WHEN 1 THEN true WHEN 2 THEN false END AS jetway,
       CASE WHEN q % 9 > 0 THEN q END AS stnode, CASE WHEN q % 8 > 0 THEN q + 1 END AS ennode, CASE WHEN q % 7 > 0 THEN fid END AS nodeid
FROM (SELECT icao, sid AS fid, cast(floor(sid / 4) AS bigint) AS q, sid % 37 AS ln FROM {{b_stand}}) t""",
}


def with_views(sql: str) -> str:
    """Prefix the common table expressions a statement needs, in dependency order."""
    order: list[str] = []

    def need(text: str):
        for name in re.findall(r"\bb_[a-z_]+\b", text):
            if name in VIEWS and name not in order:
                need(re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]))
                order.append(name)

    need(sql)
    body = sql.strip()
    ctes = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n]).strip()})" for n in order]
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
