"""Scenery text: airport blocks, coded rows, rings, children attached to their parents.

A block is one row (the reader splits files at airport headers); lines, fields and rings
come out of it with built-in string and window functions, so blocks of all airports are
parsed side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, text
from ..operators.ordered import HOT_ROWS, beside, fill, has_hot_key, keep_first, running, scan

RING_END = (113, 114, 115, 116)
WITH_CONTROL = (112, 114, 116)
HEADER_KEYS = ["icao_code", "iata_code", "faa_code", "city", "country", "region_code", "datum_lat", "datum_lon", "transition_alt", "transition_level"]


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Scenery files cut at land airport headers by the reader itself: path, value."""
    return spark.read.option("lineSep", "\n1 ").text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def airport_blocks(chunks: DataFrame) -> DataFrame:
    """One row per airport, seaport or heliport: path, icao, block.

    The file head before the first airport and anything after row 99 are dropped. A chunk
    may hold further blocks headed 16 or 17. The first piece of a chunk is a land block whose
    row code the reader has cut off, so its code is the fourth field, whatever its elevation;
    only where a file begins with an airport does the row still carry its own code.
    """
    pieces = chunks.select("path", F.posexplode(F.split("value", r"\n(?=1[67]\s)")).alias("i", "b"))
    head = F.col("b").rlike(r"^\s*(I|A)\s*(\r?\n|$)")
    pieces = pieces.filter(~(head & (F.col("i") == 0)))
    own_code = F.col("b").rlike(r"^1[67]?\s+-?[0-9.]+\s+\S+\s+[0-9]+\s")
    block = F.when((F.col("i") == 0) & ~own_code, F.concat(F.lit("1 "), F.col("b"))).otherwise(F.col("b"))
    block = F.regexp_replace(block, r"(?s)\n\s*99\s*(\n.*)?$", "")
    first = F.split(F.trim(F.split(block, "\n")[0]), r"\s+")
    return pieces.select("path", F.upper(F.get(first, F.lit(4))).alias("icao"), block.alias("block")).filter(F.col("icao").isNotNull())


def first_file_wins(blocks: DataFrame, file_rank: Column) -> DataFrame:
    """Keep each airport's block from the best-ranked file (custom, global, default), then by path."""
    b = blocks.withColumn("file_rank", file_rank)
    return keep_first(b, ["icao"], ["file_rank", "path"]).drop("file_rank")


def pick_airport(blocks: DataFrame, code: str) -> DataFrame:
    return blocks.filter(F.upper("icao") == code.upper())


def coded_lines(blocks: DataFrame) -> DataFrame:
    """icao, line_no, code, f: fields after the row code; rows without a numeric code are skipped."""
    ln = blocks.select("icao", F.posexplode(F.split("block", "\n")).alias("line_no", "_raw"))
    parts = F.split(F.trim(F.regexp_replace("_raw", "\r$", "")), r"\s+")
    ln = ln.select("icao", "line_no", parts.alias("_p")).withColumn("code", F.get("_p", F.lit(0)).try_cast("int"))
    return ln.filter("code IS NOT NULL").select("icao", "line_no", "code", F.slice("_p", 2, F.size("_p")).alias("f"))


def num(i: int) -> Column:
    """Field as a number; anything unparsable is 0."""
    return F.coalesce(F.get("f", F.lit(i)).try_cast("double"), F.lit(0.0))


def whole(i: int) -> Column:
    return F.coalesce(F.get("f", F.lit(i)).try_cast("bigint"), F.get("f", F.lit(i)).try_cast("double").cast("bigint"), F.lit(0))


def word(i: int) -> Column:
    return F.get("f", F.lit(i))


def tail(i: int) -> Column:
    """Fields from ``i`` on, joined by spaces; null when there are none."""
    return F.when(F.size("f") > i, F.array_join(F.slice("f", i + 1, F.greatest(F.size("f") - i, F.lit(0))), " "))


def rows(lines: DataFrame, *row_codes: int, need: int = 0) -> DataFrame:
    return lines.filter(F.col("code").isin(*row_codes) & (F.size("f") >= need))


def headers(lines: DataFrame) -> DataFrame:
    """Header row plus key/value rows; of two values of one key the later wins.

    A latitude without a longitude (or the reverse) is dropped; zero is a latitude and a longitude like any other.
    """
    h = lines.filter(F.col("code").isin(1, 16, 17)).select("icao", word(0).try_cast("double").alias("elev_ft"), tail(4).alias("name"))
    kv = rows(lines, 1302, need=2).select("icao", "line_no", word(0).alias("k"), tail(1).alias("v"))
    # A null ordering value leaves a row out of max_by, so one pass serves every key.
    m = kv.groupBy("icao").agg(*[F.max_by("v", F.when(F.col("k") == k, F.col("line_no"))).alias(k) for k in HEADER_KEYS])
    j = h.join(m, "icao", "left")
    lat, lon = F.col("datum_lat").try_cast("double"), F.col("datum_lon").try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    return j.select("icao", F.col("iata_code").alias("iata"), F.col("faa_code").alias("faa"), "name", "city", "country", F.col("region_code").alias("region"), F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"),
                    "elev_ft", F.col("transition_alt").try_cast("double").alias("trans_alt_ft"), F.col("transition_level").alias("trans_level"))


def runways(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runway rows with both ends, and a warning per row that is too short."""
    r = rows(lines, 100)
    end = lambda k, o: [text.pad_source(word(o)).alias(f"ident{k}"), num(o + 1).alias(f"lat{k}"), num(o + 2).alias(f"lon{k}"), num(o + 3).alias(f"displaced{k}"), num(o + 4).alias(f"blastpad{k}"),
                        F.coalesce(text.lookup(codes.SCENERY_MARKING, whole(o + 5).cast("int")), F.lit(0)).alias(f"marking{k}"), whole(o + 6).cast("int").alias(f"approach{k}"), (whole(o + 7) == 1).alias(f"tdz{k}"), whole(o + 8).cast("int").alias(f"reil{k}")]
    ok = r.filter(F.size("f") >= 25).select("icao", "line_no", num(0).alias("width_m"), codes.scenery_surface(whole(1)).alias("surface"), F.when(whole(2) > 0, codes.scenery_surface(whole(2))).alias("shoulder_surface"),
                                            (whole(4) == 1).alias("centerline_lights"), whole(5).cast("int").alias("edge_lights"), *end(0, 7), *end(1, 16), F.lit("xplane").alias("source"))
    short = r.filter(F.size("f") < 25).select("icao", F.col("line_no").alias("seq"), F.concat(F.lit("short runway row: 100 "), F.array_join("f", " ")).alias("message"))
    return ok, short


def water_runways(lines: DataFrame) -> DataFrame:
    return rows(lines, 101, need=8).select("icao", "line_no", num(0).alias("width_m"), word(2).alias("ident0"), num(3).alias("lat0"), num(4).alias("lon0"), word(5).alias("ident1"), num(6).alias("lat1"), num(7).alias("lon1"))


def helipads(lines: DataFrame) -> DataFrame:
    return rows(lines, 102, need=7).select("icao", "line_no", text.pad_source(word(0)).alias("ident"), num(1).alias("lat"), num(2).alias("lon"), num(3).alias("heading"), num(4).alias("length_m"), num(5).alias("width_m"),
                                           codes.scenery_surface(whole(6)).alias("surface"), F.lit("xplane").alias("source"))


def node_fields() -> Column:
    """A node row: position, optional control, line code (< 100) and light code (>= 100), last value winning.

    Null for other rows and for rows with too few fields.
    """
    has_ctrl = F.col("code").isin(*WITH_CONTROL)
    need = F.when(has_ctrl, 4).otherwise(2)
    extra = F.transform(F.slice("f", need + 1, F.greatest(F.size("f") - need, F.lit(0))), lambda v: F.coalesce(v.try_cast("double").cast("int"), F.lit(0)))
    closing = F.col("code").isin(115, 116)
    last = lambda a: F.when(closing, 0).otherwise(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))
    fields = F.struct(num(0).alias("lat"), num(1).alias("lon"), F.when(has_ctrl, num(2)).alias("ctrl_lat"), F.when(has_ctrl, num(3)).alias("ctrl_lon"),
                      last(F.filter(extra, lambda v: v < 100)).alias("line"), last(F.filter(extra, lambda v: v >= 100)).alias("light"))
    return F.when(F.col("code").between(111, 116) & (F.size("f") >= need), fields)


def rings(lines: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nodes with their object (header line), its code and fields, ring number and closed flag.

    The object of a node is the last non-node row before it; its ring is the number of ring
    ends passed since. Rows with too few fields end rings but are no nodes. The text is taken
    apart once: all that later steps need travels in the one shuffle by airport.
    """
    hot = has_hot_key(lines, ["icao"], hot_rows)
    is_node = F.col("code").between(111, 116)
    geo = lines.select("icao", "line_no", "code", F.when(~is_node, F.struct("line_no", "code", F.when(F.col("code").isin(110, 120, 130), F.col("f")).alias("f"))).alias("_h"), node_fields().alias("_node"))
    marked = scan(geo, ["icao"], ["line_no"], hot=hot, head=fill("_h"))
    nodes = marked.filter(is_node & F.col("head.code").isin(110, 120, 130)).select("icao", "line_no", F.col("head.line_no").alias("obj"), F.col("head.code").alias("obj_code"), F.col("head.f").alias("obj_f"), "code", "_node", F.col("code").isin(*RING_END).cast("int").alias("_end"))
    nodes = scan(nodes, ["icao", "obj"], ["line_no"], hot=hot, _ends=running("_end")).withColumn("ring", (F.col("_ends") - F.col("_end")).cast("int"))
    n = nodes.filter("_node IS NOT NULL").select("icao", "line_no", "obj", "obj_code", "obj_f", "code", "ring", "_node.*")
    n = beside(n, ["icao", "obj", "ring"], hot, closed=F.max(F.col("code").isin(113, 114)), n_nodes=F.count(F.lit(1)))
    return beside(n, ["icao", "obj"], hot, n_outer=F.count_if(F.col("ring") == 0))


def pavements(lines: DataFrame, ring_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pavement attributes and vertices; ring 0 is the outer one and needs three nodes."""
    r = ring_rows.filter("obj_code = 110 AND n_outer >= 3").drop("obj_f", "n_outer")
    good = r.select("icao", "obj").distinct()
    h = rows(lines, 110).select("icao", F.col("line_no").alias("obj"), codes.scenery_surface(whole(0)).alias("surface"), tail(3).alias("name"), F.lit("xplane").alias("source"))
    return h.join(good, ["icao", "obj"], "left_semi").withColumn("hint", text.pavement_hint("name")), r


def painted_lines(ring_rows: DataFrame) -> DataFrame:
    return ring_rows.filter("obj_code = 120").withColumnRenamed("obj_f", "f").withColumn("name", tail(0)).drop("f", "n_outer")


def boundary(ring_rows: DataFrame) -> DataFrame:
    """Vertices of the first boundary ring of each airport."""
    b = ring_rows.filter("obj_code = 130").drop("obj_f", "n_outer")
    first = b.groupBy("icao").agg(F.min(F.struct("obj", "ring")).alias("_f")).select("icao", "_f.*")
    return b.join(first, ["icao", "obj", "ring"], "left_semi")


def beacons(lines: DataFrame) -> DataFrame:
    return rows(lines, 18, need=3).select("icao", "line_no", num(0).alias("lat"), num(1).alias("lon"), F.lit(5).alias("kind"), tail(3).alias("name"))


def windsocks(lines: DataFrame) -> DataFrame:
    return rows(lines, 19, need=3).select("icao", "line_no", num(0).alias("lat"), num(1).alias("lon"), F.lit(6).alias("kind"), F.lit(6.0).alias("height_m"), tail(3).alias("name"))


def signs(lines: DataFrame) -> DataFrame:
    return rows(lines, 20, need=6).select("icao", "line_no", num(0).alias("lat"), num(1).alias("lon"), num(2).alias("heading"), whole(4).cast("int").alias("size"), tail(5).alias("raw"), F.lit("xplane").alias("source"))


def visual_aids(lines: DataFrame) -> DataFrame:
    kind = F.coalesce(text.lookup(codes.VISUAL_AIDS, whole(2).cast("int")), F.lit(0))
    return rows(lines, 21, need=5).select("icao", "line_no", num(0).alias("lat"), num(1).alias("lon"), kind.alias("kind"), num(3).alias("heading"), F.when(num(4) > 0, num(4)).alias("angle"), text.pad_source(word(5)).alias("runway"), tail(6).alias("name"))


def frequencies(lines: DataFrame) -> DataFrame:
    """Rows 50-56 in hundredths and 1050-1056 in thousandths of a megahertz."""
    r = lines.filter((F.col("code").between(50, 56) | F.col("code").between(1050, 1056)) & (F.size("f") >= 1))
    mhz = F.when(F.col("code") >= 1050, whole(0) / 1000).otherwise(whole(0) / 100)
    return r.select("icao", "line_no", text.lookup(codes.STATIONS, F.col("code") % 50).alias("station"), mhz.alias("mhz"), F.coalesce(tail(1), F.lit("")).alias("name"))


def route_nodes(lines: DataFrame) -> DataFrame:
    return rows(lines, 1201, need=4).select("icao", whole(3).alias("nid"), num(0).alias("lat"), num(1).alias("lon"), word(2).alias("usage"), tail(4).alias("name"))


def route_edges(lines: DataFrame) -> DataFrame:
    return rows(lines, 1202, need=4).select("icao", F.col("line_no").alias("eid"), whole(0).alias("from_id"), whole(1).alias("to_id"), (word(2) == "oneway").alias("oneway"), word(3).alias("restriction"), tail(4).alias("name"))


def _parents(lines: DataFrame, parent: int, child: int, name: str, parent_need: int) -> DataFrame:
    """Child rows with the line of the last parent row before them."""
    both = lines.filter(((F.col("code") == parent) & (F.size("f") >= parent_need)) | (F.col("code") == child))
    s = scan(both.withColumn("_p", F.when(F.col("code") == parent, F.col("line_no"))), ["icao"], ["line_no"], **{name: fill("_p")})
    return s.filter((F.col("code") == child) & F.col(name).isNotNull())


def active_zones(lines: DataFrame) -> DataFrame:
    """Active zone rows with their edge, one row per runway."""
    z = _parents(lines, 1202, 1204, "eid", 4).filter(F.size("f") >= 2)
    return z.select("icao", "eid", word(0).alias("zone"), F.explode(F.split(word(1), ",")).alias("r")).select("icao", "eid", "zone", text.pad_source("r").alias("runway"))


def stands(lines: DataFrame) -> DataFrame:
    """Start rows with the details of the last detail row that follows each."""
    kind = F.coalesce(text.lookup(codes.STAND_KINDS, word(3)), F.lit("misc"))
    s = rows(lines, 1300, need=5).select("icao", F.col("line_no").alias("sid"), F.coalesce(tail(5), F.lit("")).alias("name"), num(0).alias("lat"), num(1).alias("lon"), num(2).alias("heading"), kind.alias("kind"), F.split(word(4), r"\|").alias("types"), F.lit("xplane").alias("source"))
    d = _parents(lines, 1300, 1301, "sid", 5).select("icao", "sid", "line_no", F.upper(F.substring(word(0), 1, 1)).alias("size_code"), word(1).alias("operation"), F.transform(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))), F.upper).alias("airlines"))
    last = d.groupBy("icao", "sid").agg(F.max_by(F.struct("size_code", "operation", "airlines"), "line_no").alias("d"))
    return s.join(last, ["icao", "sid"], "left").select(*s.columns, "d.size_code", "d.operation", F.coalesce("d.airlines", F.array().cast("array<string>")).alias("airlines"))


def parse(blocks: DataFrame) -> dict[str, DataFrame]:
    """Every collection of the scenery, one DataFrame each."""
    ln = coded_lines(blocks)
    rg = rings(ln)
    rw, warn = runways(ln)
    pv, pvv = pavements(ln, rg)
    return {"headers": headers(ln), "runways": rw, "warnings": warn, "water_runways": water_runways(ln), "helipads": helipads(ln), "pavements": pv, "pavement_vertices": pvv, "painted_lines": painted_lines(rg), "boundary": boundary(rg),
            "beacons": beacons(ln), "windsocks": windsocks(ln), "signs": signs(ln), "visual_aids": visual_aids(ln), "frequencies": frequencies(ln), "route_nodes": route_nodes(ln), "route_edges": route_edges(ln), "active_zones": active_zones(ln), "stands": stands(ln)}
