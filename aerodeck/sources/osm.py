"""Map elements: XML and JSON scans, way and relation geometry, ring assembly, collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions import text
from ..operators.ordered import durable, rank, scan
from ..operators.spatial import shuffled

TAG_ROWS = "tag array<struct<_k:string,_v:string>>"
XML_SCHEMAS = {
    "node": f"_id bigint, _lat double, _lon double, {TAG_ROWS}",
    "way": f"_id bigint, nd array<struct<_ref:bigint>>, {TAG_ROWS}",
    "relation": f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {TAG_ROWS}",
}
JSON_SCHEMA = ("elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,"
               "members:array<struct<type:string,ref:bigint,role:string>>,tags:map<string,string>>>, remark string, _corrupt_record string")


def _tag_map(col: str) -> Column:
    pairs = F.transform(F.coalesce(col, F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"]))
    # A key listed twice keeps its last value.
    return F.aggregate(pairs, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["_k"]), F.create_map(p["_k"], p["_v"])))


def read_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nodes, ways and relations of map XML files; ``tile`` is the file, for later-wins merges."""
    raw = {k: spark.read.format("xml").option("rowTag", k).schema(s).load(path).withColumn("tile", F.col("_metadata.file_path")) for k, s in XML_SCHEMAS.items()}
    return {
        "nodes": raw["node"].select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tag_map("tag").alias("tags"), "tile"),
        "ways": raw["way"].select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("nodes"), _tag_map("tag").alias("tags"), "tile"),
        "relations": raw["relation"].select(F.col("_id").alias("id"), F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members"), _tag_map("tag").alias("tags"), "tile"),
    }


def elements_from_json(docs: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Elements of JSON texts, and the rejected texts with the reason.

    A text that is not JSON, or whose remark reports an error or a time-out, gives no rows.
    """
    j = docs.withColumn("_j", F.from_json(value, JSON_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}))
    remark = F.lower(F.coalesce("_j.remark", F.lit("")))
    why = (F.when(F.col("_j").isNull() | F.col("_j._corrupt_record").isNotNull() | F.col("_j.elements").isNull(), "not an element list").when(remark.rlike("error|timed out"), F.col("_j.remark")))
    j = j.withColumn("reason", why)
    keep = [n for n in docs.columns if n != value]
    ok = j.filter("reason IS NULL").select(*keep, F.explode("_j.elements").alias("e")).select(*keep, "e.*")
    return ok, j.filter("reason IS NOT NULL").select(*keep, "reason")


def split_elements(elements: DataFrame) -> dict[str, DataFrame]:
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    e = elements.withColumn("tags", F.coalesce("tags", empty))
    return {"nodes": e.filter("type = 'node'").select("id", "lat", "lon", "tags"), "ways": e.filter("type = 'way'").select("id", "nodes", "tags"),
            "relations": e.filter("type = 'relation'").select("id", "members", "tags")}


def latest_elements(elements: DataFrame, order: str = "tile") -> DataFrame:
    """Overlapping extracts merged by element id; the later tile wins. One map-side combined step."""
    rest = [n for n in elements.columns if n != "id"]
    return elements.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_e")).select("id", "_e.*")


def relevant(elements: DataFrame, kind: str) -> DataFrame:
    return elements.filter(T.is_relevant("tags", F.lit(kind)))


def way_vertices(ways: DataFrame, nodes: DataFrame, way: str = "way", node: str = "nid") -> DataFrame:
    """Coordinates of each way in order, renumbered from 1; unknown nodes are skipped."""
    refs = ways.select(way, F.posexplode("nodes").alias("pos", node))
    pos = nodes.select(node, *[n for n in nodes.columns if n != node])
    v = refs.join(pos, node).drop(node)
    return scan(v, [way], ["pos"], seq=rank()).drop("pos")


def relation_vertices(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vertices of the member ways of relations, with the ring role of each way."""
    m = relations.select("relation", F.explode("members").alias("m")).filter("m.type IN ('way', 'w')")
    m = m.select("relation", F.col("m.ref").alias("way"), F.when(F.col("m.role") == "inner", "inner").otherwise("outer").alias("role"))
    used = ways.join(m.select("way").distinct(), "way", "left_semi")
    return m.join(way_vertices(used, nodes), "way")


SHARED_VERTICES = 50_000


def assemble_rings(fragments: DataFrame, digits: int = 9, max_rounds: int = 40, shared: int = SHARED_VERTICES) -> DataFrame:
    """Rings from way fragments that share end points, for all groups at once.

    ``fragments``: grp, frag, seq, x, y. Every fragment is a link in both directions; at an
    end point the next link is the smallest other fragment there. Closed chains keep the
    direction of their smallest fragment; open chains of at least three points are forced
    shut. Output: grp, ring (smallest fragment), seq, x, y.

    A group of up to ``shared`` vertices is put together in one row (``_rings_in_rows``); larger
    ones by rounds over all their links (``_rings_in_rounds``), with the same rings.
    """
    large = fragments.groupBy("grp").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > shared).select("grp")
    if large.isEmpty():
        return _rings_in_rows(fragments, digits)
    same = F.col("grp").eqNullSafe(F.col("_large"))
    large = durable(large.withColumnRenamed("grp", "_large"))
    return _rings_in_rows(fragments.join(large, same, "left_anti"), digits).unionByName(_rings_in_rounds(fragments.join(large, same, "left_semi"), digits, max_rounds))


def chains(ends: list[tuple[str, str]], counts: list[int]) -> list[tuple[int, int, int, int]]:
    """(ring, fragment, direction, links to the end of its chain) of the fragments of one group, which are numbered in order."""
    own = [i for i, (p, q) in enumerate(ends) if p == q and counts[i] >= 4]
    closed = set(own)
    half = {(i, d): (ends[i] if d > 0 else ends[i][::-1]) for i in range(len(ends)) if i not in closed for d in (-1, 1)}
    starts: dict[str, list[tuple[int, int]]] = {}
    for link in sorted(half):
        starts.setdefault(half[link][0], []).append(link)
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for link in sorted(half):  # a fork could give one link two predecessors: the smallest stays, so chains stay chains
        after = next((n for n in starts.get(half[link][1], ()) if n[0] != link[0]), None)
        if after is not None:
            back.setdefault(after, link)
    ahead = {link: after for after, link in back.items()}
    picked, seen = [(i, i, 1, 0) for i in own], set()
    for link in sorted(half):
        if link in seen:
            continue
        first = link
        while first in back and back[first] != link:
            first = back[first]
        loop = first in back
        chain, at = [], link if loop else first
        while at is not None and at not in seen:
            seen.add(at)
            chain.append(at)
            at = ahead.get(at)
        low = min((i, -d) for i, d in chain)
        if low[1] != -1:
            continue
        if loop:
            k = chain.index((low[0], -low[1]))
            chain = chain[k:] + chain[:k]
        picked += [(low[0], i, d, len(chain) - 1 - k) for k, (i, d) in enumerate(chain)]
    return picked


def _rings_in_rows(fragments: DataFrame, digits: int) -> DataFrame:
    """Each group in one row: the vertices are shuffled once and no tables are written between."""
    vertex = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    f = fragments.select("grp", "frag", "seq", "x", "y").repartition("grp").groupBy("grp", "frag").agg(vertex.alias("p"))
    key = lambda v: F.concat_ws(",", F.round(v.x, digits).cast("string"), F.round(v.y, digits).cast("string"))
    f = f.select("grp", F.struct("frag", "p", key(F.col("p")[0]).alias("kp"), key(F.element_at("p", -1)).alias("kq"), F.size("p").alias("n")).alias("f"))
    g = f.groupBy("grp").agg(F.array_sort(F.collect_list("f")).alias("f"))
    walk = F.udf(lambda kp, kq, n: chains(list(zip(kp, kq, strict=True)), n), "array<struct<ring:int,frag:int,dir:int,steps:int>>", useArrow=False)
    g = g.withColumn("w", walk(F.transform("f", lambda v: v.kp), F.transform("f", lambda v: v.kq), F.transform("f", lambda v: v.n)))
    rings = F.array_sort(F.array_distinct(F.transform("w", lambda w: w.ring)))
    r = g.select("grp", "f", "w", F.explode(rings).alias("r"))
    links = F.array_sort(F.transform(F.filter("w", lambda w: w.ring == F.col("r")), lambda w: F.struct((-w.steps).alias("k"), w.frag.alias("frag"), w.dir.alias("dir"))))
    points = lambda w: F.transform(F.get("f", w.frag).p, lambda v: F.struct(v.x.alias("x"), v.y.alias("y")))
    r = r.select("grp", F.get("f", F.col("r")).frag.alias("ring"), F.flatten(F.transform(links, lambda w: F.when(w.dir == 1, points(w)).otherwise(F.reverse(points(w))))).alias("v"))
    # Joined fragments repeat their shared point: a vertex equal to the one before it is dropped.
    near = lambda a, b: F.coalesce((F.abs(a.x - b.x) < 1e-9) & (F.abs(a.y - b.y) < 1e-9), F.lit(False))
    numbered = F.transform("v", lambda v, i: F.struct((i + 1).alias("seq"), v.x.alias("x"), v.y.alias("y"), ((i > 0) & near(F.get("v", i - 1), v)).alias("again")))
    r = r.select("grp", "ring", F.filter(numbered, lambda v: ~v.again).alias("v"))
    a, z = F.col("v")[0], F.element_at("v", -1)
    shut = F.when((F.abs(a.x - z.x) >= 1e-9) | (F.abs(a.y - z.y) >= 1e-9), F.array(F.struct((z.seq + 1).alias("seq"), a.x.alias("x"), a.y.alias("y"), F.lit(False).alias("again"))))
    whole = F.when(F.size("v") >= 3, F.concat("v", F.coalesce(shut, F.slice("v", 1, 0))))  # a filter would work out the rings twice
    return r.select("grp", "ring", F.explode(whole).alias("v")).select("grp", "ring", "v.seq", "v.x", "v.y")


def _rings_in_rounds(fragments: DataFrame, digits: int, max_rounds: int) -> DataFrame:
    """Pointer doubling finds the loop each link belongs to and its position, in rounds logarithmic in the ring size."""
    f = fragments.groupBy("grp", "frag").agg(F.min_by(F.struct("x", "y"), "seq").alias("p"), F.max_by(F.struct("x", "y"), "seq").alias("q"), F.count(F.lit(1)).alias("n"))
    key = lambda s: F.concat_ws(",", F.round(f"{s}.x", digits).cast("string"), F.round(f"{s}.y", digits).cast("string"))
    f = f.withColumn("kp", key("p")).withColumn("kq", key("q"))
    own = f.filter("kp = kq AND n >= 4").select("grp", "frag")
    links = f.filter("NOT (kp = kq AND n >= 4)")
    fwd = links.select("grp", "frag", F.lit(1).alias("dir"), F.col("kp").alias("a"), F.col("kq").alias("b"))
    bwd = links.select("grp", "frag", F.lit(-1).alias("dir"), F.col("kq").alias("a"), F.col("kp").alias("b"))
    half = durable(fwd.unionByName(bwd))
    nxt = half.select("grp", F.col("frag").alias("nf"), F.col("dir").alias("nd"), F.col("a").alias("b"))
    # At an end point with more than two fragments the smallest other one continues.
    succ = half.join(shuffled(nxt), ["grp", "b"]).filter("nf <> frag").groupBy("grp", "frag", "dir").agg(F.min(F.struct("nf", "nd")).alias("s"))
    succ = half.select("grp", "frag", "dir").join(shuffled(succ), ["grp", "frag", "dir"], "left").select("grp", "frag", "dir", "s.nf", "s.nd")
    # A fork could give one link two predecessors: keep the smallest so chains stay chains.
    back = succ.filter("nf IS NOT NULL").groupBy("grp", "nf", "nd").agg(F.min(F.struct("frag", "dir")).alias("w")).select("grp", "nf", "nd", F.col("w.frag").alias("frag"), F.col("w.dir").alias("dir"))
    link = durable(half.select("grp", "frag", "dir").join(shuffled(back), ["grp", "frag", "dir"], "left"))

    def double(state: DataFrame, carry: list[tuple[str, str]]) -> DataFrame:
        far = state.select("grp", F.col("frag").alias("nf"), F.col("dir").alias("nd"), F.col("nf").alias("_f"), F.col("nd").alias("_d"), *[F.col(n).alias(f"_{n}") for n, _ in carry])
        j = state.join(shuffled(far), ["grp", "nf", "nd"], "left")
        merged = [(F.least(n, F.coalesce(f"_{n}", n)) if how == "min" else F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n, how in carry]
        return durable(j.select("grp", "frag", "dir", F.col("_f").alias("nf"), F.col("_d").alias("nd"), *merged))

    def settle(state, carry):
        for _ in range(max_rounds):
            state, before = double(state, carry), state
            left, was = state.filter("nf IS NOT NULL").count(), before.filter("nf IS NOT NULL").count()
            if left == 0 or (left == was and not _changes(before, state, carry)):
                return state
        raise RuntimeError("ring assembly did not settle")

    def _changes(a, b, carry):
        n = carry[0][0]
        return a.select("grp", "frag", "dir", F.col(n).alias("_o")).join(shuffled(b), ["grp", "frag", "dir"]).filter(F.col("_o") != F.col(n)).limit(1).count()

    # The smallest link ahead: links that still have a successor afterwards lie on a loop.
    code = F.struct("frag", (-F.col("dir")).alias("d"))
    low = settle(link.withColumn("low", code), [("low", "min")])
    loops = low.filter("nf IS NOT NULL").select("grp", "frag", "dir", "low")
    # A loop comes twice, once per direction; keep the one whose smallest link runs forward.
    loop = loops.filter("low.d = -1")
    cut = link.join(shuffled(loop.select("grp", "frag", "dir", "low")), ["grp", "frag", "dir"], "left")
    open_ = F.col("low").isNotNull() & (F.col("nf") == F.col("low.frag")) & (F.col("nd") == -F.col("low.d"))
    cut = cut.withColumn("nf", F.when(~open_, F.col("nf"))).withColumn("nd", F.when(~open_, F.col("nd"))).drop("low")
    cut = cut.join(shuffled(loops.filter("low.d = 1").select("grp", "frag", "dir")), ["grp", "frag", "dir"], "left_anti")
    # Distance to the end of the chain, and the chain's last link as its name.
    ranked = cut.withColumn("steps", F.when(F.col("nf").isNotNull(), 1).otherwise(0))
    tail = settle(ranked.withColumn("steps", F.col("steps")), [("steps", "sum")])
    ids = settle(cut.withColumn("low", code), [("low", "min")]).select("grp", "frag", "dir", F.col("low").alias("ahead"))
    chain = tail.select("grp", "frag", "dir", "steps").join(shuffled(ids), ["grp", "frag", "dir"])
    heads = cut.select("grp", "frag", "dir").join(cut.filter("nf IS NOT NULL").select("grp", F.col("nf").alias("frag"), F.col("nd").alias("dir")), ["grp", "frag", "dir"], "left_anti")
    # Every link learns its head: the head pushes its name along the chain by doubling.
    pred = cut.filter("nf IS NOT NULL").select("grp", F.col("nf").alias("frag"), F.col("nd").alias("dir"), F.col("frag").alias("pf"), F.col("dir").alias("pd"))
    up = cut.select("grp", "frag", "dir").join(shuffled(pred), ["grp", "frag", "dir"], "left").select("grp", "frag", "dir", F.col("pf").alias("nf"), F.col("pd").alias("nd"))
    behind = settle(up.withColumn("low", code), [("low", "min")]).select("grp", "frag", "dir", F.col("low").alias("back"))
    named = chain.join(shuffled(behind), ["grp", "frag", "dir"]).withColumn("name", F.least("ahead", "back"))
    # An open chain also comes twice; its smallest fragment decides the direction, too.
    pick = named.filter("name.d = -1").select("grp", F.col("name.frag").alias("ring"), "frag", "dir", "steps")
    pick = pick.unionByName(own.select("grp", F.col("frag").alias("ring"), "frag", F.lit(1).alias("dir"), F.lit(0).alias("steps")))
    v = fragments.join(shuffled(pick), ["grp", "frag"]).withColumn("_s", F.when(F.col("dir") == 1, F.col("seq")).otherwise(-F.col("seq"))).withColumn("_k", -F.col("steps"))
    v = scan(v, ["grp", "ring"], ["_k", "_s"], seq_=rank())
    # Joined fragments repeat their shared point: drop a vertex equal to the one before it.
    from ..operators.ordered import lag
    v = scan(v.select("grp", "ring", F.col("seq_").alias("seq"), "x", "y"), ["grp", "ring"], ["seq"], _px=lag("x"), _py=lag("y"))
    same = (F.abs(F.col("_px") - F.col("x")) < 1e-9) & (F.abs(F.col("_py") - F.col("y")) < 1e-9)
    v = v.filter(~F.coalesce(same, F.lit(False))).drop("_px", "_py")
    tips = v.groupBy("grp", "ring").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("z"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("n"))
    shut = tips.filter("n >= 3 AND (abs(a.x - z.x) >= 1e-9 OR abs(a.y - z.y) >= 1e-9)").select("grp", "ring", (F.col("last") + 1).alias("seq"), F.col("a.x").alias("x"), F.col("a.y").alias("y"))
    good = tips.filter("n >= 3").select("grp", "ring")
    return v.join(shuffled(good), ["grp", "ring"], "left_semi").unionByName(shut)


def holes_to_outers(outers: DataFrame, inners: DataFrame) -> DataFrame:
    """Inner ring -> first outer ring of its relation containing its first vertex.

    Both: grp, ring, geom. Output: grp, inner, outer.
    """
    from ..operators.spatial import points_in_polygons
    first = inners.select("grp", F.col("ring").alias("inner"), F.col("geom")[0][0].x.alias("x"), F.col("geom")[0][0].y.alias("y"))
    hit = points_in_polygons(first, outers.withColumnRenamed("ring", "outer"), ["inner"], ["outer"], key="grp")
    return hit.groupBy("grp", "inner").agg(F.min("outer").alias("outer"))


def osm_collections(nodes: DataFrame, ways: DataFrame) -> dict[str, DataFrame]:
    """Source collections of tagged elements: which row feeds what, with its attributes.

    ``nodes``: id, x, y, tags (+ keys); ``ways``: id, nodes, tags. Geometry stays with
    ``way_vertices``; each collection is a filter on one ordered classification column.
    """
    t = F.col("tags")
    n = nodes.withColumn("collection", T.node_collection(t)).filter("collection IS NOT NULL")
    letter = F.upper(F.substring(F.coalesce(T.tag(t, "aircraft:size"), T.tag(t, "icao:size"), T.tag(t, "parking_position:size")), 1, 1))
    stands = n.filter("collection = 'stand'").select("*", F.coalesce(text.tag_name(t), F.lit("")).alias("name"), F.coalesce(T.tag(t, "direction"), T.tag(t, "heading")).try_cast("double").alias("heading"),
                                                     F.when(T.tag(t, "parking_position") == "hangar", "hangar").otherwise("gate").alias("kind"), F.when(letter.rlike("^[A-F]$"), letter).alias("size_code"),
                                                     T.tag(t, "operator").alias("operation"), F.transform(F.split(T.tag(t, "airline"), ";"), lambda a: F.upper(F.trim(a))).alias("airlines"),
                                                     (F.coalesce(T.tag(t, "jet_bridge"), T.tag(t, "jetway")) == "yes").alias("jetway"))
    w = ways.withColumn("area", T.is_area(t, "nodes"))
    w = w.withColumn("collection", F.when(F.col("area"), T.area_collection(t)).otherwise(T.line_collection(t))).filter("collection IS NOT NULL")
    refs = F.filter(F.transform(F.split(F.coalesce(T.tag(t, "ref"), F.lit("")), "/"), F.trim), lambda s: s != "")
    bridge = F.coalesce(T.tag(t, "bridge") != "no", F.lit(False))
    return {
        "stands": stands,
        "holds": n.filter("collection = 'hold'").select("*", T.hold_kind(t).alias("kind"), text.tag_name(t).alias("name")),
        "lights": n.filter("collection = 'light'").select("*", T.light_kind(t).alias("kind"), T.tag(t, "ref").alias("runway")),
        "helipads": n.filter("collection = 'helipad'").select("*", F.coalesce(text.tag_name(t), F.lit("H")).alias("ident"), F.coalesce(T.surface_of(t), F.lit(0)).alias("surface")),
        "headers": n.filter("collection = 'header'").select("*", T.tag(t, "name").alias("name"), T.tag(t, "iata").alias("iata")),
        "point_structures": n.filter("collection = 'point_structure'").select("*", T.point_kind(t).alias("kind"), text.height_m(t).alias("height_m"), T.tag(t, "name").alias("name")),
        "taxi_centerlines": w.filter("collection = 'taxi_centerline' AND NOT area").select("*", text.tag_name(t).alias("name"), text.length_m(T.tag(t, "width")).alias("width_m"), bridge.alias("bridge")),
        "runways": w.filter("collection = 'runway' AND NOT area").select("*", F.get(refs, F.lit(0)).alias("ident0"), F.get(refs, F.lit(1)).alias("ident1"), F.coalesce(text.length_m(T.tag(t, "width")), F.lit(45.0)).alias("width_m"), F.coalesce(T.surface_of(t), F.lit(0)).alias("surface")),
        "roads": w.filter("collection = 'road_center'").select("*", T.tag(t, "name").alias("name"), text.road_width(t).alias("width_m"), bridge.alias("bridge")),
        "line_structures": w.filter("collection = 'line_structure'").select("*", T.line_kind(t).alias("kind"), text.height_m(t).alias("height_m"), T.tag(t, "name").alias("name")),
        "buildings": w.filter("area AND collection = 'building'").select("*", T.building_kind(t).alias("kind"), text.height_m(t).alias("height_m"), T.tag(t, "building:levels").try_cast("double").alias("levels"), T.tag(t, "name").alias("name")),
        "areas": w.filter("area AND collection NOT IN ('building', 'stand')").select("*", F.col("collection").alias("kind"), text.tag_name(t).alias("name"), T.surface_of(t).alias("surface"), F.concat(F.lit("osm:"), F.col("id").cast("string")).alias("reference")),
    }


