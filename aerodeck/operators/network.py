"""Routing network as node and edge tables; connected components; votes and joined names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import restriction_wingspan, width_wingspan
from ..functions.geo import dist, rnd, seg_param
from .ordered import durable, lag, lead, rank, running, scan
from .spatial import crossings, nearest, near_pairs, shuffled

# Edge types, node types, directions.
TAXI, RUNWAY, STAND, EXIT = 1, 2, 3, 5
N_TAXI, N_RUNWAY, N_STAND, N_PARKING, N_HOLD, N_EXIT = 1, 2, 3, 4, 5, 6
BOTH_WAYS, FORWARD = 1, 2


def majority(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Most frequent name per key; a tie goes to the smaller name. Two map-side combined steps."""
    votes = df.filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(name).alias("n"))).alias("_b"))
    return best.select(*keys, F.col("_b.n").alias(name), (-F.col("_b.v")).alias("votes"))


def join_names(df: DataFrame, keys: list[str], name: str, sep: str) -> DataFrame:
    """Sorted distinct names per key, joined; the distinct step keeps the lists short."""
    d = df.filter(F.col(name).isNotNull()).select(*keys, name).distinct()
    return d.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(name)), sep).alias(name))


def edge_positions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the positions of both ends; an edge missing an end is dropped."""
    a = nodes.select("icao", F.col("nid").alias("from_id"), F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"))
    b = nodes.select("icao", F.col("nid").alias("to_id"), F.col("x").cast("double").alias("bx"), F.col("y").cast("double").alias("by"))
    return edges.join(a, ["icao", "from_id"]).join(b, ["icao", "to_id"])


def node_types(edges: DataFrame) -> DataFrame:
    """Node class from the types of the edges meeting there: (icao, node, nodetype)."""
    inc = edges.select("icao", "edgetype", F.explode(F.array("a", "b")).alias("node"))
    f = inc.groupBy("icao", "node").agg(*[F.bool_or(F.col("edgetype") == k).alias(n) for k, n in ((RUNWAY, "rw"), (EXIT, "ex"), (TAXI, "tw"))])
    rw, ex, tw = F.col("rw"), F.col("ex"), F.col("tw")
    return f.select("icao", "node", F.when(rw & (ex | tw), N_EXIT).when(rw, N_RUNWAY).when(ex & tw, N_HOLD).otherwise(N_TAXI).alias("nodetype"))


def network_from_routes(edges: DataFrame, nodes: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Network of the scenery's routes. ``zones``: icao, eid, runway (one row per active runway).

    Self-loops drop out; an edge with active zones is a runway exit.
    """
    e = edges.filter((F.col("restriction") == "runway") | F.col("restriction").startswith("taxiway")).filter("from_id <> to_id")
    active = join_names(zones, ["icao", "eid"], "runway", ",").withColumnRenamed("runway", "actzone")
    e = edge_positions(e, nodes).join(active, ["icao", "eid"], "left")
    is_rwy = F.col("restriction") == "runway"
    et = F.when(is_rwy, RUNWAY).when(F.col("actzone").isNotNull(), EXIT).otherwise(TAXI)
    out = e.select("icao", F.col("eid").cast("string").alias("eid"), F.concat(F.lit("n"), F.col("from_id").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("to_id").cast("string")).alias("b"), et.alias("edgetype"),
                   F.when(F.col("oneway"), FORWARD).otherwise(BOTH_WAYS).alias("direc"), F.when(~is_rwy, F.col("name")).alias("name"), restriction_wingspan("restriction").alias("wingspan"),
                   F.when(is_rwy, F.upper("name")).alias("idrwy"), "actzone", "ax", "ay", "bx", "by", F.lit("xplane").alias("source"))
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("b").alias("node"), F.col("bx").alias("x"), F.col("by").alias("y")))
    n = out.select("icao", F.explode(ends).alias("p")).groupBy("icao", "p.node").agg(F.min("p.x").alias("x"), F.min("p.y").alias("y"))
    return n, out


def network_from_lines(lines: DataFrame, rw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Network from taxi centrelines and runway axes where no routes exist.

    ``lines``: icao, way, seq, x, y, name, width_m, runway (null). Crossing points are
    inserted, ways are cut at junctions (way ends and coordinates used more than once on a
    0.1 m grid) and each part becomes an edge. Returns nodes, edges, edge vertices.
    """
    axis = rw.select("icao", F.concat(F.lit("r"), F.col("rid").cast("string")).alias("way"), F.col("width_m"), F.col("idrwy").alias("runway"),
                     F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit(1).alias("seq"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    axis = axis.select("icao", "way", "p.seq", "p.x", "p.y", F.lit(None).cast("string").alias("name"), "width_m", "runway")
    v = lines.select(axis.columns).unionByName(axis)
    segs = scan(v.withColumnRenamed("x", "ax").withColumnRenamed("y", "ay"), ["icao", "way"], ["seq"], bx=lead("ax"), by=lead("ay")).filter("bx IS NOT NULL")
    cross = crossings(segs, ["seq"])
    both = F.explode(F.array(F.struct(F.col("a_way").alias("way"), F.col("a_seq").alias("seq")), F.struct(F.col("b_way").alias("way"), F.col("b_seq").alias("seq"))))
    ins = cross.select("icao", "x", "y", both.alias("w")).select("icao", "w.way", "w.seq", "x", "y").join(segs.select("icao", "way", "seq", "ax", "ay", "bx", "by", "name", "width_m", "runway"), ["icao", "way", "seq"])
    ins = ins.filter((dist("x", "y", "ax", "ay") > 0.05) & (dist("x", "y", "bx", "by") > 0.05)).withColumn("t", dist("ax", "ay", "x", "y") / F.greatest(dist("ax", "ay", "bx", "by"), F.lit(1e-9)))
    pts = v.withColumn("t", F.lit(0.0)).unionByName(ins.select("icao", "way", "seq", "x", "y", "name", "width_m", "runway", "t"))
    pts = pts.dropDuplicates(["icao", "way", "seq", "t"])
    pts = pts.withColumn("kx", F.round(F.col("x") * 10).cast("bigint")).withColumn("ky", F.round(F.col("y") * 10).cast("bigint"))
    pts = scan(pts, ["icao", "way"], ["seq", "t"], pos=rank(), _nx=lead("x"))
    pts = pts.withColumn("tip", (F.col("pos") == 1) | F.col("_nx").isNull()).drop("_nx")
    used = pts.groupBy("icao", "kx", "ky").agg(F.sum(F.when(F.col("tip"), 2).otherwise(1)).alias("uses"))
    pts = pts.join(used, ["icao", "kx", "ky"]).withColumn("junction", (F.col("tip") | (F.col("uses") >= 2)).cast("int"))
    # A junction closes one part and opens the next: number the parts by junctions passed.
    pts = scan(pts, ["icao", "way"], ["pos"], seen=running("junction"))
    part = F.when((F.col("junction") == 1) & (F.col("pos") > 1), F.array(F.col("seen") - 1, F.col("seen"))).otherwise(F.array("seen"))
    parts = pts.withColumn("part", F.explode(part)).withColumn("eid", F.concat_ws(".", "way", F.col("part").cast("string")))
    shape = scan(parts.select("icao", "eid", "pos", "x", "y", "kx", "ky", "name", "width_m", "runway"), ["icao", "eid"], ["pos"], _px=lag("x"), _py=lag("y"))
    e = shape.groupBy("icao", "eid").agg(
        F.min_by(F.struct("kx", "ky", "x", "y"), "pos").alias("p"), F.max_by(F.struct("kx", "ky", "x", "y"), "pos").alias("q"), F.first("name", True).alias("name"), F.max("width_m").alias("width_m"),
        F.first("runway", True).alias("idrwy"), F.sum(dist("_px", "_py", "x", "y")).alias("len"))
    node = lambda s: F.concat_ws("_", F.col(f"{s}.kx").cast("string"), F.col(f"{s}.ky").cast("string"))
    e = e.withColumn("a", node("p")).withColumn("b", node("q")).filter("a <> b AND len > 0.5")
    rwy = F.col("idrwy").isNotNull()
    edges = e.select("icao", "eid", "a", "b", F.when(rwy, RUNWAY).otherwise(TAXI).alias("edgetype"), F.lit(BOTH_WAYS).alias("direc"), "name", width_wingspan("width_m").alias("wingspan"), "idrwy",
                     F.lit(None).cast("string").alias("actzone"), F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"), F.lit("osm").alias("source"))
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("p").alias("p")), F.struct(F.col("b").alias("node"), F.col("q").alias("p")))
    nodes = e.select("icao", F.explode(ends).alias("n")).groupBy("icao", "n.node").agg(F.min("n.p.x").alias("x"), F.min("n.p.y").alias("y"))
    vertices = shape.join(edges.select("icao", "eid"), ["icao", "eid"], "left_semi").select("icao", "eid", "pos", "x", "y")
    return nodes, edges, vertices


def attach_stands(nodes: DataFrame, edges: DataFrame, stands: DataFrame, reach: float = 250.0) -> tuple[DataFrame, DataFrame]:
    """Tie each stand to the nearest taxi edge, reusing a node within 3 m or splitting the edge.

    ``stands``: icao, idstd, x, y (stand), px, py (attach point), wingspan. Edges are
    straight (ax..by). All split points of an edge are cut at once in order along it, so the
    result does not depend on the order of the stands. Adds node columns nodetype, idstd.
    """
    taxi = edges.filter(~F.col("edgetype").isin(RUNWAY, STAND))
    s = nearest(stands, taxi.select("icao", "eid", "a", "b", "ax", "ay", "bx", "by"), reach, ["eid", "a", "b", "ax", "ay", "bx", "by"], ["eid"], "px", "py", cell=reach, wide=True)
    s = s.filter(F.col("eid").isNotNull())
    spots = nodes.select("icao", "node", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    close = near_pairs(s.select("icao", "idstd", "px", "py"), spots, 3.0, "px", "py").groupBy("icao", "idstd").agg(F.min(F.struct("dist", "node")).alias("n"))
    s = s.join(close.select("icao", "idstd", F.col("n.node").alias("near_node")), ["icao", "idstd"], "left")
    t = seg_param("px", "py", "ax", "ay", "bx", "by")
    s = s.withColumn("t", t).withColumn("qx", F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax"))).withColumn("qy", F.col("ay") + F.col("t") * (F.col("by") - F.col("ay")))
    target = (F.when(F.col("near_node").isNotNull(), F.col("near_node")).when(dist("qx", "qy", "ax", "ay") < 2.0, F.col("a")).when(dist("qx", "qy", "bx", "by") < 2.0, F.col("b")))
    # Split points of one edge within the 0.1 m grid are one node.
    s = s.withColumn("split", target.isNull()).withColumn("_q", F.round(F.col("t") * dist("ax", "ay", "bx", "by") * 10).cast("bigint"))
    s = s.withColumn("target", F.coalesce(target, F.concat_ws("@", "eid", F.col("_q").cast("string"))))
    cuts = s.filter("split").groupBy("icao", "eid", "target").agg(F.min("t").alias("t"), F.min("qx").alias("qx"), F.min("qy").alias("qy"))
    stops = (cuts.select("icao", "eid", "t", F.col("target").alias("node"), F.col("qx").alias("x"), F.col("qy").alias("y"))
             .unionByName(edges.join(cuts.select("icao", "eid").distinct(), ["icao", "eid"], "left_semi").select("icao", "eid", F.explode(F.array(
                 F.struct(F.lit(-1.0).alias("t"), F.col("a").alias("node"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit(2.0).alias("t"), F.col("b").alias("node"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p")).select("icao", "eid", "p.*")))
    links = scan(stops, ["icao", "eid"], ["t", "node"], nn=lead("node"), nx=lead("x"), ny=lead("y"), k=rank()).filter("nn IS NOT NULL")
    attrs = edges.drop("a", "b", "ax", "ay", "bx", "by")
    halves = links.join(attrs, ["icao", "eid"]).select("icao", F.concat_ws("/", "eid", F.col("k").cast("string")).alias("eid"), F.col("node").alias("a"), F.col("nn").alias("b"), *[n for n in attrs.columns if n not in ("icao", "eid")],
                                                       F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"))
    whole = edges.join(cuts.select("icao", "eid").distinct(), ["icao", "eid"], "left_anti")
    base_nodes = nodes.select("icao", "node", "x", "y").unionByName(cuts.select("icao", F.col("target").alias("node"), F.col("qx").alias("x"), F.col("qy").alias("y")))
    pos = base_nodes.withColumnRenamed("node", "target").withColumnRenamed("x", "tx").withColumnRenamed("y", "ty")
    s = s.join(pos, ["icao", "target"]).withColumn("on_route", dist("tx", "ty", "x", "y") < 0.5)
    stand_node = F.concat(F.lit("s:"), F.col("idstd"))
    own = s.filter("NOT on_route")
    new_edges = own.select("icao", F.concat(F.lit("s:"), "idstd").alias("eid"), F.col("target").alias("a"), stand_node.alias("b"), F.lit(STAND).alias("edgetype"), F.lit(BOTH_WAYS).alias("direc"), F.lit(None).cast("string").alias("name"),
                           "wingspan", F.lit(None).cast("string").alias("idrwy"), F.lit(None).cast("string").alias("actzone"), F.col("tx").alias("ax"), F.col("ty").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"), F.lit("derived").alias("source"))
    kind = s.groupBy("icao", F.col("target").alias("node")).agg(F.min(F.when(F.col("on_route"), F.col("idstd"))).alias("idstd"))
    kind = kind.withColumn("nodetype", F.when(F.col("idstd").isNotNull(), N_STAND).otherwise(N_PARKING))
    out_nodes = base_nodes.join(kind, ["icao", "node"], "left").unionByName(own.select("icao", stand_node.alias("node"), "x", "y", "idstd", F.lit(N_STAND).alias("nodetype")))
    out_edges = whole.select(new_edges.columns).unionByName(halves.select(new_edges.columns)).unionByName(new_edges)
    return out_nodes, out_edges


def emit_network(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge layers with dense ids, names, classes, lengths and provenance."""
    inc = edges.select("icao", "name", "idrwy", "edgetype", "source", "eid", F.explode(F.array("a", "b")).alias("node"))
    names = join_names(inc, ["icao", "node"], "name", "/")
    facts = inc.groupBy("icao", "node").agg(F.min_by("idrwy", F.when((F.col("edgetype") == RUNWAY) & F.col("idrwy").isNotNull(), F.col("eid"))).alias("idrwy"), F.bool_or(F.col("source") == "xplane").alias("_xp"))
    n = scan(nodes, ["icao"], ["x", "y", "node"], _n=rank()).withColumn("nodeid", F.col("_n").cast("bigint") - 1)
    n = n.join(node_types(edges).withColumnRenamed("nodetype", "_t"), ["icao", "node"], "left").join(names, ["icao", "node"], "left").join(facts, ["icao", "node"], "left")
    nt = F.coalesce("nodetype", "_t", F.lit(N_TAXI))
    fixed = nt.isin(N_STAND, N_PARKING)
    node_layer = n.select("icao", "node", F.col("icao").alias("idnetwrk"), "nodeid", nt.alias("nodetype"), "name", F.when(~fixed, F.col("idrwy")).alias("idrwy"), "idstd", F.lit(None).cast("string").alias("termref"),
                          F.when(fixed, "derived").when(F.col("_xp"), "xplane").otherwise("osm").alias("source"), "x", "y")
    ids = node_layer.select("icao", "node", "nodeid", "idstd")
    e = (edges.join(ids.select("icao", F.col("node").alias("a"), F.col("nodeid").alias("stnode")), ["icao", "a"])
         .join(ids.select("icao", F.col("node").alias("b"), F.col("nodeid").alias("ennode"), F.col("idstd").alias("_std")), ["icao", "b"]))
    e = scan(e, ["icao"], ["eid"], _n=rank())
    edge_layer = e.select("icao", F.col("icao").alias("idnetwrk"), (F.col("_n").cast("bigint") - 1).alias("edgeid"), "stnode", "ennode", "edgetype", "direc", F.col("name").alias("idlin"), "idrwy",
                          F.when(F.col("edgetype") == STAND, F.col("_std")).alias("idstd"), "wingspan", rnd(dist("ax", "ay", "bx", "by")).alias("edgelen"), "actzone", "source", "ax", "ay", "bx", "by")
    return node_layer, edge_layer


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected pairs (a, b): every node with its smallest member.

    Each round pulls the smallest label over the edges, then jumps to the label's label, so
    rounds grow with the logarithm of the diameter. Labels are checkpointed every round; the
    driver sees one number, the count of changes.
    """
    edges = durable(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    loops = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = durable(loops.withColumn("label", F.col("node")))
    for _ in range(max_rounds):
        pulled = edges.join(shuffled(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_m"))
        near = labels.join(shuffled(pulled), "node", "left").select("node", F.col("label").alias("_old"), F.least("label", F.coalesce("_m", "label")).alias("label"))
        hop = near.select(F.col("node").alias("label"), F.col("label").alias("_j"))
        new = durable(near.join(shuffled(hop), "label", "left").select("node", "_old", F.least("label", F.coalesce("_j", "label")).alias("label")))
        changed = new.filter("label <> _old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
