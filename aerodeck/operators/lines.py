"""Painted lines: guidance lines, holding positions, exits, stand lead-ins.

A line feature is a set of segment rows (icao, lid, seq, ax, ay, bx, by); whole geometries
are only assembled for output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, shapes
from ..functions.geo import dist, fold_angle, heading, right_of, rnd, seg_cross, seg_dist
from . import overlay
from .network import majority
from .ordered import durable, rank, running, scan
from .spatial import SEG, as_segments, nearest, segment_cells, shuffled, within

MIN_RUN_M = 0.2
CAT_I, CAT_II_III = 1, 4
EXIT_M = 300.0
STAND_LEAD_M = 250.0


def keep_runs(runs: DataFrame) -> DataFrame:
    """Runs with a code and longer than 0.2 m."""
    return runs.filter(((F.col("line") != 0) | (F.col("light") != 0)) & (F.col("length") > MIN_RUN_M))


def with_measures(segs: DataFrame, keys: list[str], order: list[str] = ("seq",)) -> DataFrame:
    """Running measures from_m, to_m of each segment along its line."""
    s = scan(segs.withColumn("_len", dist(*SEG)), keys, list(order), to_m=running("_len"))
    return s.withColumn("from_m", F.col("to_m") - F.col("_len")).drop("_len")


def line_facts(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Length, vertex count, first, last and halfway point per line; ``segs`` carry measures and seq."""
    f = segs.groupBy(*keys).agg(F.max("to_m").alias("length"), (F.count(F.lit(1)) + 1).alias("n"), F.min_by(F.struct("ax", "ay"), "from_m").alias("p"), F.max_by(F.struct("bx", "by"), "to_m").alias("q"))
    half = segs.join(f.select(*keys, (F.col("length") / 2).alias("_h")), keys).filter((F.col("to_m") >= F.col("_h")) & (F.col("to_m") > F.col("from_m")))
    t = (F.col("_h") - F.col("from_m")) / (F.col("to_m") - F.col("from_m"))
    at = F.struct((F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))
    mid = half.groupBy(*keys).agg(F.min_by(at, "from_m").alias("m"))
    j = f.join(mid, keys, "left")
    return j.select(*keys, "length", "n", F.col("p.ax").alias("fx"), F.col("p.ay").alias("fy"), F.col("q.bx").alias("lx"), F.col("q.by").alias("ly"), F.col("m.x").alias("mx"), F.col("m.y").alias("my"))


def samples(segs: DataFrame, keys: list[str], facts: DataFrame) -> DataFrame:
    """Up to three sample vertices per line: all of them, or first, middle and last."""
    s = scan(segs, keys, ["from_m", "seq"], _k=rank()).join(facts.select(*keys, "n"), keys)
    k, n = F.col("_k") - 1, F.col("n")
    mid = F.floor(n / 2)
    start = s.filter((n <= 3) | (k == 0) | (k == mid)).select(*keys, F.col("ax").alias("x"), F.col("ay").alias("y"), k.alias("i"))
    end = s.filter(F.col("_k") == n - 1).select(*keys, F.col("bx").alias("x"), F.col("by").alias("y"), (n - 1).alias("i"))
    return start.unionByName(end)


def vote_edge_name(points: DataFrame, edges: DataFrame, keys: list[str], max_d: float) -> DataFrame:
    """Most frequent name of the nearest named edge over a line's samples, with its wingspan.

    ``edges``: icao, eid, name, wingspan, ax..by.
    """
    hit = nearest(points, edges, max_d, ["name", "wingspan"], ["eid"], cell=max(max_d, 200.0), wide=True).filter(F.col("name").isNotNull())
    best = majority(hit, keys, "name").drop("votes")
    span = hit.groupBy(*keys, "name").agg(F.min_by("wingspan", "i").alias("wingspan"))
    return best.join(span, [*keys, "name"], "left").withColumnRenamed("name", "edge_name")


def nearest_runway(mids: DataFrame, rw: DataFrame, cap: float, x: str = "mx", y: str = "my") -> DataFrame:
    """Runway axis nearest to each point within ``cap``: adds idrwy, rwy_hdg and the axis."""
    axis = rw.select("icao", "rid", "idrwy", F.col("heading").alias("rwy_hdg"), *SEG, *[F.col(n).alias(f"r{n}") for n in SEG])
    return nearest(mids, axis, cap, ["idrwy", "rwy_hdg", *[f"r{n}" for n in SEG]], ["idrwy", "rid"], x, y, cell=max(cap, 250.0)).drop("at").withColumnRenamed("dist", "rwy_dist")


def classify_lines(facts: DataFrame, edges: DataFrame, rw: DataFrame) -> DataFrame:
    """Meaning of each run: its code, or for unknown codes its place and direction.

    Across a taxi edge (> 60 degrees, < 90 m, edge within 4 m) it is a hold, a runway hold
    within 350 m of a runway; along it (< 30 degrees, >= 5 m) a centreline.
    """
    known = facts.withColumn("meaning", codes.line_meaning("line"))
    odd = known.filter("meaning = 'geometric' AND length >= 1")
    e = edges.withColumn("edge_dir", F.degrees(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))))
    h = nearest(odd.drop("dist", "at"), e, 4.0, ["eid", "edge_dir"], ["eid"], "mx", "my", cell=100.0, wide=True).drop("at", "dist")
    axis = rw.select("icao", *SEG)
    by_rwy = within(h.select("icao", "lid", "mx", "my"), axis, 350.0, "left_semi", "mx", "my", strict=True).select("icao", "lid", F.lit(True).alias("_near"))
    h = h.join(by_rwy, ["icao", "lid"], "left")
    diff = fold_angle(F.degrees(F.atan2(F.col("ly") - F.col("fy"), F.col("lx") - F.col("fx"))), F.col("edge_dir"))
    guess = (F.when(F.col("eid").isNull(), "ignore").when((diff > 60) & (F.col("length") < 90), F.when(F.col("_near"), "runway_hold").otherwise("intersection_hold"))
             .when((diff < 30) & (F.col("length") >= 5), "center").otherwise("ignore"))
    placed = h.withColumn("meaning", guess).select(*known.columns)
    rest = known.filter("meaning <> 'geometric' OR length < 1").withColumn("meaning", F.when(F.col("meaning") == "geometric", "ignore").otherwise(F.col("meaning")))
    return rest.unionByName(placed)


def assemble(segs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Line geometry per feature from its ordered segments."""
    lists = segs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *SEG))).alias("_l"))
    pts = F.concat(F.array(shapes.pt(F.col("_l")[0].ax, F.col("_l")[0].ay)), F.transform("_l", lambda s: shapes.pt(s.bx, s.by)))
    return lists.select(*keys, F.array(pts).alias("geom"))


def first_crossing(segs: DataFrame, keys: list[str], others: DataFrame, cell: float = 100.0) -> DataFrame:
    """Crossing measures of each line with other segments: (keys, measure)."""
    left = segment_cells(segs.select("icao", *[k for k in keys if k != "icao"], "from_m", *SEG), cell)
    right = segment_cells(others.select("icao", *SEG).distinct(), cell).select("icao", "cx", "cy", *[F.col(n).alias(f"o{n}") for n in SEG])
    hit, x, y = seg_cross(*SEG, *[f"o{n}" for n in SEG])
    j = left.join(shuffled(right), ["icao", "cx", "cy"]).filter(hit)
    return j.select(*keys, (F.col("from_m") + dist("ax", "ay", x, y)).alias("measure")).distinct()


def exits_and_rest(parts: DataFrame, holds: DataFrame, rw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exit lines and what stays outside runways, as segment rows.

    ``parts``: icao, lid, part, seq, t0, inside, ax..by. An inside part with one end on the
    axis (within 5 m, the other end clearly off it) is extended over the neighbouring
    outside part to its first hold or 300 m; any other inside part stays as it is. When both
    neighbours claim one outside part, the earlier part takes its share first.
    """
    keys = ["icao", "lid", "part"]
    p = durable(with_measures(parts, keys, ["seq", "t0"]))
    facts = durable(line_facts(p, keys))
    side = p.groupBy(*keys).agg(F.first("inside").alias("inside"))
    ins = nearest_runway(facts.join(side.filter("inside"), keys), rw, 200.0)
    d0 = seg_dist("fx", "fy", "rax", "ray", "rbx", "rby")
    d1 = seg_dist("lx", "ly", "rax", "ray", "rbx", "rby")
    true_exit = F.coalesce((F.least(d0, d1) <= 5.0) & (F.abs(d0 - d1) >= 5.0), F.lit(False))
    forward = d0 <= d1
    ins = ins.select(*keys, F.when(true_exit, F.when(forward, 1).otherwise(-1)).otherwise(0).alias("dir"))
    out = p.filter("NOT inside")
    length = facts.select(*keys, "length")
    cuts = first_crossing(out, keys, holds)
    fwd = ins.filter("dir = 1").select("icao", "lid", (F.col("part") + 1).alias("part"), F.col("part").alias("f_exit"))
    bwd = ins.filter("dir = -1").select("icao", "lid", (F.col("part") - 1).alias("part"), F.col("part").alias("b_exit"))
    c1 = cuts.join(length, keys).groupBy(*keys).agg(F.min("measure").alias("f_cut"), F.min(F.col("length") - F.col("measure")).alias("b_cut"))
    plan = length.join(side.filter("NOT inside").select(*keys), keys).join(fwd, keys, "left").join(bwd, keys, "left").join(c1, keys, "left")
    lim = lambda v: F.least(F.coalesce(v, F.lit(EXIT_M)), F.lit(EXIT_M), F.col("length"))
    f_to = F.when(F.col("f_exit").isNotNull(), lim(F.col("f_cut"))).otherwise(0.0)
    b_from = F.when(F.col("b_exit").isNotNull(), F.greatest(F.col("length") - lim(F.col("b_cut")), f_to)).otherwise(F.col("length"))
    plan = durable(plan.select(*keys, "f_exit", "b_exit", f_to.alias("_a"), b_from.alias("_b"), F.col("length").alias("_l")))
    o = out.join(plan, keys)
    spans = F.array(F.struct(F.lit("f").alias("role"), F.lit(0.0).alias("lo"), F.col("_a").alias("hi")), F.struct(F.lit("r").alias("role"), F.col("_a").alias("lo"), F.col("_b").alias("hi")), F.struct(F.lit("b").alias("role"), F.col("_b").alias("lo"), F.col("_l").alias("hi")))
    o = o.withColumn("_s", F.explode(spans)).withColumn("_lo", F.greatest("from_m", "_s.lo")).withColumn("_hi", F.least("to_m", "_s.hi")).filter("_hi - _lo > 1e-9")
    size = F.col("to_m") - F.col("from_m")
    t0, t1 = (F.col("_lo") - F.col("from_m")) / size, (F.col("_hi") - F.col("from_m")) / size
    o = o.select(*keys, "seq", F.col("_s.role").alias("role"), "f_exit", "b_exit", F.col("_lo").alias("from_m"), F.col("_hi").alias("to_m"), (F.col("_s.hi") - F.col("_s.lo")).alias("span"),
                 *[(F.col(a) + t * (F.col(b) - F.col(a))).alias(n) for a, b, t, n in (("ax", "bx", t0, "ax"), ("ay", "by", t0, "ay"), ("ax", "bx", t1, "bx"), ("ay", "by", t1, "by"))])
    rest = o.filter("role = 'r' AND span > 0.01").filter((F.col("span") > 1.0) | (F.col("f_exit").isNull() & F.col("b_exit").isNull()))
    rest = rest.select(*keys, F.col("from_m").alias("ord"), *SEG)
    base = p.filter("inside").join(ins, keys)
    own = base.select(*keys, "dir", F.col("from_m").alias("ord"), *SEG)
    ext_f = o.filter("role = 'f'").select("icao", "lid", F.col("f_exit").alias("part"), F.lit(1).alias("dir"), (F.col("from_m") + 1e6).alias("ord"), *SEG)
    ext_b = o.filter("role = 'b'").select("icao", "lid", F.col("b_exit").alias("part"), F.lit(-1).alias("dir"), (F.col("from_m") - 1e6).alias("ord"), *SEG)
    rows = own.unionByName(ext_f).unionByName(ext_b)
    back = F.col("dir") == -1
    flip = {"ax": "bx", "ay": "by", "bx": "ax", "by": "ay"}
    exits = rows.select(*keys, F.when(back, -F.col("ord")).otherwise(F.col("ord")).alias("ord"), *[F.when(back, F.col(o_)).otherwise(F.col(n)).alias(n) for n, o_ in flip.items()])
    return exits, rest


def build_lines(runs: DataFrame, edges: DataFrame, rw: DataFrame, stands: DataFrame, centerlines: DataFrame, hold_points: DataFrame) -> dict[str, DataFrame]:
    """The five painted-line layers and the roadway centrelines.

    ``runs``: segments of coded runs (icao, lid, seq, line, light, desc, source, ax..by);
    ``edges``: non-runway edges (icao, eid, name, wingspan, ax..by); ``stands``: icao,
    idstd, x, y; ``centerlines``: mapped taxi centreline segments (icao, lid, seq, desc,
    ax..by), used where nothing is painted; ``hold_points``: icao, hid, kind, name, x, y.
    """
    named = edges.filter(F.col("name").isNotNull())
    keys = ["icao", "lid"]
    # Phases end in tables: each product below feeds several later joins.
    segs = durable(with_measures(runs, keys))
    attrs = runs.groupBy(*keys).agg(*[F.first(n, True).alias(n) for n in ("line", "light", "desc", "source")])
    facts = keep_runs(line_facts(segs, keys).join(attrs, keys))
    facts = durable(facts)
    meant = durable(classify_lines(facts, edges, rw))
    holds = meant.filter(F.col("meaning").isin("runway_hold", "ils_hold", "intersection_hold"))
    hold_segs = segs.join(holds.select(*keys, "meaning"), keys).select(*keys, "meaning", "seq", "from_m", "to_m", *SEG)
    hold_segs = durable(hold_segs)
    votes = vote_edge_name(samples(hold_segs, keys, facts), named, keys, 40.0)
    h = nearest_runway(holds, rw, 500.0).join(votes, keys, "left").join(assemble(hold_segs, keys, ["seq"]), keys)
    stop = h.filter("meaning <> 'intersection_hold'").select(
        "icao", F.col("edge_name").alias("idlin"), "idrwy", F.when(F.col("meaning") == "runway_hold", CAT_I).otherwise(CAT_II_III).alias("catstop"), F.col("light").isin(codes.HOLD_LIGHTS).alias("lighting"), F.lit(1).alias("status"), "source", "geom")
    inter = h.filter("meaning = 'intersection_hold'").select("icao", F.col("edge_name").alias("idlin"), "source", "geom")

    painted = meant.filter(F.col("meaning").isin("center", "center_ils", "lane"))
    has_paint = meant.filter(codes.line_meaning("line").isin("center", "center_ils")).select("icao").distinct()
    mapped = centerlines.join(has_paint, "icao", "left_anti")
    lines = painted.select(*keys, "meaning", "light", "desc", "source").unionByName(mapped.groupBy(*keys).agg(F.lit("center").alias("meaning"), F.lit(0).alias("light"), F.first("desc", True).alias("desc"), F.lit("osm").alias("source")))
    line_segs = segs.join(painted.select(*keys), keys, "left_semi").select(*keys, "seq", *SEG).unionByName(mapped.select(*keys, "seq", *SEG))
    parts = overlay.split_lines(line_segs, ["lid"], rw.select("icao", *SEG, "width_m"))
    exits, rest = exits_and_rest(durable(parts), hold_segs.filter("meaning <> 'intersection_hold'"), rw)
    exits, rest = durable(exits), durable(rest)
    pk = ["icao", "lid", "part"]

    def described(rows, max_d):
        m = durable(with_measures(rows.withColumnRenamed("ord", "seq"), pk))
        f = durable(line_facts(m, pk))
        v = vote_edge_name(samples(m, pk, f), named, pk, max_d)
        return m, f.join(v, pk, "left").join(lines, keys)

    m, f = described(exits, 60.0)
    f = nearest_runway(f, rw, 200.0)
    diff = fold_angle(heading("fx", "fy", "lx", "ly"), F.col("rwy_hdg"))
    exit_rows = f.join(assemble(m, pk, ["seq"]), pk).select("icao", "lid", "part", F.col("edge_name").alias("idlin"), "idrwy", F.when(diff.between(20, 50), 2).otherwise(1).alias("exittype"), F.col("light").isin(codes.LIT_LIGHTS).alias("lighting"), "source", "geom")

    m, f = described(rest, 40.0)
    tips = f.select(*pk, F.explode(F.array(F.struct(F.col("fx").alias("x"), F.col("fy").alias("y")), F.struct(F.col("lx").alias("x"), F.col("ly").alias("y")))).alias("e")).select(*pk, "e.x", "e.y")
    led = nearest(tips, as_segments(stands), 20.0, ["idstd"], ["idstd"], strict=True).filter("idstd IS NOT NULL").groupBy(*pk).agg(F.min_by("idstd", F.struct("dist", "idstd")).alias("idstd"))
    g = f.join(led, pk, "left").join(assemble(m, pk, ["seq"]), pk)
    lead = F.col("idstd").isNotNull() & (F.col("length") < STAND_LEAD_M)
    stand_rows = g.filter(lead).select("icao", "lid", "part", "idstd", F.lit(None).cast("string").alias("idlin"), F.lit(1).alias("color"), F.lit(1).alias("style"), "source", "geom")
    short = F.when((F.length("desc") <= 5) & ~F.lower("desc").contains("line"), F.col("desc"))
    guide = g.filter(~lead).select(
        "icao", "lid", "part", F.coalesce("edge_name", short).alias("idlin"), F.lit(1).alias("color"), F.when(F.col("meaning") == "lane", 2).otherwise(1).alias("style"), F.lit(1).alias("direc"),
        F.col("light").isin(codes.LIT_LIGHTS).alias("lighting"), (F.col("meaning") == "center_ils").alias("ilscrit"), "wingspan", rnd("length").alias("length"), "source", "geom")

    extra_stop, extra_inter = mapped_holds(hold_points, hold_segs.filter("meaning <> 'intersection_hold'"), guide, rw)
    roads = segs.join(meant.filter("meaning = 'road_center'").select(*keys), keys, "left_semi").select("icao", "lid", "seq", *SEG)
    return {"taxiwayholdingposition": stop.unionByName(extra_stop), "taxiwayintersectionmarking": inter.unionByName(extra_inter), "runwayexitline": exit_rows,
            "standguidanceline": stand_rows, "taxiwayguidanceline": guide, "_road_centers": roads}


def mapped_holds(points: DataFrame, hold_segs: DataFrame, guides: DataFrame, rw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mapped hold points not within 15 m of a painted hold, as 24 m lines across the taxiway."""
    from .spatial import edges_of
    p = within(points, hold_segs, 15.0, "left_anti", strict=True)
    dirs = edges_of(guides, ["icao"]).filter(dist(*SEG) > 0.01)
    size = dist(*SEG)
    dirs = dirs.withColumn("ux", (F.col("bx") - F.col("ax")) / size).withColumn("uy", (F.col("by") - F.col("ay")) / size)
    d = nearest_direction(p, dirs)
    rx, ry = right_of("ux", "uy")
    line = shapes.line_geom((F.col("x") - rx * 12, F.col("y") - ry * 12), (F.col("x") + rx * 12, F.col("y") + ry * 12))
    d = d.withColumn("geom", line)
    inter = d.filter("kind = 'intersection_hold'").select("icao", F.col("name").alias("idlin"), F.lit("osm").alias("source"), "geom")
    stop = nearest_runway(d.filter("kind <> 'intersection_hold'"), rw, 500.0, "x", "y")
    stop = stop.select("icao", F.col("name").alias("idlin"), "idrwy", F.when(F.col("kind") == "ils_hold", CAT_II_III).otherwise(CAT_I).alias("catstop"), F.lit(False).alias("lighting"), F.lit(1).alias("status"), F.lit("osm").alias("source"), "geom")
    return stop, inter


def nearest_direction(points: DataFrame, segs: DataFrame, cap: float = 60.0) -> DataFrame:
    """Unit direction (ux, uy) of the nearest segment closer than ``cap``; east where there is none."""
    d = nearest(points, segs, cap, ["ux", "uy"], ["ux", "uy"], strict=True).drop("at", "dist")
    return d.withColumn("ux", F.coalesce("ux", F.lit(1.0))).withColumn("uy", F.coalesce("uy", F.lit(0.0)))


