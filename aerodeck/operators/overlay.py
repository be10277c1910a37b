"""Overlay on tables: grid-cell cover, covered share, boundaries, strips, hulls, ring clean-up."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.geo import dist
from ..functions.shapes import pt
from .spatial import crossed_rows, shuffled


def row_spans(polys: DataFrame, fid: list[str], cell: float = 1.0, key: str = "icao") -> DataFrame:
    """Spans of grid cells whose centre lies in the polygon: (key, fid, cy, a, z), both ends inclusive; holes respected.

    Row by row: the crossings of the cell row's centre line with the polygon edges, sorted, pair up into spans.
    """
    rows = crossed_rows(polys, [key, *fid], cell).select(key, *fid, F.col("row").alias("cy"), F.col("_x").alias("_xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_xs") / 2).cast("int") - 1), lambda i: F.struct(
        F.ceil(F.get("_xs", i * 2) / cell - 0.5).cast("int").alias("a"), (F.ceil(F.get("_xs", i * 2 + 1) / cell - 0.5) - 1).cast("int").alias("z")))
    return rows.filter(F.size("_xs") >= 2).select(key, *fid, "cy", F.explode(pairs).alias("_s")).filter("_s.z >= _s.a").select(key, *fid, "cy", "_s.a", "_s.z")


def cover(polys: DataFrame, fid: list[str], cell: float = 1.0, key: str = "icao") -> DataFrame:
    """Grid cells whose centre lies in the polygon: (key, fid, cx, cy); only cells inside a span are made, never those of the box."""
    return row_spans(polys, fid, cell, key).select(key, *fid, F.explode(F.sequence("a", "z")).alias("cx"), "cy")


def cover_bits(polys: DataFrame, fid: list[str], cell: float = 1.0, key: str = "icao") -> DataFrame:
    """The cells of ``cover``, 64 columns of a row in the bits of one number: (key, fid, cy, block, bits)."""
    s = row_spans(polys, fid, cell, key).withColumn("block", F.explode(F.sequence(F.shiftright("a", 6), F.shiftright("z", 6))))
    lo, hi = F.greatest(F.col("a") - F.col("block") * 64, F.lit(0)), F.least(F.col("z") - F.col("block") * 64, F.lit(63))
    bits = F.call_function("shiftleft", F.lit(-1).cast("bigint"), lo).bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), 63 - hi))
    return s.select(key, *fid, "cy", "block", bits.alias("bits"))


def distinct_shapes(polys: DataFrame, key: str = "icao") -> DataFrame:
    return polys.select(key, "geom").withColumn("_id", F.xxhash64("geom")).dropDuplicates([key, "_id"])


def cover_set(polys: DataFrame, cell: float = 1.0, key: str = "icao") -> DataFrame:
    """Distinct cells any polygon covers; copies of a polygon are collapsed first."""
    return cover(distinct_shapes(polys, key), ["_id"], cell, key).select(key, "cx", "cy").distinct()


def union_bits(polys: DataFrame, cell: float = 1.0, key: str = "icao") -> DataFrame:
    """The cells of ``cover_set`` as (key, cy, block, bits); united before the shuffle, so neither cells nor hot rows travel."""
    return cover_bits(distinct_shapes(polys, key), ["_id"], cell, key).groupBy(key, "cy", "block").agg(F.bit_or("bits").alias("bits"))


def covered_share(polys: DataFrame, others: DataFrame, fid: list[str], cell: float = 1.0, key: str = "icao") -> DataFrame:
    """Cells of each polygon, how many any polygon of the other set covers, and the share."""
    own = cover_bits(polys, fid, cell, key)
    hit = union_bits(others, cell, key).withColumnRenamed("bits", "_hit")
    both = F.bit_count(F.col("bits").bitwiseAND(F.coalesce("_hit", F.lit(0).cast("bigint"))))
    j = own.join(shuffled(hit), [key, "cy", "block"], "left").groupBy(key, *fid).agg(F.sum(F.bit_count("bits")).alias("cells"), F.sum(both).alias("covered"))
    return j.withColumn("share", F.col("covered") / F.col("cells"))


def union_area(polys: DataFrame, cell: float = 1.0, key: str = "icao") -> DataFrame:
    """Area of the union of all polygons of an airport, by cells."""
    return union_bits(polys, cell, key).groupBy(key).agg((F.sum(F.bit_count("bits")) * (cell * cell)).alias("area"))


def remainder(polys: DataFrame, minus: DataFrame, fid: list[str], cell: float = 1.0, key: str = "icao") -> DataFrame:
    """Cells of each polygon outside the other set."""
    return cover(polys, fid, cell, key).join(shuffled(cover_set(minus, cell, key)), [key, "cx", "cy"], "left_anti")


def boundary(cells: DataFrame, cell: float = 1.0, keys: tuple = ("icao",)) -> DataFrame:
    """Boundary sides of a cell set: sides that occur once, as segments in metres.

    A side is (axis, column, row); two neighbouring cells of the set share it and cancel.
    """
    sides = F.array(F.struct(F.lit("h").alias("axis"), F.col("cx").alias("i"), F.col("cy").alias("j")),
                    F.struct(F.lit("h").alias("axis"), F.col("cx").alias("i"), (F.col("cy") + 1).alias("j")),
                    F.struct(F.lit("v").alias("axis"), F.col("cx").alias("i"), F.col("cy").alias("j")),
                    F.struct(F.lit("v").alias("axis"), (F.col("cx") + 1).alias("i"), F.col("cy").alias("j")))
    once = (cells.select(*keys, "cx", "cy").distinct().select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
            .groupBy(*keys, "axis", "i", "j").agg(F.count(F.lit(1)).alias("n")).filter("n = 1"))
    x, y = F.col("i") * cell, F.col("j") * cell
    horizontal = F.col("axis") == "h"
    return once.select(*keys, "axis", x.alias("ax"), y.alias("ay"), F.when(horizontal, x + cell).otherwise(x).alias("bx"), F.when(horizontal, y).otherwise(y + cell).alias("by"))


def strips(segs: DataFrame, width, joints: bool = True, sides: int = 16) -> DataFrame:
    """Buffer of lines: one rectangle per segment and one circle per vertex, same feature."""
    rects = segs.withColumn("geom", F.array(shapes.rect_between("ax", "ay", "bx", "by", width)))
    if not joints:
        return rects
    r = (F.col(width) if isinstance(width, str) else F.lit(width)) / 2
    ends = segs.withColumn("_c", F.explode(F.array(pt("ax", "ay"), pt("bx", "by"))))
    return rects.unionByName(ends.withColumn("geom", F.array(shapes.circle("_c.x", "_c.y", r, sides))).drop("_c"))


def _chain(pts: Column, left: bool) -> Column:
    """Lower (or upper) hull chain of points sorted by x; turns that bend the wrong way drop.

    Along a convex chain the vertices a new point makes obsolete are exactly a suffix, so
    the survivors are a prefix whose length is the number of proper turns plus one.
    """
    sign = 1.0 if left else -1.0

    def step(acc, p):
        n = F.size(acc)
        turns = F.when(n >= 2, F.size(F.filter(
            F.zip_with(F.slice(acc, 1, n - 1), F.slice(acc, 2, n - 1), lambda a, b: ((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) * sign),
            lambda v: v > 0))).otherwise(F.lit(0))
        return F.concat(F.slice(acc, 1, F.least(n, turns + 1)), F.array(p))

    return F.aggregate(pts, F.array().cast(shapes.RING), step)


def hull_ring(pts) -> Column:
    """Closed counter-clockwise convex hull of an array of points; empty below three corners."""
    s = F.array_sort(F.array_distinct(pts))
    lower, upper = _chain(s, True), F.reverse(_chain(s, False))
    ring = F.concat(lower, F.slice(upper, 2, F.greatest(F.size(upper) - 1, F.lit(0))))
    return F.when(F.size(ring) >= 4, ring).otherwise(F.array().cast(shapes.RING))


def outermost(points: DataFrame, keys: list[str], directions: int = 32) -> DataFrame:
    """Points (keys, x, y) that the polygon of the farthest points in some directions does not hold inside.

    The farthest points are maxima, combined before they are shuffled, one row a key; a point strictly inside
    their polygon cannot be on the hull. Of a round or square cloud less than one point in a hundred stays.
    """
    p = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    turns = [2 * math.pi * i / directions for i in range(directions)]
    far = [F.max_by(F.struct("x", "y"), F.col("x") * math.cos(a) + F.col("y") * math.sin(a)) for a in turns]
    corners = p.groupBy(*keys).agg(F.array(*far).alias("_c")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.concat("_c", F.slice("_c", 1, 1)).alias("_c"))
    same = reduce(lambda m, n: m & n, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    sides = F.zip_with(F.slice("_c", 1, directions), F.slice("_c", 2, directions), lambda u, v: F.struct(u.alias("u"), v.alias("v")))
    real = F.filter(sides, lambda s: (s.u.x != s.v.x) | (s.u.y != s.v.y))
    joined = p.join(corners.withColumn("_s", real).drop("_c"), same)
    inside = F.forall("_s", lambda s: (s.v.x - s.u.x) * (F.col("y") - s.u.y) - (s.v.y - s.u.y) * (F.col("x") - s.u.x) > 0) & (F.size("_s") > 2)
    return joined.filter(~inside).select(*keys, "x", "y")


def hull(points: DataFrame, keys: list[str], batch: int = 64, rounds: int = 1) -> DataFrame:
    """Convex hull per key, from partial hulls of ``batch`` shares of its outermost points.

    A share is dealt by a hash of the point, whatever order the rows come in; points that are on no partial
    hull are on no hull, and only points of partial hulls meet in one row.
    """
    p = outermost(points, keys)
    for _ in range(rounds):
        lists = p.withColumn("_b", F.pmod(F.xxhash64("x", "y"), F.lit(batch))).groupBy(*keys, "_b").agg(F.collect_set(F.struct("x", "y")).alias("_l"))
        ring = hull_ring("_l")
        kept = F.when(F.size(ring) >= 4, F.slice(ring, 1, F.size(ring) - 1)).otherwise(F.col("_l"))
        p = lists.select(*keys, F.explode(kept).alias("_p")).select(*keys, "_p.x", "_p.y")
    out = p.groupBy(*keys).agg(F.collect_set(F.struct("x", "y")).alias("_l")).withColumn("_r", hull_ring("_l"))
    return out.filter(F.size("_r") >= 4).select(*keys, F.array("_r").alias("geom"))


def tidy(df: DataFrame, min_area: float = 0.5) -> DataFrame:
    """Outer rings counter-clockwise, holes clockwise; slivers dropped."""
    return df.withColumn("geom", shapes.orient_geom("geom")).filter((F.size(F.col("geom")[0]) >= 4) & (shapes.geom_area("geom") >= min_area))


def keyhole(geom) -> Column:
    """One ring with the same area: holes hung on the outer ring by slits of no width."""
    g = shapes.orient_geom(geom)
    outer = g[0]
    holes = F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0)))
    return F.aggregate(holes, outer, lambda acc, h: F.concat(acc, h, F.slice(outer, 1, 1)))


def split_disjoint_rings(polys: DataFrame, fid: list[str], key: str = "icao") -> DataFrame:
    """Rings listed as holes but lying outside the outer ring become polygons of their own."""
    from .spatial import points_in_polygons
    rings = polys.select(key, *fid, F.posexplode("geom").alias("ring", "r"))
    outers = rings.filter("ring = 0").select(key, *fid, F.array("r").alias("geom"))
    holes = rings.filter("ring > 0").withColumn("x", F.col("r")[0].x).withColumn("y", F.col("r")[0].y)
    own = outers.select(key, *[F.col(f).alias(f"_o_{f}") for f in fid], "geom")
    hits = points_in_polygons(holes, own, [*fid, "ring"], [f"_o_{f}" for f in fid], key=key)
    same = hits
    for f in fid:
        same = same.filter(F.col(f) == F.col(f"_o_{f}"))
    marked = holes.join(same.select(key, *fid, "ring", F.lit(True).alias("_in")), [key, *fid, "ring"], "left")
    real = marked.filter("_in").groupBy(key, *fid).agg(F.array_sort(F.collect_list(F.struct("ring", "r"))).alias("h"))
    main = outers.join(real, [key, *fid], "left").select(
        key, *fid, F.lit(0).alias("part"), F.concat("geom", F.coalesce(F.transform("h", lambda s: s.r), F.array().cast(shapes.GEOM))).alias("geom"))
    extra = marked.filter("_in IS NULL").select(key, *fid, F.col("ring").alias("part"), F.array("r").alias("geom"))
    return main.unionByName(extra)


def split_lines(segs: DataFrame, keys: list[str], rects: DataFrame, cell: float = 250.0) -> DataFrame:
    """Split segments into parts inside and outside a set of rectangles.

    ``rects``: icao, ax, ay, bx, by (axis), width_m. The parameter interval of a segment
    inside each rectangle is closed-form; intervals of one segment are merged, and the
    parts come out in order with ``inside`` and running ``part`` numbers per line.
    """
    from .ordered import lag, running, scan
    from .spatial import SEG, segment_cells
    half = F.col("width_m") / 2
    r = rects.select("icao", "ax", "ay", "bx", "by", half.alias("_h"))
    rc = segment_cells(r, cell, F.col("_h")).select(
        "icao", "cx", "cy", F.col("ax").alias("rx0"), F.col("ay").alias("ry0"), F.col("bx").alias("rx1"), F.col("by").alias("ry1"), "_h")
    base = segs.select("icao", *keys, "seq", *SEG)
    j = segment_cells(base, cell).join(shuffled(rc), ["icao", "cx", "cy"])
    j = j.select("icao", *keys, "seq", *SEG, "rx0", "ry0", "rx1", "ry1", "_h").distinct()
    ln = dist("rx0", "ry0", "rx1", "ry1")
    ux, uy = (F.col("rx1") - F.col("rx0")) / ln, (F.col("ry1") - F.col("ry0")) / ln

    def local(x, y):
        dx, dy = F.col(x) - F.col("rx0"), F.col(y) - F.col("ry0")
        return dx * ux + dy * uy, dx * uy - dy * ux

    a_l, a_w = local("ax", "ay")
    b_l, b_w = local("bx", "by")

    def slab(a, b, lo, hi):
        d = b - a
        flat = F.abs(d) < 1e-12
        inside = (a >= lo) & (a <= hi)
        t0 = F.when(flat, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least((lo - a) / d, (hi - a) / d))
        t1 = F.when(flat, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest((lo - a) / d, (hi - a) / d))
        return t0, t1

    l0, l1 = slab(a_l, b_l, F.lit(0.0), ln)
    w0, w1 = slab(a_w, b_w, -F.col("_h"), F.col("_h"))
    iv = j.select("icao", *keys, "seq", F.greatest(l0, w0, F.lit(0.0)).alias("t0"), F.least(l1, w1, F.lit(1.0)).alias("t1")).filter("t1 - t0 > 1e-9")
    per = iv.groupBy("icao", *keys, "seq").agg(F.array_sort(F.collect_list(F.struct("t0", "t1"))).alias("iv"))
    merged = F.aggregate("iv", F.array().cast("array<struct<t0:double,t1:double>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1).t1 >= s.t0 - 1e-9),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1).t0.alias("t0"), F.greatest(F.element_at(acc, -1).t1, s.t1).alias("t1")))))
        .otherwise(F.concat(acc, F.array(F.struct(s.t0.alias("t0"), s.t1.alias("t1"))))))
    m = base.join(per, ["icao", *keys, "seq"], "left").withColumn("iv", F.coalesce(merged, F.array().cast("array<struct<t0:double,t1:double>>")))
    # Gaps between the merged intervals are the outside parts.
    bounds = F.concat(F.array(F.struct(F.lit(0.0).alias("t0"), F.lit(0.0).alias("t1"))), F.col("iv"), F.array(F.struct(F.lit(1.0).alias("t0"), F.lit(1.0).alias("t1"))))
    n = F.size("_b")
    gaps = F.zip_with(F.slice("_b", 1, n - 1), F.slice("_b", 2, n - 1), lambda p, q: F.struct(p.t1.alias("t0"), q.t0.alias("t1"), F.lit(False).alias("inside")))
    ins = F.transform("iv", lambda s: F.struct(s.t0.alias("t0"), s.t1.alias("t1"), F.lit(True).alias("inside")))
    cuts = m.withColumn("_b", bounds).withColumn("_s", F.explode(F.filter(F.array_sort(F.concat(gaps, ins)), lambda s: s.t1 - s.t0 > 1e-9)))
    parts = cuts.select("icao", *keys, "seq", "_s.t0", "_s.t1", "_s.inside", *SEG)
    for (p, q), t, names in ((("ax", "ay"), "t0", ("px", "py")), (("ax", "ay"), "t1", ("qx", "qy"))):
        parts = parts.withColumn(names[0], F.col(p) + F.col(t) * (F.col("bx") - F.col(p))).withColumn(names[1], F.col(q) + F.col(t) * (F.col("by") - F.col(q)))
    parts = parts.select("icao", *keys, "seq", "t0", "inside", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("qx").alias("bx"), F.col("qy").alias("by"))
    parts = scan(parts, ["icao", *keys], ["seq", "t0"], _pi=lag("inside"))
    starts = F.coalesce(F.col("_pi") != F.col("inside"), F.lit(True)).cast("int")
    return scan(parts.withColumn("_st", starts), ["icao", *keys], ["seq", "t0"], part=running("_st")).drop("_pi", "_st")


def quad_tiles(points: DataFrame, cap: int = 50000, depth: int = 5, size: float = 1.0) -> DataFrame:
    """Adaptive tiling: the shallowest quad cell of each point holding at most ``cap`` points.

    ``points``: x, y in [0, size). Counts per cell of every level come from one aggregation
    over the deepest cells, so the points are shuffled once.
    """
    n = 1 << depth
    deep = points.withColumn("_ix", F.least(F.floor(F.col("x") / size * n), F.lit(n - 1)).cast("int")).withColumn("_iy", F.least(F.floor(F.col("y") / size * n), F.lit(n - 1)).cast("int"))
    per = deep.groupBy("_ix", "_iy").agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda lv: F.struct(
        lv.alias("level"), F.floor(F.col("_ix") / F.pow(F.lit(2), depth - lv)).cast("int").alias("tx"), F.floor(F.col("_iy") / F.pow(F.lit(2), depth - lv)).cast("int").alias("ty"))))
    wide = per.select("_ix", "_iy", "n", levels.alias("l")).select("_ix", "_iy", "n", "l.*")
    counts = wide.groupBy("level", "tx", "ty").agg(F.sum("n").alias("n_tile"))
    fit = wide.join(counts, ["level", "tx", "ty"]).filter((F.col("n_tile") <= cap) | (F.col("level") == depth))
    # The grid has at most 4**depth cells, a bound fixed by the depth, not by the data.
    tile = fit.groupBy("_ix", "_iy").agg(F.min(F.struct("level", "tx", "ty", "n_tile")).alias("t")).select("_ix", "_iy", "t.*")
    return deep.join(F.broadcast(tile), ["_ix", "_iy"]).drop("_ix", "_iy")


