"""Spatial joins as equi-joins on grid cells, with exact predicates behind them.

Every join here carries (icao, cell) equality, so no pair is formed between things that are
far apart, and no result depends on the cell size. Copies at one place are collapsed before
the join, so a third of the rows sitting on one spot costs one probe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import c, seg_cross, seg_dist, seg_param, seg_seg_dist

SEG = ["ax", "ay", "bx", "by"]


def cell_no(v, cell) -> Column:
    return F.floor(c(v) / cell).cast("int")


def shuffled(df: DataFrame) -> DataFrame:
    """Join by a shuffle: rows an explode makes count as their source file to the optimizer, which would send them all through the driver."""
    return df.hint("merge")


def point_cells(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    return df.withColumn("cx", cell_no(x, cell)).withColumn("cy", cell_no(y, cell))


def segment_cells(df: DataFrame, cell: float, d: float = 0.0) -> DataFrame:
    """One row per cell within ``d`` of the segment (ax, ay)-(bx, by), column by column.

    Only cells along the segment are produced, not those of its bounding box. What touches a cell
    border counts for both sides, so that segments which meet there up to rounding share a cell.
    """
    x0, x1 = F.least("ax", "bx"), F.greatest("ax", "bx")
    pad = d + 1e-6
    cols = df.withColumn("cx", F.explode(F.sequence(cell_no(x0 - pad, cell), cell_no(x1 + pad, cell))))
    left = F.greatest(F.col("cx") * cell - pad, x0)
    right = F.least((F.col("cx") + 1) * cell + pad, x1)
    dx = F.col("bx") - F.col("ax")
    steep = F.abs(dx) < 1e-9
    slope = (F.col("by") - F.col("ay")) / F.when(steep, F.lit(1.0)).otherwise(dx)
    ya = F.when(steep, F.least("ay", "by")).otherwise(F.col("ay") + (F.least(left, x1) - F.col("ax")) * slope)
    yb = F.when(steep, F.greatest("ay", "by")).otherwise(F.col("ay") + (F.greatest(right, x0) - F.col("ax")) * slope)
    return cols.withColumn("cy", F.explode(F.sequence(cell_no(F.least(ya, yb) - pad, cell), cell_no(F.greatest(ya, yb) + pad, cell))))


def edges_of(df: DataFrame, keep: list[str], geom: str = "geom") -> DataFrame:
    """Segments of every ring or line of a feature table: keep columns, ring, seq, ax, ay, bx, by."""
    rings = df.select(*keep, F.posexplode(geom).alias("ring", "_r"))
    n = F.size("_r")
    segs = F.when(n >= 2, F.zip_with(F.slice("_r", 1, n - 1), F.slice("_r", 2, n - 1), lambda p, q: F.struct(
        p.x.alias("ax"), p.y.alias("ay"), q.x.alias("bx"), q.y.alias("by"))))
    return rings.select(*keep, "ring", F.posexplode(segs).alias("seq", "_s")).select(*keep, "ring", "seq", "_s.*")


def as_segments(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points as segments of no length, so that point targets use the same joins."""
    return df.withColumn("ax", c(x)).withColumn("ay", c(y)).withColumn("bx", c(x)).withColumn("by", c(y))


def wide_cells(segs: DataFrame, cell: float, key: str = "icao", full: int = 4096) -> DataFrame:
    """(key, cell): 8, 4 or 2 times ``cell`` where a key has few segments, ``cell`` from ``full`` of them on.

    A segment is laid out in fewer rows in wide cells, and few segments meet a point even there. The steps quarter
    ``full``, as an area does when its side is halved.
    """
    n = segs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    wide = F.when(F.col("_n") < full // 16, 8.0).when(F.col("_n") < full // 4, 4.0).when(F.col("_n") < full, 2.0).otherwise(1.0)
    return n.select(key, (wide * cell).alias("_cell"))


SLOTS = 1 << 19


def _slot_bit(key: str) -> tuple[Column, Column]:
    h = F.xxhash64(key, "cx", "cy")
    return h.bitwiseAND(F.lit(SLOTS - 1)), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")


def in_cells(df: DataFrame, cells: DataFrame, key: str = "icao") -> DataFrame:
    """Rows of ``df`` (key, cx, cy) whose cell is one of ``cells``, and a few others: what meets nothing is not shuffled.

    The cells are told from a table of at most ``SLOTS`` numbers of 64 bits, whatever the input, so it may be broadcast;
    an exact join follows.
    """
    slot, bit = _slot_bit(key)
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    seen = cells.select(slot.alias("_slot"), mark.alias("_m")).groupBy("_slot").agg(F.bit_or("_m").alias("_bits"))
    return df.withColumn("_slot", slot).join(F.broadcast(seen), "_slot").filter(F.col("_bits").bitwiseAND(mark) != 0).drop("_slot", "_bits")


def box_cells(df: DataFrame, cell: float, d: float = 0.0, geom: str = "geom") -> DataFrame:
    """One row a cell that the box of a geometry, widened by ``d``, meets."""
    from ..functions.shapes import bounds
    b = bounds(geom)
    return (df.withColumn("cx", F.explode(F.sequence(cell_no(b["min_x"] - d, cell), cell_no(b["max_x"] + d, cell))))
            .withColumn("cy", F.explode(F.sequence(cell_no(b["min_y"] - d, cell), cell_no(b["max_y"] + d, cell)))))


def near_pairs(points: DataFrame, segs: DataFrame, d: float, x: str = "x", y: str = "y", cell: float | None = None,
               key: str = "icao", wide: bool = False) -> DataFrame:
    """Point-segment pairs within ``d`` of each other, with ``dist`` and ``at`` (0..1 along).

    ``wide``: segments are much longer than a cell, so cells follow their number (``wide_cells``).
    """
    cell = cell or max(d, 100.0)
    if wide:
        size = shuffled(wide_cells(segs, cell, key))
        points, segs, cell = points.join(size, key), segs.join(size, key), F.col("_cell")
    left = point_cells(points, x, y, cell).drop("_cell")
    right = segment_cells(segs, cell, d).drop("_cell")
    out = left.join(shuffled(right), [key, "cx", "cy"]).drop("cx", "cy")
    out = out.withColumn("dist", seg_dist(x, y, *SEG)).filter(F.col("dist") <= d)
    return out.withColumn("at", seg_param(x, y, *SEG))


def nearest(points: DataFrame, segs: DataFrame, cap: float, values: list[str], tie: list[str], x: str = "x",
            y: str = "y", cell: float | None = None, key: str = "icao", strict: bool = False, wide: bool = False) -> DataFrame:
    """Left join of each point with its nearest segment within ``cap``; ties by ``tie``.

    Adds ``values``, ``dist`` and ``at``; null where nothing is near enough.
    """
    cols = list(dict.fromkeys([*tie, *values]))
    targets = (segs.groupBy(key, *SEG).agg(F.min(F.struct(*cols)).alias("_v")))
    spots = points.select(key, F.col(x).alias("_px"), F.col(y).alias("_py")).distinct()
    pairs = near_pairs(spots, targets, cap, "_px", "_py", cell, key, wide)
    if strict:
        pairs = pairs.filter(F.col("dist") < cap)
    best = pairs.groupBy(key, "_px", "_py").agg(F.min(F.struct("dist", "_v", "at")).alias("_b"))
    best = best.select(key, F.col("_px").alias(x), F.col("_py").alias(y), F.col("_b.dist").alias("dist"),
                       F.col("_b.at").alias("at"), *[F.col(f"_b._v.{v}").alias(v) for v in values])
    return points.join(best, [key, x, y], "left")


def within(points: DataFrame, segs: DataFrame, d: float, how: str = "left_semi", x: str = "x", y: str = "y",
           cell: float | None = None, key: str = "icao", strict: bool = False) -> DataFrame:
    """Points within ``d`` of any segment (``left_semi``) or of none (``left_anti``)."""
    spots = points.select(key, F.col(x).alias("_px"), F.col(y).alias("_py")).distinct()
    pairs = near_pairs(spots, segs.select(key, *SEG).distinct(), d, "_px", "_py", cell, key)
    if strict:
        pairs = pairs.filter(F.col("dist") < d)
    hits = pairs.select(key, F.col("_px").alias(x), F.col("_py").alias(y)).distinct()
    return points.join(hits, [key, x, y], how)


def crossings(segs: DataFrame, sid: list[str], way: str = "way", cell: float = 250.0, key: str = "icao") -> DataFrame:
    """Crossing points of segments of different ways, each pair once (a < b by way)."""
    cells = segment_cells(segs.select(key, way, *sid, *SEG), cell)
    a = cells.select(key, "cx", "cy", *[F.col(n).alias(f"a_{n}") for n in (way, *sid, *SEG)])
    b = cells.select(key, "cx", "cy", *[F.col(n).alias(f"b_{n}") for n in (way, *sid, *SEG)])
    on = a.join(shuffled(b), [key, "cx", "cy"]).filter(F.col(f"a_{way}") < F.col(f"b_{way}"))
    hit, x, y = seg_cross(*[f"a_{n}" for n in SEG], *[f"b_{n}" for n in SEG])
    out = on.filter(hit).withColumn("x", x).withColumn("y", y)
    # Both segments may share several cells: keep the pair only in the cell of its crossing,
    # or in the lowest shared cell when rounding puts the crossing on a border.
    pair = [key, *[f"{s}_{n}" for s in "ab" for n in (way, *sid)]]
    return out.groupBy(*pair).agg(F.min(F.struct("x", "y")).alias("p")).select(*pair, F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def lines_near(segs: DataFrame, fid: list[str], targets: DataFrame, d: float, cell: float | None = None,
               key: str = "icao", few: str | None = None) -> DataFrame:
    """Ids of features with a segment within ``d`` of a target segment.

    ``few`` names the side, ``lines`` or ``targets``, that is much the smaller: of the other only what lies in its
    cells is shuffled.
    """
    cell = cell or max(d, 250.0)
    left = segment_cells(segs.select(key, *fid, *SEG), cell, d)
    targets = targets.select(key, *SEG)
    right = segment_cells(targets if few == "lines" else targets.distinct(), cell)
    if few == "lines":
        right = in_cells(right, left, key)
    elif few == "targets":
        left = in_cells(left, right, key)
    right = right.select(key, "cx", "cy", F.col("ax").alias("tx"), F.col("ay").alias("ty"), F.col("bx").alias("ux"), F.col("by").alias("uy"))
    close = seg_seg_dist(*SEG, "tx", "ty", "ux", "uy") <= d
    return left.join(shuffled(right), [key, "cx", "cy"]).filter(close).select(key, *fid).distinct()


def rising_sides(geom: str = "geom") -> Column:
    """The sides of all rings of a geometry, level ones left out, as an array of (ax, ay, bx, by)."""
    n = lambda r: F.greatest(F.size(r) - 1, F.lit(0))
    sides = F.flatten(F.transform(geom, lambda r: F.zip_with(F.slice(r, 1, n(r)), F.slice(r, 2, n(r)), lambda p, q: F.struct(
        p.x.alias("ax"), p.y.alias("ay"), q.x.alias("bx"), q.y.alias("by")))))
    return F.filter(sides, lambda e: e.ay != e.by)


def crossed_rows(polys: DataFrame, keep: list[str], step: float, geom: str = "geom") -> DataFrame:
    """(keep, row, _x): where the middle line of each row of ``step`` metres crosses the sides of a polygon, in order.

    Worked out within the polygon's own row, so nothing is sorted or shuffled.
    """
    return block_rows(row_blocks(polys, keep, step, geom), keep, step)


def row_blocks(polys: DataFrame, keep: list[str], step: float, geom: str = "geom") -> DataFrame:
    """Polygons in blocks ``_k`` of 64 rows, each with the sides that pass it, so a ring of many sides is not gone through for each row."""
    first, last = lambda e: F.ceil(F.least(e.ay, e.by) / step - 0.5).cast("int"), lambda e: (F.ceil(F.greatest(e.ay, e.by) / step - 0.5) - 1).cast("int")
    sides = F.transform(rising_sides(geom), lambda e: F.struct(e.ax.alias("ax"), e.ay.alias("ay"), e.bx.alias("bx"), e.by.alias("by"), first(e).alias("f"), last(e).alias("l")))
    s = polys.select(*keep, F.filter(sides, lambda e: e.l >= e.f).alias("_e"))
    s = s.withColumn("_f", F.array_min(F.transform("_e", lambda e: e.f))).withColumn("_l", F.array_max(F.transform("_e", lambda e: e.l))).filter("_l >= _f")
    s = s.withColumn("_k", F.explode(F.sequence(F.shiftright("_f", 6), F.shiftright("_l", 6))))
    low, high = F.col("_k") * 64, F.col("_k") * 64 + 63
    return s.select(*keep, F.greatest("_f", low).alias("_f"), F.least("_l", high).alias("_l"), "_k", F.filter("_e", lambda e: (e.f <= high) & (e.l >= low)).alias("_e"))


def block_rows(blocks: DataFrame, keep: list[str], step: float) -> DataFrame:
    s = blocks.withColumn("row", F.explode(F.sequence("_f", "_l")))
    row = F.col("row")
    x = F.transform(F.filter("_e", lambda e: (e.f <= row) & (e.l >= row)), lambda e: e.ax + ((row + 0.5) * step - e.ay) * (e.bx - e.ax) / (e.by - e.ay))
    return s.select(*keep, "row", F.array_sort(x).alias("_x"))


EDGE = 0.01


def polygon_cells(polys: DataFrame, keep: list[str], cell: float, geom: str = "geom") -> DataFrame:
    """One row a cell that may hold a point inside a polygon: keep, cx, cy and ``_e``, all sides a ray to the right may cross.

    These are the sides that pass the cell's row at or beyond its left border. A row of cells has only the columns
    between the first and the last side that passes it.
    """
    s = polys.select(*keep, rising_sides(geom).alias("_e"))
    low, high = F.array_min(F.transform("_e", lambda e: F.least(e.ay, e.by))), F.array_max(F.transform("_e", lambda e: F.greatest(e.ay, e.by)))
    s = s.withColumn("cy", F.explode(F.sequence(cell_no(low, cell), cell_no(high, cell))))
    bottom, top = F.col("cy") * cell, (F.col("cy") + 1) * cell

    def reach(e):
        flat = F.abs(e.by - e.ay) < 1e-6
        at = lambda y: e.ax + (e.bx - e.ax) * F.least(F.greatest((y - e.ay) / (e.by - e.ay), F.lit(0.0)), F.lit(1.0))
        u = F.when(flat, e.ax).otherwise(at(F.greatest(F.least(e.ay, e.by), bottom)))
        v = F.when(flat, e.bx).otherwise(at(F.least(F.greatest(e.ay, e.by), top)))
        return F.struct(e.ax.alias("ax"), e.ay.alias("ay"), e.bx.alias("bx"), e.by.alias("by"), F.least(u, v).alias("lo"), F.greatest(u, v).alias("hi"))

    passing = F.filter("_e", lambda e: (F.least(e.ay, e.by) <= top) & (F.greatest(e.ay, e.by) >= bottom))
    s = s.select(*keep, "cy", F.transform(passing, reach).alias("_e"))
    first, last = F.array_min(F.transform("_e", lambda e: e.lo)), F.array_max(F.transform("_e", lambda e: e.hi))
    s = s.withColumn("cx", F.explode(F.sequence(cell_no(first - EDGE, cell), cell_no(last + EDGE, cell))))
    ahead = F.filter("_e", lambda e: e.hi >= F.col("cx") * cell - EDGE)
    return s.select(*keep, "cx", "cy", F.transform(ahead, lambda e: F.struct(e.ax.alias("ax"), e.ay.alias("ay"), e.bx.alias("bx"), e.by.alias("by"))).alias("_e"))


def points_in_polygons(points: DataFrame, polys: DataFrame, pid: list[str], fid: list[str], x: str = "x", y: str = "y",
                       cell: float = 200.0, key: str = "icao", geom: str = "geom") -> DataFrame:
    """(pid, fid) pairs of points strictly inside polygons, holes respected.

    A polygon is laid out in the cells it can hold points in, each with the sides of its row (``polygon_cells``); a
    point meets it in one row, where the parity of the crossings to its right decides.
    """
    cells = polygon_cells(polys, [key, *fid], cell, geom)
    spots = point_cells(points.select(key, F.col(x).alias("_px"), F.col(y).alias("_py")).distinct(), "_px", "_py", cell)
    px, py = F.col("_px"), F.col("_py")
    crossed = F.filter("_e", lambda e: ((e.ay > py) != (e.by > py)) & (px < (e.bx - e.ax) * (py - e.ay) / (e.by - e.ay) + e.ax))
    inside = (spots.join(shuffled(cells), [key, "cx", "cy"]).filter(F.size(crossed) % 2 == 1)
              .select(key, F.col("_px").alias(x), F.col("_py").alias(y), *fid))
    return points.select(key, *pid, x, y).join(inside, [key, x, y]).select(key, *pid, *fid)


def box_pairs(left: DataFrame, right: DataFrame, cell: float, key: str = "icao", d: float = 0.0) -> DataFrame:
    """Pairs of rows whose boxes (l_/r_ min_x, min_y, max_x, max_y) meet; each pair once.

    A pair meeting in several cells is kept in the cell holding the lower-left corner of
    the shared box, so no de-duplicating shuffle is needed.
    """
    def spread(df, p, pad):
        return (df.withColumn("cx", F.explode(F.sequence(cell_no(F.col(f"{p}min_x") - pad, cell), cell_no(F.col(f"{p}max_x") + pad, cell))))
                .withColumn("cy", F.explode(F.sequence(cell_no(F.col(f"{p}min_y") - pad, cell), cell_no(F.col(f"{p}max_y") + pad, cell)))))
    on = spread(left, "l_", d).join(shuffled(spread(right, "r_", 0.0)), [key, "cx", "cy"])
    meet = ((F.col("l_min_x") - d <= F.col("r_max_x")) & (F.col("r_min_x") <= F.col("l_max_x") + d)
            & (F.col("l_min_y") - d <= F.col("r_max_y")) & (F.col("r_min_y") <= F.col("l_max_y") + d))
    home = ((cell_no(F.greatest(F.col("l_min_x") - d, F.col("r_min_x")), cell) == F.col("cx"))
            & (cell_no(F.greatest(F.col("l_min_y") - d, F.col("r_min_y")), cell) == F.col("cy")))
    return on.filter(meet & home).drop("cx", "cy")
