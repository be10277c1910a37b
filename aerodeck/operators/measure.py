"""Lines and rings on the long vertex table: measures, tessellation, offsets, cuts."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import bezier, bezier_steps, dist
from . import ordered


def segments(vertex: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Each vertex joined with the next of its line as (ax, ay, bx, by); the last has none."""
    s = ordered.scan(vertex.withColumnRenamed("x", "ax").withColumnRenamed("y", "ay"), keys, [seq],
                     bx=ordered.lead("ax"), by=ordered.lead("ay"))
    return s.filter(F.col("bx").isNotNull())


def measure_lines(vertex: DataFrame, keys: list[str]) -> DataFrame:
    """Length, longest segment and the point halfway along, per line."""
    s = segments(vertex, keys).withColumn("len", dist("ax", "ay", "bx", "by"))
    s = ordered.scan(s, keys, ["seq"], cum=ordered.running("len"))
    total = s.groupBy(*keys).agg(F.sum("len").alias("length"), F.max("len").alias("longest"))
    half = s.join(total, keys).filter((F.col("cum") >= F.col("length") / 2) & (F.col("len") > 0))
    t = (F.col("length") / 2 - (F.col("cum") - F.col("len"))) / F.col("len")
    at = F.struct((F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))
    mid = half.groupBy(*keys).agg(F.min_by(at, F.col("seq")).alias("mid"))
    return total.join(mid, keys, "left").select(*keys, "length", "longest", F.col("mid.x").alias("mid_x"), F.col("mid.y").alias("mid_y"))


def measure_polygons(vertex: DataFrame, keys: list[str]) -> DataFrame:
    """Area, centroid and vertex mean of closed rings; ring 0 is the outer, others are holes.

    Every ring is a run of vertices with its first vertex repeated last. One scan for the
    next vertex, then one map-side combined aggregation; holes count negative.
    """
    s = segments(vertex, [*keys, "ring"])
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    per_ring = s.groupBy(*keys, "ring").agg(
        F.sum(cross).alias("c"), F.sum((F.col("ax") + F.col("bx")) * cross).alias("sx"),
        F.sum((F.col("ay") + F.col("by")) * cross).alias("sy"),
        F.sum("ax").alias("vx"), F.sum("ay").alias("vy"), F.count(F.lit(1)).alias("n"))
    sign = F.signum("c") * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    agg = per_ring.groupBy(*keys).agg(
        F.sum(sign * F.col("c")).alias("c"), F.sum(sign * F.col("sx")).alias("sx"), F.sum(sign * F.col("sy")).alias("sy"),
        F.sum(F.when(F.col("ring") == 0, F.col("vx"))).alias("vx"), F.sum(F.when(F.col("ring") == 0, F.col("vy"))).alias("vy"),
        F.sum(F.when(F.col("ring") == 0, F.col("n"))).alias("n"))
    area = F.when(F.col("c") != 0, F.col("c"))
    return agg.select(*keys, (F.col("c") / 2).alias("area"), (F.col("sx") / (3 * area)).alias("cx"), (F.col("sy") / (3 * area)).alias("cy"),
                      (F.col("vx") / F.col("n")).alias("mean_x"), (F.col("vy") / F.col("n")).alias("mean_y"))


def tessellate(segs: DataFrame) -> DataFrame:
    """Points along each segment whose ends may carry controls (acx, acy) and (bcx, bcy).

    A segment without controls gives its end point alone; the far control is mirrored.
    """
    ctrl = F.col("acx").isNotNull() | F.col("bcx").isNotNull()
    n = F.when(ctrl, bezier_steps(dist("ax", "ay", "bx", "by"))).otherwise(F.lit(1))
    e = segs.withColumn("_n", n).withColumn("step", F.explode(F.sequence(F.lit(1), "_n")))
    t = F.col("step") / F.col("_n")

    def along(a, b, ca, cb):
        curve = bezier(a, F.coalesce(ca, a), F.coalesce(2 * F.col(b) - F.col(cb), b), b, t)
        return F.when(F.col("acx").isNotNull() | F.col("bcx").isNotNull(), curve).otherwise(F.col(b))

    out = e.withColumn("x", along("ax", "bx", "acx", "bcx")).withColumn("y", along("ay", "by", "acy", "bcy"))
    return out.drop("ax", "ay", "bx", "by", "acx", "acy", "bcx", "bcy", "_n")


def close_rings(vertex: DataFrame, keys: list[str], tol: float = 1e-6) -> DataFrame:
    """Drop consecutive duplicates and repeat the first vertex last where a ring is open."""
    v = ordered.scan(vertex, keys, ["seq"], _px=ordered.lag("x"), _py=ordered.lag("y"))
    kept = v.filter(F.col("_px").isNull() | (dist("_px", "_py", "x", "y") >= tol)).drop("_px", "_py")
    ends = kept.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("z"),
                                   F.max("seq").alias("last"), F.count(F.lit(1)).alias("n"))
    open_ = ends.filter((F.col("n") >= 2) & (dist("a.x", "a.y", "z.x", "z.y") > tol))
    closing = open_.select(*keys, (F.col("last") + 1).alias("seq"), F.col("a.x").alias("x"), F.col("a.y").alias("y"))
    return kept.select(*keys, "seq", "x", "y").unionByName(closing)


def offset_lines(vertex: DataFrame, keys: list[str], d) -> DataFrame:
    """Each vertex moved ``d`` metres to the right of travel."""
    v = ordered.scan(vertex, keys, ["seq"], px=ordered.lag("x"), py=ordered.lag("y"), nx=ordered.lead("x"), ny=ordered.lead("y"))
    for n, base in (("px", "x"), ("py", "y"), ("nx", "x"), ("ny", "y")):
        v = v.withColumn(n, F.coalesce(n, base))
    size = F.greatest(dist("px", "py", "nx", "ny"), F.lit(1e-9))
    return (v.withColumn("ox", F.col("x") + d * (F.col("ny") - F.col("py")) / size)
            .withColumn("oy", F.col("y") - d * (F.col("nx") - F.col("px")) / size).drop("px", "py", "nx", "ny"))


def coded_runs(vertex: DataFrame, keys: list[str], closed: bool = False) -> DataFrame:
    """Number the runs of equal non-zero (line, light) code along a line or ring.

    Codes belong to the segment starting at a vertex. Output: the segments with ``run``;
    on a closed ring the last run continues the first when their codes are equal.
    """
    v = vertex.withColumnRenamed("x", "ax").withColumnRenamed("y", "ay")
    s = ordered.scan(v, keys, ["seq"], bx=ordered.lead("ax"), by=ordered.lead("ay"))
    if closed:
        first = v.groupBy(*keys).agg(F.min_by(F.struct("ax", "ay"), "seq").alias("_f"), F.count(F.lit(1)).alias("_n"))
        s = s.join(first, keys).filter(F.col("_n") >= 2)
        s = s.withColumn("bx", F.coalesce("bx", "_f.ax")).withColumn("by", F.coalesce("by", "_f.ay")).drop("_f", "_n")
    s = s.filter(F.col("bx").isNotNull())
    s = ordered.scan(s, keys, ["seq"], _pl=ordered.lag("line"), _pg=ordered.lag("light"))
    starts = F.coalesce((F.col("_pl") != F.col("line")) | (F.col("_pg") != F.col("light")), F.lit(True))
    s = ordered.scan(s.withColumn("_s", starts.cast("int")), keys, ["seq"], run=ordered.running("_s"))
    if closed:
        ends = s.groupBy(*keys).agg(F.max("run").alias("_last"), F.min_by(F.struct("line", "light"), "seq").alias("_a"),
                                    F.max_by(F.struct("line", "light"), "seq").alias("_z"))
        s = s.join(ends, keys)
        wrap = (F.col("run") == F.col("_last")) & (F.col("_last") > 1) & (F.col("_a") == F.col("_z")) & (F.col("line") != 0)
        s = s.withColumn("pass", F.when(wrap, 0).otherwise(1)).withColumn("run", F.when(wrap, F.lit(1)).otherwise(F.col("run")).cast("bigint"))
        s = s.drop("_last", "_a", "_z")
    return s.filter((F.col("line") != 0) | (F.col("light") != 0)).drop("_pl", "_pg", "_s")


def cut_pieces(vertex: DataFrame, keys: list[str], size: float = 150.0, tol: float = 1.0) -> DataFrame:
    """Number the pieces of lines; adds ``piece``, from 0.

    A vertex nearer than ``tol`` to the last kept one is dropped; a piece that has run ``size`` metres is closed, and
    the vertex that closes it opens the next. Pieces of one vertex go. Both rules look at what was kept before, so a
    line is passed through in order, once, with a few numbers of state and never held; vertices without a
    position are dropped.
    """
    names = vertex.columns
    shape = T.StructType([*vertex.schema.fields, T.StructField("piece", T.LongType())])

    def run(batches):
        key, last, length, piece, held = None, (0.0, 0.0), 0.0, 0, None  # held: the first vertex of a piece, waiting for a second
        for b in batches:
            at, no = [], []
            rows = zip(zip(*(b.column(names.index(k)).to_pylist() for k in keys), strict=True), b.column(names.index("x")).to_pylist(), b.column(names.index("y")).to_pylist(), strict=True)
            for i, (k, x, y) in enumerate(rows):
                if k != key or key is None:
                    key, last, length, piece, held = k, (x, y), 0.0, 0, i
                    continue
                d = math.sqrt((x - last[0]) * (x - last[0]) + (y - last[1]) * (y - last[1]))
                if d < tol:
                    continue
                if isinstance(held, int):
                    at.append(held)
                    no.append(piece)
                elif held is not None:
                    yield with_piece(held, [piece])
                at.append(i)
                no.append(piece)
                held, last, length = None, (x, y), length + d
                if length >= size:
                    held, length, piece = i, 0.0, piece + 1
            if at:
                yield with_piece(b.take(pa.array(at)), no)
            if isinstance(held, int):
                held = b.take(pa.array([held]))

    def with_piece(b, no):
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(no, pa.int64())], [*names, "piece"])

    placed = vertex.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return placed.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(run, shape)


def cut_at(segs: DataFrame, keys: list[str], cuts: DataFrame, limit: float = 300.0) -> DataFrame:
    """Part of each line before its first cut: the nearest given measure, else ``limit``.

    ``cuts`` holds (keys, measure) candidates. Adds ``from_m``/``to_m`` running measures to
    the segments and trims the one the cut falls in.
    """
    s = segs.withColumn("_len", dist("ax", "ay", "bx", "by"))
    s = ordered.scan(s, keys, ["seq"], to_m=ordered.running("_len")).withColumn("from_m", F.col("to_m") - F.col("_len"))
    first = cuts.groupBy(*keys).agg(F.min("measure").alias("_cut"))
    s = s.join(first, keys, "left").withColumn("_cut", F.least(F.coalesce("_cut", F.lit(limit)), F.lit(limit)))
    s = s.filter(F.col("from_m") < F.col("_cut"))
    t = F.when(F.col("_len") > 0, F.least((F.col("_cut") - F.col("from_m")) / F.col("_len"), F.lit(1.0))).otherwise(F.lit(1.0))
    s = s.withColumn("_t", t)
    return (s.withColumn("bx", F.col("ax") + F.col("_t") * (F.col("bx") - F.col("ax")))
            .withColumn("by", F.col("ay") + F.col("_t") * (F.col("by") - F.col("ay")))
            .withColumn("to_m", F.least("to_m", "_cut")).drop("_t", "_cut", "_len"))


def thin(vertex: DataFrame, keys: list[str], tol: float, passes: int = 2) -> DataFrame:
    """Drop every second inner vertex lying within ``tol`` of its neighbours' segment."""
    from ..functions.geo import seg_dist
    v = vertex
    for _ in range(passes):
        v = ordered.scan(v, keys, ["seq"], _px=ordered.lag("x"), _py=ordered.lag("y"), _nx=ordered.lead("x"), _ny=ordered.lead("y"), _rn=ordered.rank())
        inner = F.col("_px").isNotNull() & F.col("_nx").isNotNull() & (F.col("_rn") % 2 == 0)
        drop = inner & (seg_dist("x", "y", "_px", "_py", "_nx", "_ny") < tol)
        v = v.filter(~F.coalesce(drop, F.lit(False))).drop("_px", "_py", "_nx", "_ny", "_rn")
    return v


def feature_bbox(vertex: DataFrame, keys: list[str]) -> DataFrame:
    return vertex.groupBy(*keys).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def tiles(vertex: DataFrame, size: float = 300.0, limit: float = 20000.0) -> DataFrame:
    """Tile of each piece (by its first vertex) and the real box of everything in a tile."""
    first = vertex.groupBy("icao", "fid", "piece").agg(
        F.min_by(F.struct("x", "y"), "seq").alias("p"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"),
        F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))
    kept = first.filter((F.greatest(F.abs("x0"), F.abs("x1"), F.abs("y0"), F.abs("y1")) <= limit) & (F.col("n") >= 2))
    placed = kept.withColumn("tile_x", F.floor(F.col("p.x") / size)).withColumn("tile_y", F.floor(F.col("p.y") / size))
    return placed.groupBy("icao", "tile_x", "tile_y").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("points"), F.min(F.round("x0")).alias("min_x"), F.min(F.round("y0")).alias("min_y"),
        F.max(F.round("x1")).alias("max_x"), F.max(F.round("y1")).alias("max_y"))
