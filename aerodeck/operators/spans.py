"""Polygon overlay by spans: a shape is, for each row of ``step`` metres, the intervals its middle line crosses.

A span is (key, feature, row, x0, x1) with real ends, so straight sides lose nothing and areas are exact but for
rows in which a side bends. Shapes cost rows in proportion to their height, not to their area. Union, difference
and intersection are interval arithmetic in rows: equi-joins on (key, row, bucket of x), where a bucket bounds
how many spans meet, and ordered windows that merge what overlaps. Round buffers of lines and outlines have a
closed form in each row, so an offset with arc joins is a union of spans and needs no clean-up of crossings.

``polygons`` walks the ends of the spans of a feature into closed rings, holes included; the rings have
exactly the area of the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.geo import c
from .ordered import durable
from .spatial import block_rows, box_pairs, crossed_rows, row_blocks, shuffled

STEP = 1.0
BUCKET = 256.0
SPAN = "struct<x0:double,x1:double>"


def _rows(lo: Column, hi: Column, step: float) -> tuple[Column, Column]:
    """First and last row whose middle lies in [lo, hi)."""
    return F.ceil(lo / step - 0.5).cast("int"), (F.ceil(hi / step - 0.5) - 1).cast("int")


def of_polygons(polys: DataFrame, fid: list[str], step: float = STEP, key: str = "icao") -> DataFrame:
    """Spans of each polygon, holes left out: crossings of a middle line with the sides pair up in order."""
    return _paired(crossed_rows(polys, [key, *fid], step), [key, *fid])


def _paired(xs: DataFrame, keep: list[str]) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("_x") / 2).cast("int")), lambda i: F.struct(F.get("_x", 2 * i - 2).alias("x0"), F.get("_x", 2 * i - 1).alias("x1")))
    return xs.filter(F.size("_x") >= 2).select(*keep, "row", F.explode(pairs).alias("_s")).select(*keep, "row", "_s.x0", "_s.x1").filter("x1 > x0")


def cover(polys: DataFrame, step: float = STEP, key: str = "icao") -> DataFrame:
    """Spans that any polygon of a key covers; copies of a polygon are collapsed first.

    What is shuffled are the sides of blocks of 64 rows, not their spans; rows are made where they are united.
    """
    one = polys.select(key, "geom").withColumn("_id", F.xxhash64("geom")).dropDuplicates([key, "_id"])
    blocks = row_blocks(one, [key], step).repartition(key, "_k")
    return united(_paired(block_rows(blocks, [key, "_k"], step), [key, "_k"]), [key, "_k"]).drop("_k")


def of_buffers(segs: DataFrame, keep: list[str], radius, step: float = STEP) -> DataFrame:
    """Spans of all points within ``radius`` (a column or metres) of each segment ax, ay, bx, by.

    In a row the reach to the right, x(t) + sqrt(r^2 - v(t)^2) for the point t of the segment at height v below
    the line, is concave in t: its best t is where the offset side touches, held to the t that reach the row.
    """
    segs = segs.withColumn("_r", c(radius) if isinstance(radius, str) else F.lit(float(radius))).filter("_r > 0")
    first, last = _rows(F.least("ay", "by") - F.col("_r"), F.greatest("ay", "by") + F.col("_r"), step)
    s = segs.withColumn("_f", first).withColumn("_l", last).filter("_l >= _f").withColumn("row", F.explode(F.sequence("_f", "_l")))
    dx, dy, r = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("_r")
    up = (F.col("row") + 0.5) * step - F.col("ay")
    level = F.abs(dy) < 1e-12
    rise = F.when(level, F.lit(1.0)).otherwise(dy)
    t0 = F.when(level, 0.0).otherwise(F.greatest(F.lit(0.0), F.least((up - r) / rise, (up + r) / rise)))
    t1 = F.when(level, 1.0).otherwise(F.least(F.lit(1.0), F.greatest((up - r) / rise, (up + r) / rise)))
    touch = r * dx / F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-12)) * F.signum(dy)

    def end(side: int) -> Column:
        level_t = F.when(dx * side > 0, 1.0).otherwise(0.0)
        t = F.when(level, level_t).otherwise(F.least(F.greatest((up + side * touch) / rise, t0), t1))
        v = up - t * dy
        return F.col("ax") + t * dx + side * F.sqrt(F.greatest(r * r - v * v, F.lit(0.0)))

    return s.select(*keep, "row", end(-1).alias("x0"), end(1).alias("x1")).filter("x1 > x0")


def united(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of each (keys, row) with those that overlap or touch as one."""
    by = W.partitionBy(*keys, "row").orderBy("x0", "x1")
    reached = F.max("x1").over(by.rowsBetween(W.unboundedPreceding, -1))
    fresh = spans.select(*keys, "row", "x0", "x1").withColumn("_new", F.when(reached >= F.col("x0") - 1e-9, 0).otherwise(1))
    run = fresh.withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(*keys, "row", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def bucketed(spans: DataFrame, bucket: float) -> DataFrame:
    """Spans cut at the borders of buckets of x."""
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("x0") / bucket).cast("int"), F.floor(F.col("x1") / bucket).cast("int"))))
    return s.withColumn("x0", F.greatest("x0", F.col("_b") * bucket)).withColumn("x1", F.least("x1", (F.col("_b") + 1) * bucket)).filter("x1 > x0")


def _met(spans: DataFrame, others: DataFrame, key: str, bucket: float) -> DataFrame:
    """Cut ``spans`` with ``_o``, the merged spans of ``others`` in their row and bucket."""
    cells = united(bucketed(others, bucket), [key, "_b"])
    lists = cells.groupBy(key, "row", "_b").agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("_o"))
    return bucketed(spans, bucket).join(shuffled(lists), [key, "row", "_b"], "left").withColumn("_o", F.coalesce("_o", F.array().cast(f"array<{SPAN}>")))


def _pieces(met: DataFrame, pieces: Column, fid: list[str], key: str) -> DataFrame:
    clipped = F.filter(F.transform(pieces, lambda s: F.struct(F.greatest(s.x0, "x0").alias("x0"), F.least(s.x1, "x1").alias("x1"))), lambda s: s.x1 - s.x0 > 1e-9)
    cut = met.withColumn("_p", F.explode(clipped)).select(key, *fid, "row", "_p.x0", "_p.x1")
    return united(cut, [key, *fid])


def minus(spans: DataFrame, others: DataFrame, fid: list[str], key: str = "icao", bucket: float = BUCKET) -> DataFrame:
    """What of each feature's spans lies outside all ``others`` of its key."""
    starts = F.concat(F.array("x0"), F.transform("_o", lambda o: o.x1))
    ends = F.concat(F.transform("_o", lambda o: o.x0), F.array("x1"))
    return _pieces(_met(spans, others, key, bucket), F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("x0"), b.alias("x1"))), fid, key)


def common(spans: DataFrame, others: DataFrame, fid: list[str], key: str = "icao", bucket: float = BUCKET) -> DataFrame:
    """What of each feature's spans lies inside any of ``others`` of its key."""
    return _pieces(_met(spans, others, key, bucket), F.col("_o"), fid, key)


def measured(spans: DataFrame, keys: list[str], step: float = STEP) -> DataFrame:
    """Area of spans that do not overlap."""
    return spans.groupBy(*keys).agg((F.sum(F.col("x1") - F.col("x0")) * step).alias("area"))


def rings_of(spans: list, step: float, square: bool = False) -> list[list[list[tuple[float, float]]]]:
    """Polygons (outer ring counter-clockwise, then holes) of one feature's spans (row, x0, x1).

    Every span has a left end, passed downwards, and a right end, passed upwards. Between neighbouring rows an
    end goes on to the outer end of what it overlaps, or turns round along the border of the rows, and so each
    end has one successor; the cycles are the rings. An end that goes on is joined to the next by a straight side,
    which follows slanted sides and cuts a step by half a row; ``square`` draws the step along the border of the
    rows instead, which is exact for shapes with sides along the axes.
    """
    spans = sorted(tuple(s) for s in spans)
    by_row: dict[int, list[int]] = {}
    for i, (row, _, _) in enumerate(spans):
        by_row.setdefault(row, []).append(i)
    parent = list(range(len(spans)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    after: dict[tuple[int, int], tuple[tuple[int, int], bool]] = {}  # end (span, side) -> next end, and whether it turns round
    for row in sorted(set(by_row) | {r - 1 for r in by_row}):
        low, high = by_row.get(row, []), by_row.get(row + 1, [])
        groups, a, b = [], 0, 0
        while a < len(low) or b < len(high):  # groups of spans of both rows that overlap, from the left
            below, above, reach = [], [], -float("inf")
            if b >= len(high) or (a < len(low) and spans[low[a]][1] <= spans[high[b]][1]):
                below.append(low[a])
                a += 1
            else:
                above.append(high[b])
                b += 1
            ends = {0: max((spans[i][2] for i in below), default=reach), 1: max((spans[i][2] for i in above), default=reach)}
            while True:
                if a < len(low) and spans[low[a]][1] < ends[1]:
                    below.append(low[a])
                    ends[0] = max(ends[0], spans[low[a]][2])
                    a += 1
                elif b < len(high) and spans[high[b]][1] < ends[0]:
                    above.append(high[b])
                    ends[1] = max(ends[1], spans[high[b]][2])
                    b += 1
                else:
                    break
            groups.append((below, above))
        for below, above in groups:
            for i in (*below, *above):
                parent[root(i)] = root((below or above)[0])
            for i, j in zip(below, below[1:]):
                after[i, 1] = ((j, 0), True)
            for i, j in zip(above, above[1:]):
                after[j, 0] = ((i, 1), True)
            if below and above:
                after[below[-1], 1] = ((above[-1], 1), False)
                after[above[0], 0] = ((below[0], 0), False)
            elif below:
                after[below[-1], 1] = ((below[0], 0), True)
            else:
                after[above[0], 0] = ((above[-1], 1), True)

    outer: dict[int, list] = {}
    holes: dict[int, list] = {}
    seen: set[tuple[int, int]] = set()
    for start in after:
        ring, at = [], start
        while at not in seen:
            seen.add(at)
            (i, side), (to, turns) = at, after[at]
            row, x = spans[i][0], spans[i][1 + side]
            ring.append((x, (row + 0.5) * step))
            if turns or square:
                border = (row + 1 if side else row) * step
                ring += [(x, border), (spans[to[0]][1 + to[1]], border)]
            at = to
        if ring:
            kept = [q for p, q, r in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1]) if abs((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])) > 1e-9 * (1 + abs(r[0] - p[0]) + abs(r[1] - p[1]))]
            ring = kept if len(kept) >= 3 else ring
            area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))
            (outer if area > 0 else holes).setdefault(root(start[0]), []).append([*ring, ring[0]])
    return [[*rings, *holes.get(k, [])] for k, rings in sorted(outer.items(), key=lambda kv: kv[1][0][0])]


def polygons(spans: DataFrame, keys: list[str], step: float = STEP, square: bool = False) -> DataFrame:
    """(keys, part, geom, area): the connected parts of each feature's spans as closed rings.

    The spans of one feature meet in a row; merged, they are bounded by its height and its width over gaps.
    """
    trace = F.udf(lambda s: [[[(float(x), float(y)) for x, y in ring] for ring in poly] for poly in rings_of(s, step, square)], f"array<{shapes.GEOM}>", useArrow=False)
    one = united(spans, keys).groupBy(*keys).agg(F.collect_list(F.struct("row", "x0", "x1")).alias("_s"))
    out = one.select(*keys, F.posexplode(trace("_s")).alias("part", "geom"))
    return out.withColumn("area", shapes.geom_area("geom"))


def beside(others: DataFrame, polys: DataFrame, step: float = STEP, key: str = "icao") -> DataFrame:
    """(key, geom) of the ``others`` whose box meets the box of a polygon; only they can cover a part of one."""
    side = lambda df, p: df.select(key, F.col("geom").alias(f"{p}geom"), *[v.alias(f"{p}{n}") for n, v in shapes.bounds("geom").items()])
    met = box_pairs(side(others, "l_"), side(polys, "r_").drop("r_geom"), BUCKET, key, step)
    return met.select(key, F.col("l_geom").alias("geom"))


def remainders(polys: DataFrame, others: DataFrame, fid: list[str], step: float = STEP, key: str = "icao") -> DataFrame:
    """(key, fid, part, geom, area, own): the parts of each polygon outside all ``others``.

    ``own`` is the area of the whole polygon. One that nothing covers keeps its own geometry. What is left is read
    several times and kept as a table.
    """
    own = of_polygons(polys, fid, step, key)
    rest = durable(minus(own, cover(beside(others, polys, step, key), step, key), fid, key))
    sizes = measured(own, [key, *fid], step).withColumnRenamed("area", "_own").join(measured(rest, [key, *fid], step).withColumnRenamed("area", "_rest"), [key, *fid])
    base = polys.select(key, *fid, "geom").join(sizes, [key, *fid])
    whole = base.filter("_rest >= _own - 1e-6").select(key, *fid, F.lit(0).alias("part"), "geom", shapes.geom_area("geom").alias("area"), shapes.geom_area("geom").alias("own"))
    touched = sizes.filter("_rest < _own - 1e-6").select(key, *fid, F.col("_own").alias("own"))
    parts = polygons(rest.join(touched.drop("own"), [key, *fid], "left_semi"), [key, *fid], step)
    return whole.unionByName(parts.join(touched, [key, *fid]))
