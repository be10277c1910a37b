"""Runway markings: dimension tables and marking rows per runway end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.geo import c, clamp, unit

# Fixed values: (below, value) steps of the marking dimension tables; the last is open-ended.
STRIPES = [(20, 4), (26, 6), (40, 8), (55, 12), (None, 16)]
AIMING = [(800, (150.0, 30.0, 4.0)), (1200, (250.0, 30.0, 6.0)), (2400, (300.0, 45.0, 6.0)), (None, (400.0, 60.0, 10.0))]
TOUCHDOWN = [(900, 1), (1200, 2), (1500, 3), (2400, 4), (None, 6)]
TOUCHDOWN_BARS = {1: [1, 0, 0, 0, 0, 0], 2: [2, 1, 0, 0, 0, 0], 3: [3, 2, 1, 0, 0, 0], 4: [3, 2, 2, 1, 0, 0], 6: [3, 3, 2, 2, 1, 1]}
THRESHOLD, DESIGNATION, CENTERLINE, AIMING_POINT, TOUCHDOWN_ZONE, SIDE_STRIPE, ARROW, CHEVRON = range(1, 9)


def _steps(v, table) -> Column:
    out = None
    for below, value in table:
        if below is None:
            return out.otherwise(F.lit(value))
        out = F.when(c(v) < below, value) if out is None else out.when(c(v) < below, value)


def stripe_count(width) -> Column:
    return _steps(width, STRIPES)


def aiming_point(lda) -> tuple[Column, Column, Column]:
    """Distance from the threshold, stripe length, stripe width."""
    return tuple(_steps(lda, [(b, v[i]) for b, v in AIMING]) for i in range(3))


def touchdown_pairs(lda) -> Column:
    return _steps(lda, TOUCHDOWN)


def _each(n: Column) -> Column:
    """0..n-1, empty when n is not positive."""
    n = n.cast("int")
    return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))


def marking_rows(ends: DataFrame) -> DataFrame:
    """One row per painted shape of every marked runway end.

    ``ends``: icao, idrwy, idthr, marking, width, tx, ty (threshold), hdg (landing
    direction), lda, displaced, blastpad. Shapes are counted, exploded and placed by column
    arithmetic; nothing is grouped or shuffled.
    """
    e = ends.filter(c("marking") > 1).withColumn("half", c("lda") / 2)
    instrument, precision = c("marking") >= 3, c("marking") >= 4
    start = F.when(instrument, 48.0).otherwise(12.0)
    inner = F.when(c("width") >= 45, 22.5).otherwise(18.0)
    keys = ["icao", "rid", "idrwy", "idthr", "marking"]
    out = []

    def add(df, kind, along, length, lateral, width, text=None):
        ring = shapes.axis_rect("tx", "ty", "hdg", along, length, lateral, width)
        out.append(df.select(*keys, F.lit(kind).alias("marktype"), (c(text) if text else F.lit(None).cast("string")).alias("text"),
                             F.array(ring).alias("geom")))

    usable = c("width") - 6
    n = stripe_count("width")
    s = e.filter(instrument).withColumn("i", _each(n))
    add(s, THRESHOLD, 6.0, 30.0, -usable / 2 + usable / n * (c("i") + 0.5), 1.8)
    add(e, DESIGNATION, start, 9.0, 0.0, clamp(c("width") * 0.5, 6.0, 14.0), "idthr")
    first = start + 21
    s = e.withColumn("i", _each(F.floor((c("half") - 30 - first) / 50) + 1))
    add(s, CENTERLINE, first + c("i") * 50, 30.0, 0.0, 0.9)
    at, length, wide = aiming_point("lda")
    sided = F.explode(F.array(F.lit(-1.0), F.lit(1.0)))
    s = e.filter(instrument & (at + length < c("half"))).withColumn("s", sided)
    add(s, AIMING_POINT, at, length, c("s") * (inner / 2 + wide / 2), wide)
    bars = F.element_at(F.create_map(*[F.lit(v) if isinstance(v, int) else F.array(*[F.lit(b) for b in v])
                                       for kv in TOUCHDOWN_BARS.items() for v in kv]), touchdown_pairs("lda"))
    s = e.filter(precision).select("*", F.posexplode(bars).alias("i", "n")).withColumn("d", 150.0 * (c("i") + 1))
    s = s.filter((c("n") > 0) & (F.abs(c("d") - at) >= 1.0) & (c("d") + 22.5 <= c("half"))).withColumn("j", _each(c("n")))
    s = s.withColumn("s", sided)
    add(s, TOUCHDOWN_ZONE, "d", 22.5, c("s") * (inner / 2 + 0.9 + c("j") * 1.5), 1.8)
    s = e.filter(precision).withColumn("s", sided)
    add(s, SIDE_STRIPE, 0.0, c("half"), c("s") * (c("width") / 2 - 0.45), 0.9)
    # Arrows every 30 m from 15 m past the runway end while more than 10 m before the threshold.
    s = e.filter(c("displaced") > 30).withColumn("i", _each(F.ceil((c("displaced") - 25) / 30)))
    add(s, ARROW, -c("displaced") + 15 + c("i") * 30, 20.0, 0.0, 0.9)
    # Chevron arms: from a point on the axis back 15 m to the pavement edge, on both sides.
    s = e.filter(c("blastpad") > 20).withColumn("i", _each(F.ceil((c("blastpad") - 25) / 30))).withColumn("s", sided)
    ux, uy = unit("hdg")
    d = -c("displaced") - 10 - c("i") * 30
    side = c("s") * (c("width") / 2 - 1)
    ax, ay = c("tx") + ux * d, c("ty") + uy * d
    bx, by = c("tx") + ux * (d - 15) + uy * side, c("ty") + uy * (d - 15) - ux * side
    out.append(s.select(*keys, F.lit(CHEVRON).alias("marktype"), F.lit(None).cast("string").alias("text"),
                        F.array(shapes.rect_between(ax, ay, bx, by, 0.9)).alias("geom")))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows
