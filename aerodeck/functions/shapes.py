"""Geometry columns: points, rings and feature geometries as arrays of structs.

A feature geometry is ``array<array<struct<x,y>>>``: one inner array for a point or a
line, outer ring first and then holes for a surface. Rings are closed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import c, dist, heading, unit

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
GEOM = f"array<{RING}>"


def pt(x, y) -> Column:
    return F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))


def point_geom(x, y) -> Column:
    return F.array(F.array(pt(x, y)))


def line_geom(*xy) -> Column:
    return F.array(F.array(*[pt(x, y) for x, y in xy]))


def rect_along(x, y, h, length, width) -> Column:
    """Closed counter-clockwise ring from (x, y) along heading ``h``, centred on the axis."""
    ux, uy = unit(h)
    rx, ry = uy * c(width) / 2, -ux * c(width) / 2
    ex, ey = c(x) + ux * c(length), c(y) + uy * c(length)
    first = pt(c(x) - rx, c(y) - ry)
    return F.array(first, pt(c(x) + rx, c(y) + ry), pt(ex + rx, ey + ry), pt(ex - rx, ey - ry), first)


def rect_between(ax, ay, bx, by, width) -> Column:
    return rect_along(ax, ay, heading(ax, ay, bx, by), dist(ax, ay, bx, by), width)


def rect_centered(x, y, h, length, width) -> Column:
    ux, uy = unit(h)
    return rect_along(c(x) - ux * c(length) / 2, c(y) - uy * c(length) / 2, h, length, width)


def axis_rect(x, y, h, along, length, lateral, width) -> Column:
    """Rectangle in runway axes: ``along`` metres past (x, y), ``lateral`` metres right."""
    ux, uy = unit(h)
    return rect_along(c(x) + ux * c(along) + uy * c(lateral), c(y) + uy * c(along) - ux * c(lateral), h, length, width)


def circle(x, y, r, n: int = 32) -> Column:
    n = max(n, 8)
    step = 2 * 3.141592653589793 / n
    return F.transform(F.sequence(F.lit(0), F.lit(n)),
                       lambda i: pt(c(x) + c(r) * F.cos((i % n) * step), c(y) + c(r) * F.sin((i % n) * step)))


def once(value, then) -> Column:
    """``then(value)``, with ``value`` worked out once a row however often ``then`` names it."""
    return F.transform(F.array(c(value)), then)[0]


def _pair_sum(ring: Column, term) -> Column:
    """Sum of ``term(p, q)`` over consecutive vertices of a ring or line."""
    def total(r):
        n = F.size(r)
        pairs = F.zip_with(F.slice(r, 1, F.greatest(n - 1, F.lit(0))), F.slice(r, 2, F.greatest(n - 1, F.lit(0))), term)
        return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)

    return once(ring, total)


def signed_area(ring) -> Column:
    return _pair_sum(c(ring), lambda p, q: (p.x * q.y - q.x * p.y) / 2)


def ring_area(ring) -> Column:
    return F.abs(signed_area(ring))


def geom_area(geom) -> Column:
    """Outer ring area minus the areas of the holes."""
    g = c(geom)
    return 2 * ring_area(g[0]) - F.aggregate(g, F.lit(0.0), lambda a, r: a + ring_area(r))


def line_length(line) -> Column:
    return _pair_sum(c(line), lambda p, q: F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)))


def ring_centroid(ring) -> Column:
    """Area centroid of a closed ring; its first vertex when the area vanishes."""
    def centroid(ro):
        r, o = ro.r, ro.o
        a = _pair_sum(r, lambda p, q: (p.x - o.x) * (q.y - o.y) - (q.x - o.x) * (p.y - o.y))
        sx = _pair_sum(r, lambda p, q: (p.x + q.x - 2 * o.x) * ((p.x - o.x) * (q.y - o.y) - (q.x - o.x) * (p.y - o.y)))
        sy = _pair_sum(r, lambda p, q: (p.y + q.y - 2 * o.y) * ((p.x - o.x) * (q.y - o.y) - (q.x - o.x) * (p.y - o.y)))
        return once(F.struct(a.alias("a"), sx.alias("sx"), sy.alias("sy")), lambda s: F.when(F.abs(s.a) < 1e-12, o).otherwise(
            pt(o.x + s.sx / (3 * s.a), o.y + s.sy / (3 * s.a))))

    return once(ring, lambda r: once(F.struct(r.alias("r"), r[0].alias("o")), centroid))


def oriented(ring, ccw: bool = True) -> Column:
    r = c(ring)
    wrong = signed_area(r) < 0 if ccw else signed_area(r) > 0
    return F.when(wrong, F.reverse(r)).otherwise(r)


def orient_geom(geom) -> Column:
    """Outer ring counter-clockwise, holes clockwise."""
    return F.transform(c(geom), lambda r, i: F.when(i == 0, oriented(r, True)).otherwise(oriented(r, False)))


def bounds(geom) -> dict[str, Column]:
    pts = F.flatten(c(geom))
    xs, ys = F.transform(pts, lambda p: p.x), F.transform(pts, lambda p: p.y)
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def clip_half_plane(ring, a, b, k, keep_inside: bool = True) -> Column:
    """Part of an open ring where ``a*x + b*y + k >= 0`` (or ``<= 0``); open ring out."""
    r = c(ring)
    sign = 1.0 if keep_inside else -1.0
    n = F.size(r)

    def side(p):
        return (a * p.x + b * p.y + k) * sign

    def step(p, q):
        sp, sq = side(p), side(q)
        t = sp / (sp - sq)
        cut = pt(p.x + t * (q.x - p.x), p.y + t * (q.y - p.y))
        none = F.array().cast(RING)
        return (F.when((sp >= 0) & (sq >= 0), F.array(q))
                .when((sp >= 0) & (sq < 0), F.when(sp > 0, F.array(cut)).otherwise(none))
                .when((sp < 0) & (sq >= 0), F.when(sq > 0, F.array(cut, q)).otherwise(F.array(q)))
                .otherwise(none))

    nxt = F.concat(F.slice(r, 2, F.greatest(n - 1, F.lit(0))), F.slice(r, 1, F.least(n, F.lit(1))))
    return F.flatten(F.zip_with(r, nxt, step))


def open_ring(ring) -> Column:
    r = c(ring)
    return F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))


def close(ring) -> Column:
    r = c(ring)
    return F.when(F.size(r) >= 3, F.concat(r, F.slice(r, 1, 1))).otherwise(F.array().cast(RING))


def half_planes(ring) -> Column:
    """Inward half planes of a closed counter-clockwise convex ring."""
    r = c(ring)
    n = F.size(r)
    return F.zip_with(F.slice(r, 1, n - 1), F.slice(r, 2, n - 1), lambda p, q: F.struct(
        (p.y - q.y).alias("a"), (q.x - p.x).alias("b"), (p.x * q.y - q.x * p.y).alias("k")))


def apart(ring, convex) -> Column:
    """True if a side of a closed counter-clockwise convex ring has the whole ring beyond it: they share no area."""
    return F.exists(half_planes(convex), lambda h: F.forall(c(ring), lambda p: h.a * p.x + h.b * p.y + h.k <= 0))


def clip_convex(ring, convex) -> Column:
    """Intersection of a closed ring with a closed counter-clockwise convex ring (closed ring out)."""
    return close(F.aggregate(half_planes(convex), open_ring(ring),
                             lambda acc, h: clip_half_plane(acc, h.a, h.b, h.k)))


def subtract_convex(ring, convex) -> Column:
    """Pieces of a closed ring outside a closed counter-clockwise convex ring.

    Piece i lies inside planes 1..i-1 and outside plane i, so the pieces are disjoint and
    their areas add up exactly.
    """
    start = F.struct(open_ring(ring).alias("rest"), F.array().cast(GEOM).alias("out"))

    def step(acc, h):
        outside = clip_half_plane(acc.rest, h.a, h.b, h.k, keep_inside=False)
        out = F.when(F.size(outside) >= 3, F.array_append(acc.out, close(outside))).otherwise(acc.out)
        return F.struct(clip_half_plane(acc.rest, h.a, h.b, h.k).alias("rest"), out.alias("out"))

    return F.aggregate(half_planes(convex), start, step, lambda acc: acc.out)


def subtract_all(ring, convexes, min_area: float = 0.5) -> Column:
    """Pieces of a closed ring outside every convex ring of an array."""
    return F.aggregate(c(convexes), F.array(c(ring)), lambda pieces, cut: F.filter(
        F.flatten(F.transform(pieces, lambda p: subtract_convex(p, cut))), lambda p: ring_area(p) >= min_area))
