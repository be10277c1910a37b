"""Column expressions for projection, headings, distances and rounding.

Everything here is ``Column -> Column`` built from JVM functions, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius in metres and kilometres, feet to metres, km per NM.
EARTH_M = 6371008.8
EARTH_KM = 6371.0088
FT_M = 0.3048
NM_KM = 1.852


def c(v) -> Column:
    """A column from a name, a Column or a literal number."""
    if isinstance(v, str):
        return F.col(v)
    return v if isinstance(v, Column) else F.lit(v)


def rnd(v, digits: int = 1) -> Column:
    """Round half away from zero to ``digits`` decimals; never negative zero."""
    k = 10 ** digits
    return F.round(c(v) * k) / k + F.lit(0.0)


def clamp(v, lo, hi) -> Column:
    """Null stays null (``greatest`` alone would skip it)."""
    return F.when(c(v).isNotNull(), F.least(F.greatest(c(v), c(lo)), c(hi)))


def hypot(dx, dy) -> Column:
    dx, dy = c(dx), c(dy)
    return F.sqrt(dx * dx + dy * dy)


def dist(ax, ay, bx, by) -> Column:
    return hypot(c(bx) - c(ax), c(by) - c(ay))


def forward(lon, lat, lon0, lat0) -> tuple[Column, Column]:
    """Azimuthal equidistant metres of (lon, lat) round (lon0, lat0)."""
    phi, phi0 = F.radians(c(lat)), F.radians(c(lat0))
    dl = F.radians(c(lon) - c(lon0))
    cos_c = clamp(F.sin(phi0) * F.sin(phi) + F.cos(phi0) * F.cos(phi) * F.cos(dl), -1.0, 1.0)
    arc = F.acos(cos_c)
    k = F.when(arc < 1e-12, F.lit(1.0)).otherwise(arc / F.sin(arc)) * EARTH_M
    x = k * F.cos(phi) * F.sin(dl)
    y = k * (F.cos(phi0) * F.sin(phi) - F.sin(phi0) * F.cos(phi) * F.cos(dl))
    return x, y


def inverse(x, y, lon0, lat0) -> tuple[Column, Column]:
    """(lon, lat) degrees of local metres; the origin itself below a nanometre."""
    x, y, phi0 = c(x), c(y), F.radians(c(lat0))
    rho = hypot(x, y)
    arc = rho / EARTH_M
    lat = F.degrees(F.asin(clamp(F.cos(arc) * F.sin(phi0) + y * F.sin(arc) * F.cos(phi0) / rho, -1.0, 1.0)))
    lon = c(lon0) + F.degrees(
        F.atan2(x * F.sin(arc), rho * F.cos(phi0) * F.cos(arc) - y * F.sin(phi0) * F.sin(arc)))
    at_origin = rho < 1e-9
    return F.when(at_origin, c(lon0)).otherwise(lon), F.when(at_origin, c(lat0)).otherwise(lat)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    sp = F.sin((p2 - p1) / 2)
    sl = F.sin(F.radians(c(lon2) - c(lon1)) / 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), sp * sp + F.cos(p1) * F.cos(p2) * sl * sl)))


def snap(v, step) -> Column:
    """Snap to a grid step; a null or non-positive step leaves the value alone."""
    v, step = c(v), c(step)
    return F.when(step > 0, F.round(v / step) * step + F.lit(0.0)).otherwise(v)


def heading(ax, ay, bx, by) -> Column:
    """Degrees clockwise from north of a -> b, in [0, 360)."""
    return (F.degrees(F.atan2(c(bx) - c(ax), c(by) - c(ay))) + 360) % 360


def reverse_heading(h) -> Column:
    return (c(h) + 180) % 360


def unit(h) -> tuple[Column, Column]:
    r = F.radians(c(h))
    return F.sin(r), F.cos(r)


def right_of(ux, uy) -> tuple[Column, Column]:
    return c(uy), -c(ux)


def fold_angle(a, b) -> Column:
    """Undirected difference of two directions, 0..90 degrees."""
    d = F.abs(c(a) - c(b)) % 180
    return F.least(d, 180 - d)


def seg_param(px, py, ax, ay, bx, by) -> Column:
    """Clamped position (0..1) of the foot of (px, py) on segment a-b."""
    dx, dy = c(bx) - c(ax), c(by) - c(ay)
    l2 = dx * dx + dy * dy
    return F.when(l2 < 1e-12, F.lit(0.0)).otherwise(
        clamp(((c(px) - c(ax)) * dx + (c(py) - c(ay)) * dy) / l2, 0.0, 1.0))


def seg_dist(px, py, ax, ay, bx, by) -> Column:
    """Distance from a point to a segment."""
    t = seg_param(px, py, ax, ay, bx, by)
    return dist(px, py, c(ax) + t * (c(bx) - c(ax)), c(ay) + t * (c(by) - c(ay)))


def _cross(ax, ay, bx, by, px, py) -> Column:
    return (c(bx) - c(ax)) * (c(py) - c(ay)) - (c(by) - c(ay)) * (c(px) - c(ax))


def seg_cross(ax, ay, bx, by, cx, cy, dx, dy) -> tuple[Column, Column, Column]:
    """Single crossing point of two segments: (hit, x, y); parallel pairs give no hit."""
    den = (c(bx) - c(ax)) * (c(dy) - c(cy)) - (c(by) - c(ay)) * (c(dx) - c(cx))
    safe = F.when(F.abs(den) < 1e-12, F.lit(None)).otherwise(den)
    t = ((c(cx) - c(ax)) * (c(dy) - c(cy)) - (c(cy) - c(ay)) * (c(dx) - c(cx))) / safe
    u = ((c(cx) - c(ax)) * (c(by) - c(ay)) - (c(cy) - c(ay)) * (c(bx) - c(ax))) / safe
    hit = F.coalesce((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.lit(False))
    return hit, c(ax) + t * (c(bx) - c(ax)), c(ay) + t * (c(by) - c(ay))


def seg_seg_dist(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Smallest distance between two segments (0 where they cross)."""
    hit, _, _ = seg_cross(ax, ay, bx, by, cx, cy, dx, dy)
    return F.when(hit, F.lit(0.0)).otherwise(F.least(
        seg_dist(ax, ay, cx, cy, dx, dy), seg_dist(bx, by, cx, cy, dx, dy),
        seg_dist(cx, cy, ax, ay, bx, by), seg_dist(dx, dy, ax, ay, bx, by)))


def metres_per_degree(lon0, lat0, step: float = 0.01) -> tuple[Column, Column]:
    """Metres per degree of longitude and latitude at a reference point."""
    x, _ = forward(c(lon0) + step, lat0, lon0, lat0)
    _, y = forward(lon0, c(lat0) + step, lon0, lat0)
    return x / step, y / step


def bezier(p0, h0, h1, p1, t) -> Column:
    """Cubic Bezier coordinate at ``t``."""
    p0, h0, h1, p1, t = c(p0), c(h0), c(h1), c(p1), c(t)
    m = 1 - t
    return m * m * m * p0 + 3 * m * m * t * h0 + 3 * m * t * t * h1 + t * t * t * p1


def bezier_steps(chord) -> Column:
    """About one vertex per two metres of chord, between 4 and 48."""
    return clamp(F.ceil(c(chord) / 2), 4, 48).cast("int")
