"""Lookups over built layers: layer subsets, projections, derived members, airport facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shapes, text
from ..functions.geo import c, inverse, rnd, snap

# Fixed value: a client spelling of one layer accepted on input.
LAYER_ALIASES = {"touchdownliftofarea": "touchdownliftoffarea"}


def layer_name(name: str) -> str:
    n = name.strip().lower()
    return LAYER_ALIASES.get(n, n)


def pick_layers(registry: DataFrame, profile: str = "full", include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Layers of a profile, narrowed by include and exclude lists."""
    r = registry.filter("in_map") if profile == "map" else registry
    if include:
        r = r.filter(F.col("layer").isin([layer_name(n) for n in include]))
    if exclude:
        r = r.filter(~F.col("layer").isin([layer_name(n) for n in exclude]))
    return r


def layers(features: DataFrame, frames: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, projection: str = "wgs84",
           precision: float | None = None) -> DataFrame:
    """Chosen layers of chosen airports in the response projection, snapped to ``precision``.

    Layer names become a plain ``isin`` on the partition column, so unread layers cost
    nothing. ``frames``: icao, lat0, lon0.
    """
    f = features
    if include:
        f = f.filter(F.col("layer").isin([layer_name(n) for n in include]))
    if exclude:
        f = f.filter(~F.col("layer").isin([layer_name(n) for n in exclude]))
    f = f.join(frames.select("icao", "lat0", "lon0"), "icao")

    def place(p):
        x, y = inverse(p.x, p.y, F.col("lon0"), F.col("lat0")) if projection == "wgs84" else (p.x, p.y)
        return shapes.pt(snap(x, precision), snap(y, precision)) if precision else shapes.pt(x, y)

    return f.withColumn("geom", F.transform("geom", lambda r: F.transform(r, place))).drop("lat0", "lon0")


def derived_members(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Centroid of surfaces; midpoint and longest segment of curves, in the response projection."""
    g = F.col("geom")
    line = g[0]
    n = F.size(line)
    segs = F.when(n >= 2, F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), lambda p, q: F.struct(
        p.x.alias("x"), p.y.alias("y"), (q.x - p.x).alias("dx"), (q.y - p.y).alias("dy"), F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)).alias("len"))))
    start = F.struct(F.lit(0.0).alias("acc"), F.lit(None).cast(shapes.POINT).alias("mid"))

    def walk(half):
        def step(a, s):
            t = (half - a.acc) / s.len
            here = shapes.pt(s.x + t * s.dx, s.y + t * s.dy)
            return F.struct((a.acc + s.len).alias("acc"), F.coalesce(a.mid, F.when((a.acc + s.len >= half) & (s.len > 0), here)).alias("mid"))
        return step

    df = df.withColumn("_s", segs).withColumn("_half", shapes.line_length(line) / 2)
    curve, surface = c(kind) == "curve", c(kind) == "surface"
    mid = F.aggregate("_s", start, walk(F.col("_half"))).mid
    return df.select(*[n for n in df.columns if n not in ("_s", "_half")], F.when(surface, shapes.ring_centroid(line)).alias("centroid"), F.when(curve, mid).alias("midpoint"),
                     F.when(curve, rnd(F.array_max(F.transform("_s", lambda s: s.len)), 2)).alias("longest_segment"))


def cycle(days: DataFrame, day: str) -> DataFrame:
    """Cycle start, end and number for each date."""
    s = text.cycle_start(day, text.CALENDAR_EPOCH)
    return days.withColumn("cycle_start", s).withColumn("cycle_end", F.date_add("cycle_start", 28)).withColumn("cycle", text.cycle_number("cycle_start"))


def airport_info(index: DataFrame, runways: DataFrame) -> DataFrame:
    """Names, position and the open runways with lengths, longest first."""
    r = runways.filter("NOT closed").select("icao", F.struct((-F.col("length_ft")).alias("o"), "rid", F.concat(F.col("rid").cast("string"), F.lit(": "), F.col("length_ft").cast("string"), F.lit(" ft")).alias("t")).alias("s"))
    lists = r.groupBy("icao").agg(F.array_sort(F.collect_list("s")).alias("l"))
    return index.join(lists, "icao", "left").withColumn("runways", F.array_join(F.transform("l", lambda s: s.t), "; ")).drop("l")
