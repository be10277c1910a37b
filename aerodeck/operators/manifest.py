"""Roll-ups per airport: counts, sources, messages, boxes, reference points, manifests, index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import empty_reason
from ..functions.geo import hypot


def feature_counts(features: DataFrame) -> DataFrame:
    """Counts per airport and layer with airport totals and the grand total (``*``)."""
    return features.rollup("icao", "layer").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("icao", F.lit("*")).alias("icao"), F.coalesce("layer", F.lit("*")).alias("layer"), "n")


def layer_sources(features: DataFrame) -> DataFrame:
    return features.groupBy("icao", "layer").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def message_lists(rows: DataFrame) -> DataFrame:
    """Messages of an airport in order. ``rows``: icao, seq, message."""
    lists = rows.groupBy("icao").agg(F.array_sort(F.collect_list(F.struct("seq", "message"))).alias("m"))
    return lists.select("icao", F.transform("m", lambda s: s.message).alias("messages"))


def airport_bbox(headers: DataFrame, *positions: DataFrame) -> DataFrame:
    """Box over positions (icao, lon, lat); the header position only where there is nothing else."""
    pos = reduce(lambda a, b: a.unionByName(b), [p.select("icao", "lon", "lat") for p in positions])
    b = pos.groupBy("icao").agg(F.min("lon").alias("_w"), F.min("lat").alias("_s"), F.max("lon").alias("_e"), F.max("lat").alias("_n"))
    j = headers.join(b, "icao", "left")
    return j.select("icao", "lat", "lon", F.coalesce("_w", "lon").alias("west"), F.coalesce("_s", "lat").alias("south"), F.coalesce("_e", "lon").alias("east"), F.coalesce("_n", "lat").alias("north"), F.col("_w").isNotNull().alias("mapped"))


def query_box(boxes: DataFrame, radius_km: float = 3.0) -> DataFrame:
    """Box plus about 500 m; a radius box where nothing is mapped."""
    dlat = F.when(F.col("mapped"), 0.0045).otherwise(radius_km / 111.195)
    dlon = dlat / F.greatest(F.cos(F.radians("lat")), F.lit(0.2))
    pick = lambda a, b: F.when(F.col("mapped"), F.col(a)).otherwise(F.col(b))
    return boxes.select("icao", (pick("west", "lon") - dlon).alias("west"), (pick("south", "lat") - dlat).alias("south"), (pick("east", "lon") + dlon).alias("east"), (pick("north", "lat") + dlat).alias("north"))


def reference_point(headers: DataFrame, runways: DataFrame, boxes: DataFrame | None) -> DataFrame:
    """Published point, else the middle of the longest runway (in degrees), else the box centre."""
    mid = F.struct(((F.col("alat") + F.col("blat")) / 2).alias("lat"), ((F.col("alon") + F.col("blon")) / 2).alias("lon"))
    size = hypot(F.col("alon") - F.col("blon"), F.col("alat") - F.col("blat"))
    r = runways.groupBy("icao").agg(F.min_by(mid, F.struct((-F.round(size, 9)).alias("s"), "rid")).alias("_r"))
    j = headers.join(r, "icao", "left")
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    lat, lon = F.when(known, F.col("lat")).otherwise(F.col("_r.lat")), F.when(known, F.col("lon")).otherwise(F.col("_r.lon"))
    basis = F.when(known, "published").when(F.col("_r").isNotNull(), "runway").otherwise("box")
    if boxes is not None:
        j = j.join(boxes.select("icao", ((F.col("south") + F.col("north")) / 2).alias("_blat"), ((F.col("west") + F.col("east")) / 2).alias("_blon")), "icao", "left")
        lat, lon = F.coalesce(lat, "_blat"), F.coalesce(lon, "_blon")
    return j.select("icao", lat.alias("lat"), lon.alias("lon"), basis.alias("basis"))


def manifest(features: DataFrame, headers: DataFrame, messages: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per airport: per-layer count, sources and empty reason, warnings, totals.

    Counting is map-side combined; the per-airport map has one entry per layer, at most 45.
    """
    per = features.groupBy("icao", "layer").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set("source")).alias("sources"))
    src = per.groupBy("icao").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    # Every airport has every layer: the fixed 45 names become an array on the header row.
    names = registry.select(F.array_sort(F.collect_list("layer"))).scalar()
    full = headers.join(src, "icao", "left").withColumn("layer", F.explode(names)).withColumnRenamed("sources", "_all")
    j = full.join(per, ["icao", "layer"], "left")
    has = lambda s: F.coalesce(F.array_contains("_all", s), F.lit(False))
    reason = F.when(F.col("count").isNull(), empty_reason("layer", has("xplane"), has("osm")))
    entry = F.struct("layer", F.struct(F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), reason.alias("empty_reason")))
    keep = [n for n in headers.columns if n != "icao"]
    m = j.groupBy("icao").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("layers"), F.sum(F.coalesce("count", F.lit(0))).alias("total_features"), F.first("_all").alias("sources"), *[F.first(n).alias(n) for n in keep])
    return m.join(messages.withColumnRenamed("messages", "warnings"), "icao", "left")


def upsert_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same airport; sorted by code."""
    return old.join(new.select("icao"), "icao", "left_anti").unionByName(new).orderBy("icao")
