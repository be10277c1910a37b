"""Merging sources per airport: unions, first source wins, gap filling, fallbacks, overrides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import FT_M
from ..functions.text import pad_registry
from .ordered import rank, scan
from .spatial import as_segments, nearest

HEADER_FIELDS = ["iata", "faa", "name", "city", "country", "region", "lat", "lon", "elev_ft", "trans_alt_ft", "trans_level", "mag_var"]


def union_sources(*sources: DataFrame) -> DataFrame:
    """Append collections; columns a source lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def merge_headers(*headers: DataFrame, fields: list[str]) -> DataFrame:
    """Field by field, the first source (in argument order) with a value wins."""
    rows = union_sources(*[h.withColumn("_src", F.lit(i)) for i, h in enumerate(headers)])
    return rows.groupBy("icao").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_src"))).alias(f) for f in fields])


def merge_index(first: DataFrame, later: DataFrame, fill: list[str], keep: list[str]) -> DataFrame:
    """Index of two sources: ``keep`` comes from the first that lists the airport, ``fill`` also from the later."""
    a = first.select("icao", *[F.col(f).alias(f"a_{f}") for f in [*keep, *fill]], F.lit(True).alias("_a"))
    b = later.select("icao", *[F.col(f).alias(f"b_{f}") for f in [*keep, *fill]])
    j = a.join(b, "icao", "full")
    return j.select("icao", *[F.when(F.col("_a"), F.col(f"a_{f}")).otherwise(F.col(f"b_{f}")).alias(f) for f in keep],
                    *[F.coalesce(f"a_{f}", f"b_{f}").alias(f) for f in fill])


def first_source(*sources: DataFrame) -> DataFrame:
    """Rows of the best-ranked source that has the airport (rank = argument order)."""
    rows = union_sources(*[s.withColumn("src_rank", F.lit(i)) for i, s in enumerate(sources)])
    best = rows.groupBy("icao").agg(F.min("src_rank").alias("src_rank"))
    return rows.join(best, ["icao", "src_rank"])


def fallback(main: DataFrame, other: DataFrame) -> DataFrame:
    """``other`` only for airports that ``main`` has nothing for."""
    return union_sources(main, other.join(main.select("icao").distinct(), "icao", "left_anti"))


def apply_overrides(features: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace or extend layers. Override rows get ``:ov<n>`` ids after the generated ones.

    Both sides: icao, layer, fid, id, source; overrides also ``replace``.
    """
    replaced = overrides.filter("replace").select("icao", "layer").distinct()
    kept = features.join(replaced, ["icao", "layer"], "left_anti")
    base = kept.groupBy("icao", "layer").agg(F.count(F.lit(1)).alias("_base"))
    ov = scan(overrides.drop("replace"), ["icao", "layer"], ["fid"], _rn=rank()).join(base, ["icao", "layer"], "left")
    number = (F.coalesce("_base", F.lit(0)) + F.col("_rn")).cast("string")
    new_id = F.coalesce("id", F.concat("icao", F.lit(":"), "layer", F.lit(":ov"), number))
    ov = ov.withColumn("id", new_id).withColumn("source", F.lit("override")).drop("_base", "_rn")
    return union_sources(kept, ov)


def registry_ends(base: DataFrame, ends: DataFrame) -> DataFrame:
    """Registry rows per runway end in metres, keyed by airport code and padded designator."""
    e = base.select("SITE_NO", F.upper("ICAO_ID").alias("icao")).filter(F.col("icao") != "").join(ends, "SITE_NO")

    def m(name):
        return F.col(name).try_cast("double") * FT_M

    tora, asda = m("TKOF_RUN_AVBL"), m("ACLT_STOP_DIST_AVBL")
    return e.select("icao", pad_registry("RWY_END_ID").alias("end_key"), tora.alias("tora_m"), m("TKOF_DIST_AVBL").alias("toda_m"),
                    asda.alias("asda_m"), m("LNDG_DIST_AVBL").alias("lda_m"), F.when(asda > tora + 1.0, asda - tora).alias("stopway_m"),
                    F.col("TDZ_ELEV").try_cast("double").alias("tdze_ft"), m("LAHSO_ALD").alias("lahso_m"),
                    F.coalesce(pad_registry("RWY_END_INTERSECT_LAHSO"), F.col("LAHSO_DESC")).alias("crossing"))


def enrich_ends(ends: DataFrame, registry: DataFrame) -> DataFrame:
    """Published distances overwrite the matched ends; a stopway only where there is one."""
    r = registry.select("icao", "end_key", *[F.col(n).alias(f"_{n}") for n in ("tora_m", "toda_m", "asda_m", "lda_m", "stopway_m", "tdze_ft")], F.lit(True).alias("_hit"))
    j = ends.withColumn("end_key", pad_registry("ident")).join(r, ["icao", "end_key"], "left")
    for n in ("tora_m", "toda_m", "asda_m", "lda_m", "tdze_ft"):
        j = j.withColumn(n, F.when(F.col("_hit"), F.col(f"_{n}")).otherwise(F.col(n)))
    j = j.withColumn("stopway_m", F.coalesce("_stopway_m", "stopway_m"))
    return j.select(*ends.columns)


def merge_stands(stands: DataFrame) -> DataFrame:
    """Scenery stands enriched by the tagged stand within 25 m; other tagged stands kept if named.

    A tagged stand enriches the nearest scenery stand; several fill in nearest-first order.
    """
    scenery, tagged = stands.filter("source = 'xplane'"), stands.filter("source <> 'xplane'")
    targets = as_segments(scenery)
    matched = nearest(tagged, targets.withColumnRenamed("sid", "target"), 25.0, ["target"], ["target"], strict=True)
    fills = matched.filter(F.col("target").isNotNull()).groupBy("icao", "target").agg(
        *[F.min_by(f, F.when(F.col(f).isNotNull(), F.struct("dist", "sid"))).alias(f"_{f}") for f in ("jetway", "outline")])
    enriched = scenery.join(fills.withColumnRenamed("target", "sid"), ["icao", "sid"], "left")
    enriched = enriched.withColumn("jetway", F.coalesce("jetway", "_jetway")).withColumn("outline", F.coalesce("outline", "_outline"))
    has_scenery = scenery.select("icao", F.lit(True).alias("_hs")).distinct()
    extra = matched.filter(F.col("target").isNull()).join(has_scenery, "icao", "left")
    extra = extra.filter(F.col("_hs").isNull() | (F.coalesce(F.trim("name"), F.lit("")) != ""))
    return enriched.select(*stands.columns).unionByName(extra.select(*stands.columns))


def unique_names(df: DataFrame, order: list[str], prefix: str = "STAND ", name: str = "name") -> DataFrame:
    """Unnamed rows become ``STAND n``; a repeated name gets `` (2)``, `` (3)`` and so on."""
    given = F.trim(F.coalesce(name, F.lit("")))
    df = df.withColumn("_blank", given == "")
    df = scan(df, ["icao", "_blank"], order, _n=rank())
    df = df.withColumn(name, F.when(F.col("_blank"), F.concat(F.lit(prefix), F.col("_n").cast("string"))).otherwise(given))
    df = scan(df.drop("_blank", "_n"), ["icao", name], order, _k=rank())
    return df.withColumn(name, F.when(F.col("_k") > 1, F.concat(name, F.lit(" ("), F.col("_k").cast("string"), F.lit(")"))).otherwise(F.col(name))).drop("_k")


def assign_ids(features: DataFrame) -> DataFrame:
    """``<ICAO>:<layer>:<n>`` in spatial order; features that carry an id keep it.

    ``features``: icao, layer, fid, id, x, y (centroid), idlin.
    """
    df = features.withColumn("_kx", F.round(F.col("x") * 10)).withColumn("_ky", F.round(F.col("y") * 10)).withColumn("_kl", F.coalesce("idlin", F.lit("")))
    df = scan(df, ["icao", "layer"], ["_kx", "_ky", "_kl", "fid"], _rn=rank())
    new_id = F.concat_ws(":", "icao", "layer", F.col("_rn").cast("string"))
    return df.withColumn("id", F.coalesce("id", new_id)).drop("_kx", "_ky", "_kl", "_rn")


def drop_repeated_runways(runways: DataFrame, order: list[str], d: float = 50.0) -> DataFrame:
    """Of adjacent runways with one pair id, drop those starting within ``d`` of a kept one."""
    rest = [n for n in runways.columns if n not in ("icao", "idrwy", *order)]
    kind = ", ".join(f"`{n}`:{runways.schema[n].dataType.simpleString()}" for n in [*order, *rest])
    # The runways of one airport with one pair id: a handful.
    lists = runways.groupBy("icao", "idrwy").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("_l"))

    def step(kept, s):
        last = F.try_element_at(kept, F.lit(-1))
        far = F.sqrt(F.pow(s["ax"] - last["ax"], F.lit(2)) + F.pow(s["ay"] - last["ay"], F.lit(2))) >= d
        return F.when(F.coalesce(far, F.lit(True)), F.concat(kept, F.array(s))).otherwise(kept)

    kept = F.aggregate("_l", F.array().cast(f"array<struct<{kind}>>"), step)
    return lists.select("icao", "idrwy", F.explode(kept).alias("_s")).select("icao", "idrwy", "_s.*").select(*runways.columns)


