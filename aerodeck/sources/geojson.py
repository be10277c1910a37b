"""GeoJSON: feature collections in and out, mapping-service layers, overrides, built layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.geo import rnd

COLLECTION = "replace boolean, error string, features array<struct<id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def _position(a) -> Column:
    return shapes.pt(a[0], a[1])


def _rings(kind: Column, coords: Column) -> Column:
    """Geometry text to parts of rings: array (parts) of array (rings) of array of points."""
    p1 = F.from_json(coords, "array<double>")
    p2 = F.from_json(coords, "array<array<double>>")
    p3 = F.from_json(coords, "array<array<array<double>>>")
    p4 = F.from_json(coords, "array<array<array<array<double>>>>")
    ring = lambda r: F.transform(r, _position)
    return (F.when(kind == "Point", F.array(F.array(F.array(_position(p1))))).when(kind == "LineString", F.array(F.array(ring(p2))))
            .when(kind == "MultiPoint", F.transform(p2, lambda p: F.array(F.array(_position(p))))).when(kind == "Polygon", F.array(F.transform(p3, ring)))
            .when(kind == "MultiLineString", F.transform(p3, lambda ln: F.array(ring(ln)))).when(kind == "MultiPolygon", F.transform(p4, lambda poly: F.transform(poly, ring))))


def features(docs: DataFrame, value: str = "value") -> DataFrame:
    """Features of collection texts: doc columns, replace, fno, id, kind, parts, props.

    The id is lifted from the feature, else from its properties. A text that is an error
    body, or no collection at all, gives no rows.
    """
    keep = [n for n in docs.columns if n != value]
    j = docs.withColumn("_j", F.from_json(value, COLLECTION)).filter("_j.error IS NULL AND _j.features IS NOT NULL")
    f = j.select(*keep, F.coalesce("_j.replace", F.lit(False)).alias("replace"), F.posexplode("_j.features").alias("fno", "_f")).filter("_f.geometry IS NOT NULL")
    return f.select(*keep, "replace", "fno", F.coalesce(F.col("_f.properties")["id"], F.col("_f.id")).alias("id"), F.col("_f.geometry.type").alias("kind"), _rings(F.col("_f.geometry.type"), F.col("_f.geometry.coordinates")).alias("parts"), F.col("_f.properties").alias("props"))


def vertices(feats: DataFrame, keys: list[str]) -> DataFrame:
    """Long vertex table: keys, part, ring, seq, x, y."""
    p = feats.select(*keys, F.posexplode("parts").alias("part", "_r"))
    r = p.select(*keys, "part", F.posexplode("_r").alias("ring", "_v"))
    return r.select(*keys, "part", "ring", F.posexplode("_v").alias("seq", "_p")).select(*keys, "part", "ring", "seq", "_p.x", "_p.y")


def prop(name: str) -> Column:
    """Property as trimmed text, numbers included; blank counts as missing."""
    return F.nullif(F.trim(F.col("props")[name]), F.lit(""))


# Mapping-service layers and what they feed.
SERVICE_LAYERS = {"AM_Hotspot": "hotspot", "AM_Wind_Indicator": "windsock", "AM_Taxiway": "taxiway", "AM_Apron": "apron", "AM_Building": "building"}


def service_rows(feats: DataFrame) -> DataFrame:
    """Mapping-service features by target. ``feats``: features() of docs with icao, service.

    Output: icao, target, name, surface, reference, kind, parts.
    """
    from ..functions.text import lookup
    surface = F.coalesce(prop("SURFACE").try_cast("int"), F.lit(0))
    target = lookup(SERVICE_LAYERS, "service")
    name = F.when(target == "hotspot", F.concat(F.lit("HS"), prop("HOT_ID"))).when(target.isin("taxiway", "apron"), prop("DESIGNATOR"))
    ok = F.when(target == "windsock", F.col("kind") == "Point").otherwise(F.col("kind").isin("Polygon", "MultiPolygon"))
    return feats.filter(target.isNotNull() & ok).select("icao", target.alias("target"), name.alias("name"), F.when(target.isin("taxiway", "apron"), surface).alias("surface"), F.when(target == "hotspot", prop("CS_TEXT")).alias("reference"), F.lit("faa_amdb").alias("source"), "kind", "parts")


def override_files(docs: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Override collections by path ``<ICAO>/<layer>.geojson|.json``; unknown layers are reported.

    ``docs``: path, value.
    """
    p = docs.withColumn("icao", F.upper(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))).withColumn("layer", F.lower(F.regexp_extract("path", r"(?i)/([^/]+)\.(?:geo)?json$", 1))).filter("layer <> ''")
    # The registry is a fixed dimension of 45 rows.
    reg = F.broadcast(registry.select("layer"))
    known = features(p.join(reg, "layer", "left_semi"))
    unknown = p.join(reg, "layer", "left_anti").select("icao", "path", F.lit("unknown layer name").alias("warning"))
    return known, unknown


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as rows: path, value."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def geometry_json(kind: Column, geom: Column, digits: int) -> Column:
    """GeoJSON geometry text of a feature geometry, coordinates rounded."""
    xy = lambda p: F.array(rnd(p.x, digits), rnd(p.y, digits))
    ring = lambda r: F.transform(r, xy)
    make = lambda name, coords: F.to_json(F.struct(F.lit(name).alias("type"), coords.alias("coordinates")))
    return F.when(kind == "point", make("Point", xy(geom[0][0]))).when(kind == "curve", make("LineString", ring(geom[0]))).otherwise(make("Polygon", F.transform(geom, ring)))


def feature_collections(feats: DataFrame, props: list[str], registry: DataFrame, frames: DataFrame, projection: str = "local") -> DataFrame:
    """One collection text per (icao, layer), features in id order, with the metadata block.

    ``feats``: icao, layer, id, geom and property columns (null properties are written);
    ``frames``: icao, lat0, lon0. Coordinates carry 7 decimals in degrees, 3 in metres. A
    collection is one output document, so its features meet in one row by definition.
    """
    digits = 7 if projection == "wgs84" else 3
    f = feats.join(F.broadcast(registry.select("layer", "kind")), "layer")
    bag = F.to_json(F.struct(*props), {"ignoreNullFields": "false"})
    one = F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(',"geometry":'), geometry_json(F.col("kind"), F.col("geom"), digits), F.lit(',"properties":'), bag, F.lit("}"))
    docs = f.groupBy("icao", "layer", "kind").agg(F.array_sort(F.collect_list(F.struct("id", one.alias("t")))).alias("l")).join(frames.select("icao", "lat0", "lon0"), "icao")
    meta = F.to_json(F.struct(F.col("icao"), F.col("layer"), F.col("kind").alias("geometry"), F.lit(projection).alias("projection"), F.struct(F.col("lat0").alias("lat"), F.col("lon0").alias("lon")).alias("arp"), F.size("l").alias("count")))
    text = F.concat(F.lit('{"type":"FeatureCollection","name":"'), F.col("layer"), F.lit('","metadata":'), meta, F.lit(',"features":['), F.array_join(F.transform("l", lambda s: s.t), ","), F.lit("]}"))
    return docs.select("icao", "layer", F.size("l").alias("count"), text.alias("value"))
