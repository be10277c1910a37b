"""Tabular and JSON sources: airport indexes, registry tables, code lists, flight plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import scan, rank

AIRPORT_COLUMNS = ["ident", "type", "name", "latitude_deg", "longitude_deg", "elevation_ft", "continent", "iso_country", "iso_region", "municipality", "gps_code", "iata_code", "icao_code"]
RUNWAY_COLUMNS = ["airport_ident", "length_ft", "width_ft", "surface", "closed", "le_ident", "le_latitude_deg", "le_longitude_deg", "le_displaced_threshold_ft", "he_ident", "he_latitude_deg", "he_longitude_deg", "he_displaced_threshold_ft"]
REGISTRY_BASE = ["SITE_NO", "ARPT_ID", "ICAO_ID", "ARPT_NAME"]
REGISTRY_ENDS = ["SITE_NO", "RWY_ID", "RWY_END_ID", "TKOF_RUN_AVBL", "TKOF_DIST_AVBL", "ACLT_STOP_DIST_AVBL", "LNDG_DIST_AVBL", "LAHSO_ALD", "RWY_END_INTERSECT_LAHSO", "LAHSO_DESC", "DISPLACED_THR_LEN", "TDZ_ELEV"]
REGISTRY_ARRESTING = ["SITE_NO", "RWY_ID", "RWY_END_ID", "ARREST_DEVICE_CODE"]
LIST_HEADERS = ["icao", "ident", "idarpt", "icao_code"]
SCENERY_LIST = "airports array<struct<AirportCode:string,AirportName:string,RecommendedSceneryId:bigint,Latitude:double,Longitude:double,Elevation:double>>"
FLIGHT_PLAN = ("fetch struct<status:string>, origin struct<icao_code:string>, destination struct<icao_code:string>, general struct<flight_number:string>, atc struct<callsign:string>, aircraft struct<icaocode:string>, alternate string")


def by_header(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns found by trimmed, case-insensitive header; blanks and missing columns become null."""
    have = {c.strip().upper(): c for c in df.columns}
    return df.select(*[(F.nullif(F.trim(F.col(f"`{have[n.upper()]}`").cast("string")), F.lit("")) if n.upper() in have else F.lit(None).cast("string")).alias(n) for n in names])


def read_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return by_header(spark.read.option("header", True).csv(path), names)


def text_index(lines: DataFrame, value: str = "value", line_no: str = "line_no") -> DataFrame:
    """Fixed-layout index: two head lines, at least five fields, ``-1`` for unknown."""
    f = lines.filter(F.col(line_no) >= 2).select(F.split(F.trim(value), r"\s+").alias("f"))
    f = f.filter((F.size("f") >= 5) & F.col("f")[0].rlike("^[A-Za-z0-9]+$"))
    g = lambda i: F.get("f", F.lit(i))
    ta = g(8).try_cast("double")
    out = f.select(F.upper(g(0)).alias("icao"), g(1).alias("region"), g(2).try_cast("double").alias("lat"), g(3).try_cast("double").alias("lon"), g(4).try_cast("double").alias("elev_ft"), g(5).alias("kind"),
                   F.when(ta > 0, ta).alias("trans_alt_ft"), F.nullif(g(9), F.lit("-1")).alias("trans_level"), F.lit("aptmeta").alias("source"))
    return out.filter("lat IS NOT NULL AND lon IS NOT NULL")


def airports(df: DataFrame) -> DataFrame:
    """Airport table rows with a four-character code and a position."""
    a = by_header(df, AIRPORT_COLUMNS)
    code = F.coalesce("icao_code", "gps_code", "ident")
    out = a.select(F.upper(code).alias("icao"), F.col("iata_code").alias("iata"), "name", F.col("iso_region").alias("region"), F.col("iso_country").alias("country"), F.col("municipality").alias("city"), F.col("latitude_deg").try_cast("double").alias("lat"),
                   F.col("longitude_deg").try_cast("double").alias("lon"), F.col("elevation_ft").try_cast("double").alias("elev_ft"), F.col("type").alias("kind"), F.upper("continent").alias("continent"), F.lit("ourairports").alias("source"))
    return out.filter(F.col("icao").rlike("^[A-Z0-9]{4}$") & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def index_runways(df: DataFrame) -> DataFrame:
    r = by_header(df, RUNWAY_COLUMNS)
    d = lambda n: F.col(n).try_cast("double").alias(n)
    return r.filter("airport_ident IS NOT NULL").select(F.upper("airport_ident").alias("icao"), d("length_ft"), d("width_ft"), "surface", F.coalesce(F.col("closed") == "1", F.lit(False)).alias("closed"), F.coalesce("le_ident", F.lit("")).alias("le_ident"),
                                                        d("le_latitude_deg"), d("le_longitude_deg"), d("le_displaced_threshold_ft"), F.coalesce("he_ident", F.lit("")).alias("he_ident"), d("he_latitude_deg"), d("he_longitude_deg"), d("he_displaced_threshold_ft"))


def scenery_list(docs: DataFrame, value: str = "value") -> DataFrame:
    a = docs.select(F.explode(F.from_json(value, SCENERY_LIST)["airports"]).alias("a")).select("a.*").filter("AirportCode IS NOT NULL")
    return a.select(F.upper("AirportCode").alias("icao"), F.col("AirportName").alias("name"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"), F.col("Elevation").alias("elev_ft"), F.col("RecommendedSceneryId").alias("scenery_id"), F.lit("xplane").alias("source"))


def attach_scenery(index: DataFrame, listed: DataFrame) -> DataFrame:
    """Known airports gain the scenery id; unknown ones with a position join the index."""
    known = index.join(listed.select("icao", "scenery_id"), "icao", "left")
    new = listed.filter("lat IS NOT NULL AND lon IS NOT NULL").join(index.select("icao"), "icao", "left_anti")
    return known.unionByName(new, allowMissingColumns=True)


def registry_arresting(base: DataFrame, arresting: DataFrame) -> DataFrame:
    from ..functions.text import pad_registry
    b = base.select("SITE_NO", F.upper("ICAO_ID").alias("icao")).filter("icao IS NOT NULL")
    a = arresting.filter("RWY_END_ID IS NOT NULL AND ARREST_DEVICE_CODE IS NOT NULL").join(b, "SITE_NO")
    return a.select("icao", pad_registry("RWY_END_ID").alias("runway_end"), F.col("ARREST_DEVICE_CODE").alias("kind"), F.lit(None).cast("double").alias("distance_m"), F.lit("faa_nasr").alias("source"))


def registry_lahso(ends: DataFrame) -> DataFrame:
    """Landing-short rows out of ``conflate.registry_ends``."""
    return ends.filter("lahso_m > 0").select("icao", F.col("end_key").alias("runway_end"), F.col("lahso_m").alias("available_m"), "crossing", F.lit("faa_nasr").alias("source"))


def is_code(v: Column) -> Column:
    return v.rlike("^[A-Za-z0-9]{3,4}$")


def code_list(texts: DataFrame, value: str = "value", key: str = "path") -> DataFrame:
    """Codes of list files in order: one column of a CSV with a code header, else free text.

    ``texts``: one row per file. Output: key, pos, icao.
    """
    t = texts.withColumn("_l", F.split(F.regexp_replace(value, "^﻿", ""), "\r?\n"))
    cols = F.transform(F.split(F.lower(F.col("_l")[0]), ","), lambda h: F.trim(F.regexp_replace(h, '"', "")))
    at = F.array_min(F.filter(F.transform(F.array(*[F.lit(h) for h in LIST_HEADERS]), lambda h: F.array_position(cols, h)), lambda p: p > 0))
    t = t.withColumn("_at", at)
    csv = t.filter("_at IS NOT NULL").select(key, "_at", F.posexplode("_l").alias("pos", "ln")).filter("pos > 0")
    cell = F.trim(F.regexp_replace(F.get(F.split("ln", ","), F.col("_at").cast("int") - 1), '"', ""))
    from_csv = csv.select(key, F.col("pos").alias("p1"), F.lit(0).alias("p2"), cell.alias("icao"))
    free = t.filter("_at IS NULL").select(key, F.posexplode("_l").alias("p1", "ln"))
    from_text = free.select(key, "p1", F.posexplode(F.split(F.regexp_replace("ln", "#.*$", ""), r"[\s,;]+")).alias("p2", "icao"))
    r = from_csv.unionByName(from_text).filter(is_code(F.col("icao"))).withColumn("icao", F.upper("icao"))
    return scan(r, [key], ["p1", "p2"], pos=rank()).select(key, "pos", "icao")


def flight_plans(docs: DataFrame, value: str = "value", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Distinct codes of flight plans in order origin, destination, alternates; and the rejects."""
    j = docs.withColumn("_j", F.from_json(value, FLIGHT_PLAN))
    four = lambda v: F.when(F.length(v) == 4, F.upper(v))
    many = F.from_json("_j.alternate", "array<struct<icao_code:string>>")
    one = F.from_json("_j.alternate", "struct<icao_code:string>")["icao_code"]
    alternates = F.when(F.col("_j.alternate").startswith("["), F.transform(many, lambda a: four(a["icao_code"]))).otherwise(F.array(four(one)))
    o, d = four(F.col("_j.origin.icao_code")), four(F.col("_j.destination.icao_code"))
    status = F.col("_j.fetch.status")
    why = F.when(F.col("_j").isNull(), "not JSON").when(F.coalesce(status != "Success", F.lit(False)), status).when(o.isNull() & d.isNull(), "no airports in the plan")
    r = j.withColumn("reason", why).withColumn("_c", F.array_distinct(F.array_compact(F.concat(F.array(o, d), F.coalesce(alternates, F.array().cast("array<string>"))))))
    ok = r.filter("reason IS NULL").select(key, F.posexplode("_c").alias("pos", "icao"))
    return ok, r.filter("reason IS NOT NULL").select(key, "reason")
