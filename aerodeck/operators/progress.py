"""Build bookkeeping: what is left, progress, status reports, retention, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import rank, running, scan


def not_built(codes: DataFrame, manifest: DataFrame, runlog: DataFrame) -> DataFrame:
    """Codes without a manifest, marked ``retry`` where the log holds a failure."""
    failed = runlog.filter("error IS NOT NULL").select("icao", F.lit("retry").alias("state")).distinct()
    return codes.join(manifest.select("icao"), "icao", "left_anti").join(failed, "icao", "left").select("icao", F.coalesce("state", F.lit("new")).alias("state"))


def latest(df: DataFrame, order: list[str], n: int = 12) -> DataFrame:
    return df.orderBy(*[F.col(o).desc() for o in order]).limit(n)


def progress(runlog: DataFrame, selection: DataFrame, bad: str = "error") -> DataFrame:
    """Totals, what is done and failed (last event per airport), rate per hour."""
    last = runlog.groupBy("icao").agg(F.max_by("status", "event_id").alias("status"))
    state = selection.select("icao").distinct().join(last, "icao", "left")
    totals = state.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != bad).alias("done"), F.count_if(F.col("status") == bad).alias("failed"))
    span = runlog.agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us")).scalar()
    t = totals.withColumn("elapsed", F.round(span / 1000000).cast("bigint"))
    return t.select("total", "done", "failed", F.greatest(F.col("total") - F.col("done") - F.col("failed"), F.lit(0)).alias("remaining"), "elapsed",
                    F.when(F.col("elapsed") > 60, F.col("done") / F.col("elapsed") * 3600).otherwise(F.lit(0.0)).alias("per_hour"))


def retention_plan(files: DataFrame, limit, keep: str) -> DataFrame:
    """What to remove, oldest first within each tier, until the rest fits ``limit`` bytes.

    ``files``: icao (folder or file), bytes, modified, tier (0 airports, 1 downloads). The
    kept airport counts towards the total but is never listed. Nothing is deleted.
    """
    total = files.select(F.sum("bytes")).scalar()
    # One global running sum in (tier, age) order; the scan splits it into ranges at scale.
    u = files.filter(F.col("icao") != keep).withColumn("_all", F.lit(1))
    r = scan(u, ["_all"], ["tier", "modified", "icao"], cum=running("bytes"))
    return r.withColumn("_total", total).filter(F.col("_total") - (F.col("cum") - F.col("bytes")) > limit).drop("_all", "_total", "cum")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Number of files and bytes per extension; reads file metadata only."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return f.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def status_report(runlog: DataFrame, manifest: DataFrame, index: DataFrame, label: str) -> DataFrame:
    """One line per logged airport with the manifest's facts, the index filling names."""
    m = manifest.select("icao", F.col("name").alias("m_name"), F.col("country").alias("m_country"), "sources", "features")
    i = index.select("icao", F.col("name").alias("i_name"), F.col("country").alias("i_country"))
    j = runlog.join(m, "icao", "left").join(i, "icao", "left")
    blank = F.lit("")
    return j.select("icao", "status", F.coalesce("m_name", "i_name", blank).alias("name"), F.coalesce("m_country", "i_country", blank).alias("country"), F.coalesce("sources", blank).alias("sources"),
                    F.coalesce(F.col("features").cast("string"), blank).alias("features"), F.when(F.col("seconds").isNotNull(), F.format_string("%.1f", "seconds")).otherwise(blank).alias("build_seconds"), F.coalesce("error", blank).alias("error"), F.lit(label).alias("run"))


def batch_report(runlog: DataFrame) -> DataFrame:
    """Selected, built, failed, skipped and total seconds of a batch as one row."""
    s = F.col("status")
    return runlog.agg(F.count(F.lit(1)).alias("selected"), F.count_if(s == "built").alias("built"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"), F.sum("seconds").alias("seconds"))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    return scan(df, keys, order, **{name: rank()})
