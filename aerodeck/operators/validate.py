"""Checks over built layers: broken rows are dropped, everything else is reported."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import edges_of, points_in_polygons, within

EXPECTED_VERTICES = {"point": 1, "curve": 2, "surface": 4}


def _finite(col: str):
    return ~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))) & F.col(col).isNotNull()


def geometry_issues(vertex: DataFrame, registry: DataFrame) -> DataFrame:
    """Features with too few vertices in a part for their layer's kind, or a non-finite vertex.

    ``vertex``: icao, layer, fid, ring, x, y. One map-side combined aggregation.
    """
    # The registry is a fixed dimension of 45 rows.
    reg = F.broadcast(registry.select("layer", "kind"))
    per = vertex.groupBy("icao", "layer", "fid", "ring").agg(F.count(F.lit(1)).alias("n"), F.count_if(~(_finite("x") & _finite("y"))).alias("bad"))
    need = F.when(F.col("kind") == "point", 1).when(F.col("kind") == "curve", 2).otherwise(4)
    f = per.join(reg, "layer", "left").groupBy("icao", "layer", "fid").agg(F.bool_or(F.col("kind").isNull() | (F.col("n") < need)).alias("degenerate"), F.bool_or(F.col("bad") > 0).alias("non_finite"))
    issue = F.when(F.col("degenerate"), "geometry kind mismatch or degenerate").when(F.col("non_finite"), "non-finite coordinate")
    return f.select("icao", "layer", "fid", issue.alias("issue")).filter("issue IS NOT NULL")


def id_issues(features: DataFrame) -> DataFrame:
    """Missing ids (one row per feature) and duplicated ids (one row per extra copy)."""
    missing = features.filter("id IS NULL").select("icao", "layer", F.lit(None).cast("string").alias("id"), F.lit("feature without id").alias("issue"))
    twice = features.filter("id IS NOT NULL").groupBy("icao", "layer", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dup = twice.select("icao", "layer", "id", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("_k")).drop("_k").withColumn("issue", F.lit("duplicate id"))
    return missing.unionByName(dup)


def missing_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends that reference no node: (icao, eid, side, node)."""
    ends = edges.select("icao", "eid", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("nodeid")) for s in ("stnode", "ennode")])).alias("e")).select("icao", "eid", "e.side", "e.nodeid")
    return ends.filter("nodeid IS NOT NULL").join(nodes.select("icao", "nodeid"), ["icao", "nodeid"], "left_anti").select("icao", "eid", "side", F.col("nodeid").alias("node"))


def stray_thresholds(thresholds: DataFrame, surfaces: DataFrame, tol: float = 1.0) -> DataFrame:
    """Thresholds neither on a runway surface nor within ``tol`` of its edge."""
    off = within(thresholds, edges_of(surfaces, ["icao"]), tol, "left_anti", strict=True)
    poly = surfaces.withColumn("_sid", F.xxhash64("geom")).dropDuplicates(["icao", "_sid"])
    on = points_in_polygons(off, poly, ["tid"], ["_sid"]).select("icao", "tid").distinct()
    return off.join(on, ["icao", "tid"], "left_anti")


def missing_layers(built: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (icao, layer) pairs that were not written."""
    return expected.join(built.select("icao", "layer").distinct(), ["icao", "layer"], "left_anti")


def validate(features: DataFrame, vertex: DataFrame, registry: DataFrame, edges: DataFrame, nodes: DataFrame, thresholds: DataFrame,
             surfaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean features, and all issues with their severity."""
    bad = geometry_issues(vertex, registry)
    clean = features.join(bad.select("icao", "layer", "fid").distinct(), ["icao", "layer", "fid"], "left_anti")
    rows = [
        bad.select("icao", "layer", F.lit("dropped").alias("severity"), "issue"),
        bad.select("icao", "layer", F.lit("error").alias("severity"), "issue"),
        id_issues(clean).select("icao", "layer", F.lit("error").alias("severity"), "issue"),
        missing_nodes(edges, nodes).select("icao", F.lit("asrnedge").alias("layer"), F.lit("error").alias("severity"), F.concat("side", F.lit(" references a missing node")).alias("issue")),
        stray_thresholds(thresholds, surfaces).select("icao", F.lit("runwaythreshold").alias("layer"), F.lit("warning").alias("severity"), F.lit("threshold is not on a runway surface").alias("issue")),
    ]
    return clean, reduce(lambda a, b: a.unionByName(b), rows)


def report(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
