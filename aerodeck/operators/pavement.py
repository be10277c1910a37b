"""Taxiway and apron pavement: classification, fallbacks, runways cut out, names, shoulders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes, text
from ..functions.geo import c
from . import overlay, spans
from .conflate import union_sources
from .network import majority
from .ordered import durable, rank, scan
from .spatial import box_pairs, edges_of, lines_near, points_in_polygons

# Smallest area kept, in square metres (strict above 5).
MIN_AREAS = {"intersection": 1.0, "pavement": 2.0, "road": 4.0, "shoulder": 5.0, "construction": 400.0, "osm_apron": 500.0}
STRICT = {"intersection", "construction", "osm_apron"}
LARGE_APRON_M2 = 40000.0
TAXIWAY_SHOULDER_M = 3.5
TAXIWAY_WIDTH_M = 23.0
BRIDGE, EXIT = 7, 3


def big_enough(area, kind: str) -> Column:
    k = MIN_AREAS[kind]
    return c(area) > k if kind in STRICT else c(area) >= k


def number_aprons(pieces: DataFrame, order: list[str]) -> DataFrame:
    """Unnamed apron pieces become ``APRON n``, n counting every apron piece of the airport."""
    p = scan(pieces, ["icao"], order, _n=rank())
    return p.withColumn("idapron", F.coalesce("name", F.concat(F.lit("APRON "), F.col("_n").cast("string")))).drop("_n")


def _box(df: DataFrame, p: str, cols: list[str]) -> DataFrame:
    b = shapes.bounds("geom")
    return df.select("icao", *[F.col(n).alias(f"{p}_{n}") for n in cols], *[v.alias(f"{p}_{n}") for n, v in b.items()])


def classify(pavement: DataFrame, stands: DataFrame, mids: DataFrame, aprons: DataFrame, cell: float = 5.0) -> DataFrame:
    """Class of each pavement: by hint, else by the stands and taxi edges on it, else by mapped aprons.

    ``pavement``: icao, pid, hint, geom; ``mids``: icao, eid, x, y of non-runway edges;
    ``aprons``: icao, geom. Counting joins touch only pavement whose hint leaves it open, and
    the cell cover only what the counts leave open.
    """
    open_ = pavement.filter(F.col("hint").isin("unknown", "runway"))
    on = (points_in_polygons(stands, open_, ["sid"], ["pid"]).groupBy("icao", "pid").agg(F.count(F.lit(1)).alias("n_stands")))
    ed = (points_in_polygons(mids, open_, ["eid"], ["pid"]).groupBy("icao", "pid").agg(F.count(F.lit(1)).alias("n_edges")))
    have = aprons.select("icao", F.lit(True).alias("_mapped")).distinct()
    j = (open_.join(on, ["icao", "pid"], "left").join(ed, ["icao", "pid"], "left").join(have, "icao", "left")
         .withColumn("n_stands", F.coalesce("n_stands", F.lit(0))).withColumn("n_edges", F.coalesce("n_edges", F.lit(0))))
    j = durable(j)
    undecided = j.filter(((F.col("n_stands") > 0) == (F.col("n_edges") > 0)) & F.coalesce("_mapped", F.lit(False)))
    share = overlay.covered_share(undecided.select("icao", "pid", "geom"), aprons, ["pid"], cell).select("icao", "pid", "share")
    j = j.join(share, ["icao", "pid"], "left")
    st, ed_ = F.col("n_stands") > 0, F.col("n_edges") > 0
    guess = (F.when(st & ~ed_, "apron").when(ed_ & ~st, "taxiway")
             .when(F.coalesce("_mapped", F.lit(False)), F.when(F.coalesce("share", F.lit(0.0)) > 0.5, "apron").otherwise("taxiway"))
             .when(st, "apron").when((shapes.geom_area("geom") > LARGE_APRON_M2) & ~ed_, "apron").otherwise("taxiway"))
    decided = j.select(*pavement.columns, guess.alias("class"))
    known = pavement.filter(~F.col("hint").isin("unknown", "runway")).withColumn("class", F.col("hint"))
    return known.unionByName(decided)


def without_runways(pieces: DataFrame, rw: DataFrame, key: str = "pid", cell: float = 500.0) -> DataFrame:
    """Pieces of each polygon outside every runway rectangle of its airport.

    Only rectangles that may share area with the polygon cut it: others would split it along the lines of their
    sides. Empty results are filtered after the explode, or Spark would cut every polygon twice to look ahead.
    """
    left = _box(pieces, "l", [key, "geom"])
    right = _box(rw, "r", ["geom", "idrwy", "rid"])
    met = box_pairs(left, right, cell).filter(~shapes.apart(F.col("l_geom")[0], F.col("r_geom")[0]))
    hits = met.groupBy("icao", F.col(f"l_{key}").alias(key)).agg(F.array_sort(F.collect_list(F.struct("r_idrwy", "r_rid", F.col("r_geom")[0].alias("cut")))).alias("_c")).withColumn("_cuts", F.transform("_c", lambda s: s["cut"])).drop("_c")
    j = pieces.join(hits, ["icao", key], "left")
    whole = j.filter("_cuts IS NULL").drop("_cuts").withColumn("piece", F.lit(0))
    cut = j.filter("_cuts IS NOT NULL").select(*pieces.columns, F.posexplode_outer(shapes.subtract_all(overlay.keyhole("geom"), "_cuts")).alias("piece", "_p"))
    return union_sources(whole, cut.filter("_p IS NOT NULL").withColumn("geom", F.array("_p")).drop("_p"))


def osm_supplement(areas: DataFrame, scenery: DataFrame, step: float = spans.STEP) -> DataFrame:
    """Parts of mapped aprons outside all scenery pavement, of more than 500 square metres: areas' columns, part, geom."""
    aprons = areas.filter("kind = 'apron'")
    rest = spans.remainders(aprons, scenery, ["aid"], step).filter(big_enough("area", "osm_apron"))
    return rest.select("icao", "aid", "part", "geom").join(aprons.drop("geom"), ["icao", "aid"])


def pavement_pieces(pavement: DataFrame, areas: DataFrame, lines: DataFrame, stands: DataFrame, mids: DataFrame, rw: DataFrame,
                    cell: float = 5.0) -> DataFrame:
    """Classified pavement of every source, runways cut out: icao, pid, piece, class, name, ..., geom.

    ``areas``: icao, aid, kind, name, surface, geom; ``lines``: taxi centreline segments
    (icao, fid, name, width_m, bridge, ax, ay, bx, by). Airports without pavement fall back
    to mapped areas and buffered centrelines.
    """
    osm_aprons = areas.filter(F.col("kind").isin("apron", "deicing")).select("icao", "geom")
    p = pavement.filter(F.size(F.col("geom")[0]) >= 4).select("icao", F.concat(F.lit("p"), F.col("pid").cast("string")).alias("pid"), "name", "hint", "surface", "source", "geom")
    # Phases end in tables, so later joins plan over short lineages.
    own = durable(classify(p, stands, mids, osm_aprons, cell).drop("hint"))
    bridged = lines_near(edges_of(p, ["icao", "pid"]), ["pid"], lines.filter("bridge"), 0.0, few="targets")
    own = own.join(bridged.withColumn("bridge", F.lit(True)), ["icao", "pid"], "left").withColumn("bridge", F.coalesce("bridge", F.lit(False)))
    have = pavement.select("icao").distinct()
    bare = areas.join(have, "icao", "left_anti")
    cls = F.when(F.col("kind").isin("apron", "deicing"), "apron").when(F.col("kind") == "taxiway", "taxiway").when(F.col("kind") == "helipad", "helipad")
    mapped = bare.withColumn("class", cls).filter("class IS NOT NULL")
    extra = osm_supplement(areas.join(have, "icao", "left_semi"), p).withColumn("class", F.lit("apron"))
    cols = ["icao", "aid", "part", "name", "surface", "geom", "class"]
    from_areas = mapped.withColumn("part", F.lit(0)).select(cols).unionByName(extra.select(cols))
    from_areas = from_areas.select("icao", F.concat(F.lit("a"), F.concat_ws("-", "aid", F.when(F.col("part") > 0, F.col("part")))).alias("pid"), "name", F.coalesce("surface", F.lit(0)).alias("surface"), F.lit("osm").alias("source"), "geom", "class", F.lit(False).alias("bridge"))
    taxi = lines.join(have, "icao", "left_anti").withColumn("w", F.coalesce("width_m", F.lit(TAXIWAY_WIDTH_M)))
    buffered = overlay.strips(taxi, "w")
    buffered = buffered.select("icao", F.concat(F.lit("l"), F.xxhash64("fid", "geom").cast("string")).alias("pid"), "name", F.lit(4).alias("surface"), F.lit("osm").alias("source"), "geom", F.lit("taxiway").alias("class"), "bridge")
    pieces = own.select(buffered.columns).unionByName(from_areas.select(buffered.columns)).unionByName(buffered)
    pieces = without_runways(durable(pieces), rw)
    return pieces.withColumn("fid", F.concat("pid", F.lit("."), F.col("piece").cast("string"))).filter(big_enough(shapes.geom_area("geom"), "pavement"))


def build_apronelement(pieces: DataFrame) -> DataFrame:
    a = number_aprons(pieces.filter("class = 'apron'"), ["pid", "piece"])
    return a.select("icao", "fid", "idapron", F.col("surface").alias("surftype"), text.apron_kind("idapron").alias("feattype"), F.lit(1).alias("status"), F.lit(None).cast("string").alias("pcn"), "source", "geom")


def build_taxiwayelement(pieces: DataFrame, mids: DataFrame, rw: DataFrame) -> DataFrame:
    """Short names stay; otherwise the most frequent edge name on the piece. Touching a runway makes an exit."""
    tw = pieces.filter("class = 'taxiway'")
    short = F.when(F.length("name") <= 6, F.col("name"))
    on = points_in_polygons(mids, tw, ["eid"], ["fid"]).join(mids.select("icao", "eid", F.col("name").alias("edge_name")), ["icao", "eid"]).filter("edge_name IS NOT NULL")
    voted = majority(on, ["icao", "fid"], "edge_name").select("icao", "fid", "edge_name")
    touch = lines_near(edges_of(tw, ["icao", "fid"]), ["fid"], edges_of(rw, ["icao"]), 1.0, few="targets").withColumn("_t", F.lit(True))
    j = tw.join(voted, ["icao", "fid"], "left").join(touch, ["icao", "fid"], "left")
    ft = F.when(F.col("bridge"), BRIDGE).when(F.col("_t"), EXIT).otherwise(0)
    return j.select("icao", "fid", F.coalesce(short, F.col("edge_name")).alias("idlin"), F.col("surface").alias("surftype"), ft.alias("feattype"), "bridge", F.lit(1).alias("status"), F.lit(None).cast("string").alias("pcn"), "source", "geom")


def pavement_roads(pieces: DataFrame) -> DataFrame:
    return pieces.filter("class = 'road'").select("icao", "name", F.col("surface").alias("surftype"), F.lit(None).cast("double").alias("width"), F.lit(False).alias("bridge"), "source", "geom")


def pavement_helipads(pieces: DataFrame) -> DataFrame:
    null = F.lit(None).cast("double")
    return pieces.filter("class = 'helipad'").select("icao", F.col("name").alias("ident"), F.col("surface").alias("surftype"), null.alias("length"), null.alias("width"), null.alias("brngtrue"), "source", "geom")


def build_taxiwayshoulder(pieces: DataFrame, others: DataFrame, mids: DataFrame, width: float = TAXIWAY_SHOULDER_M, step: float = 0.5) -> DataFrame:
    """Optional band round all taxiways and aprons of an airport, less them and ``others`` (icao, geom).

    The band is the round offset of the pavement; its connected parts of 5 square metres or more carry the most
    frequent name of the edges on them.
    """
    tw = pieces.filter(F.col("class").isin("taxiway", "apron"))
    band = spans.united(spans.of_buffers(edges_of(tw, ["icao"]), ["icao"], width, step), ["icao"])
    taken = spans.cover(tw.select("icao", "geom").unionByName(others.select("icao", "geom")), step)
    free = durable(spans.polygons(spans.minus(band, taken, [], bucket=spans.BUCKET), ["icao"], step).filter(big_enough("area", "shoulder")))
    on = points_in_polygons(mids, free, ["eid"], ["part"]).join(mids.select("icao", "eid", F.col("name").alias("idlin")), ["icao", "eid"]).filter("idlin IS NOT NULL")
    names = majority(on, ["icao", "part"], "idlin").select("icao", "part", "idlin")
    return free.join(names, ["icao", "part"], "left").select("icao", "part", "idlin", F.lit(0).alias("surftype"), F.lit(width).alias("width"), "area", F.lit("derived").alias("source"), "geom")
