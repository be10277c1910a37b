"""Choosing airports: criteria, exclusions, areas, search, neighbours, shares and priority lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, NM_KM, c, haversine_km, rnd
from ..functions.text import continent_code
from .ordered import rank, scan
from .spatial import shuffled

INTERNATIONAL = r"(?i)\b(international|intl|internacional|internationale|internazionale)\b"


def runway_stats(runways: DataFrame) -> DataFrame:
    """Open runways and longest open runway per airport."""
    open_ = ~F.col("closed")
    return runways.groupBy("icao").agg(F.count_if(open_).alias("n_open"), F.max(F.when(open_, F.col("length_ft"))).alias("longest_ft"))


def with_stats(index: DataFrame, runways: DataFrame) -> DataFrame:
    return index.join(runway_stats(runways), "icao", "left")


def _lower_in(col, values) -> Column:
    return F.lower(col).isin([v.lower() for v in values])


def criterion(name: str, value) -> Column:
    """Predicate of one selection criterion over an index row with runway stats."""
    tests = {
        "country": lambda: _lower_in("country", [value]),
        "countries": lambda: _lower_in("country", value),
        "continents": lambda: _lower_in("continent", value),
        "min_runways": lambda: F.col("n_open") >= value,
        "region": lambda: F.upper("region").startswith(value.upper()),
        "prefix": lambda: F.col("icao").startswith(value.upper()),
        "near": lambda: haversine_km(F.lit(value[0]), F.lit(value[1]), "lat", "lon") <= value[2],
        "bbox": lambda: F.col("lon").between(value[0], value[2]) & F.col("lat").between(value[1], value[3]),
        "kinds": lambda: F.lower("kind").rlike("|".join(v.lower() for v in value)),
        "min_runway_ft": lambda: F.col("longest_ft") >= value,
        "iata": lambda: _lower_in("iata", value),
        "search": lambda: F.lower("name").contains(value.lower()) | F.coalesce(F.lower("city").contains(value.lower()), F.lit(False)),
        "all": lambda: F.lit(True),
    }
    return F.coalesce(tests[name](), F.lit(False))


def select_airports(index: DataFrame, runways: DataFrame, **criteria) -> DataFrame:
    """Airports meeting every criterion."""
    df = with_stats(index, runways) if {"min_runways", "min_runway_ft"} & set(criteria) else index
    for name, value in criteria.items():
        df = df.filter(criterion(name, value))
    return df


def exclude(airports: DataFrame, entries: DataFrame) -> DataFrame:
    """Drop codes named by ``entries.entry``: four characters or more exactly, fewer as a prefix.

    Prefixes have one to three characters, so each code is looked up by equality on its own
    three prefixes and itself; no theta join.
    """
    e = entries.select(F.upper("entry").alias("_key")).distinct()
    code = F.upper("icao")
    keys = F.array(*[F.substring(code, 1, n) for n in (1, 2, 3)], F.when(F.length(code) >= 4, code))
    named = airports.select("icao", F.explode(F.array_compact(keys)).alias("_key")).join(e, "_key").select("icao").distinct()
    return airports.join(named, "icao", "left_anti")


def select_areas(index: DataFrame, runways: DataFrame, areas: list[str], kinds: list[str], min_runways: int = 1,
                 min_ft: float | None = None) -> DataFrame:
    """Airports of any listed continent or country; ``all`` overrides the list."""
    words = [a.strip() for a in areas]
    df = with_stats(index, runways).filter(F.coalesce(F.col("n_open"), F.lit(0)) >= min_runways)
    if kinds:
        df = df.filter(criterion("kinds", kinds))
    if min_ft is not None:
        df = df.filter(criterion("min_runway_ft", min_ft))
    if any(w.lower() in ("all", "world") for w in words):
        return df
    wanted = F.array(*[F.lit(w) for w in words])
    continents = F.array_compact(F.transform(wanted, continent_code))
    countries = F.transform(F.filter(wanted, lambda w: continent_code(w).isNull()), F.upper)
    return df.filter(F.array_contains(continents, F.upper("continent")) | F.array_contains(countries, F.upper("country")))


def first_positions(codes: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Keep the first position of duplicated keys."""
    return codes.groupBy(*keys).agg(F.min(pos).alias(pos))


def search_ranked(index: DataFrame, text: str, limit: int = 25) -> DataFrame:
    """Exact code, then code prefix, then name, then city matches."""
    q = text.strip().lower()
    r = (F.when((F.lower("icao") == q) | F.coalesce(F.lower("iata") == q, F.lit(False)), 0)
         .when(F.lower("icao").startswith(q), 1).when(F.lower("name").contains(q), 2).when(F.lower("city").contains(q), 3))
    return index.withColumn("rank", r).filter(F.col("rank").isNotNull()).orderBy("rank", "icao").limit(limit)


def search_prefix(index: DataFrame, built: DataFrame, text: str) -> DataFrame:
    """Large, medium or built airports whose code, IATA code or name starts with the text.

    ``built``: manifest rows (icao, iata, name, lat, lon, elev_ft); built airports missing
    from the index are offered too.
    """
    cols = ["icao", "iata", "name", "lat", "lon", "elev_ft"]
    listed = (index.filter(F.col("kind").isin("large_airport", "medium_airport")).select(*cols)
              .unionByName(index.join(built.select("icao"), "icao", "left_semi").filter(~F.col("kind").isin("large_airport", "medium_airport")).select(*cols)))
    rows = listed.unionByName(built.join(index, "icao", "left_anti").select(*cols))
    q = text.strip().upper()
    match = F.col("icao").startswith(q) | F.coalesce(F.upper("iata").startswith(q), F.lit(False)) | F.coalesce(F.upper("name").startswith(q), F.lit(False))
    return rows.filter(match | F.lit(q == "")).orderBy("icao")


def search_row(df: DataFrame) -> DataFrame:
    elev = F.coalesce(rnd(F.col("elev_ft") * 0.3048, 2), F.lit(0.0))
    return df.select(F.col("icao").alias("idarpt"), "iata", elev.alias("elev"), F.coalesce("name", F.lit("")).alias("name"), "lat", "lon")


LEVELS = 6
CHUNK = 256


def _rings(radius_km: float) -> list[tuple[float, float]]:
    """(side, reach) in km of nested cubes, finest first; the last is the whole radius.

    Cubes cut the sphere in space, so they are as wide at the poles as elsewhere and need no wrap. Sides are powers of
    two; two points of a cube lie within a chord of 1.733 sides, so a cube that holds enough airports bounds the search.
    """
    chord = 2 * EARTH_KM * math.sin(min(max(radius_km, 0.0) / (2 * EARTH_KM), math.pi / 2)) + 1e-6
    side = 2.0 ** math.ceil(math.log2(max(chord, 0.01) / 1.733))
    return [*((side / 2 ** i, 1.733 * side / 2 ** i) for i in range(LEVELS, 0, -1)), (side, chord)]


def in_space(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds gx, gy, gz: the place on the sphere, in km from its centre."""
    a, b = F.radians(lat), F.radians(lon)
    return df.withColumns({"gx": EARTH_KM * F.cos(a) * F.cos(b), "gy": EARTH_KM * F.cos(a) * F.sin(b), "gz": EARTH_KM * F.sin(a)})


CUBE = ["ix", "iy", "iz"]


def cube_of(side) -> list[Column]:
    return [F.floor(F.col(f"g{n}") / side).cast("int").alias(f"i{n}") for n in "xyz"]


def _up(level) -> list[Column]:
    return [F.floor(F.col(n) / F.pow(F.lit(2.0), level)).cast("int").alias(n) for n in CUBE]


def full_cubes(index: DataFrame, rings: list[tuple[float, float]], limit: int) -> DataFrame:
    """(level, cube) of the cubes that hold ``limit`` airports; counted in the finest cubes and rolled up."""
    held = index.groupBy(*cube_of(rings[0][0])).agg(F.count(F.lit(1)).alias("n"))
    up = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(rings) - 1)), lambda lv: F.struct(lv.alias("level"), *_up(lv))))
    return held.select("n", up.alias("u")).groupBy("u.level", *[f"u.{n}" for n in CUBE]).agg(F.sum("n").alias("n")).filter(F.col("n") >= limit).drop("n")


def airports_near_cubes(index: DataFrame, rings: list[tuple[float, float]]) -> DataFrame:
    """(level, cube, near): airports within the reach of a level of any place of a cube.

    ``near`` holds (icao, lat, lon) and the place in space; a cube near more than ``CHUNK`` airports gets several rows, so no row is large.
    """
    sizes = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(d)).alias("side"), F.lit(float(r)).alias("reach")) for i, (d, r) in enumerate(rings)])
    a = index.withColumn("_l", F.explode(sizes)).select("icao", "lat", "lon", "gx", "gy", "gz", "_l.*")
    gap, low, high = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for n in "xyz":
        a = a.withColumn(f"i{n}", F.explode(F.sequence(*[F.floor((F.col(f"g{n}") + s * F.col("reach")) / F.col("side")).cast("int") for s in (-1, 1)])))
        lo = F.col(f"i{n}") * F.col("side")
        hi = lo + F.col("side")
        off = F.greatest(lo - F.col(f"g{n}"), F.col(f"g{n}") - hi, F.lit(0.0))
        inner = F.greatest(lo, -hi, F.lit(0.0))
        gap, low, high = gap + off * off, low + inner * inner, high + F.greatest(lo * lo, hi * hi)
        a = a.filter(gap <= F.col("reach") * F.col("reach") + 1e-6)
    # Cubes that the sphere does not pass through hold no point.
    a = a.filter((low <= EARTH_KM * EARTH_KM + 1e-3) & (high >= EARTH_KM * EARTH_KM - 1e-3)).select("level", *CUBE, "icao", "lat", "lon", "gx", "gy", "gz")
    chunks = a.groupBy("level", *CUBE).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_n")).filter("_n > 1")
    a = a.join(chunks, ["level", *CUBE], "left").withColumn("_part", F.pmod(F.xxhash64("icao"), F.coalesce("_n", F.lit(1))))
    return a.groupBy("level", *CUBE, "_part").agg(F.collect_list(F.struct("icao", "lat", "lon", "gx", "gy", "gz")).alias("near")).drop("_part")


PARTS = 4


def pruned(near: Column, side: Column, limit: int) -> Column:
    """Airports of ``near`` that can be among the nearest of a place of the cube (jx, jy, jz) of some side.

    ``limit`` airports lie nearer to every place of the cube than some bound; who is farther than that from all of it goes.
    """
    def squared(a, far):
        total = F.lit(0.0)
        for n in "xyz":
            low, high = F.col(f"j{n}") * side - a[f"g{n}"], a[f"g{n}"] - (F.col(f"j{n}") + 1) * side
            off = F.greatest(-low, -high) if far else F.greatest(low, high, F.lit(0.0))
            total = total + off * off
        return total

    bound = F.coalesce(F.get(F.array_sort(F.transform(near, lambda a: squared(a, True))), F.lit(limit - 1)), F.lit(float("inf")))
    # The bound is bound to a variable, else it would be worked out again for each airport.
    return F.get(F.transform(F.array(bound * (1 + 1e-9) + 1e-6), lambda u: F.filter(near, lambda a: squared(a, False) <= u)), F.lit(0))


def placed(df: DataFrame) -> DataFrame:
    return in_space(df.filter("lat IS NOT NULL AND lon IS NOT NULL"))


def distances(lat: str, lon: str) -> Column:
    """(km, icao) of each airport of ``near``."""
    return F.transform("near", lambda a: F.struct(haversine_km(F.col(lat), F.col(lon), a.lat, a.lon).alias("km"), a.icao.alias("icao")))


def nearest_candidates(points: DataFrame, index: DataFrame, radius_km: float = 60, limit: int = 16, pid: str = "pid") -> DataFrame:
    """Pairs (pid, icao, km) that hold the ``limit`` nearest airports within a radius of each point.

    Each point searches the ring of the smallest cube round it that already holds ``limit`` airports, so what is
    compared follows the density near the point and not the radius; where no cube does, the radius is the ring.
    A point meets the airports that can be nearest to its part of the cube in one row, or one row for each 256, and passes on ``limit`` of each.
    Rows without a position take no part.
    """
    rings = _rings(radius_km)
    top = len(rings) - 1
    a = placed(index.select("icao", "lat", "lon"))
    p = placed(points.select(pid, "lat", "lon"))
    fine = p.select("*", *cube_of(rings[0][0]))
    levels = F.explode(F.transform(F.sequence(F.lit(0), F.lit(top)), lambda lv: F.struct(lv.alias("level"), *_up(lv))))
    mine = fine.select(*CUBE).distinct().select(*[F.col(n).alias(f"_{n}") for n in CUBE], levels.alias("u")).select(*[f"_{n}" for n in CUBE], "u.*")
    level = mine.join(shuffled(full_cubes(a, rings, limit)), ["level", *CUBE]).groupBy(*[F.col(f"_{n}").alias(n) for n in CUBE]).agg(F.min("level").alias("level"))
    p = fine.join(shuffled(level), CUBE, "left").withColumn("level", F.coalesce("level", F.lit(top)))
    # Points look into parts of their cube, and each part keeps the airports that can be nearest to a place of it.
    side = F.get(F.array(*[F.lit(d / PARTS) for d, _ in rings]), F.col("level"))
    part = ["level", "jx", "jy", "jz"]
    p = p.select(pid, "lat", "lon", "level", *[F.floor(F.col(f"g{n}") / side).cast("int").alias(f"j{n}") for n in "xyz"])
    used = p.select(*part).distinct().select(*part, *[F.floor(F.col(f"j{n}") / PARTS).cast("int").alias(f"i{n}") for n in "xyz"])
    kept = pruned(F.col("near"), side, limit)
    lists = used.join(shuffled(airports_near_cubes(a, rings)), ["level", *CUBE]).select(*part, F.transform(kept, lambda s: F.struct(s.icao, s.lat, s.lon)).alias("near"))
    met = p.join(shuffled(lists), part).select(pid, F.filter(distances("lat", "lon"), lambda s: s.km <= radius_km).alias("_d"))
    return met.select(pid, F.explode(F.slice(F.array_sort("_d"), 1, limit)).alias("_s")).select(pid, "_s.icao", "_s.km")


def nearest_airports(points: DataFrame, index: DataFrame, radius_km: float = 60, limit: int = 16,
                     pid: str = "pid") -> DataFrame:
    """The nearest airports within a radius of many points, nearest first (ties by code), with the distance in NM."""
    near = W.partitionBy(pid).orderBy("km", "icao")
    best = nearest_candidates(points, index, radius_km, limit, pid).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= limit)
    return best.withColumn("distance_nm", rnd(F.col("km") / NM_KM, 2))


def apportion(counts: DataFrame, slots, group: list[str], key: list[str], floor: int = 0) -> DataFrame:
    """Largest-remainder share of slots over counted keys, per group; a floor may apply.

    ``counts``: group, key, n; ``slots`` a column (per group) or number. Nobody gets more
    than their count; keys the floor lifted too far give slots back, the biggest overshoot
    first. Key tables are small dimensions (countries), already aggregated.
    """
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    df = counts.withColumn("_slots", c(slots)).withColumn("_total", F.sum("n").over(w))
    df = df.withColumn("exact", F.col("_slots") * F.col("n") / F.col("_total"))
    df = df.withColumn("got", F.least(F.greatest(F.floor("exact").cast("bigint"), F.lit(floor)), F.col("n")))
    goal = F.least(F.col("_slots"), F.col("_total"))
    df = df.withColumn("short", goal - F.sum("got").over(w))
    # Candidate steps up and down: each key offers one row per slot it could gain or lose,
    # so the sequential hand-out becomes one ranking by remainder.
    up = df.filter(F.col("short") > 0).withColumn("step", F.explode(F.sequence(F.lit(0), F.greatest(F.least(F.col("n") - F.col("got"), F.col("short")) - 1, F.lit(0)))))
    up = up.filter(F.col("got") + F.col("step") < F.col("n"))
    up = up.withColumn("_r", F.row_number().over(w.orderBy((F.col("exact") - F.col("got") - F.col("step")).desc(), *key)))
    gained = up.filter(F.col("_r") <= F.col("short")).groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_up"))
    down = df.filter((F.col("short") < 0) & (F.col("got") > floor)).withColumn("step", F.explode(F.sequence(F.lit(0), F.greatest(F.least(F.col("got") - floor, -F.col("short")) - 1, F.lit(0)))))
    down = down.withColumn("_r", F.row_number().over(w.orderBy((F.col("got") - F.col("step") - F.col("exact")).desc(), *key)))
    lost = down.filter(F.col("_r") <= -F.col("short")).groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_down"))
    out = df.join(gained, [*group, *key], "left").join(lost, [*group, *key], "left")
    share = F.col("got") + F.coalesce("_up", F.lit(0)) - F.coalesce("_down", F.lit(0))
    return out.select(*group, *key, "n", share.alias("slots"))


def airport_rank_order() -> list[Column]:
    """Large first, then international names, more runways, longer runway, code."""
    return [F.when(F.col("kind") == "large_airport", 0).otherwise(1).alias("o1"), F.when(F.col("name").rlike(INTERNATIONAL), 0).otherwise(1).alias("o2"),
            (-F.coalesce("n_open", F.lit(0))).alias("o3"), (-F.coalesce("longest_ft", F.lit(0))).alias("o4"), F.col("icao")]


def rank_in_country(index: DataFrame, runways: DataFrame) -> DataFrame:
    df = with_stats(index, runways).select("icao", "country", *airport_rank_order()[:4])
    return scan(df, ["country"], ["o1", "o2", "o3", "o4", "icao"], rank=rank()).select("icao", "country", "rank")


def proportional_list(index: DataFrame, runways: DataFrame, total: int) -> DataFrame:
    """Airports by continent share, then country share (at least one each), best first."""
    by_country = index.groupBy("continent", "country").agg(F.count(F.lit(1)).alias("n"))
    conts = apportion(by_country.groupBy("continent").agg(F.sum("n").alias("n")), total, [], ["continent"])
    per = apportion(by_country.join(conts.select("continent", F.col("slots").alias("_cs")), "continent"), F.col("_cs"), ["continent"], ["country"], 1)
    return (rank_in_country(index, runways).join(per.select("continent", "country", "slots"), "country")
            .filter(F.col("rank") <= F.col("slots")).select("icao", "continent", "country", "rank"))


def reason_list(index: DataFrame, runways: DataFrame, state_countries: list[str] = ("IN", "US")) -> DataFrame:
    """Airports worth building with the joined reasons; every country and state gets one."""
    df = with_stats(index, runways).withColumn("n_open", F.coalesce("n_open", F.lit(0))).withColumn("longest_ft", F.coalesce("longest_ft", F.lit(0)))
    intl = F.col("name").rlike(INTERNATIONAL)
    reasons = F.array_compact(F.array(F.when(F.col("kind") == "large_airport", "large"), F.when(intl, "international"), F.when(F.col("n_open") >= 2, "2+ runways")))
    named = df.select("icao", "country", "region", F.explode(reasons).alias("why"))
    lonely = df.join(named.select("country").distinct(), "country", "left_anti")
    main = lonely.groupBy("country").agg(F.min_by("icao", F.struct(-F.col("longest_ft"), -F.col("n_open"), F.col("icao"))).alias("icao"))
    main = main.select("icao", F.concat(F.lit("main airport of "), F.col("country")).alias("why"))
    covered = named.select("icao", "why").unionByName(main)
    states = df.filter(F.col("country").isin(list(state_countries)) & F.col("region").isNotNull())
    have = states.join(covered.select("icao").distinct(), "icao", "left_semi").select("region").distinct()
    best = states.join(have, "region", "left_anti").groupBy("region").agg(
        F.min_by("icao", F.struct(F.when(intl, 0).otherwise(1), -F.col("longest_ft"), -F.col("n_open"), F.col("icao"))).alias("icao"))
    rows = covered.unionByName(best.select("icao", F.concat(F.lit("main airport of "), F.col("region")).alias("why")))
    return rows.groupBy("icao").agg(F.array_join(F.array_sort(F.collect_set("why")), " + ").alias("why"))


def priority_order(df: DataFrame, first: list[str] = ("IN", "US")) -> DataFrame:
    """Priority countries first, then continent, country, more runways, code."""
    p = F.lit(len(first))
    for i, code in reversed(list(enumerate(first))):
        p = F.when(F.col("country") == code, i).otherwise(p)
    return df.withColumn("priority", p + 1).orderBy("priority", "continent", "country", F.col("n_open").desc(), "icao")


