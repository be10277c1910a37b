"""Structured Streaming: build progress, nearest airport of a position feed, change events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import select
from ..operators.spatial import shuffled


def progress_stream(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per status and window of a stream of run events (ts, status); state ends with the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def nearest_stream(positions: DataFrame, index: DataFrame, reach_km: float = 1500.0) -> DataFrame:
    """Each position with its nearest airport within reach; stateless, so it never grows.

    The finest cube round the position that holds an airport is looked up level by level, and its ring alone is searched.
    A position in whose ring more than ``select.CHUNK`` airports lie meets them in one row.
    """
    rings = select._rings(reach_km)
    a = select.placed(index.select("icao", "lat", "lon"))
    full = select.full_cubes(a, rings, 1)
    near = select.airports_near_cubes(a, rings).groupBy("level", *select.CUBE).agg(F.flatten(F.collect_list("near")).alias("near"))
    p = select.in_space(positions.withColumnsRenamed({"lat": "plat", "lon": "plon"}), "plat", "plon").withColumn("level", F.lit(len(rings) - 1))
    for i in reversed(range(len(rings) - 1)):
        held = full.filter(F.col("level") == i).select(*select.CUBE, F.lit(i).alias("_held"))
        p = p.withColumns(dict(zip(select.CUBE, select.cube_of(rings[i][0]), strict=True))).join(held, select.CUBE, "left").withColumn("level", F.coalesce("_held", "level")).drop("_held", *select.CUBE)
    side = F.get(F.array(*[F.lit(float(d)) for d, _ in rings]), F.col("level"))
    j = p.withColumns(dict(zip(select.CUBE, select.cube_of(side), strict=True))).join(shuffled(near), ["level", *select.CUBE], "left")
    j = j.withColumn("_b", F.array_min(select.distances("plat", "plon")))
    hit = F.col("_b.km") <= reach_km
    return j.select(*[n for n in positions.columns if n not in ("lat", "lon")], F.when(hit, F.col("_b.icao")).alias("icao"), F.when(hit, F.col("_b.km")).alias("km"))


LAST = "icao string, ts timestamp, event_id bigint"
KEEP = pd.Timedelta(days=30)
CHANGE = "vehicle bigint, event_id bigint, icao string"


class ChangeDetector(StatefulProcessor):
    """Keeps the last row of a vehicle and passes on rows at which its airport changes.

    Rows of one micro-batch are taken in the order of (ts, event_id); a row that is not later than the last row
    taken is late and left out, so a batch that is run again or comes out of order never goes back. A vehicle that
    is silent for ``KEEP`` is forgotten, by a timer once the watermark has passed, and its next airport is a change.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        # A call may get its rows in several pieces and in any order.
        df = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        icao, at = None, None
        if self.last.exists():
            icao, ts, event = self.last.get()
            at = (pd.Timestamp(ts), event)
        out = []
        for ts, event, new in zip(df["ts"], df["event_id"], df["icao"], strict=True):
            if pd.isna(ts) or (at is not None and (ts, event) <= at):
                continue
            if at is not None and ts - at[0] > KEEP:
                icao, at = None, None
            new = None if pd.isna(new) else new
            if new != icao or (at is None and new is not None):
                out.append((key[0], event, new))
            icao, at = new, (ts, event)
        if at is not None:
            self.last.update((icao, at[0].to_pydatetime(), int(at[1])))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((at[0].tz_localize("UTC") if at[0].tzinfo is None else at[0]).timestamp() * 1000) + int(KEEP.total_seconds() * 1000) + 1)
        yield pd.DataFrame(out, columns=["vehicle", "event_id", "icao"]).astype({"vehicle": "int64", "event_id": "int64"})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"vehicle": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "icao": pd.Series(dtype="object")})

    def close(self) -> None:
        pass


def change_stream(nearest: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows of a stream (vehicle, event_id, ts, icao) at which a vehicle's nearest airport changes; rows without a vehicle drop out."""
    keyed = nearest.filter("vehicle IS NOT NULL").select("vehicle", "event_id", F.col("ts").cast("timestamp").alias("ts"), "icao").withWatermark("ts", late)
    return keyed.groupBy("vehicle").transformWithStateInPandas(statefulProcessor=ChangeDetector(), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime")


def run_changes(nearest: DataFrame, out: str, checkpoint: str) -> None:
    """Write the changes of a stream of nearest airports to the table ``out``, from where ``checkpoint`` left off, until the source is read.

    State lives in RocksDB and its change log under ``checkpoint``, so a lost executor or a restart goes on from the last batch.
    """
    spark, key, rocks = nearest.sparkSession, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rocks)
    try:
        change_stream(nearest).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
