"""Helpers the operators of this package share: shared storage, word hashes, sketches, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M1, M2, P1 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; one is set only where none is."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file:///tmp/spark-checkpoints-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete a stored table that later steps no longer read."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """Word (str or bytes) -> 64-bit hash, kept for the words of a task up to a bound of entries."""

    LIMIT = 200_000

    def __missing__(self, word):
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise uint64 hashes so that every bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``k`` word hashes; a shorter non-empty sequence is one run."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out = out * P1 + h[i : n - k + 1 + i]
    return mixed(out + np.uint64(k))


CHUNK = 1 << 13


def sketch_rows(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The non-zero chunks of a task's fixed-size sketch, as rows."""
    for i in range(0, len(counts), CHUNK):
        part = counts[i : i + CHUNK]
        if part.any():
            yield i // CHUNK, part.tobytes()


def gather_sketch(rows: DataFrame, size: int, dtype: str, fold=np.add) -> np.ndarray:
    """Fold the chunks (part, data) that tasks made into one array of ``size`` elements.

    The size is fixed, whatever the input, so the array may go to the driver and be broadcast.
    Chunks meet in two steps, so that no task gathers those of all tasks.
    """
    def fold_group(group: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(group["data"].iloc[0], dtype).copy()
        for data in group["data"].iloc[1:]:
            fold(total, np.frombuffer(data, dtype), out=total)
        return pd.DataFrame({"part": [group["part"].iloc[0]], "data": [total.tobytes()]})

    some = rows.select("part", "data", F.pmod(F.xxhash64("data"), F.lit(64)).alias("slot"))
    some = some.groupBy("part", "slot").applyInPandas(fold_group, "part int, data binary")
    out = np.zeros(size, dtype)
    for row in some.groupBy("part").applyInPandas(fold_group, "part int, data binary").collect():  # the chunks of one array of fixed size
        got = np.frombuffer(row["data"], dtype)
        out[row["part"] * CHUNK : row["part"] * CHUNK + len(got)] = got
    return out


def members(ids: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """A bitmap of fixed size that holds every id of ``ids`` (two hash positions each).

    It may let other ids through, so an exact join follows; its size never grows with the input.
    """
    def mark(batches):
        seen = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            for at in bitmap_positions(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits):
                np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        got = list(sketch_rows(seen))
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], ["part", "data"])

    rows = ids.select(F.col(column).cast("long").alias("id")).where("id IS NOT NULL").mapInArrow(mark, "part int, data binary")
    return gather_sketch(rows, 1 << (bits - 3), "uint8", np.bitwise_or)


def bitmap_positions(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mixed(ids * P1 + np.uint64(1))
    mask = np.uint64((1 << bits) - 1)
    return [(h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)]


def in_bitmap(ids: np.ndarray, seen: np.ndarray) -> np.ndarray:
    bits = int(len(seen) * 8).bit_length() - 1
    ok = np.ones(len(ids), bool)
    for at in bitmap_positions(ids, bits):
        ok &= (seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b), root being the smallest id reachable.

    Alternating large-star and small-star steps over the links, each round a written table; all
    steps are joins and minimum aggregates, so a node with very many links is split like any
    skewed key. Raises if it does not settle.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, edges = edges, stored(small)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        release(before)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
