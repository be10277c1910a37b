"""Ordered scans (rank, lag, lead, running sum, fill-forward) that survive hot keys.

Small inputs use one ordinary window. When a key may hold more rows than one task should
see, the rows are range-partitioned on (keys, order), fixed by a checkpoint, scanned chunk
by chunk, and the few keys that straddle chunk borders get their carries from a summary of
at most two rows per chunk. Both ways give the same rows; sums of doubles may differ in
their last digits.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import c

HOT_ROWS = 5_000_000
SMALL_BYTES = 256 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; one is made on local masters only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage; the cluster names the shared folder."""
    shared_folder(df.sparkSession)
    input_bytes(df)
    return df.checkpoint()


_read = {"bytes": 0}


def input_bytes(df: DataFrame) -> int:
    """Upper bound of the bytes of the tables a result is made from; runs no job.

    Sizes behind joins are products of guesses, so only the leaves count. A checkpointed
    leaf stands for everything read before it.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName().startswith("Scan ExistingRDD") or "RDD" in leaf.nodeName():
            total += _read["bytes"]
        else:
            total += int(leaf.stats().sizeInBytes())
    _read["bytes"] = max(_read["bytes"], min(total, 1 << 62))
    return total


def has_hot_key(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> bool:
    """True if a key may exceed ``hot_rows``; counts only when the inputs are not small."""
    if hot_rows >= HOT_ROWS and input_bytes(df) < SMALL_BYTES:
        return False
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (top or 0) > hot_rows


def rank():
    return ("rank", None)


def lag(v):
    return ("lag", c(v))


def lead(v):
    return ("lead", c(v))


def running(v):
    """Sum of ``v`` up to and including the row."""
    return ("sum", c(v))


def fill(v):
    """Last non-null ``v`` up to and including the row."""
    return ("fill", c(v))


def _plain(spec, keys, order) -> Column:
    kind, v = spec
    w = W.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return {"rank": lambda: F.row_number().over(w), "lag": lambda: F.lag(v).over(w),
            "lead": lambda: F.lead(v).over(w), "sum": lambda: F.sum(v).over(upto),
            "fill": lambda: F.last(v, ignorenulls=True).over(upto)}[kind]()


def scan(df: DataFrame, keys: list[str], order: list, *, hot_rows: int = HOT_ROWS, chunks: int | None = None,
         hot: bool | None = None, **specs) -> DataFrame:
    """Add one column per spec, computed per key in ascending ``order`` (a unique order).

    ``hot`` says whether a key is hot, where the caller knows, so that rows are not counted again.
    """
    if not (has_hot_key(df, keys, hot_rows) if hot is None else hot):
        return df.select("*", *[_plain(s, keys, order).alias(n) for n, s in specs.items()])

    order = [c(o) for o in order]
    n = chunks or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = df.columns
    named = df.select("*", *[o.alias(f"_o{i}") for i, o in enumerate(order)],
                      *[s[1].alias(f"_v_{k}") for k, s in specs.items() if s[1] is not None])
    ordcols = [f"_o{i}" for i in range(len(order))]
    parts = durable(named.repartitionByRange(n, *keys, *ordcols).withColumn("_chunk", F.spark_partition_id()))

    inner = ["_chunk", *keys]

    def same(prefix: str) -> Column:
        """Equality of chunk and keys; a null key is a key like any other."""
        return reduce(lambda p, q: p & q, [F.col(n).eqNullSafe(F.col(f"{prefix}{n}")) for n in inner])

    src = {k: (s[0], F.col(f"_v_{k}") if s[1] is not None else None) for k, s in specs.items()}
    local = parts.select("*", *[_plain(s, inner, ordcols).alias(f"_l_{k}") for k, s in src.items()],
                         _plain(rank(), inner, ordcols).alias("_rn"))

    # Only the first and the last key of a chunk can straddle a border: <= 2 rows a chunk.
    key = F.struct(*keys)
    edges = (parts.groupBy("_chunk").agg(F.min(key).alias("a"), F.max(key).alias("z"))
             .select("_chunk", F.explode(F.array_distinct(F.array("a", "z"))).alias("k")).select("_chunk", "k.*"))
    pos = F.struct(*ordcols)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for k, (kind, v) in src.items():
        if kind == "sum":
            aggs.append(F.sum(v).alias(f"_s_{k}"))
        elif kind == "lag":
            aggs.append(F.max_by(F.struct(v.alias("v")), pos).alias(f"_s_{k}"))
        elif kind == "lead":
            aggs.append(F.min_by(F.struct(v.alias("v")), pos).alias(f"_s_{k}"))
        elif kind == "fill":
            aggs.append(F.max_by(v, F.when(v.isNotNull(), pos)).alias(f"_s_{k}"))
    summary = parts.join(F.broadcast(edges.withColumnsRenamed({n: f"_e_{n}" for n in inner})), same("_e_"), "left_semi").groupBy(*inner).agg(*aggs)
    w = W.partitionBy(*keys).orderBy("_chunk")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    carry = []
    for k, (kind, _) in src.items():
        s = F.col(f"_s_{k}") if kind != "rank" else F.col("_n")
        carry.append({"rank": lambda s=s: F.sum(s).over(before), "sum": lambda s=s: F.sum(s).over(before),
                      "lag": lambda s=s: F.lag(s).over(w)["v"], "lead": lambda s=s: F.lead(s).over(w)["v"],
                      "fill": lambda s=s: F.last(s, ignorenulls=True).over(before)}[kind]().alias(f"_c_{k}"))
    carries = summary.select(*[F.col(n).alias(f"_k_{n}") for n in inner], "_n", *carry)
    joined = local.join(F.broadcast(carries), same("_k_"), "left")
    out = []
    for k, (kind, _) in src.items():
        loc, car = F.col(f"_l_{k}"), F.col(f"_c_{k}")
        if kind == "rank":
            out.append((loc + F.coalesce(car, F.lit(0))).cast("int").alias(k))
        elif kind == "sum":
            out.append(F.when(car.isNull(), loc).otherwise(car + F.coalesce(loc, F.lit(0))).alias(k))
        elif kind == "lag":
            out.append(F.when(F.col("_rn") == 1, car).otherwise(loc).alias(k))
        elif kind == "lead":
            out.append(F.when(F.col("_rn") == F.col("_n"), car).otherwise(loc).alias(k))
        else:
            out.append(F.coalesce(loc, car).alias(k))
    return joined.select(*base, *out)


def beside(df: DataFrame, keys: list[str], hot: bool, **aggs: Column) -> DataFrame:
    """Add aggregates of each key to its rows: in a window, or joined back where a key is hot. Null keys are keys."""
    if not hot:
        return df.select("*", *[v.over(W.partitionBy(*keys)).alias(n) for n, v in aggs.items()])
    total = df.groupBy(*keys).agg(*[v.alias(n) for n, v in aggs.items()]).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(total, on).drop(*[f"_k_{k}" for k in keys])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest in ``order``; map-side combined, so hot keys are harmless."""
    rest = [n for n in df.columns if n not in keys and n not in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def top_k(df: DataFrame, keys: list[str], order: list, k: int, salts: int = 16) -> DataFrame:
    """First ``k`` rows of each key: ranked inside salted slices, then over the k*salts survivors."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    cut = salted.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col("_rn") <= k)
    return (cut.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .filter(F.col("_rn") <= k).withColumnRenamed("_rn", "rank").drop("_salt"))
