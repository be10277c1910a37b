"""Exact top-k search by inner product in three phases with a uniform threshold.

Vectors hold integers. The dimensions are cut into blocks; a score is the sum of one partial score
for each block, so an entry that reaches a cutoff reaches cutoff / blocks in one block at least.

1. Every task gathers local score lists from a slice of its rows; the k-th best of what the tasks
   gathered is a safe cutoff for each query: the true k-th score cannot be lower.
2. The cutoffs go to all tasks, which collect every entry with a partial score at the uniform
   threshold cutoff / blocks.
3. The remaining blocks of these entries are resolved exactly, in integers, and the best k are kept.

Queries are a stated set and are met in blocks of bounded size; only one such block and its cutoffs
are broadcast at a time. Each task keeps k entries for a query at most, which loses nothing of the top k.

Defined cases: a vector that is null, or has a null or non-finite component, takes no part; the same
vec_id in several rows is so many candidates, none of which meets a query of that id; a query row
that is repeated gives one list; vectors of other lengths count as padded by zeros; ties go to the
smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

RESULT = "query_id long, vec_id long, score long"


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, padded by zeros to ``width``."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    out = np.zeros((len(column), width), np.int64)
    flat = np.asarray(column.flatten())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(column), width)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def best(score: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best entries of each query (query, vec_id, score), ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    start = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - start < k
    return query[keep], ids[keep], score[keep]


class Scorer:
    """Partial scores of batches of rows against one block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, blocks: int):
        self.ids, self.k, self.vectors = ids, k, vectors
        self.cuts = np.array_split(np.arange(vectors.shape[1]), blocks)
        self.top = float(np.abs(vectors).max(initial=0))

    def partial(self, rows: np.ndarray) -> list[np.ndarray]:
        """Exact products: in the narrowest of float32, float64 and int64 that cannot round."""
        bound = self.top * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        a, b = rows.astype(kind), self.vectors.astype(kind)
        return [a[:, c] @ b[:, c].T for c in self.cuts]

    def entries(self, ids: np.ndarray, rows: np.ndarray, cutoff: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """The best entries (query number, vec_id, score) of the rows; with a cutoff, only those that reach it."""
        parts = self.partial(rows)
        if cutoff is None:
            score = np.sum(parts, axis=0)
            at, q = np.divmod(np.arange(score.size), score.shape[1])
        else:
            threshold = np.ceil(cutoff / len(self.cuts))
            reached = parts[0] >= threshold
            for p in parts[1:]:
                reached |= p >= threshold
            at, q = np.nonzero(reached)
            score = sum(p[at, q].astype(np.int64) for p in parts)
            ok = score >= cutoff[q]
            at, q, score = at[ok], q[ok], score[ok]
        score = score.reshape(-1).astype(np.int64)
        ok = ids[at] != self.ids[q]
        return best(score[ok], ids[at[ok]], q[ok], self.k)


def scan(rows: DataFrame, held, width: int, k: int, blocks: int, slice_of: int = 1, step: int = 1024) -> DataFrame:
    """Entries of every task's rows, at most k of a query and task; ``slice_of`` n: of one row in n."""
    def run(batches):
        ids, vectors, cutoff = held.value
        scorer, found = Scorer(ids, vectors, k, blocks), None
        for b in batches:
            own, made = np.asarray(b.column(0), np.int64), matrix(b.column(1), width)
            if slice_of > 1:
                own, made = own[::slice_of], made[::slice_of]
            for i in range(0, len(own), step):
                got = scorer.entries(own[i : i + step], made[i : i + step], cutoff)
                found = got if found is None else best(np.concatenate([found[2], got[2]]), np.concatenate([found[1], got[1]]), np.concatenate([found[0], got[0]]), k)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[0]]), pa.array(found[1]), pa.array(found[2])], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, RESULT)


def ranked(entries: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, queries: DataFrame, k: int, blocks: int = 2, slice_of: int = 8, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest inner product for each query.

    ``rows`` and ``queries`` have vec_id and an integer array ``vector``. ``block_rows`` queries are met at a time.
    """
    spark = rows.sparkSession
    queries = stored(queries.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("vector").alias("vector")))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    n = queries.count()
    out = rows.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    if not n or not width:
        return out
    parts = -(-n // block_rows)
    for part in range(parts):
        # One block of queries at a time; its size is bounded by about twice block_rows.
        some = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).toArrow() if parts > 1 else queries.toArrow()
        if not some.num_rows:
            continue
        ids, vectors = np.asarray(some.column(0), np.int64), matrix(some.column(1).combine_chunks(), width)
        first = spark.sparkContext.broadcast((ids, vectors, None))
        cut = ranked(scan(rows, first, width, k, blocks, slice_of), k).where(F.col("rank") == k).select("query_id", "score").toArrow()
        at = pd.Series(np.asarray(cut.column(1), np.int64), index=np.asarray(cut.column(0), np.int64)).reindex(ids)
        cutoff = at.fillna(np.iinfo(np.int64).min // 4).to_numpy(np.int64)
        second = spark.sparkContext.broadcast((ids, vectors, cutoff))
        out = out.unionByName(ranked(scan(rows, second, width, k, blocks), k).select("query_id", "rank", "vec_id", "score"))
    return out


def integers(vectors: DataFrame, column: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, vector) with floor(scale * x) of every component, for usable vectors."""
    return vectors.where(usable(column)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("vector"))


def op3(spark, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where("vec_id IS NOT NULL"), rows.where("vec_id % 20 = 0"), 20)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op3_exact_top_k_search": op3}
ORACLES = {"op3_exact_top_k_search": SQL}
