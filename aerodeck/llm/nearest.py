"""Approximate nearest neighbours by an adaptive scan of dimensions within probed lists.

Index: vectors are dealt to the lists of a k-means fit and turned by one random rotation, after which
any leading dimensions are a fair sample of a distance. Each index row holds up to ``BLOCK`` vectors of
one list as column blocks of ``STEP`` rotated dimensions. Every row of the table is indexed; only the
fit (centroids, number of probed lists) reads a sample of about ``SAMPLE`` vectors.

Search: a query probes the lists whose centroids are nearest. Of each it adds up one column block after
the other and tests after each whether the partial distance over d dimensions, scaled to all D, exceeds
the distance to beat by more than chance allows, sqrt(D / d * partial) > (1 + eps / sqrt(d)) * cutoff;
such candidates are abandoned. Those that stay get their exact distance on the original vectors. The
first cutoff of a query comes from its nearest list alone, and falls as the scan goes on.

The number of probed lists is the smallest that reaches the wanted recall for queries of the sample, so
clustered vectors probe few lists and vectors without structure probe most. Queries are a stated set,
met in blocks of bounded size in the order of their nearest lists; only such a block is broadcast.

Defined cases: a vector that is null or all zeros, or has a null or non-finite component, takes no part,
nor does a row without id; the same vec_id in several rows is so many candidates, none of which meets a
query of that id; of the rows of a repeated query the smallest vector counts; vectors of other lengths
count as padded by zeros; ties go to the smaller vec_id; with fewer candidates than k all found are
given; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, stored, table

SAMPLE = 16_384
BLOCK = 2_048
STEP = 16
HELD_BYTES = 64 << 20
RESULT = "query_id long, vec_id long, score double"
INDEX = "list int, vec_ids binary, raw binary, columns array<binary>"


@dataclass(frozen=True)
class Fit:
    """What all tasks share: dimensions, rotation, centroids of the rotated vectors, lists to probe."""

    width: int
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.rotation).astype(np.float32)

    def nearest_lists(self, turned: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each vector, nearest first."""
        d = (self.centroids**2).sum(1)[None] - 2 * turned @ self.centroids.T
        return np.argsort(d, 1, kind="stable")[:, :n].astype(np.int32)


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as doubles, padded by zeros to ``width``."""
    lengths = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = np.asarray(column.flatten())
    return out


def kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids, from the first ``k`` of distinct rows in random order."""
    rows = np.random.default_rng(7).permutation(np.unique(rows, axis=0))
    centroids = rows[:k].copy()
    for _ in range(rounds):
        of = ((centroids**2).sum(1)[None] - 2 * rows @ centroids.T).argmin(1)
        sums, counts = np.zeros_like(centroids, np.float64), np.bincount(of, minlength=len(centroids))
        np.add.at(sums, of, rows)
        centroids[counts > 0] = (sums[counts > 0] / counts[counts > 0, None]).astype(centroids.dtype)
    return centroids


def tuned_probes(fit: Fit, rows: np.ndarray, k: int, recall: float) -> int:
    """Fewest lists that hold ``recall`` of the k nearest of each of 256 rows of the sample."""
    rows = np.unique(rows, axis=0)
    some = np.random.default_rng(9).permutation(len(rows))[:256]
    d = (rows[some] ** 2).sum(1)[:, None] + (rows**2).sum(1)[None] - 2 * rows[some] @ rows.T
    d[np.arange(len(some)), some] = np.inf
    k = min(k, len(rows) - 1)
    if k < 1:
        return 1
    near = np.argpartition(d, k - 1, 1)[:, :k]
    of, order = fit.nearest_lists(rows, 1)[:, 0], fit.nearest_lists(rows[some], len(fit.centroids))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1], dtype=rank.dtype)[None], 1)
    needed = np.sort(np.take_along_axis(rank, of[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def fitted(vectors: DataFrame, k: int, recall: float) -> Fit | None:
    """The fit, from about ``SAMPLE`` rows at most drawn by a hash of their ids."""
    n, width = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return None
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 20)) < (1 << 20) * min(1.0, SAMPLE / n)).limit(2 * SAMPLE)
    rows = matrix(drawn.select("vector").toArrow().column(0).combine_chunks(), width)  # bounded by 2 * SAMPLE
    rotation = np.linalg.qr(np.random.default_rng(5).standard_normal((width, width)))[0]
    turned = (rows @ rotation).astype(np.float32)
    lists = int(np.clip(n // BLOCK, 4, 1024))
    centroids = kmeans(turned, lists) if len(turned) else np.zeros((1, width), np.float32)
    fit = Fit(width, rotation, centroids, 1)
    return Fit(width, rotation, centroids, tuned_probes(fit, turned, k, recall) if len(turned) else 1)


def index_rows(ids: np.ndarray, vectors: np.ndarray, fit: Fit, raw: np.dtype):
    """Index rows of some vectors: cut list by list, rotated dimensions in column blocks."""
    turned = fit.turned(vectors)
    of = fit.nearest_lists(turned, 1)[:, 0]
    order = np.argsort(of, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        for i in range(0, len(at), BLOCK):
            some = at[i : i + BLOCK]
            columns = [np.ascontiguousarray(turned[some, j : j + STEP]).tobytes() for j in range(0, fit.width, STEP)]
            yield int(of[some[0]]), ids[some].tobytes(), vectors[some].astype(raw).tobytes(), columns


def indexed(vectors: DataFrame, fit: Fit) -> DataFrame:
    """The index: each task cuts what it reads, up to HELD_BYTES at a time, so no list meets in one task."""
    held = vectors.sparkSession.sparkContext.broadcast(fit)
    raw = raw_type(vectors)

    def run(batches):
        fit, ids, rows = held.value, [], []
        most = max(1, HELD_BYTES // (12 * fit.width))

        def flush():
            for got in index_rows(np.concatenate(ids), np.concatenate(rows), fit, raw):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(got, [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary())], strict=True)], ["list", "vec_ids", "raw", "columns"])
            ids.clear()
            rows.clear()

        for b in batches:
            for i in range(0, b.num_rows, most):
                part = b.slice(i, most)
                ids.append(np.asarray(part.column(0), np.int64))
                rows.append(matrix(part.column(1), fit.width))
                if sum(map(len, ids)) >= most:
                    yield from flush()
        if ids:
            yield from flush()

    out = stored(vectors.select("vec_id", "vector").mapInArrow(run, INDEX))
    held.destroy()
    return out


def raw_type(vectors: DataFrame) -> np.dtype:
    kind = dict(vectors.dtypes)["vector"]
    return np.dtype(np.float32 if kind == "array<float>" else np.float64)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest entries of each query, ties to the smaller id."""
    order = np.lexsort((ids, score, query))
    query, ids, score = query[order], ids[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
    return query[keep], ids[keep], score[keep]


class Scanner:
    """Scans index rows for one block of queries and keeps the k best entries of each."""

    def __init__(self, fit: Fit, ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, cutoff: np.ndarray, k: int, eps: float):
        self.ids, self.vectors, self.cutoff, self.k, self.eps = ids, vectors, cutoff.copy(), k, eps
        self.turned = fit.turned(vectors)
        self.width = fit.width
        self.probing = [np.flatnonzero((lists == i).any(1)) for i in range(len(fit.centroids))]
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def survivors(self, asked: np.ndarray, ids: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that no test abandons."""
        first = columns[0]
        q = self.turned[asked, : first.shape[1]]
        whole = (q**2).sum(1)[:, None] + (first**2).sum(1)[None] - 2 * q @ first.T
        at_q, at_x = np.nonzero((whole <= self.reach(first.shape[1], asked)[:, None]) & (ids[None] != self.ids[asked][:, None]))
        partial, done = whole[at_q, at_x], first.shape[1]
        for c in columns[1:]:
            partial = partial + ((self.turned[asked[at_q], done : done + c.shape[1]] - c[at_x]) ** 2).sum(1)
            done += c.shape[1]
            keep = partial <= self.reach(done, asked[at_q])
            at_q, at_x, partial = at_q[keep], at_x[keep], partial[keep]
        return asked[at_q], at_x

    def reach(self, done: int, asked: np.ndarray) -> np.ndarray:
        """Largest partial squared distance over ``done`` dimensions that is not abandoned."""
        slack = 1 + self.eps / np.sqrt(done) if done < self.width else 1.0
        return (self.cutoff[asked] * slack) ** 2 * done / self.width * (1 + 1e-4) + 1e-5

    def scan(self, ids: np.ndarray, raw: np.ndarray, columns: list[np.ndarray], of: int) -> None:
        step = max(1, (4 << 20) // max(1, len(ids)))
        for i in range(0, len(self.probing[of]), step):
            q, x = self.survivors(self.probing[of][i : i + step], ids, columns)
            for j in range(0, len(q), 65_536):
                qs, xs = q[j : j + 65_536], x[j : j + 65_536]
                gap = self.vectors[qs] - raw[xs].astype(np.float64)
                score = np.sqrt(np.add.accumulate(gap * gap, 1)[:, -1])  # added from the left, as a plain loop does
                near = score <= self.cutoff[qs]
                self.keep(qs[near], ids[xs[near]], score[near])

    def keep(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if len(q):
            self.found = best(*(np.concatenate(p) for p in zip(self.found, (q, ids, score), strict=True)), self.k)
            at, n = np.unique(self.found[0], return_counts=True)
            last = self.found[2][np.cumsum(n) - 1]
            full = n == self.k
            self.cutoff[at[full]] = np.minimum(self.cutoff[at[full]], last[full])


def scanned(index: DataFrame, held, lists: list[int], raw: np.dtype) -> DataFrame:
    """At most k entries of a query and task, from the index rows of ``lists``."""
    def run(batches):
        fit, ids, *rest = held.value
        scanner = Scanner(fit, ids, *rest)
        for b in batches:
            for of, own, vectors, columns in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.frombuffer(own, np.int64)
                n = len(own)
                scanner.scan(own, np.frombuffer(vectors, raw).reshape(n, -1), [np.frombuffer(c, np.float32).reshape(n, -1) for c in columns], of)
        q, near, score = scanner.found
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(near), pa.array(score)], ["query_id", "vec_id", "score"])

    return index.where(F.col("list").isin(lists)).mapInArrow(run, RESULT)


def ranked(entries: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.98, eps: float = 2.1, block_rows: int = 4096, fit: Fit | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k nearest rows of each query by Euclidean distance.

    ``rows`` and ``queries`` have vec_id and an array ``vector`` of floats or doubles.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("vec_id").isNotNull() & usable("vector"))
    fit = fit or fitted(rows, k, recall)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if fit is None:
        return empty
    raw, index = raw_type(rows), indexed(rows, fit)
    queries = queries.where(F.col("vec_id").isNotNull() & usable("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    homed = stored(with_home(queries, fit))
    counts = sorted((r["home"], r["count"]) for r in homed.groupBy("home").count().collect())  # a row for each of at most 1,024 lists
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    parts = -(-before[-1] // block_rows)
    spans = spark.createDataFrame([(home, start, n) for (home, n), start in zip(counts, before, strict=False)], "home int, start long, n long")
    blocks = homed.join(spans, "home").withColumn("block", F.floor((F.col("start") + F.pmod(F.xxhash64("vec_id"), "n")) / block_rows))
    results = []
    for part in range(parts):
        # Queries of the same or neighbouring lists make a block, of about block_rows.
        some = blocks.where(F.col("block") == part)
        got = some.select("vec_id", "vector").toArrow()
        if not got.num_rows:
            continue
        ids, vectors = np.asarray(got.column(0), np.int64), matrix(got.column(1).combine_chunks(), fit.width)
        lists = fit.nearest_lists(fit.turned(vectors), fit.probes)
        far = np.full(len(ids), np.inf)
        first = spark.sparkContext.broadcast((fit, ids, vectors, lists[:, :1], far, k, eps))
        cut = ranked(scanned(index, first, np.unique(lists[:, 0]).tolist(), raw), k).where(F.col("rank") == k).select("query_id", "score").toArrow()
        at = {q: s for q, s in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True)}
        cutoff = np.array([at.get(q, np.inf) for q in ids.tolist()])
        second = spark.sparkContext.broadcast((fit, ids, vectors, lists, cutoff, k, eps))
        results.append(stored(ranked(scanned(index, second, np.unique(lists).tolist(), raw), k)))
        first.destroy()
        second.destroy()
    release(index)
    release(homed)
    return spark.read.schema(empty.schema).parquet(*[r.stored_at for r in results]) if results else empty


def with_home(queries: DataFrame, fit: Fit) -> DataFrame:
    """``queries`` with the nearest list of each."""
    held = queries.sparkSession.sparkContext.broadcast(fit)
    kind = dict(queries.dtypes)["vector"]

    def run(batches):
        for b in batches:
            home = held.value.nearest_lists(held.value.turned(matrix(b.column(1), held.value.width)), 1)[:, 0] if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home)], ["vec_id", "vector", "home"])

    return queries.mapInArrow(run, f"vec_id long, vector {kind}, home int")


def vectors_of(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("vector"))


def op13(spark, sf_dir: str) -> DataFrame:
    rows = vectors_of(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.where("vec_id % 100 = 0"))


QUERIES = {"op13_approximate_nearest_neighbours": op13}
ORACLES: dict[str, str] = {}
