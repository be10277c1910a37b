"""Ranked lexical search by MaxScore with bounds of term pairs.

Forward index: one row per document with the terms it shares with the queries of a block, their counts and
its length; texts are cut once. Statistics N, L and df come from all documents.

Pair index: the terms of an item are ordered by their maximum score over all documents, and neighbours in
that order make pairs. For every pair the intersection of its two posting lists gives the joint maximum,
the highest sum of both scores in one document. A document with both terms cannot exceed it and one with a
single term cannot exceed that term's own maximum, so max(joint, single maxima) bounds the pair and is
never above the sum of the maxima. Bounds of the first j terms combine pairs and single terms at query
time, whichever way is lower: bound(j) = min(bound(j - 1) + max(j), bound(j - 2) + pair(j - 1, j)).

Search: the best documents of the pair intersections of each item, scored in full, give a cutoff that the
true k-th score cannot be below. Documents are then met in blocks of rows: only those in a posting list of an
essential term (one that the bounds cannot do without) are candidates, the other terms are looked up from
the highest bound down, and a candidate leaves as soon as its score so far plus the bound of the rest is
below the cutoff, which rises with what the task has found. All numbers are exact 64-bit integers.

Items are a stated set, met in blocks of bounded numbers of terms; a block's terms, maxima and cutoffs are
all that is broadcast or gathered, and each task keeps k entries an item.

Defined cases: a null text has no terms; documents without terms count nowhere; documents without id count
in the statistics and are never returned; rows with the same doc_id are documents of their own; of the rows
of a repeated item the smallest text counts, a null item_id is an item; items without terms, or whose terms
no document holds, give no rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, stored, table

#: Bytes that separate terms become spaces and A-Z small letters; all others stand for themselves.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK_DOCS, BLOCK_POSTINGS = 4_096, 1_000_000
BLOCK_TERMS = 200_000
ENTRY = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): of every document with terms, those of the vocabulary and their counts."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary = held.value
        ids, lengths, sizes, terms, tfs = [], [], [], [], []

        def flush():
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tfs)]
            batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
            for column in (ids, lengths, sizes, terms, tfs):
                column.clear()
            return batch

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                own = sorted((at, tf) for t, tf in Counter(found).items() if (at := vocabulary.get(t)) is not None)
                ids.append(doc_id)
                lengths.append(len(found))
                sizes.append(len(own))
                terms += [at for at, _ in own]
                tfs += [tf for _, tf in own]
                if len(terms) >= BLOCK_POSTINGS:
                    yield flush()
        yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    out = stored(texts.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>"))
    held.destroy()
    return out


@dataclass(frozen=True)
class Corpus:
    """N, L and the weight of every term of the vocabulary."""

    documents: int
    length: int
    weights: np.ndarray

    def impacts(self, terms: np.ndarray, tfs: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 90 + (90 * n * self.documents) // self.length
        return self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))


def corpus_of(index: DataFrame, size: int) -> Corpus:
    documents, length = index.agg(F.count("*"), F.sum("n")).first()
    df = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # a row for each term of the block
    held = np.zeros(size, np.int64)
    held[np.asarray(df.column(0), np.int64)] = np.asarray(df.column(1), np.int64)
    return Corpus(documents, length or 1, np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in held.tolist()], np.int64))


class Postings:
    """Posting lists of a block of documents: of each term the rows that hold it, and its score there."""

    def __init__(self, batch: pa.RecordBatch, corpus: Corpus):
        sizes = np.asarray(batch.column(2).value_lengths())
        self.ids = batch.column(0)
        self.returned = np.asarray(self.ids.is_valid())
        self.doc_ids = np.asarray(self.ids.fill_null(0), np.int64)
        terms, tfs = (np.asarray(batch.column(i).flatten(), np.int64) for i in (2, 3))
        rows = np.repeat(np.arange(len(sizes)), sizes)
        impacts = corpus.impacts(terms, tfs, np.asarray(batch.column(1), np.int64)[rows])
        order = np.argsort(terms, kind="stable")
        self.terms, start = np.unique(terms[order], return_index=True)
        self.rows = dict(zip(self.terms.tolist(), np.split(rows[order], start[1:]), strict=True)) if len(terms) else {}
        self.impacts = dict(zip(self.terms.tolist(), np.split(impacts[order], start[1:]), strict=True)) if len(terms) else {}
        self.size = len(sizes)

    def look_up(self, term: int, rows: np.ndarray) -> np.ndarray:
        """Scores of a term in ascending ``rows``, 0 where they lack it."""
        own = self.rows.get(term)
        if own is None:
            return np.zeros(len(rows), np.int64)
        at = np.minimum(np.searchsorted(own, rows), len(own) - 1)
        return np.where(own[at] == rows, self.impacts[term][at], 0)

    def meet(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The intersection list of two terms: rows, and the sums of both scores."""
        if a not in self.rows or b not in self.rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, x, y = np.intersect1d(self.rows[a], self.rows[b], assume_unique=True, return_indices=True)
        return rows, self.impacts[a][x] + self.impacts[b][y]


def blocks_of(batches, corpus: Corpus):
    """Blocks of BLOCK_DOCS documents at most, and of BLOCK_POSTINGS postings unless one document has more."""
    for b in batches:
        held, start = np.concatenate([[0], np.cumsum(np.asarray(b.column(2).value_lengths()))]), 0
        while start < b.num_rows:
            most = int(np.searchsorted(held, held[start] + BLOCK_POSTINGS, "right")) - 1
            stop = min(start + BLOCK_DOCS, max(start + 1, most), b.num_rows)
            yield Postings(b.slice(start, stop - start), corpus)
            start = stop


def term_maxima(index: DataFrame, corpus: Corpus) -> np.ndarray:
    """The highest score of every term in any document."""
    held = index.sparkSession.sparkContext.broadcast(corpus)

    def run(batches):
        top = np.zeros(len(held.value.weights), np.int64)
        for block in blocks_of(batches, held.value):
            for t in block.terms.tolist():
                top[t] = max(top[t], block.impacts[t].max())
        at = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(top[at])], ["t", "top"])

    got = index.mapInArrow(run, "t int, top long").groupBy("t").agg(F.max("top").alias("top")).toArrow()
    held.destroy()
    out = np.zeros(len(corpus.weights), np.int64)
    out[np.asarray(got.column(0), np.int64)] = np.asarray(got.column(1), np.int64)
    return out


def best(items: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, -score, items))
    items, ids, score = items[order], ids[order], score[order]
    keep = np.arange(len(items)) - np.searchsorted(items, items, "left") < k
    return items[keep], ids[keep], score[keep]


def entry_batch(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    item, ids, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names)


def pair_index(index: DataFrame, corpus: Corpus, items: list[list[int]], k: int, seeds: int = 3) -> tuple[dict[tuple[int, int], int], np.ndarray]:
    """Joint maxima of neighbouring terms of every item, and a safe cutoff for each item.

    The best documents of the ``seeds`` highest pairs of an item, k of each and block, are scored in full.
    """
    pairs = sorted({pair for terms in items for pair in zip(terms, terms[1:], strict=False)})
    held = index.sparkSession.sparkContext.broadcast((corpus, items, pairs, {p: i for i, p in enumerate(pairs)}))

    def run(batches):
        corpus, items, pairs, number = held.value
        joint, found = np.zeros(len(pairs), np.int64), []
        for block in blocks_of(batches, corpus):
            top = []
            for i, (a, b) in enumerate(pairs):
                rows, sums = block.meet(a, b)
                joint[i] = max(joint[i], sums.max(initial=0))
                rows, sums = rows[block.returned[rows]], sums[block.returned[rows]]
                top.append(rows[np.argpartition(-sums, k - 1)[:k]] if len(rows) > k else rows)
            for i, terms in enumerate(items):
                ends = [top[number[p]] for p in list(zip(terms, terms[1:], strict=False))[-seeds:]] or [block.rows.get(terms[0], np.zeros(0, np.int64))[:k]]
                rows = np.unique(np.concatenate(ends))
                rows = rows[block.returned[rows]]
                score = sum(block.look_up(t, rows) for t in terms)
                found.append(best(np.full(len(rows), i), block.doc_ids[rows], np.asarray(score, np.int64), k))
            if len(found) > 4 * len(items):
                found = [best(*(np.concatenate([f[j] for f in found]) for j in range(3)), k)]
        if found:
            found = [best(*(np.concatenate([f[j] for f in found]) for j in range(3)), k)]
        at = np.flatnonzero(joint)
        yield entry_batch([*found, (np.full(len(at), -1), at, joint[at])], ["item", "doc_id", "score"])

    made = stored(index.mapInArrow(run, ENTRY))
    held.destroy()
    tops = made.where("item < 0").groupBy("doc_id").agg(F.max("score").alias("score")).toArrow()  # a row for each pair
    joint = dict.fromkeys(pairs, 0) | {pairs[i]: x for i, x in zip(tops.column(0).to_pylist(), tops.column(1).to_pylist(), strict=True)}
    cut = ranked(made.where("item >= 0"), k).where(F.col("rank") == k).select("item", "score").toArrow()  # a row for each item
    release(made)
    cutoff = np.ones(len(items), np.int64)
    cutoff[np.asarray(cut.column(0), np.int64)] = np.maximum(1, np.asarray(cut.column(1), np.int64))
    return joint, cutoff


def bounds(terms: list[int], maxima: np.ndarray, joint: dict[tuple[int, int], int]) -> list[int]:
    """bound(j) for j = 0 to all terms: what the first j can add to one document at most."""
    out = [0]
    for j, t in enumerate(terms):
        bound = out[j] + int(maxima[t])
        if j:
            before = terms[j - 1]
            bound = min(bound, out[j - 1] + max(joint[before, t], int(maxima[before]), int(maxima[t])))
        out.append(bound)
    return out


def matches(block: Postings, terms: list[int], bound: list[int], cutoff: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the block that reach the cutoff, and their scores."""
    # The first terms, as many as cannot reach the cutoff together, are not essential.
    free = next((j for j in range(len(terms), 0, -1) if bound[j] < cutoff), 0)
    total = np.zeros(block.size, np.int64)
    for t in terms[free:]:
        if t in block.rows:
            total[block.rows[t]] += block.impacts[t]
    rows = np.flatnonzero((total + bound[free] >= cutoff) & (total > 0) & block.returned)
    score = total[rows]
    for j in range(free - 1, -1, -1):
        if not len(rows):
            break
        score = score + block.look_up(terms[j], rows)
        keep = score + bound[j] >= cutoff
        rows, score = rows[keep], score[keep]
    return rows, score


def searched(index: DataFrame, corpus: Corpus, items: list[list[int]], bound: list[list[int]], cutoff: np.ndarray, k: int) -> DataFrame:
    held = index.sparkSession.sparkContext.broadcast((corpus, items, bound, cutoff))

    def run(batches):
        corpus, items, bound, cutoff = held.value
        cutoff, found = cutoff.copy(), [(np.zeros(0, np.int64),) * 3 for _ in items]
        for block in blocks_of(batches, corpus):
            for i, terms in enumerate(items):
                rows, score = matches(block, terms, bound[i], int(cutoff[i]))
                if len(rows):
                    new = (np.full(len(rows), i), block.doc_ids[rows], score)
                    found[i] = best(*(np.concatenate(p) for p in zip(found[i], new, strict=True)), k)
                    if len(found[i][0]) == k:
                        cutoff[i] = max(cutoff[i], found[i][2][-1])
        yield entry_batch(found, ["item", "doc_id", "score"])

    out = stored(ranked(index.mapInArrow(run, ENTRY), k))
    held.destroy()
    return out


def ranked(entries: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    once = items.groupBy("item_id").agg(F.min("text").alias("text"))
    some = stored(once.select("item_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")))
    size, kind = some.agg(F.sum("size")).first()[0] or 0, dict(items.dtypes)["item_id"]
    parts, results = -(-size // (8 * block_terms)), []  # terms of about 8 bytes with repeats: an upper bound for those of a block
    for part in range(parts):
        got = some.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).select("item_id", "text").toArrow()
        texts = [(i, sorted(set(terms_of(t)))) for i, t in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)]
        texts = [x for x in texts if x[1]]
        if not texts:
            continue
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in texts for t in terms}))}
        index = forward(docs, vocabulary)
        corpus = corpus_of(index, len(vocabulary))
        maxima = term_maxima(index, corpus)
        asked = [sorted((vocabulary[t] for t in terms), key=lambda t: (maxima[t], t)) for _, terms in texts]
        joint, cutoff = pair_index(index, corpus, asked, k)
        found = searched(index, corpus, asked, [bounds(t, maxima, joint) for t in asked], cutoff, k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(texts)], f"item int, item_id {kind}")
        results.append(stored(found.join(names, "item").select("item_id", "rank", "doc_id", "score")))
        release(index)
        release(found)
    release(some)
    shape = f"item_id {kind}, rank int, doc_id long, score long"
    return spark.read.schema(shape).parquet(*[r.stored_at for r in results]) if results else spark.createDataFrame([], shape)


def op11(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH folded AS (SELECT doc_id, row_number() OVER () AS r, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM folded),
counts AS (SELECT doc_id, r, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT r, count(*) AS n FROM words GROUP BY r),
total AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0 * nn + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term, nn),
items AS (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
scored AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) AS BIGINT) AS score
           FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (r), total WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id, r),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""

QUERIES = {"op11_ranked_lexical_search": op11}
ORACLES = {"op11_ranked_lexical_search": SQL}
