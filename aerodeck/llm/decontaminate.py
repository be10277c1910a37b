"""Benchmark decontamination by greedy string tiling over joined shared-token seeds.

Karp-Rabin hashes of all runs of ``k`` words of documents and benchmark items are compared through an
equi-join on the hash; a bitmap of fixed size keeps document runs that no item holds out of the
shuffle. Of each (document, item) pair with enough shared runs, the matched runs are extended along
their diagonals and the longest non-overlapping ones are marked as tiles, again and again, until none
of ``k`` words is left. The share of the item's words under tiles is its coverage, so passages whose
parts were moved around are found as well as whole ones.

Words are lower-cased runs of letters and digits, so punctuation and line breaks do not hide a copy.

Defined cases: null and empty texts, on either side, match nothing; an item with fewer than ``k`` words is
one run of its own length; items with the same text are all reported; repeated rows (same doc_id) count as
one document if their texts are equal, and else each pair is judged on the union of its runs; rows
without doc_id or item_id are never reported; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, in_bitmap, members, stored, table, windows

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Rule:
    """``k``: words of the shortest tile; ``coverage``: share of an item's words that must be tiled."""

    k: int = 5
    coverage: float = 0.8


def word_hashes(text: str | None, words: WordHashes) -> np.ndarray:
    return words.array(WORD.findall((text or "").lower()))


def item_runs(items: DataFrame, k: int) -> DataFrame:
    """(item_id, words, width, at, run): the runs of every item; width is k, or all words if fewer."""
    def run(batches):
        words = WordHashes()
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = word_hashes(text, words)
                width = min(k, len(h))
                rows += [(item, len(h), width, at, int(r)) for at, r in enumerate(windows(h, k).view(np.int64))]
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "words", "width", "at", "run"), r, strict=True)) for r in rows], SCHEMA)

    picked = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "item_id long, words int, width int, at int, run long")


SCHEMA = pa.schema([("item_id", pa.int64()), ("words", pa.int32()), ("width", pa.int32()), ("at", pa.int32()), ("run", pa.int64())])


def document_runs(docs: DataFrame, seen, widths: list[int]) -> DataFrame:
    """(doc_id, pos, run): the runs of whole texts that the bitmap of item runs lets through."""
    def run(batches):
        words, bitmap = WordHashes(), seen.value
        for b in batches:
            ids, pos, runs = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = word_hashes(text, words)
                for width in widths:
                    if len(h) < width:
                        continue
                    r = windows(h, width)
                    at = np.flatnonzero(in_bitmap(r, bitmap))
                    if len(at):
                        ids.append(np.full(len(at), doc, np.int64))
                        pos.append(at.astype(np.int32))
                        runs.append(r[at].view(np.int64))
            join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0, kind))
            yield pa.RecordBatch.from_arrays([join(ids, np.int64), join(pos, np.int32), join(runs, np.int64)], ["doc_id", "pos", "run"])

    picked = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, pos int, run long")


def tiles(pos: np.ndarray, at: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of one pair from its matched runs (pos in the document, at in the item).

    Runs that follow one another on a diagonal are one maximal match. The longest is marked first; what
    a mark leaves of another match goes back if it still has ``width`` words.
    """
    order = np.lexsort((pos, pos - at))
    p, a = pos[order], at[order]
    fresh = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(p - a) != 0)])
    size = np.diff(np.r_[fresh, len(p)]) + width - 1
    heap = [(-int(n), int(p[i]), int(a[i])) for i, n in zip(fresh, size, strict=True)]
    heapq.heapify(heap)
    in_doc, in_item, out = set(), set(), []
    while heap:
        n, x, y = heapq.heappop(heap)
        free = [x + i not in in_doc and y + i not in in_item for i in range(-n)]
        if all(free):
            out.append((x, y, -n))
            in_doc.update(range(x, x - n))
            in_item.update(range(y, y - n))
            continue
        start = None
        for i, ok in enumerate([*free, False]):
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                if i - start >= width:
                    heapq.heappush(heap, (start - i, x + start, y + start))
                start = None
    return sorted(out)


def tiled(group: pd.DataFrame) -> pd.DataFrame:
    """Coverage of one (document, item) pair."""
    first = group.iloc[0]
    found = tiles(group["pos"].to_numpy(np.int64), group["at"].to_numpy(np.int64), int(first["width"]))
    covered = sum(n for _, _, n in found)
    return pd.DataFrame({"doc_id": [int(first["doc_id"])], "item_id": [int(first["item_id"])], "item_words": [int(first["words"])], "covered_words": [covered],
                         "coverage": [covered / int(first["words"])], "tiles": [",".join(f"{x}:{y}:{n}" for x, y, n in found)]})


def contaminated(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per (document, item) pair whose coverage reaches the rule, with its tiles.

    A tile of n words holds n - k + 1 runs, so a pair needs a k-th of the covered words in distinct
    item positions; pairs below that are left before they are gathered.
    """
    held = stored(item_runs(items, rule.k))
    widths = sorted(r[0] for r in held.select("width").distinct().collect())  # at most k values
    seen = docs.sparkSession.sparkContext.broadcast(members(held, "run"))
    hits = stored(document_runs(docs, seen, widths).join(held, "run").select("doc_id", "item_id", "pos", "at", "words", "width").distinct())
    need = F.ceil(F.lit(rule.coverage) * F.col("words") / F.col("width") - F.lit(1e-9))
    enough = hits.groupBy("doc_id", "item_id", "words", "width").agg(F.count_distinct("at").alias("runs")).where(F.col("runs") >= need).select("doc_id", "item_id")
    found = hits.join(enough, ["doc_id", "item_id"]).groupBy("doc_id", "item_id").applyInPandas(tiled, "doc_id long, item_id long, item_words int, covered_words int, coverage double, tiles string")
    return found.where(F.col("coverage") >= F.lit(rule.coverage - 1e-9))


def decontaminate(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents that hold no benchmark item."""
    bad = contaminated(docs, items, rule).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_benchmark_decontamination": op2}
ORACLES: dict[str, str] = {}
