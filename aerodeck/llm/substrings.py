"""Substring dedup: paragraph MinHash banding, exact verification, removals clustered by components.

Units are the paragraphs of a document (its lines) of at least ``least`` words, and windows of ``least`` words
that start at anchors. An anchor is the smallest word-run hash among any ``reach`` neighbours, so two
documents choose the same anchors in a passage they share, wherever it stands: a passage of
least + reach + k words or more always holds a common window. Windows are seeds: where a marked span begins or
ends with one, it is extended word by word, by up to reach - 1 words, as far as other documents go on alike; the
end of a passage is never farther from its last common window.

Equal units are one class. Unequal paragraphs meet by MinHash bands, tuned for a recall near 0.99 at the
similarity of the rule; colliding ones are verified by the exact Jaccard similarity of their
word runs, and components of verified links make the classes. The first occurrence of a class (smallest
doc_id, then place) is kept, all others are removals; what overlaps in a document is one span.

Defined cases: null and empty texts and paragraphs with fewer words have no paragraph unit; repetition inside
one document alone is no removal; rows without doc_id are left out; rows with the same doc_id are one
document; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import P1, WordHashes, components, in_bitmap, members, mixed, stored, table, windows
from .jaccard import Rule, length_band, link_rows, packed

UNITS = "doc_id long, start int, end int, unit long, n int, bands array<long>"
WORD = re.compile(r"\S+")


@dataclass(frozen=True)
class Settings:
    """``bands`` of ``rows`` MinHash values; ``least`` words of a unit; ``reach`` of an anchor."""

    bands: int = 9
    rows: int = 4
    least: int = 25
    reach: int = 20
    rule: Rule = Rule(5, 80, 100)


def tuned(similarity: float, rows: int, recall: float) -> int:
    """Number of bands that finds pairs of this similarity with this probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


class Cutter:
    """Units of one text after another."""

    def __init__(self, s: Settings):
        self.s, self.words = s, WordHashes()
        count = s.bands * s.rows
        self.factor = mixed(np.arange(1, count + 1, dtype=np.uint64) * P1) | np.uint64(1)

    def hashes(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of the text, and where its lines begin, as word numbers, with the end."""
        lines = [line.split() for line in (text or "").lower().split("\n")]
        return self.words.array([w for line in lines for w in line]), np.cumsum([0, *map(len, lines)])

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """Word numbers where windows start."""
        s = self.s
        if len(h) < s.least:
            return np.empty(0, np.int64)
        run = windows(h, s.rule.k)[: len(h) - s.least + 1]
        if len(run) <= s.reach:
            return np.array([int(run.argmin())])
        view = np.lib.stride_tricks.sliding_window_view(run, s.reach)
        return np.unique(view.argmin(axis=1) + np.arange(len(view)))

    def window_units(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start at ``at``."""
        words = h[at[:, None] + np.arange(self.s.least)]
        out = words[:, 0].copy()
        for i in range(1, self.s.least):
            out = out * P1 + words[:, i]
        return mixed(out + np.uint64(self.s.least)).view(np.int64)

    def paragraphs(self, h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(line)
        keep = size >= self.s.least
        return line[:-1][keep], line[1:][keep]

    def unit(self, h: np.ndarray, start: int, end: int) -> int:
        return xxhash.xxh3_64_intdigest(h[start:end].tobytes()) - (1 << 63)

    def band_hashes(self, run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One row of band hashes for each paragraph, from the hashes of all word runs of the text."""
        k, out = self.s.rule.k, []
        cuts = np.stack([starts, ends - k + 1], 1).ravel()
        run = np.append(run, np.uint64(0))
        for band in range(self.s.bands):
            value = np.full(len(starts), band + 1, np.uint64)
            for f in self.factor[band * self.s.rows : (band + 1) * self.s.rows]:
                least = np.minimum.reduceat(run * f, cuts)[::2]  # the runs are mixed already; an odd factor permutes them
                value = mixed(value * P1 + least)
            out.append(value)
        return np.stack(out, 1).view(np.int64)


def units(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, start, end, unit, n, bands) of all units; windows have no bands."""
    def run(batches):
        cutter = Cutter(s)
        for b in batches:
            ids, starts, ends, names, sizes, bands = [], [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, line = cutter.hashes(text)
                at = cutter.anchors(h)
                if not len(at):
                    continue
                window, run = cutter.window_units(h, at), windows(h, s.rule.k)
                p0, p1 = cutter.paragraphs(h, line)
                ids.append(np.full(len(at) + len(p0), doc, np.int64))
                starts += [at, p0]
                ends += [at + s.least, p1]
                names += [window, np.array([cutter.unit(h, x, y) for x, y in zip(p0, p1, strict=True)], np.int64)]
                sizes += [np.zeros(len(at), np.int32), np.array([len(np.unique(run[x : y - s.rule.k + 1])) for x, y in zip(p0, p1, strict=True)], np.int32)]
                bands += [None] * len(at)
                if len(p0):
                    bands += list(cutter.band_hashes(run, p0, p1))
            cat = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind))
            yield pa.RecordBatch.from_arrays([cat(ids, np.int64), cat(starts, np.int32), cat(ends, np.int32), cat(names, np.int64), cat(sizes, np.int32), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "start", "end", "unit", "n", "bands"])

    return picked(docs).mapInArrow(run, UNITS)


def picked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")


def paragraph_sets(docs: DataFrame, wanted: DataFrame, homes: DataFrame, s: Settings) -> DataFrame:
    """(doc, sig, text), stored, of the paragraphs whose unit is in ``wanted``; doc is the unit here.

    ``homes`` has one document of each unit; only those documents are cut again.
    """
    sc = docs.sparkSession.sparkContext
    seen = sc.broadcast(members(wanted, "doc"))
    at_home = sc.broadcast(members(homes.join(wanted.select(F.col("doc").alias("unit")), "unit", "left_semi"), "doc_id"))

    def run(batches):
        cutter, done = Cutter(s), set()
        for b in batches:
            names, texts = [], []
            b = b.filter(pa.array(in_bitmap(np.asarray(b.column(0), np.int64).view(np.uint64), at_home.value)))
            for text in b.column(1).to_pylist():
                h, line = cutter.hashes(text)
                p0, p1 = cutter.paragraphs(h, line)
                lines = [x for x in (text or "").lower().split("\n") if len(x.split()) >= s.least]
                name = np.array([cutter.unit(h, x, y) for x, y in zip(p0, p1, strict=True)], np.int64)
                for i in np.flatnonzero(in_bitmap(name.view(np.uint64), seen.value)):
                    if int(name[i]) not in done:
                        done.add(int(name[i]))
                        names.append(int(name[i]))
                        texts.append(packed(lines[i]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([0] * len(names), pa.int64()), pa.array(texts, pa.binary())], ["doc", "sig", "text"])

    made = picked(docs).mapInArrow(run, "doc long, sig long, text binary")
    out = stored(made.join(wanted.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"]))
    seen.destroy()
    at_home.destroy()
    return out


def in_units(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose unit is in ``wanted`` (and a few others), before any shuffle."""
    seen = rows.sparkSession.sparkContext.broadcast(members(wanted, "unit", 26))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(np.asarray(b.column(3), np.int64).view(np.uint64), seen.value)))

    return rows.mapInArrow(run, rows.schema)


def contexts(docs: DataFrame, ends: DataFrame, s: Settings) -> DataFrame:
    """(unit, side, doc_id, start, runs): of all windows whose unit is in ``ends`` (unit, side), one hash for
    each number of words before (side -1) or after (side 1), up to reach - 1 and the end of the text."""
    sc = docs.sparkSession.sparkContext
    seen = {side: sc.broadcast(members(ends.where(F.col("side") == side), "unit")) for side in (-1, 1)}

    def runs(h: np.ndarray, first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """For words from each of ``first`` on, one by one in a direction: running hashes, and how many words there are."""
        n = np.clip(first + 1 if step < 0 else len(h) - first, 0, s.reach - 1)
        value, out = np.ones(len(first), np.uint64), np.zeros((len(first), s.reach - 1), np.uint64)
        for i in range(s.reach - 1):
            value = mixed(value * P1 + h[np.clip(first + step * i, 0, len(h) - 1)])
            out[:, i] = value
        return out.view(np.int64), n

    def run(batches):
        cutter = Cutter(s)
        for b in batches:
            parts = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, _ = cutter.hashes(text)
                at = cutter.anchors(h)
                if not len(at):
                    continue
                name = cutter.window_units(h, at)
                for side, bits in seen.items():
                    i = np.flatnonzero(in_bitmap(name.view(np.uint64), bits.value))
                    if len(i):
                        beside, n = runs(h, at[i] - 1 if side < 0 else at[i] + s.least, side)
                        parts.append((name[i], np.full(len(i), side, np.int32), np.full(len(i), doc, np.int64), at[i].astype(np.int32), n, beside[np.arange(s.reach - 1) < n[:, None]]))
            if parts:
                unit, side, doc, start, n, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (unit, side, doc, start)), lists], ["unit", "side", "doc_id", "start", "runs"])

    made = picked(docs).mapInArrow(run, "unit long, side int, doc_id long, start int, runs array<long>")
    return made.join(ends, ["unit", "side"], "left_semi")


def extended(docs: DataFrame, marked: DataFrame, s: Settings) -> DataFrame:
    """Spans beyond the windows at the ends of the spans in ``marked`` (doc_id, start, end, unit, window, class_id, removed).

    Windows with the same words beside them are a class of their own, whose first occurrence is kept: of words
    that several documents share one copy always stays.
    """
    span = merged(marked.select("doc_id", "start", "end", "class_id", "removed"))
    window = marked.where("window")
    begins = window.join(span.select("doc_id", "removed", "start"), ["doc_id", "removed", "start"], "left_semi").select("unit", F.lit(-1).alias("side"))
    stops = window.join(span.select("doc_id", "removed", "end"), ["doc_id", "removed", "end"], "left_semi").select("unit", F.lit(1).alias("side"))
    beside = stored(contexts(docs, stored(begins.union(stops).distinct()), s).withColumns({"n": F.size("runs"), "whole": F.try_element_at("runs", F.lit(-1))}))
    # Occurrences with the same words beside them are one context; running hashes name it by its length and last one.
    name = ["unit", "side", "n", "whole"]
    context = beside.groupBy(*name).agg(F.min(F.struct("doc_id", "start")).alias("lo"), F.max("doc_id").alias("hi"), F.any_value("runs").alias("runs"))
    each = context.select(*name, "lo", "hi", F.posexplode("runs").alias("i", "run"))
    first = each.groupBy("unit", "side", "i", "run").agg(F.min("lo").alias("first"), F.max("hi").alias("top")).where("top <> first.doc_id")
    met = each.select(*name, "i", "run").join(first.drop("top"), ["unit", "side", "i", "run"])
    # With more words a class only gets smaller, so its first occurrence is the first of all longer ones it is in:
    # an occurrence is removed up to some number of words, and kept beyond if it is the first of the longest class.
    levels = met.groupBy(*name).agg(F.sort_array(F.collect_list(F.struct("i", "first")), asc=False).alias("l"))  # at most reach - 1
    last = F.col("l")[0]
    ends = levels.select(*name, last.alias("one"), F.get(F.filter("l", lambda x: x["first"] != last["first"]), F.lit(0)).alias("other"))
    here = F.struct("doc_id", "start")
    kept = F.struct(F.lit(False).alias("removed"), F.col("one.i").alias("i"), F.col("one.first").alias("first"))
    gone = F.struct(F.lit(True).alias("removed"), F.col("one.i").alias("i"), F.col("one.first").alias("first"))
    other = F.struct(F.lit(True).alias("removed"), F.col("other.i").alias("i"), F.col("other.first").alias("first"))
    both = beside.drop("runs").join(ends, name).withColumn("first", here == F.col("one.first"))
    far = both.select("unit", "side", "doc_id", "start", F.explode(F.when(~F.col("first"), F.array(gone)).when(F.col("other").isNull(), F.array(kept)).otherwise(F.array(kept, other))).alias("e"))
    far = far.select("side", "doc_id", "start", "e.removed", (F.col("e.i") + 1).alias("n"), F.col("e.first.doc_id").alias("class_id"))
    left, end = F.col("side") < 0, F.col("start") + s.least
    return far.select("doc_id", F.when(left, F.col("start") - F.col("n")).otherwise(F.col("start")).alias("start"), F.when(left, end).otherwise(end + F.col("n")).alias("end"), "class_id", "removed")


def repeated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, start, end, class_id, removed): merged spans of words (numbers, half-open) of classes that
    occur in several documents; class_id is the smallest doc_id of the class of the first unit."""
    every = stored(units(docs, s))
    paragraphs = every.where("bands IS NOT NULL")
    homes = stored(paragraphs.select("unit", "n", "bands", "doc_id").dropDuplicates(["unit"]))
    once = homes.select("unit", "n", F.explode("bands").alias("key"))
    shared = once.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    left = stored(once.join(shared, "key").select("key", F.col("unit").alias("doc"), F.lit(0).cast("long").alias("sig"), "n", F.lit(0).alias("pos"), length_band("n", s.rule).alias("band"), F.col("unit").alias("comp")))
    links = link_rows(left, lambda ids: paragraph_sets(docs, ids, homes.select("unit", "doc_id"), s), docs.sparkSession.createDataFrame([], "a long, b long"), s.rule)
    class_of = stored(components(links)).withColumnsRenamed({"id": "unit", "root": "root"})

    span = every.select("unit", "doc_id").groupBy("unit").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    classes = stored(span.where("lo <> hi").select("unit").union(class_of.select("unit")).distinct())
    some = in_units(every.select("doc_id", "start", "end", "unit", F.col("bands").isNull().alias("window")), classes).join(classes, "unit")
    some = stored(some.join(class_of, "unit", "left").select("doc_id", "start", "end", "unit", "window", F.coalesce("root", "unit").alias("class")))
    first = some.groupBy("class").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("hi")).where("hi <> first.doc_id")
    marked = stored(some.join(first, "class").select("doc_id", "start", "end", "unit", "window", F.col("first.doc_id").alias("class_id"), ((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))).alias("removed")))
    return merged(marked.select("doc_id", "start", "end", "class_id", "removed").union(extended(docs, marked, s)))


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document and kind as one: a span begins where none before reaches it."""
    by = W.partitionBy("doc_id", "removed").orderBy("start", "end")
    reached = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    begun = spans.distinct().withColumn("new", F.when(reached >= F.col("start"), 0).otherwise(1))
    numbered = begun.withColumn("span", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "removed", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("class_id").alias("class_id")).select("doc_id", "start", "end", "class_id", "removed")


def without_repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with the removals cut out of their texts."""
    cuts = repeated(docs, s).where("removed").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    names = docs.columns

    def run(batches):
        for b in batches:
            texts = b.column(names.index("text")).to_pylist()
            for i, spans in enumerate(b.column(len(names)).to_pylist()):
                if spans and texts[i]:
                    words = [m.span() for m in WORD.finditer(texts[i])]
                    for x in reversed(spans):
                        texts[i] = texts[i][: words[x["start"]][0]] + texts[i][words[x["end"] - 1][1] :]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(j) for j, n in enumerate(names)], names)

    both = docs.join(cuts.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left").select(*names, "_cuts")
    return both.mapInArrow(run, docs.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))


QUERIES = {"op10_substring_dedup": op10}
ORACLES: dict[str, str] = {}
