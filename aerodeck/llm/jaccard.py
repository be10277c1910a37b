"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

The n-grams of a document are ordered rarest first. Two sets that reach the threshold share an n-gram
among the first |x| - ceil(t |x|) + 1 of each, so only these prefixes are joined. Rarity is read from
a count sketch of fixed size over all documents: any common order gives the same pairs, the sketch
only decides how few candidates there are.

Equal sets are first linked to their smallest doc_id and stand for one another from then on. Candidate
pairs of a prefix n-gram are not all emitted: in each round every document meets one pivot of its
n-gram, verified links join components, and the next round only looks at n-grams that still hold
several components. Last, all remaining candidates in different components are met, so no link that
joins components is lost; pairs inside a component are not needed for it. A pair is verified once.

Before texts are fetched, a pair must pass a bound of its overlap: how many n-grams of each set fall in each of
32 parts of the range of hashes is kept with the set, and the sum of the smaller counts is never below the overlap.

Defined cases: a null text is empty; an empty document is linked with nothing; a text with fewer words
than n is one n-gram; rows with the same doc_id are one node; a row without doc_id takes no part in
links and has no component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHashes, components, gather_sketch, in_bitmap, members, release, sketch_rows, stored, table, windows

SKETCH = 1 << 17
PAIR = ["a", "a_sig", "b", "b_sig"]
SLICES = 32


@dataclass(frozen=True)
class Rule:
    """Two sets link when den * |x and y| >= num * |x or y|; sets hold distinct runs of ``k`` words."""

    k: int = 4
    num: int = 85
    den: int = 100

    def overlap(self, nx, ny):
        """Smallest intersection that reaches the threshold."""
        return -((-self.num * (nx + ny)) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        return n - -((-self.num * n) // self.den) + 1


def gram_set(text: str | None, words: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the word runs of a whole text; only A-Z are lower-cased."""
    return np.unique(windows(words.array((text or "").encode().lower().split()), k))


def signature(grams: np.ndarray) -> int:
    """One 64-bit hash of a whole set, as a signed number."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def sliced(grams: np.ndarray) -> list[int]:
    """How many n-grams fall in each of SLICES parts of the range of hashes."""
    return np.bincount((grams >> np.uint64(59)).astype(np.int64), minlength=SLICES).tolist()


def profiled(docs: DataFrame, rule: Rule) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, sig, slices) of every row, and how often n-grams of each sketch bucket occur in documents."""
    def run(batches):
        words, counts = WordHashes(), np.zeros(SKETCH, np.int64)
        for b in batches:
            n, sig, slices = [], [], []
            for text in b.column(1).to_pylist():
                grams = gram_set(text, words, rule.k)
                np.add.at(counts, (grams & np.uint64(SKETCH - 1)).astype(np.int64), 1)
                n.append(len(grams))
                sig.append(signature(grams) if len(grams) else None)
                slices.append(sliced(grams))
            nothing = [None] * len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(slices, pa.list_(pa.int32())), pa.array(nothing, pa.int32()), pa.array(nothing, pa.binary())], names)
        got = list(sketch_rows(counts))
        none = [pa.nulls(len(got), kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*none, pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], names)

    names = ["doc_id", "n", "sig", "slices", "part", "data"]

    made = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, sig long, slices array<int>, part int, data binary"))
    return made.where("part IS NULL").select("doc_id", "n", "sig", "slices"), gather_sketch(made.where("part IS NOT NULL"), SKETCH, "int64")


def rare_first(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return grams[np.lexsort((grams, counts[(grams & np.uint64(SKETCH - 1)).astype(np.int64)]))]


def prefixes(docs: DataFrame, counts: np.ndarray, rule: Rule) -> DataFrame:
    """(doc, sig, n, keys): the prefix n-grams of every document, rarest first; of equal sets a task gives one."""
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        words, counts, seen = WordHashes(), held.value, set()
        for b in batches:
            docs, ids, sizes, keys = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                grams = gram_set(text, words, rule.k)
                sig = signature(grams)
                if len(grams) and sig not in seen:
                    seen.add(sig)
                    docs.append(doc)
                    ids.append(sig)
                    sizes.append(len(grams))
                    keys.append(rare_first(grams, counts)[: rule.prefix(len(grams))].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["doc", "sig", "n", "keys"])

    made = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc long, sig long, n int, keys array<long>")
    out = stored(made)
    held.destroy()
    return out


def possible(rule: Rule, a: str, b: str):
    """Length and positional filters on rows of the same key."""
    nx, ny = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(nx - F.col(f"{a}.pos"), ny - F.col(f"{b}.pos"))
    return (rule.den * F.least(nx, ny) >= rule.num * F.greatest(nx, ny)) & (rest * (rule.num + rule.den) >= rule.num * (nx + ny))


def packed(text: str | None) -> bytes:
    return zlib.compress((text or "").encode(), 1)


def sets_of(docs: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """(doc, sig, text), stored: the packed texts of the documents in ``ids``; they are smaller than their sets."""
    seen = docs.sparkSession.sparkContext.broadcast(members(ids, "doc"))

    def run(batches):
        words, bitmap = WordHashes(), seen.value
        for b in batches:
            b = b.filter(pa.array(in_bitmap(np.asarray(b.column(0), np.int64).view(np.uint64), bitmap)))
            texts = b.column(1).to_pylist()
            sigs = [signature(gram_set(t, words, rule.k)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.int64()), pa.array([packed(t) for t in texts], pa.binary())], ["doc", "sig", "text"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc IS NOT NULL").mapInArrow(run, "doc long, sig long, text binary")
    out = stored(made)
    seen.destroy()
    return out


def suffix_allows(x: np.ndarray, y: np.ndarray, need: int) -> bool:
    """Suffix filter: cut both sets at one n-gram of the middle; each side adds its smaller half at most."""
    m = len(y) // 2
    left = np.searchsorted(x, y[m])
    return min(left, m) + min(len(x) - left, len(y) - m) >= need


def plausible(pairs: DataFrame, slices: DataFrame, rule: Rule) -> DataFrame:
    """``pairs`` whose sets can overlap enough by their counts in slices of the range of hashes."""
    for side in ("a", "b"):
        pairs = pairs.join(slices.select(F.col("sig").alias(f"{side}_sig"), F.col("slices").alias(f"{side}_n")), f"{side}_sig")
    total = lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)
    both = total(F.zip_with("a_n", "b_n", lambda x, y: F.least(x, y)))
    return pairs.where(both * (rule.num + rule.den) >= (total("a_n") + total("b_n")) * rule.num).select(*PAIR)


def verified(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], rule: Rule) -> DataFrame:
    """``pairs`` with ``linked``, as a stored table, by the exact intersection of the sets of the whole texts.

    ``texts_of`` gives a stored table (doc, sig, text) of the ids it is handed.
    """
    some = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
    for side in ("b", "a"):
        pairs = pairs.join(some.select(F.col("doc").alias(side), F.col("sig").alias(f"{side}_sig"), F.col("text").alias(f"t{side}")), [side, f"{side}_sig"])

    def run(batches):
        words, last, of = WordHashes(), None, None
        for b in batches:
            linked = []
            for x, y in zip(b.column(4), b.column(5), strict=True):
                x, y = x.as_py(), y.as_py()
                if x != last:  # pairs with the same first document follow one another
                    last, of = x, gram_set(zlib.decompress(x).decode(), words, rule.k)
                other = gram_set(zlib.decompress(y).decode(), words, rule.k)
                need = rule.overlap(len(of), len(other))
                ok = min(len(of), len(other)) >= need and suffix_allows(of, other, need)
                linked.append(bool(ok and len(np.intersect1d(of, other, assume_unique=True)) >= need))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(linked, pa.bool_())], [*PAIR, "linked"])

    out = stored(pairs.select(*PAIR, "ta", "tb").mapInArrow(run, "a long, a_sig long, b long, b_sig long, linked boolean"))
    release(some)
    return out


def with_components(rows: DataFrame, links: DataFrame) -> DataFrame:
    return rows.join(components(links).withColumnsRenamed({"id": "doc", "root": "_root"}), "doc", "left").withColumn("comp", F.coalesce("_root", "doc")).drop("_root")


def length_band(n: str, rule: Rule):
    """Sets in the same band can pass the length filter; pairs of neighbouring bands are left to the last round."""
    return F.floor(F.log(n) / F.lit(math.log(rule.den / rule.num))).cast("int")


def link_rows(left: DataFrame, texts_of: Callable[[DataFrame], DataFrame], links: DataFrame, rule: Rule, star_rounds: int = 2, slices: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that give the components of all sets that share a key and reach the rule.

    ``left``, a stored table that is released here, has key, doc, sig, n, pos, band and comp (its component by
    ``links``); ``slices`` (sig, slices), if given, lets fewer pairs ask for texts.
    """
    tested = None
    for turn in range(star_rounds + 1):
        if turn:
            before, now = left, with_components(left.drop("comp"), links)
            open_keys = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
            left = stored(now.join(open_keys, "key"))
            release(before)
        if turn < star_rounds:
            # A pivot of each n-gram and length band: the smallest id first, then one by a hash.
            by = F.struct((F.col("doc") if turn == 0 else F.hash("doc", F.lit(turn)).cast("long")).alias("o"), "doc", "sig", "n", "pos", "comp")
            pivots = left.groupBy("key", "band").agg(F.min(by).alias("p")).select("key", "band", "p.doc", "p.sig", "p.n", "p.pos", "p.comp")
            met = left.alias("x").join(pivots.alias("y"), ["key", "band"])
        else:
            # A pair is met at each key it shares; the distinct below drops the repeats before they are shuffled.
            met = left.alias("x").join(left.alias("y"), "key").where("x.doc < y.doc")
        met = met.where("x.comp <> y.comp").where(possible(rule, "x", "y"))
        one, two = (F.struct(F.col(f"{side}.doc").alias("doc"), F.col(f"{side}.sig").alias("sig")) for side in ("x", "y"))
        pairs = met.select(F.least(one, two).alias("one"), F.greatest(one, two).alias("two")).select(F.col("one.doc").alias("a"), F.col("one.sig").alias("a_sig"), F.col("two.doc").alias("b"), F.col("two.sig").alias("b_sig")).distinct()
        pairs = pairs if tested is None else pairs.join(tested, PAIR, "left_anti")
        pairs = stored(pairs if slices is None else plausible(pairs, slices, rule))
        done = verified(pairs, texts_of, rule)
        release(pairs)
        tested = done.select(*PAIR) if tested is None else tested.union(done.select(*PAIR))
        links = links.union(done.where("linked").select("a", "b"))
    release(left)
    return links


def jaccard_join(docs: DataFrame, rule: Rule = Rule(), star_rounds: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    profile, counts = profiled(docs, rule)
    with_id = profile.where("doc_id IS NOT NULL AND sig IS NOT NULL")
    equal = stored(with_id.groupBy("sig").agg(F.min("doc_id").alias("doc"), F.any_value("slices").alias("slices")))
    links = with_id.join(equal.select("sig", "doc"), "sig").where("doc <> doc_id").select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))

    held = prefixes(docs, counts, rule)
    grams = held.select("doc", "sig", "n", F.posexplode("keys").alias("pos", "key"))
    # Only n-grams of two different sets matter; copies of one set, which meet at each of its n-grams, are one
    # row from here on. All this needs one shuffle by n-gram.
    of_key = W.partitionBy("key")
    shared = grams.withColumns({"lo": F.min("sig").over(of_key), "hi": F.max("sig").over(of_key)}).where("lo <> hi")
    rows = shared.groupBy("key", "sig").agg(F.min("doc").alias("doc"), F.min("n").alias("n"), F.min("pos").alias("pos"))
    left = stored(rows.select("key", "doc", "sig", "n", "pos", length_band("n", rule).alias("band"), F.col("doc").alias("comp")))
    release(held)
    links = link_rows(left, lambda ids: sets_of(docs, ids, rule), links, rule, star_rounds, equal.select("sig", "slices"))
    return with_components(profile.select(F.col("doc_id").alias("doc"), "n"), links).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule(5, 80, 100)) -> DataFrame:
    """The documents without those that a smaller doc_id of their component stands for."""
    groups = jaccard_join(docs, rule).where("component_id <> doc_id").select("doc_id").distinct()
    once = docs.join(groups, "doc_id", "left_anti")
    return once.select(*docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op4_ngram_jaccard_join": op4}
ORACLES: dict[str, str] = {}
