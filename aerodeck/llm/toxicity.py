"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded texts, with exception phrases.

Texts are lower-cased and folded: letters of other scripts and symbols that look like Latin letters, and
digits that stand for letters inside words, become those letters. The lexicon is learnt from labelled
documents: words and word beginnings whose share of occurrences in toxic documents is far above that
in clean ones, weighted by their log-odds. Exception phrases are words that begin with a stem of the lexicon,
and pairs of adjacent words that hold a hit, which belong to clean documents; they take the hits inside them away.

A score is the sigmoid of bias + gain * log(1 + mass) where mass is the sum of weights of the hits
(each entry counted with diminishing return) divided by the root of the length of the text beyond a
usual one; bias and gain are fitted to the labelled sample.

Defined cases: a null text is empty; an empty text and a text without hits get the sigmoid of the bias;
repeated rows are scored alike; without labels of both kinds the lexicon is empty; other columns of
``docs`` pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .quality import held_out, labelled_sample

# Look-alike letters of other scripts, and symbols and digits that stand for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһѵкмнтвαοενρτυχικ", "aeopcyxijsdhvkmhtbaoevptuxik", strict=True))
SUBSTITUTES = dict(zip("01345780@$!|", "oieastboasil", strict=True))
# Tried once for each run of other letters, so that texts of one long word stay linear.
SUBSTITUTED = re.compile(r"(?<![^\W_013457])[^\W_013457]*+[013457@$!|][\w@$!|]*")
WORD = re.compile(r"\w+")
FOLD = str.maketrans(LOOKALIKES)
DIGITS = str.maketrans(SUBSTITUTES)


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents the lexicon is learnt from, about; ``support`` and ``share``: number and
    share of toxic documents an entry needs, so that words of a few copies are none; ``odds``: smallest
    log-odds; ``entries``: size of the lexicon."""

    sample: int = 20_000
    support: int = 5
    share: float = 0.02
    odds: float = 2.5
    entries: int = 5_000
    stems: tuple[int, ...] = (4, 5, 6, 7)
    usual_words: int = 300


def folded(text: str | None) -> str:
    """Lower-cased text; in words that mix letters with digits or symbols these become letters."""
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(FOLD)

    def letters(m: re.Match) -> str:
        word = m[0]
        bare = word.rstrip("!|")
        return bare.translate(DIGITS) + " " * (len(word) - len(bare)) if any(c.isalpha() for c in bare) else word

    return SUBSTITUTED.sub(letters, text)


def word_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of either kind that hold a word."""
    return document_counts(sample, lambda: set)


def pair_counts(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(term, toxic, clean): documents of either kind that hold a pair of adjacent words of which one is a hit."""
    held = sample.sparkSession.sparkContext.broadcast(lexicon)

    def terms():
        matcher = Matcher(held.value)

        def pairs(words):
            hit = [matcher.hit(w) for w in words]
            return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:], strict=False) if x or y}

        return pairs

    return document_counts(sample, terms)


def document_counts(sample: DataFrame, made) -> DataFrame:
    """(term, toxic, clean): documents of either kind that hold a term, counted in each task first; ``made`` gives
    each task the function from the words of a text to its set of terms."""
    def run(batches):
        terms = made()
        counts: dict[str, list[float]] = {}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in terms(WORD.findall(folded(text))):
                    c = counts.setdefault(w, [0.0, 0.0])
                    c[y < 0.5] += 1.0
            if len(counts) > 500_000:
                yield batch(counts)
                counts = {}
        yield batch(counts)

    def batch(counts):
        both = list(counts.values())
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([v[0] for v in both], pa.float64()), pa.array([v[1] for v in both], pa.float64())], ["term", "toxic", "clean"])

    return sample.select("text", "y").mapInArrow(run, "term string, toxic double, clean double").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass(frozen=True)
class Lexicon:
    """``weights``: entry -> weight; an entry begins with a space, and ends with one if it is a whole word.
    ``exceptions``: one or more words between spaces."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    bias: float = -4.0
    gain: float = 1.0


def learn(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "toxic") -> Lexicon:
    """Learn the lexicon and its exceptions from a bounded sample of labelled documents."""
    sample = stored(labelled_sample(docs, labels, label, s.sample))
    sizes = sample.agg(F.sum((F.col("y") >= 0.5).cast("long")), F.sum((F.col("y") < 0.5).cast("long"))).first()
    n_toxic, n_clean = sizes[0] or 0, sizes[1] or 0
    if not n_toxic or not n_clean:
        return Lexicon({}, ())
    words = stored(word_counts(sample))
    forms = F.array(F.concat(F.lit(" "), "term", F.lit(" ")), *[F.when(F.length("term") >= n, F.concat(F.lit(" "), F.substring("term", 1, n))) for n in s.stems])
    entries = words.select(F.explode(F.array_compact(forms)).alias("entry"), "toxic", "clean").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_clean + 1.0))
    top = entries.where(F.col("toxic") >= max(s.support, s.share * n_toxic)).withColumn("odds", odds).where(F.col("odds") >= s.odds).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "entry").limit(s.entries).collect()
    weights = {r["entry"]: float(r["odds"]) for r in top}
    # A longer entry that a shorter one of the same strength covers adds nothing.
    weights = {e: w for e, w in weights.items() if not any(weights.get(e[:n], -1.0) >= 0.8 * w for n in range(4, len(e)))}
    stems = [e for e in weights if not e.endswith(" ")]
    clean = F.array(*[F.lit(e.strip()) for e in stems]) if stems else F.array().cast("array<string>")
    spared = words.where((F.col("clean") > 0) & (F.col("clean") * n_toxic >= F.col("toxic") * n_clean)).where(F.exists(clean, lambda e: F.startswith("term", e)))
    exceptions = spared.orderBy(F.desc("clean"), "term").limit(s.entries).select("term").collect()
    lexicon = Lexicon(weights, tuple(f" {r[0]} " for r in exceptions))
    # A pair needs the support of an entry: a pair of a few documents says nothing against its hit.
    phrases = pair_counts(sample, lexicon).where((F.col("clean") >= s.support) & (F.col("clean") * n_toxic >= F.col("toxic") * n_clean)).orderBy(F.desc("clean"), "term").limit(s.entries).select("term").collect()
    lexicon = Lexicon(weights, (*lexicon.exceptions, *(f" {r[0]} " for r in phrases)))
    bins = masses(sample, lexicon, s).groupBy(F.round(F.log1p("mass"), 1).alias("x"), (F.col("y") >= 0.5).cast("double").alias("y")).count().collect()
    x, y, n = (np.array([float(r[c]) for r in bins]) for c in ("x", "y", "count"))
    return Lexicon(lexicon.weights, lexicon.exceptions, *fitted(x, y, n))


def fitted(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Bias and gain of a logistic curve through weighted points, by Newton steps."""
    a, w = np.stack([np.ones_like(x), x], 1), np.array([-1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (n * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hessian, a.T @ (n * (y - p)) - ridge * w)
        w = w + np.clip(step, -1, 1)
    return float(w[0]), float(w[1])


class Matcher:
    """Aho-Corasick automaton of the entries and the exception phrases."""

    def __init__(self, lexicon: Lexicon):
        self.machine = ahocorasick.Automaton()
        self.weights, self.exceptions = lexicon.weights, frozenset(lexicon.exceptions)
        self.lengths = frozenset(map(len, (e for e in lexicon.weights if not e.endswith(" "))))
        for e in lexicon.weights:
            self.machine.add_word(e, (e, False))
        for e in lexicon.exceptions:
            self.machine.add_word(e, (e, True))
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    def hit(self, word: str) -> bool:
        """Whether the word alone is a hit."""
        padded = f" {word} "
        return padded not in self.exceptions and any(padded[:n] in self.weights for n in self.lengths | {len(padded)})

    def mass(self, text: str | None, usual_words: int) -> tuple[float, int]:
        """Weight of the hits for the length of the text, and their number."""
        if self.empty or not text:
            return 0.0, 0
        words = WORD.findall(folded(text))
        hits: dict[int, str] = {}
        spared = set()
        for end, (entry, exception) in self.machine.iter(" " + " ".join(words) + " "):
            start = end - len(entry) + 1
            if exception:
                spared.update(start + i for i, c in enumerate(entry[:-1]) if c == " ")
            elif self.weights[entry] > self.weights.get(hits.get(start, ""), 0.0):
                hits[start] = entry
        times: dict[str, int] = {}
        for start, entry in hits.items():
            if start not in spared:
                times[entry] = times.get(entry, 0) + 1
        total = sum(self.weights[e] * (1 + math.log(n)) for e, n in times.items())
        return total / max(1.0, len(words) / usual_words) ** 0.5, sum(times.values())


def masses(docs: DataFrame, lexicon: Lexicon, s: Settings = Settings(), column: str = "mass") -> DataFrame:
    """``docs`` with the mass of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = docs.columns

    def run(batches):
        matcher = Matcher(held.value)
        for b in batches:
            mass = [matcher.mass(t, s.usual_words)[0] for t in b.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mass, pa.float64())], [*names, column])

    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{column}` double")


def score(docs: DataFrame, lexicon: Lexicon, s: Settings = Settings(), column: str = "score") -> DataFrame:
    """``docs`` with the toxicity of each whole text, between 0 and 1."""
    curve = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(lexicon.bias) + F.lit(lexicon.gain) * F.log1p("_mass"))))
    return masses(docs, lexicon, s, "_mass").select(*docs.columns, curve.alias(column))


def op8(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = learn(docs, labels.where(~held_out("doc_id", 4, 2)))
    out = score(docs.select("doc_id", "text"), lexicon).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op8_toxicity": op8}
ORACLES: dict[str, str] = {}
