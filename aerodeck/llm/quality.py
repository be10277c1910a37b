"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL, scored as sparse dot products.

A document is the means of three blocks of hashed n-grams: words, word pairs, and triples of word
shapes (case, digits, punctuation as it stands, repetition of one of the two words before), and a
bucket of its length. The score is the sigmoid of the dot product of these with the weights.

Defined cases: a null text counts as empty; an empty text has only its length bucket, so every row
gets a score; repeated rows are scored alike; a null doc_id is scored and not held out; without
labels of both kinds the weights stay zero and all scores are 0.5. Other columns of ``docs`` pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import P1, mixed, stored, table

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents used for training, about; ``shards`` train side by side and are
    averaged after each of ``rounds`` passes; the rest are the usual FTRL constants."""

    bits: int = 18
    sample: int = 12_000
    shards: int = 4
    rounds: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.0
    gain: float = 6.0


class Tokens(dict):
    """Token -> number of its entry in ``word`` and ``shape``, arrays of hashes; bounded."""

    LIMIT = 1 << 17

    def __init__(self):
        super().__init__()
        self.word, self.shape = np.zeros(self.LIMIT, np.uint64), np.zeros(self.LIMIT, np.uint64)

    def __missing__(self, token):
        at = len(self)
        if token[0].isalnum():
            shape = 1 if token.isdigit() else 2 if len(token) > 1 and token.isupper() else 3 if token[0].isupper() else 4 if token.islower() else 5
        else:
            shape = xxhash.xxh64_intdigest("p" + token[:4]) | 1 << 60
        self.word[at], self.shape[at] = xxhash.xxh64_intdigest(token.lower()), shape
        self[token] = at
        return at

    def hashes(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        step = self.LIMIT // 2
        parts = []
        for i in range(0, len(tokens), step):
            if len(self) > step:
                self.clear()
            some = tokens[i : i + step]
            at = np.fromiter(map(self.__getitem__, some), np.int64, len(some))
            parts.append((self.word[at], self.shape[at]))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def blocks(text: str | None, tokens: Tokens, bits: int) -> list[np.ndarray]:
    """Hashed feature positions of a whole text, one array per block."""
    mask = np.uint64((1 << bits) - 1)
    found = TOKEN.findall(text or "")
    n = len(found)
    length = np.array([n.bit_length()], np.uint64)
    out = [mixed(length * P1 + np.uint64(7)) & mask]
    if n:
        word, shape = tokens.hashes(found)
        again = np.zeros(n, bool)
        again[1:] = word[1:] == word[:-1]
        again[2:] |= word[2:] == word[:-2]
        shape = shape * np.uint64(2) + again
        padded = np.concatenate([np.zeros(2, np.uint64), shape])
        out.append(mixed(word * P1 + np.uint64(11)) & mask)
        if n > 1:
            out.append(mixed((word[:-1] * P1 + word[1:]) * P1 + np.uint64(13)) & mask)
        out.append(mixed(((padded[:-2] * P1 + padded[1:-1]) * P1 + padded[2:]) * P1 + np.uint64(17)) & mask)
    return [b.astype(np.int64) for b in out]


def features(text, tokens: Tokens, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The same as a sparse vector: distinct positions and their values."""
    parts = blocks(text, tokens, s.bits)
    at = np.concatenate(parts)
    value = np.concatenate([np.full(len(p), (s.gain if i else 1.0) / len(p)) for i, p in enumerate(parts)])
    index, inverse = np.unique(at, return_inverse=True)
    return index, np.bincount(inverse, value)


def weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
    return np.where(np.abs(z) <= s.l1, 0.0, w)


def ftrl_pass(rows: list[tuple[str | None, float]], z: np.ndarray, n: np.ndarray, s: Settings) -> None:
    """One pass of follow-the-regularised-leader updates over ``rows``, in place."""
    tokens = Tokens()
    for text, y in rows:
        at, x = features(text, tokens, s)
        w = weights(z[at], n[at], s)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
        z[at] += g - sigma * w
        n[at] += g * g


def shard_pass(state, turn: int, s: Settings):
    """Continue a pass from the averaged state over the rows of one shard, in an order fixed by ``turn``."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(group["doc_id"], group["text"], group["y"], strict=True), key=lambda r: hash((int(r[0]), turn)))
        z, n = (a.copy() for a in state.value)
        ftrl_pass([(text, y) for _, text, y in rows], z, n, s)
        return pd.DataFrame({"rows": [len(rows)], "z": [z.tobytes()], "n": [n.tobytes()]})
    return run


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def sampled(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About ``most`` of the rows, those with the smallest hashes of a column; all, if there are fewer.

    The cut of the hash is set from a count, so nothing is sorted or gathered.
    """
    n = rows.count()
    share = F.pmod(F.xxhash64(by, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows if n <= most else rows.where(share < F.lit(most / n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of about ``most`` labelled documents.

    The ids are bounded by ``most``, so they are broadcast; a document labelled twice has the mean label.
    """
    picked = sampled(labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()), "doc_id", most).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "quality") -> np.ndarray:
    """Weights learnt from ``labels``; shards run FTRL passes side by side, their states are averaged."""
    sample = stored(labelled_sample(docs, labels, label, s.sample).repartition(s.shards, "doc_id"))
    size = 1 << s.bits
    z, n = np.zeros(size), np.zeros(size)
    spark = docs.sparkSession
    kinds = sample.agg(F.min("y"), F.max("y")).first()
    if kinds[0] is None or kinds[0] == kinds[1]:
        return z
    for turn in range(s.rounds):
        state = spark.sparkContext.broadcast((z, n))
        made = sample.withColumn("shard", F.pmod(F.hash("doc_id"), F.lit(s.shards))).groupBy("shard").applyInPandas(shard_pass(state, turn, s), "rows long, z binary, n binary").collect()
        made.sort(key=lambda r: (r["rows"], bytes(r["z"])))  # one row a shard; sums are taken in a fixed order
        total = sum(r["rows"] for r in made)
        z = sum(np.frombuffer(r["z"]) * (r["rows"] / total) for r in made)
        n = sum(np.frombuffer(r["n"]) * (r["rows"] / total) for r in made)
        state.destroy()
    return weights(z, n, s)


def score(docs: DataFrame, w: np.ndarray, s: Settings = Settings(), column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(w)
    names = docs.columns

    def run(batches):
        tokens, w = Tokens(), held.value
        for b in batches:
            logit = np.array([sum((s.gain if i else 1.0) * w[p].mean() for i, p in enumerate(blocks(t, tokens, s.bits))) for t in b.column(names.index("text")).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))), pa.float64())], [*names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    model = train(docs, labels.where(~held_out("doc_id", 5, 0)), s)
    name = next(n for i in range(len(docs.columns) + 1) if (n := f"_score{i}") not in docs.columns)
    return score(docs, model, s, name).where(F.col(name) >= threshold).drop(name)


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id", 5, 0)))
    out = score(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op1_quality_classifier": op1}
ORACLES: dict[str, str] = {}
