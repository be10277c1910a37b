"""PII: contextual extraction bootstrapped from seed entities.

Four patterns give the seeds (e-mail, IP address, card number, phone number). Each seed induces lexical
patterns: the two words before it, the word before and the word after, and the two words after. The
graph of patterns and the tokens they surround is scored in turns on Spark: a pattern is as good as the
mean score of its instances times the logarithm of how many known ones support it, an instance is
as good as its accepted patterns. Instances beyond a threshold join the known ones and vote in the next turn.
Tokens of accepted instances become spans beside the base ones.

Spans are half-open and count code points. Base matches of a kind are leftmost and do not overlap; one
that fails its test is dropped and its characters are not tried again.

Defined cases: a null text is empty; an empty text has no spans; an added span never overlaps a base span;
rows with the same doc_id are each scanned; a null doc_id is kept; other columns are ignored; without
seeds nothing is added; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

KINDS = ["email", "ip", "card", "phone"]
# The patterns of the seeds. A look-behind only spares starts inside a run of digits, which
# cannot match where the run's own start did not.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
TOKEN = re.compile(r"(?<!\S)\S*[0-9@]\S*")
EDGE = "\"'()[]{}<>,;:.!?|"
SPAN = "array<struct<kind:string,start:int,end:int,value:string,patterns:array<string>>>"


@dataclass(frozen=True)
class Settings:
    """``turns`` of scoring; ``support``: known instances a pattern needs; ``confidence`` of patterns and
    instances; ``least``: digits that a token without @ needs to be judged."""

    turns: int = 3
    support: int = 3
    confidence: float = 0.8
    least: int = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the local part, @ and a dotted domain; each @ is looked at once, so long runs stay linear."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            after = m.end()
        else:
            after = at + 1
        at = text.find("@", after)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base matches, by kind as listed and then by start."""
    if not HINT.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span; digits are masked."""
    before = re.sub(r"[0-9]", "0", text[max(0, start - 120) : start].lower()).split()[-2:]
    after = re.sub(r"[0-9]", "0", text[end : end + 120].lower()).split()[:2]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} *")
    if before and after:
        out.append(f"{before[-1]} * {after[0]}")
    if len(after) == 2:
        out.append(f"* {after[0]} {after[1]}")
    return out


def entities(text: str | None, least: int) -> tuple[list[dict], list[dict]]:
    """Base spans and the other identifier-like tokens of a text, with their patterns."""
    text = text or ""
    base = base_spans(text)
    if not base and not HINT.search(text):
        return [], []
    known = [{"kind": k, "start": a, "end": b, "value": text[a:b], "patterns": contexts(text, a, b)} for k, a, b in base]
    taken: list[list[int]] = []  # the union of base spans
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    more = []
    for m in TOKEN.finditer(text):
        word = m[0].strip(EDGE)
        a = m.start() + len(m[0]) - len(m[0].lstrip(EDGE))
        b = a + len(word)
        if not word or "@" not in word and sum(c.isdigit() for c in word) < least:
            continue
        i = bisect_left(taken, [b]) - 1  # the last that begins before the token ends
        if i < 0 or taken[i][1] <= a:
            more.append({"kind": None, "start": a, "end": b, "value": word, "patterns": contexts(text, a, b)})
    return known, more


def found(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, key, base, more) of every row; key is the xxhash64 of the text, no texts are kept."""
    names = ["doc_id", "key", "base", "more"]
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        for b in batches:
            both = [entities(t, s.least) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in both], item), pa.array([x[1] for x in both], item)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, f"doc_id long, key long, base {SPAN}, more {SPAN}"))


def bootstrapped(scanned: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(value, kind) of the tokens that accepted patterns vouch for."""
    spark = scanned.sparkSession
    seen = scanned.select(F.explode(F.concat("base", "more")).alias("e")).select("e.kind", "e.value", F.explode("e.patterns").alias("pattern")).distinct()
    seen = stored(seen)
    # Only patterns that hold a seed can ever be accepted in the first turn; later turns follow their tokens.
    known = seen.where("kind IS NOT NULL").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    edges = seen.select("pattern", "value").distinct()
    added = spark.createDataFrame([], "value string, kind string, score double")
    for _ in range(s.turns):
        every = known.unionByName(added)
        votes = edges.join(every, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("support"))
        sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
        patterns = votes.where(F.col("support") >= s.support).join(sizes, "pattern").withColumn("mean", F.col("mass") / F.col("n"))
        accepted = patterns.where(F.col("mean") >= s.confidence).withColumn("score", F.col("mean") * F.least(F.lit(1.0), F.log2(F.col("support") + 1.0) / 2.0))
        rows = edges.join(accepted.select("pattern", "kind", "score"), "pattern").join(known.select("value").distinct(), "value", "left_anti")
        best = rows.groupBy("value", "kind").agg(F.avg("score").alias("score")).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b"))
        before, added = added, stored(best.select("value", "b.kind", "b.score").where(F.col("score") >= s.confidence))
        if added.select("value", "kind").exceptAll(before.select("value", "kind")).isEmpty():
            break
    return added.select("value", F.col("kind").alias("as_kind"))


def extract(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, key, base, spans) of every row; both arrays hold (kind, start, end) by kind as listed, then start."""
    scanned = found(docs, s)
    more = scanned.select("doc_id", "key", F.explode("more").alias("m")).select("doc_id", "key", "m.start", "m.end", "m.value")
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    hits = more.join(bootstrapped(scanned, s), "value").groupBy("doc_id", "key").agg(F.collect_set(F.struct(rank[F.col("as_kind")].alias("rank"), "start", "end")).alias("added"))
    plain = F.transform("base", lambda b: F.struct(rank[b["kind"]].alias("rank"), b["start"].alias("start"), b["end"].alias("end")))
    left, right = scanned.select("doc_id", "key", plain.alias("base")).alias("s"), hits.alias("a")
    both = left.join(right, F.col("s.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("s.key") == F.col("a.key")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<rank:int,start:int,end:int>>"))))
    return both.select("s.doc_id", "s.key", "base", every.alias("spans"))


def joined(column: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", names[x["rank"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6(spark, sf_dir: str) -> DataFrame:
    got = extract(table(spark, sf_dir, "documents"))
    ranks = F.transform("base", lambda b: b["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op6_pii": op6}
ORACLES: dict[str, str] = {}
