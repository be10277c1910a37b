"""Secret scans: character Markov models of random strings and of ordinary identifiers.

Base spans come from three patterns. Further tokens are judged by two first-order Markov models of
characters: the log-likelihood ratio of "random string" against "ordinary identifier", per character.
The models are trained from labelled samples: by default the values of base spans are the random
strings, and long words of a bounded sample of documents without base spans the identifiers.
Everything on the path is a DataFrame expression.

Spans are half-open and count code points. Positions come from marking matches in the text and
splitting at the marks; the mark is first replaced in the text by a character of the same length that no
pattern can match.

Defined cases: a null text is empty; an empty text has no spans; spans of one kind never overlap, a
Markov span never overlaps a base span; rows with the same doc_id are each scanned (rows are told
apart by the hash of the text, equal rows have equal spans); a null doc_id is kept; extra columns are
ignored by ``scan`` and kept by ``redact``; without samples of both labels no spans are added; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table
from .quality import sampled

KINDS = ["assign", "access", "hex"]
# The patterns of base spans. The lengths 20 and 24 may stand in the pattern, since what
# is dropped there holds no shorter match; that of an assigned value may not, and is tested after.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MARK, OTHER = "\u0001", "\u0002"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


@dataclass(frozen=True)
class Settings:
    """``least``: characters of a judged token; ``threshold``: log-likelihood ratio per character;
    ``sample``: documents that ordinary identifiers are taken from, about."""

    least: int = 20
    threshold: float = 0.5
    sample: int = 20_000


def spans(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches, as (kind, start, end, value)."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), f"({pattern})", f"{MARK}$1{MARK}")
    pieces = F.split(marked, MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(SPAN).alias("found"))

    def step(acc, piece):
        end = acc["at"] + F.char_length(piece)
        hit = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"), piece.alias("value"))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["found"], F.array(hit))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(pieces, start, step, lambda acc: acc["found"])


def base_spans(text: str = "text") -> Column:
    """The base spans of a text, ordered by start and then by kind as listed."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    low = F.lower(t)
    worth = (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & (F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api")))
    assigned = F.filter(spans(t, ASSIGN, "assign"), lambda s: F.char_length(F.regexp_replace(s["value"], ASSIGNED, "")) >= 6)
    assign = F.when(worth, assigned).otherwise(none)
    access = F.when(F.contains(t, F.lit("AKIA")), spans(t, ACCESS, "access")).otherwise(none)
    hexes = F.when(t.rlike("[0-9a-f]{24}"), spans(t, HEX, "hex")).otherwise(none)
    rank = lambda k: F.when(k == "assign", 0).when(k == "access", 1).when(k == "hex", 2).otherwise(3)
    order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(rank(a["kind"]) - rank(b["kind"]))
    return F.array_sort(F.concat(assign, access, hexes), order)


def candidates(text: str, least: int) -> Column:
    """Tokens long enough to be judged."""
    t = F.coalesce(F.col(text), F.lit(""))
    pattern = f"[A-Za-z0-9+/_=-]{{{least},}}"
    return F.when(t.rlike(pattern), spans(t, pattern, "markov")).otherwise(F.array().cast(SPAN))


def joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def steps(value: str) -> Column:
    """(previous character, character) of a string, from a start sign on; characters outside ASCII are one class."""
    plain = F.regexp_replace(value, "[^\\x21-\\x7E]", "?")
    padded = F.concat(F.lit("^"), plain)
    return F.regexp_extract_all(padded, F.lit("(?=(..))"), F.lit(1))


CLASS_SIZES = {"lower": 26.0, "upper": 26.0, "digit": 10.0, "sign": 32.0}


def char_class(column: str) -> Column:
    c = F.col(column)
    return F.when(c.between("a", "z"), "lower").when(c.between("A", "Z"), "upper").when(c.between("0", "9"), "digit").otherwise("sign")


def train(samples: DataFrame, prior: float = 8.0) -> DataFrame:
    """(step, llr): log P(random) - log P(identifier) of each character step, from (value, random).

    A row for each of the 94 * 94 steps of printable characters, so the model has a fixed size. Steps that the
    samples rarely hold lean on the steps between classes of characters, ``prior`` of them.
    """
    counted = samples.where(F.char_length("value") > 0).select("random", F.explode(steps("value")).alias("step")).groupBy("step").agg(F.sum(F.col("random").cast("double")).alias("r"), F.sum((~F.col("random")).cast("double")).alias("o"))
    codes = F.sequence(F.lit(33), F.lit(126))
    grid = samples.sparkSession.range(1).select(F.explode(codes).alias("x")).select("x", F.explode(codes).alias("y")).select(F.char("x").alias("prev"), F.char("y").alias("next"))
    grid = grid.select(F.concat("prev", "next").alias("step"), "prev", char_class("prev").alias("pc"), char_class("next").alias("nc"))
    model = stored(grid.join(counted, "step", "left").fillna(0.0, ["r", "o"]))
    llr = F.lit(0.0)
    for count, sign in (("r", 1.0), ("o", -1.0)):
        within = lambda *by, c=count: F.sum(c).over(W.partitionBy(*by))  # noqa: E731  over the fixed grid
        size = F.coalesce(*[F.when(F.col("nc") == k, F.lit(n)) for k, n in CLASS_SIZES.items()])
        backed = (within("pc", "nc") + 1.0) / (within("pc") + 4.0) / size
        llr = llr + F.lit(sign) * F.log((F.col(count) + F.lit(prior) * backed) / (within("prev") + F.lit(prior)))
    total = model.agg(F.sum("r"), F.sum("o")).first()
    out = model.select("step", llr.alias("llr"))
    return stored(out if total[0] and total[1] else out.limit(0))


def found(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, key, base, more): base spans and the tokens the models may judge; no texts."""
    made = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), base_spans().alias("base"), candidates("text", s.least).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return stored(made.withColumn("more", apart))


def default_samples(scanned: DataFrame, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(value, random): values of base spans, and long words of a bounded sample of documents, those without base spans."""
    random = scanned.select(F.explode("base").alias("b")).select(F.regexp_replace("b.value", ASSIGNED, "").alias("value"), F.lit(True).alias("random"))
    some = sampled(docs.where("text IS NOT NULL").select("doc_id", "text"), "doc_id", s.sample)
    some = some.where(F.size(base_spans()) == 0)
    words = F.filter(F.split("text", "[^A-Za-z0-9_-]+"), lambda w: (F.char_length(w) >= 8) & ~w.rlike("[0-9]{4}|[0-9a-f]{20}"))
    return random.unionByName(some.select(F.explode(words).alias("value"), F.lit(False).alias("random")))


def judged(scanned: DataFrame, model: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``scanned`` with ``spans``: base spans and the tokens that look random, by start."""
    name = F.sha2("m.value", 256).alias("token")  # stands for the token where a row is made for each of its steps
    every_token = scanned.select("doc_id", "key", F.explode("more").alias("m")).select("doc_id", "key", "m", name)
    tokens = every_token.select("token", F.col("m.value").alias("value")).dropDuplicates(["token"])
    each = tokens.select("token", F.explode(steps("value")).alias("step")).groupBy("token", "step").agg(F.count("*").alias("n"))
    scores = each.join(F.broadcast(model), "step", "left").groupBy("token").agg((F.sum(F.coalesce("llr", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("ratio"))
    rows = every_token.join(scores.where(F.col("ratio") >= s.threshold).select("token"), "token")
    added = rows.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("m")).alias("added"))
    left, right = scanned.drop("more").alias("s"), added.alias("a")
    both = left.join(right, F.col("s.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("s.key") == F.col("a.key")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))), lambda a, b: F.coalesce(F.nullif(a["start"] - b["start"], F.lit(0)), F.when(a["kind"] == "assign", -1).when(b["kind"] == "assign", 1).when(a["kind"] == "access", -1).when(b["kind"] == "access", 1).otherwise(0)))
    return both.select("s.doc_id", "s.key", "base", every.alias("spans"))


def scan(docs: DataFrame, samples: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """(doc_id, key, base, spans) of every row; key is the xxhash64 of the text."""
    scanned = found(docs, s)
    return judged(scanned, train(default_samples(scanned, docs, s) if samples is None else samples), s)


def redact(docs: DataFrame, s: Settings = Settings(), sign: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``sign``; n_chars, if there, follows."""
    hits = scan(docs, None, s).where(F.size("spans") > 0).groupBy("doc_id", "key").agg(F.first("spans").alias("_spans"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_spans")
    both = docs.withColumn("_k", F.xxhash64(F.coalesce("text", F.lit("")))).join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, span):
        between = F.col("text").substr(acc["at"] + 1, F.greatest(span["start"] - acc["at"], F.lit(0)))
        fresh = span["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], between, F.lit(sign))).otherwise(acc["out"]).alias("out"))

    text = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.char_length("text"))))
    out = both.withColumn("_hit", F.col("_spans").isNotNull()).withColumn("text", F.when(F.col("_hit"), text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_hit"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda b: b["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return got.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op7_secret_scans": op7}
ORACLES: dict[str, str] = {}
