"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Documents are summed to cells of source, language and topic. Raking multiplies the token weight of the cells by
target / actual share of one marginal after the other; the cells stay a DataFrame throughout, so there may be any
number of sources. Each document is then kept with probability min(1, rate * weight); the rate is
solved so that the expected tokens are the budget. The draw is a hash of the doc_id, so it is the same on every run.
All of it is DataFrame expressions.

The topic of a document is its form, read from the whole text: a table (many bars), or a note, article
or book by its number of words; a column ``topic`` can be named instead.

Defined cases: a null text has no words and draws as a note; documents without words have probability 1 only if the
weight says so (their cell has no tokens and keeps weight 1); a null source or language counts as the empty string;
a value without a target keeps its actual share; rows with the same doc_id draw alike; rows without doc_id are drawn by
an empty id; columns of ``docs`` pass through, but one named like an added column (in either case) gives way to it; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stored, table

CELL = ["_source", "_lang", "_topic"]
ADDED = ["_tokens", *CELL, "_weight", "_probability"]
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    """``budget``: share of all tokens to keep; targets by default are actual shares to the power of
    ``temper``; ``rounds`` of raking and ``steps`` of solving the rate; ``seed`` of the draw."""

    budget: float = 0.5
    temper: tuple[float, float, float] = (0.5, 0.7, 0.7)
    rounds: int = 6
    steps: int = 6
    seed: str = "mix"


def topic_of(text: str) -> Column:
    words = F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0))
    bars = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))), F.lit(0))
    return F.when((bars * 10 >= words) & (bars > 0), "table").when(words < 100, "note").when(words < 1000, "article").otherwise("book")


def labelled(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """``docs`` with its cell and tokens."""
    return docs.select("*", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("double").alias("_tokens"), F.coalesce("source", F.lit("")).alias("_source"), F.coalesce("lang", F.lit("")).alias("_lang"),
                       (topic_of("text") if topic is None else F.coalesce(topic, F.lit(""))).alias("_topic"))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, target): actual token shares to a power, as shares of all tokens."""
    own = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
    total = own.agg(F.sum(F.pow("t", F.lit(power)))).first()[0] or 1.0
    return own.select(dim, (F.pow("t", F.lit(power)) / F.lit(total)).alias("target"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int) -> DataFrame:
    """``cells`` (the three dimensions, tokens) with ``weight``: the marginals of weight * tokens approach the targets.

    The targets join the cells once. Joins are by a shuffle: the driver keeps a table for each broadcast, and there
    are three joins a round.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    aims = {dim: f"_aim{dim}" for dim in targets}
    for dim, target in targets.items():
        cells = cells.join(target.withColumnRenamed("target", aims[dim]).hint("merge"), dim, "left")
    cells = stored(cells.select(*CELL, "tokens", *aims.values(), F.lit(1.0).alias("weight")))
    for _ in range(rounds):
        for dim, aim in aims.items():
            have = cells.groupBy(dim).agg(F.sum(F.col("weight") * F.col("tokens")).alias("have"), F.max(aim).alias("aim"))
            ratio = have.select(dim, F.when(F.col("have") > 0, F.col("aim") * F.lit(total) / F.col("have")).otherwise(1.0).alias("ratio"))
            before, cells = cells, stored(cells.join(ratio.hint("merge"), dim, "left").select(*CELL, "tokens", *aims.values(), (F.col("weight") * F.coalesce("ratio", F.lit(1.0))).alias("weight")))
            release(before)
    return cells.select(*CELL, "tokens", "weight")


def solved(cells: DataFrame, s: Settings) -> float:
    """The rate at which min(1, rate * weight) keeps the budget of tokens in expectation."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    rate = 0.0
    for _ in range(s.steps):
        full = F.col("weight") * F.lit(rate) >= 1
        row = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight") * F.col("tokens")))).first()
        rate = (s.budget * total - row[0]) / row[1] if row[1] else rate
    return rate


def mixed_cells(rows: DataFrame, s: Settings, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(cell, _weight, _probability) of every cell of labelled rows."""
    cells = stored(rows.groupBy(*CELL).agg(F.sum("_tokens").alias("tokens")))
    targets = targets or {dim: tempered(cells, dim, power) for dim, power in zip(CELL, s.temper, strict=True)}
    cells = raked(cells, targets, s.rounds)
    return cells.select(*CELL, F.col("weight").alias("_weight"), F.least(F.lit(1.0), F.col("weight") * F.lit(solved(cells, s))).alias("_probability"))


def drawn(doc_id: str, seed: str) -> Column:
    """A number in [0, 1) from a hash of the id."""
    digest = F.substring(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, s: Settings = Settings(), targets: dict[str, DataFrame] | None = None, topic: str | None = None) -> DataFrame:
    """The sampled documents, with their columns and _tokens, the cell, _weight and _probability."""
    if topic in docs.columns and topic.lower() in ADDED:
        raise ValueError(f"rename the topic column: {topic} is a name of an added one")
    rows = labelled(docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in ADDED)), topic)
    return rows.join(mixed_cells(rows, s, targets), CELL).where(drawn("doc_id", s.seed) < F.col("_probability"))


def op5(spark, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").cast("long").alias("tokens"),
                      F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"))


def sql(s: Settings = Settings()) -> str:
    """The same in SQL: every round of raking and every step of the rate is one common table."""
    words = "len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))"
    bars = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', ''))"
    parts = [f"w AS (SELECT doc_id, CAST({words} AS DOUBLE) AS tokens, {bars} AS bars, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents)",
             "d AS (SELECT *, CASE WHEN bars * 10 >= tokens AND bars > 0 THEN 'table' WHEN tokens < 100 THEN 'note' WHEN tokens < 1000 THEN 'article' ELSE 'book' END AS topic FROM w)",
             "c0 AS (SELECT source, lang, topic, sum(tokens) AS tokens, CAST(1 AS DOUBLE) AS weight FROM d GROUP BY ALL)",
             "total AS (SELECT sum(tokens) AS t FROM c0)"]
    dims = ["source", "lang", "topic"]
    for dim, power in zip(dims, s.temper, strict=True):
        parts.append(f"g_{dim} AS (SELECT {dim}, pow(t, {power}) / sum(pow(t, {power})) OVER () AS target FROM (SELECT {dim}, sum(tokens) AS t FROM c0 GROUP BY {dim}))")
    n = 0
    for _ in range(s.rounds):
        for dim in dims:
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * CASE WHEN h.have > 0 THEN g.target * (SELECT t FROM total) / h.have ELSE 1 END AS weight FROM c{n} "
                         f"JOIN (SELECT {dim}, sum(weight * tokens) AS have FROM c{n} GROUP BY {dim}) h USING ({dim}) JOIN g_{dim} g USING ({dim}))")
            n += 1
    parts.append("r0 AS (SELECT CAST(0 AS DOUBLE) AS rate)")
    for i in range(s.steps):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT ({s.budget} * (SELECT t FROM total) - sum(CASE WHEN weight * rate >= 1 THEN tokens ELSE 0 END)) / sum(CASE WHEN weight * rate >= 1 THEN 0 ELSE weight * tokens END) AS rate FROM c{n}, r{i})")
    parts.append(f"p AS (SELECT source, lang, topic, weight, least(1.0, weight * (SELECT rate FROM r{s.steps})) AS probability FROM c{n})")
    draw = f"CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{s.seed}'), 1, 8)) AS BIGINT) / 4294967296.0"
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, round(weight, 6) AS weight, round(probability, 6) AS probability FROM d JOIN p USING (source, lang, topic) WHERE {draw} < probability"


QUERIES = {"op5_mixing_to_targets": op5}
ORACLES = {"op5_mixing_to_targets": sql()}
