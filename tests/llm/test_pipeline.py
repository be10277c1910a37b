"""Every stage of the corpus pipeline against a plain reading of it, on its own input."""

import re

import corpus_pipeline as pipeline
from aerodeck.llm import quality
from aerodeck.llm.jaccard import Rule
from tests.harness import ROOT
from tests.llm.test_jaccard import brute
from tests.llm.test_spans import brute_secrets

FOLDER = f"{ROOT}/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_stages(spark):
    docs = pipeline.table(spark, FOLDER, "documents")
    columns, stages = docs.columns, dict(pipeline.STAGES)
    labels = {r.doc_id: r.quality for r in pipeline.table(spark, FOLDER, "labels").collect()}
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, docs = texts(docs), pipeline.stored(stages["quality classifier"](spark, docs, FOLDER))
    kept = texts(docs)
    assert docs.columns == columns and kept.items() <= before.items()
    good = [i for i in before if labels.get(i) == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)

    docs = pipeline.stored(stages["n-gram Jaccard join"](spark, docs, FOLDER))
    assert docs.columns == columns
    assert sorted(texts(docs)) == sorted(i for i, _, root in brute(sorted(kept.items()), Rule(5, 80, 100)) if i == root)

    before, docs = texts(docs), pipeline.stored(stages["benchmark decontamination"](spark, docs, FOLDER))
    items = [" ".join(words(r.text)) for r in pipeline.table(spark, FOLDER, "benchmark").collect()]
    kept = texts(docs)
    whole = {i for i, t in before.items() if any(f" {x} " in f" {' '.join(words(t))} " for x in items if x)}
    assert docs.columns == columns and not whole & set(kept) and kept.items() <= before.items() and len(kept) >= 0.9 * (len(before) - len(whole))

    docs = pipeline.stored(stages["secret scans"](spark, docs, FOLDER))
    redacted = texts(docs)
    assert docs.columns == columns and set(redacted) == set(kept)
    for i, t in kept.items():
        assert not brute_secrets(redacted[i]) and (redacted[i] == t or brute_secrets(t) or "[SECRET]" in redacted[i])

    last = stages["mixing to target weights"](spark, docs, FOLDER)
    assert last.columns[: len(columns)] == columns and texts(last).items() <= redacted.items()


def test_empty_documents(spark):
    docs = pipeline.table(spark, FOLDER, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, FOLDER))
    assert docs.count() == 0


def test_held_out_folds(spark):
    row = spark.createDataFrame([(1,), (None,)], "doc_id long").select(quality.held_out("doc_id", 5, 0).alias("h")).collect()
    assert row[1].h is False
