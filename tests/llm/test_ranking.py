"""Ranked lexical search against brute force, and its bounds against the truth."""

import math
import random
import re
from collections import Counter

import numpy as np

from aerodeck.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = {}
    for item in {i for i, _ in items}:
        texts = [t for i, t in items if i == item and t is not None]
        scored = []
        for d, c, n in held:
            m = 10 + 90 * n * n_docs // length
            got = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(min(texts) if texts else "")) if t in c)
            if got > 0 and d is not None:
                scored.append((-got, d))
        if scored:
            out[item] = [(rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k])]
    return out


def found(docs, items, k=10, **more):
    out = {}
    for r in ranking.search(docs, items, k, **more).orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return out


def tables(seed, n_docs=700):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda n: " ".join(r.choices(vocab, weights, k=n))
    docs = [(d, text(r.randrange(0, 60))) for d in range(n_docs)]
    items = [(i, text(r.choice([1, 2, 5, 15, 30]))) for i in range(40)]
    docs += [(2000 + i, docs[5][1] + " W1, w2") for i in range(40)]  # ties
    docs += [(3000, None), (3001, ""), (3002, " .,;"), (3003, text(30_000)), (None, items[1][1]), (7, items[1][1]), (7, items[1][1]), (3004, "Été été ÉTÉ naïve_x Iİ"), (3005, "x" * 100_000)]
    items += [(100, None), (101, ""), (102, "nothing here"), (103, "été Iİ naïve"), (1, "zz w3"), (None, "w10 w11"), (104, "w0"), (105, "x" * 100_000)]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, item_id int, rank int, score int").repartition(5),
            spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int"))


def test_ranking(spark):
    docs, items = tables(3)
    want = brute(docs, items)
    assert found(*frames(spark, docs, items)) == want
    assert found(*frames(spark, docs, items), block_terms=4000) == want  # several blocks of items
    assert found(*frames(spark, docs, items), k=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = frames(spark, *tables(4, 20))
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text IS NULL"), items), (docs, items.where("item_id = 100"))):
        got = ranking.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_pair_bounds_are_safe_and_tighter(spark):
    docs, items = tables(6)
    df, _ = frames(spark, docs, items)
    texts = [sorted({t.encode() for t in words(x)}) for _, x in items if words(x)]
    vocabulary = {t: i for i, t in enumerate(sorted({t for x in texts for t in x}))}
    index = ranking.forward(df, vocabulary)
    corpus = ranking.corpus_of(index, len(vocabulary))
    maxima = ranking.term_maxima(index, corpus)
    asked = [sorted((vocabulary[t] for t in x), key=lambda t: (maxima[t], t)) for x in texts]
    joint, cutoff = ranking.pair_index(index, corpus, asked, 10)
    block = ranking.Postings(index.toArrow().combine_chunks().to_batches()[0], corpus)
    tighter = 0
    for terms, cut in zip(asked, cutoff, strict=True):
        bound = ranking.bounds(terms, maxima, joint)
        plain = np.concatenate([[0], np.cumsum(maxima[terms])])
        tighter += bound[-1] < plain[-1]
        so_far = np.zeros(block.size, np.int64)
        for j, t in enumerate(terms):
            so_far += block.look_up(t, np.arange(block.size))
            assert so_far.max() <= bound[j + 1] <= plain[j + 1]
        full = np.sort(so_far[block.returned])[::-1]
        assert cut <= max(1, full[9])
    assert tighter > len(asked) // 4
