"""The n-gram Jaccard join against brute force, on planted copies and on odd rows."""

import random
import re

from aerodeck.llm.jaccard import Rule, jaccard_join, keep_one


def grams(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, rule):
    sets = [grams(t, rule.k) for _, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            x, y = sets[i], sets[j]
            if a is not None and b is not None and x and y and rule.den * len(x & y) >= rule.num * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted([(d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets, strict=True)], key=str)


def sample(seed, n=160):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    bases = [[r.choice(vocab) for _ in range(r.choice([1, 3, 5, 30, 60, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocab)
        text = " ".join(w)
        rows.append((i, text.upper() if r.random() < 0.1 else text))
    return rows


def check(spark, rows, rule):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted([tuple(r) for r in jaccard_join(df, rule).collect()], key=str)
    assert got == brute(rows, rule)


def test_planted_copies(spark):
    check(spark, sample(1), Rule())
    check(spark, sample(2), Rule(5, 80, 100))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (None, "one"), (6, "a b c"), (7, "A B C"), (7, "x y z w v"), (8, "X y z w v"),
            (8, "X y z w v"), (9, "É b c d"), (10, "é b c d"), (11, "a b"), (12, "word " * 30000), (13, "word " * 40000)]
    check(spark, rows, Rule())


def test_empty_and_clashing_columns(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6), (2, "a b c d e f", 7, 8), (3, "z", 9, 9)], "doc_id long, text string, n long, comp long")
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
