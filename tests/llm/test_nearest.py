"""Approximate nearest neighbours against brute force."""

import dataclasses
import math
import random

import numpy as np

from aerodeck.llm import nearest


def brute(rows, queries, k):
    good = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in queries:
        own = [v for i, v in good if i == q]
        if own:
            a = min(own)
            far = lambda b: math.sqrt(sum((x - y) ** 2 for x, y in zip([*a, *[0.0] * (len(b) - len(a))], [*b, *[0.0] * (len(a) - len(b))])))
            out[q] = sorted((far(b), i) for i, b in good if i != q)[:k]
    return out


def found(df, k=10, every=100, **more):
    rows = nearest.vectors_of(df)
    out = {}
    for r in nearest.nearest(rows, rows.where(f"vec_id % {every} = 0"), k, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def sample_rows(seed, n, width=24, clusters=0):
    r = random.Random(seed)
    middles = [[r.gauss(0, 8) for _ in range(width)] for _ in range(clusters)]
    return [(i, [(middles[i % clusters][d] if clusters else 0.0) + r.gauss(0, 1) for d in range(width)]) for i in range(n)]


def recall(got, want):
    hits = sum(len({i for _, i in got[q]} & {i for _, i in rows}) for q, rows in want.items())
    return hits / sum(map(len, want.values()))


def test_recall_and_scores(spark):
    for seed, clusters in ((1, 0), (2, 30)):
        rows = sample_rows(seed, 3000, clusters=clusters)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
        got, want = found(df, every=50), brute(rows, range(0, 3000, 50), 10)
        assert got.keys() == want.keys() and recall(got, want) >= 0.95
        exact = dict(rows)
        for q, near in got.items():
            assert len(near) == 10 and near == sorted(near)
            assert all(math.isclose(s, math.dist(exact[q], exact[i]), rel_tol=1e-12) for s, i in near)


def test_clusters_need_few_probes(spark):
    few, most = (nearest.fitted(nearest.vectors_of(spark.createDataFrame(sample_rows(3, 3000, clusters=n), "vec_id long, embedding array<double>")), 10, 0.98) for n in (4, 0))
    assert few.probes < most.probes


def test_all_lists_without_tests_are_exact(spark):
    """Ties, copies, null, zero, short and huge vectors, null and repeated ids, clashing columns."""
    rows = sample_rows(5, 400, 8)
    rows += [(1000 + i, rows[100][1]) for i in range(30)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7 + [None]), (2100, [float("nan")] * 8), (2200, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(300, [0.5] * 8), (300, [0.5] * 8), (2300, [0.1, 0.2]), (2400, [])]
    df = spark.createDataFrame([(*x, 0, 0, 0.0) for x in rows], "vec_id long, embedding array<double>, query_id int, rank int, score double").repartition(6)
    vectors = nearest.vectors_of(df).where(nearest.usable("vector"))
    fit = nearest.fitted(vectors, 10, 1.0)
    fit = dataclasses.replace(fit, probes=len(fit.centroids))
    want = brute(rows, range(0, 3000, 100), 10)
    for block in (4096, 2):
        got = found(df, eps=100.0, fit=fit, block_rows=block)
        assert got.keys() == want.keys()
        for q in want:
            assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-12)


def test_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert found(spark.createDataFrame([], kind)) == {}
    assert found(spark.createDataFrame([(0, [0.0, 0.0])], kind)) == {}
    assert found(spark.createDataFrame([(0, [1.0, 0.0])], kind)) == {}
    assert found(spark.createDataFrame([(0, [1.0]), (1, [3.0]), (7, [2.0])], kind)) == {0: [(1.0, 7), (2.0, 1)]}


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got, want = found(df), brute(rows, [i for i, _ in rows if i % 100 == 0], 10)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
