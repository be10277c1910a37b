"""Top-k search, string tiling and substring dedup against brute force."""

import math
import random
import re

from aerodeck.llm import decontaminate, search, substrings


def brute_top(rows, queries, k):
    out = set()
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, a in {i: v for i, v in reversed(good) if i in queries}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def found(df, k, **more):
    rows = search.integers(df).where("vec_id IS NOT NULL")
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in search.top_k(rows, rows.where("vec_id % 20 = 0"), k, **more).collect()}


def test_top_k(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(16)]) for i in range(500)]
    rows += [(600 + i, rows[20][1]) for i in range(80)] + [(900, None), (901, [1.0] * 15 + [None]), (920, [float("nan")] * 16), (940, [float("inf")] * 16), (None, [1.0] * 16), (960, [1e12] * 16), (961, [-3.0] * 16)]
    df = spark.createDataFrame([(*x, "q") for x in rows], "vec_id long, embedding array<double>, query_id string").repartition(6)
    want = brute_top(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 20)
    assert found(df, 20) == want
    assert found(df, 20, block_rows=7, blocks=3, slice_of=3) == want


def test_top_k_of_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert found(spark.createDataFrame([], kind), 20) == set()
    assert found(spark.createDataFrame([(0, [1.0])], kind), 20) == set()
    assert found(spark.createDataFrame([(0, [1.0]), (1, [0.5]), (2, [])], kind), 20) == {(0, 1, 1, 2048), (0, 2, 2, 0)}


def brute_tiles(doc, item, k):
    """Greedy string tiling word by word."""
    marked_d, marked_i, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for x in range(len(doc)):
            for y in range(len(item)):
                n = 0
                while x + n < len(doc) and y + n < len(item) and doc[x + n] == item[y + n] and x + n not in marked_d and y + n not in marked_i:
                    n += 1
                best = max(best, (n, -x, -y))
        n, x, y = best[0], -best[1], -best[2]
        if n < k:
            return total
        total += n
        marked_d |= set(range(x, x + n))
        marked_i |= set(range(y, y + n))


def test_tiling(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, [r.choice(vocab) for _ in range(r.choice([3, 6, 20, 40]))]) for i in range(12)]
    docs = []
    for d in range(60):
        words = [r.choice(vocab) for _ in range(r.randrange(0, 60))]
        item = list(r.choice(items)[1])
        if d % 3 == 0:
            cut = len(item) // 2
            item = item[cut:] + ["zz"] + item[:cut]
        if d % 5 == 0 and len(item) > 8:
            item[len(item) // 3] = "changed"
        docs.append((d, words + item + words[:5]))
    docs += [(100, []), (101, ["of"] * 3000), (102, items[1][1]), (102, items[1][1])]
    items += [(50, []), (51, ["of"] * 30), (52, items[1][1])]
    df = spark.createDataFrame([(d, ", ".join(w).upper(), 1) for d, w in docs] + [(None, "w1", 1), (103, None, 1)], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(53, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered_words for r in decontaminate.contaminated(df, bench).collect()}
    want = {}
    for d, w in docs:
        for i, item in items:
            if d != 101 and item and i != 51:
                n = brute_tiles(w, item, min(5, len(item)))
                if n >= 0.8 * len(item) - 1e-9:
                    want[(d, i)] = n
    want[(101, 51)] = 30
    assert got == want
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == ({d for d, _ in docs} | {None, 103}) - {d for d, _ in want}
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_repeated_passages(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    prose = lambda n: [word() for _ in range(n)]
    passage, line = prose(55), prose(60)
    near = [*line[:30], "edited", *line[31:]]
    docs = [(d, " ".join(prose(r.randrange(80, 200)) + passage + prose(40))) for d in range(6)]
    docs += [(10, " ".join(prose(30)) + "\n" + " ".join(line)), (11, " ".join(line) + "\n" + " ".join(prose(50))), (12, " ".join(prose(30)) + "\n" + " ".join(near))]
    docs += [(20 + d, " ".join(prose(120))) for d in range(6)] + [(30, None), (31, ""), (None, " ".join(line)), (32, "\n".join([" ".join(line[::-1])] * 3))]
    df = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, start int").repartition(4)
    rows = substrings.repeated(df).collect()
    assert {x.doc_id for x in rows} == {*range(6), 10, 11, 12}
    texts = {d: (t or "").split() for d, t in docs}
    for x in rows:
        if x.doc_id < 6:
            assert set(texts[x.doc_id][x.start : x.end]) <= set(passage) and x.class_id == 0 and x.removed == (x.doc_id != 0)
    assert any(x.doc_id == 12 and x.removed and x.end - x.start == 60 and x.class_id == 10 for x in rows)
    out = {x.doc_id: x.text for x in substrings.without_repeats(df).collect()}
    assert out[0] == dict(docs)[0] and out[20] == dict(docs)[20] and out[30] is None
    assert len(re.findall(r"\S+", out[3])) <= len(texts[3]) - 25 and "edited" not in out[12]
    assert substrings.repeated(df.limit(0)).count() == 0


def test_whole_passages_are_marked(spark):
    r = random.Random(8)
    prose = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    docs, want = [], {}
    for n, size in enumerate([51, 55, 64, 90, 200]):
        passage = prose(size)
        for d in range(3):
            before = r.randrange(30, 120)
            docs.append((10 * n + d, " ".join(prose(before) + passage + prose(40))))
            want[10 * n + d] = (before, before + size, d > 0)
    inner, left, right = prose(60), prose(12), prose(12)
    docs += [(100, " ".join(prose(50) + inner + prose(50))), *((d, " ".join(prose(40) + left + inner + right + prose(40))) for d in (101, 102))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = substrings.repeated(df).collect()
    for d, (start, end, removed) in want.items():
        assert [(x.start, x.end, x.removed) for x in rows if x.doc_id == d] == [(start, end, removed)]
    # What only the later two share stays in the first of them.
    assert {(x.doc_id, x.start, x.end) for x in rows if x.removed and x.doc_id >= 100} == {(101, 52, 112), (102, 40, 124)}


def test_paragraphs_that_repeat_a_phrase_differently_meet(spark):
    phrase = [f"w{i}" for i in range(30)]
    # Rotated starts and other numbers of turns: the sets of runs are equal, the numbers of runs are 116 and 86.
    docs = [(1, " ".join(phrase * 4)), (2, " ".join((phrase[7:] + phrase[:7]) * 3))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r.n for r in substrings.units(df, substrings.Settings()).where("bands IS NOT NULL").collect()}
    assert rows == {1: 30, 2: 30}
    got = {(x.doc_id, x.start, x.end) for x in substrings.repeated(df).collect() if x.removed}
    assert (2, 0, 90) in got


def test_bands_reach_the_recall():
    s = substrings.Settings()
    assert s.bands >= substrings.tuned(0.8, s.rows, 0.99)
