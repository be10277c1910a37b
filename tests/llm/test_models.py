"""Quality, toxicity, mixing and licences: held-out accuracy, brute force and odd rows."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aerodeck.llm import licenses, mixing, quality, toxicity
from tests.harness import ROOT

ODD = [(1, None, 3), (2, "", 4), (None, "x", 5), (4, "word " * 40_000, 6), (5, "same", 7), (5, "same", 7)]
ODD_SCHEMA = "doc_id long, text string, _mass long"


def labelled(spark, label):
    docs, labels = spark.read.parquet(f"{ROOT}/sf0.01/documents.parquet"), spark.read.parquet(f"{ROOT}/sf0.01/labels.parquet")
    return docs.select("doc_id", "text"), labels.select("doc_id", label)


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").select("held_out", "predicted", label).where("held_out").collect()
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_quality_on_held_out_documents(spark):
    docs, labels = labelled(spark, "quality")
    s = quality.Settings()
    w = quality.train(docs, labels.where(~quality.held_out("doc_id", 5, 0)), s)
    got = quality.score(docs, w, s).select("doc_id", "score", quality.held_out("doc_id", 5, 0).alias("held_out")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
    assert accuracy(got, labels, "quality") >= 0.95
    for r in docs.join(got, "doc_id").limit(5).collect():
        at, x = quality.features(r.text, quality.Tokens(), s)
        assert math.isclose(r.score, 1 / (1 + math.exp(-float(w[at] @ x))), rel_tol=1e-9)


def test_updates_follow_the_regularised_leader():
    s = quality.Settings(bits=10)
    z, n, zz, nn = np.zeros(1024), np.zeros(1024), defaultdict(float), defaultdict(float)
    rows = [("good plain words here", 1.0), ("BAD!! WORDS!! HERE!!", 0.0), ("", 1.0), (None, 0.0)] * 3
    quality.ftrl_pass(rows, z, n, s)
    for text, y in rows:
        at, x = quality.features(text, quality.Tokens(), s)
        w = {i: 0.0 if abs(zz[i]) <= s.l1 else -(zz[i] - math.copysign(s.l1, zz[i])) / ((s.beta + math.sqrt(nn[i])) / s.alpha + s.l2) for i in at}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, x))))
        for i, v in zip(at, x):
            g = (p - y) * v
            zz[i] += g - (math.sqrt(nn[i] + g * g) - math.sqrt(nn[i])) / s.alpha * w[i]
            nn[i] += g * g
    assert np.allclose(z, [zz[i] for i in range(1024)]) and np.allclose(n, [nn[i] for i in range(1024)])


def test_scores_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not quality.train(df, none).any()
    got = quality.score(df, np.zeros(1 << 18)).collect()
    assert len(got) == 6 and all(r.score == 0.5 for r in got)
    assert toxicity.learn(df, none) == toxicity.Lexicon({}, ())
    got = toxicity.score(df.drop("_mass"), toxicity.Lexicon({" word ": 5.0}, ()))
    assert all(0 < r.score < 1 for r in got.collect())
    empty = df.limit(0)
    assert quality.score(empty, np.zeros(1 << 18)).count() == 0 and quality.keep_good(empty, none).columns == df.columns


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(spark, "toxic")
    lexicon = toxicity.learn(docs, labels.where(~quality.held_out("doc_id", 4, 2)))
    got = toxicity.score(docs, lexicon).select("doc_id", "score", quality.held_out("doc_id", 4, 2).alias("held_out")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
    assert accuracy(got, labels, "toxic") >= 0.95


def test_lexicon_matching_against_brute_force():
    lexicon = toxicity.Lexicon({" idio": 4.0, " scum ": 3.0}, (" idiom ",))
    m = toxicity.Matcher(lexicon)
    brute = lambda words: sum(w * (1 + math.log(n)) for e, w in lexicon.weights.items() if (n := sum((x + " ").startswith(e[1:]) and x != "idiom" for x in words)))
    for text, words in [("You IDIOT, idiots!", ["you", "idiot", "idiots"]), ("an idiom", ["an", "idiom"]), ("1d10t $cum scumble", ["idiot", "scum", "scumble"]), ("іdіоt", ["idiot"]), ("", []), ("2010 10", ["2010", "10"])]:
        assert math.isclose(m.mass(text, 300)[0], brute(words)), text
    assert m.mass("scum " + "x " * 1199, 300)[0] == 3.0 / 2


def test_learnt_phrases_of_two_words_take_hits_away(spark):
    toxic = [f"you moron number{i} go" for i in range(60)]
    clean = [f"the moron telescope of site{i} works" for i in range(12)] + [f"a quiet day{i} of work" for i in range(600)]
    rows = [(i, t, int(i < 60)) for i, t in enumerate(toxic + clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    m = toxicity.Matcher(lexicon)
    assert " moron telescope " in lexicon.exceptions and not any(e.startswith(" you ") for e in lexicon.exceptions)
    assert m.mass("new moron telescope here", 300) == (0.0, 0)
    assert m.mass("M0ron, telescope", 300) == (0.0, 0) and m.mass("telescope moron", 300)[1] == 1 and m.mass("moron telescope moron", 300)[1] == 1
    both = toxicity.Matcher(toxicity.Lexicon({" idio": 4.0, " scum ": 3.0}, (" scum idiots ",)))
    assert both.mass("scum idiots", 300)[1] == 0 and both.mass("scum idiots scum", 300)[1] == 1


def test_folding_of_words_and_of_one_long_word():
    assert toxicity.folded("Sh1ft 1234 _ab4 n1ce!! plain") == "shift 1234 _aba nice   plain"
    long = "a" * 1_000_000
    assert toxicity.folded(long + " 4bc") == long + " abc"


def test_raking_against_brute_force(spark):
    r = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 300))) + (" |" * 40 if i % 7 == 0 else ""), ["en", "de", None][i % 3], f"s{min(i % 9, 4)}", i) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, None, None, None, 1)], "doc_id long, text string, lang string, source string, tokens long")
    s = mixing.Settings(rounds=12)
    got = mixing.mix(df, s).collect()
    cells = defaultdict(float)
    cell_of = {}
    for i, text, lang, source, _ in rows:
        n, bars = len(text.split()), text.count("|")
        cell_of[i] = (source or "", lang or "", "table" if bars * 10 >= n and bars else "note" if n < 100 else "article")
        cells[cell_of[i]] += n
    cells[("", "", "note")] += 0.0
    weight, total = {c: 1.0 for c in cells}, sum(cells.values())
    share = []
    for d, power in enumerate(s.temper):
        own = defaultdict(float)
        for c, t in cells.items():
            own[c[d]] += t
        norm = sum(t**power for t in own.values())
        share.append({v: t**power / norm for v, t in own.items()})
    for _ in range(s.rounds):
        for d in range(3):
            have = defaultdict(float)
            for c, t in cells.items():
                have[c[d]] += weight[c] * t
            weight = {c: w * share[d][c[d]] * total / have[c[d]] if have[c[d]] else w for c, w in weight.items()}
    for d in range(3):
        for v, want in share[d].items():
            assert abs(sum(weight[c] * t for c, t in cells.items() if c[d] == v) / total - want) < 0.03
    for row in got:
        if row.doc_id is not None:
            assert math.isclose(row._weight, weight[cell_of[row.doc_id]], rel_tol=1e-6) and 0 <= row._probability <= 1
    expected = sum(min(1, w / max(weight.values())) for w in weight.values())
    assert expected and 0.35 * total <= sum(len((r.text or "").split()) for r in got) <= 0.65 * total
    assert mixing.mix(df.limit(0), s).count() == 0


def test_columns_with_clashing_names(spark):
    """Columns named like added ones give way, in mixing and in the last stage; all others pass through, of any type."""
    docs = spark.createDataFrame([(i, "word " * (20 * i + 1), "en", "s", i, i, i, i) for i in range(40)], "doc_id long, text string, lang string, source string, _tokens long, _Weight long, mix_topic long, other long")
    got = mixing.mix(docs)
    assert got.columns.count("_tokens") == 1 and "_Weight" not in got.columns and all(r.other == r.doc_id and r._tokens == 20 * r.doc_id + 1 for r in got.collect())
    last = corpus_pipeline.by_mixture(spark, docs, "")
    assert last.columns == ["doc_id", "text", "lang", "source", "other", "mix_topic", "mix_tokens", "mix_weight", "mix_probability"]
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in got.collect()} and {r.mix_topic for r in last.collect()} <= {"note", "article"}
    with pytest.raises(ValueError):
        mixing.mix(docs, topic="_tokens")
    odd = docs.select("doc_id", "text", F.struct(F.col("other").alias("a b")).alias("nested"), F.lit(2.0).alias("_score"), F.lit(3.0).alias("_score0"))
    kept = quality.score(odd, np.zeros(1 << quality.Settings().bits), column="_score1")
    assert kept.columns == [*odd.columns, "_score1"] and {r[-1] for r in kept.collect()} == {0.5}


def brute_license(text, templates=licenses.TEMPLATES, threshold=0.6):
    words = lambda t: [w for w in re.split(r"[^a-z0-9.]+|\.(?![0-9])|(?<![0-9])\.", t.lower()) if w]
    df = defaultdict(int)
    for _, t in templates:
        for w in set(words(t)):
            df[w] += 1
    idf = lambda w: math.log((len(templates) + 1) / (df[w] + 1)) + 1 if w in df else math.log(len(templates) + 1) + 1

    def vector(t):
        v = defaultdict(float)
        for w in words(t):
            v[w] += idf(w)
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    best = []
    for line in (x for x in (text or "").split("\n") if re.search(licenses.NOTICE, x)):
        a = vector(line)
        best += [(-round(sum(x * b.get(w, 0) for w, x in a.items()), 9), name) for name, t in templates for b in [vector(t)]]
    best = [b for b in best if -b[0] >= threshold]
    return min(best) if best else None


def test_licences_and_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("a/LICENSE", mit), ("a/x.txt", "plain"), ("a/b/y.txt", "plain text"), ("a/b/c/LICENSE", gpl), ("a/b/c/d/z", None), ("q/z", ""), (None, gpl), ("q/h", f"{gpl} and so on\n" + "body " * 50), ("q/n", "license to word"),
            ("a/x.txt", "plain"), ("LICENSE", "All rights reserved."), ("w", "nothing"), ("q/long", "word " * 50_000 + "\nLicensed under CC BY-NC 4.0.")]
    got = sorted(((r.path, r.license, r.how, r.from_folder) for r in licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, license int")).collect()), key=str)
    assert ("a/LICENSE", "MIT", "file", None) in got and got.count(("a/x.txt", "MIT", "inherited", "a")) == 2
    assert ("a/b/y.txt", "MIT", "inherited", "a") in got and ("a/b/c/d/z", "GPL-3.0", "inherited", "a/b/c") in got
    assert (None, "GPL-3.0", "file", None) in got and ("q/h", "GPL-3.0", "header", None) in got and ("q/long", "CC-BY-NC-4.0", "header", None) in got
    assert ("q/z", None, None, None) in got and len(got) == len(rows)
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_licence_headers_and_short_forms(spark):
    want = {
        "All rights reserved.": "Proprietary", "# Copyright (c) 2020 Foo Inc. All rights reserved.": "Proprietary",
        "// SPDX-License-Identifier: MIT": "MIT", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
        "This program is free software; you can redistribute it and/or modify": "GPL",
        "Redistribution and use in source and binary forms, with or without": "BSD",
        "All rights reserved.\nThis file is released under the MIT License.": "MIT",
        "SPDX-License-Identifier: Nobody-7.3": None, "the use of this work is free for all": None, "You can modify the version you use": None,
    }
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame([(f"{i}/x", t) for i, t in enumerate(want)], "path string, text string")).collect()}
    assert [got[f"{i}/x"] for i in range(len(want))] == list(want.values())
    assert all(re.search(licenses.NOTICE, t) for _, t in licenses.TEMPLATES)


def test_licence_files_and_wrapped_headers(spark):
    wrap = lambda text, n, mark="": "\n".join(mark + " ".join(w[i : i + n]) for w in [text.split()] for i in range(0, len(w), n))
    full = dict(licenses.full_texts())
    files = {name: f"Copyright (c) 2020 Jane Roe. All rights reserved.\n\n{wrap(text, 11)}" for name, text in full.items()}
    header = "int a;\n" + wrap(licenses.GNU.format(3), 6, " * ") + "\n" + "\n".join(f"int b{i} = c{i};" for i in range(40))
    rows = [x for name, text in files.items() for x in [(f"{name}/LICENSE", text), (f"{name}/src/a.c", "int a;")]] + [("gnu/x.c", header)]
    got = {r.path: (r.license, r.how) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for name in full:
        assert got[f"{name}/LICENSE"] == (name, "file") and got[f"{name}/src/a.c"] == (name, "inherited")
    assert got["gnu/x.c"] == ("GPL-3.0", "header")


def test_licence_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{ROOT}/sf0.001/documents.parquet").collect()}
    for r in licenses.op9(spark, f"{ROOT}/sf0.001").collect():
        want = brute_license(texts[r.doc_id])
        if want:
            assert (r.license, r.cosine) == (want[1], -want[0])
        else:
            assert r.how in (None, "inherited")


def test_raking_broadcasts_nothing(spark, monkeypatch):
    """Each broadcast of a round stays in the driver's memory; the rounds join by a shuffle."""
    cells = spark.createDataFrame([("s1", "en", "note", 10.0), ("s1", "fr", "book", 30.0), ("s2", "en", "note", 60.0)], "_source string, _lang string, _topic string, tokens double")
    plans, keep = [], mixing.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(mixing, "stored", seen)
    target = keep(spark.createDataFrame([("s1", 0.5), ("s2", 0.5)], "_source string, target double"))
    got = {(r._source, r._lang): r.weight for r in mixing.raked(keep(cells), {"_source": target}, 2).collect()}
    assert got == {("s1", "en"): 1.25, ("s1", "fr"): 1.25, ("s2", "en"): 50 / 60}
    assert plans and not any("Broadcast" in p for p in plans)
