"""License scans: sparse TF-IDF cosine of notices to templates, and inheritance along directories.

Every line of a whole text that holds a telling word of the templates is a notice; so are the
groups of two to four lines around it, its paragraph and the text, so that wrapped headers and licence files
are compared as wholes, paragraphs and texts with full licences too. Its words are weighted by tf * idf (idf over the
templates, words outside them count as rarest) and compared with every template by a sparse dot product:
an equi-join on words with the fixed template table. The best template at the threshold is
the licence of the document. A document that reaches a licence as a whole, or is mostly
notice, is a licence file and speaks for its directory; documents without a notice take the licence of the nearest directory above them that has
one, found by joining the ancestors of each distinct directory with the declared ones.

Documents here have no paths, so ``document_paths`` gives them one from given columns:
source / language / hundreds of the id / id. All of it is DataFrame expressions.

Defined cases: null and empty texts have no notice; of equally good templates the first by name counts; of several
licence files in a directory the first path counts; rows with the same path are each scanned; a null
path has no directory and inherits nothing; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

# Short public notices of common licences, among them standard headers, and SPDX identifiers.
SPDX = {
    "AGPL-3.0": "AGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "BSL-1.0": "BSL-1.0",
    "CC-BY-4.0": "CC-BY-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0": "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0": "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0": "CC-BY-ND-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC0-1.0": "CC0-1.0",
    "EPL-2.0": "EPL-2.0", "GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0": "GPL-3.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "ISC": "ISC",
    "LGPL-2.1": "LGPL-2.1", "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0": "LGPL-3.0", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "MIT": "MIT", "MPL-2.0": "MPL-2.0", "Unlicense": "Unlicense", "Zlib": "Zlib",
}
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = [
    *((name, f"SPDX-License-Identifier: {i}") for i, name in SPDX.items()),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL", "This program is free software: you can redistribute it and/or modify"),
    ("GPL-2.0", GNU.format(2)),
    ("GPL-3.0", GNU.format(3)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Licensed under the ISC License."),
    ("LGPL-2.1", GNU.format(2.1).replace("program", "library").replace("GNU", "GNU Lesser")),
    ("LGPL-3.0", GNU.format(3).replace("program", "library").replace("GNU", "GNU Lesser")),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright (c) All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the license conditions are met."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is released under the CC0 1.0 Universal public domain dedication license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software; the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved. No license is granted without prior written permission."),
]
# These say less than a licence: they count where a document has no other notice, and never for a directory.
WEAK = {"All rights reserved.", "Copyright (c) All rights reserved.", "This program is free software: you can redistribute it and/or modify"}
# Words that no notice consists of alone; "mit" and "nd" are words of other languages too.
COMMON = set("a all an and any are as at be by can either except for following general in into is it its later library may met mit nd no not of on only option or person prior program public that the this to under use version with without work written you your".split())


def gate(templates: list[tuple[str, str]], threshold: float) -> str:
    """Pattern of telling words of which every notice holds one.

    The telling words left out of a template have, with its common ones, less than threshold^2 of its squared
    weight, so a text of these alone stays below; or none is left out, and a text below is one of common words.
    """
    texts = [Counter(w for w in re.split(r"[^a-z0-9.]+|\.(?![0-9])|(?<![0-9])\.", text.lower()) if w) for _, text in templates]
    df = Counter(w for x in texts for w in x)
    out = set()
    for x in texts:
        weight = {w: (n * (math.log((len(texts) + 1) / (df[w] + 1)) + 1)) ** 2 for w, n in x.items()}
        left, total = sum(weight.values()), sum(weight.values())
        telling = [w for w in x if w not in COMMON and len(w) > 1 and not w.replace(".", "").isdigit()]
        for w in sorted(telling, key=lambda w: (w not in out, -weight[w], w)):
            if left < (threshold - 1e-6) ** 2 * total:
                break
            out.add(w)
            left -= weight[w]
    return f"(?i)(?<![a-z0-9])(?:{'|'.join(map(re.escape, sorted(out)))})(?![a-z0-9])"


def full_texts() -> list[tuple[str, str]]:
    """(license, text) of the full licences beside this module."""
    return [(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


NOTICE = gate(TEMPLATES, 0.6)


@dataclass(frozen=True)
class Settings:
    """``threshold``: cosine of a notice; ``share``: of a licence file's words that are notice; ``group``: lines of a group."""

    threshold: float = 0.6
    share: float = 0.5
    group: int = 4


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9.]+|\\.(?![0-9])|(?<![0-9])\\."), lambda w: w != "")


def template_vectors(spark: SparkSession, templates: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(template, license, weak, word, weight) with unit length, and (word, idf)."""
    texts = spark.createDataFrame([(i, name, text in WEAK, text) for i, (name, text) in enumerate(templates)], "template int, license string, weak boolean, text string")
    tf = texts.select("template", "license", "weak", F.explode(words(F.col("text"))).alias("word")).groupBy("template", "license", "weak", "word").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("word").agg((F.log(F.lit(len(templates) + 1.0) / (F.count("*") + 1.0)) + 1.0).alias("idf"))
    weighted = tf.join(F.broadcast(idf), "word").withColumn("weight", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighted.join(F.broadcast(norm), "template").select("template", "license", "weak", "word", (F.col("weight") / F.col("norm")).alias("weight")), idf


def notices(docs: DataFrame, notice: str = NOTICE, group: int = Settings.group) -> DataFrame:
    """(path, key, line, kind, total, n): the notices of whole texts, and the words of the text and of its notices.

    Kinds are line, group, paragraph and text.
    """
    units = lambda texts, kind: F.transform(texts, lambda x: F.struct(x.alias("line"), F.lit(kind).alias("kind")))
    hit = lambda x: x.rlike(notice)
    rows = docs.where(F.coalesce(hit(F.col("text")), F.lit(False))).select("path", F.xxhash64("text").alias("key"), "text", F.split("text", "\n").alias("lines"), F.regexp_count("text", F.lit(r"\S+")).alias("total"))
    at = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: hit(F.get("lines", i)))
    of_size = lambda i, n: F.transform(F.sequence(F.greatest(i - n + 1, F.lit(0)), i), lambda j: F.array_join(F.slice("lines", j + 1, n), "\n"))
    groups = F.array_distinct(F.flatten(F.transform(at, lambda i: F.flatten(F.transform(F.sequence(F.lit(2), F.lit(group)), lambda n: of_size(i, n))))))
    paragraphs = F.filter(F.split("text", r"\n\s*\n"), hit)
    every = F.concat(units(F.filter("lines", hit), "line"), units(F.when(F.size("lines") > 1, groups).otherwise(F.array().cast("array<string>")), "group"), units(paragraphs, "paragraph"), units(F.array("text"), "text"))
    return rows.select("path", "key", "total", F.explode(every).alias("u")).select("path", "key", "total", "u.line", "u.kind").withColumn("n", F.regexp_count("line", F.lit(r"\S+")))


def best(texts: DataFrame, templates: list[tuple[str, str]], s: Settings) -> DataFrame:
    """(line, license, weak, cosine): of every distinct text the best template at the threshold."""
    vectors, idf = template_vectors(texts.sparkSession, templates)
    rarest = F.lit(math.log(len(templates) + 1.0) + 1.0)  # of a word that no template holds
    # Equal notices are compared once, however many documents hold them.
    lines = texts.distinct().select("line", F.xxhash64("line").alias("text_id")).select("text_id", F.explode(words(F.col("line"))).alias("word")).groupBy("text_id", "word").agg(F.count("*").alias("tf"))
    weighted = stored(lines.join(F.broadcast(idf), "word", "left").select("text_id", "word", (F.col("tf") * F.coalesce("idf", rarest)).alias("weight")))
    norm = weighted.groupBy("text_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dot = weighted.join(F.broadcast(vectors.withColumnRenamed("weight", "unit")), "word").groupBy("text_id", "template", "license", "weak").agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"))
    cosine = dot.join(norm, "text_id").select("text_id", "license", "weak", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).where(F.col("cosine") >= s.threshold)
    return cosine.groupBy("text_id").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "license", "weak", "cosine")).alias("b")).select("text_id", "b.license", "b.weak", "b.cosine")


def matched(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, s: Settings = Settings()) -> DataFrame:
    """(path, key, license, cosine, is_file) of the rows with a notice at the threshold."""
    found = stored(notices(docs, gate(templates, s.threshold), s.group))
    short = best(found.select("line"), templates, s)
    full = best(found.where("kind IN ('paragraph', 'text')").select("line"), full_texts(), s)
    both = stored(short.unionByName(full).groupBy("text_id").agg(F.min(F.struct("weak", (-F.col("cosine")).alias("order"), "license", "cosine")).alias("b")).select("text_id", "b.license", "b.weak", "b.cosine"))
    met = found.select("path", "key", "total", "kind", "n", F.xxhash64("line").alias("text_id")).join(both, "text_id")
    n = F.sum(F.when(F.col("kind") == "line", F.col("n")).otherwise(0))
    whole = F.max((F.col("kind") == "text") & ~F.col("weak"))
    # A licence that the text reaches as a whole comes before those of its parts.
    rows = met.groupBy("path", "key", "total").agg(F.min(F.struct("weak", (F.col("kind") != "text").alias("part"), (-F.col("cosine")).alias("order"), "license", "cosine")).alias("b"), n.alias("n"), whole.alias("whole"))
    return rows.select("path", "key", "b.license", "b.cosine", (~F.col("b.weak") & (F.col("whole") | (F.col("n") >= F.lit(s.share) * F.col("total")))).alias("is_file"))


def directory(path: str) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(folder: str) -> Column:
    """The directory itself and all above it, the root being the empty string."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def inherited(paths: DataFrame, declared: DataFrame) -> DataFrame:
    """(folder, license, from_folder): of every distinct directory, the nearest declared one at or above it."""
    folders = paths.where("path IS NOT NULL").select(directory("path").alias("folder")).distinct()
    up = folders.select("folder", F.explode(F.array_distinct(ancestors("folder"))).alias("above"))
    met = up.join(declared.withColumnRenamed("folder", "above"), "above")
    return met.groupBy("folder").agg(F.max(F.struct(F.length("above").alias("depth"), F.col("above").alias("from_folder"), "license")).alias("b")).select("folder", "b.license", "b.from_folder")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, s: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs`` (path, text): path, key, license, how (header, file, inherited), cosine, from_folder."""
    own = stored(matched(docs, templates, s))
    declared = own.where("is_file AND path IS NOT NULL").groupBy(directory("path").alias("folder")).agg(F.min(F.struct("path", "license")).alias("b")).select("folder", "b.license")
    above = inherited(docs, declared).withColumnsRenamed({"license": "up_license", "folder": "up_folder"})
    rows = docs.select("path", F.xxhash64("text").alias("key"), directory("path").alias("folder")).alias("d")
    o = own.alias("o")
    both = rows.join(o, F.col("d.path").eqNullSafe(F.col("o.path")) & (F.col("d.key") == F.col("o.key")), "left").join(above, F.col("d.folder") == F.col("up_folder"), "left")
    how = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("up_license").isNotNull(), "inherited")
    return both.select("d.path", "d.key", F.coalesce("license", "up_license").alias("license"), how.alias("how"), "cosine", F.when(F.col("license").isNull(), F.col("from_folder")).alias("from_folder"))


def document_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text) with a path from the columns of a document."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")


def op9(spark, sf_dir: str) -> DataFrame:
    got = scan(document_paths(table(spark, sf_dir, "documents")))
    return got.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "license", "how", "cosine", "from_folder")


QUERIES = {"op9_license_scans": op9}
ORACLES: dict[str, str] = {}
