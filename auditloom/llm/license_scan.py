"""License scans: a trained paragraph classifier whose finds are confirmed against templates.

Paragraphs are the \\n-split lines of a text. Features are the word bigrams and trigrams of a
paragraph (lower-case letters and digits), present or not, hashed to 64 bits, and the share of its
n-grams that no template has, which speaks for the unknown class. A logistic regression with one class
for each licence family and one for everything else ("unknown") is fitted on variations of the
templates below and on a bounded sample of the table's own paragraphs. Its temperature is set by a
first fit that never sees every `HOLD_BACK`-th template of a family, nor every `HOLD_BACK`-th way to
put a notice or other text: on the variations of those, so on unseen wording; the fit that scores then
has all. A paragraph
is reported when a family beats the unknown class, and the find is confirmed when the paragraph and a
template of the family share enough n-grams.

N-grams that occur in no template count by their share alone, so each text is cut into n-grams once,
those with a weight are found by a join with the small table of weights, and the few rows that are
left are summed by paragraph.

Defined results: null, blank and one-word paragraphs are unknown; paragraphs of any length are read
whole; rows that repeat a doc_id and paragraph text are reported once; a null doc_id is reported as
such; families that tie in probability go to the first by name, and templates that tie in likeness to
the first in the list; extra columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import materialize

UNKNOWN = "unknown"
#: Paragraphs of the table in the training sample, at most.
SAMPLE_PARAGRAPHS = 1500
#: Of each family's templates, of the notices' wordings and of the other texts, one of so many is held back to set the temperature.
HOLD_BACK = 3
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.8

#: Notices as licences and their stewards word them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC license.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    ],
    "Unlicense": [
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "Licensed under the zlib license.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}
#: Names of the licences in notices.
NAMES = {
    "MIT": ["MIT License", "MIT license (MIT)"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License v2.0"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v2.1"],
    "AGPL": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD license"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC0": ["CC0 1.0"],
    "ISC": ["ISC License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib license"],
}
#: How notices speak of them.
FRAMES = [
    "Released under the {}.", "Licensed under the {}.", "This project is licensed under the terms of the {}.", "Distributed under the {}; see the file for details.",
    "The code in this repository is available under the {}.", "Except where otherwise noted, all content is under the {}.", "License: {}", "You may use this work under {} or later.",
    "Copyright (c) the authors, published under {}.",
]
#: Sentences that talk of such things without granting anything.
OTHER_TEXTS = [
    "He renewed his driving license last week.",
    "The MIT campus lies on the river.",
    "The Apache helicopter landed behind the hill.",
    "She studied general public health and free software at school.",
    "You may not use this door except in an emergency.",
    "A copy of the letter was distributed with this file of papers.",
    "The license fee is due at the end of the year.",
    "All of the above must be included in the report.",
    "The version 2.0 of this program was published by the foundation.",
    "Public domain works and attribution are the topic of the third lecture.",
    "A fishing license is required by law in this state.",
    "The work is under way and the terms of the contract are known.",
    "Terms and conditions apply to all orders placed on this site.",
    "All rights reserved. No part of this book may be copied without the written permission of the publisher.",
    "He was licensed under state law to practice medicine.",
    "The creative commons room of the library is open to the public.",
    "Copyright law protects the author of a work for many years.",
    "The software was released in March and is free for students.",
    "The public license office is closed on Mondays.",
    "Subject to the following restrictions, visitors may use the garden for any purpose.",
]


def grams_of(table: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, n_grams (distinct positions' n-grams counted with repeats), gram: a row for each bigram and trigram."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    rows = table.select(*keys, hashed.alias("__h")).where(F.size("__h") >= 2)
    size = F.size("__h")
    zipped = F.arrays_zip(
        F.slice("__h", 1, size - 1).alias("a"), F.slice("__h", 2, size - 1).alias("b"), F.slice("__h", 3, F.greatest(size - 2, F.lit(0))).alias("c")
    )
    rows = rows.select(*keys, (2 * size - 3).cast("long").alias("n_grams"), F.inline(zipped))
    both = F.array(F.xxhash64("a", "b"), F.when(F.col("c").isNotNull(), F.xxhash64("a", "b", "c")))
    return rows.select(*keys, "n_grams", F.explode(both).alias("gram")).where(F.col("gram").isNotNull())


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0), line, line_hash."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("paragraph", "line"))
    return lines.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "line", F.xxhash64("line").alias("line_hash"))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from values in the driver, as one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _variations() -> list[tuple[str, str, bool]]:
    """(text, class, held back): the templates whole, their halves if long, and with usual words around; notices; the other texts.

    Held back are every `HOLD_BACK`-th template of a family that has so many, every `HOLD_BACK`-th way
    to put a notice, and every `HOLD_BACK`-th other text, each with all that is made of it.
    """
    last = HOLD_BACK - 1
    out = []
    for family, own in TEMPLATES.items():
        for k, t in enumerate(own):
            words = t.split()
            half = len(words) // 2
            made = [t, f"{t} See the file for details.", f"Copyright (c) the authors. {t}", f"The code in this repository: {t}", f"// {t}"]
            made += [" ".join(words[:half]), " ".join(words[half:])] if len(words) >= 16 else []
            out += [(x, family, k % HOLD_BACK == last) for x in made]
        out += [(frame.format(name), family, k % HOLD_BACK == last) for name in NAMES[family] for k, frame in enumerate(FRAMES)]
    return out + [(t, UNKNOWN, k % HOLD_BACK == last) for k, t in enumerate(OTHER_TEXTS)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _regress(x: np.ndarray, y: np.ndarray, rounds: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and constants of the softmax regression, classes balanced; full-batch steps with per-weight scaling (Adam)."""
    weight = 1.0 / np.maximum(y.sum(axis=0), 1)[y.argmax(axis=1)]
    weight /= weight.sum()
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, rounds + 1):
        error = (_softmax(x @ w + b) - y) * weight[:, None]
        for m, v, p, g in ((mw, vw, w, x.T @ error + decay * w), (mb, vb, b, error.sum(axis=0))):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w, b


def sample_lines(docs: DataFrame, most: int = SAMPLE_PARAGRAPHS) -> list[str]:
    """At most `most` distinct paragraphs, those of the least hash. Tasks hand on what lies below a bound of the hash that twice as many rows are expected under."""
    lines = paragraphs(docs).where(F.length("line") > 0)
    n = lines.count()
    at = F.shiftrightunsigned("line_hash", 11).cast("double") / float(1 << 53)
    rows = lines.where(at <= min(1.0, (2.0 * most + 100) / max(n, 1))).select("line_hash", "line").distinct().collect()
    return [r["line"] for r in sorted(rows, key=lambda r: (r["line_hash"] & ((1 << 64) - 1), r["line"]))[:most]]


def fit(spark: SparkSession, docs: DataFrame, sample_paragraphs: int = SAMPLE_PARAGRAPHS, rounds: int = 400, decay: float = 1e-4) -> dict:
    """Weights by n-gram, of the share without a template, constant terms and temperature. The n-grams are cut by Spark, the fit runs on the driver."""
    classes = [*sorted(TEMPLATES), UNKNOWN]
    flat = [t for f in classes[:-1] for t in TEMPLATES[f]]
    owner = [f for f in classes[:-1] for _ in TEMPLATES[f]]
    made, plain = _variations(), sample_lines(docs, sample_paragraphs)
    every = flat + [t for t, _, _ in made] + plain
    found = grams_of(_table(spark, [{"id": k, "t": t} for k, t in enumerate(every)], "id: long, t: string"), ["id"], "t").distinct().collect()
    own, sizes = [set() for _ in every], np.ones(len(every))
    for r in found:
        own[r["id"]].add(r["gram"])
        sizes[r["id"]] = r["n_grams"]
    whole = own[: len(flat)]
    known = {g: k for k, g in enumerate(sorted(set().union(*whole)))}
    templates = [{"gram": g, "template": k, "family": owner[k], "size": len(grams)} for k, grams in enumerate(whole) for g in sorted(grams)]
    # Paragraphs of the sample that hold most of a template are no examples of the unknown class.
    rows = [(k, c, held) for k, (_, c, held) in enumerate(made, len(flat))]
    rows += [(k, UNKNOWN, k % HOLD_BACK == 0) for k in range(len(flat) + len(made), len(every)) if all(2 * len(own[k] & t) < len(t) for t in whole)]
    x, y, held = np.zeros((len(rows), len(known) + 1)), np.zeros((len(rows), len(classes))), np.array([h for _, _, h in rows])
    for at, (k, c, _) in enumerate(rows):
        there = [known[g] for g in own[k] if g in known]
        x[at, there] = 1
        x[at, -1] = 1 - len(there) / max(sizes[k], 1)
        y[at, classes.index(c)] = 1
    w, b = _regress(x[~held], y[~held], rounds, decay)
    z, true = x[held] @ w + b, y[held].argmax(axis=1)
    # Each class of the held-back examples counts the same, as in the fit.
    share = 1.0 / np.bincount(true, minlength=len(classes))[true]
    loss = lambda t: -float(np.average(np.log(_softmax(z / t)[np.arange(len(z)), true] + 1e-12), weights=share))
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    held_back = {"right": float(np.average(z.argmax(axis=1) == true, weights=share)), "loss": loss(temperature), "sure": float(np.average(_softmax(z / temperature).max(axis=1), weights=share))}
    w, b = (v / temperature for v in _regress(x, y, rounds, decay))
    weights = [{"gram": g, "w": [round(float(v), 6) for v in w[k]]} for g, k in known.items()]
    rounded = lambda vs: [round(float(v), 6) for v in vs]
    return {"classes": classes, "weights": weights, "strange": rounded(w[-1]), "bias": rounded(b), "templates": templates, "temperature": temperature, "texts": flat, "held_back": held_back}


def scan(spark: SparkSession, docs: DataFrame, model: dict, min_probability: float = MIN_PROBABILITY, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """A row for each paragraph with a licence: doc_id, paragraph, family, probability, template, similarity, confirmed."""
    classes, key = model["classes"], ["doc_id", "paragraph", "line_hash"]
    weights = materialize(_table(spark, model["weights"], "gram: bigint, w: array<double>"))
    templates = _table(spark, model["templates"], "gram: bigint, template: bigint, family: string, size: bigint")
    # Both tables have a row for each n-gram of the fixed templates.
    found = grams_of(paragraphs(docs), key, "line").join(F.broadcast(weights.select("gram")), "gram", "left_semi")
    found = materialize(found.distinct())
    same = lambda t: [F.col(k).eqNullSafe(t[f"__{k}"]) for k in key]
    strange = F.lit(1.0) - F.count(F.lit(1)) / F.col("n_grams")  # the share of n-grams that no template has
    logits = found.join(F.broadcast(weights), "gram").groupBy(*key, "n_grams").agg(
        *[(F.sum(F.col("w")[k]) + F.lit(model["bias"][k]) + strange * model["strange"][k]).alias(f"z{k}") for k in range(len(classes))]
    )
    top = F.greatest(*[F.col(f"z{k}") for k in range(len(classes))])
    total = sum((F.exp(F.col(f"z{k}") - F.col("top")) for k in range(len(classes))), F.lit(0.0))
    best = F.greatest(*[F.struct(F.col(f"z{k}").alias("z"), F.lit(-k).alias("k")) for k in range(len(classes))])
    judged = (
        logits.withColumn("top", top)
        .withColumn("total", total)
        .select(*key, "n_grams", F.element_at(F.array(*map(F.lit, classes)), F.lit(1) - best["k"]).alias("family"), (F.lit(1.0) / F.col("total")).alias("probability"))
        .where((F.col("family") != UNKNOWN) & (F.col("probability") >= min_probability))
    )
    shared = found.join(F.broadcast(templates), "gram").groupBy(*key, "template", "family", "size").agg(F.count(F.lit(1)).alias("common"), F.first("n_grams").alias("n"))
    likeness = shared.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("family").alias("__family"), F.struct((F.col("common") / F.least("size", "n")).alias("similarity"), (-F.col("template")).alias("t")).alias("s"))
    likeness = likeness.groupBy(*[f"__{k}" for k in key], "__family").agg(F.max("s").alias("s"))
    joined = judged.join(likeness, [*same(likeness), F.col("family") == F.col("__family")], "left")
    similarity = F.least(F.coalesce(F.col("s")["similarity"], F.lit(0.0)), F.lit(1.0))
    return joined.select(
        "doc_id", "paragraph", "family", "probability",
        F.element_at(F.array(*map(F.lit, model["texts"])), (1 - F.col("s")["t"]).cast("int")).alias("template"),
        similarity.alias("similarity"), (similarity >= min_similarity).alias("confirmed"),
    )


def op10_license_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(spark, docs, fit(spark, docs))
