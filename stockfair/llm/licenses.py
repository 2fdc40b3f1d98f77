"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs are lines.  Features are hashed word bigrams and trigrams of the
templates below; a multinomial logistic regression over licence families and
one class for everything else is trained on cuts of the templates with other
words around them, and on a bounded sample of the corpus's own paragraphs
(``MAX_OTHER`` of ``MAX_SAMPLE`` documents with the lowest hash of their id).
Its temperature is calibrated on held-out rows, and a family is predicted only
above the probability that keeps held-out other paragraphs out.  A prediction
is confirmed if the paragraph and one template of the family share most of the
shorter one's n-grams, and the paragraph says what tells the family from its
neighbours (``TELLING``): the version, and no word of another family or denial.

Main path (scoring): DataFrame functions only.  N-grams of function words alone
are no features, so a paragraph without any of the templates' other words has
none.  Those are dropped by a look-up per word; n-grams of the rest are joined
with the templates' n-grams, a fixed table that is broadcast.

Defined cases: null or empty texts have no paragraphs; a paragraph without any
template n-gram is of no family; equal paragraphs each count; repeated rows of
equal id and text are told apart by nothing, are scored as one row and give its
rows once; ids may be null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockfair.llm.common import ascii_lower, stored

MAX_SAMPLE, MAX_OTHER = 400, 3000
CONFIRM = 0.6
#: Share of held-out other paragraphs that may pass the threshold.
FALSE_SHARE = 0.001

#: fixed values: notices by family, as the licences word them
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation.",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
}
#: fixed values: phrases (lower-case words) of which a confirmed paragraph of the family
#: has one, and those of which it has none
TELLING = {
    "MIT": ((), ()),
    "Apache-2.0": ((), ("version 1 0", "version 1 1", "apache license 1")),
    "GPL-3.0": (("version 3", "v3", "gpl 3", "gplv3", "gpl 3 0"),
                ("lesser", "library general", "affero", "version 1", "version 2", "gpl 2", "gplv2")),
    "LGPL-3.0": (("version 3", "v3", "lgpl 3", "lgplv3", "lgpl 3 0"), ("affero", "version 2", "version 2 1", "lgpl 2", "lgplv2")),
    "BSD": ((), ()),
    "MPL-2.0": ((), ("version 1", "v 1", "mpl 1")),
    "CC-BY-4.0": (("cc by 4 0", "attribution 4 0"),
                  ("sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives", "noderivs")),
    "CC-BY-SA-4.0": (("cc by sa 4 0", "attribution sharealike 4 0"), ("nc", "nd", "noncommercial")),
    "CC-BY-NC-4.0": (("cc by nc 4 0", "attribution noncommercial 4 0"),
                     ("sa", "nd", "sharealike", "noderivatives", "noderivs")),
}
#: fixed values: phrases that deny a licence
DENIALS = ("not licensed", "not released", "not covered", "not distributed under", "isn t licensed", "no longer licensed",
           "not available under", "not governed by")
#: fixed values: paragraphs that speak of licences and are none
OTHERS = (
    "A driving licence is required for this position.",
    "The license plate was hard to read in the rain.",
    "He was granted a version of the general plan by the public.",
    "All terms and conditions of the sale are subject to change.",
    "You may obtain a copy of the report at the office.",
)
#: fixed values: function words
FUNCTION_WORDS = frozenset(
    "a all an and any are as at be by for from if in is it may not of on or other out such that the this to "
    "under was will with without you".split())
OTHER = "other"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _grams(text: str) -> set[str]:
    w = _WORD.findall("".join(c.lower() if c < "\x80" else c for c in text))
    return {" ".join(w[i:i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}


def _may_hold(text: Column, words: list[str], slots: int = 1 << 16) -> Column:
    """Whether a text may hold one of ``words``: each of its words is looked up
    in a table of hash slots, one byte each, so the cost does not grow with
    ``words``; all texts that hold one pass, and few others."""
    from xxhash import xxh64_intdigest

    table = bytearray(slots)
    for w in words:
        table[xxh64_intdigest(w.encode(), 42) % slots] = 1  # xxhash64() is XXH64 with seed 42
    # the lowest bits are the same for signed and unsigned hashes
    at = lambda w: F.xxhash64(w).bitwiseAND(F.lit(slots - 1)).cast("int") + 1
    return F.exists(F.split(text, _SEPARATORS),
                    lambda w: F.substring(F.lit(table), at(w), F.lit(1)) == F.lit(bytearray(b"\x01")))


def _gram_column() -> Column:
    """Bigrams and trigrams of the words in column ``w``."""
    pairs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))),
                        lambda w, i: F.concat_ws(" ", w, F.get("w", i + 1)))
    triples = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))),
                          lambda w, i: F.concat_ws(" ", w, F.get("w", i + 1), F.get("w", i + 2)))
    return F.concat(pairs, triples)


def _telling() -> Column:
    """Per family of ``TELLING``, whether the words in column ``w`` allow it."""
    text = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    has = lambda phrase: text.contains(f" {phrase} ")
    denied = reduce(or_, map(has, DENIALS))
    return F.create_map(*[x for f, (some, none) in TELLING.items() for x in (F.lit(f), (
        reduce(or_, map(has, some), F.lit(not some)) & ~reduce(or_, map(has, none), denied)))])


@dataclass
class Model:
    grams: list[str]
    families: list[str]      # the last is OTHER
    weights: np.ndarray      # grams + 1 (intercept) x families, divided by the temperature
    threshold: float
    held_out: dict[str, float]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, n: int, steps: int = 250, ridge: float = 0.02) -> np.ndarray:
    w = v = np.zeros((x.shape[1], n))
    share = 1 / np.bincount(y, minlength=n).clip(1)
    each = (share[y] / share[y].sum())[:, None]  # classes weigh alike
    rate = 4 / max(1.0, float((each * x * x).sum(1).max() * 2 + 1))
    rate = min(rate, 1.0)
    target = np.eye(n)[y]
    for t in range(steps):
        g = x.T @ (each * (_softmax(x @ v) - target)) + ridge / len(y) * v
        new = v - rate * g
        v, w = new + t / (t + 3) * (new - w), new
    return w


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on cuts of the templates and on a bounded sample of paragraphs."""
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct() \
        .orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(MAX_SAMPLE)
    lines = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")) \
        .join(F.broadcast(ids), "id").select(F.explode(F.split("t", "\n")).alias("line"))  # MAX_SAMPLE ids
    own = [r["line"] for r in lines.select("line").distinct()
           .orderBy(F.xxhash64("line"), "line").limit(MAX_OTHER).collect()]
    families = [*TEMPLATES, OTHER]
    known = [(k, t) for k, ts in TEMPLATES.items() for t in ts]
    grams = sorted(g for g in {g for _, t in known for g in _grams(t)}
                   if not FUNCTION_WORDS.issuperset(g.split(" ")))
    column = {g: i for i, g in enumerate(grams)}
    rng = random.Random(1)
    noise = [w for line in own[:200] for w in line.split()] or ["text"]
    rows: list[tuple[set[str], int]] = []
    for k, t in known:
        words = t.split()
        for j in range(40):
            size = len(words) if j < 10 else rng.randint(max(3, -(-2 * len(words) // 3)), max(3, len(words)))
            at = rng.randint(0, max(0, len(words) - size))
            some = [rng.choice(noise) for _ in range(rng.randint(0, 6) if j else 0)]
            some_after = [rng.choice(noise) for _ in range(rng.randint(0, 6) if j else 0)]
            rows.append((_grams(" ".join(some + words[at:at + size] + some_after)), families.index(k)))
    # corpus paragraphs that hold a whole template are no examples of other text
    whole = [_grams(t) for _, t in known]
    for line in [*OTHERS * 8, *own]:
        g = _grams(line)
        if not any(len(g & t) >= CONFIRM * len(t) for t in whole):
            rows.append((g, len(families) - 1))
    x = np.zeros((len(rows), len(grams) + 1))
    for i, (g, _) in enumerate(rows):
        x[i, [column[a] for a in g if a in column]] = 1
    x[:, -1] = 1
    y = np.array([k for _, k in rows])
    held = np.array([rng.random() < 0.2 for _ in rows])
    w = _fit(x[~held], y[~held], len(families))
    z = x[held] @ w
    scale = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0), key=lambda s: -np.mean(
        np.log(_softmax(z * s)[np.arange(held.sum()), y[held]] + 1e-12)))
    p = _softmax(z * scale)
    best = p[:, :-1].max(1)
    false = np.sort(best[y[held] == len(families) - 1])
    at = int(np.ceil((1 - FALSE_SHARE) * len(false))) - 1 if len(false) else -1
    threshold = max(0.5, float(false[at]) if at >= 0 else 0.5)
    real = y[held] < len(families) - 1
    right = (p.argmax(1) == y[held]) & (best > threshold)
    return Model(grams, families, _fit(x, y, len(families)) * scale, threshold, {
        "recall": float(right[real].mean()) if real.any() else 0.0,
        "false_share": float((best[~real] > threshold).mean()) if (~real).any() else 0.0})


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, family, probability, containment, confirmed): paragraphs
    (from 0, lines of the text) of a predicted family."""
    spark = docs.sparkSession
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"),
                        F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("paragraph", "line"))
    words = F.filter(F.split(ascii_lower(F.col("line")), _SEPARATORS), lambda w: w != "")
    marks = sorted({w for g in model.grams for w in g.split(" ")} - FUNCTION_WORDS)
    # lower() folds more than A-Z, so it lets through all that can match
    rows = lines.where(_may_hold(F.lower("line"), marks)).select("id", "text_key", "paragraph", words.alias("w"))
    rows = rows.select("id", "text_key", "paragraph", F.array_distinct(_gram_column()).alias("g"),
                       F.map_keys(F.map_filter(_telling(), lambda f, ok: ok)).alias("fits"))
    # fixed tables: the templates' n-grams
    weights = spark.createDataFrame(
        [(g, [float(v) for v in model.weights[i]]) for i, g in enumerate(model.grams)],
        "gram string, weight array<double>")
    kept = set(model.grams)
    own = [(g, f, f"{f}/{k}", len(_grams(t) & kept)) for f, ts in TEMPLATES.items() for k, t in enumerate(ts)
           for g in sorted(_grams(t) & kept)]
    templates = spark.createDataFrame(own, "gram string, family string, template string, size int")
    key = ["id", "text_key", "paragraph"]
    # outer: a filter inferred from a plain explode would be pushed into the lambdas above
    hits = rows.select(*key, F.size("g").alias("n"), "fits", F.explode_outer("g").alias("gram"))
    # repeated rows meet in one key: each n-gram counts once for it
    hits = hits.join(F.broadcast(weights.select("gram")), "gram", "left_semi").select(*key, "n", "fits", "gram").distinct()
    hits = stored(hits.join(F.broadcast(weights), "gram"))  # read twice below, and few
    n = len(model.families)
    sums = hits.groupBy(*key).agg(
        F.first("n").alias("n"), F.first("fits").alias("fits"), *[F.sum(F.get("weight", F.lit(k))).alias(f"z{k}") for k in range(n)])
    z = F.array(*[F.col(f"z{k}") + float(model.weights[-1][k]) for k in range(n)])
    top = sums.select(*key, "n", "fits", z.alias("z"))
    top = top.withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    best = F.array_max(F.array(*[F.struct(F.get("e", F.lit(k)).alias("e"), F.lit(f).alias("family"))
                                 for k, f in enumerate(model.families) if f != OTHER]))
    top = top.select(*key, "n", "fits", total.alias("total"), best.alias("x"))
    found = top.select(*key, "n", (F.col("x.e") / F.col("total")).alias("p"), "x.family",
                       F.array_contains("fits", F.col("x.family")).alias("told")) \
        .where(F.col("p") > model.threshold)
    shared = hits.select(*key, "gram").join(F.broadcast(templates), "gram") \
        .groupBy(*key, "family", "template").agg(F.count("*").alias("both"), F.first("size").alias("size"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*key, "family")]
    cond = same[0] & same[1] & same[2] & same[3]
    best = found.alias("a").join(shared.alias("b"), cond, "left") \
        .groupBy("a.id", "a.text_key", "a.paragraph", "a.family", "a.p", "a.told") \
        .agg(F.max(F.coalesce(F.col("b.both") / F.least("a.n", "b.size"), F.lit(0.0))).alias("containment"))
    return best.select(F.col("id").alias(id_col), "paragraph", "family", F.col("p").alias("probability"),
                       "containment", ((F.col("containment") >= CONFIRM) & F.col("told")).alias("confirmed"))
