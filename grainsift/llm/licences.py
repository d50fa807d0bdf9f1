"""Licence notices in documents: a paragraph classifier, confirmed by templates.

A paragraph is a run of lines that hold a letter or a digit, without the marks of comments
around them, so notices that are wrapped over lines are whole. It is looked at in windows of
8, 16, 32 ... words that overlap by half, up to twice the longest template: every template
that occurs lies wholly in one of them, and several notices in one paragraph are all found.

A window is described by its word n-grams (one and two) that also occur in the templates. A
multinomial logistic regression, fitted here to variants of the templates and to a bounded
sample of other paragraphs, gives each licence family and the class "unknown" a probability;
a temperature, fitted to variants that were held back, calibrates them. A family is found if
it is likely enough and the window holds enough of the word triples of one of its templates
(of a template of two words, the pair). Of findings that overlap the one that holds the most
triples stays, then the likelier and then the earlier one.

Scoring is made of DataFrame functions alone and needs no shuffle. Most texts, paragraphs and
windows are ruled out by a few words: for every template, key words are chosen such that words
without any of them cannot hold enough of its triples. This changes no result.

Null and empty texts have no licence. Rows are independent; repeated rows give repeated
results. Texts are read whole, whatever their length. Each finding has the line of its first
word. Only id and text columns are read; others pass through.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import few_hashes, refuse_clash

UNKNOWN = "unknown"
CONTAINMENT, PROBABILITY = 0.6, 0.5
MAX_OTHERS, MAX_OTHER_CHARS, VARIANTS, SEED = 1_500, 20_000, 40, 3

# Notices in the wording of the published licences.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
                   "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
                "SPDX-License-Identifier: GPL-3.0-or-later"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License version 2.",
                "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
             "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
                 "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "BSD": ("Licensed under the BSD 3-Clause License.", "Released under the BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.",
                "SPDX-License-Identifier: MPL-2.0"),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "SPDX-License-Identifier: ISC"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0": ("Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "Proprietary": ("All rights reserved. No part of this publication may be reproduced without permission of the publisher.",
                    "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}

# Words that are no use as key words, since other texts are full of them.
COMMON = {"a", "all", "and", "any", "are", "as", "at", "be", "by", "conditions", "either", "following", "for", "general", "in", "is", "it",
          "may", "mit", "not", "of", "on", "or", "purpose", "subject", "that", "the", "this", "to", "under", "use", "with", "without", "you"}

LEAD, TRAIL = "^[^A-Za-z0-9]*(?:(?:dnl|rem|REM)[ \\t]+)?", "[^A-Za-z0-9.]+$"  # marks of comments around a line
LEAST_HALF = 4  # words; windows are twice as long and begin every so many words
FINDINGS = "array<struct<held:int,probability:double,before:int,last:int,family:string,line:int>>"

SEPARATORS = "[^a-z0-9.+\\-]+|[.]+(?=[^a-z0-9]|$)"


def words_of(paragraph: str) -> list[str]:
    """In A to Z lower case; the same as the expression ``_words``."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in paragraph)
    return [w for w in re.split(SEPARATORS, low) if w]


def n_grams(words: list[str], n: int) -> set[str]:
    return {" ".join(words[i:i + n]) for i in range(len(words) - n + 1)}


@dataclass
class Model:
    families: list[str]  # the last one is unknown
    weights: dict[str, list[float]]  # of each n-gram, by family
    bias: list[float]
    triples: dict[str, list[list[str]]]  # of each template, by family
    keys: list[str]


def key_words(templates: dict[str, list[list[str]]]) -> list[str]:
    """Words of which every paragraph that a template can confirm holds one."""
    chosen: set[str] = set()
    for triples in (t for of_family in templates.values() for t in of_family):
        left = set(triples)
        for w in sorted({w for t in triples for w in t.split()}, key=lambda w: (w in COMMON, w not in chosen, -len(w), w)):
            if len(left) < CONTAINMENT * len(triples):
                break
            if any(w in t.split() for t in left):
                chosen.add(w)
                left = {t for t in left if w not in t.split()}
    return sorted(chosen)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(others: list[str], templates: dict[str, tuple[str, ...]] = TEMPLATES, rounds: int = 400, seed: int = SEED) -> Model:
    """Fit to variants of the templates and to other paragraphs."""
    rng = random.Random(seed)
    families = [*templates, UNKNOWN]
    triples = {f: [sorted(n_grams(words_of(t), min(3, len(words_of(t))))) for t in ts] for f, ts in templates.items()}
    vocabulary = sorted({g for ts in templates.values() for t in ts for n in (1, 2) for g in n_grams(words_of(t), n)})
    number = {g: i for i, g in enumerate(vocabulary)}
    every = {g for ts in triples.values() for t in ts for g in t}
    others = [o for o in others if not (n_grams(words_of(o), 3) | n_grams(words_of(o), 2)) & every]
    plain = [w for o in others[:200] for w in words_of(o)[:5]] or ["some", "other", "words"]
    samples: list[tuple[list[str], int]] = []
    for k, ts in enumerate(templates.values()):
        for t in ts:
            for v in range(VARIANTS // 2):
                words = [w for w in words_of(t) if v == 0 or rng.random() > 0.08]
                extra = [rng.choice(plain) for _ in range(rng.choice((0, 0, 2, 5)))]
                samples.append((words + extra if rng.random() < 0.5 else extra + words, k))
    for o in others:
        samples.append((words_of(o), len(families) - 1))
    for _ in range(20 * len(families)):  # single words and pairs of the templates in other surroundings
        samples.append((rng.sample(vocabulary, min(3, len(vocabulary))) + [rng.choice(plain) for _ in range(6)], len(families) - 1))
    x, y = np.zeros((len(samples), len(number))), np.zeros((len(samples), len(families)))
    for i, (words, k) in enumerate(samples):
        y[i, k] = 1
        for n in (1, 2):
            for g in n_grams(words, n):
                if g in number:
                    x[i, number[g]] = 1
    back = np.array([rng.random() < 0.2 for _ in samples])
    w, b, speed = np.zeros((len(number), len(families))), np.zeros(len(families)), 1.0
    move_w, move_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        d = (softmax(x[~back] @ w + b) - y[~back]) / (~back).sum()
        move_w = 0.9 * move_w - speed * (x[~back].T @ d + 1e-5 * w)
        move_b = 0.9 * move_b - speed * d.sum(0)
        w, b = w + move_w, b + move_b
    logits = x[back] @ w + b
    loss = lambda t: -np.log(softmax(logits / t)[y[back] == 1] + 1e-12).mean()
    heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return Model(families, {g: (w[i] / heat).round(6).tolist() for g, i in number.items()}, (b / heat).round(6).tolist(),
                 triples, key_words(triples))


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = MAX_OTHERS) -> Model:
    """Fit with the paragraphs of at most ``limit`` documents of bounded length as the unknown class."""
    text = F.col(text_column).cast("string")
    short = docs.filter(F.length(text) <= MAX_OTHER_CHARS)
    few = F.broadcast(few_hashes(short, id_column, limit))  # ``limit`` rows at most
    some = (short.select(F.xxhash64(id_column).alias("h"), text.alias("t")).join(few, "h")
            .groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect())
    rng = random.Random(SEED)
    lines = [rng.choice([x for x in r.t.split("\n") if x.strip()] or ["empty"]) for r in some]
    return fit([x[:2000] for x in lines])


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _words(paragraph: Column) -> Column:
    low = F.translate(paragraph, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(
        F.sequence(F.lit(0), F.size(words) - n),
        lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))


def line_words(line: str) -> list[str]:
    """Words of a line without the marks of comments at both ends."""
    return words_of(re.sub(TRAIL, "", re.sub(LEAD, "", line)))


def sizes_of(n_words: int, longest: int) -> list[int]:
    """Half lengths of the windows of a paragraph: doubled until one window holds it, or every template."""
    sizes = [LEAST_HALF]
    while 2 * sizes[-1] < n_words and sizes[-1] < longest:
        sizes.append(2 * sizes[-1])
    return sizes


def window_finding(words: Column, lines: Column, start: Column, model: Model) -> Column:
    """struct of the family, its probability, how many triples of a template the window holds and where.

    Null if the window is no notice. ``words`` and ``lines`` (of each word) are those of the
    window, ``start`` is its place in the paragraph.
    """
    weights = _constant(model.weights, "map<string,array<double>>")
    seen = F.array_intersect(F.concat(words, _grams(words, 2)), _constant(sorted(model.weights), "array<string>"))
    logits = F.aggregate(seen, _constant(model.bias, "array<double>"),
                         lambda total, g: F.zip_with(total, F.element_at(weights, g), lambda a, b: a + b))
    scored = F.struct(logits.alias("logits"), _grams(words, 3).alias("three"), _grams(words, 2).alias("two"))

    def judge(s: Column) -> Column:
        top = F.array_max(s["logits"])
        best = F.array_position(s["logits"], top)  # the first of equal ones
        total = F.aggregate(s["logits"], F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        family = F.element_at(_constant(model.families, "array<string>"), best.cast("int"))
        templates = F.element_at(_constant(model.triples, "map<string,array<array<string>>>"), family)

        def places(t: Column) -> Column:  # of a template's triples (or its pair) in the window, from 1
            at = lambda g: F.greatest(F.array_position(s["three"], g), F.array_position(s["two"], g))
            return F.filter(F.transform(t, at), lambda x: x > 0)

        held = F.transform(templates, lambda t: F.struct(F.size(places(t)).alias("n"), F.size(t).alias("of"), places(t).alias("at")))
        enough = F.filter(held, lambda h: h["n"] >= F.lit(CONTAINMENT) * h["of"])
        most = F.array_max(F.transform(enough, lambda h: F.struct(h["n"].alias("n"), h["at"].alias("at"))))
        probability = F.lit(1.0) / total
        first = F.array_min(most["at"]).cast("int") - 1
        found = F.struct(
            most["n"].alias("held"), F.round(probability, 9).alias("probability"), (-(start + first)).alias("before"),
            (start + F.array_max(most["at"]).cast("int") + 1).alias("last"), family.alias("family"), F.get(lines, first).alias("line"))
        return F.when((family != UNKNOWN) & (probability >= PROBABILITY) & most.isNotNull(), found)

    return F.element_at(F.transform(F.array(scored), judge), 1)


def _apart(findings: Column) -> Column:
    """Of findings that overlap the one that holds the most triples, then the likelier, then the earlier one."""
    overlap = lambda x, y: (-x["before"] <= y["last"]) & (-y["before"] <= x["last"])
    kept = F.aggregate(
        F.sort_array(F.array_distinct(findings), asc=False), F.array().cast(FINDINGS),
        lambda acc, d: F.when(F.exists(acc, lambda e: overlap(e, d)), acc).otherwise(F.array_append(acc, d)))
    return F.reverse(F.sort_array(F.transform(kept, lambda d: F.struct(
        d["before"].alias("before"), d["line"].alias("line"), d["family"].alias("family"), d["probability"].alias("probability")))))


def scan(docs: DataFrame, model: Model, column: str = "licences", text_column: str = "text") -> DataFrame:
    """The documents with an array of struct(line, family, probability), in order of place.

    A column of that name, whatever its case, is refused.
    """
    refuse_clash(docs.columns, column)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keys = "(?i)\\b(?:" + "|".join(re.escape(k) for k in model.keys) + ")\\b"
    may_hold = lambda c: c.rlike(keys)
    longest = max(len(t) + 2 for ts in model.triples.values() for t in ts)

    # lines without a letter or digit part paragraphs; marks keep the number of each line
    plain = F.translate(text, "\x01\x02", "  ")
    cleaned = lambda p: F.regexp_replace(F.regexp_replace(p, LEAD, ""), TRAIL, "")
    marked = F.transform(F.split(plain, "\n"), lambda p, i: F.when(
        p.rlike("[A-Za-z0-9]"), F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x02"), cleaned(p))).otherwise(""))
    paragraphs = F.filter(F.split(F.array_join(marked, "\n"), "\n\n+"), may_hold)

    def words_with_lines(line: Column) -> Column:
        number = F.regexp_extract(line, "\x01(\\d+)\x02", 1).try_cast("int")
        return F.transform(_words(F.substring_index(line, "\x02", -1)), lambda w: F.struct(number.alias("line"), w.alias("w")))

    def findings(placed: Column) -> Column:
        n = F.size(placed)

        def windows(half: int, smaller: int | None) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(n - half - 1, F.lit(0)), F.lit(half))
            wanted = F.lit(True) if smaller is None else n > 2 * smaller
            own = F.when(wanted, F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(placed, s + 1, 2 * half).alias("p"))))
            return F.coalesce(own, F.array().cast("array<struct<start:int,p:array<struct<line:int,w:string>>>>"))

        halves = sizes_of(2**31, longest)
        every = F.concat(*[windows(h, None if k == 0 else halves[k - 1]) for k, h in enumerate(halves)])
        key_words = _constant(model.keys, "array<string>")
        likely = F.filter(every, lambda x: F.arrays_overlap(F.transform(x["p"], lambda y: y["w"]), key_words))
        found = F.transform(likely, lambda x: window_finding(
            F.transform(x["p"], lambda y: y["w"]), F.transform(x["p"], lambda y: y["line"]), x["start"], model))
        return _apart(F.filter(found, lambda f: f.isNotNull()))

    placed = F.transform(paragraphs, lambda p: F.flatten(F.transform(F.split(p, "\n"), words_with_lines)))
    found = F.flatten(F.transform(placed, findings))
    named = F.transform(found, lambda f: F.struct(f["line"].alias("line"), f["family"].alias("family"), f["probability"].alias("probability")))
    return docs.withColumn(column, F.when(may_hold(text), named).otherwise(F.array().cast(
        "array<struct<line:int,family:string,probability:double>>")))
