"""Licence scans by a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are lines, and notices may run over consecutive lines. A sparse logistic regression over word uni- and bigrams gives each licence family a score; it is
fitted on the driver to the templates below, to variants of them, and to a bounded sample of the corpus's own lines,
which stand for text without a licence. Scores are turned into probabilities by one temperature, and a paragraph whose
best family stays under ``known`` is ``unknown`` if it speaks of a licence at all. A family is confirmed if the
paragraph has most of the distinctive words of one of the family's templates.

A line that isn't confirmed by itself is scored again with the words that follow it, as many as the templates are long
and up to the next line without words. Of the lines from which a notice is found so, the last one has its row; other
lines of it count by themselves. Lines that neither speak of a licence nor are confirmed have no row.

Only DataFrame expressions run on the executors. The weights are those of a bounded vocabulary (that of the templates),
held in one literal map. Texts without any of ``implied_words`` and without an anchor word are skipped before anything
is computed on them: too few grams of every template are left without those words for it to be confirmed.

Defined results: null and empty texts have no paragraphs; repeated paragraphs each count; repeated rows give repeated
results; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

#: Short notices of each family (fixed values, from the licences' own published notices).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "apache": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"),
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "public-domain": ("This work is dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain."),
    "proprietary": ("All rights reserved.", "Copyright, all rights reserved. Unauthorized copying of this file is strictly prohibited."),
}
#: Words that speak of a licence by themselves (fixed values); every template has one.
ANCHORS = ("license", "licensed", "licence", "licensing", "licenses", "spdx", "copyright", "rights", "redistribution", "permission", "redistribute", "unencumbered", "domain")
FAMILIES = tuple(TEMPLATES)
#: Templates of so many words or fewer are looked for among as few following words.
SHORT = 14
_WORD = r"[a-z0-9]+(?:[-.][a-z0-9]+)*"
_NONE = len(FAMILIES)


def grams(line: str) -> list[str]:
    """Uni- and bigrams of a line's lower-cased words."""
    w = re.findall(_WORD, line.lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def _variants(text: str) -> list[str]:
    w = text.split()
    return [text, text.upper(), "Note: " + text, text + " See the file for details.", " ".join(w[: max(2, len(w) * 3 // 4)]), " ".join(w[len(w) // 4 :])]


class Model:
    """Weights by gram, one per family and one for no licence; the temperature; and each template's distinctive words."""

    def __init__(self, weights: dict[str, list[float]], bias: list[float], temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature
        spread: dict[str, set[str]] = {}
        for family, texts in TEMPLATES.items():
            for t in texts:
                for g in grams(t):
                    spread.setdefault(g, set()).add(family)
        self.distinctive = {f: [sorted({g for g in grams(t) if len(spread[g]) <= 3}) for t in texts] for f, texts in TEMPLATES.items()}

    def probabilities(self, line: str) -> list[float]:
        g = [self.weights[x] for x in set(grams(line)) if x in self.weights]
        z = [(b + sum(w[k] for w in g)) / self.temperature for k, b in enumerate(self.bias)]
        top = max(z)
        e = [math.exp(v - top) for v in z]
        return [v / sum(e) for v in e]

    def confirmed(self, line: str, share: float = 0.6) -> set[str]:
        have = set(grams(line))
        return {f for f, sets in self.distinctive.items() if any(s and sum(g in have for g in s) >= share * len(s) for s in sets)}


def fit(background: list[str], *, rounds: int = 400, rate: float = 0.3, l2: float = 1e-3) -> Model:
    """Multinomial logistic regression over the templates' grams; the variants held out of training set the temperature."""
    train, held = [], []
    for y, texts in enumerate(TEMPLATES.values()):
        for t in texts:
            for k, v in enumerate(_variants(t)):
                (held if k == 3 else train).append((v, y))
    lines = [x for x in background if not any(a in x.lower() for a in ANCHORS)]
    train += [(x, _NONE) for x in lines[::2]] + [("This section is free of errors and subject to change.", _NONE), ("The general public may use the work.", _NONE)]
    held += [(x, _NONE) for x in lines[1::2]]
    vocabulary = sorted({g for texts in TEMPLATES.values() for t in texts for g in grams(t)})
    index = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows):
        x = np.zeros((len(rows), len(vocabulary) + 1))
        x[:, -1] = 1
        for r, (t, _) in enumerate(rows):
            for g in set(grams(t)):
                if g in index:
                    x[r, index[g]] = 1
        return x, np.eye(_NONE + 1)[[y for _, y in rows]]

    x, y = matrix(train)
    w = np.zeros((x.shape[1], _NONE + 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    balance = (1 / y.sum(0).clip(1))[y.argmax(1)][:, None]
    balance /= balance.sum()
    for step in range(1, rounds + 1):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ ((p - y) * balance) + l2 * w / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    hx, hy = matrix(held)
    z = hx @ w

    def loss(t: float) -> float:
        q = z / t - (z / t).max(1, keepdims=True)
        return float(-(hy * (q - np.log(np.exp(q).sum(1, keepdims=True)))).sum())

    temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return Model({g: np.round(w[i], 6).tolist() for g, i in index.items()}, np.round(w[-1], 6).tolist(), temperature)


def train(documents: DataFrame, *, text_col: str = "text", sample: int = 200, lines_each: int = 10) -> Model:
    """``sample`` documents at most give background lines: ``lines_each`` of each whole text, whole and chosen by a hash."""
    lines = F.array_distinct(F.filter(F.transform(F.split(F.col(text_col), "\n", -1), lambda x: F.trim(x)), lambda x: x != ""))
    some = F.slice(F.array_sort(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("line")))), 1, lines_each)
    rows = bounded_sample(documents.filter(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("key"), some.getField("line").alias("lines")), F.col("key"), sample)
    return fit(sorted({x.strip() for r in rows for x in r["lines"] if x.strip()}))


def implied_words(model: Model, share: float = 0.6) -> list[str]:
    """Words of which a text has at least one if ``share`` of any template's distinctive grams are in it.

    From each template, the words in most of its grams are taken until the grams without them are too few.
    """
    out: set[str] = set()
    for s in (s for sets in model.distinctive.values() for s in sets if s):
        left = [set(g.split()) for g in s if not out & set(g.split())]
        while len(left) >= share * len(s):
            # anchors and long words first: they are rare elsewhere
            word = max({w for g in left for w in g}, key=lambda w: (w in ANCHORS, len(w) > 5, sum(w in g for g in left), len(w), w))
            out.add(word)
            left = [g for g in left if word not in g]
    return sorted(out)


def _has_any(text: Column, parts: list[str]) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for a in parts:
        found = found | low.contains(a)
    return found


def _sum(weights: str, k: int) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda total, x: total + F.get(x, F.lit(k)))


def paragraphs(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", known: float = 0.6, share: float = 0.6) -> DataFrame:
    """One row for each paragraph that speaks of a licence: doc_id, line (from 0), family (or unknown), probability, confirmed."""
    implied = implied_words(model, share)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(_has_any(F.col("text"), sorted({*ANCHORS, *implied})))
    longest = [max((n for t in TEMPLATES.values() for x in t if ((n := len(re.findall(_WORD, x.lower()))) <= SHORT) == short), default=0) for short in (True, False)]
    words = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_extract_all(F.lower(x), F.lit(_WORD), F.lit(0)))

    def following(all_words: Column, i: Column) -> Column:
        """The words of the next lines up to one without words."""
        tail = F.slice(all_words, i + 2, max(longest))
        stop = F.array_position(F.transform(tail, F.size), F.lit(0))
        return F.slice(F.flatten(F.when(stop > 0, F.slice(tail, F.lit(1), (stop - 1).cast("int"))).otherwise(tail)), 1, max(longest))

    docs = docs.select("doc_id", words.alias("all"))
    lines = docs.select("doc_id", F.posexplode(F.transform("all", lambda w, i: F.struct(w.alias("words"), following(F.col("all"), i).alias("more")))).alias("line", "x")).select("doc_id", "line", "x.words", "x.more")
    some = F.array(*map(F.lit, sorted({*ANCHORS, *implied})))
    lines = lines.filter((F.size("words") > 0) & (F.arrays_overlap("words", some) | F.arrays_overlap("more", some)))
    grams_of = list(model.weights)
    table = F.map_from_arrays(F.array(*map(F.lit, grams_of)), F.array(*(F.array(*map(F.lit, model.weights[g])) for g in grams_of)))

    def scored(rows: DataFrame, name: str, words: Column) -> DataFrame:
        """Adds the distinct grams of ``words``, the best family and its probability."""
        rows = rows.withColumn("w", words)
        pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        rows = rows.withColumn(f"grams{name}", F.array_distinct(F.concat("w", pairs)))
        rows = rows.withColumn("found", F.filter(F.transform(f"grams{name}", lambda g: F.try_element_at(table, g)), lambda x: x.isNotNull()))
        scores = [F.exp((F.lit(b) + _sum("found", k)) / model.temperature) for k, b in enumerate(model.bias)]
        rows = rows.withColumn("e", F.array(*scores)).withColumn("total", F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x))
        best = F.array_max(F.transform(F.slice("e", 1, len(FAMILIES)), lambda x, i: F.struct(x.alias("e"), (-i).alias("i"))))
        rows = rows.withColumn("best", best).withColumn(f"probability{name}", F.col("best.e") / F.col("total"))
        return rows.withColumn(f"family{name}", F.element_at(F.array(*map(F.lit, FAMILIES)), (1 - F.col("best.i")).cast("int"))).drop("w", "found", "e", "total", "best")

    def has(grams: Column, family: Column, lengths: tuple[bool, ...]) -> Column:
        """Whether the grams confirm the family by a template that is short, or one that isn't."""
        out = F.lit(False)
        for f, sets in model.distinctive.items():
            for s, t in zip(sets, TEMPLATES[f]):
                if s and (len(re.findall(_WORD, t.lower())) <= SHORT) in lengths:
                    out = out | ((family == f) & (F.size(F.array_intersect(grams, F.array(*map(F.lit, s)))) >= share * len(s)))
        return out

    lines = scored(lines, "", F.col("words"))
    lines = lines.withColumn("confirmed", (F.col("probability") >= known) & has(F.col("grams"), F.col("family"), (True, False)))
    out = [F.struct("family", "probability", "confirmed")]
    for name, short, n in (("_short", True, longest[0]), ("_long", False, longest[1])):
        more = F.when(~F.col("confirmed"), F.slice("more", 1, n))
        lines = scored(lines, name, F.concat("words", more))
        lines = lines.withColumn("rest", more)
        pairs = F.zip_with(F.slice("rest", 1, F.greatest(F.size("rest") - 1, F.lit(0))), F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        lines = lines.withColumn("rest", F.concat("rest", pairs))
        family = F.col(f"family{name}")
        # a notice that the following lines have without this one isn't this line's
        wrapped = ~F.col("confirmed") & (F.col(f"probability{name}") >= known) & has(F.col(f"grams{name}"), family, (short,)) & ~has(F.col("rest"), family, (True, False))
        lines = lines.withColumn(f"wrapped{name}", F.coalesce(wrapped, F.lit(False))).drop("rest")
        out.append(F.struct(family.alias("family"), F.col(f"probability{name}").alias("probability"), F.lit(True).alias("confirmed")))
    speaks = F.arrays_overlap("words", F.array(*map(F.lit, ANCHORS)))
    x = F.when(F.col("wrapped_long"), out[2]).when(F.col("wrapped_short"), out[1]).otherwise(out[0])
    # not a filter on these columns: pushed below them, it would repeat all their expressions
    shown = F.when(speaks | F.col("confirmed") | F.col("wrapped_short") | F.col("wrapped_long"), F.array(x))
    lines = lines.select("doc_id", F.col("line").cast("int").alias("line"), F.explode_outer(shown).alias("x")).filter("x IS NOT NULL")
    return lines.select("doc_id", "line", F.when(F.col("x.probability") >= known, F.col("x.family")).otherwise(F.lit("unknown")).alias("family"), F.round("x.probability", 6).alias("probability"), F.col("x.confirmed").alias("confirmed"))


def scan(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document with a licence paragraph: doc_id, n_paragraphs, families (confirmed, sorted, comma-joined) and n_unknown."""
    found = paragraphs(documents, model, id_col=id_col, text_col=text_col, **how)
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_paragraphs"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count_if(~F.col("confirmed")).alias("n_unknown"),
    )
