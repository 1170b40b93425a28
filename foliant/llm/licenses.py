"""Licence scans: sparse logistic regression over word n-grams names the licence family of each notice.

A notice is a line, or lines in a row of one paragraph (up to a line without words) over which it is wrapped.

The model is trained here on notices written from templates, with names, years, versions and wording varied, against
paragraphs of plain prose, among them texts that speak of licences without granting one. A paragraph is "unknown" when the
calibrated probability of the best family is low, or when no template of that family confirms it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.common import bound_batches, only

#: Notices made from each template; solver's steps and rate; weight of the L1 penalty, which keeps the model sparse.
MADE, STEPS, RATE, PENALTY = 30, 200, 3.0, 2e-5
#: Least calibrated probability, and least share of a template's words that the paragraph must have.
SURE, CONFIRMED = 0.5, 0.7
UNKNOWN = "unknown"

# Templates of notices by licence family. {v} is a version, {n} a name, {y} a year.
TEMPLATES = {
    "Apache": ["Licensed under the Apache License, Version {v}.", "Licensed under the Apache License, Version {v} (the License); you may not use this file except in compliance with the License.", "This project is licensed under the Apache License {v}.", "SPDX-License-Identifier: Apache-{v}", "Released under the terms of the Apache Software License."],
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT", "Distributed under the MIT License by {n}, {y}."],
    "GPL": ["This work is licensed under the GNU General Public License, version {v}.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or any later version.", "SPDX-License-Identifier: GPL-{v}-or-later", "Released under the GNU GPL v{v}.", "Licensed under GPLv{v}."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version {v}.", "Licensed under the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-{v}-only", "Released under the LGPL v{v}."],
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version {v}.", "Licensed under the GNU Affero General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: AGPL-{v}-only", "Released under the AGPL v{v}."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-{v}-Clause"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}.", "Licensed under the Mozilla Public License, Version {v}.", "SPDX-License-Identifier: MPL-{v}"],
    "CC-BY-NC": ["Licensed under CC BY-NC {v}.", "This work is licensed under a Creative Commons Attribution-NonCommercial {v} International License.", "Released under CC BY-NC-SA {v}.", "Licensed under CC-BY-NC-{v}."],
    "CC-BY": ["Licensed under CC BY {v}.", "This work is licensed under a Creative Commons Attribution {v} International License.", "Released under CC-BY-{v}.", "Licensed under Creative Commons Attribution."],
    "CC-BY-SA": ["Licensed under CC BY-SA {v}.", "This work is licensed under a Creative Commons Attribution-ShareAlike {v} International License.", "Released under CC-BY-SA-{v}."],
    "CC0": ["To the extent possible under law, {n} has waived all copyright and related rights to this work.", "Released under CC0 {v} Universal.", "Dedicated to the public domain under the Creative Commons CC0 waiver.", "This is free and unencumbered software released into the public domain."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License {v}.", "Licensed under the Eclipse Public License, Version {v}.", "SPDX-License-Identifier: EPL-{v}"],
    "proprietary": ["Copyright {y} {n}. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
PROSE = ["The driver must have a valid license to rent the car.", "She was released from the hospital under the care of {n}.", "The public library is open to any person free of charge.", "His fishing licence was granted in {y}.", "The general public was not permitted to use the hall.", "Version {v} of the schedule was published by the city of {n}.", "The work of {n} is on display at the museum.", "In {y} the foundation gave software to schools without a fee.", "The attribution of the painting to {n} is disputed.", "A commercial about common creative habits was aired in {y}.", "The eclipse of {y} was seen by the public.", "Apache helicopters were released to the army in {y}.", "They were all right and reserved seats for {n}.", "The university MIT was founded long before {y}.", "The conditions of use of the road are met by few.", "Please write to {n} about the terms of the offer, which may change.", "The licence fee for television rose again in {y}."]
NAMES = ["Example Corp", "Jane Doe", "the authors", "Acme Labs", "N. N.", "the contributors"]
VERSIONS = ["2.0", "3", "4.0", "1.0", "2", "3.0", "2.1", "1.1"]
#: Words too common to tell a licence from prose; an n-gram of these alone is no feature.
COMMON = frozenset("a an and any are as at be by for from in is it may of on or that the this to under was were which with you your not his her all about few".split())

#: Letters and digits apart, so that "GPLv3" has the word of "GPLv{v}".
_WORD = re.compile(r"[a-z]+|[0-9]+")
#: Comment marks of letters at the begin of a line; others have no words.
_MARK = re.compile(r"^\s*(?:rem|dnl)\s")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(_MARK.sub("", paragraph.lower()))


def grams(words: list[str]) -> set[str]:
    """Word n-grams of one to three words that hold a word which is not common."""
    out = {w for w in words if w not in COMMON}
    for n in (2, 3):
        out.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1) if not COMMON.issuperset(words[i : i + n]))
    return out


class Model:
    """weights: n-gram by class, the last class is unknown; anchors: words, not numbers, without which no template is confirmed; wide: words over
    which a notice may be wrapped, twice those of the longest template."""

    def __init__(self, families: list[str], index: dict[str, int], weights: np.ndarray, temperature: float):
        self.families, self.index, self.weights, self.temperature = families, index, weights, temperature
        self.anchors = {w for g in index for w in g.split() if w not in COMMON and not w.isdigit()}
        self.shapes = {f: [frozenset(w for w in words_of(t.replace("{v}", "").replace("{n}", "").replace("{y}", ""))) for t in TEMPLATES[f]] for f in families}
        self.wide = 2 * max(len(words_of(t)) for f in families for t in TEMPLATES[f])

    def probabilities(self, features: set[str]) -> np.ndarray:
        rows = [self.index[g] for g in features if g in self.index]
        z = (self.weights[0] + self.weights[rows].sum(axis=0)) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def classify(self, paragraph: str) -> tuple[str, float, float] | None:
        """Family or unknown, its calibrated probability, and the best template's share of words found; None if the
        paragraph has none of the words that the model knows, so that it is unknown beyond doubt."""
        found = self.judge(words_of(paragraph))
        return found and found[:3]

    def judge(self, words: list[str]) -> tuple[str, float, float, int] | None:
        """As classify, of words; and the most words found of a template that is confirmed."""
        if self.anchors.isdisjoint(words):
            return None
        p = self.probabilities(grams(words))
        best = int(p[:-1].argmax())
        have = set(words)
        shares = [(len(shape & have) / len(shape), len(shape & have)) for shape in self.shapes[self.families[best]]]
        match = max(shares)[0]
        if p[best] >= SURE and p[best] > p[-1] and match >= CONFIRMED:
            return self.families[best], float(p[best]), match, max(n for share, n in shares if share >= CONFIRMED)
        return UNKNOWN, float(p[-1]), match, 0

    def notices(self, text: str) -> list[tuple[int, str, float, float]]:
        """The first line, family, probability and template's share of every notice of a text."""
        lines = [words_of(line) for line in text.split("\n")]
        hot = [not self.anchors.isdisjoint(words) for words in lines]
        out, start = [], 0
        for stop in [i for i, words in enumerate(lines) if not words] + [len(lines)]:
            out += self.in_paragraph(lines, hot, start, stop)
            start = stop + 1
        return out

    def in_paragraph(self, lines: list[list[str]], hot: list[bool], start: int, stop: int) -> list[tuple[int, str, float, float]]:
        """The notices of lines start to stop. Lines in a row are a notice if a template is confirmed by them; those that
        have most of a template's words, less one for each line, come first. A line that is a notice of its own gives way
        only to lines that have more of a template's words, and as great a share."""
        found = []
        for i in filter(hot.__getitem__, range(start, stop)):
            words: list[str] = []
            for j in range(i, stop):
                if j > i and len(words) >= self.wide:
                    break
                words = words + lines[j]
                if hot[j] and (j == i or self.may_confirm(set(words))):
                    got = self.judge(words)
                    if got and got[0] != UNKNOWN:
                        found.append((i, j, *got))
        alone = {i: x for x in found for i in (x[0],) if x[0] == x[1]}
        kept = [x for x in found if x[0] == x[1] or all(x[5] > y[5] and x[4] >= y[4] for k in range(x[0], x[1] + 1) if (y := alone.get(k)))]
        kept.sort(key=lambda x: (x[1] - x[0] - x[5], x[1] - x[0], x[0]))
        taken: set[int] = set()
        out = []
        for i, j, family, p, match, _ in kept:
            if taken.isdisjoint(range(i, j + 1)):
                taken.update(range(i, j + 1))
                out.append((i, family, p, match))
        return sorted(out)

    def may_confirm(self, have: set[str]) -> bool:
        return any(len(shape & have) >= CONFIRMED * len(shape) for shapes in self.shapes.values() for shape in shapes)


def made(template: str, rng: np.random.Generator) -> str:
    """A notice from a template, with other words around it, words left out and marks and case changed now and then."""
    pick = lambda some: some[int(rng.integers(len(some)))]
    text = template.replace("{v}", pick(VERSIONS)).replace("{n}", pick(NAMES)).replace("{y}", str(int(rng.integers(1980, 2030))))
    words = text.split()
    if rng.random() < 0.3 and len(words) > 8:
        del words[int(rng.integers(len(words)))]
    noise = "".join(chr(97 + int(c)) for c in rng.integers(26, size=int(rng.integers(2, 9))))
    if rng.random() < 0.3:
        words = [noise, *words] if rng.random() < 0.5 else [*words, noise]
    return " ".join(words).upper() if rng.random() < 0.1 else " ".join(words)


@functools.cache
def trained(seed: int = 3) -> Model:
    """The model, by proximal gradient steps on the L1-penalised loss; the temperature is fitted on held-out notices."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    rows = [(made(t, rng), i) for i, f in enumerate(families) for t in TEMPLATES[f] for _ in range(MADE)]
    rows += [(made(t, rng), len(families)) for t in PROSE for _ in range(2 * MADE)]
    rows += [(" ".join(rng.permutation(made(t, rng).split())[: int(rng.integers(1, 4))]), len(families)) for f in families for t in TEMPLATES[f] for _ in range(MADE // 6)]
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    features = [grams(words_of(t)) for t, _ in rows]
    counts: dict[str, int] = {}
    for some in features:
        for g in some:
            counts[g] = counts.get(g, 0) + 1
    index = {g: i + 1 for i, g in enumerate(sorted(g for g, n in counts.items() if n >= MADE // 4))}
    cut = len(rows) * 4 // 5
    row_at = np.array([i for i, some in enumerate(features) for g in some if g in index])
    col_at = np.array([index[g] for some in features for g in some if g in index])
    x = np.zeros((len(rows), len(index) + 1), np.float32)
    x[row_at, col_at] = 1.0
    x[:, 0] = 1.0
    y = np.eye(len(families) + 1, dtype=np.float32)[[c for _, c in rows]]
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    for _ in range(STEPS):
        z = x[:cut] @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= RATE * (x[:cut].T @ (p - y[:cut])) / cut
        bias = w[0].copy()
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * PENALTY, 0)
        w[0] = bias
    z, best = x[cut:] @ w, (np.inf, 1.0)
    for temperature in np.geomspace(0.25, 4, 25):
        s = z / temperature
        loss = float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - (s * y[cut:]).sum(axis=1)).mean())
        best = min(best, (loss, float(temperature)))
    used = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    place = {int(r): i for i, r in enumerate(used)}
    return Model(families, {g: place[i] for g, i in index.items() if i in place}, w[used], best[1])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, paragraph (the number from 0 of the line that it begins in), family, probability and template_match of every
    notice of a licence, on one line or wrapped over lines of a paragraph, in all whole texts.

    A null or empty text has no notice; repeated rows give their findings again; a null id stays null.
    Ties go to the family first in order. The model is trained before and goes to the tasks; nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    model = trained()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                rows += [(i, at, family, round(p, 6), round(match, 6)) for at, family, p, match in model.notices(text or "")]
            at, number, family, p, match = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(family, pa.string()), pa.array(p, pa.float64()), pa.array(match, pa.float64())], ["id", "paragraph", "family", "probability", "template_match"])

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, id_col, text_col).mapInArrow(find, f"id {kind}, paragraph int, family string, probability double, template_match double").withColumnRenamed("id", id_col)
