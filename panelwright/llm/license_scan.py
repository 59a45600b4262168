"""Licence scans by a trained paragraph classifier.

Paragraphs (lines that hold a word) are described by hashed word 1- to 3-grams. A sparse logistic regression per licence family, trained
on templates, their fragments and variations, with paragraphs of the corpus as examples of no licence, gives probabilities; a Platt
scaling fitted on paragraphs left out calibrates them, and what stays under the cut is `unknown`. A prediction then has to
be confirmed by its family's template: enough of the template's word pairs must occur in the paragraph, or of the paragraph's in a template.

A prediction that no template confirms does not stand, so paragraphs that share no word pair with any template, nor, if short, the name of a licence, are not
scored; the answer is the same.

A paragraph may hold several licences; each is found with its place. What reads like a notice (fixed phrases that name terms of use) but has no
family that is sure and confirmed is given as `unknown`.

Defined cases: null and empty texts have no licence; a window that fits two families equally, by the same words, goes to the first by name; ids may be null or repeat;
an empty table gives an empty result; without texts to sample the templates alone train the model; other columns are carried along.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from panelwright.llm.common import fresh, slices

SAMPLE_DOCS = 400  # texts whose paragraphs teach what is no licence, at most
SAMPLE_PARAGRAPHS = 40  # of each of them
PROBABILITY = 0.5
SIMILARITY = 0.5
FRAGMENT = 40  # words of a window over a long paragraph
HEADS = (9, 12, 16, 24)  # words after which long notices are often cut
SHORT = 8  # words of a paragraph in which the one-word name of a licence is a notice
UNKNOWN = "unknown"
NONE = "none"

# Notices and characteristic passages of public licence texts, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "AGPL-3.0", "AGPLv3", "GNU AGPLv3", "https://www.gnu.org/licenses/agpl-3.0.html"),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0",
        "Apache-2.0", "Apache License 2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD License", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
        "BSD-3-Clause", "BSD-2-Clause", "BSD 2-Clause License", "New BSD License"),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
        "CC BY 4.0", "CC BY 3.0", "https://creativecommons.org/licenses/by/4.0/"),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "CC BY-NC 4.0", "CC BY-NC 3.0", "https://creativecommons.org/licenses/by-nc/4.0/"),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "CC BY-SA 4.0", "CC BY-SA 3.0", "https://creativecommons.org/licenses/by-sa/4.0/"),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "Released into the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0",
        "CC0-1.0", "CC0 1.0 Universal"),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU GPL v2", "SPDX-License-Identifier: GPL-3.0-or-later",
        "GPLv2", "GPLv3", "GPL-3.0", "GPL-2.0-only", "GNU GPL v3", "https://www.gnu.org/licenses/gpl-3.0.html"),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License", "SPDX-License-Identifier: ISC",
        "ISC License"),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "LGPLv3", "LGPL-2.1", "GNU LGPL v2.1"),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT",
        "MIT License", "License: MIT", "The MIT License (MIT)", "https://opensource.org/licenses/MIT"),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0",
        "MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License Version 2.0"),
    "proprietary": (
        "All rights reserved", "Copyright (c) All rights reserved. No part of this publication may be reproduced without prior written permission",
        "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited"),
}

_GNU = frozenset({"agpl", "gpl", "lgpl"})
_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")


def paragraph_words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _pairs(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)}


@dataclass
class Classifier:
    """Weights of every template n-gram for each family and none, and the calibration of the winning margin."""

    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # (n-grams, families + 1), the last column is no licence
    bias: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    words: frozenset[str] = field(default_factory=frozenset)

    def scores(self, found: list[list[int]]) -> np.ndarray:
        """Log odds of every class for paragraphs given by the positions of their n-grams."""
        out = np.empty((len(found), len(self.bias)))
        for i, at in enumerate(found):
            out[i] = self.weights[at].sum(axis=0) / max(1.0, len(at) ** 0.5) + self.bias
        return out

    def positions(self, words: list[str]) -> list[int]:
        return sorted(self.vocabulary[g] for g in ngrams(words) if g in self.vocabulary)


def _variations(rng: np.random.RandomState) -> list[tuple[int, list[str]]]:
    """Templates, windows of them, and copies with words left out or foreign words around them."""
    out = []
    starts = Counter(head for texts in TEMPLATES.values() for head in {tuple(w[:n]) for w in map(paragraph_words, texts) for n in HEADS})
    for family, (name, texts) in enumerate(TEMPLATES.items()):
        for text in texts:
            own = paragraph_words(text)
            out.append((family, own))
            # Those that are one family's alone; notices of the GNU licences differ by a word.
            heads = [own[:n] for n in HEADS if starts[tuple(own[:n])] == 1 and name not in _GNU]
            parts = [own[at:at + rng.randint(9, 32)] for at in range(0, len(own) - 8, 4)] + heads * 4 if len(own) > 14 else []
            for part in [own] * 6 + parts:
                kept = [w for w in part if rng.rand() > 0.08] or part
                around = [f"x{rng.randint(10**6)}" for _ in range(rng.randint(0, 8))]
                out.append((family, [*around[:len(around) // 2], *kept, *around[len(around) // 2:]]))
    return out


def fit(background: list[list[str]], rounds: int = 250, l2: float = 1e-3, seed: int = 5) -> Classifier:
    """Multinomial logistic regression over template n-grams by gradient steps, calibrated on every fifth example."""
    rng = np.random.RandomState(seed)
    families = list(TEMPLATES)
    vocabulary = {g: i for i, g in enumerate(sorted({g for texts in TEMPLATES.values() for t in texts for g in ngrams(paragraph_words(t))}))}
    model = Classifier(families, vocabulary, np.zeros((len(vocabulary), len(families) + 1)), np.zeros(len(families) + 1),
                       words=frozenset(g for g in vocabulary if " " not in g))
    common = sorted(model.words)
    loose = [[common[i] for i in rng.randint(0, len(common), rng.randint(1, 6))] for _ in range(400)]  # template words, but not in a row
    examples = _variations(rng) + [(len(families), w) for w in [*loose, *background]]
    positions, labels = [model.positions(w) for _, w in examples], np.array([c for c, _ in examples])
    keep = [i for i, at in enumerate(positions) if at]  # the others hold nothing to learn from
    left_out = np.array([i % 5 == 0 for i in range(len(keep))])
    teach = [keep[i] for i in np.flatnonzero(~left_out)]
    row = np.concatenate([np.full(len(positions[i]), k) for k, i in enumerate(teach)])
    column = np.concatenate([np.array(positions[i]) for i in teach])
    value = np.concatenate([np.full(len(positions[i]), len(positions[i]) ** -0.5) for i in teach])
    target = np.eye(len(families) + 1)[labels[teach]]
    share = np.bincount(labels[teach], minlength=len(families) + 1) + 1.0
    model.bias = np.log(share / share.sum())
    speed, total = np.full_like(model.weights, 1e-6), len(teach)
    for _ in range(rounds):
        scores = np.zeros((total, len(model.bias)))
        np.add.at(scores, row, model.weights[column] * value[:, None])
        scores += model.bias
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        error = (target - scores / scores.sum(axis=1, keepdims=True)) / total
        grad = np.zeros_like(model.weights)
        np.add.at(grad, column, error[row] * value[:, None])
        grad -= l2 / total * model.weights
        speed += grad * grad
        model.weights += 0.5 * grad / np.sqrt(speed)
    check = [keep[i] for i in np.flatnonzero(left_out)]
    scores = model.scores([positions[i] for i in check])
    margin = _margin(scores)
    _calibrate(model, margin, (scores[:, :-1].argmax(axis=1) == labels[check]).astype(float))
    return model


def _margin(scores: np.ndarray) -> np.ndarray:
    """How far the best family is above everything else."""
    best = scores[:, :-1].argmax(axis=1)
    rest = scores.copy()
    rest[np.arange(len(rest)), best] = -np.inf
    top = rest.max(axis=1, keepdims=True)
    return scores[np.arange(len(scores)), best] - (top + np.log(np.exp(rest - top).sum(axis=1, keepdims=True))).ravel()


def _calibrate(model: Classifier, margin: np.ndarray, right: np.ndarray) -> None:
    """Platt scaling of the margin, with smoothed targets."""
    n1, n0 = right.sum(), len(right) - right.sum()
    target = np.where(right == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        a += 0.05 * ((target - p) * margin).mean()
        b += 0.05 * (target - p).mean()
    model.slope, model.offset = max(a, 0.1), b


_TEMPLATE_PAIRS = [(family, frozenset(_pairs(paragraph_words(t)))) for family, texts in TEMPLATES.items() for t in texts]
_PAIR_TEMPLATES: dict[tuple[str, ...], list[int]] = {}
for _i, (_, _own) in enumerate(_TEMPLATE_PAIRS):
    for _pair in _own:
        _PAIR_TEMPLATES.setdefault(_pair, []).append(_i)


# Pairs of one family's templates alone. Notices of the other GNU licences have most of gpl's, so its own are those with its name.
_ONLY = {pair: next(iter(found)) for pair, found in ((p, {_TEMPLATE_PAIRS[i][0] for i in at}) for p, at in _PAIR_TEMPLATES.items()) if len(found) == 1}
_ONLY = {pair: family for pair, family in _ONLY.items() if family != "gpl" or any(w == "gnu" or w.startswith("gpl") for w in pair)}


def _names(words: list[str]) -> set[tuple[str, ...]]:
    """Words of a short paragraph that are a template by themselves, such as the names of a licence in one word."""
    return {(w,) for w in words if (w,) in _PAIR_TEMPLATES} if len(words) <= SHORT else set()


def similarities(words: list[str]) -> dict[str, float]:
    """By family the best overlap of word pairs with a template: the share of the shorter side, so that parts and additions count in full."""
    own = _pairs(words)
    shared: dict[int, int] = {}
    for pair in own | _names(words):
        for i in _PAIR_TEMPLATES.get(pair, ()):
            shared[i] = shared.get(i, 0) + 1
    best: dict[str, float] = {}
    for i, n in shared.items():
        family, pairs = _TEMPLATE_PAIRS[i]
        best[family] = max(best.get(family, 0.0), n / min(len(own), len(pairs)))
    return best


# Words by which a notice names terms of use, whatever licence they are.
_NOTICE = re.compile(
    r"SPDX-License-Identifier:\s*\S+"
    r"|\b(?:licen[sc]ed|released|distributed|available|provided|published|covered|governed|redistributed|used)\s+(?:only\s+)?under\s+(?:\S+\s+){0,8}?\S*licen[sc]e\b"
    r"|\blicen[sc]ed\s+(?:only\s+)?under\s+\S"
    r"|\b(?:under|to|accept|with)\s+the\s+(?:terms|conditions)\s+(?:and\s+conditions\s+)?of\s+(?:\S+\s+){0,8}?\S*licen[sc]e\b"
    r"|\bpermission\s+(?:is\s+(?:hereby\s+)?granted|to\s+(?:use|copy|modify|distribute))\b"
    r"|\bredistribution\s+and\s+use\b"
    r"|\b(?:software|work|program|library|file|code)\b.{0,40}\b(?:released\s+into|in)\s+the\s+public\s+domain\b"
    r"|\b(?:software|program|library|file|code)\s+is\s+provided\s+\W?as[\s-]is\b"
    r"|\ball\s+rights\s+reserved\b"
    r"|\b[\w.+-]+(?:\s+[\w.+-]+){0,3}\s+licen[sc]e(?:\s+agreement)?\s*[-,:(]?\s*(?:v|ver|version)\.?\s*\d", re.IGNORECASE)
_CUES = ("licen", "public", "permission", "redistribution", "provided", "rights")


def notices(line: str) -> list[tuple[int, int]]:
    """Where a paragraph reads like a licence notice, as code points."""
    low = line.lower()
    return [m.span() for m in _NOTICE.finditer(line)] if any(c in low for c in _CUES) else []


def _without(part: list[str], family: str, shown: set[str]) -> list[str]:
    """The words with those blanked that show another of the families and not this one."""
    own, other = set(), set()
    for i, pair in enumerate(zip(part, part[1:])):
        only = _ONLY.get(pair)
        if only in shown:
            (own if only == family else other).update((i, i + 1))
    return ["" if i in other and i not in own else w for i, w in enumerate(part)]


def families_of(model: Classifier, part: list[str]) -> list[tuple[str, float, float, bool]]:
    """(family, probability, similarity, whether a pair of words shows it alone) of every licence in a window.

    The classifier names the family and a template has to confirm it. Where word pairs show several families, each that a template confirms
    is also judged without the words that show the others.
    """
    near = similarities(part)
    shown = {_ONLY[pair] for pair in zip(part, part[1:]) if pair in _ONLY}
    several = sorted(f for f in shown if near.get(f, 0.0) >= SIMILARITY)
    best: dict[str, tuple[float, float, bool]] = {}
    for wanted in [None, *(several if len(shown) > 1 else [])]:
        scores = model.scores([model.positions(part if wanted is None else _without(part, wanted, shown))])
        probability = float(1 / (1 + np.exp(-np.clip(model.slope * _margin(scores)[0] + model.offset, -30, 30))))
        family = model.families[int(scores[0, :-1].argmax())]
        confirmed = near.get(family, 0.0)
        alone = len(_pairs(part)) < 2 and confirmed < 1  # a single common pair proves nothing
        if wanted in (None, family) and probability >= PROBABILITY and confirmed >= SIMILARITY and not alone and probability > best.get(family, (0.0,))[0]:
            best[family] = (probability, confirmed, family in shown)
    return [(family, *found) for family, found in best.items()]


def nearest(model: Classifier, words: list[str]) -> tuple[float, float]:
    """Probability and similarity of the family that a notice comes nearest to."""
    scores = model.scores([model.positions(words)])
    probability = float(1 / (1 + np.exp(-np.clip(model.slope * _margin(scores)[0] + model.offset, -30, 30))))
    return probability, similarities(words).get(model.families[int(scores[0, :-1].argmax())], 0.0)


def passages(model: Classifier, words: list[str]) -> list[tuple[str, float, float, int, int]]:
    """(family, probability, similarity, first word, end) of every licence in a paragraph, in the order of their places.

    A long paragraph is judged by windows of FRAGMENT words; windows of one family that overlap or touch are one passage. What no word pair shows to
    be of its family alone is left to one that is shown, or else surer, in a window over the same words; what all GNU licences share to the one that is named.
    """
    found = []
    for at in range(0, max(1, len(words) - FRAGMENT // 2), FRAGMENT // 2):
        part = words[at:at + FRAGMENT]
        found += [(*one, at, at + len(part)) for one in families_of(model, part)]
    merged: list[tuple[str, float, float, int, int]] = []
    for family in sorted({x[0] for x in found}):
        for _, probability, near, shown, at, end in (x for x in found if x[0] == family):
            if not shown and any(x[0] != family and (x[3] and {family, x[0]} <= _GNU or (x[3], x[1]) > (shown, probability) and x[4] < end and at < x[5])
                                 for x in found):
                continue
            last = merged[-1] if merged else None
            if last and last[0] == family and at <= last[4]:
                surest = max((last[1], last[2]), (probability, near))
                merged[-1] = (family, *surest, last[3], end)
            else:
                merged.append((family, probability, near, at, end))
    return sorted(merged, key=lambda x: (x[3], x[0]))


def train(docs: DataFrame, id_column: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """Fit with paragraphs of at most sample_docs texts, those of least id hash, as examples of no licence; lines that match a template closely are not used."""
    rows = docs.select(F.xxhash64(id_column, text).alias("order"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    share = min(1.0, (1.5 * sample_docs + 50) / max(1, docs.count()))  # thinned by the hash, so that tasks send few rows
    rows = rows.filter(F.pmod("order", F.lit(1 << 30)) < share * (1 << 30))
    chosen = rows.orderBy("order").limit(sample_docs).select(F.slice(F.split("text", "\n"), 1, SAMPLE_PARAGRAPHS).alias("lines"))
    background = []
    for r in sorted(chosen.collect(), key=lambda r: r.lines):
        for line in r.lines:
            words = paragraph_words(line)[:FRAGMENT]
            if words and max(similarities(words).values(), default=0.0) < 0.3:
                background.append(words)
    return fit(background)


FOUND = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                  T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType())]))
_FOUND = pa.list_(pa.struct([("line", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()),
                             ("similarity", pa.float64())]))


def scan_text(model: Classifier, text: str | None) -> list[dict]:
    """Passages of a text that hold a licence: line (from 0), code points, family, probability, similarity. A line may have several.

    A notice outside all passages of a known family is `unknown`, with the probability and similarity of the family that comes nearest.
    """
    out, at = [], 0
    for number, line in enumerate((text or "").split("\n")):
        words, found, spans = paragraph_words(line), [], []
        if any(pair in _PAIR_TEMPLATES for pair in zip(words, words[1:])) or _names(words):
            own = [m.span() for m in _WORD.finditer(line)]
            spans = own if len(own) == len(words) > FRAGMENT else []
            for family, probability, near, first, end in passages(model, words):
                shown = any(_ONLY.get(pair) == family for pair in zip(words[first:end], words[first + 1:end]))
                start = spans[first][0] if first and spans else 0
                stop = spans[end - 1][1] if end < len(words) and spans else len(line)
                if not shown and any(start < y and x < stop and not model.words.issuperset(paragraph_words(line[x:y])) for x, y in notices(line)):
                    continue  # the wording is common to many licences and the notice names one that no template has
                found.append((start, stop, family, probability, near))
        known = list(found)
        for start, stop in notices(line):
            if not any(start < y and x < stop for x, y, *_ in known):
                if found and found[-1][2] == UNKNOWN and len(paragraph_words(line[found[-1][1]:start])) < FRAGMENT:
                    start = found.pop()[0]
                found.append((start, stop, UNKNOWN, *nearest(model, paragraph_words(line[start:stop])[:FRAGMENT])))
        out += [{"line": number, "start": at + start, "end": at + stop, "family": family, "probability": probability, "similarity": near}
                for start, stop, family, probability, near in sorted(found)]
        at += len(line) + 1
    return out


def scan(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """The table with `licences`, an array of what scan_text finds."""
    (name,) = fresh(docs, "licences")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [scan_text(model, t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _FOUND)], [*batch.schema.names, name])

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, T.StructField(name, FOUND)]))
