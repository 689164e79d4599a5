"""Licence scans: a trained paragraph classifier, an unknown class, and templates that confirm.

A paragraph is a run of non-blank lines.  Its lines are scored one by one, long
ones in windows, and so is every stretch, across line ends, that holds enough of
a template's word pairs; of stretches that overlap, the best confirmed one counts.

The features of a stretch are hashed runs of one to three words; a
multinomial logistic regression on the features that occur in the templates
tells licence families, other licence wording and ordinary text apart.  The
temperature is calibrated on variants that were left out of training; a family
whose calibrated probability is low, or whose templates do not confirm it, is
reported as unknown.  Hits are found by looking up word hashes, without Python
objects for words.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .scratch import bounded_batches

from .words import mix, word_hashes

# Usual wordings of each family's notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Available under the CC BY-NC-SA 4.0 licence.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU GPL v2 or later.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This software is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
OTHER: tuple[str, ...] = (  # licence wording of no family above
    "All rights reserved. No part of this publication may be reproduced without written permission of the publisher.",
    "Licensed under the terms of the vendor agreement.", "Use of this software is subject to the enclosed end user license agreement.",
    "Released under a custom community license.", "This work is licensed under the terms stated by its owner.",
    "SPDX-License-Identifier: LicenseRef-Proprietary", "Distributed under the Example Public License, version 1.",
    "All rights reserved.", "All rights reserved worldwide.", "Copyright by the author. All rights reserved.", "Copyright (c) the authors and contributors. All rights reserved.", "Proprietary and confidential.", "Unauthorized copying of this file is strictly prohibited.",
    "No license is granted to use or copy this work.", "May not be reproduced or redistributed without permission.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
)
ORDINARY: tuple[str, ...] = (
    "The driver showed his license to the officer and went on.", "She studied at MIT and works for a public library.", "The general said the public would be free to enter.",
    "The foundation published a new version of the work.", "Under the terms of the contract the work was released in May.", "You can use this source of water with care.",
    "Creative people are common in the city, and commons are free.", "The following conditions are met in most forms of the disease.", "He was granted permission to obtain a copy of the file.",
    "An apache helicopter flew over the village at two.", "International trade under new terms is subject to change.", "This is the version of the story that I know.",
    "The software is easy to use and the documentation is good.", "With or without sugar, both forms are permitted here.", "Attribution of the painting is not certain.", "by and of the in to a is that it for on with as this was",
    "mit dem und der mit einer von den mit mit das ist nicht mit im", "All the rights of the people were reserved for the king and the rest of them.", "He reserved a table for all of us on the right.", "The copyright of the song was sold by the author to a company.", "Two seats are reserved and the others are free.",
    "Copying the file takes a minute and no permission.", "The reserved man kept the confidential letter and was granted a fee.", "Any purpose is as good as this one, with or without a reason.",
)

BITS, RUNS = 22, (1, 2, 3)
STEPS, RIDGE, VARIANTS = 150, 1e-3, 12
SURE, CONFIRMED = 0.6, 0.5  # least calibrated probability of a family, and least share of a template's word pairs in the paragraph
LONG, WINDOW, STRIDE = 64, 32, 16  # words: a line beyond LONG is scored in windows
SLACK = 1.3  # a stretch may be longer than its template by this
ROWS = 100  # texts scanned at a time
UNKNOWN, NONE = "unknown", "none"
_U = np.uint64
_MULTIPLIERS = np.random.default_rng(31).integers(1, 2**63, (4, 4), dtype=np.uint64) | _U(1)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total += words[i : i + n] * _MULTIPLIERS[k, i]
    return mix(total)


def _plain(lines: pa.Array) -> pa.Array:
    """Punctuation about words gives way to white space; what holds names together, as in cc-by, stays."""
    return pc.replace_substring_regex(lines.cast(pa.large_string()), r"[^\w\s.\-]+|[.\-]+(?:\s|$)|(?:^|\s)[.\-]+", " ")


def _line_words(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, _, h, n in word_hashes(_plain(pa.array(texts, pa.large_string()))):
        out += np.split(h, np.cumsum(n)[:-1])
    return out


@dataclass(frozen=True)
class Scanner:
    """Sorted feature hashes, their weights by class, biases, temperature, and the templates' word pairs by family."""

    classes: list[str]
    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    pairs: dict[str, list[np.ndarray]]

    def sums(self, words: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
        """Logits of consecutive lines; ``line`` is the line of each word.  A feature counts once in a line."""
        out = np.zeros((lines, len(self.classes)))
        for k in RUNS:
            h = runs(words, k)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            hit = np.flatnonzero((self.features[at] == h) & (line[: len(h)] == line[k - 1 :]))
            once = np.unique(line[hit] * len(self.features) + at[hit])
            np.add.at(out, once // len(self.features), self.weights[once % len(self.features)])
        return out + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def similarity(self, family: str, words: np.ndarray) -> float:
        """Largest share of a template's word pairs that the paragraph has."""
        own = np.unique(runs(words, 2) if len(words) > 1 else words)
        return max(float(np.isin(t, own).mean()) for t in self.pairs[family])

    def closeness(self, family: str, words: np.ndarray) -> float:
        """Largest share that common word pairs have of all pairs of the paragraph and a template of the family."""
        own = np.unique(runs(words, 2) if len(words) > 1 else words)
        return max(len(np.intersect1d(t, own)) / len(np.union1d(t, own)) for t in self.pairs[family])

    def likeness(self, words: np.ndarray) -> float:
        """Largest overlap with any template: common word pairs by the fewer of the two sides."""
        own = np.unique(runs(words, 2) if len(words) > 1 else words)
        return max(float(np.isin(t, own).sum()) / min(len(t), len(own)) for f in self.pairs for t in self.pairs[f])

    def decide(self, probability: np.ndarray, words: np.ndarray) -> tuple[str, float, float]:
        """(family, unknown or none; its probability; template similarity) of one paragraph.

        What is more probably licence wording than ordinary text is a family if its templates confirm it, and unknown if not.
        """
        ordinary = self.classes.index(NONE)
        if probability[ordinary] >= 0.5:
            return NONE, float(probability[ordinary]), 0.0
        k = int(np.delete(probability, ordinary).argmax())  # the last class is none
        name = self.classes[k]
        near = self.similarity(name, words)
        if name != UNKNOWN and near >= CONFIRMED and probability[k] >= SURE:
            return name, float(probability[k]), near
        return UNKNOWN, float(1 - probability[ordinary]), self.likeness(words)


def _variants(text: str, rng: np.random.Generator) -> list[str]:
    """The text, and the text with words left out or ordinary words about it."""
    words, out = text.split(), [text, text.rstrip(".:")]
    for _ in range(VARIANTS):
        kept = [w for w in words if rng.random() > 0.06]
        about = ORDINARY[rng.integers(len(ORDINARY))].split()
        cut = int(rng.integers(0, len(about)))
        out.append(" ".join((about[:cut] if rng.random() < 0.5 else []) + kept + (about[cut:] if rng.random() < 0.3 else [])))
    return out


@cache
def train() -> Scanner:
    """Fits the classifier on variants of the templates, always the same."""
    rng = np.random.default_rng(2)
    classes = [*TEMPLATES, UNKNOWN, NONE]
    texts, labels = [], []
    for name, wordings in [*TEMPLATES.items(), (UNKNOWN, OTHER), (NONE, ORDINARY)]:
        for w in wordings:
            v = _variants(w, rng) if name != NONE else [w, *(" ".join(rng.permutation(w.split())[: rng.integers(2, 9)]) for _ in range(VARIANTS))]
            texts += v
            labels += [classes.index(name)] * len(v)
    words, y = _line_words(texts), np.array(labels)
    each = [np.concatenate([runs(w, k) for k in RUNS]) for w in words]
    features = np.unique(np.concatenate(each))
    x = np.zeros((len(texts), len(features)), dtype=np.float64)
    for i, f in enumerate(each):
        x[i, np.searchsorted(features, f)] = 1.0
    held = np.arange(len(texts)) % 4 == 3
    target = np.eye(len(classes))[y]
    w, b = np.zeros((len(features), len(classes))), np.zeros(len(classes))
    gw, gb = np.zeros_like(w), np.zeros_like(b)
    fit_x, fit_t = x[~held], target[~held]
    for _ in range(STEPS):  # full gradients with momentum
        z = fit_x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - fit_t) / len(fit_x)
        gw = 0.9 * gw + fit_x.T @ d + RIDGE * w
        gb = 0.9 * gb + d.sum(axis=0)
        w -= 0.5 * gw
        b -= 0.5 * gb
    b[classes.index(NONE)] += 1.0  # a line without any known wording is ordinary
    z = x[held] @ w + b

    def loss(t: float) -> float:
        q = z / t
        q = q - np.log(np.exp(q - q.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - q.max(axis=1, keepdims=True)
        return -float((q * target[held]).sum())

    temperature = min(np.geomspace(0.2, 5, 60).tolist(), key=loss)
    pairs = {name: [np.unique(runs(t, 2) if len(t) > 1 else t) for t in _line_words(list(wordings))] for name, wordings in [*TEMPLATES.items(), (UNKNOWN, OTHER)]}
    return Scanner(classes, features, w, b, temperature, pairs)


def _line_spans(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of lines with words, of long ones in windows."""
    short, long_ = np.flatnonzero((n > 0) & (n <= LONG)), np.flatnonzero(n > LONG)
    first, last = [start[short]], [start[short] + n[short]]
    for k in long_.tolist():
        at = np.append(np.arange(0, n[k] - WINDOW, STRIDE), n[k] - WINDOW)
        first.append(start[k] + at)
        last.append(start[k] + at + WINDOW)
    return np.concatenate(first), np.concatenate(last)


def _template_spans(scanner: Scanner, words: np.ndarray, paragraph: np.ndarray) -> list[tuple[int, int]]:
    """Stretches inside a paragraph with ``CONFIRMED`` of a template's word pairs, from the first of these to the last; of templates of a few words, all pairs."""
    h = runs(words, 2)
    templates = [t for f in scanner.pairs for t in scanner.pairs[f]]
    known = np.unique(np.concatenate(templates))
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hits = np.flatnonzero((known[at] == h) & (paragraph[:-1] == paragraph[1:])) if len(h) else np.zeros(0, dtype=np.int64)
    found = set()
    for t in templates:
        least, most = int(np.ceil(CONFIRMED * len(t))) if len(t) > 3 else len(t), int(SLACK * len(t)) + 1
        q = hits[np.isin(h[hits], t)]
        if len(q) < least:
            continue
        near = (q[least - 1 :] - q[: len(q) - least + 1] < most) & (paragraph[q[least - 1 :]] == paragraph[q[: len(q) - least + 1]])
        best: tuple[int, int, int] | None = None
        for i in np.flatnonzero(near).tolist():
            part = q[i : np.searchsorted(q, q[i] + most)]
            part = part[paragraph[part] == paragraph[q[i]]]
            new = np.unique(h[part], return_index=True)[1]  # what only repeats pairs is no part of the stretch
            size, first, last = len(new), int(part[0]), int(part[new.max()]) + 2
            if size < least:
                continue
            if best is None or first >= best[2] or (size, first - last) > (best[0], best[1] - best[2]):
                found.update([best[1:]] if best else [])
                best = size, first, last
        if best:
            found.add(best[1:])
    return sorted(found)


def _best(spans: list[tuple]) -> list[tuple]:
    """Of (start, end, name, probability, similarity, closeness) that overlap only the best: families before unknown, by closeness and length."""
    taken: list[tuple] = []
    starts: list[int] = []
    for s in sorted(spans, key=lambda s: (s[2] == UNKNOWN, -s[5], s[0] - s[1], -s[3], s[0])):
        i = bisect(starts, s[0])
        if (i and taken[i - 1][1] > s[0]) or (i < len(taken) and taken[i][0] < s[1]):
            continue
        starts.insert(i, s[0])
        taken.insert(i, s)
    return taken


def _scan(scanner: Scanner, texts: pa.Array) -> Iterator[tuple[int, int, str, float, float]]:
    parts = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    parent = np.asarray(pc.list_parent_indices(parts)).astype(np.int64)
    number = np.arange(len(parent)) - np.searchsorted(parent, parent)
    pieces = [(h, n) for _, _, h, n in word_hashes(_plain(parts.flatten()))]
    if not pieces:
        return
    words, n = (np.concatenate(x) for x in zip(*pieces, strict=True))
    start = np.cumsum(n) - n
    line = np.repeat(np.arange(len(n)), n)
    blank = np.asarray(pc.equal(pc.utf8_trim_whitespace(parts.flatten()), "").fill_null(True))
    paragraph = np.cumsum(blank | np.append(True, parent[1:] != parent[:-1]))[line]
    first, last = _line_spans(start, n)
    more = _template_spans(scanner, words, paragraph)
    if more:
        first, last = np.append(first, [s for s, _ in more]), np.append(last, [e for _, e in more])
    ordinary, found = scanner.classes.index(NONE), []
    if not len(first):
        return
    size = np.cumsum(last - first)
    cuts = np.searchsorted(size, np.arange(0, size[-1], 1 << 15))
    for lo, hi in zip(cuts, [*cuts[1:], len(size)], strict=True):
        if lo == hi:
            continue
        length = last[lo:hi] - first[lo:hi]
        of = np.repeat(np.arange(hi - lo), length)
        at = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length) + first[lo:hi][of]
        p = scanner.probabilities(scanner.sums(words[at], of, hi - lo))
        for k in np.flatnonzero(p[:, ordinary] < 0.5).tolist():
            s, e = int(first[lo + k]), int(last[lo + k])
            name, *rest = scanner.decide(p[k], words[s:e])
            found.append((s, e, name, *rest, scanner.closeness(name, words[s:e])))
    before = (-1, 0, "")  # line, end, name
    for s, e, name, probability, near, _ in _best(found):
        one = n[line[s]] > LONG and before[0] == line[s] and before[2] == name == UNKNOWN and s - before[1] <= STRIDE  # windows of one long notice
        before = (int(line[s]), e, name)
        if one:
            continue
        yield int(parent[line[s]]), int(number[line[s]]), name, probability, near


def scan_texts(scanner: Scanner, texts: pa.Array) -> Iterator[tuple[int, int, str, float, float]]:
    """(row, line number, family or unknown, probability, template similarity) of each stretch that is licence wording; the line is its first."""
    for at in range(0, len(texts), ROWS):
        for row, *rest in _scan(scanner, texts.slice(at, ROWS)):
            yield (at + row, *rest)


def licence_paragraphs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` to a row for each paragraph of licence wording: doc_id, line, family, probability, similarity."""
    bounded_batches(docs.sparkSession)
    scanner = train()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(scan_texts(scanner, batch.column(1)))
            row, line, family, probability, near = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(line, pa.int32()), pa.array(family, pa.string()), pa.array(probability, pa.float64()), pa.array(near, pa.float64())], names=["doc_id", "line", "family", "probability", "similarity"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, line int, family string, probability double, similarity double")


def document_licences(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` to doc_id, n_paragraphs, n_unknown, licences, a row for each row.

    ``licences`` holds the families found, sorted and joined by commas, empty if
    none; ``n_paragraphs`` counts paragraphs of licence wording, ``n_unknown``
    those that no family explains.  Null, empty and blank texts have none.
    """
    bounded_batches(docs.sparkSession)
    scanner = train()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, unknown, families = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64), [set() for _ in range(len(batch))]
            for row, _, name, _, _ in scan_texts(scanner, batch.column(1)):
                n[row] += 1
                if name == UNKNOWN:
                    unknown[row] += 1
                else:
                    families[row].add(name)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(unknown), pa.array([",".join(sorted(f)) for f in families], pa.string())], names=["doc_id", "n_paragraphs", "n_unknown", "licences"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_paragraphs long, n_unknown long, licences string")
