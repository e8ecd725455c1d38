"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are runs of lines between lines without a word (blank ones, or bare comment marks), so that a notice wrapped
over lines is one; each single line of a longer run is judged too, and of overlapping findings the one with the better
template coverage stays. A multinomial logistic regression over sparse word n-grams (1 to 3) gives each a licence
family, ``unknown`` (licence-like, but no known family) or ``none``. It is trained on the templates below, varied by
dropping and adding words, against lines and runs of a bounded sample of the corpus, plain sentences that use the same
words, and licence-like sentences without a family. Its n-grams are those of the licence sentences. Probabilities are
calibrated by a temperature fitted on variations that training didn't see, with their calibration error kept in the
model; a family below ``SURE`` becomes ``unknown``. A predicted family is confirmed if the paragraph holds enough of the
word trigrams of one of its templates, and enough of the paragraph is the template if that is short; families that no
template confirms become ``unknown`` too, and short lines (under ``LEAST_WORDS``) count only if confirmed.

Defined cases: null, empty and wordless texts have no paragraph and no licence; an empty table gives an empty result,
and a model trained on one knows the templates alone; repeated rows stay rows; other columns are ignored. The model's
size depends on the templates only; training sees ``SAMPLE_ROWS`` documents and ``SAMPLE_LINES`` of their paragraphs at
most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonloom.llm.textops import Words, drawn, mix, sliced

#: Notices and key sentences of common licences.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied",
        "SPDX-License-Identifier: Apache-2.0", "Apache License, Version 2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT", "MIT License", "The MIT License", "License: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "SPDX-License-Identifier: BSD-3-Clause", "BSD 3-Clause License", "BSD 2-Clause License",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version",
        "You should have received a copy of the GNU General Public License along with this program",
        "SPDX-License-Identifier: GPL-3.0-or-later", "GNU General Public License, version 3",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0", "Released under the Creative Commons CC0 1.0 Universal public domain dedication"],
    "proprietary": ["All rights reserved", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential"],
}
#: Licence-like sentences without a family, for the unknown class.
UNKNOWN = [
    "Licensed under the terms of the community license", "This work is licensed under an agreement between the parties", "See the license for details", "Use of this content is subject to the license terms",
    "Distributed under the example source license, version 1.0", "The license of this work is not known", "Released under a custom license", "Permission to use this text is subject to conditions",
]
#: Plain sentences that use the words of licences.
PLAIN = [
    "The members of the club kept all rights reserved for the founders until the vote last spring", "The blue car had a license plate from another state", "She passed the test and got her driving license in May", "He works mit license plates and signs in a small shop",
    "They asked for permission to use the hall and it was granted without conditions", "The copyright of the song was sold to a studio", "The public library is free and open to the general public on Sunday", "Students of mit met at the institute to talk about software", "The table was reserved for all of us",
    "A fishing license is needed at the lake", "The version of the story in the second source differs", "Version 2.0 of the program was slow", "The foundation published a note on the general state of public roads",
]
FAMILIES = ["none", "unknown", *TEMPLATES]
#: Documents and paragraphs of theirs that training sees at most (about); variations of each template.
SAMPLE_ROWS, SAMPLE_LINES, VARIATIONS = 3_000, 8_000, 40
SURE, COVERED, GRAMS = 0.6, 0.6, (1, 2, 3)
#: A template of fewer words must make up this share of what it confirms; words of an unconfirmed finding at least.
SHORT_WORDS, SHORT_SHARE, LEAST_WORDS = 6, 0.4, 4
EPOCHS, STEP = 150, 40.0

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def _grams(h: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside units (paragraphs), and their first words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(unit[:m] == unit[n - 1 :])
    g = np.full(len(at), n, np.uint64)
    for j in range(n):
        g = mix(g * np.uint64(31) + h[at + j])
    return g, at


class Paragraphs:
    """Paragraphs of a chunk of texts: runs of lines first, then the lines of longer runs. Each has its text's number,
    its byte range, and its words, which are next to each other."""

    def __init__(self, texts: list[bytes | None]):
        self.words = w = Words(texts, IS_WORD)
        self.hash = w.hashes()
        breaks = np.flatnonzero((w.bytes == 0x0A) | (w.bytes == 0))
        line = np.searchsorted(breaks, w.start)
        apart, far = np.ones(w.n, bool), np.ones(w.n, bool)  # words that begin a line; a run of lines
        apart[1:] = line[1:] != line[:-1]
        far[1:] = (line[1:] > line[:-1] + 1) | (w.text[1:] != w.text[:-1])
        self.run = np.cumsum(far) - 1
        runs, lines = np.flatnonzero(far), np.flatnonzero(apart)
        self.n_runs = len(runs)
        ends = np.append(lines[1:], w.n)
        again = np.bincount(self.run[lines], minlength=self.n_runs)[self.run[lines]] > 1  # a run of one line is judged once
        #: The number of a word's line among the paragraphs, -1 if it has none of its own.
        number = np.where(again, np.cumsum(again) - 1 + self.n_runs, -1)
        self.line = np.repeat(number, ends - lines)
        self.lo = np.concatenate([runs, lines[again]])
        self.hi = np.concatenate([np.append(runs[1:], w.n)[: self.n_runs], ends[again]])
        self.n, self.size = len(self.lo), self.hi - self.lo
        self.text, self.start, self.end = w.text[self.lo], w.start[self.lo], w.end[self.hi - 1]

    def features(self, known: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, gram hash) of all n-grams, or of those that ``known`` marks. A gram counts once in a paragraph,
        however often it is repeated."""
        units, found = [], []
        for n in GRAMS:
            g, at = _grams(self.hash, self.run, n)
            if known is not None:
                hit = known(g)
                g, at = g[hit], at[hit]
            inside = (self.line[at] >= 0) & (self.line[at] == self.line[at + n - 1])
            units += [self.run[at], self.line[at[inside]]]
            found += [g, g[inside]]
        unit, g = np.concatenate(units), np.concatenate(found)
        if not len(g):
            return unit, g
        by = np.lexsort((g, unit))
        unit, g = unit[by], g[by]
        new = np.append(True, (unit[1:] != unit[:-1]) | (g[1:] != g[:-1]))
        return unit[new], g[new]


def _logits(unit: np.ndarray, at: np.ndarray, size: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Class scores from sparse features: (paragraph, gram place), each of weight 1 / sqrt(words x gram lengths)."""
    scale = 1 / np.sqrt(np.maximum(size, 1) * len(GRAMS))
    out = np.stack([np.bincount(unit, weights[at, j], len(size)) for j in range(weights.shape[1])], axis=1)
    return out * scale[:, None] + bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Weights of the n-grams that training met, by sorted hash; ``error``: its calibration error on held-out
    variations; ``templates``: (family, trigrams, words) of each template."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float, error: float, templates: list[tuple[int, np.ndarray, int]]):
        self.grams, self.weights, self.bias, self.temperature, self.error, self.templates = grams, weights, bias, temperature, error, templates
        self.low = np.zeros(1 << 18, bool)  # most grams aren't the model's: their low bits tell
        self.low[grams & np.uint64(len(self.low) - 1)] = True

    def known(self, g: np.ndarray) -> np.ndarray:
        """True for the model's n-grams."""
        hit = self.low[g & np.uint64(len(self.low) - 1)]
        some = g[hit]
        hit[hit] = self.grams[np.minimum(np.searchsorted(self.grams, some), len(self.grams) - 1)] == some
        return hit

    def logits(self, p: Paragraphs) -> np.ndarray:
        unit, g = p.features(self.known)
        return _logits(unit, np.searchsorted(self.grams, g), p.size, self.weights, self.bias)

    def coverage(self, family: int, words: np.ndarray) -> float:
        """Largest share of a template's trigrams that the words (hashes) hold. A short template that isn't
        ``SHORT_SHARE`` of the words covers nothing."""
        one = np.zeros(len(words), np.int64)
        held = {n: _grams(words, one, n)[0] for n in GRAMS}
        return max((float(np.isin(t, held[min(3, n)]).mean()) for f, t, n in self.templates if f == family and (n >= SHORT_WORDS or n >= SHORT_SHARE * len(words))), default=0.0)

    def classify(self, p: Paragraphs) -> list[tuple[int, str, float, float]]:
        """(paragraph, family or unknown, probability, template coverage) of those that aren't ``none``; of a run and
        its lines the one with the larger coverage."""
        if not p.n:
            return []
        prob = _softmax(self.logits(p) / self.temperature)
        found = []
        for i in np.flatnonzero(1 - prob[:, 0] >= SURE).tolist():
            j = 1 + int(prob[i, 1:].argmax())
            cover = self.coverage(j, p.hash[p.lo[i] : p.hi[i]]) if j > 1 else 0.0
            sure = j > 1 and prob[i, j] >= SURE and cover >= COVERED
            if sure or p.size[i] >= LEAST_WORDS:
                found.append((i, FAMILIES[j] if sure else "unknown", float(prob[i, j]), cover))
        # the surest first; what overlaps one that is already taken goes (equal: the run before its lines)
        taken: list[tuple[int, str, float, float]] = []
        ranges: dict[int, list[tuple[int, int]]] = {}
        for x in sorted(found, key=lambda x: (x[1] == "unknown", -x[3], x[0])):
            own = ranges.setdefault(int(p.text[x[0]]), [])
            if all(p.end[x[0]] <= a or p.start[x[0]] >= b for a, b in own):
                own.append((int(p.start[x[0]]), int(p.end[x[0]])))
                taken.append(x)
        return sorted(taken, key=lambda x: int(p.start[x[0]]))


def _varied(rng: np.random.Generator, sentence: str, filler: list[str]) -> str:
    words = [w for w in sentence.split() if rng.random() > 0.06] or sentence.split()
    pick = lambda n: [filler[i] for i in rng.integers(0, len(filler), n)] if filler else []
    kind = rng.random()
    if kind < 0.25:
        words = pick(int(rng.integers(1, 6))) + words
    elif kind < 0.5:
        words = words + pick(int(rng.integers(1, 6)))
    return " ".join(words)


def _features(sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, gram hash) of all n-grams, and each sentence's words. A sentence is one paragraph."""
    p = Paragraphs([" ".join(s.split()).encode() for s in sentences])
    size = np.zeros(len(sentences), np.int64)
    size[p.text] = p.size
    unit, g = p.features()
    return p.text[unit], g, size


def corpus_paragraphs(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Lines, and runs of up to five, of about ``sample_rows`` documents (by a hash of their id), ``SAMPLE_LINES`` at most
    (by a hash of the text). Those with the word stem 'licen', 'copyright' or 'reserved' aren't taken, as they may be
    licences."""
    sample = docs.select("doc_id", "text").where("text is not null").where(drawn(F.col("doc_id"), sample_rows, docs.count(), 4))
    lines = sample.select(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("lines"))
    runs = F.transform(F.sequence(F.lit(1), F.size("lines"), F.lit(5)), lambda i: F.array_join(F.slice("lines", i, 5), " "))
    units = lines.where(F.size("lines") > 0).select(F.explode(F.concat("lines", runs)).alias("line")).where("not lower(line) rlike 'licen|copyright|reserved'").distinct()
    return [r[0] for r in units.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES).collect()]


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 3) -> Model:
    """A model from the templates, with paragraphs of the corpus and plain sentences as ``none``."""
    plain = corpus_paragraphs(docs, sample_rows)
    rng = np.random.default_rng(seed)
    filler = sorted({w for s in plain[:200] for w in s.split()})[:2000]
    sets: list[tuple[list[str], np.ndarray]] = []
    for part in range(2):  # for the weights; for the temperature
        text, family = [], []
        for j, name in enumerate(FAMILIES):
            base = PLAIN if name == "none" else UNKNOWN if name == "unknown" else TEMPLATES[name]
            made = [v for s in base for v in [s, *(_varied(rng, s, filler) for _ in range(VARIATIONS))]]
            made += plain[part::2] if name == "none" else []
            text += made
            family += [j] * len(made)
        sets.append((text, np.array(family)))
    (text, y), (text_v, y_v) = sets
    unit, g, size = _features(text)
    grams, n = np.unique(g[y[unit] > 0], return_counts=True)
    grams = grams[n >= 2]

    def placed(unit: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
        hit = grams[at] == g
        return unit[hit], at[hit]

    unit, at = placed(unit, g)
    w, b = np.zeros((len(grams), len(FAMILIES))), np.zeros(len(FAMILIES))
    # classes weigh the same; the plain sentences half of theirs
    n_plain = max(1, len(plain[0::2]))
    share = np.where(y == 0, 0.5 / n_plain, 1 / np.bincount(y, minlength=len(FAMILIES))[y])
    share[: len(PLAIN) * (VARIATIONS + 1)] = 0.5 / (len(PLAIN) * (VARIATIONS + 1))
    share, onehot = share[:, None] / len(FAMILIES), np.eye(len(FAMILIES))[y]
    scale = 1 / np.sqrt(np.maximum(size, 1) * len(GRAMS))
    by = np.argsort(at, kind="stable")
    heads = np.flatnonzero(np.append(True, at[by][1:] != at[by][:-1]))
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(EPOCHS):  # full-batch descent with momentum over the sparse features
        d = (_softmax(_logits(unit, at, size, w, b)) - onehot) * share
        grad = np.zeros_like(w)
        grad[at[by][heads]] = np.add.reduceat((d * scale[:, None])[unit[by]], heads)
        mw, mb = 0.9 * mw - STEP * (grad + 1e-6 * w), 0.9 * mb - 0.1 * STEP * d.sum(0)
        w, b = w + mw, b + mb
    unit_v, g_v, size_v = _features(text_v)
    z = _logits(*placed(unit_v, g_v), size_v, w, b)
    of = np.arange(len(y_v))
    temperature = min((0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=lambda t: float(-np.log(np.maximum(_softmax(z / t)[of, y_v], 1e-12)).mean()))
    prob = _softmax(z / temperature)
    top, right = prob.max(axis=1), prob.argmax(axis=1) == y_v
    bin_of = np.minimum((top * 10).astype(int), 9)
    error = float(np.abs(np.bincount(bin_of, top - right, 10)).sum() / max(len(top), 1))
    templates = []
    for name, sentences in TEMPLATES.items():
        for sentence in sentences:
            h = Words([sentence.encode()], IS_WORD).hashes()
            templates.append((FAMILIES.index(name), np.unique(_grams(h, np.zeros(len(h), np.int64), min(3, len(h)))[0]), len(h)))
    return Model(grams, w, b, temperature, error, templates)


def _scanner(model: Model):
    kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("coverage", pa.float64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in sliced(batch.column(1)):
                p = Paragraphs(texts)
                begin = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
                found: list[list[dict]] = [[] for _ in range(b - a)]
                for i, family, prob, cover in model.classify(p):
                    d = int(p.text[i])
                    found[d].append({"family": family, "probability": prob, "coverage": cover, "start_byte": int(p.start[i] - begin[d]), "end_byte": int(p.end[i] - begin[d])})
                n = np.bincount(p.text[: p.n_runs], minlength=b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(found, kind)], names=["doc_id", "n_paragraphs", "found"])

    return run


def scanned(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, found: the licence paragraphs (family or unknown, probability, coverage of the closest
    template, byte range) of every row, by start."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scanner(model), f"doc_id {kind}, n_paragraphs bigint, found array<struct<family:string,probability:double,coverage:double,start_byte:bigint,end_byte:bigint>>")
