"""Licence scans with a trained notice classifier.

A text is one sequence of words, across its line ends; words of punctuation alone (comment
marks) are passed over, so a hard-wrapped notice reads like one on a single line. Every
place where most word pairs of a template stand close together is a candidate of the
template's family. Hashed one- and two-word features of its words feed a multinomial
logistic regression over licence families and an unknown class. It is trained on the driver
with variations of notice templates, and with a bounded sample of the corpus's own paragraphs
and scrambled notices as the unknown class. A held-out part sets the temperature of the
probabilities, and the least chance of a family against the unknown class at which few of its
unknown paragraphs, scrambled notices among them, are accepted. Candidates with that chance are
notices. Where candidates share words, the one with the greatest probability, agreement and
density of matched words counts; others are findings of their own, also of the same family or
in the same line.

SPDX tags are read by their identifiers, each of an expression by itself: a family's prefix
decides, whatever the version or suffix, and probability and agreement are 1. Identifiers of
no family listed here (Apache-1.1, CC-BY-ND) are unknown.

Every word of every document is compared, inside tasks, in one pass without a shuffle.

Defined cases: null, empty and blank texts have no findings; repeated rows are reported
each; an empty table gives an empty table (the classifier is then trained without corpus
paragraphs); other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import only, sampled, slices, table
from riskloom.llm.hashing import WindowHasher, mix, word_places

#: Notices by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
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
    "public domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
    ],
}
FAMILIES = list(TEMPLATES)
#: Buckets of the features; corpus paragraphs in the unknown class, at most; variations of each template; steps.
FEATURES, SAMPLE, VARIATIONS, STEPS = 1 << 14, 3000, 40, 120
#: Notices of so many words are also given scrambled, as unknown.
SCRAMBLED = 8
#: Words that a candidate may span; of templates with more than two thirds of that, half as many again as they have.
WINDOW = 24
#: Share of held-out unknown paragraphs that the least probability may let through to the templates.
FALSE_ACCEPTS = 0.02
#: Share of a template's word pairs that must be in the candidate.
AGREEMENT = 0.6
#: Candidates scored at once.
SCORED = 4096
#: SPDX identifiers by family, and the tag before them.
IDENTIFIERS = {
    "MIT": r"MIT(-.+|NFA)?",
    "Apache-2.0": r"Apache-2\.0.*",
    "GPL": r"GPL-.+",
    "LGPL": r"LGPL(LR)?-.+",
    "AGPL": r"AGPL-.+",
    "BSD": r"0?BSD(-.+)?",
    "MPL-2.0": r"MPL-2\.0.*",
    "CC-BY": r"CC-BY-\d.*",
    "CC-BY-SA": r"CC-BY-SA-.+",
    "CC-BY-NC": r"CC-BY-NC-.+",
    "public domain": r"CC0-.+|Unlicense.*|CC-PDDC|PDDL-.+",
    "proprietary": r"LicenseRef-.*(Proprietary|Commercial|All-Rights-Reserved).*",
}
SPDX, TAG = re.compile(rb"SPDX-License-Identifier\s*:?\s*([^\r\n]*)", re.I), b"spdx-license-identifier"


class NoticeHasher(WindowHasher):
    """Words without case and outer punctuation."""

    def words(self, words: Sequence[bytes]) -> np.ndarray:
        store = self.store
        if len(store) > 1 << 17:
            store.clear()
        for word in words:
            if word not in store:
                store[word] = xxhash.xxh3_64_intdigest(word.lower().strip(b".,;:!?()[]{}\"'*#/|"))
        return np.fromiter(map(store.__getitem__, words), np.uint64, len(words))


#: The hash of words of punctuation alone.
MARKS = np.uint64(xxhash.xxh3_64_intdigest(b""))


def word_pairs(hashed: np.ndarray) -> np.ndarray:
    return mix(mix(hashed[:-1]) + hashed[1:])


def _buckets(hashed: np.ndarray) -> np.ndarray:
    return (hashed & np.uint64(FEATURES - 1)).astype(np.int64)


class Notice(NamedTuple):
    family: int
    probability: float
    agreement: float


class NoticeClassifier:
    """Weights, temperature and least probability; column 0 is the unknown class."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.weights, self.bias, self.temperature, self.least = weights, bias, temperature, least
        hasher = NoticeHasher(1)
        self.templates = [[np.unique(word_pairs(hasher.words(t.encode().split()))) for t in TEMPLATES[f]] for f in FAMILIES]
        # Pairs of all templates but the SPDX tags, and of each template: its family, words, and which of them it has.
        several = [(k, t) for k, family in enumerate(self.templates) for t in family if len(t) > 1]
        self.pairs = np.unique(np.concatenate([t for _, t in several]))
        self.matched = [(k, len(t) + 1, np.isin(self.pairs, t)) for k, t in several]

    def chances(self, hashed: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Class probabilities of the spans of two or more words from ``starts`` to ``ends``."""
        found = np.empty((len(starts), len(self.bias)))
        words = _buckets(hashed)
        pairs = _buckets(word_pairs(hashed))
        for low in range(0, len(starts), SCORED):
            first, n = starts[low : low + SCORED], (ends - starts)[low : low + SCORED]
            begins = np.cumsum(n) - n
            at = np.repeat(first - begins, n) + np.arange(n.sum())
            one = np.add.reduceat(self.weights[words[at]], begins, axis=0)
            two = self.weights[pairs[np.minimum(at, len(pairs) - 1)]]
            two[begins + n - 1] = 0  # the last word starts no pair
            sums = one + np.add.reduceat(two, begins, axis=0)
            found[low : low + SCORED] = softmax((sums / np.sqrt(2.0 * n - 1)[:, None] + self.bias) / self.temperature)
        return found

    def agreement(self, hashed: np.ndarray, family: int) -> float:
        pairs = word_pairs(hashed)
        return max(float(np.isin(t, pairs).mean()) for t in self.templates[family])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def against_unknown(chances: np.ndarray) -> np.ndarray:
    """Chance of each family if it is that family or none; other notices nearby do not lower it."""
    return chances[:, 1:] / (chances[:, 1:] + chances[:, :1] + 1e-300)


def train_notices(paragraphs: Sequence[str], seed: int = 11) -> NoticeClassifier:
    """Fit the classifier; ``paragraphs`` of the corpus are taken as unknown unless a template is in them."""
    r = np.random.default_rng(seed)
    hasher = NoticeHasher(1)
    blank = NoticeClassifier(np.zeros((FEATURES, len(FAMILIES) + 1), np.float32), np.zeros(len(FAMILIES) + 1), 1.0, 0.5)
    unknown = [w for w in (p.encode().split()[:WINDOW] for p in paragraphs) if len(w) > 1]
    unknown = [w for w in unknown if max(blank.agreement(hasher.words(w), k) for k in range(len(FAMILIES))) < AGREEMENT]
    filler = [w for words in unknown[:200] for w in words] or b"it was a day like any other in town".split()
    samples: list[tuple[list[bytes], int]] = [(w, 0) for w in unknown]
    for k, family in enumerate(FAMILIES, 1):
        for template in TEMPLATES[family]:
            words = template.encode().split()
            for _ in range(VARIATIONS):
                kept = [w for w in words if r.random() > 0.06] or words
                around = [[filler[int(i)] for i in r.integers(0, len(filler), int(r.integers(0, 12)))] for _ in range(2)]
                samples.append((around[0] + kept + around[1], k))
                if len(words) >= SCRAMBLED:
                    mixed = [words[int(i)] for i in r.permutation(len(words))]
                    samples.append((mixed[: len(mixed) // 2] + around[0], 0))
    samples = [(w, k) for w, k in samples if len(w) > 1]
    parts = []
    for words, _ in samples:
        hashed = hasher.words(words)
        parts.append(_buckets(np.concatenate([hashed, word_pairs(hashed)])))
    labels = np.array([k for _, k in samples])
    held = r.random(len(samples)) < 0.25

    def rows(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        picked = [parts[int(i)] for i in np.flatnonzero(chosen)]
        counts = np.array([len(p) for p in picked])
        return np.concatenate(picked), counts, labels[chosen]

    def logits(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[at], np.cumsum(np.r_[0, counts[:-1]]), axis=0) / np.sqrt(counts)[:, None] + bias

    weights, bias = np.zeros((FEATURES, len(FAMILIES) + 1), np.float32), np.zeros(len(FAMILIES) + 1, np.float32)
    square, square_bias = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    at, counts, wanted = rows(~held)
    for _ in range(STEPS):
        d = softmax(logits(at, counts)).astype(np.float32)
        d[np.arange(len(d)), wanted] -= 1
        d /= len(d)
        grad = 1e-5 * weights
        np.add.at(grad, at, np.repeat(d / np.sqrt(counts)[:, None], counts, axis=0).astype(np.float32))
        square += grad * grad
        square_bias += d.sum(0) ** 2
        weights -= 0.3 * grad / np.sqrt(square)
        bias -= 0.3 * d.sum(0) / np.sqrt(square_bias)
    at, counts, wanted = rows(held)
    scores = logits(at, counts)
    losses = {t: -np.log(softmax(scores / t)[np.arange(len(wanted)), wanted] + 1e-9).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    temperature = min(losses, key=losses.__getitem__)
    wrong = against_unknown(softmax(scores / temperature)[wanted == 0]).max(axis=1, initial=0.0)
    least = float(np.quantile(wrong, 1 - FALSE_ACCEPTS)) if len(wrong) else 0.0
    return NoticeClassifier(weights, bias, temperature, min(0.9, max(0.5, least)))


def _candidates(hashed: np.ndarray, model: NoticeClassifier) -> list[tuple[int, int, int, float, float]]:
    """(first word, last word exclusive, family, agreement, density) wherever a template agrees.

    From every matched pair on, each span that ends with a pair of the template not yet in it and
    has enough of them is one.
    """
    pairs = word_pairs(hashed)
    slot = np.minimum(np.searchsorted(model.pairs, pairs), len(model.pairs) - 1)
    hits = np.flatnonzero(model.pairs[slot] == pairs)
    slot = slot[hits]
    found = []
    for family, n_words, has in model.matched:
        mine = has[slot]
        if mine.sum() < AGREEMENT * (n_words - 1):
            continue
        at, pair = hits[mine], slot[mine]
        least, reach = int(np.ceil(AGREEMENT * (n_words - 1) - 1e-9)), max(WINDOW, n_words * 3 // 2) - 1
        # Spans without room for enough pairs are passed over at once.
        for i in np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < reach).tolist():
            seen: set[int] = set()
            for j in range(i, len(at)):
                if at[j] - at[i] >= reach:
                    break
                if int(pair[j]) in seen:
                    continue
                seen.add(int(pair[j]))
                if len(seen) >= least:
                    n = int(at[j] - at[i]) + 2
                    found.append((int(at[i]), int(at[i]) + n, family, len(seen) / (n_words - 1), min(1.0, (len(seen) + 1) / n)))
    return found


def spdx_notices(data: bytes) -> list[tuple[int, int, int]]:
    """(first byte, last byte exclusive, family) of the identifiers after SPDX tags."""
    found = []
    if TAG not in data.lower():
        return found
    for tag in SPDX.finditer(data):
        before, first = b"AND", True
        for word in re.finditer(rb"[^\s()]+", tag[1]):
            name = word[0].strip(b".,;:!?[]{}\"'*#/|")
            if name.upper() in (b"AND", b"OR", b"WITH"):
                before = name.upper()
                continue
            if not before:
                break
            if before != b"WITH":
                at = tag.start(1) + word.start() + word[0].index(name)
                families = [k for k, f in enumerate(FAMILIES) if re.fullmatch(IDENTIFIERS[f].encode(), name, re.I)]
                found += [(tag.start() if first else at, at + len(name), k) for k in families]
                first = False
            before = b""
    return found


def text_notices(text: str, model: NoticeClassifier, hasher: NoticeHasher) -> list[tuple[int, int, int, Notice]]:
    """(line, first byte, last byte exclusive, notice) of every notice; its line is where it starts."""
    data = text.encode()
    found = [(a, b, Notice(k, 1.0, 1.0)) for a, b, k in spdx_notices(data)]
    hashed = hasher.words(data.split())
    spoken = np.flatnonzero(hashed != MARKS)
    hashed = hashed[spoken]
    candidates = _candidates(hashed, model) if len(hashed) > 1 else []
    if candidates:
        first, last = (edge[spoken] for edge in word_places(data))
        start, end, family = (np.array(c, np.int64) for c in list(zip(*candidates))[:3])
        chances = model.chances(hashed, start, end)
        rows = np.arange(len(family))
        chance = chances[rows, family + 1]
        worth = chance * np.array([agreed * dense for *_, agreed, dense in candidates])
        taken = np.zeros(len(hashed), bool)
        allowed = against_unknown(chances)[rows, family] >= model.least
        for i in np.lexsort((start, -worth)).tolist():
            a, b = int(start[i]), int(end[i])
            if allowed[i] and not taken[a:b].any():
                taken[a:b] = True
                found.append((int(first[a]), int(last[b - 1]), Notice(int(family[i]), float(chance[i]), candidates[i][3])))
    if not found:
        return []
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    return [(int(np.searchsorted(ends, a)), a, b, notice) for a, b, notice in sorted(found)]


def scan_licenses(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, line, at, upto (bytes), family, probability, agreement of every notice."""
    docs = only(docs, doc_id="bigint", text="string")
    # One line of each sampled document, cut to one window: the driver gets a bounded number of words.
    one = F.substring(F.element_at(F.split("text", "\n"), F.lit(-1)), 1, 600)
    model = train_notices(sampled(docs.where("text is not null"), "doc_id", one, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = NoticeHasher(1)
        for batch in slices(batches):
            rows = [
                (doc_id, line, a, b, FAMILIES[n.family], round(n.probability, 4), round(n.agreement, 4))
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                for line, a, b, n in text_notices(text or "", model, hasher)
            ]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.float64(), pa.float64()]
            columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["doc_id", "line", "at", "upto", "family", "probability", "agreement"]
    return docs.mapInArrow(run, "doc_id bigint, line bigint, at bigint, upto bigint, family string, probability double, agreement double")


def op8_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
