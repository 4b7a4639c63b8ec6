"""License scan: a trained paragraph classifier whose finds a template must confirm.

Lines are cut into words, and so are paragraphs of several lines; unigrams, bigrams and trigrams that occur in the
templates are the features of a multinomial logistic regression over licence families and
an unknown class, calibrated by a temperature. A found family counts only if one of its
templates is largely there, in the templates' own word pairs. A wrapped notice is found in
its paragraph (consecutive lines with words) as a span of about a template's length.
"""

from __future__ import annotations

import dataclasses
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words

UNKNOWN = "unknown"
#: Least chance of a family, and least share of a template's word pairs in the paragraph.
CHANCE, CONFIRMED = 0.5, 0.6
#: At most about so many paragraphs of the corpus serve as examples of the unknown class.
NEGATIVES = 2000
#: Such an example serves with so many characters at most; texts that are scanned are whole.
NEGATIVE_CHARS = 2000
#: Licence notices by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is distributed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GPLv3.", "Licensed under the GPL version 2 or later.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under the Creative Commons Attribution License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.",
    ],
    "public-domain": [
        "This work has been dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: Unlicense",
    ],
    "ISC": [
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without permission.",
        "This document is confidential and proprietary. Unauthorized copying is prohibited.", "Copyright, all rights reserved.",
    ],
}
#: Sentences about licences that name none, for the unknown class.
VAGUE = [
    "You need a license to drive a car in this country.", "The license of the restaurant was renewed in the year of the flood.",
    "The terms of the work were modified by the public.", "Permission to use the hall is granted by the mayor.",
    "This work is the version of the general that is under the bridge.", "See the file for the terms and conditions of use.",
    "Licensed under the terms of our agreement.", "The source of the river is free to the public.", "Released under the moon in the form of a copy.",
    "The public library is open to any person.", "Copyright law is taught in the second year.", "This software is subject to change without notice.",
]
_PUNCTUATION = words.LOWER.copy()
_PUNCTUATION[[ord(c) for c in ".,;:()\"'[]/<>*_`#!?"]] = 32
_TEXT_TABLE = {i: int(_PUNCTUATION[i]) for i in range(128)}
#: Signs that begin the lines of a comment, besides the punctuation.
MARKS = " \t\r\x0b\x0c-+=|%~@&^$\\{}"
_BYTE_TABLE = bytes(_PUNCTUATION.tolist())


def tokens(text: str) -> list[str]:
    return text.translate(_TEXT_TABLE).split()


def _grams(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1)}


def _pairs(ws: list[str]) -> set[str]:
    return {" ".join(p) for p in zip(ws, ws[1:])}


def _pair_hashes(pairs: list[str]) -> np.ndarray:
    h, _ = words.word_hashes([p.encode() for p in pairs], True)
    return words.mix(words.mix(h[0::2]) + h[1::2])


def _best_spans(hits: list[tuple[int, str]], reach: float, enough: float) -> list[tuple[int, int, int]]:
    """(different pairs, first hit, last hit) of spans of ``hits`` (word number, pair), at most
    ``reach`` words apart: the one with most pairs (ties: fewest words, then the later one),
    then the best of what is left beside it, while they have ``enough`` pairs.

    One pass keeps the span that ends at each hit; a pick shortens only the spans that end
    within reach behind it, and only these are made anew.
    """
    begin, heap, picked, taken = [-1] * len(hits), [], [], bytearray(len(hits))

    def extend(low: int) -> None:
        count: dict[str, int] = {}
        a = low
        for b in range(low, len(hits)):
            if taken[b]:
                return
            count[hits[b][1]] = count.get(hits[b][1], 0) + 1
            # repeated pairs at the front and words beyond the length are let go
            while hits[b][0] - hits[a][0] > reach or count[hits[a][1]] > 1:
                count[hits[a][1]] -= 1
                if not count[hits[a][1]]:
                    del count[hits[a][1]]
                a += 1
            if begin[b] == a:
                return  # from here on the spans are as before
            begin[b] = a
            if len(count) >= enough:
                heapq.heappush(heap, (-len(count), hits[b][0] - hits[a][0], -a, -b))

    if hits:
        extend(0)
    while heap:
        n, _, a, b = heapq.heappop(heap)
        a, b = -a, -b
        if taken[b] or begin[b] != a:
            continue
        picked.append((-n, a, b))
        taken[a : b + 1] = b"\1" * (b + 1 - a)
        extend(b + 1)
    return picked


@dataclasses.dataclass
class Scanner:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    temperature: float
    templates: list[tuple[str, set[str]]]

    def scores(self, ws: list[str]) -> np.ndarray:
        at = [self.vocabulary[g] for g in _grams(ws) if g in self.vocabulary]
        z = self.weights[at].sum(0) / np.sqrt(max(1, len(at))) + self.weights[-1]
        z = (z - z.max()) / self.temperature
        return np.exp(z) / np.exp(z).sum()

    def find(self, text: str) -> tuple[str, float, float] | None:
        """(family, chance, share of its best template) if a licence is confirmed, else None."""
        ws = tokens(text)
        p = self.scores(ws)
        best = int(p.argmax())
        if self.families[best] == UNKNOWN or p[best] < CHANCE:
            return None
        there = _pairs(ws)
        share = max(len(t & there) / len(t) for f, t in self.templates if f == self.families[best])
        return (self.families[best], float(p[best]), share) if share >= CONFIRMED else None

    def wrapped(self, lines: list[str]) -> list[tuple[int, int, tuple[str, float, float]]]:
        """(first line, last line, find) of notices that go over lines of one paragraph.

        For each template the span of about its length that has most of its word pairs,
        again and again in what is left beside it, in time in proportion to the paragraph
        (times the logarithm of the number of finds).
        """
        ws, at = [], []
        for k, line in enumerate(lines):
            own = line.translate(_TEXT_TABLE).lstrip(MARKS).split()
            ws += own
            at += [k] * len(own)
        where: dict[str, list[int]] = {}
        for i, p in enumerate(zip(ws, ws[1:])):
            where.setdefault(" ".join(p), []).append(i)
        found = []
        for family, pairs in self.templates:
            hits = sorted((i, p) for p in pairs for i in where.get(p, ()))
            for n, a, b in _best_spans(hits, 1.25 * len(pairs) + 2, CONFIRMED * len(pairs)):
                first, last = hits[a][0], hits[b][0] + 1
                if at[first] == at[last]:
                    continue
                p = self.scores(ws[first : last + 1])
                likely = int(p.argmax())
                if self.families[likely] == family and p[likely] >= CHANCE:
                    found.append((at[first], at[last], (family, float(p[likely]), n / len(pairs))))
        return found

    def pair_hashes(self) -> np.ndarray:
        pairs = sorted({p for _, t in self.templates for p in t})
        return np.sort(_pair_hashes(pairs))

    def template_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``pair_hashes`` each template has, and how many of them confirm it."""
        order = self.pair_hashes()
        return np.stack([np.isin(order, _pair_hashes(sorted(t))) for _, t in self.templates]), CONFIRMED * np.array([len(t) for _, t in self.templates])


def _places(rows: list[list[str]], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(example, feature, value) of all features of the examples' words."""
    at = [[vocabulary[g] for g in _grams(ws) if g in vocabulary] for ws in rows]
    size = np.array([len(r) for r in at])
    owner = np.repeat(np.arange(len(at)), size)
    return owner, np.concatenate([np.array(r, np.int64) for r in at]), 1 / np.sqrt(np.maximum(1, size))[owner]


def _logits(places: tuple, rows: int, w: np.ndarray) -> np.ndarray:
    owner, place, value = places
    return np.column_stack([np.bincount(owner, weights=value * w[place, c], minlength=rows) + w[-1, c] for c in range(w.shape[1])])


def _fit(rows: list[list[str]], want: np.ndarray, vocabulary: dict[str, int], k: int, rounds: int, l2: float) -> np.ndarray:
    """Weights of a multinomial logistic regression with equal weight per class; the last row is the bias."""
    owner, place, value = places = _places(rows, vocabulary)
    weight = 1 / np.bincount(want, minlength=k)[want]
    w = np.zeros((len(vocabulary) + 1, k))
    square = np.full_like(w, 1e-8)
    for _ in range(rounds):
        p = _logits(places, len(rows), w)
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), want] -= 1
        p *= weight[:, None] / k
        g = np.vstack([
            np.column_stack([np.bincount(place, weights=value * p[owner, c], minlength=len(vocabulary)) for c in range(k)]),
            p.sum(0),
        ]) + l2 / k * w
        square += g * g
        w -= 0.5 * g / np.sqrt(square)
    return w


def train(negatives: list[str], seed: int = 5, rounds: int = 300, l2: float = 1e-3) -> Scanner:
    """Fit on the templates, on damaged and embedded variants, and on unknown paragraphs.

    The temperature comes from a fit without every fourth notice of a family and every fourth
    unknown paragraph, by their loss: no variant of a held-out notice is learnt there. The
    weights come from a second fit, on everything.
    """
    rng = np.random.default_rng(seed)
    plain = [tokens(t) for t in negatives] or [tokens(t) for t in VAGUE]
    families = sorted(TEMPLATES) + [UNKNOWN]
    rows, want, held = [], [], []

    def add(family: str, ws: list[str], number: int) -> None:
        rows.append(ws)
        want.append(families.index(family))
        held.append(number % 4 == 1)

    for n, t in enumerate([*negatives, *VAGUE]):
        for _ in range(1 if n < len(negatives) else 3):
            add(UNKNOWN, tokens(t), n)
    for family, notices in TEMPLATES.items():
        for n, t in enumerate(notices):
            ws = tokens(t)
            for v in range(12):
                keep = [w for w in ws if rng.random() > 0.1 * (v % 3)] or ws
                around = plain[int(rng.integers(len(plain)))][: int(rng.integers(0, 12))] if v % 2 else []
                add(family, around + keep if v % 4 < 2 else keep + around, n)
    wanted, out, k = np.array(want), np.array(held), len(families)

    def fitted(which: np.ndarray, notices: list[str]) -> tuple[dict[str, int], np.ndarray]:
        vocabulary = {g: i for i, g in enumerate(sorted(set().union(*(_grams(tokens(t)) for t in notices))))}
        return vocabulary, _fit([rows[i] for i in which], wanted[which], vocabulary, k, rounds, l2)

    vocabulary, w = fitted(np.flatnonzero(~out), [t for ts in TEMPLATES.values() for n, t in enumerate(ts) if n % 4 != 1])
    test = [rows[i] for i in np.flatnonzero(out)]
    z = _logits(_places(test, vocabulary), len(test), w)

    def loss(t: float) -> float:
        s = (z - z.max(1, keepdims=True)) / t
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(test)), wanted[out]]).mean())

    grid = np.exp(np.linspace(np.log(0.1), np.log(5), 40))
    vocabulary, w = fitted(np.arange(len(rows)), [t for ts in TEMPLATES.values() for t in ts])
    templates = [(f, _pairs(tokens(t))) for f, ts in TEMPLATES.items() for t in ts]
    return Scanner(families, vocabulary, w, float(grid[np.argmin([loss(t) for t in grid])]), templates)


def _apart(finds: list[tuple[int, int, tuple]]) -> list[tuple[int, int, tuple]]:
    """Finds (first line, last line, find) that share no line with a better one of their
    paragraph; the share of the template decides, then fewer lines."""
    taken: list[tuple[int, int, tuple]] = []
    lines: dict[str | None, set[int]] = defaultdict(set)  # taken ones by family; None: by wrapped notices
    for f in sorted(finds, key=lambda f: (-f[2][2], f[1] - f[0], f[0], f[2][0])):
        own = range(f[0], f[1] + 1)
        if lines[f[2][0]].isdisjoint(own) and lines[None].isdisjoint(own):
            taken.append(f)
            lines[f[2][0]].update(own)
            if f[0] < f[1]:
                lines[None].update(own)
    return sorted(taken, key=lambda f: f[:2])


_ARROW_SPANS = pa.list_(pa.struct([
    ("paragraph", pa.int32()), ("family", pa.string()), ("chance", pa.float64()), ("template_share", pa.float64()), ("text", pa.string()),
]))
SPANS = "array<struct<paragraph:int,family:string,chance:double,template_share:double,text:string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", negatives: int = NEGATIVES) -> DataFrame:
    """(id_col, n_paragraphs, families, spans) per row.

    ``spans`` has every confirmed licence notice (number of its first line from 0, family,
    chance, share of the template, its lines), be it within a line or wrapped over lines of
    one paragraph; ``n_paragraphs`` counts the lines that are not blank; ``families`` has the
    distinct families in order. Null, empty and blank texts have no paragraph and no licence. Examples of the
    unknown class are paragraphs without template wording, drawn by a hash of the text;
    on an empty table only the built-in ones serve. Repeated rows repeat; other columns
    are not read. A paragraph may hold any number of notices.
    """
    texts = docs.where(F.col(text_col).isNotNull())
    n = texts.count()
    drawn = texts.where(F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < int(min(1.0, negatives / max(1, n)) * (1 << 20)))
    line = F.get(F.filter(F.split(text_col, "\n"), lambda x: F.length(x) > 0), F.lit(0))
    wording = re.compile(r"licen[cs]e|copyright|permission|redistribut|gpl|apache|mozilla|creative commons|cc by|public domain|spdx|rights reserved", re.I)
    some = [r[0] for r in drawn.where(line.isNotNull()).select(F.substring(line, 1, NEGATIVE_CHARS)).distinct().collect()]
    scanner = train(sorted(t for t in some if not wording.search(t)))
    pairs = scanner.pair_hashes()
    in_template, enough = scanner.template_pairs()

    def hits(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """Numbers of the texts with pairs of templates, and which ones."""
        for a, b in words.blocks(texts):
            h, who = words.word_hashes(texts[a:b], True)
            pair = words.mix(words.mix(h[:-1]) + h[1:])
            at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            hit = (pairs[at] == pair) & (who[:-1] == who[1:])
            both = np.unique(who[:-1][hit].astype(np.int64) * len(pairs) + at[hit])
            texts_hit, first = np.unique(both // len(pairs), return_index=True)
            for k, own in zip(texts_hit.tolist(), np.split(both % len(pairs), first[1:])):
                yield a + k, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, owner, counts = [], [], []
            for i, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                own = (t or b"").split(b"\n")
                counts.append(sum(1 for x in own if x.strip()))
                lines += own
                owner += [(i, k) for k in range(len(own))]
            found: list[list] = [[] for _ in counts]
            clean = [x.translate(_BYTE_TABLE) for x in lines]
            # paragraphs: lines of one text up to one without a word
            start = [k for k, x in enumerate(clean) if x.strip() and (not k or owner[k - 1][0] != owner[k][0] or not clean[k - 1].strip())]
            paragraphs, whole = [], []
            for k in start:
                end = k + 1
                while end < len(lines) and owner[end][0] == owner[k][0] and clean[end].strip():
                    end += 1
                paragraphs.append((k, end))
                whole.append(b" ".join(x.lstrip(MARKS.encode()) for x in clean[k:end]))
            of_line = np.zeros(len(lines), np.int64)
            finds: dict[int, list] = {}
            for n, (first, end) in enumerate(paragraphs):
                of_line[first:end] = n
            for k, _ in hits(clean):
                got = scanner.find(lines[k].decode("utf-8", "replace"))
                if got:
                    n = int(of_line[k])
                    finds.setdefault(n, []).append((k - paragraphs[n][0], k - paragraphs[n][0], got))
            for n, own in hits(whole):
                first, end = paragraphs[n]
                if end - first > 1 and (in_template[:, own].sum(1) >= enough).any():
                    finds.setdefault(n, []).extend(scanner.wrapped([x.decode("utf-8", "replace") for x in lines[first:end]]))
            for n in sorted(finds):
                for low, high, got in _apart(finds[n]):
                    i, place = owner[paragraphs[n][0] + low]
                    own = lines[paragraphs[n][0] + low : paragraphs[n][0] + high + 1]
                    found[i].append({"paragraph": place, "family": got[0], "chance": got[1], "template_share": got[2], "text": b"\n".join(own).decode("utf-8", "replace")})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array([sorted({s["family"] for s in f}) for f in found], pa.list_(pa.string())),
                 pa.array(found, _ARROW_SPANS)],
                ["id", "n_paragraphs", "families", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_paragraphs long, families array<string>, spans {SPANS}")
    return out.withColumnRenamed("id", id_col)
