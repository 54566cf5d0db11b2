"""License scans: winnowed fingerprints of license templates, then banded alignment.

Template words are hashed in runs of GRAM; of every WINDOW neighbouring hashes the smallest is kept
(winnowing), for templates and documents alike, so a run of GRAM + WINDOW - 1 equal words always shares a
fingerprint. A template shorter than that is looked up by all its runs of GRAM words (or by all its words, if
they are fewer), and of documents all runs are compared with those. The templates' fingerprints form an inverted index: a list of bounded size that is given to
the operator and travels with its function. Where a document's fingerprint is found there, the template is
aligned with the words around that place inside a band of diagonals, and matches that cover enough of the
template are reported with their spans.

Defined results for odd input: a null text is an empty one and matches nothing; a null doc_id is carried as
it is; a very long text is scanned whole; repeated rows are separate documents; of several templates
that match the same words only those that no match contains and outweighs are reported; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .license_texts import TEXTS
from .shingles import _BASE, _BYTES, _DOWN, _UP, mix

GRAM, WINDOW = 3, 3
COVERAGE = 0.8
BLOCK = 4_000_000

#: A template of up to this many words must agree with the text in its telling words: numbers, and what tells licenses of one family apart.
TELLING_WORDS = 80
TELLING = frozenset(b"nc nd sa noncommercial noderivatives noderivs sharealike lesser library affero".split())


def _creative_commons() -> dict[str, str]:
    """The short statement and the sentence of every license of the family."""
    long = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    out = {}
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        for version, scope in (("3.0", "Unported"), ("4.0", "International")):
            out[f"CC-{kind}-{version}"] = f"Licensed under CC {kind} {version}"
            name = "-".join(long[x] for x in kind.split("-"))
            out[f"CC-{kind}-{version}-statement"] = f"This work is licensed under a Creative Commons {name} {version} {scope} License"
    return out


# Statements by which texts name their license, and short license texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "GPL-2.0-name": "GNU General Public License version 2",
    "GPL-3.0-name": "GNU General Public License version 3",
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    **_creative_commons(),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-rights-reserved-statement": "All rights reserved",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced without permission",
    **TEXTS,
}


def templates_of(folder: str) -> dict[str, str]:
    """Every text of a folder on the driver as a template by its file's name, for license lists that are at hand."""
    out = {}
    for x in sorted(os.listdir(folder)):
        path = os.path.join(folder, x)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out[x] = f.read()
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = True
_WORD[128:] = True
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def tokens(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    spans = [m.span() for m in _TOKEN.finditer(text)]
    low = text.lower()
    return [low[a:b] for a, b in spans], spans


def hashed_words(texts: list[bytes]):
    """Text number and hash of every word, and the texts' word counts."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    solid = np.concatenate([[False], _WORD[data], [False]])
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    a, b = turns[0::2], turns[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[_LOWER[data]] * _UP.upto(len(data)), dtype=np.uint64)])
    words = mix((total[b] - total[a]) * _DOWN.upto(len(data))[a] + (b - a).astype(np.uint64))
    doc = np.searchsorted(ends, a, side="right")
    return doc, words, np.bincount(doc, minlength=len(texts))


def _grams(doc, words, size: int):
    """Hash of every run of size words, and whether it stays inside one text."""
    if len(words) < size:
        return np.empty(0, np.uint64), np.empty(0, bool)
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h = h * np.uint64(_BASE) + words[k : len(h) + k] + np.uint64(k + 1)
    return mix(h), doc[size - 1 :] == doc[: len(h)]


def runs(doc, words, n, size: int):
    """All runs of size words: text number, word number and hash."""
    h, inside = _grams(doc, words, size)
    got = np.flatnonzero(inside)
    return doc[got], got - (np.cumsum(n) - n)[doc[got]], h[got]


def winnowed(doc, words, n):
    """Winnowed runs of GRAM words: text number, word number and hash."""
    h, inside = _grams(doc, words, GRAM)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64), h
    gdoc = doc[: len(h)]
    # a gram that runs into the next text takes no part; a window ends with its text
    key = np.where(inside, h, np.uint64(2**64 - 1))
    keep = np.zeros(len(h), bool)
    place = np.arange(len(h))
    best, at = key.copy(), place.copy()
    for k in range(1, WINDOW):
        shift = np.full(len(h), 2**64 - 1, np.uint64)
        shift[:-k] = np.where(gdoc[k:] == gdoc[:-k], key[k:], np.uint64(2**64 - 1))
        less = shift <= best  # the rightmost of equal hashes
        best, at = np.where(less, shift, best), np.where(less, np.minimum(place + k, len(h) - 1), at)
    keep[at[inside]] = True
    keep &= inside
    first = np.cumsum(n) - n
    got = np.flatnonzero(keep)
    return gdoc[got], got - first[gdoc[got]], h[got]


def fingerprints(texts: list[bytes]):
    """Winnowed fingerprints: text number, word number, hash, and the texts' word counts."""
    doc, words, n = hashed_words(texts)
    return *winnowed(doc, words, n), n


class TemplateIndex:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [tokens(templates[n].encode())[0] for n in self.names]
        if not all(self.words):
            raise ValueError("a template needs a word at least")
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for ws in self.words for w in ws))}
        self.numbers = [np.array([self.number[w] for w in ws], np.int64) for ws in self.words]
        # telling words of the short ones
        self.telling = [Counter(w for w in ws if w in TELLING or w.isdigit()) if len(ws) <= TELLING_WORDS else None for ws in self.words]
        self.posts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.keys = self._post([d for d, w in enumerate(self.words) if len(w) >= GRAM + WINDOW - 1], winnowed)
        # keys of the short templates by the length of their runs
        self.short: dict[int, np.ndarray] = {}
        for size in range(1, GRAM + 1):
            few = [d for d, w in enumerate(self.words) if len(w) < GRAM + WINDOW - 1 and min(len(w), GRAM) == size]
            if few:
                self.short[size] = self._post(few, lambda *x, size=size: runs(*x, size))

    def _post(self, which: list[int], prints) -> np.ndarray:
        doc, at, h = prints(*hashed_words([b" ".join(self.words[d]) for d in which]))
        for d, p, x in zip(doc.tolist(), at.tolist(), h.tolist(), strict=True):
            self.posts[x].append((which[d], p))
        return np.array(sorted(set(h.tolist())), np.uint64)

    def agrees(self, name: int, words: list[bytes]) -> bool:
        """Whether a text's words have the telling words of the template: another version or another license of a family is no match.
        Numbers count where the template has some; a copy may number its clauses."""
        want = self.telling[name]
        if want is None:
            return True
        numbers = any(w.isdigit() for w in want)
        return Counter(w for w in words if w in TELLING or (numbers and w.isdigit())) == want

    def found(self, texts: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """By text number, (word number, fingerprint) of what is in the index."""
        doc, words, n = hashed_words(texts)
        places = defaultdict(list)
        for keys, prints in [(self.keys, winnowed(doc, words, n)), *[(keys, runs(doc, words, n, size)) for size, keys in self.short.items()]]:
            if not len(keys):
                continue
            own, at, h = prints
            hit = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
            for d, p, x in zip(own[hit].tolist(), at[hit].tolist(), h[hit].tolist(), strict=True):
                places[d].append((p, x))
        return places


#: Places of an alignment are packed in words of 64 bits: equal words, then the first one, then the last one.
_BITS = 21
_FIELD = (1 << _BITS) - 1


def align(template: np.ndarray, words: np.ndarray, band: int):
    """Longest common subsequence of a template and words (as numbers) inside a band around the main diagonal.

    Returns (equal words, first and last of them in words); words[i + d] may meet template[i] for
    0 <= d <= 2 * band. Of equally long ones, one that begins late and ends early.
    """
    width, n = 2 * band + 1, len(template)
    size = n + width
    if size > _FIELD:
        raise ValueError("a template of more than two million words")
    near = np.full(size, -1, np.int64)
    near[: min(len(words), size)] = words[:size]
    order = np.argsort(near, kind="stable")
    by = near[order]
    # best[j + 1]: the best alignment of the template so far with words up to j; it rises inside the band
    best, edge = np.zeros(size + 1, np.int64), 0
    low, high = np.searchsorted(by, template), np.searchsorted(by, template, side="right")
    for i in np.flatnonzero(high > low).tolist():
        at = order[low[i] : high[i]]
        at = at[(at >= i) & (at < i + width)]
        if not len(at):
            continue
        best[edge + 1 : i + width + 1] = best[edge]
        edge = i + width
        held = best[at]
        longer = np.where(held == 0, (1 << 2 * _BITS) | (at << _BITS), (held & ~_FIELD) + (1 << 2 * _BITS)) + (_FIELD - at)
        best[at + 1] = np.maximum(best[at + 1], longer)
        part = best[at[0] + 1 : edge + 1]
        np.maximum.accumulate(part, out=part)  # skip words of the text
    top = int(best[edge])
    return (top >> 2 * _BITS, (top >> _BITS) & _FIELD, _FIELD - (top & _FIELD)) if top else (0, -1, -1)


def scan(text: bytes, index: TemplateIndex, places: list[tuple[int, int]], coverage: float):
    """Matches of one text: (template, coverage, equal words, template words, first byte, end byte).

    places: (word number, fingerprint) of fingerprints found in the index.
    """
    words, spans = tokens(text)
    numbers = np.fromiter((index.number.get(w, -1) for w in words), np.int64, len(words))
    starts: dict[int, set[int]] = defaultdict(set)
    for at, h in places:
        for name, p in index.posts[h]:
            starts[name].add(at - p)
    found = []
    for name, begins in starts.items():
        want = index.numbers[name]
        band = min(2 + len(want) // 8, len(want) - 1)
        done = -(10**9)
        for s in sorted(begins):
            if s - done <= band:  # the last alignment's band has it
                continue
            done = s
            lo = s - band
            near = numbers[max(0, lo) : s + len(want) + band]
            n, a, b = align(want, np.concatenate([np.full(max(0, -lo), -1, np.int64), near]), band)
            if n >= coverage * len(want) and index.agrees(name, words[lo + a : lo + b + 1]):
                found.append((name, n, len(want), lo + a, lo + b))
    best = []
    for m in sorted(found, key=lambda m: (-m[1], m[2], m[3], m[0])):  # of equally many words, the most covered template
        if not any(b[3] <= m[3] and m[4] <= b[4] for b in best):
            best.append(m)
    return [(index.names[k], n / of, n, of, spans[a][0], spans[b][1]) for k, n, of, a, b in sorted(best, key=lambda m: (m[3], m[0]))]


def _scanner(templates: dict[str, str], coverage: float):
    def run(batches):
        index = TemplateIndex(templates)
        for batch in batches:
            ids, texts = batch.column(0), [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= BLOCK):
                    size += len(texts[b])
                    b += 1
                for d, own in sorted(index.found(texts[a:b]).items()):
                    text = texts[a + d]
                    for name, share, n, of, i, j in scan(text, index, own, coverage):
                        start = len(text[:i].decode("utf-8", "replace"))
                        rows.append((a + d, name, share, n, of, start, start + len(text[i:j].decode("utf-8", "replace"))))
                a = b
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.float64(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True)]],
                names=["doc_id", "license", "coverage", "matched_words", "template_words", "start", "end"],
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per match; start and end are code points of the text."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, license string, coverage double, matched_words long, template_words long, start long, end long"
    return slim.mapInArrow(_scanner(dict(templates), coverage), kinds)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


ORACLE_SQL = None
