"""Licence scans: a trained paragraph classifier whose predictions templates confirm.

Paragraphs end at blank lines and at line feeds after a sentence. Words of letters or
digits (each digit read as 0) are looked at in windows of up to ``WINDOW`` words with half
overlap, so that a notice inside a long paragraph is not diluted. Multinomial logistic
regression over the window's words and word pairs gives each licence family and the class
``unknown`` a probability; a temperature and the bound for leaving ``unknown`` are fitted on
texts kept apart. A predicted family is confirmed if the window holds most of the word
pairs of one of its templates; then its words are set aside and the rest of the window is
classified again, so that each licence of a window is found.

There is no table of labelled paragraphs: positive examples are public notices, worn and set
into other text; unknown ones are decoys, shuffled notices and windows of the corpus itself,
a bounded sample drawn by a hash (``background``) without those that hold a notice.

Defined results: a null or empty text has no findings; a paragraph has at most one finding
per family, from its best window; whole texts are scanned whatever their length; repeated
rows give repeated findings; other columns pass through, clashing ones are replaced; an
empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import broadcast, mapped

UNKNOWN = "unknown"
WINDOW = 48
_MODEL_LIMIT = 64 << 20
_GAP = 3  # places between pairs of one stretch
_SENTENCE_END = (".", "!", "?", ":", ";")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

# Public notices of each family, sentence by sentence; the first are those by
# which a work is put under the licence. Sentences that several families share are left out.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "Zlib": [
        "Released under the zlib License.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}

# Sentences with the words of licences that state none.
DECOYS = [
    "The driver showed a license to the officer of the general public.",
    "The film was released under a new name and the version was free of charge.",
    "A public notice is subject to the terms of the treaty.",
    "Permission was granted to any person with a copy of the letter.",
    "The software was modified without restriction in use or form.",
    "The Apache are a people of the plains; the foundation published a work on their source.",
    "Creative work in the commons needs attribution and an international public.",
    "The conditions are met and the following forms are provided.",
    "This library is open to the public; this program is on at eight.",
    "Version 2 of the file is in compliance with the rules.",
    "See the license file for terms.", "The by-law of 1984 on public domain was universal.",
]
_FILLER = "the of and to in is was that this with for on are by it as at from or be le la les des un en que der die und zu den el los que por una inor than erha tion ouen ment keit ung".split()


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans of the paragraphs in code points."""
    out, begin, at = [], None, 0
    for line in text.split("\n"):
        bare = line.rstrip()
        if bare and begin is None:
            begin = at
        end = at + len(line)
        if begin is not None:
            if not bare:
                out.append((begin, max(begin, at - 1)))
                begin = None
            elif bare.endswith(_SENTENCE_END):
                out.append((begin, end))
                begin = None
        at = end + 1
    if begin is not None:
        out.append((begin, len(text)))
    return out


@dataclass
class Model:
    families: list[str]  # the last is UNKNOWN
    words: dict[bytes, int]  # from 1 on; 0 is any other word
    pair_codes: np.ndarray
    word_weights: np.ndarray  # the first row is zero
    pair_weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bound: float  # of the probability of all families together
    templates: list[tuple[int, str, np.ndarray]]  # family, text, codes of its word pairs
    least_similar: float


class Around:
    """Text to set notices into: stretches of sampled windows, or invented words without any."""

    def __init__(self, rng: random.Random, windows: list[list[bytes]]):
        self.rng, self.windows = rng, windows

    def __call__(self, n: int) -> list[bytes]:
        rng = self.rng
        if self.windows and rng.random() < 0.7:
            w = rng.choice(self.windows)
            at = rng.randint(0, max(0, len(w) - n))
            return w[at : at + n]
        return words_of(" ".join(rng.choice(_FILLER) if rng.random() < 0.7 else "".join(rng.choice("aeinorsthdl") for _ in range(rng.randint(2, 9))) for _ in range(n)))


def _examples(rng: random.Random, families: list[str], each: int, windows: list[list[bytes]] = []) -> tuple[list[list[bytes]], np.ndarray]:
    """Notices with words dropped, versions changed and other text around; decoys, other text and shuffled notices."""
    rows, labels, around = [], [], Around(rng, windows)
    vocabulary = [w for t in TEMPLATES.values() for x in t for w in words_of(x)]
    for label, family in enumerate(families[:-1]):
        for i in range(each):
            source = TEMPLATES[family][i % len(TEMPLATES[family])]
            source = re.sub(r"\d", lambda m: str(rng.randint(1, 4)), source)
            kept = [w for w in words_of(source) if rng.random() > (0.08 if i % 3 else 0)]
            rows.append((around(rng.choice([0, 0, 3, 12])) + kept + around(rng.choice([0, 0, 3, 12])))[:WINDOW])
            labels.append(label)
    for i in range(6 * each):
        kind = i % 3
        if kind == 0:
            part = words_of(rng.choice(DECOYS))
            row = around(rng.randint(0, 15)) + [w for w in part if rng.random() > 0.1]
        elif kind == 1:
            row = around(rng.randint(1, WINDOW))
        else:
            row = [rng.choice(vocabulary) for _ in range(rng.randint(1, 10))] + around(rng.randint(0, 20))
            rng.shuffle(row)
        rows.append(row[:WINDOW])
        labels.append(len(families) - 1)
    unknown = [w[:WINDOW] for w in windows if w]
    return rows + unknown, np.r_[np.asarray(labels), np.full(len(unknown), len(families) - 1)].astype(int)


def background(docs: DataFrame, rows: int = 1500, text: str = "text") -> list[list[bytes]]:
    """Words of one window from each of about ``rows`` texts, drawn by a hash of the text from the whole table.

    Windows that hold a third of a template's word pairs are left out, as they may be notices.
    """
    with_text = docs.where(F.length(text) > 0).select(F.col(text).alias("text"))
    n = with_text.count()
    if not n:
        return []
    hashed = with_text.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(1 << 20)) < int(min(1.0, rows / n) * (1 << 20)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                out = []
                for t, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist()):
                    w = words_of(t)
                    first = (h >> 20) % max(1, len(w) - WINDOW + 1)
                    out.append(b" ".join(w[first : first + WINDOW]))
                yield pa.RecordBatch.from_pydict({"h": batch.column("h"), "w": pa.array(out, pa.binary())})

    found = mapped(hashed, windows, "h long, w binary").orderBy("h", "w").limit(2 * rows).collect()
    held = [{(a, b) for a, b in zip(w, w[1:])} for v in TEMPLATES.values() for x in v for w in [words_of(x)]]

    def notice(w: list[bytes]) -> bool:
        mine = set(zip(w, w[1:]))
        return any(3 * len(mine & t) >= len(t) for t in held)

    return [w for w in (bytes(r["w"]).split() for r in found) if not notice(w)]


def _pairs(ids: np.ndarray, base: int) -> np.ndarray:
    """Code of each word with its follower; 0 where either is not in the vocabulary."""
    a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    return np.where((a > 0) & (b > 0), a * base + b, 0)


def _counted(ids: np.ndarray) -> np.ndarray:
    """Places of known words; of a word repeated at once only the first counts."""
    return np.flatnonzero((ids > 0) & (ids != np.r_[0, ids[:-1]]))


def _dense(rows: list[list[bytes]], words: dict[bytes, int], pair_codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(words) + 1 + len(pair_codes)), np.float32)
    for i, row in enumerate(rows):
        ids = np.asarray([words.get(w, 0) for w in row], np.int64)
        for w in ids[_counted(ids)]:
            out[i, w] += 1
        codes = _pairs(ids, len(words) + 1)
        at = np.searchsorted(pair_codes, codes)
        at[at == len(pair_codes)] = 0
        for k in at[pair_codes[at] == codes]:
            out[i, len(words) + 1 + k] += 1
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(windows: list[list[bytes]] = [], seed: int = 0, each: int = 120, steps: int = 150, least_similar: float = 0.6, false_share: float = 0.002, common_words: int = 400) -> Model:
    """Fit weights by gradient descent with momentum, then temperature and bound on kept-apart examples.

    ``windows`` is the background; each third of them is kept apart.
    """
    families = [*TEMPLATES, UNKNOWN]
    rng = random.Random(seed)
    rows, y = _examples(rng, families, each, [w for i, w in enumerate(windows) if i % 3])
    # Words of licences and decoys, the most common ones of the background, and the pairs of notices.
    own = {w for t in [*(x for v in TEMPLATES.values() for x in v), *DECOYS] for w in words_of(t)}
    common = sorted(Counter(w for x in windows for w in x).items(), key=lambda x: (-x[1], x[0]))[:common_words]
    words = {w: i + 1 for i, w in enumerate(sorted({*own, *(w for w, _ in common), b"0", b"00", b"0000"}))}
    base = len(words) + 1
    ids_of = lambda text: np.asarray([words.get(w, 0) for w in words_of(text)], np.int64)
    pair_codes = np.unique(np.concatenate([_pairs(ids_of(x), base) for v in [*TEMPLATES.values(), DECOYS] for x in v]))
    pair_codes = pair_codes[pair_codes > 0]
    x = _dense(rows, words, pair_codes)
    target = np.eye(len(families), dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], len(families)), np.float32), np.zeros(len(families), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        error = (_softmax(x @ w + b) - target) / len(x)
        vw = 0.9 * vw - 0.5 * (x.T @ error + 1e-5 * w)
        vb = 0.9 * vb - 0.5 * error.sum(0)
        w += vw
        b += vb
    apart, labels = _examples(random.Random(seed + 1), families, each // 2, windows[::3])
    z = _dense(apart, words, pair_codes) @ w + b
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), labels] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.25, 4, 33), key=loss))
    known = 1 - _softmax(z / temperature)[:, -1]
    bound = float(max(0.5, np.quantile(known[labels == len(families) - 1], 1 - false_share)))
    templates = []
    for k, family in enumerate(families[:-1]):
        for text in TEMPLATES[family]:
            codes = np.unique(_pairs(ids_of(text), base))
            templates.append((k, text, codes[codes > 0]))
    if _softmax(b[None] / temperature)[0, :-1].sum() > bound:
        raise ValueError("a text without known words must be unknown")
    word_weights = w[: len(words) + 1].copy()
    word_weights[0] = 0
    return Model(families, words, pair_codes, word_weights, w[len(words) + 1 :].copy(), b, temperature, bound, templates, least_similar)


@dataclass
class Finding:
    row: int
    paragraph: int
    start: int
    end: int
    family: str
    probability: float
    template: str
    similarity: float
    confirmed: bool


class Scanner:
    def __init__(self, model: Model):
        self.m = model

    def _windows(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paragraph, first and last-but-one word of every window, over words end to end."""
        half = WINDOW // 2
        n = np.maximum(1, -(-np.maximum(sizes - WINDOW, 0) // half) + 1)
        paragraph = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(paragraph)) - np.repeat(np.cumsum(n) - n, n)
        first = (np.cumsum(sizes) - sizes)[paragraph] + nth * half
        return paragraph, first, np.minimum(first + WINDOW, np.cumsum(sizes)[paragraph])

    def scan(self, texts: list[str | None]) -> list[Finding]:
        m, base = self.m, len(self.m.words) + 1
        get, where, sizes, ids = m.words.get, [], [], []
        for row, text in enumerate(texts):
            for nth, (a, b) in enumerate(paragraphs(text) if text else ()):
                found = [get(w, 0) for w in words_of(text[a:b])]
                if any(found):
                    where.append((row, nth, a, b))
                    sizes.append(len(found))
                    ids.extend(found)
        if not where:
            return []
        ids = np.asarray(ids, np.int64)
        paragraph, lo, hi = self._windows(np.asarray(sizes))
        codes = _pairs(ids, base)
        at = np.minimum(np.searchsorted(m.pair_codes, codes), len(m.pair_codes) - 1)
        pair = np.flatnonzero(m.pair_codes[at] == codes)
        z = np.tile(m.bias.astype(np.float64), (len(lo), 1))
        named = _counted(ids)
        # Sums over a window are differences of running sums over the words that count.
        for places, weights, last in ((named, m.word_weights[ids[named]], hi), (pair, m.pair_weights[at[pair]], hi - 1)):
            running = np.vstack([np.zeros((1, weights.shape[1])), np.cumsum(weights, 0, dtype=np.float64)])
            a, b = np.searchsorted(places, lo), np.searchsorted(places, last)
            z += running[np.maximum(a, b)] - running[a]
        p = _softmax(z / m.temperature)
        best: dict[tuple[int, int], Finding] = {}
        for k in np.flatnonzero(1 - p[:, -1] > m.bound):
            row, nth, a, b = where[paragraph[k]]
            for family, probability, template, similarity in self._families(ids[lo[k] : hi[k]], p[k]):
                new = Finding(row, nth, a, b, m.families[family], probability, template, similarity, similarity >= m.least_similar)
                old = best.get((int(paragraph[k]), family))
                if old is None or (new.similarity, new.probability) > (old.similarity, old.probability):
                    best[int(paragraph[k]), family] = new
        return [best[k] for k in sorted(best)]

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """Of every family for one window."""
        m = self.m
        codes = _pairs(ids, len(m.words) + 1)
        at = np.minimum(np.searchsorted(m.pair_codes, codes), len(m.pair_codes) - 1)
        z = m.bias.astype(np.float64) + m.word_weights[ids[_counted(ids)]].sum(0, dtype=np.float64) + m.pair_weights[at[m.pair_codes[at] == codes]].sum(0, dtype=np.float64)
        return _softmax(z / m.temperature)

    def _families(self, ids: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, float, str, float]]:
        """Family, probability, nearest template and its similarity; again without the words of a confirmed template."""
        m, ids, seen = self.m, ids.copy(), set()
        while 1 - p[-1] > m.bound:
            family = int(p[:-1].argmax())
            if family in seen:
                return
            seen.add(family)
            codes = _pairs(ids, len(m.words) + 1)
            similarity, template, pairs = max(((float(np.isin(c, codes).mean()) if len(c) else 0.0, t, c) for f, t, c in m.templates if f == family), key=lambda x: x[:2])
            yield family, float(p[family]), template, similarity
            if similarity < m.least_similar:
                return
            # Where the template stands: the longest stretch of its pairs. Others may be another notice's.
            held = np.flatnonzero(np.isin(codes, pairs))
            stretch = max(np.split(held, np.flatnonzero(np.diff(held) > _GAP) + 1), key=len)
            ids[stretch] = ids[stretch + 1] = 0
            p = self.probabilities(ids)


_FIELDS = [("paragraph", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("family", T.StringType()), ("probability", T.DoubleType()), ("template", T.StringType()), ("similarity", T.DoubleType()), ("confirmed", T.BooleanType())]


def scan(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """One row per finding: the columns of ``df`` but the text, and what was found where."""
    shared = broadcast(df.sparkSession, model, _MODEL_LIMIT)
    names = {n for n, _ in _FIELDS} | {text}
    others = [f for f in df.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = scanner.scan(batch.column(text).to_pylist())
                rows = pa.array([x.row for x in found], pa.int64())
                out = {f.name: batch.column(f.name).take(rows) for f in others}
                kinds = {T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_()}
                out |= {n: pa.array([getattr(x, n) for x in found], kinds[kind]) for n, kind in _FIELDS}
                yield pa.RecordBatch.from_pydict(out)

    return mapped(df.select(*[f.name for f in others], text), run, T.StructType(others + [T.StructField(n, k) for n, k in _FIELDS]))


def query(docs: DataFrame) -> DataFrame:
    out = scan(docs.select("doc_id", "text"), train(background(docs)))
    return out.withColumn("probability", F.round("probability", 4)).withColumn("similarity", F.round("similarity", 4))
