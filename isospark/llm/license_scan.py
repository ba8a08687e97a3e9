"""Operator 6, license scans: winnowed fingerprints pick candidates, banded alignment decides.

The ``GRAM``-word shingles of every license template are winnowed: of each ``WINDOW`` shingles
in a row the one with the least hash stays, so that any stretch of ``GRAM + WINDOW - 1`` words
shares one with its template.  They form an inverted index from shingle to places in templates.
Shingles of a document that are in the index are hits; hits of one template near one diagonal
make a candidate, whose stretch of the document is aligned with the whole template (local
alignment of words in a band around the diagonals).  What lies before and after a match is
aligned again while hits are left there, so copies that follow each other are all found.
Reported are matched words, the coverage of the template, and spans in words and characters.

The templates are whole license texts, in the folder ``licenses`` beside this module, and the
notices and lines by which works name their license.

Templates go to the tasks in blocks of bounded size, one pass over the documents for each block;
documents are not shuffled.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontaminate import _FOLD, words

GRAM, WINDOW, BAND = 3, 3, 6
MIN_COVERAGE = 0.6
#: A candidate has a hit for every so many words of its template, or at least one: a long text is not aligned for a phrase.
WORDS_A_HIT = 60
#: Words of templates that one pass looks for.
BLOCK_WORDS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1

_WORD = re.compile(rb"[^ ]+")

#: Notices and lines that name a license.
NOTICES = (
    ("mit-line", "Released under the MIT License."),
    ("apache-2-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-line", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("gpl-2-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl-2-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cc-by-4-notice", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4-notice", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4-notice", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4-line", "Licensed under CC BY-NC 4.0."),
    ("cc0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def license_texts() -> list[tuple[str, str]]:
    """Whole texts by the names of their files, and the notices."""
    folder = resources.files(__package__) / "licenses"
    return [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")] + list(NOTICES)


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the least hash of every window (the last of equal ones), each once."""
    n = len(hashes)
    if n <= window:
        return [min(range(n), key=lambda i: (hashes[i], -i))] if n else []
    out: list[int] = []
    for a in range(n - window + 1):
        k = min(range(a, a + window), key=lambda i: (hashes[i], -i))
        if not out or out[-1] != k:
            out.append(k)
    return out


class Index:
    """Word codes of templates, and their winnowed shingles as an inverted index."""

    def __init__(self, templates: list[tuple[str, bytes | None]], gram: int = GRAM, window: int = WINDOW):
        self.gram = gram
        self.code: dict[bytes, int] = {}
        self.names, self.texts = [], []
        entries = []
        for name, text in templates:
            w = words(text)
            if not w:
                continue
            codes = [self.code.setdefault(x, len(self.code) + 1) for x in w]
            t = len(self.names)
            self.names.append(name)
            self.texts.append(codes)
            grams = [tuple(codes[i : i + gram]) for i in range(max(1, len(codes) - gram + 1))]
            # Shorter templates are one shingle, which codes of 0 fill up.
            grams = [g + (0,) * (gram - len(g)) for g in grams]
            hashes = [zlib.crc32(b" ".join(w[i : i + gram])) for i in range(len(grams))]
            entries += [(grams[i], t, i) for i in winnow(hashes, window)]
        self.base = len(self.code) + 1
        if self.base**gram >= 1 << 63:
            raise ValueError("too many different words in a block of templates")
        entries = sorted((self.key(g), t, i) for g, t, i in entries)
        self.keys = np.array([e[0] for e in entries], np.int64)
        self.template = np.array([e[1] for e in entries], np.int64)
        self.place = np.array([e[2] for e in entries], np.int64)
        self.short = sorted({len(c) for c in self.texts if len(c) < gram})

    def key(self, gram) -> int:
        k = 0
        for c in gram:
            k = k * self.base + int(c)
        return k

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document place, template, template place) of the document's shingles in the index."""
        places, keys = [], []
        for n in [*self.short, self.gram]:
            if len(codes) < n:
                continue
            key = np.zeros(len(codes) - n + 1, np.int64)
            known = np.ones(len(key), bool)
            for j in range(self.gram):
                c = codes[j : j + len(key)] if j < n else 0
                key = key * self.base + c
                known &= (c != 0) if j < n else True
            at = np.flatnonzero(known)
            places.append(at)
            keys.append(key[at])
        if not places:
            return (np.zeros(0, np.int64),) * 3
        place, key = np.concatenate(places), np.concatenate(keys)
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        n = hi - lo
        entry = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.repeat(place, n), self.template[entry], self.place[entry]


def candidates(hits, length, band: int = BAND) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Groups of hits of one template near one diagonal: (template, [(document place, template place)]).

    Hits are taken by diagonal, as those of other copies and of phrases that recur stand between
    them in the document; a group's places are no further apart than the template is long.
    """
    place, template, at = hits
    order = np.lexsort((place, place - at, template))
    p, t, d = place[order], template[order], (place - at)[order]
    edge = np.flatnonzero((t[1:] != t[:-1]) | (d[1:] - d[:-1] > band)) + 1
    for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(p)]):
        while lo < hi:
            end = lo + int(np.searchsorted(d[lo:hi], d[lo] + 4 * band, side="right"))
            near = sorted(zip(p[lo:end].tolist(), (p - d)[lo:end].tolist()))
            group: list[tuple[int, int]] = []
            for x in near:
                if group and x[0] - group[-1][0] > length[t[lo]]:
                    yield int(t[lo]), group
                    group = []
                group.append(x)
            if group:
                yield int(t[lo]), group
            lo = end


def align(doc: list[int], template: list[int], low: int, high: int) -> tuple[int, int, int, int]:
    """Best local alignment with diagonals in ``[low, high]``: (score, matched words, first word, end word).

    ``doc`` and ``template`` are word codes; of equal scores the one that ends first, then the longer.
    """
    best = (0, 0, 0, 0)
    previous: dict[int, tuple[int, int, int]] = {}
    for i, c in enumerate(template):
        now: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + low), min(len(doc), i + high + 1)):
            s, m, start = previous.get(j - 1, (0, 0, j))
            same = doc[j] == c
            cell = (s + (MATCH if same else MISMATCH), m + same, start)
            for x in (previous.get(j), now.get(j - 1)):
                if x and x[0] + GAP > cell[0]:
                    cell = (x[0] + GAP, x[1], x[2])
            if cell[0] > 0:
                now[j] = cell
                if cell[0] > best[0] or (cell[0] == best[0] and j + 1 < best[3]):
                    best = (cell[0], cell[1], cell[2], j + 1)
        previous = now
    return best


def matches(codes: np.ndarray, template: list[int], group: list[tuple[int, int]], min_coverage: float, band: int) -> list[tuple[int, int, int]]:
    """(matched words, first word, end word) around a group of hits, until none is left outside of an alignment."""
    found = []
    todo = [(0, len(codes), group)]
    while todo:
        lo, hi, hits = todo.pop()
        if len(hits) * WORDS_A_HIT <= len(template) - WORDS_A_HIT:
            continue
        diagonals = [p - a for p, a in hits]
        a = max(lo, hits[0][0] - len(template) - band)
        z = min(hi, hits[-1][0] + len(template) + band + 1)
        score, matched, start, end = align(codes[a:z].tolist(), template, min(diagonals) - a - band, max(diagonals) - a + band)
        if not score:
            continue
        start, end = start + a, end + a
        if matched >= min_coverage * len(template):
            found.append((matched, start, end))
        for left, right, rest in ((lo, start, [h for h in hits if h[0] < start]), (end, hi, [h for h in hits if h[0] >= end])):
            if rest and left < right:
                todo.append((left, right, rest))
    return found


def scan_text(b: bytes | None, index: Index, min_coverage: float = MIN_COVERAGE, band: int = BAND) -> list[tuple[str, int, float, int, int, int, int]]:
    """Matches in one text: (template, matched words, coverage, word span, byte span).

    Matches of one template do not overlap: of those that would, the one with more matched words
    stays, of equal ones the first.
    """
    w = words(b)
    if not w or not len(index.keys):
        return []
    get = index.code.get
    codes = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
    hits = index.hits(codes)
    if not len(hits[0]):
        return []
    by: dict[int, set] = {}
    for t, group in candidates(hits, [len(x) for x in index.texts], band):
        by.setdefault(t, set()).update(matches(codes, index.texts[t], group, min_coverage, band))
    found = []
    for t, each in by.items():
        kept: list[tuple[int, int]] = []
        for matched, start, end in sorted(each, key=lambda m: (-m[0], m[1], m[2])):
            k = bisect.bisect(kept, (start, end))
            if (k and kept[k - 1][1] > start) or (k < len(kept) and kept[k][0] < end):
                continue
            kept.insert(k, (start, end))
            found.append((index.names[t], matched, matched / len(index.texts[t]), start, end))
    if not found:
        return []
    at = [m.span() for m in _WORD.finditer(b.translate(_FOLD))]
    return [(*r, at[r[3]][0], at[r[4] - 1][1]) for r in sorted(found, key=lambda r: (r[3], r[4], r[0]))]


_MATCHES = "array<struct<license:string,matched:long,coverage:double,start_word:long,end_word:long,start_char:long,end_char:long>>"
_NAMES = ("license", "matched", "coverage", "start_word", "end_word", "start_char", "end_char")


def template_blocks(templates: DataFrame, name_col: str, text_col: str, block_words: int) -> Iterator[Index]:
    block, n = [], 0
    for r in templates.select(F.col(name_col).alias("n"), F.col(text_col).cast("binary").alias("t")).toLocalIterator():
        block.append((r.n, bytes(r.t) if r.t is not None else None))
        n += len(words(block[-1][1]))
        if n >= block_words:
            yield Index(block)
            block, n = [], 0
    if block:
        yield Index(block)


def _scanner(index, min_coverage: float):
    kind = pa.list_(pa.struct([(n, pa.string() if n == "license" else pa.float64() if n == "coverage" else pa.int64()) for n in _NAMES]))

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for b in texts.cast(pa.binary()).to_pylist():
            found = scan_text(b, index.value, min_coverage)
            rows.append([dict(zip(_NAMES, (*r[:5], *(len(b[:x].decode("utf-8", "replace")) for x in r[5:])))) for r in found])
        return pa.array(rows, kind)

    return run


def license_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(license_texts(), "license string, text string")


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "license", template_col: str = "text", min_coverage: float = MIN_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per match: ``(id_col, license, matched, coverage, start_word, end_word, start_char, end_char)``.

    Spans exclude their end; a template that recurs in a document gives a row each time.  Templates may
    overlap one another (a notice within its license); of equally good matches of one the first stays.
    Texts are scanned whole, one at a time.  Null and empty texts have no matches, templates without words match nothing, repeated templates report
    each, null and repeated ids keep their rows, an empty table of either kind gives none.
    """
    spark = docs.sparkSession
    kind = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n == "license" else T.DoubleType() if n == "coverage" else T.LongType()) for n in _NAMES]))
    out = None
    for block in template_blocks(templates, name_col, template_col, block_words):
        udf = F.arrow_udf(_scanner(spark.sparkContext.broadcast(block), min_coverage), kind)
        part = docs.select(F.col(id_col), F.explode(udf(F.col(text_col))).alias("_m")).select(id_col, "_m.*")
        out = part if out is None else out.union(part)
    if out is None:
        return docs.select(F.col(id_col), F.explode(F.lit(None).cast(_MATCHES)).alias("_m")).select(id_col, "_m.*")
    return out
