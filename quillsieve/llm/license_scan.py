"""License scan: an exact set-similarity join of text blocks with license templates.

Templates and blocks are sets of words. A block meets a template when it holds
at least `threshold` of the template's words. Words are put in one global
order, rarest first by the number of documents that hold them. A block with
the needed overlap must hold one of a template's first |T| - need + 1 words
(prefix filter), must have enough words (length filter), and enough must be
left after the word that matched (positional filter); what passes is counted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, map_arrow, slices

#: Phrases that name a license, and its label: fixed values of the task.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (name, label, text): public license texts and the notices that their publishers ask for, several a license. Fixed values.
LICENSE_TEXTS = (
    ("mit-grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit-text",
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without'
        " restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom"
        " the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        ' of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A'
        " PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("mit-notice", "mit", "released under the terms of the MIT license"),
    ("apache-notice", "apache", "licensed under the Apache License, Version 2.0"),
    ("apache-terms", "apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    (
        "apache-boilerplate",
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("gpl-notice", "gpl", "this work is licensed under the GNU General Public License version 3"),
    ("gpl-terms", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    (
        "gpl-header",
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"
        " of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with"
        " this program. If not, see",
    ),
    ("bsd-terms", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd-text",
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must"
        " retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
        ' "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT'
        " SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF"
        " SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT"
        " (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc-text",
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission"
        ' notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY'
        " AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
        " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("cc-by-notice", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-notice", "cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-notice", "cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("mpl-notice", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "mpl-header",
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
        " https://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense-text",
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code"
        " form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)
#: Name to (label, text).
TEMPLATES = {name: (label, text) for name, label, text in LICENSE_TEXTS}
THRESHOLD = 0.8
#: A line is one block; a longer one, and the whole text across its lines, is cut into blocks that overlap by half. They
#: have at least so many words; for longer templates, the power of two that a template fits into twice.
BLOCK_WORDS = 128

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased."""
    return data.translate(_TABLE).split()


class ContainmentIndex:
    """Template word sets in one global order, with an index over their prefixes."""

    def __init__(self, templates: dict[str, tuple[str, str]], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        self.names = sorted(templates)
        self.labels = [templates[n][0] for n in self.names]
        sets = [set(words_of(templates[n][1].encode())) for n in self.names]
        vocabulary = set().union(*sets) if sets else set()
        order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.sets = [sorted(self.rank[w] for w in s) for s in sets]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for t, (s, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for at in range(len(s) - need + 1):
                self.prefixes.setdefault(s[at], []).append((t, at))
        self.prefix_words = {order[r] for r in self.prefixes}

    def probe(self, block: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block meets."""
        size = len(set(block))
        rank = self.rank
        held = sorted({rank[w] for w in block if w in rank})
        inside, seen, out = set(held), set(), []
        for j, r in enumerate(held):
            for t, at in self.prefixes.get(r, ()):
                need, words = self.need[t], self.sets[t]
                if t in seen:
                    continue
                # `r` is the first word both share, or an earlier one has put t in `seen`
                seen.add(t)
                if size < need or 1 + min(len(words) - at, len(held) - j) - 1 < need:
                    continue
                shared = sum(x in inside for x in words)
                if shared >= need:
                    out.append((t, shared / len(words)))
        return out


def indexes(templates: dict[str, tuple[str, str]], frequency: dict[bytes, int], threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> dict[int, ContainmentIndex]:
    """Words of a block to the index of the templates that are looked for in blocks of that size."""
    by_size: dict[int, dict[str, tuple[str, str]]] = {}
    for name, (label, text) in templates.items():
        size = max(block_words, 1 << (2 * len(words_of(text.encode())) - 1).bit_length())
        by_size.setdefault(size, {})[name] = label, text
    return {size: ContainmentIndex(own, frequency, threshold) for size, own in sorted(by_size.items())}


def _blocks(words: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    step = max(1, size // 2)
    for start in range(0, max(1, len(words) - step), step):
        yield start, words[start : start + size]


def frequencies(docs: DataFrame, templates: dict[str, tuple[str, str]]) -> dict[bytes, int]:
    """In how many documents each template word stands, over the whole table.

    The result is as large as the templates' vocabulary, whatever the corpus.
    """
    vocabulary = frozenset(w for _, text in templates.values() for w in words_of(text.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in slices(batches, 512):
            for data in as_bytes(batch, "text"):
                counts.update(vocabulary.intersection(words_of(data)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").transform(map_arrow, run, "word binary, n long").groupBy("word").sum("n").collect()
    return {bytes(w): n for w, n in rows}


_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                     ("blocks", pa.list_(pa.struct([("template", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])))])
_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<template: string, label: string, first_word: long, n_words: long, containment: double>>"


def phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> tuple[list[int], set[str]]:
    """Where phrases start, counted in words, and their labels. Each word is counted once for each phrase."""
    places, labels = [], set()
    joined = b" " + b" ".join(words) + b" "
    for phrase, label in phrases.items():
        at, last, word = joined.find(phrase), 0, 0
        while at >= 0:
            word, last = word + joined.count(b" ", last, at), at
            places.append(word)
            labels.add(label)
            at = joined.find(phrase, at + 1)
    return places, labels


def scan_text(data: bytes, by_size: dict[int, ContainmentIndex], phrases: dict[bytes, str]) -> tuple:
    """The result columns of one text, without doc_id."""
    words = words_of(data)
    places, base = phrase_places(words, phrases)
    blocks, labels, lines = [], set(base), None
    present = set(words)
    for size, index in by_size.items():
        if index.prefix_words.isdisjoint(present):
            continue
        if lines is None:
            lines, before = [], 0
            for line in data.split(b"\n"):
                own = words_of(line)
                if own:
                    lines.append((before, own))
                before += len(own)
        # Notices are wrapped: the words of all lines are one more stream of blocks.
        met = set()
        for first, own in [*lines, (0, words)] if len(lines) > 1 else lines:
            for start, block in _blocks(own, size):
                if index.prefix_words.isdisjoint(block) or (first + start, len(block)) in met:
                    continue
                met.add((first + start, len(block)))
                for t, share in index.probe(block):
                    blocks.append({"template": index.names[t], "label": index.labels[t], "first_word": first + start, "n_words": len(block), "containment": share})
                    labels.add(index.labels[t])
    score = 1.0 if places else max((b["containment"] for b in blocks), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_base (places of a phrase),
    first_word and last_word (smallest and largest such place; null without one),
    base_labels, labels (with those of templates), score and `blocks` (every block
    that meets a template). Labels are distinct, sorted, comma-joined; '' if none.

    The score is 1 with a phrase, else the best containment found, else 0. Null
    texts count as empty: no words, no labels, score 0. Repeated rows give
    repeated rows; other columns are ignored; an empty table gives no rows.
    A template is found whole however it is wrapped: it fits into half a block of its size.
    """
    templates = TEMPLATES if templates is None else templates
    keyed = {f" {p} ".encode(): label for p, label in (PHRASES if phrases is None else phrases).items()}
    by_size = indexes(templates, frequencies(docs, templates), threshold, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            rows = [scan_text(data, by_size, keyed) for data in as_bytes(batch, "text")]
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            ids = batch.column(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, list(_FIELDS)[1:], strict=True))], schema=_FIELDS)

    return docs.select("doc_id", "text").transform(map_arrow, run, _DDL)
