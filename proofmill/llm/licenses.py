"""License scan: phrases in place, and an exact set-similarity join of text blocks with license notices."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_map

#: Words that name a license where they stand together.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices in the words of the public license texts, paragraph by paragraph.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "apache-2": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
        "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed "
        "or altered from any source distribution.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This work is licensed under the GNU General Public License, version 3",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
        "one at https://mozilla.org/MPL/2.0/.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}

#: Words in all templates together, at most: their index is built in every task.
MAX_TEMPLATE_WORDS = 2_000_000

_WORD = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.translate(_TABLE).split()


def token_counts(docs: DataFrame, vocabulary: set[bytes], text_col: str) -> dict[bytes, int]:
    """How often each vocabulary word occurs in all texts; one number per vocabulary word reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for a, b in chunks(batch.column(0)):
                for t in batch.column(0).slice(a, b - a).to_pylist():
                    total.update(w for w in split_words(t or b"") if w in vocabulary)
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    counted = docs.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(count, "w binary, n long")
    return {bytes(r["w"]): r["n"] for r in counted.groupBy("w").agg(F.sum("n").alias("n")).collect()}


class NoticeIndex:
    """Templates as token ranks, rare tokens first, with the prefix of each one indexed by token.

    ``templates`` are pairs of a label and a list of words, and all are searched for in blocks of one length.
    """

    def __init__(self, templates: list[tuple[str, list[bytes]]], counts: dict[bytes, int], threshold: float, block: int):
        self.block = block
        sets = [(label, set(words)) for label, words in templates]
        order = sorted(set().union(*(words for _, words in sets)), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.notices: list[tuple[str, list[int], int]] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, (label, words) in enumerate(sets):
            ranks = sorted(self.rank[w] for w in words)
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            self.notices.append((label, ranks, need))
            for i, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefix.setdefault(order[r], []).append((k, i))
        self.by_rank = {self.rank[w]: x for w, x in self.prefix.items()}

    def matches(self, block: list[bytes]) -> Iterator[tuple[str, float]]:
        """Labels of the templates that the block contains to the threshold, with the share of each found."""
        have = sorted({self.rank[w] for w in block if w in self.rank})
        seen = set()
        for j, r in enumerate(have):
            for k, i in self.by_rank.get(r, ()):
                label, notice, need = self.notices[k]
                # Length filter, then positional filter at the first shared token of the rarity order.
                if k in seen or len(have) < need or min(len(notice) - i, len(have) - j) < need:
                    continue
                seen.add(k)
                both = len(set(notice).intersection(have))
                if both >= need:
                    yield label, both / len(notice)

    def search(self, words: list[bytes]) -> Iterator[tuple[str, float]]:
        """What :meth:`matches` finds in all blocks of a text; each block overlaps the next by half."""
        half = self.block // 2
        starts = {s for i, w in enumerate(words) if w in self.prefix for s in (i // half * half, i // half * half - half) if s >= 0}
        for s in sorted(starts):
            yield from self.matches(words[s : s + self.block])


def indexes(templates: dict[str, tuple[str, ...]], counts: dict[bytes, int], threshold: float) -> list[NoticeIndex]:
    """One index for each size of templates: half a block is the next power of two, so any run of as many words as a template has lies inside a block."""
    by_block: dict[int, list[tuple[str, list[bytes]]]] = {}
    for label, notices in templates.items():
        for words in (split_words(t.encode()) for t in notices):
            if words:
                by_block.setdefault(2 << (len(words) - 1).bit_length(), []).append((label, words))
    return [NoticeIndex(x, counts, threshold, block) for block, x in sorted(by_block.items())]


def scan_text(text: bytes, phrases: dict[bytes, str], found_by: list[NoticeIndex]) -> tuple:
    words = split_words(text)
    joined, places = b" %b " % b" ".join(words), []
    labels, best = {}, 0.0
    for phrase, label in phrases.items():
        at = joined.find(phrase)
        while at >= 0:
            places.append(joined.count(b" ", 0, at))
            labels[label] = 1
            at = joined.find(phrase, at + 1)
    base = sorted(labels)
    for index in found_by:
        for label, share in index.search(words):
            labels[label], best = 1, max(best, share)
    score = 1.0 if places else best
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(labels)), score


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES,
    templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Base labels come from phrases whose words stand consecutively. Further labels come from every text
    block that contains ``threshold`` of a template's distinct words. Blocks are two to four times as long as
    the template and overlap by half, so a template of any length fits. The join is exact: tokens are
    ordered by their count over all documents, and the prefix, length and positional filters only skip
    blocks that cannot reach the threshold. The templates are the small side and go to every task; more than
    ``MAX_TEMPLATE_WORDS`` words of them are refused.

    ``score`` is 1 with a base label, else the largest share of a template found (at least ``threshold``), else 0.
    Null and wordless texts have no words, no labels and score 0. Repeated rows stay, null ids are kept,
    empty tables give empty results, other columns are not read, texts may be of any length.
    """
    vocabulary = {w for notices in templates.values() for t in notices for w in split_words(t.encode())}
    if sum(len(split_words(t.encode())) for notices in templates.values() for t in notices) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"the templates have more than {MAX_TEMPLATE_WORDS} words; scan in several calls")
    found_by = indexes(templates, token_counts(docs, vocabulary, text_col), threshold)
    known = {b" %b " % b" ".join(split_words(p.encode())): label for p, label in phrases.items()}
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def scan(texts: list[bytes]) -> dict[str, pa.Array]:
        rows = zip(*(scan_text(t, known, found_by) for t in texts))
        return {n: pa.array(list(c), k) for n, c, k in zip(names, rows, kinds)}

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return text_map(docs, [F.col(id_col).cast("long").alias("doc_id")], text_col, scan, schema)
