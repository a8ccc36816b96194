"""License scans: normalised text against licence templates, Dice coefficient over word bigrams.

Segments of a text - its lines, its blocks between blank lines, and the whole - are normalised (lower case, anything
but letters and digits a space) and compared with every template whose size allows the threshold: the
coefficient 2|A and B| / (|A| + |B|) is at most 2 min / (|A| + |B|), so a segment of n bigrams only meets
templates of t/(2-t) n to (2-t)/t n bigrams.  Segments that share no bigram with any template stop there.  Bigrams
are multisets.  One row per document: its best match and every licence that reached the threshold.

Defined cases: null and empty texts match nothing; of equal coefficients the first template by name wins;
repeated rows are scanned row by row; further columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from newsflow.llm.runtime import ship_package

THRESHOLD = 0.8

#: Public licence notices and texts.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. Do not redistribute."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_NO_WORD = re.compile(r"[\W_]+")
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")


def bigrams(text: str) -> list[tuple[str, str]]:
    words = _NO_WORD.sub(" ", text.lower()).split()
    return list(zip(words, words[1:], strict=False))


class TemplateIndex:
    """Templates in order of size."""

    def __init__(self, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD):
        self.threshold = threshold
        rows = [(len(b), name, Counter(b)) for name, texts in sorted((templates or TEMPLATES).items()) for t in texts if (b := bigrams(t))]
        self.rows = sorted(rows, key=lambda r: (r[0], r[1]))
        self.sizes = [r[0] for r in self.rows]
        self.any = {b for *_, grams in self.rows for b in grams}
        self.least = self.threshold / (2 - self.threshold)

    def allowed(self, n: int) -> tuple[int, int]:
        """The places in size order of templates that ``n`` bigrams may reach the threshold with."""
        slack = 1e-9
        return bisect.bisect_left(self.sizes, n * self.least - slack), bisect.bisect_right(self.sizes, n / self.least + slack)

    def match(self, words: list[str]) -> dict[str, float]:
        n = len(words) - 1
        lo, hi = self.allowed(n)
        if n < 1 or lo >= hi:
            return {}
        grams = list(zip(words, words[1:], strict=False))
        if self.any.isdisjoint(grams):
            return {}
        mine, found = Counter(grams), {}
        for size, name, theirs in self.rows[lo:hi]:
            dice = 2 * sum(min(c, mine[g]) for g, c in theirs.items() if g in mine) / (n + size)
            if dice >= self.threshold and dice > found.get(name, 0):
                found[name] = dice
        return found

    def scan(self, text: str | None) -> dict[str, float]:
        found: dict[str, float] = {}
        if not text:
            return found
        lines = [_NO_WORD.sub(" ", line).split() for line in text.lower().split("\n")]
        blocks, block = [], []
        for words, line in zip(lines, text.split("\n"), strict=True):
            if line.strip():
                block.append(words)
            elif block:
                blocks.append(block)
                block = []
        blocks += [block] if block else []
        segments = lines + [[w for ws in b for w in ws] for b in blocks if len(b) > 1]
        if len(blocks) > 1:
            segments.append([w for ws in lines for w in ws])
        for words in segments:
            for name, dice in self.match(words).items():
                if dice > found.get(name, 0):
                    found[name] = dice
        return found


def scan_licenses(documents: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, licenses): the best match, null without one, and all by name."""
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("dice", pa.float64()), ("licenses", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, threshold)
        for b in batches:
            found = [index.scan(t) for t in b.column("text").to_pylist()]
            best = [min(f.items(), key=lambda x: (-x[1], x[0])) if f else (None, None) for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([n for n, _ in best], pa.string()), pa.array([d for _, d in best], pa.float64()),
                                              pa.array([sorted(f) for f in found], pa.list_(pa.string()))], schema=schema)

    ship_package(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, dice double, licenses array<string>")
