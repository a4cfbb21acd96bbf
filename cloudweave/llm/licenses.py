"""License scans by conditional compression.

Candidate blocks are the lines of a text that hold a license cue word, and the paragraphs around such lines.
Each block is compressed alone and with every template as a raw zstandard dictionary; templates are ranked by
the bytes that the dictionary saves, in proportion. All that save enough are confirmed by aligning the exact words of block and
template: enough of the template's words must occur in order, and all its words that hold a digit (versions). The template
that differs least wins its words, and what stands before and after them is searched again, so a block may hold several
notices, each with its own span. Missing and extra words are reported.

Defined cases: null and empty texts give no rows; repeated rows each give their rows; ties between templates go to
the name that sorts first; lines and paragraphs of any length are scanned (a block longer than ``PIECE``
characters is compared in overlapping pieces); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import documents, session_for

# Wording of common license notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-license": "Released under the BSD License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
CUES = ("licen", "copyright", "warrant", "permission", "redistribut", "rights reserved", "public domain", "spdx")

PIECE, OVERLAP = 4000, 2000
#: A template must save this share of the block's compressed bytes, or of its own length where the block is longer.
LEAST_SAVED = 0.15
LEAST_WORDS, MOST_EXTRA = 0.85, 0.5
BLOCKS_HELD = 20_000

_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_LINE = re.compile(r"[^\n]+")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = {n: words(templates[n]) for n in self.names}
        # Comments wrap and indent notices: both sides are compared with single spaces.
        self.text = {n: " ".join(templates[n].split()).encode() for n in self.names}
        options = {"level": 9, "write_content_size": False, "write_checksum": False}
        self.plain = zstandard.ZstdCompressor(**options)
        self.given = {
            n: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(self.text[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for n in self.names
        }
        self.known: dict[str, list[tuple]] = {}

    def savings(self, block: str) -> list[tuple[float, str]]:
        """(share of bytes saved, template), best first."""
        raw = " ".join(block.split()).encode()
        alone = len(self.plain.compress(raw))
        found = []
        for n in self.names:
            saved = alone - len(self.given[n].compress(raw))
            found.append((saved / max(1, min(alone, len(self.plain.compress(self.text[n])))), n))
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def compare(self, theirs: list[str], name: str) -> tuple[int, int, int, int]:
        """(template words found in order, other words between the first and last of them, first word, end) in a list of words."""
        matched = [m for m in difflib.SequenceMatcher(None, theirs, self.words[name], autojunk=False).get_matching_blocks() if m.size]
        n = sum(m.size for m in matched)
        if not n:
            return 0, 0, 0, 0
        start, end = matched[0].a, matched[-1].a + matched[-1].size
        return n, end - start - n, start, end

    def confirm(self, block: str) -> list[tuple]:
        """(start, end, template, saved, matched, missing, extra) of all notices in a block, none overlapping another."""
        if block in self.known:
            return self.known[block]
        spots = [m.span() for m in _WORD.finditer(block)]
        own = [block[a:b].lower() for a, b in spots]
        found, parts = [], [(0, len(own))]
        while parts:
            lo, hi = parts.pop()
            some, here = own[lo:hi], set(own[lo:hi])
            # Templates that lack too many words anywhere, or a version, can't be confirmed.
            able = {
                n for n, w in self.words.items()
                if sum(x in here for x in w) >= LEAST_WORDS * len(w) and all(x in here for x in w if any(c.isdigit() for c in x))
            }
            if not able:
                continue
            best = []
            for saved, name in self.savings(block[spots[lo][0] : spots[hi - 1][1]]):
                if saved >= LEAST_SAVED and name in able:
                    matched, extra, a, b = self.compare(some, name)
                    n = len(self.words[name])
                    if matched >= LEAST_WORDS * n and extra <= MOST_EXTRA * n:
                        best.append((n - matched + extra, -matched, -saved, name, a, b, (name, saved, matched, n - matched, extra)))
            if best:
                *_, a, b, row = min(best)
                found.append((spots[lo + a][0], spots[lo + b - 1][1], *row))
                parts += [(lo, lo + a), (lo + b, hi)]
        found.sort()
        if len(self.known) < BLOCKS_HELD:
            self.known[block] = found
        return found

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Cue lines, and paragraphs of several lines that hold one."""
        out, start, end, cue, lines = [], 0, 0, False, 0
        for m in _LINE.finditer(text):
            blank = not m[0].strip()
            if m.start() > end + 1 or blank:
                if cue and lines > 1:
                    out.append((start, end))
                start, cue, lines = m.start(), False, 0
            if blank:
                start, end = m.end() + 1, m.end()
                continue
            end, lines = m.end(), lines + 1
            low = m[0].lower()
            if any(c in low for c in CUES):
                cue = True
                out.append(m.span())
        if cue and lines > 1:
            out.append((start, end))
        return sorted(out, key=lambda x: (x[0], x[1]))

    def scan(self, text: str) -> list[tuple]:
        """(start, end, template, saved, matched, missing, extra); the same template once where spans of lines, paragraphs or pieces overlap."""
        low = text.lower()
        if not any(c in low for c in CUES):
            return []
        by_size = sorted(self.blocks(text), key=lambda x: (x[1] - x[0], x))
        found: list[tuple] = []
        at_of: dict[str, list[tuple[int, int]]] = {}
        for start, end in by_size:
            for a in range(start, end, OVERLAP) if end - start > PIECE else (start,):
                b = min(end, a + PIECE)
                for first, last, name, *rest in self.confirm(text[a:b]):
                    first, last = a + first, a + last
                    spots = at_of.setdefault(name, [])
                    k = bisect.bisect_left(spots, (first, 0))
                    if not (k < len(spots) and spots[k][0] < last) and not (k and spots[k - 1][1] > first):
                        spots.insert(k, (first, last))
                        found.append((first, last, name, *rest))
                if b == end:
                    break
        return sorted(found)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row a license notice: doc_id, start, end (code points), license, saved, n_matched, n_missing, n_extra."""
    session_for(df)
    templates = dict(templates or TEMPLATES)
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    kinds = {"start": pa.int64(), "end": pa.int64(), "license": pa.string(), "saved": pa.float64(), "n_matched": pa.int64(), "n_missing": pa.int64(), "n_extra": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            found = [(doc, *x) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in scanner.scan(t)]
            if found:
                doc, *columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, b.column(0).type), *[pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)]], names=["doc_id", *kinds])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, end long, license string, saved double, n_matched long, n_missing long, n_extra long")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
