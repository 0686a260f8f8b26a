"""License scans by conditional compression.

Around blocks of lines with licence vocabulary, runs of words that a template
shares with the text place candidate blocks of the template's size, so text on the same
line or in the same block changes nothing.  A template is cut into one run more
than words may differ; one run of every notice within the allowed differences is
therefore unchanged and gives a candidate.  zstandard compresses each candidate alone and with every
template as a raw-content dictionary.  Templates that save a good part of what they save on their own text are
ranked by bytes saved, and the exact differences in wording confirm a winner; only a template that saves nearly as
much can take its place by a closer wording.  A confirmed notice takes its words, the rest is compressed again.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from heapq import heappop, heappush

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.words import sliced

# Notices of public licences; "#" stands for any one word.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "MIT-reference": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT license.",
    "MIT-title": "MIT License Copyright (c) #",
    "SPDX": "SPDX-License-Identifier: #",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-reference": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version # of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version # of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "AGPL-reference": "This work is licensed under the GNU Affero General Public License, version #.",
    "GPL-reference": "This work is licensed under the GNU General Public License, version #.",
    "LGPL-reference": "This work is licensed under the GNU Lesser General Public License, version #.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY": "Licensed under CC BY #.",
    "CC-BY-SA": "Licensed under CC BY-SA #.",
    "CC-BY-NC": "Licensed under CC BY-NC #.",
    "CC-BY-ND": "Licensed under CC BY-ND #.",
    "CC-BY-NC-SA": "Licensed under CC BY-NC-SA #.",
    "CC-reference": "This work is licensed under a Creative Commons Attribution # International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Proprietary": "Copyright # All rights reserved.",
}
CUES = re.compile(r"licen[sc]e|copyright|permission|warrant|redistribut|spdx|creative commons|public domain|rights reserved|\bCC BY", re.IGNORECASE)
#: Lines between two cues that still belong to one block, and the length beyond which a line is cut at sentence ends.
GAP = 3
LONG_LINE = 2000
#: Differing words allowed as a share of the template.
DIFFERENCES = 0.1
#: Share of the bytes a template saves on its own text from which it is compared, and share of the winner's from which a closer wording counts.
SAVED = 0.25
NEAR = 0.9
_WORD = re.compile(r"[\w#]+(?:[.\-/]\w+)*")
_MARKS = re.compile(r"[^\w\s]*")
_SENTENCE = re.compile(r"(?<=[.;!?])\s+")
_SETTINGS = zstandard.ZstdCompressionParameters.from_level(9, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """Lines, long ones cut at sentence ends, as character ranges."""
    at = 0
    for line in text.split("\n"):
        if len(line) <= LONG_LINE:
            yield at, at + len(line)
        else:
            begin = 0
            for cut in _SENTENCE.finditer(line):
                yield at + begin, at + cut.start()
                begin = cut.end()
            yield at + begin, at + len(line)
        at += len(line) + 1


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """Ranges from a line with a cue to the last one at most GAP lines after the one before."""
    if not CUES.search(text):
        return []
    blocks: list[list[int]] = []
    for number, (begin, end) in enumerate(pieces(text)):
        if CUES.search(text, begin, end):
            if blocks and number - blocks[-1][2] <= GAP:
                blocks[-1][1:] = [end, number]
            else:
                blocks.append([begin, end, number])
    return [(a, b) for a, b, _ in blocks]


def differences(block: list[str], template: list[str]) -> tuple[list[str], list[str], int, int]:
    """Template words missing from the block, words standing in their place, and the first and last block word used."""
    same = SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks()[:-1]
    if not same:
        return template, [], 0, 0
    missing, extra, at = [], [], 0
    begin = max(0, same[0].a - same[0].b) if "#" in template[: same[0].b] else same[0].a
    place = begin
    for a, b, size in [*same, (None, len(template), 0)]:
        gap = template[at:b]
        given = block[place:a] if a is not None else block[place : place + gap.count("#")] if "#" in gap else []
        free = gap.count("#")
        missing += [w for w in gap if w != "#"]
        extra += given[free:] if len(given) > free else []
        missing += ["#"] * max(0, free - len(given))
        at = b + size
        place = (a + size) if a is not None else place + len(given)
    return missing, extra, begin, place


def runs_of(template: list[str]) -> list[tuple[int, list[str]]]:
    """(place, words): disjoint runs without "#", one more than words may differ, of about equal length."""
    edges = [-1, *(at for at, w in enumerate(template) if w == "#"), len(template)]
    whole = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
    parts = [1] * len(whole)
    while whole and sum(parts) <= DIFFERENCES * len(template):
        longest = max(range(len(whole)), key=lambda n: (whole[n][1] - whole[n][0]) / parts[n])
        parts[longest] += 1
    cuts = [[a + (b - a) * i // n for i in range(n + 1)] for (a, b), n in zip(whole, parts, strict=True)]
    return [(a, template[a:b]) for own in cuts for a, b in zip(own, own[1:], strict=False) if a < b]


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.words = {name: words_of(text) for name, text in templates.items()}
        #: Runs by their first word, and the most words a notice takes.
        self.runs: dict[str, list[tuple[list[str], str, int]]] = {}
        for name, words in self.words.items():
            for place, run in runs_of(words):
                self.runs.setdefault(run[0], []).append((run, name, place))
        self.reach = max((len(w) + self.allowed(n) for n, w in self.words.items()), default=0)
        self.plain = zstandard.ZstdCompressor(compression_params=_SETTINGS)
        self.given, self.own = {}, {}
        for name, words in self.words.items():
            data = " ".join(w for w in words if w != "#").encode()
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[name] = zstandard.ZstdCompressor(dict_data=own, compression_params=_SETTINGS)
            #: Bytes a template saves on its own text.
            self.own[name] = len(self.plain.compress(data)) - len(self.given[name].compress(data))

    def allowed(self, name: str) -> int:
        return int(DIFFERENCES * len(self.words[name]))

    def sizes(self, words: list[str], name: str) -> tuple[int, int]:
        """Bytes of the words compressed alone and with the template."""
        data = " ".join(words).encode()
        return len(self.plain.compress(data)), len(self.given[name].compress(data))

    def ranked(self, words: list[str]) -> list[tuple[int, str]]:
        """(bytes saved, template) of all templates that save enough, most first."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        saved = ((alone - len(packer.compress(data)), name) for name, packer in self.given.items())
        return sorted((s for s in saved if s[0] > 0 and s[0] >= SAVED * self.own[s[1]]), key=lambda s: (-s[0], s[1]))

    def aligned(self, own: list[str], name: str) -> tuple[int, list[str], list[str], int, int] | None:
        """(differing words, missing, extra, first word, word after the last) if few enough differ."""
        template = self.words[name]
        missing, extra, begin, end = differences(own, template)
        count = len(missing) + len(extra)
        return (count, missing, extra, begin, end) if count <= DIFFERENCES * len(template) else None

    def confirmed(self, block: str, name: str) -> tuple[int, list[str], list[str]] | None:
        """(differing words, missing, extra) if few enough."""
        own = self.aligned(words_of(block), name)
        return own[:3] if own else None

    def areas(self, text: str) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
        """Words and their character ranges: blocks with as many words around them as a notice may take."""
        blocks = candidate_blocks(text)
        if not blocks:
            return
        found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        begins, merged = [a for a, _ in found], []
        for begin, end in blocks:
            first, last = max(0, bisect_left(begins, begin) - self.reach), bisect_left(begins, end) + self.reach
            if merged and first <= merged[-1][1]:
                merged[-1][1] = last
            else:
                merged.append([first, last])
        for first, last in merged:
            yield [text[a:b].lower() for a, b in found[first:last]], found[first:last]

    def windows(self, words: list[str]) -> Iterator[tuple[str, int, int, int, int]]:
        """(template, first word, word after the last, first and last + 1 word of the run) around every run shared with a template."""
        for at, word in enumerate(words):
            for run, name, place in self.runs.get(word, ()):
                if words[at : at + len(run)] == run:
                    begin, spare = at - place, self.allowed(name)
                    yield name, max(0, begin - spare), min(len(words), begin + len(self.words[name]) + spare), at, at + len(run)

    def scan(self, text: str) -> Iterator[tuple]:
        """Every confirmed licence, in order: range, licence, reduction, differences, missing, extra.

        Of all confirmed candidates the one with the fewest differing words goes first, then the one that saves most;
        it takes its words, and what is left of the candidates it touches is compressed again.
        """
        for words, ranges in self.areas(text):
            known: dict[tuple, tuple | None] = {}

            def compared(low: int, high: int) -> tuple | None:
                own, best, enough = words[low:high], None, 0.0
                for saved, name in self.ranked(own):
                    if saved < enough:
                        break
                    found = self.aligned(own, name)
                    if not found:
                        continue
                    enough = enough or NEAR * saved
                    order = found[0] / len(self.words[name]), -saved, name
                    if best is None or order < best[0]:
                        best = order, found
                if not best:
                    return None
                (*order, name), (count, missing, extra, first, last) = best
                begin, end = ranges[low + first][0], _MARKS.match(text, ranges[low + last - 1][1]).end()
                alone, given = self.sizes(own[first:last], name)
                return (*order, name, low + first, low + last), (begin, end, name, round(1 - given / alone, 4), count, missing, extra)

            waiting: list[tuple] = []

            def offer(low: int, high: int, begin: int, end: int) -> None:
                window = low, high
                if window not in known:
                    known[window] = compared(low, high)
                if known[window]:
                    heappush(waiting, (known[window][0], window, begin, end))

            for window in self.windows(words):
                offer(*window[1:])
            taken, found = bytearray(len(words)), []
            while waiting:
                (*_, first, last), (low, high), begin, end = heappop(waiting)
                if 1 not in taken[first:last]:
                    taken[first:last] = b"\1" * (last - first)
                    found.append(known[low, high][1])
                elif 1 not in taken[begin:end]:
                    after = taken.find(1, end, high)
                    offer(max(low, taken.rfind(1, low, begin) + 1), high if after < 0 else after, begin, end)
            yield from sorted(found, key=lambda f: f[:2])


SCHEMA = (
    "doc_id long, block_begin long, block_end long, license string, reduction double, differences long, exact boolean, "
    "missing array<string>, extra array<string>"
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Confirmed licence notices of every document, one row each; their ranges don't overlap.

    Columns: doc_id, block_begin and block_end (characters of the notice itself), license, reduction,
    differences, exact (no differing word), missing and extra words.  Null and
    empty texts have none, repeated rows report each, null ids stay null.  The reduction is that of
    the notice's lower-cased words.  Templates of under ten words allow no differing word; a holder's name may stand for one word.
    """
    chosen = dict(templates or TEMPLATES)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        names = ("doc_id", "block_begin", "block_end", "license", "reduction", "differences", "exact", "missing", "extra")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
        for batch in sliced(batches, "text"):
            rows = [
                (key, *found[:5], found[4] == 0, *found[5:])
                for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for found in scanner.scan(text or "")
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return rows.mapInArrow(run, SCHEMA)
