"""License scans by conditional compression.

A document's lines that carry a license word are its candidate blocks (neighbouring ones join).
Notices in a block and in as many words around it as the longest template has are found by exact
wording: the part of the words nearest to a template is aligned with it, and the words inserted,
deleted and replaced are counted. A part is confirmed if those are at most ``MAX_DIFFERENCE`` of the
template's words and none of them tells licenses apart: names, versions and other numbers
(``TELLING``) must be the template's, each as often, with the word that follows not going on with
one. So a near relative, as another version, isn't confirmed, and stays a block without a license.

Templates are proposed by conditional compression: the words are compressed alone and with each template
as a zstandard raw dictionary, and the templates are ranked by the bytes they save. The wording accepts
or rejects them in that order, down to the last one. A confirmed part is taken out and what lies on
either side is ranked and searched again, so each notice is a row of its own. The saving that is
reported is the share of the part's own size. A block without a notice gets the template that saves most.

Defined cases: null and empty texts have no blocks; of confirmed templates that save nearly the same the one
with fewest differences counts, then the higher saving, then the first name; a confirmed part's own place is reported,
closing punctuation included; a block without a confirmed part, or what such parts leave of it if
that has a cue, is reported with a null license; repeated rows give repeated results; null doc_ids pass through; a very long line is
cut around its license words, so a block's size is bounded, but notices are looked for in the words
around it too; an empty table gives an empty table; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import ship_package

# Public wording of license notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-1.1": "Licensed under the Apache Software License, Version 1.1.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-2-Clause OR BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-header": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-1.0": "This work is licensed under the GNU General Public License, version 1.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.0": "This work is licensed under the GNU Lesser General Public License, version 2.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: SPDX identifiers whose identifier lines are notices.
IDENTIFIERS = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-1.1 MPL-2.0 Unlicense WTFPL Zlib".split()
TEMPLATES |= {f"{name}-identifier": f"SPDX-License-Identifier: {name}" for name in IDENTIFIERS}
TEMPLATES |= {
    "Apache-2.0-terms": "licensed under the terms of the Apache License 2.0",
    "GPL-2.0-terms": "Distributed under the GNU GPL version 2 license.",
    "GPL-3.0-name": "GPLv3 license",
    "GPL-3.0-terms": "Distributed under the GNU GPL version 3 license.",
    "MIT-name": "License: MIT",
    "MIT-terms": "licensed under the terms of the MIT license.",
}
# words of a cue may stand on two lines, with a comment mark between
_GAP = r"[\x20\t\r\n#*/;>%-]+"
CUE = rf"(?i)licen[sc]e|copyright|creative{_GAP}commons|public{_GAP}domain|redistribut|hereby{_GAP}granted|\bCC0\b"
_CUE = re.compile(CUE)
# a full stop joins digits only: a sentence may end without a space
_WORD = re.compile(r"[^\W_]+(?:(?:-|(?<=\d)\.(?=\d))[^\W_]+)*")
_CLOSING = re.compile(r"[^\w\s]*")

BLOCK_CHARS = 2000
#: Characters on either side of a block in which the words of a notice are looked for.
REACH_CHARS = 8000
MAX_DIFFERENCE = 0.2
#: Share of the winner's saved bytes from which another template's differences count as well.
NEARLY = 0.9
#: Parts of words that tell licenses apart.
TELLING = frozenset("affero agpl apache artistic attribution boost bsd by cc cc0 commons creative eclipse epl free gnu gpl isc lesser lgpl library mit mozilla mpl nc nd noncommercial noderivatives noderivs public sa sharealike unencumbered unported wtfpl zlib".split())
_NUMBER = re.compile(r"v?[0-9]+(?:\.[0-9]+)*")


def telling(word: str) -> tuple[str, ...]:
    """The parts of a word that tell licenses apart; numbers do, without closing zeros (2 is 2.0)."""
    if _NUMBER.fullmatch(word):
        return (_base(word.removeprefix("v")),)
    return tuple(p if p in TELLING else _base(p) for p in word.split("-") if p in TELLING or _NUMBER.fullmatch(p))


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidate blocks: lines with a cue, joined where they touch, a long line
    cut to a window around its cues."""
    out: list[list[int]] = []
    for m in _CUE.finditer(text):
        line = text.rfind("\n", 0, m.start()) + 1
        stop = text.find("\n", m.end())
        stop = len(text) if stop < 0 else stop
        a, b = max(line, m.start() - BLOCK_CHARS // 2), min(stop, m.end() + BLOCK_CHARS // 2)
        if out and a <= out[-1][1] + 1 and b - out[-1][0] <= 4 * BLOCK_CHARS:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _placed_words(text: str, start: int, end: int) -> tuple[list[str], list[tuple[int, int]]]:
    """Words of a part of the text, and their places in it."""
    hits = [(m.group().lower(), m.span()) for m in _WORD.finditer(text, start, end)]
    return [w for w, _ in hits], [p for _, p in hits]


def edits(template: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end in the block (exclusive, from 0): the least words inserted, deleted and replaced
    between the template and a part of the block that ends there, and the part's start."""
    n = len(block)
    one = np.int64(1 << 32)
    # edits in the high bits, the distance from the end in the low ones: of equal edits the shortest part
    steps = np.arange(n + 1) * one
    row = n - np.arange(n + 1, dtype=np.int64)
    for word in template:
        new = row + one
        np.minimum(new[1:], row[:-1] + (block != word) * one, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return row >> 32, n - (row & (one - 1))


def _base(word: str) -> str:
    return word.removesuffix(".0")


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import zstandard as zstd

        self.plain = zstd.ZstdCompressor(level=3)
        self.texts = {k: words(v) for k, v in sorted(templates.items())}
        self.counts = {k: Counter(v) for k, v in self.texts.items()}
        self.codes = {w: n for n, w in enumerate(sorted({w for v in self.texts.values() for w in v}))}
        self.coded = {k: self.code(v) for k, v in self.texts.items()}
        self.telling = {k: Counter(p for w in v for p in telling(w)) for k, v in self.texts.items()}
        # words on either side of a block that a notice with a word in it can reach
        self.reach = max(len(v) + int(MAX_DIFFERENCE * len(v)) for v in self.texts.values())
        self.known = {}
        for k, v in sorted(templates.items()):
            data = zstd.ZstdCompressionDict(v.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            self.known[k] = zstd.ZstdCompressor(level=3, dict_data=data)
        self.seen: dict[str, tuple] = {}

    def code(self, own: list[str]) -> np.ndarray:
        return np.array([self.codes.get(w, -1) for w in own], np.int64)

    def saving(self, name: str, block: str) -> float:
        data = block.encode("utf-8", "replace")
        return 1 - len(self.known[name].compress(data)) / len(self.plain.compress(data))

    def ranked(self, block: str) -> list[tuple[int, str]]:
        """(bytes saved, template) of all templates as dictionaries of a block, the highest first."""
        data = block.encode("utf-8", "replace")
        alone = len(self.plain.compress(data))
        return sorted(((alone - len(known.compress(data)), name) for name, known in self.known.items()), key=lambda x: (-x[0], x[1]))

    def wording(self, name: str, coded: np.ndarray, counts: Counter, own_telling: list[tuple[str, ...]]) -> tuple[int, int, int] | None:
        """(words that differ, first word, last word (exclusive)) of the part nearest to a template, if it is confirmed."""
        template = self.texts[name]
        limit = int(MAX_DIFFERENCE * len(template))
        if (self.counts[name] & counts).total() < len(template) - limit:
            return None
        cost, start = edits(self.coded[name], coded)
        ends = np.flatnonzero(cost <= limit)
        for end in ends[np.argsort(cost[ends], kind="stable")].tolist():
            a = int(start[end])
            if a < end and Counter(p for ps in own_telling[a:end] for p in ps) == self.telling[name]:
                return int(cost[end]), a, end
        return None

    def confirmed(self, text: str, own: list[str], places: list[tuple[int, int]]) -> tuple | None:
        """The confirmed part of some words of the text that saves most: (matching words, saving, template,
        first word, last word (exclusive), words that differ). Templates are proposed in order of the bytes
        they save; the first that the wording confirms counts, or one that saves nearly as much with
        fewer differences."""
        if not own:
            return None
        coded, counts, own_telling = self.code(own), Counter(own), [telling(w) for w in own]
        found, least = [], -math.inf
        for saved, name in self.ranked(text[places[0][0] : places[-1][1]]):
            if saved < least:
                break
            got = self.wording(name, coded, counts, own_telling)
            if got:
                least = max(least, NEARLY * saved)
                found.append((got[0], -saved, name, *got[1:]))
        if not found:
            return None
        wrong, _, name, a, end = min(found)
        return len(self.texts[name]) - wrong, self.saving(name, text[places[a][0] : places[end - 1][1]]), name, a, end, wrong

    def unconfirmed(self, block: str) -> tuple[float, int, int]:
        """(saving, words that differ, words of the template) of the template that saves most of a block."""
        if block in self.seen:
            return self.seen[block]
        name = self.ranked(block)[0][1]
        wrong = int(edits(self.coded[name], self.code(words(block)))[0].min())
        found = (round(self.saving(name, block), 6), wrong, len(self.texts[name]))
        if len(self.seen) < 100_000:
            self.seen[block] = found
        return found

    def notices(self, text: str, own: list[str], places: list[tuple[int, int]]) -> Iterator[tuple]:
        """(matching words, saving, template, start, end (after closing punctuation), words that differ) of
        the confirmed parts of some words of the text: the best, then those of what lies on either side."""
        rest = [(own, places)]
        while rest:
            own, places = rest.pop()
            best = self.confirmed(text, own, places)
            if best:
                match, saving, name, a, b, wrong = best
                yield match, saving, name, places[a][0], _CLOSING.match(text, places[b - 1][1]).end(), wrong
                rest += [(own[:a], places[:a]), (own[b:], places[b:])]

    def judge(self, text: str) -> list[tuple[int, int, str | None, float, int, int]]:
        """(start, end, license or None, saving, words that differ, words of the template), in order."""
        around = blocks(text)
        found = set()
        for a, b in around:
            own, places = _placed_words(text, max(0, a - REACH_CHARS), min(len(text), b + REACH_CHARS))
            first = bisect.bisect_left(places, (a, 0)) - self.reach
            last = bisect.bisect_left(places, (b, 0)) + self.reach
            found.update(self.notices(text, own[max(0, first) : last], places[max(0, first) : last]))
        # neighbouring blocks look at the same words: of overlapping parts the best stays
        kept: list[tuple] = []
        for x in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            at = bisect.bisect_left(kept, x[3], key=lambda y: y[3])
            if (at == 0 or kept[at - 1][4] <= x[3]) and (at == len(kept) or x[4] <= kept[at][3]):
                kept.insert(at, x)
        out = [(a, b, license_of(name), round(saving, 6), wrong, len(self.texts[name])) for _, saving, name, a, b, wrong in kept]
        starts = [x[3] for x in kept]
        for a, b in around:
            at = max(0, bisect.bisect_left(starts, a) - 1)
            while a < b:
                stop = kept[at][3] if at < len(kept) else b
                piece = text[a : min(b, stop)]
                if _CUE.search(piece):
                    left = a + len(piece) - len(piece.lstrip("\n")) if kept else a
                    piece = piece.strip("\n") if kept else piece
                    out.append((left, left + len(piece), None, *self.unconfirmed(piece)))
                if at == len(kept):
                    break
                a, at = max(a, kept[at][4]), at + 1
        return sorted(out, key=lambda x: x[:2])


def license_of(template: str) -> str:
    for form in ("-header", "-text", "-identifier", "-terms", "-name"):
        template = template.removesuffix(form)
    return template


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, start, end (code points), license (null: none confirmed), saving, n_differences and
    n_template_words of every candidate block. Only texts with a cue reach Python."""
    ship_package(docs.sparkSession)
    templates = templates or TEMPLATES
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["start", "end", "license", "saving", "n_differences", "n_template_words"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            owner, rows = [], []
            for n, data in enumerate(batch.column(1)):
                text = data.as_py().decode("utf-8", "replace")
                found = scanner.judge(text)
                owner += [n] * len(found)
                rows += found
            if rows:
                keys = batch.column(0).take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", *names])

    rows = docs.where(F.col("text").rlike(CUE)).select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, end bigint, license string, saving double, n_differences bigint, n_template_words bigint")
