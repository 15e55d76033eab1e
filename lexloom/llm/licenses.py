"""License scans by conditional compression.

A text's candidate blocks surround words that licenses use.  Each block's words,
in lower case with a blank between, are compressed by themselves and with every template as a raw zstandard dictionary.  A
dictionary pays for the first time that each of its phrases occurs, whatever else
stands in the block, so a template that stands there saves nearly what it saves
on its own text; templates that save less are dropped.  Words then show where a
winner stands, and how it differs.  Where several cover the same place, that place
is compressed with each, and the one that saves most bytes is reported.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import arrow_map
from .scratch import table

# Wordings of public licenses and of the usual notices.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.",),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
    "CC0-1.0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
}
#: What follows a wording, given by its first word and its license, in the license's whole body.
DISCLAIMERS = {
    ("Permission", "MIT"): (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Redistribution", "BSD-3-Clause"): (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("Permission", "ISC"): (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
}
DISCLAIMERS["Redistribution", "BSD-2-Clause"] = DISCLAIMERS["Redistribution", "BSD-3-Clause"]
#: Further identifiers of which only the tag is known.
IDENTIFIERS = (
    "AGPL-3.0-only AGPL-3.0-or-later Artistic-2.0 BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 GPL-2.0-only "
    "GPL-3.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later OFL-1.1 PostgreSQL Unlicense WTFPL Zlib"
)
# End of the fixed values.


def _whole() -> dict[str, tuple[str, ...]]:
    """TEMPLATES with whole bodies and with the tags of all identifiers."""
    out = dict(TEMPLATES)
    for (first, name), (rest,) in DISCLAIMERS.items():
        out[name] += tuple(f"{w} {rest}" for w in TEMPLATES[name] if w.startswith(first + " "))
    for name in IDENTIFIERS.split():
        out[name] = (*out.get(name, ()), f"SPDX-License-Identifier: {name}")
    return out


_TRIGGER = re.compile(
    rb"licen[sc]|copyright|public domain|permission|redistribut|free software|creative commons|spdx|warrant|unencumbered|"
    rb"released under|\bcc[ -]by|\bcc0|\bgpl|\bmozilla",
    re.I,
)
_WORD = re.compile(rb"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
#: Bytes of a block around each trigger, either way, as a multiple of the longest template's.
REACH = 1.5
#: A template must save this share of what it saves on its own text.  Measured on 3,540 texts that hold one, the least share is 0.38.
LEAST_SHARE = 0.15
#: Bytes of a block that are compressed at once, besides a template's length; pieces of either size overlap by half and that length.
PIECES = (512, 1_024)
#: Lengths are rounded up to a multiple of this, so that templates share their pieces.
ROUND = 256
#: With and without dictionary alike: the library's own choice depends on the dictionary's size.
_PARAMETERS = {"window_log": 15, "hash_log": 13, "chain_log": 14, "search_log": 5, "min_match": 4, "target_length": 64, "strategy": zstandard.STRATEGY_LAZY2}
#: Words that may differ, as a share of the template's; none in notices shorter than SHORT words, where each may name a license.
DIFFERENT, SHORT = 0.1, 20


def blocks(text: bytes, trigger: re.Pattern = _TRIGGER, reach: int = 1500) -> list[tuple[int, int]]:
    """Byte ranges around each trigger, to the next blank line or for ``reach`` bytes, joined where they touch or only blank lines part them."""
    out: list[tuple[int, int]] = []
    for m in trigger.finditer(text):
        low, high = max(0, m.start() - reach), min(len(text), m.end() + reach)
        start = text.rfind(b"\n\n", low, m.start())
        start = start + 2 if start >= 0 else low
        end = text.find(b"\n\n", m.end(), high)
        end = end if end >= 0 else high
        if out and (start <= out[-1][1] or not text[out[-1][1] : start].strip()):
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Scanner:
    """Templates as dictionaries, built once per task."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS, write_content_size=False)
        self.plain = zstandard.ZstdCompressor(compression_params=parameters)
        self.templates = []
        known = [w.encode() for wordings in templates.values() for w in wordings]
        self.reach = int(REACH * max(map(len, known), default=0))
        # A wording without any of the usual words is looked for by its longest one.
        own = {max(_WORD.findall(w), key=len, default=b"") for w in known if not _TRIGGER.search(w)} - {b""}
        self.trigger = re.compile(b"|".join([_TRIGGER.pattern, *(rb"\b%s\b" % re.escape(w) for w in sorted(own))]), re.I)
        for name, wordings in templates.items():
            for text in wordings:
                words = [w.lower() for w in _WORD.findall(text.encode())]
                data = b" ".join(words)
                raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                compressor = zstandard.ZstdCompressor(compression_params=parameters, dict_data=raw)
                own = len(self.plain.compress(data)) - len(compressor.compress(data))
                self.templates.append((name, words, compressor, own, -(-len(data) // ROUND) * ROUND))

    def scan(self, text: bytes) -> list[tuple[str, int, int, float, int, str, int]]:
        """(license, start byte, end byte, gain, differing places, the differences, differing words)."""
        out = []
        for start, end in blocks(text, self.trigger, self.reach):
            out += self.block(text[start:end], start)
        return out

    def saved(self, compressor: zstandard.ZstdCompressor, data: bytes, size: int) -> int:
        """Bytes that a template saves of ``data``, which has ``size`` by itself."""
        return size - len(compressor.compress(data))

    def winners(self, words: list[bytes]) -> list[int]:
        """Templates that save enough of a block's words, those first that save the largest share of their own."""
        shares, block, sizes = [], b" ".join(words), {}
        for _, _, compressor, own, length in self.templates:
            pieces = {block[at : at + size + length] for size in PIECES for at in range(0, max(1, len(block) - length), size // 2)}
            for piece in pieces - sizes.keys():
                sizes[piece] = len(self.plain.compress(piece))
            most = max(self.saved(compressor, piece, sizes[piece]) for piece in pieces)
            shares.append(most / max(own, 1))
        return [i for i in sorted(range(len(shares)), key=lambda i: -shares[i]) if shares[i] >= LEAST_SHARE]

    def block(self, block: bytes, offset: int) -> list[tuple[str, int, int, float, int, str, int]]:
        found = []
        places = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(block)]
        words = [w for w, _, _ in places]
        for i in self.winners(words):
            name, wanted, compressor, _, _ = self.templates[i]
            for first, last, n, changes in self.wordings(words, wanted):
                start, end = places[first][1], places[last - 1][2]
                covered = b" ".join(words[first:last])
                size = len(self.plain.compress(covered))
                saved = self.saved(compressor, covered, size)
                found.append((name, offset + start, offset + end, saved / size, len(changes), "; ".join(changes), n, saved))
        # Of those that cover the same the one that saves most is named.
        found.sort(key=lambda f: (-f[7], f[6], f[0]))
        kept: list[tuple] = []
        for f in found:
            if all(f[2] <= k[1] or f[1] >= k[2] for k in kept):
                kept.append(f)
        return [k[:7] for k in sorted(kept, key=lambda k: k[1])]

    @staticmethod
    def wordings(words: list[bytes], wanted: list[bytes]) -> list[tuple[int, int, int, list[str]]]:
        """Places where ``wanted`` stands in ``words``, with the number of words that differ, and how."""
        allowed = int(DIFFERENT * len(wanted)) if len(wanted) >= SHORT else 0
        out, at = [], 0
        anchor = 2 if len(wanted) > 2 else len(wanted)
        starts = [i for i in range(len(words) - anchor + 1) if words[i : i + anchor] == wanted[:anchor]] if allowed == 0 else None
        if starts is not None:
            return [(i, i + len(wanted), 0, []) for i in starts if words[i : i + len(wanted)] == wanted]
        # Each differing word breaks three triples at most; the others stand at nearly one distance.
        triples: dict[tuple, list[int]] = {}
        for j in range(len(wanted) - 2):
            triples.setdefault(tuple(wanted[j : j + 3]), []).append(j)
        votes = Counter(i - j for i in range(len(words) - 2) for j in triples.get(tuple(words[i : i + 3]), ()))
        least = max(1, len(wanted) - 2 - 3 * allowed)
        shifts = sorted(votes)
        for x, shift in enumerate(shifts):
            if shift + allowed < at or sum(votes[y] for y in shifts[x : x + 2 * allowed + 1] if y <= shift + 2 * allowed) < least:
                continue
            low = max(at, shift, 0)
            matcher = difflib.SequenceMatcher(None, words[low : shift + 3 * allowed + len(wanted)], wanted, autojunk=False)
            runs = [m for m in matcher.get_matching_blocks() if m.size]
            best = None
            for f in range(len(runs)):  # stray words before and behind may be left out
                if runs[f].b > allowed:
                    break
                n = runs[f].b
                for g in range(f, len(runs)):
                    if g > f:
                        before = runs[g - 1]
                        n += max(runs[g].a - before.a - before.size, runs[g].b - before.b - before.size)
                    whole = n + len(wanted) - runs[g].b - runs[g].size
                    if whole <= allowed and (best is None or whole < best[0]):
                        best = (whole, f, g)
            if best is None:
                continue
            n, f, g = best
            changes, a, c = [], runs[f].a, 0
            for m in [*runs[f : g + 1], difflib.Match(runs[g].a + runs[g].size, len(wanted), 0)]:
                if m.a > a or m.b > c:
                    changes.append(f"{b' '.join(wanted[c : m.b]).decode()} -> {b' '.join(words[low + a : low + m.a]).decode()}")
                a, c = m.a + m.size, m.b + m.size
            at = low + runs[g].a + runs[g].size
            out.append((low + runs[f].a, at, n, changes))
        return out


def _scanner(templates):
    def make():
        scanner = Scanner(templates)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = [
                (doc_id, *hit)
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist())
                if text
                for hit in scanner.scan(text)
            ]
            if not rows:
                return None
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_COLUMNS)

        return each

    return make


_COLUMNS = ["doc_id", "license", "start_byte", "end_byte", "gain", "n_differences", "differences", "n_words_different"]


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """License wordings in the whole texts of ``docs`` (doc_id, text), one row each.

    doc_id, license, start_byte, end_byte, gain (the share of its size that the
    template saves), n_differences and differences (changed places of the
    wording), and n_words_different there.  Where wordings overlap, the one that
    saves most bytes is named, of equal ones that with fewer differing words, then by
    name.  A notice under SHORT words must stand whole.  Null and empty texts hold none; rows that repeat are scanned
    each; a null doc_id stays null; empty tables give no rows; further columns
    are ignored.
    """
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, license string, start_byte long, end_byte long, gain double, n_differences long, differences string, n_words_different long"
    return arrow_map(light, _scanner(_whole() if templates is None else templates), schema, "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every wording found in ``documents``."""
    return scan_licenses(table(spark, sf_dir, "documents"))
