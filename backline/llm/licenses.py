"""License scans by conditional compression.

Around every licensing cue of a text a candidate block is cut.  A block is compressed once by itself and once with
each template as a raw-content zstandard dictionary.  Every template that saves a share of ``SAVED`` or more of the bytes
is then aligned with the block word by word, and is reported only if enough of its words stand there in order; the report names the exact words that differ.

Defined cases: null and empty texts have no license; whole texts are read; repeated rows are scanned row by row; of
overlapping finds the one closer in wording (then the longer template, then the first name) stays; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

# Public wordings of notices, by SPDX name.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}

_CUE = re.compile(r"licen[cs]e|copyright|permission is|redistribut|public domain|free software|all rights|waived", re.I)
_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
SAVED, ALIKE = 0.2, 0.85


class Scanner:
    """Compressors and words of all templates; one per task."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.entries = []
        for name, wordings in templates.items():
            for text in wordings:
                data = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words = [w.lower() for w in _WORD.findall(text)]
                self.entries.append((name, words, zstandard.ZstdCompressor(level=19, dict_data=data, write_content_size=False)))
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False)

    def scan(self, text: str) -> list[tuple[str, int, int, float, float, str]]:
        """(license, start, end, share saved, likeness, differences), in order of start."""
        found = []
        for m in _CUE.finditer(text):
            found += self._around(text, m.start(), m.end())
        found.sort(key=lambda f: (-f[4], f[1] - f[2], f[0]))
        kept: list[tuple] = []
        for f in found:
            if all(f[2] <= k[1] or f[1] >= k[2] for k in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: f[1])

    def _around(self, text: str, cue: int, after: int) -> list[tuple]:
        ranked = []
        for name, words, compressor in self.entries:
            reach = sum(map(len, words)) + 2 * len(words)
            a, b = max(0, cue - reach), min(len(text), after + reach)
            block = text[a:b].encode()
            alone = len(self.plain.compress(block))
            size = sum(map(len, words)) + len(words)
            # a block is up to twice the template, of which the template can explain its own length
            share = (alone - len(compressor.compress(block))) / max(1, min(alone, size))
            ranked.append((-share, name, words, a, b))
        ranked.sort(key=lambda r: r[:2])
        out = []
        for share, name, words, a, b in ranked:
            if -share >= SAVED and (hit := self._wording(text, a, b, words)):
                out.append((name, *hit[:2], round(-share, 4), *hit[2:]))
        return out

    def _wording(self, text: str, a: int, b: int, template: list[str]) -> tuple[int, int, float, str] | None:
        """(start, end, likeness, differences) of the template's words between a and b."""
        spots = [(w.group().lower(), w.start() + a, w.end() + a) for w in _WORD.finditer(text[a:b])]
        block = [w for w, _, _ in spots]
        match = [x for x in difflib.SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if x.size]
        # leave out stray words far from the rest: the stretch with the best likeness
        best = None
        for i in range(len(match)):
            same = 0
            for j in range(i, len(match)):
                same += match[j].size
                n = match[j].a + match[j].size - match[i].a
                like = 2 * same / (n + len(template))
                if best is None or like > best[0]:
                    best = (like, match[i].a, match[i].a + n)
        if best is None or best[0] < ALIKE:
            return None
        like, low, high = best
        part = block[low:high]
        changes = []
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, template, part, autojunk=False).get_opcodes():
            if op != "equal":
                changes += [f"-{w}" for w in template[i1:i2]] + [f"+{w}" for w in part[j1:j2]]
        return spots[low][1], spots[high - 1][2], round(like, 4), " ".join(changes)


def license_spans(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """One row per notice: (doc_id, license, start, end, saved, likeness, differences); start and end in characters."""
    source = docs.select("doc_id", "text").where("text is not null")
    id_type = source.schema["doc_id"].dataType.simpleString()
    arrow_id = source.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    fields = [("doc_id", arrow_id), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()), ("likeness", pa.float64()), ("differences", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(i.as_py(), *f) for i, t in zip(batch.column(0), batch.column(1)) for f in scanner.scan(t.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    return source.mapInArrow(run, f"doc_id {id_type}, license string, start long, end long, saved double, likeness double, differences string")
