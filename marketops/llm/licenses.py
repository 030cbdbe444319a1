"""License notices by conditional compression.

A block is the text around a cue word. It is compressed alone and with each template as a raw dictionary; what the
dictionary saves, over what it saves on the template itself, ranks the templates; it leaves none out, as a block that holds a
similar notice compresses the next one well by itself and gains little. Each template is aligned with
the block word by word, and the words that differ decide: few enough, and none that carries a digit or is one of the
template's names. All stretches near enough are taken, the nearest first, and what they leave over is aligned anew until
no template is near any of it. Only then are rewordings beyond the tolerance listed, by what the words left over gain.

Blocks reach as far on both sides of a cue as the longest stretch within the tolerance has words; blocks that touch are one, and
long ones are cut with that much overlap, so every notice lies whole in a block. Texts without a cue give no rows,
as do NULL and empty texts. Repeated rows give repeated rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUE = r"(?i)licen[cs]|copyright|copyleft|permission|warrant|redistribut|spdx|public domain"
#: The same before words are joined by one space; between them may be what Python takes for white space.
RAW_CUE = CUE.replace("(?i)", "(?iU)").replace(" ", r"[\s\x1c-\x1f]+")
WORD = re.compile(r"\S+")

_EITHER = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."

#: Notices by SPDX name; "-text" marks conditions or a sentence of the full text, "-header" the usual file header.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause-text": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-2.0-or-later": _EITHER.format("program", ";", "", ";", "2"),
    "GPL-3.0-or-later": _EITHER.format("program", ":", "", ",", "3"),
    "LGPL-2.1-or-later": _EITHER.format("library", ";", "Lesser ", ";", "2.1"),
    "LGPL-3.0-or-later": _EITHER.format("library", ":", "Lesser ", ",", "3"),
    "AGPL-3.0-or-later": _EITHER.format("program", ":", "Affero ", ",", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Identifier lines; two words, so they must be exact.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0+",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0+", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
TEMPLATES |= {f"{name}-spdx": f"SPDX-License-Identifier: {name}" for name in SPDX}
SCHEMA = "doc_id bigint, first_word bigint, n_words int, license string, gain double, differences int, wording string, confirmed boolean"


def plain(word: str) -> str:
    return word.strip(".,;:()[]\"'*/#").lower()


def costs(block: list[str], template: list[str]) -> np.ndarray:
    """Row i, column j: fewest word edits that turn some stretch of the block, ending before word j, into the template's first i words."""
    n, m = len(block), len(template)
    codes: dict[str, int] = {}
    coded = np.array([codes.setdefault(w, len(codes)) for w in block], np.int64)
    cost = np.zeros((m + 1, n + 1), np.int64)
    cost[:, 0] = np.arange(m + 1)
    for i in range(1, m + 1):
        same = coded == codes.get(template[i - 1], -1)
        step = np.minimum(cost[i - 1, :-1] + ~same, cost[i - 1, 1:] + 1)
        row = np.r_[i, step]
        cost[i] = np.minimum.accumulate(row - np.arange(n + 1)) + np.arange(n + 1)  # words only the block has
    return cost


def trace(cost: np.ndarray, block: list[str], template: list[str], end: int) -> tuple[int, list[str]]:
    """(start, wording) of the stretch that ends there."""
    i, j, wording = len(template), end, []
    while i > 0:
        if j and cost[i, j] == cost[i - 1, j - 1] + (block[j - 1] != template[i - 1]):
            if block[j - 1] != template[i - 1]:
                wording.append(f"{template[i - 1]}>{block[j - 1]}")
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            wording.append(f"-{template[i - 1]}")
            i -= 1
        else:
            wording.append(f"+{block[j - 1]}")
            j -= 1
    return j, wording[::-1]


def align(block: list[str], template: list[str]) -> tuple[int, int, int, list[str]]:
    """Fewest word edits that turn some stretch of the block into the template: (edits, start, end, wording)."""
    cost = costs(block, template)
    end = int(cost[-1].argmin())
    start, wording = trace(cost, block, template, end)
    return int(cost[-1, end]), start, end, wording


def align_all(block: list[str], template: list[str], most: float) -> Iterator[tuple[int, int, int, list[str]]]:
    """Every stretch with so many edits at most, as ``align`` gives one; the nearest first, none over another."""
    cost = costs(block, template)
    used = np.zeros(len(block), bool)
    for end in map(int, np.argsort(cost[-1], kind="stable")):
        if cost[-1, end] > most:
            break
        if end and not used[end - 1]:
            start, wording = trace(cost, block, template, end)
            if start < end and not used[start:end].any():
                used[start:end] = True
                yield int(cost[-1, end]), start, end, wording


class Scanner:
    def __init__(self, templates: Mapping[str, str], least_gain: float, tolerance: float):
        self.least_gain, self.tolerance = least_gain, tolerance
        self.alone = zstandard.ZstdCompressor(level=9)
        self.words = {name: [plain(w) for w in WORD.findall(text)] for name, text in templates.items()}
        self.counts = {name: Counter(template) for name, template in self.words.items()}
        self.reach = max(len(template) + int(tolerance * len(template)) for template in self.words.values())
        self.with_, self.own = {}, {}
        for name, text in sorted(templates.items()):
            raw = text.encode()
            dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.with_[name] = zstandard.ZstdCompressor(level=9, dict_data=dictionary)
            self.own[name] = max(1, len(self.alone.compress(raw)) - len(self.with_[name].compress(raw)))

    def spans(self, words: list[str]) -> list[list[int]]:
        """The surroundings of all cues; those that touch are one."""
        cue = re.compile(CUE)
        spans: list[list[int]] = []
        for i, w in enumerate(words):
            if cue.search(w) or (i + 1 < len(words) and cue.search(f"{w} {words[i + 1]}")):
                a, b = max(0, i - self.reach), min(len(words), i + self.reach + 2)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        return spans

    def blocks(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        step = 6 * self.reach
        for s in range(a, max(a + 1, b - 2 * self.reach), step):
            yield s, min(b, s + step + 2 * self.reach)

    def scan(self, text: str) -> Iterator[tuple[int, int, str, float, int, str, bool]]:
        words = WORD.findall(text)
        plains = [plain(w) for w in words]
        free, rows = self.spans(words), []
        for find in (self._near, self._reworded):
            rest = []
            while free:
                a, b = free.pop()
                used = np.zeros(b - a, bool)
                for _, _, _, name, start, end, gain, edits, wording, good in sorted(c for s, e in self.blocks(a, b) for c in find(words, plains, s, e)):
                    if not used[start - a : end - a].any():  # else a nearer template has these words
                        used[start - a : end - a] = True
                        rows.append((start, end - start, name, round(gain, 6), edits, " ".join(wording), good))
                edges = np.flatnonzero(np.diff(np.r_[True, used, True])) + a
                (free if used.any() else rest).extend(edges.reshape(-1, 2).tolist())
            free = rest
        yield from sorted(rows)

    def _gains(self, words: list[str]) -> dict[str, float]:
        raw = " ".join(words).encode()
        size = len(self.alone.compress(raw))
        return {name: (size - len(c.compress(raw))) / self.own[name] for name, c in self.with_.items()}

    def _near(self, words: list[str], plains: list[str], a: int, b: int) -> Iterator[tuple]:
        """Candidates within the tolerance, in a form that sorts the nearest first, then the longest template and the greatest gain."""
        block = plains[a:b]
        count = Counter(block)
        # A template word is an edit unless the block has it, so what lacks too many needs no alignment.
        most = {name: self.tolerance * len(template) for name, template in self.words.items()}
        likely = [name for name, c in self.counts.items() if len(self.words[name]) - sum(min(n, count[w]) for w, n in c.items()) <= most[name]]
        found = [(name, *f) for name in likely for f in align_all(block, self.words[name], most[name])]
        gains = self._gains(words[a:b]) if found else {}
        for name, edits, start, end, wording in found:
            critical = any(c.isdigit() or c.isupper() for w in wording for c in self._exact(w, name))
            yield self._candidate(gains, name, edits, a + start, a + end, wording, not critical)

    def _reworded(self, words: list[str], plains: list[str], a: int, b: int) -> Iterator[tuple]:
        """Candidates beyond the tolerance: the nearest stretch of each template with the least gain."""
        gains = self._gains(words[a:b])
        for name, gain in gains.items():
            if gain >= self.least_gain:
                edits, start, end, wording = align(plains[a:b], self.words[name])
                if start < end:
                    yield self._candidate(gains, name, edits, a + start, a + end, wording, False)

    def _candidate(self, gains: Mapping[str, float], name: str, edits: int, start: int, end: int, wording: list[str], good: bool) -> tuple:
        size = len(self.words[name])
        return edits / size, -size, -gains[name], name, start, end, gains[name], edits, wording, good

    def _exact(self, edit: str, name: str) -> str:
        """What of an edit must not differ: digits, and the parts of the template's name, given in capitals."""
        parts = set(re.split(r"[-.]", name.lower()))
        touched = [w for w in re.split(r"[->+]", edit) if w]
        return "".join(w.upper() if w in parts else "".join(c for c in w if c.isdigit()) for w in touched)


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least_gain: float = 0.5, tolerance: float = 0.2) -> DataFrame:
    """One row per notice: where it stands (in words), the nearest template, its gain in the block, the words that differ, and whether
    they leave it confirmed. ``least_gain`` is asked of rewordings beyond the tolerance only, which are never confirmed. Of templates equally near the longest counts, then the gain; ties of gain go to the first name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least_gain, tolerance)
        names = ["doc_id", "first_word", "n_words", "license", "gain", "differences", "wording", "confirmed"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.bool_()]
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                rows += [(batch.column("doc_id")[i].as_py(), *r) for r in scanner.scan(batch.column("text")[i].as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    candidates = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(RAW_CUE))
    return candidates.mapInArrow(run, SCHEMA)
