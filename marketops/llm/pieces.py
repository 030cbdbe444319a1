"""Cutting text where no pre-token can lie across, so that each distinct piece is encoded once per worker.

The byte-level patterns take white space only at the start of a match. A single space between two other
characters is therefore always a border, and the text from one such space up to the next one can be encoded alone.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marketops.llm.common import utf8

BORDER = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of text that are cut at a time: the more, the fewer distinct pieces to look up.
CUT_BYTES = 2_000_000
#: Bytes that are white space or part of a longer character.
MAYBE_SPACE = np.array([b >= 128 or chr(b).isspace() for b in range(256)])
#: Pieces a worker remembers; the memory it takes is some 200 bytes a piece.
REMEMBERED = 150_000
#: Longer strings are not remembered, so that the memory stays bounded in texts without spaces.
LONGEST = 64


def split(text: str) -> list[str]:
    """Pieces of a text; all but the first stand for themselves after one space."""
    found = text.split(" ")
    for piece in found:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return BORDER.split(text)
    return found


def worker_memory(name: str, make: Callable[[], object]):
    """What a Python worker keeps from task to task, made when first asked for."""
    store = sys.modules.setdefault("marketops_worker_memory", types.ModuleType("marketops_worker_memory")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


class Memory:
    """A bounded memory of two generations: what was not asked for since the last turn is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key: str):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.limit:
            self.turn()
        self.young[key] = value

    def turn(self) -> None:
        self.young, self.old = {}, self.young

    def all(self, keys: list[str], make: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
        """The values of distinct keys, in order; ``make`` gets a list of those that are not known and returns their values."""
        found = list(map(self.young.get, keys))
        gaps = [i for i, value in enumerate(found) if value is None]
        if gaps:
            if len(self.young) + len(gaps) > self.limit:
                self.turn()
            new = [keys[i] for i in gaps]
            values = list(map(self.old.get, new))
            todo = [i for i, value in enumerate(values) if value is None]
            if todo:
                for i, value in zip(todo, make([new[i] for i in todo]), strict=True):
                    values[i] = value
            self.young.update([pair for pair in zip(new, values, strict=True) if len(pair[0]) <= LONGEST])
            for i, value in zip(gaps, values, strict=True):
                found[i] = value
        return found


def loose(pieces: pa.Array, texts: list[str]) -> np.ndarray:
    """Which of the strings (given twice) are empty or have white space at an end."""
    data, offsets = utf8(pieces)
    found = offsets[1:] == offsets[:-1]
    ends = np.flatnonzero(~found)
    maybe = ends[MAYBE_SPACE[data[offsets[ends]]] | MAYBE_SPACE[data[offsets[ends + 1] - 1]]]
    found[maybe] = [texts[i][0].isspace() or texts[i][-1].isspace() for i in maybe.tolist()]
    return found


class PieceCache:
    """Encodings of pieces, kept by a Python worker over its tasks; those not met for long are forgotten.

    ``encode`` gets a list of strings and returns their encodings as bytes.
    """

    def __init__(self, name: str, encode: Callable[[list[str]], Iterable[bytes]], limit: int = REMEMBERED):
        self.first, self.later = worker_memory(name, lambda: ({}, Memory(limit)))
        self.encode = encode

    def alone(self, texts: Iterable[str]) -> dict[str, bytes]:
        """What begins a text, or is not cut by borders."""
        texts, first = set(texts), self.first
        known = {t: first[t] for t in texts & first.keys()}
        new = list(texts - known.keys())
        if new:
            made = dict(zip(new, self.encode(new), strict=True))
            if len(first) > REMEMBERED // 10:
                first.clear()
            first.update({t: value for t, value in made.items() if len(t) <= LONGEST})
            known |= made
        return known

    def after_space(self, pieces: list[str]) -> list[bytes]:
        return self.later.all(pieces, lambda new: self.encode([" " + p for p in new]))

    def by_borders(self, text: str) -> bytes:
        """The encoding of a text in which not every space is a border."""
        head, *rest = split(text)
        ends = [head]
        if rest and rest[-1][-1].isspace():
            ends.append(" " + rest.pop())
        known = self.alone(ends)
        distinct = list(set(rest))
        later = dict(zip(distinct, self.after_space(distinct), strict=True))
        return b"".join([known[head], *[later[p] for p in rest], *[known[p] for p in ends[1:]]])

    def __call__(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(the encodings of all texts, each followed by ``end``; where each text's ends). NULL counts as empty.

        Arrow cuts at all spaces and finds the distinct pieces, so that only these become Python objects.
        """
        texts = texts.fill_null("")
        n = len(texts)
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy()
        inner = np.ones(bounds[-1], bool)
        inner[bounds[:-1]] = False
        coded = cut.values.filter(pa.array(inner)).dictionary_encode()
        pieces, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        heads = cut.values.take(pa.array(bounds[:-1])).to_pylist()
        counts = np.diff(bounds) - 1
        # Texts with a space that is no border have a piece that is empty or has white space at such an end.
        odd = loose(coded.dictionary, pieces)
        owner = np.repeat(np.arange(n), counts)
        whole = np.array([bool(c) and (not h or h[-1].isspace()) for h, c in zip(heads, counts.tolist(), strict=True)], bool)
        whole[owner[odd[codes]]] = True
        values = dict.fromkeys(np.flatnonzero(odd).tolist(), b"")
        good = [p for i, p in enumerate(pieces) if i not in values] if values else pieces
        coding = iter(self.after_space(good))
        values = [values[i] if i in values else next(coding) for i in range(len(pieces))] if values else list(coding)
        at = np.flatnonzero(whole).tolist()
        full = {i: self.by_borders(texts[i].as_py()) for i in at}
        known = self.alone(h for i, h in enumerate(heads) if i not in full)
        starts = [full[i] if i in full else known[h] for i, h in enumerate(heads)]
        codes, counts = codes[~whole[owner]], np.where(whole, 0, counts)
        # A text is its beginning, its other pieces and the end.
        last = np.cumsum(counts + 2)
        order = np.empty(n + n + len(codes), np.int64)
        inner = np.ones(len(order), bool)
        first = last - counts - 2
        inner[first] = inner[last - 1] = False
        order[inner], order[first], order[last - 1] = codes, len(pieces) + np.arange(n), len(pieces) + n
        joined = pa.array([*values, *starts, end], pa.large_binary()).take(pa.array(order))
        ends = np.frombuffer(joined.buffers()[1], np.int64)[: len(order) + 1]
        return np.frombuffer(joined.buffers()[2], np.uint8)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint8), ends[last]
