"""Byte-level BPE in linear time: Aho-Corasick matches and backtracking over compatible neighbours.

Tokens are mapped byte by byte to Latin-1 strings and matched by one automaton. A sequence of tokens is what the
merges give if and only if each two neighbours are what the merges give for their joined bytes. So the encoder
takes the longest match that is compatible with the token before; where none is, that position can never be a
border, and it goes one token back. Compatibility is decided once per pair of tokens and remembered.

A NULL text has no tokens and decodes to no bytes. Only the text column is read; all columns are kept.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketops.llm.common import bounded_batches, steps, utf8
from marketops.llm.pieces import CUT_BYTES, Memory, PieceCache, worker_memory

#: Pairs of tokens whose compatibility is remembered; beyond that the memory is emptied.
PAIRS = 1_000_000
#: Matches of the pattern whose ids are remembered.
WORDS = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[bytes, float]]] = {}
        self.words = Memory(WORDS)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def merged(self, raw: bytes, left: int = 1) -> list[bytes]:
        """The merges one by one, lowest rank first, until so many parts are left: for single tokens."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > left:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The parts of a token that touch its left (0) or right (1) end while the merges build it, from the whole down:
        each with the rank of the merge that ends it."""
        known = self.spines.get((token, side))
        if known is None:
            raw, ends = self.bytes_of[token], math.inf
            known = [(raw, ends)]
            while len(raw) > 1:
                parts = self.merged(raw, 2)
                ends = self.ranks[raw]
                raw = parts[-side]
                known.append((raw, ends))
            self.spines[token, side] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of both tokens' joined bytes end in these two: no part of the first is ever joined with
        a part of the second before one of them goes into its own token. Of equal ranks the left pair goes first."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            get = self.ranks.get
            known = not any(r is not None and r < x_ends and r <= y_ends for x, x_ends in self.spine(a, 1) for y, y_ends in self.spine(b, 0) for r in (get(x + y),))
            self.pairs[a, b] = known
        return known

    def word(self, raw: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # by start, shorter first
        for end, found in self.automaton.iter(raw.decode("latin-1")):
            at[end + 1 - found[1]].append(found)
        dead = bytearray(n + 1)
        ids: list[int] = []
        path: list[tuple[int, int]] = []
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            here = at[pos]
            while k >= 0:
                token, size = here[k]
                if not dead[pos + size] and (not ids or self.compatible(ids[-1], token)):
                    break
                k -= 1
            if k >= 0:
                path.append((pos, k))
                ids.append(token)
                pos += size
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                dead[pos] = 1
                pos, k = path.pop()
                ids.pop()
                k -= 1
        return ids

    def packed(self, match: str) -> bytes:
        """The ids of one match as 32-bit integers, remembered: pieces share words."""
        known = self.words.get(match)
        if known is None:
            known = array("i", self.word(match.encode())).tobytes()
            self.words.put(match, known)
        return known

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.packed, self.pattern.findall(text)))


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def _without(df: DataFrame, name: str) -> DataFrame:
    """The new column replaces one of its name, whatever its case."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of ``text``, each match of ``pattern`` encoded by itself, without special tokens."""
    bounded_batches(docs.sparkSession)
    docs = _without(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"byte_bpe {ranks_path} {pattern}"
        encoder = worker_memory(f"{name} encoder", lambda: Encoder(load_ranks(ranks_path), pattern))
        cache = PieceCache(name, lambda new: map(encoder.encode, new))
        for batch in batches:
            _, offsets = utf8(batch.column(text))
            for i, j in steps(offsets, CUT_BYTES):
                part = batch.slice(i, j - i)
                coded, ends = cache(part.column(text))
                yield _with(part, ids, pa.ListArray.from_arrays(pa.array(np.r_[0, ends] // 4, pa.int32()), pa.array(coded.view(np.int32))))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(coded: DataFrame, ranks_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the bytes that the token ids stand for; NULL ids give none, unknown ids are an error."""
    coded = _without(coded, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: token for token, rank in load_ranks(ranks_path).items()}.__getitem__
        for batch in batches:
            column = batch.column(ids)
            out = []
            for i in range(len(column)):
                values = column[i].values
                out.append(b"".join(map(token, values.to_numpy(zero_copy_only=False).tolist())) if values is not None else b"")
            yield _with(batch, to, pa.array(out, pa.binary()))

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField(to, T.BinaryType())]))
