"""Token ids in flat binary files: unsigned integers plus 64-bit document offsets, read by memory map.

Documents are range-partitioned by doc_id. A partition becomes three files: ``.ids`` (16-bit if the vocabulary
allows, else 32-bit, little endian), ``.offsets`` (one 64-bit token offset per document and one end, from the
partition's start) and ``.docs`` (64-bit doc ids). The manifest has a row per partition; prefix sums over it
give every partition's base. A file is written under the task attempt's own name and renamed, so a repeated
task replaces it by the same content.

Texts are encoded as the tokenizer's plain call does without adding tokens: strings of its added tokens in a text become these tokens, unless
``added_as_text`` is set. A NULL text is empty (its one token is the end id). Rows that repeat a doc_id stay apart, ordered by text. Rows without
doc_id come first. Other columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketops.llm.common import Scratch, documents_of, parallelism, shared_dir, steps, utf8
from marketops.llm.pieces import CUT_BYTES, Memory, PieceCache, worker_memory

NO_ID = -(2**63)
#: Pieces and words whose ids a worker remembers, some 200 bytes each and two generations: words are coined throughout, and merging one anew costs more.
PIECES, WORDS = 400_000, 150_000
#: The texts that are split here: printable characters up to U+024F, spaces and line feeds. All engines for patterns agree about them.
LATIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250))]
LETTERS, DIGITS = ("".join(c for c in LATIN if unicodedata.category(c)[0] == kind) for kind in "LN")
UNCOMMON = re.compile(r"[^\x21-\x7e \n\xa1-\u024f]")
#: The split of byte-level tokenizers (fixed value) on such texts.
PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")
#: The alphabet of byte-level models: printable bytes stand for themselves, the others follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
OTHERS = [b for b in range(256) if b not in PRINTABLE]
ALPHABET = "".join(chr(b if b in PRINTABLE else 256 + OTHERS.index(b)) for b in range(256))
MANIFEST = "part string, n_docs bigint, n_tokens bigint, low bigint, width int"


def is_byte_level(tokenizer) -> bool:
    """Whether the tokenizer is a byte-level model without other steps, which splits by the usual pattern."""
    state = json.loads(tokenizer.to_str())
    before = state.get("pre_tokenizer") or {}
    return state.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and state["model"]["type"] == "BPE"


class Coder:
    """A tokenizer's ids of strings as bytes; made once in a worker, as loading takes longer than a megabyte of text."""

    def __init__(self, path: str, added_as_text: bool, end_id: int = 0):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = added_as_text
        #: Texts that hold such a string are encoded whole.
        self.added = [] if added_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        # A byte-level model takes words in its own alphabet.
        self.model = self.tokenizer.model if is_byte_level(self.tokenizer) else None
        self.words = Memory(WORDS)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, self.kind).tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, words: list[str]) -> list[bytes]:
        """Single matches of the pattern, by the model alone."""
        coded = codecs.charmap_decode("\0".join(words).encode(), "strict", ALPHABET)[0].split(ALPHABET[0])
        tokenize, code = self.model.tokenize, "H" if self.kind.itemsize == 2 else "I"
        return [array(code, [t.id for t in tokenize(c)]).tobytes() for c in coded]

    def matches(self, found: list[str]) -> list[bytes]:
        words = list(dict.fromkeys(found))
        return [*map(dict(zip(words, self.words.all(words, self.merged), strict=True)).__getitem__, found)]

    def pieces(self, new: list[str]) -> list[bytes]:
        """Strings that stand for themselves."""
        if not self.model:
            return self.whole(new)
        # No match of the pattern goes on from another character to a space: such strings are split in one go. Others, and those of rare characters, are not.
        bad = UNCOMMON.search("".join(new)) is not None
        rest = {p for p in new if p[:1] != " " or p[-1].isspace() or (bad and UNCOMMON.search(p))}
        joined = [p for p in new if p not in rest] if rest else new
        found = PATTERN.findall("".join(joined))
        ids = self.matches(found)
        ends = np.searchsorted(np.cumsum([*map(len, found)]), np.cumsum([*map(len, joined)])) + 1
        out = [b"".join(ids[i:j]) for i, j in pairwise([0, *ends.tolist()])]
        if not rest:
            return out
        rare = [p for p in rest if bad and UNCOMMON.search(p)]
        known = dict(zip(joined, out, strict=True)) | dict(zip(rare, self.whole(rare), strict=True))
        for p in rest - known.keys():
            known[p] = b"".join(self.matches(PATTERN.findall(p)))
        return [known[p] for p in new]

    def encode(self, texts: pa.Array, cache: PieceCache, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, each followed by ``end``; where each text's end, in bytes)"""
        holds = np.zeros(len(texts), bool)
        for string in self.added:
            holds |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        data, ends = cache(pc.if_else(pa.array(holds), "", texts) if holds.any() else texts, end)
        if not holds.any():
            return data, ends
        parts = [data[i:j].tobytes() for i, j in pairwise([0, *ends.tolist()])]
        held = np.flatnonzero(holds).tolist()
        for i, ids in zip(held, self.whole([texts[i].as_py() for i in held]), strict=True):
            parts[i] = ids + end
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([*map(len, parts)])


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None, parts: int | None = None, added_as_text: bool = False) -> DataFrame:
    """Write the files below ``folder`` (default: a new one in the shared folder); the stored manifest, with ``base``."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/marketops-tokens-{uuid.uuid4().hex}"
    rows = documents_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts or parallelism(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"tokens {tokenizer_path} {added_as_text} {end_id >> 16}"
        coder = worker_memory(f"{name} coder", lambda: Coder(tokenizer_path, added_as_text, end_id))
        cache, kind = PieceCache(name, coder.pieces, PIECES), coder.kind
        end = np.array([end_id], kind).tobytes()
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        task = TaskContext.get()
        part = f"{task.partitionId():06d}"
        mine = f"{path}/.{part}-{task.taskAttemptId()}"
        sizes, ids = [np.zeros(1, np.int64)], []
        with files.open_output_stream(f"{mine}.ids") as out:
            for batch in batches:
                _, offsets = utf8(batch.column("text"))
                for i, j in steps(offsets, CUT_BYTES):
                    texts = batch.column("text").slice(i, j - i)
                    data, ends = coder.encode(texts, cache, end)
                    out.write(data)
                    sizes.append(np.diff(ends, prepend=0) // kind.itemsize)
                ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
        if not ids:
            files.delete_file(f"{mine}.ids")
            return
        starts, docs_of = np.cumsum(np.concatenate(sizes)), np.concatenate(ids)
        for name, values in (("offsets", starts.astype("<u8")), ("docs", docs_of.astype("<i8"))):
            with files.open_output_stream(f"{mine}.{name}") as out:
                out.write(values.tobytes())
        for name in ("ids", "offsets", "docs"):
            files.move(f"{mine}.{name}", f"{path}/{part}.{name}")
        yield pa.RecordBatch.from_pylist([{"part": f"{folder}/{part}", "n_docs": len(docs_of), "n_tokens": int(starts[-1]), "low": int(docs_of[0]), "width": kind.itemsize}], pa.schema([("part", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("low", pa.int64()), ("width", pa.int32())]))

    manifest = Scratch(spark).store(rows.mapInArrow(run, MANIFEST))
    # One row per file: a window over all of them is small.
    before = Window.orderBy("low", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids): each document's position among all token ids, and its ids as 32-bit little endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = fs.FileSystem.from_uri(row["part"])
                kind = np.dtype("<u2" if row["width"] == 2 else "<u4")

                def whole(name: str, kind: np.dtype, files=files, path=path) -> np.ndarray:
                    if isinstance(files, fs.LocalFileSystem):
                        return np.memmap(f"{path}.{name}", kind, "r")
                    with files.open_input_file(f"{path}.{name}") as source:
                        return np.frombuffer(source.read(), kind)

                ids, offsets, docs = whole("ids", kind), whole("offsets", np.dtype("<u8")).astype(np.int64), whole("docs", np.dtype("<i8"))
                for i, j in steps(offsets, 500_000):
                    values = np.asarray(ids[offsets[i] : offsets[j]]).astype("<u4")
                    ends = (offsets[i : j + 1] - offsets[i]) * 4
                    coded = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())])
                    own = [None if d == NO_ID else d for d in docs[i:j].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(row["base"] + offsets[i:j]), coded.cast(pa.binary())], names=["doc_id", "start", "ids"])

    return manifest.repartition(parallelism(spark)).mapInArrow(run, "doc_id bigint, start bigint, ids binary")
