"""Exact removal of repeated passages, found by sorting suffixes.

A string of ``length`` bytes is a repeat if it also starts earlier (in a smaller doc_id, or before in the
same document). Every byte that a repeat covers is removed; overlaps count.

1. Each document is cut at content-defined anchors: the smallest hash of a 32-byte string within every
   window of ``length`` bytes. Equal strings hold equal anchors at equal places, so repeats meet at their
   anchor, and only anchors that occur again are looked at further.
2. An anchor's surroundings (all windows that it serves) are compared as a whole by hash: equal ones
   after the first are repeats. Each batch sends only its first of equals on.
3. Where one anchor has several different surroundings, these are joined to a string, in which what a
   group has in common is one symbol, and ``suffix_array`` sorts the suffixes. Neighbours in that order that
   agree on ``length`` bytes are a class; all but the earliest of a class are repeats.

An anchor with more than ``hot`` different surroundings is dealt out in slices of eight window starts, whose
key is what the slice's windows have in common, so that no anchor gathers in one task.

Rows that repeat a doc_id count as separate documents, in order of their text. A NULL text is empty; a NULL
doc_id comes first. Texts shorter than ``length`` stay whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketops.llm.common import MIX_A, Rolling, Scratch, mixed, parallelism, runs, steps, table_batches, utf8
from marketops.llm.suffix_sort import suffix_array

GRAM = 32
NO_ID = -(2**63)
SLICE = 8
#: Text whose equal surroundings are brought together before they are sent on.
BATCH_BYTES = 8_000_000
BLOB = "bucket int, payload binary"
MARKS = "key bigint, kind int, payload binary"
ANCHOR = [("gram", "u8"), ("around", "u8"), ("key", "i8"), ("copy", "i4"), ("at", "u4"), ("left", "u1"), ("last", "u1")]
SPAN = [("copy", "i4"), ("start", "u4"), ("end", "u4")]
OPEN = [("copy", "i4"), ("gram", "u8"), ("at", "u4"), ("left", "u1"), ("last", "u1"), ("hot", "u1")]


def pack(columns: dict[str, np.ndarray], kinds: list[tuple[str, str]]) -> bytes:
    """Columns one after another: equal neighbours then compress well."""
    n = len(columns[kinds[0][0]])
    return np.int64(n).tobytes() + b"".join(np.ascontiguousarray(columns[name], kind).tobytes() for name, kind in kinds)


def unpack(blobs: list[bytes], kinds: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in kinds}
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for name, kind in kinds:
            parts[name].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(p) if p else np.zeros(0, dict(kinds)[name]) for name, p in parts.items()}


def deal(columns: dict[str, np.ndarray], bucket: np.ndarray, kinds: list[tuple[str, str]]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.r_[0, np.flatnonzero(b[1:] != b[:-1]) + 1, len(b)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j > i:
            yield int(b[i]), pack({k: v[order[i:j]] for k, v in columns.items()}, kinds)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Per anchor: row, place, first and last window start it serves, its hash, and the hash of all it serves."""
    total = len(data)
    span = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if total < length:
        return {k: none for k in ("row", "at", "lo", "hi", "gram", "around")}
    rolling = Rolling(data)
    gram = rolling.fixed(GRAM)
    place = np.uint64(max(1, int(total).bit_length()))
    low = ((gram >> place) << place) | np.arange(len(gram), dtype=np.uint64)  # leftmost of the smallest
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    if not len(row):
        return {k: none for k in ("row", "at", "lo", "hi", "gram", "around")}
    counts = np.maximum(sizes - length + 1, 0)
    starts = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    low = low[starts]
    new = np.r_[True, (low[1:] != low[:-1]) | (row[1:] != row[:-1])]
    i = np.flatnonzero(new)
    lo, hi = starts[i], starts[np.r_[i[1:], len(row)] - 1]
    at = (low[i] & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    around = mixed(rolling.of(lo, hi + length) + (at - lo).astype(np.uint64) * MIX_A)
    return {"row": row[i], "at": at, "lo": lo, "hi": hi, "gram": gram[at], "around": around}


def find_anchors(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            copies = batch.column("copy").to_numpy(zero_copy_only=False).astype(np.int32)
            data, offsets = utf8(batch.column("text"))
            for first, after in steps(offsets, BATCH_BYTES):
                parts = []
                for i, j in steps(offsets[first : after + 1]):
                    i, j = i + first, j + first
                    local = offsets[i : j + 1] - offsets[i]
                    a = anchors(data[offsets[i] : offsets[j]], local, length)
                    row = a["row"]
                    parts.append({
                        "gram": a["gram"].astype(np.uint64), "around": a["around"].astype(np.uint64), "key": keys[i + row], "copy": copies[i + row], "at": a["at"] - local[row], "left": a["at"] - a["lo"], "last": a["at"] - a["hi"],
                    })
                c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
                if len(c["gram"]):
                    yield from sent(c, length, buckets)

    return run


def sent(c: dict[str, np.ndarray], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The first of equal surroundings by bucket of the anchor; the others as removed ranges."""
    order = np.lexsort((c["at"], c["copy"], c["key"], c["around"], c["gram"]))
    c = {k: v[order] for k, v in c.items()}
    again = np.r_[False, (c["gram"][1:] == c["gram"][:-1]) & (c["around"][1:] == c["around"][:-1])]
    out = [(b, p) for b, p in deal({k: v[~again] for k, v in c.items()}, (c["gram"][~again] % np.uint64(buckets)).astype(np.int64), ANCHOR)]
    for key, blob in spans_by_key({k: v[again] for k, v in c.items()}, length):
        out.append((-1 - int(mixed(np.array([key], np.int64).view(np.uint64))[0] % np.uint64(buckets)), np.int64(key).tobytes() + blob))
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["bucket", "payload"])


def spans_by_key(c: dict[str, np.ndarray], length: int) -> Iterator[tuple[int, bytes]]:
    """Removed ranges of each document from whole surroundings (``left``/``last`` count back from the anchor)."""
    start = c["at"].astype(np.int64) - c["left"]
    end = c["at"].astype(np.int64) - c["last"] + length
    yield from by_key({"key": c["key"], "copy": c["copy"], "start": start, "end": end}, SPAN)


def by_key(c: dict[str, np.ndarray], kinds: list[tuple[str, str]]) -> Iterator[tuple[int, bytes]]:
    if not len(c["key"]):
        return
    order = np.argsort(c["key"], kind="stable")
    k = c["key"][order]
    cuts = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
    c = {name: np.ascontiguousarray(c[name][order], kind) for name, kind in kinds}
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(k[i]), np.int64(j - i).tobytes() + b"".join(c[name][i:j].tobytes() for name, _ in kinds)


def mark_batches(rows: list[tuple[int, int, bytes]], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())], names=["key", "kind", "payload"])


def compare_surroundings(length: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, rows = [], []
        for batch in batches:
            for b, p in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if b < 0:
                    rows.append((int(np.frombuffer(p, np.int64, 1)[0]), 0, p[8:]))
                else:
                    blobs.append(p)
            yield from mark_batches(rows)
            rows = []
        if not blobs:
            return
        c = unpack(blobs, ANCHOR)
        order = np.argsort(c["gram"], kind="stable")
        gram = c["gram"][order]
        first = np.r_[True, gram[1:] != gram[:-1]]
        size = np.diff(np.r_[np.flatnonzero(first), len(gram)])
        order = order[np.repeat(size > 1, size)]  # an anchor that occurs once holds no repeat
        c = {k: v[order] for k, v in c.items()}
        if not len(order):
            return
        order = np.lexsort((c["at"], c["copy"], c["key"], c["around"], c["gram"]))
        c = {k: v[order] for k, v in c.items()}
        same = c["gram"][1:] == c["gram"][:-1]
        again = np.r_[False, same & (c["around"][1:] == c["around"][:-1])]
        rows += [(k, 0, p) for k, p in spans_by_key({k: v[again] for k, v in c.items()}, length)]
        c = {k: v[~again] for k, v in c.items()}
        first = np.r_[True, c["gram"][1:] != c["gram"][:-1]]
        size = np.diff(np.r_[np.flatnonzero(first), len(first)])
        each = np.repeat(size, size)
        c["hot"] = each > hot
        rows += [(k, 1, p) for k, p in by_key({k: v[each > 1] for k, v in c.items()}, OPEN)]
        yield from mark_batches(rows)

    return run


def open_surroundings(length: int, buckets: int):
    """Bytes around the anchors that are still undecided, dealt by anchor (hot ones: by slice)."""
    reach = length - GRAM
    kinds = [("group", "u8"), ("key", "i8"), ("copy", "i4"), ("at", "u4"), ("left", "u1"), ("last", "u1")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = np.arange(reach + length)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys, copies = batch.column("key").to_pylist(), batch.column("copy").to_pylist()
            parts = []
            for i, blobs in enumerate(batch.column("marks").to_pylist()):
                c = unpack(blobs, OPEN)
                c = {k: v[c["copy"] == copies[i]] for k, v in c.items()}
                if len(c["at"]):
                    parts.append({k: c[k].astype(np.int64) for k in ("at", "left", "last", "hot")} | {"gram": c["gram"], "key": np.full(len(c["at"]), keys[i]), "copy": np.full(len(c["at"]), copies[i]), "base": np.full(len(c["at"]), offsets[i])})
            if not parts:
                continue
            c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            for i in range(0, len(c["at"]), 20_000):
                d = {k: v[i : i + 20_000] for k, v in c.items()}
                d["group"] = d["gram"]
                if d["hot"].any():
                    d = sliced(d, data, reach)
                take = (d["base"] + d["at"])[:, None] + (cols - reach)
                inside = (cols >= (reach - d["left"])[:, None]) & (cols < (reach - d["last"] + length)[:, None])
                window = np.where(inside, data[np.clip(take, 0, max(len(data) - 1, 0))], 0).astype(np.uint8)
                bucket = (mixed(d["group"]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                b = bucket[order]
                cuts = np.r_[0, np.flatnonzero(b[1:] != b[:-1]) + 1, len(b)]
                out = [(int(b[x]), pack({k: d[k][order[x:y]] for k, _ in kinds}, kinds) + window[order[x:y]].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "payload"])

    return run


def sliced(d: dict[str, np.ndarray], data: np.ndarray, reach: int) -> dict[str, np.ndarray]:
    """Hot anchors: a row for each eight window starts; the key adds the bytes all eight windows have."""
    whole = d["hot"] == 0
    parts = [{k: v[whole] for k, v in d.items()}]
    rest = {k: v[~whole] for k, v in d.items()}
    rolling = Rolling(data)
    for near in range(0, reach + 1, SLICE):
        far = min(near + SLICE - 1, reach)
        some = (rest["last"] <= far) & (rest["left"] >= near)
        part = {k: v[some] for k, v in rest.items()}
        part["left"], part["last"] = np.minimum(part["left"], far), np.maximum(part["last"], near)
        # window starts lie near..far bytes before the anchor: all windows hold [anchor - near, anchor - far + length)
        start = part["base"] + part["at"]
        part["group"] = mixed(rolling.of(start - near, start - far + reach + GRAM) + part["gram"] + np.uint64(near))
        parts.append(part)
    return {k: np.concatenate([p[k] for p in parts]) for k in d}


def sort_surroundings(length: int, symbols: int = 60_000):
    reach = length - GRAM
    wide = reach + length
    kinds = [("group", "u8"), ("key", "i8"), ("copy", "i4"), ("at", "u4"), ("left", "u1"), ("last", "u1")]
    row_bytes = sum(np.dtype(k).itemsize for _, k in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [p for batch in batches for p in batch.column("payload").to_pylist()]
        if not blobs:
            return
        c = unpack(blobs, kinds)
        around = np.concatenate([np.frombuffer(p, np.uint8, offset=8 + int(np.frombuffer(p, np.int64, 1)[0]) * row_bytes).reshape(-1, wide) for p in blobs])
        content = np.zeros(len(around), np.uint64)
        for i in range(0, len(around), 10_000):
            part = around[i : i + 10_000]
            at = np.arange(len(part)) * wide
            content[i : i + 10_000] = Rolling(part.ravel()).of(at, at + wide)
        content = mixed(content + c["left"].astype(np.uint64) * np.uint64(256) + c["last"])
        order = np.lexsort((c["at"], c["copy"], c["key"], content, c["group"]))
        again = np.r_[False, (c["group"][order][1:] == c["group"][order][:-1]) & (content[order][1:] == content[order][:-1])]
        rows = [(k, 0, p) for k, p in spans_by_key({k: v[order[again]] for k, v in c.items()}, length)]
        order = order[~again]
        group = c["group"][order]
        cuts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
        size = np.diff(cuts)
        order = order[np.repeat(size > 1, size)]
        size = size[size > 1]
        ends = np.cumsum(size)
        i = 0
        while i < len(size):  # whole groups, about as many symbols at a time
            j = i + 1
            begin = ends[i] - size[i]
            while j < len(size) and (ends[j] - begin) * 24 <= symbols:
                j += 1
            some = order[begin : ends[j - 1]]
            rows += sorted_repeats({k: v[some] for k, v in c.items()}, around[some], size[i:j], length)
            i = j
        yield from mark_batches(rows)

    return run


def sorted_repeats(c: dict[str, np.ndarray], around: np.ndarray, size: np.ndarray, length: int) -> list[tuple[int, int, bytes]]:
    """Repeated windows within groups of different surroundings of one anchor, by suffix order."""
    reach, wide = length - GRAM, around.shape[1]
    n, cols = len(around), np.arange(around.shape[1])
    group = np.repeat(np.arange(len(size)), size)
    head = np.cumsum(size) - size
    left, last = c["left"].astype(np.int64), c["last"].astype(np.int64)
    begin, stop = reach - left, reach - last + length
    inside = (cols >= begin[:, None]) & (cols < stop[:, None])
    equal = inside & inside[head][group] & (around == around[head][group])
    alike_right = np.argmin(np.c_[equal[:, reach:], np.zeros(n, bool)], axis=1)
    alike_left = np.argmin(np.c_[equal[:, :reach][:, ::-1], np.zeros(n, bool)], axis=1)
    core_from = (reach - np.minimum.reduceat(alike_left, head))[group]
    core_to = (reach + np.minimum.reduceat(alike_right, head))[group]
    # Of two surroundings, nothing beyond the first byte that differs can be part of a repeat.
    pair = (size == 2)[group]
    begin_used, stop_used = np.where(pair, np.maximum(begin, core_from), begin), np.where(pair, np.minimum(stop, core_to + 1), stop)
    text = np.zeros((n, wide + 1), np.int64)
    text[:, :wide] = around
    text[:, :wide] += 1
    text[np.arange(n), core_from] = 257 + group  # what all of a group share is one symbol
    used = np.zeros((n, wide + 1), bool)
    used[:, :wide] = (cols >= begin_used[:, None]) & (cols < stop_used[:, None]) & ((cols <= core_from[:, None]) | (cols >= core_to[:, None]))
    text[:, wide], used[:, wide] = 0, True
    row_of, col_of = np.nonzero(used)
    order = np.array(suffix_array(text[used]), np.int64)
    row_of, col_of = row_of[order], col_of[order]
    keep = col_of <= core_from[row_of]
    row_of, col_of = row_of[keep], col_of[keep]
    in_core = row_of[col_of == core_from[row_of]]
    before = col_of < core_from[row_of]
    row_of, col_of = row_of[before], col_of[before]
    by_col = np.argsort(col_of, kind="stable")
    col_cuts = np.searchsorted(col_of[by_col], np.arange(reach + 2))

    rank = np.empty(n, np.int64)
    rank[np.lexsort((c["at"], c["copy"], c["key"]))] = np.arange(n)
    hashes = Rolling(around.ravel()).fixed(length)
    repeat = np.zeros((n, reach + 2), bool)
    for col in range(reach + 1):
        one = row_of[by_col[col_cuts[col] : col_cuts[col + 1]]]
        two = in_core[core_from[in_core] <= col]
        rows = np.concatenate([one, two])
        rows = rows[(begin[rows] <= col) & (col <= reach - last[rows])]
        if len(rows) < 2:
            continue
        value = hashes[rows * wide + col]
        new = np.r_[True, (value[1:] != value[:-1]) | (group[rows][1:] != group[rows][:-1])]
        heads = np.flatnonzero(new)
        earliest = np.minimum.reduceat(rank[rows], heads)
        repeat[rows, col] = rank[rows] > earliest[np.cumsum(new) - 1]
    on = np.diff(np.c_[np.zeros(n, np.int8), repeat.astype(np.int8)], axis=1)
    row, start = np.nonzero(on == 1)
    _, end = np.nonzero(on == -1)
    place = c["at"][row].astype(np.int64) - reach
    found = {"key": c["key"][row], "copy": c["copy"][row], "start": place + start, "end": place + end - 1 + length}
    return [(k, 0, p) for k, p in by_key(found, SPAN)]


def cut(characters: bool, rest: bool):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys, copies = batch.column("key").to_pylist(), batch.column("copy").to_pylist()
            kept, spans = [], []
            for i, blobs in enumerate(batch.column("marks").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                if not blobs:
                    kept.append(text.tobytes())
                    spans.append([])
                    continue
                c = unpack(blobs, SPAN)
                own = c["copy"] == copies[i]
                starts, ends = runs(c["start"][own].astype(np.int64), c["end"][own].astype(np.int64))
                keep, at = [], 0
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    keep.append(text[at:s].tobytes())
                    at = e
                left = b"".join([*keep, text[at:].tobytes()])
                kept.append(left.decode("utf-8", "ignore").encode() if characters else left)
                spans.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if k == NO_ID else k for k in keys], pa.int64()), pa.array(copies, pa.int32()), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary()), *([batch.column("rest")] if rest else [])],
                names=["doc_id", "copy", "n_bytes", "spans", "kept", *(["rest"] if rest else [])],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = 1000, carry: Sequence[str] = (), characters: bool = False) -> DataFrame:
    """(doc_id, copy, n_bytes, spans, kept): each document's removed byte ranges and its remaining bytes.

    ``copy`` numbers rows that share a doc_id, from 0. ``length`` is 64 to 200 bytes. Columns named in ``carry`` come
    along in a struct ``rest``. With ``characters`` the bytes of characters that a range cuts in two go too.
    """
    if not 64 <= length <= 200:
        raise ValueError("length must be 64 to 200")
    spark = docs.sparkSession
    parts = parallelism(spark)
    scratch = Scratch(spark)
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []
    rows = docs.select(key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *rest).repartition(parts, "key")
    numbered = rows.withColumn("copy", (F.row_number().over(Window.partitionBy("key").orderBy("text")) - 1).cast("int"))
    table = scratch.bucketed(numbered, parts, "key")

    # A bucket is a partition: a batch sends no more rows than partitions read them.
    anchored = table.mapInArrow(find_anchors(length, parts), BLOB).repartitionById(parts, "bucket")
    marks = scratch.store(anchored.mapInArrow(compare_surroundings(length, hot), MARKS))
    undecided = marks.where("kind = 1").groupBy("key").agg(F.collect_list("payload").alias("marks"))
    opened = table.join(undecided, "key").mapInArrow(open_surroundings(length, parts), BLOB).repartitionById(parts, "bucket")
    more = scratch.store(opened.mapInArrow(sort_surroundings(length), MARKS))
    spans = marks.where("kind = 0").unionByName(more).groupBy("key").agg(F.collect_list("payload").alias("marks"))
    fields = T._parse_datatype_string("doc_id bigint, copy int, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary").fields
    schema = T.StructType([*fields, *[f for f in table.schema.fields if f.name == "rest"]])
    return table.join(spans, "key", "left").mapInArrow(cut(characters, bool(carry)), schema)
