"""FLAC media columns: encode samples, decode Rice residuals and linear predictors, verify checksums.

``encode_column`` stores bytes as one-channel 8-bit samples (value minus 128) in complete FLAC streams with a seek
table; each frame takes the fixed predictor of order 0 to 2 with one Rice partition, a constant, or plain samples,
whichever is shortest. ``decode_column`` reads FLAC streams back, checks the header and frame checksums and the MD5 of all
samples, and gives PCM together with the sample and byte offset of every frame, so a reader can start at any block.

Many frames are decoded side by side: each step reads the next residual of every frame of a batch. Frames with several
Rice partitions, escapes, LPC predictors, wasted bits or two channels go through a general reader, one at a time.

A NULL column is NULL, an empty one has no frames. A damaged stream raises ``ValueError``, or gives NULL with ``strict=False``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketops.llm.common import bounded_batches, steps, utf8
from marketops.llm.pieces import worker_memory

RATE = 8000
BLOCK = 4096
#: Bytes whose frames are decoded side by side.
SIDE_BY_SIDE = 2_000_000


def _crc_table(poly: int, bits: int) -> list[int]:
    top, mask, table = 1 << (bits - 1), (1 << bits) - 1, []
    for value in range(256):
        crc = value << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & mask
        table.append(crc)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = CRC8[crc ^ b]
    return crc


def _once() -> dict:
    """What is worked out once per process, on first use. The module travels to executors by value, so it lies outside it."""
    return worker_memory("flac", dict)


def _crc16_by_distance(longest: int = 2 * BLOCK) -> np.ndarray:
    """What a byte adds to the checksum, by its distance from the end: the checksum is linear."""
    once = _once()
    if "crc16" not in once:
        once["crc16"] = _crc16_rows(longest)
    return once["crc16"]


def _crc16_rows(longest: int) -> np.ndarray:
    table = np.array(CRC16, np.uint16)
    rows = [table]
    for _ in range(longest - 1):
        before = rows[-1]
        rows.append(((before << np.uint16(8)) ^ table[before >> np.uint16(8)]).astype(np.uint16))
    return np.concatenate(rows)


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of ranges of a buffer, all at once; ranges lie one after another."""
    if not len(start):
        return np.zeros(0, np.uint16)
    table = _crc16_by_distance()
    if int(size.max()) > 2 * BLOCK:  # longer frames than our own
        out = []
        for s, n in zip(start.tolist(), size.tolist(), strict=True):
            crc = 0
            for b in data[s : s + n].tolist():
                crc = ((crc << 8) & 0xFFFF) ^ CRC16[(crc >> 8) ^ b]
            out.append(crc)
        return np.array(out, np.uint16)
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    away = np.repeat(size, size) - 1 - at
    values = table[away * 256 + data[np.repeat(start, size) + at]]
    return np.bitwise_xor.reduceat(values, first)


def _number(value: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if value < 0x80:
        return bytes([value])
    n = next(n for n in range(2, 8) if value < 1 << (5 * n + 1 if n < 7 else 36))
    tail = [0x80 | (value >> (6 * i)) & 0x3F for i in range(n - 1)][::-1]
    return bytes([(0xFF << (8 - n)) & 0xFF | (value >> (6 * (n - 1))), *tail])


def _frame_header(number: int, samples: int) -> bytes:
    once = _once()
    known = once.get((number, samples))
    if known is None:
        known = _new_frame_header(number, samples)
        if len(once) < 100_000:
            once[number, samples] = known
    return known


def _new_frame_header(number: int, samples: int) -> bytes:
    code = 0xC if samples == BLOCK else 0x7
    head = bytes([0xFF, 0xF8, code << 4 | 0x4, 0x02]) + _number(number)
    if samples != BLOCK:
        head += struct.pack(">H", samples - 1)
    return head + bytes([crc8(head)])


def _stream_header(md5: bytes, samples: int, sizes: list[int]) -> bytes:
    points = [(i * BLOCK, sum_, min(BLOCK, samples - i * BLOCK)) for i, sum_ in enumerate([0, *np.cumsum(sizes[:-1]).tolist()][: len(sizes)])]
    low, high = (min(sizes), max(sizes)) if sizes else (0, 0)
    info = struct.pack(">HH", BLOCK, BLOCK) + low.to_bytes(3, "big") + high.to_bytes(3, "big")
    info += ((RATE << 44) | (0 << 41) | (7 << 36) | samples).to_bytes(8, "big") + md5
    table = b"".join(struct.pack(">QQH", *p) for p in points)
    if len(table) >= 1 << 24:  # a metadata block holds no more: every so many frames has a point then
        every = -(-len(table) // ((1 << 24) - 18))
        table = b"".join(struct.pack(">QQH", *p) for p in points[::every])
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table


def encode(texts: list[np.ndarray]) -> list[bytes]:
    """FLAC streams of several byte strings, their frames coded side by side."""
    lengths = np.array([len(t) for t in texts], np.int64)
    frames_of = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(texts)), frames_of)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames_of) - frames_of, frames_of)
    count = np.minimum(BLOCK, lengths[owner] - number * BLOCK)
    flat = np.concatenate([*texts, np.zeros(0, np.uint8)])
    signed = (flat ^ 0x80).view(np.int8)
    bodies: list[bytes] = []
    if len(owner):
        first = np.cumsum(count) - count
        x = signed.astype(np.int16)
        frame = np.repeat(np.arange(len(owner), dtype=np.int32), count)
        inside = np.arange(len(x), dtype=np.int32) - first.astype(np.int32)[frame]
        best, order, rice, code = None, np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64), np.zeros(len(x), np.uint16)
        residual = x
        for o in range(3):
            if o:
                residual = np.r_[np.int16(0), np.diff(residual)]
            folded = ((residual << 1) ^ (residual >> 15)).astype(np.uint16)
            folded[inside < o] = 0  # warm-up samples are stored plainly
            mean = np.add.reduceat(folded, first, dtype=np.int64) / np.maximum(count - o, 1)
            k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1.0))), 0, 14).astype(np.int64)
            bits = np.add.reduceat(folded >> k[frame].astype(np.uint16), first, dtype=np.int64) + (count - o) * (1 + k) + 8 * o + 10
            bits[count <= o] = 1 << 40
            better = bits < best if best is not None else np.ones(len(owner), bool)
            best = np.where(better, bits, best) if best is not None else bits
            order[better], rice[better] = o, k[better]
            code = np.where(better[frame], folded, code)
        low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        constant = low == high
        plain = ~constant & (best >= 8 * count)
        heads = [_frame_header(n, c) for n, c in zip(number.tolist(), count.tolist(), strict=True)]
        head = np.array([len(h) for h in heads])
        bits = np.where(constant, 8, np.where(plain, 8 * count, best)) + 8
        size = head + -(-bits // 8) + 2
        start = np.cumsum(size) - size
        out = np.zeros(int(size.sum()) * 8, np.uint8)

        # Rice codes, bit by bit over all samples at once
        coded = ~(constant | plain)
        body = (start + head) * 8
        sample = coded[frame] & (inside >= order[frame])
        f, u = frame[sample], code[sample].astype(np.int32)
        k = rice.astype(np.int32)[f]
        quotient = u >> k
        length = quotient + 1 + k
        ends = np.cumsum(length, dtype=np.int64)
        opens = ends - length
        heads_at = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.zeros(0, np.int64)
        shift = np.zeros(len(owner), np.int64)
        shift[f[heads_at]] = opens[heads_at]
        at = opens + (body + 8 + 8 * order + 10 - shift)[f] + quotient
        out[at] = 1
        for b in range(int(k.max()) if len(k) else 0):
            some = k > b
            if some.all():
                out[at + 1 + b] = (u >> (k - 1 - b)) & 1
            else:
                out[at[some] + 1 + b] = (u[some] >> (k[some] - 1 - b)) & 1
        for b in range(4):
            out[body[coded] + 8 + 8 * order[coded] + 6 + b] = (rice[coded] >> (3 - b)) & 1
        packed = np.packbits(out)
        byte = start + head
        packed[byte] = np.where(constant, 0, np.where(plain, 2, (8 | order) << 1))
        packed[byte[constant] + 1] = low[constant].astype(np.int8).view(np.uint8)
        for o in range(2):
            some = coded & (order > o)
            packed[byte[some] + 1 + o] = signed[first[some] + o].view(np.uint8)
        some = plain[frame]
        packed[(byte[frame] + 1 + inside)[some]] = signed[some].view(np.uint8)
        where = np.repeat(start, head) + np.arange(int(head.sum())) - np.repeat(np.cumsum(head) - head, head)
        packed[where] = np.frombuffer(b"".join(heads), np.uint8)
        check = crc16(packed, start, size - 2)
        packed[start + size - 2], packed[start + size - 1] = check >> 8, check & 0xFF
        stream = packed.tobytes()
        bodies = [stream[s : s + n] for s, n in zip(start.tolist(), size.tolist(), strict=True)]
    result, at, f = [], 0, 0
    for n, m in zip(lengths.tolist(), frames_of.tolist(), strict=True):
        own = bodies[f : f + m]
        md5 = hashlib.md5(signed[at : at + n].tobytes()).digest()
        result.append(_stream_header(md5, n, [len(b) for b in own]) + b"".join(own))
        at, f = at + n, f + m
    return result


class Bits:
    """A reader of single fields, for headers and for the frames that are not decoded side by side."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        end = self.at + n
        if end > 8 * len(self.data):
            raise ValueError("the stream ends within a frame")
        piece = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big")
        self.at = end
        return (piece >> (-end % 8)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _subframe(bits: Bits, samples: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("bad subframe")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
    depth -= wasted
    if kind == 0:
        return np.full(samples, bits.signed(depth) << wasted, np.int64)
    if kind == 1:
        return np.array([bits.signed(depth) for _ in range(samples)], np.int64) << wasted
    if 8 <= kind <= 12:
        order, shift = kind - 8, 0
        weights = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]  # fixed values of the format
        x = [bits.signed(depth) for _ in range(order)]
    elif kind >= 32:
        order = kind - 31
        x = [bits.signed(depth) for _ in range(order)]
        precision = bits.take(4) + 1
        shift = bits.signed(5)
        weights = [bits.signed(precision) for _ in range(order)]
    else:
        raise ValueError("reserved subframe type")
    method, parts = bits.take(2), bits.take(4)
    if method > 1:
        raise ValueError("reserved residual method")
    wide = 4 + method
    for p in range(1 << parts):
        k = bits.take(wide)
        n = (samples >> parts) - (order if p == 0 else 0)
        raw = bits.take(5) if k == (1 << wide) - 1 else None
        for _ in range(n):
            if raw is None:
                u = bits.unary() << k | bits.take(k)
                e = (u >> 1) ^ -(u & 1)
            else:
                e = bits.signed(raw)
            guess = sum(w * x[-1 - i] for i, w in enumerate(weights))
            x.append(e + (guess >> shift if shift >= 0 else guess << -shift))
    return np.array(x, np.int64) << wasted


#: Block sizes by code (fixed values of the format); 6 and 7 read the size from the header.
SIZES = {1: 192, **{i: 144 << i for i in range(2, 6)}, **{i: 1 << i for i in range(8, 16)}}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _read_frame_header(data: bytes, at: int, depth: int, channels: int, block: int) -> tuple[int, int, int, int, int]:
    """(first sample, samples, channel code, depth, end of the header)"""
    if data[at : at + 1] != b"\xff" or len(data) < at + 6 or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame where one should start")
    variable, code, rate = data[at + 1] & 1, data[at + 2] >> 4, data[at + 2] & 0xF
    mode, bits = data[at + 3] >> 4, (data[at + 3] >> 1) & 7
    lead, i = data[at + 4], at + 5
    if lead < 0x80:
        number = lead
    else:
        n = 8 - (lead ^ 0xFF).bit_length()
        number = lead & ((1 << (7 - n)) - 1) if n < 7 else 0
        for b in data[i : i + n - 1]:
            number = number << 6 | b & 0x3F
        i += n - 1
    if code in (6, 7):
        n = code - 5
        samples = int.from_bytes(data[i : i + n], "big") + 1
        i += n
    elif code in SIZES:
        samples = SIZES[code]
    else:
        raise ValueError("reserved block size")
    i += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if i >= len(data) or crc8(data[at:i]) != data[i]:
        raise ValueError("the checksum of a frame header is wrong")
    return (number if variable else number * block), samples, mode, DEPTHS.get(bits, depth), i + 1


def _general_frame(data: bytes, body: int, samples: int, mode: int, depth: int) -> tuple[np.ndarray, int]:
    """Samples (frames x channels) and the end of the frame, checksum included."""
    bits = Bits(data, body)
    if mode <= 7:
        channels = [_subframe(bits, samples, depth) for _ in range(mode + 1)]
    elif mode == 8:
        left, side = _subframe(bits, samples, depth), _subframe(bits, samples, depth + 1)
        channels = [left, left - side]
    elif mode == 9:
        side, right = _subframe(bits, samples, depth + 1), _subframe(bits, samples, depth)
        channels = [right + side, right]
    elif mode == 10:
        mid, side = _subframe(bits, samples, depth), _subframe(bits, samples, depth + 1)
        mid = mid << 1 | side & 1
        channels = [(mid + side) >> 1, (mid - side) >> 1]
    else:
        raise ValueError("reserved channel assignment")
    return np.stack(channels, 1), -(-bits.at // 8) + 2


def _side_by_side(data: np.ndarray, body: np.ndarray, count: np.ndarray, order: np.ndarray, rice: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of frames with one Rice partition and a fixed predictor of order 0 to 2, and where their bits end."""
    by = np.argsort(-(count - order), kind="stable")
    left = (count - order)[by]
    order_, k = order[by], rice[by]
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.int64)
    word = padded[:-4] << 24 | padded[1:-3] << 16 | padded[2:-2] << 8 | padded[3:-1]
    at = body[by] * 8 + 8 + 8 * order_ + 10
    limit = 8 * len(data)
    residual = np.zeros((int(left.max()) if len(left) else 0, len(by)), np.int32)
    active = np.searchsorted(-left, -np.arange(len(residual)), side="left").tolist()
    full = 0xFFFFFFFF
    for i, n in enumerate(active):
        p, kk = at[:n], k[:n]
        v = (word.take(p >> 3, mode="clip") << (p & 7)) & full
        quotient = 1054 - ((v | 1).astype(np.float64).view(np.int64) >> 52)  # leading zeros, from the exponent
        if quotient.max() > 24:
            far = np.flatnonzero(quotient > 24)
            quotient[far] = [_zeros(data, int(p[x]), limit) for x in far]
        p = p + quotient + 1
        rest = (word.take(p >> 3, mode="clip") << (p & 7)) & full
        residual[i, :n] = (quotient << kk) | (rest >> (32 - kk))
        at[:n] = p + kk
    if len(at) and at.max() > limit:
        raise ValueError("the stream ends within a frame")
    residual = (residual >> 1) ^ -(residual & 1)
    out: list[np.ndarray] = [None] * len(by)
    columns = np.ascontiguousarray(residual.T)
    for j, f in enumerate(by.tolist()):
        o, n = int(order_[j]), int(left[j])
        start = data[body[f] + 1 : body[f] + 1 + o].view(np.int8).astype(np.int64)
        x = columns[j, :n].astype(np.int64)
        if o == 2:
            x = np.cumsum(np.r_[start[1] - start[0], x])[1:] if n else x
        if o:
            x = np.r_[start, start[-1] + np.cumsum(x)]
        out[f] = x
    ends = np.empty(len(by), np.int64)
    ends[by] = -(-at // 8) + 2
    return out, ends


def _zeros(data: np.ndarray, at: int, limit: int) -> int:
    n = 0
    while at + n < limit and not (data[(at + n) >> 3] >> (7 - ((at + n) & 7))) & 1:
        n += 1
    if at + n >= limit:
        raise ValueError("the stream ends within a frame")
    return n


def _open(stream: bytes) -> tuple[dict, int]:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, seek = 4, None, []
    while True:
        if at + 4 > len(stream):
            raise ValueError("the stream ends within its header")
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if len(block) < size or (kind == 0 and size < 34):
            raise ValueError("the stream ends within its header")
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            info = {"block": int.from_bytes(block[:2], "big"), "channels": (packed >> 41 & 7) + 1, "depth": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": block[18:34]}
        elif kind == 3:
            seek = [struct.unpack_from(">QQH", block, i) for i in range(0, len(block) - 17, 18)]
        at += 4 + size
        if last:
            break
    if info is None:
        raise ValueError("no stream information")
    return info | {"seek": seek}, at


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int, int]], dict]]:
    """Per stream: samples (n x channels), (first sample, byte offset, samples) of every frame, and its header."""
    heads = [_open(s) for s in streams]
    joined = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    # Frames that a full seek table names are decoded side by side, all streams at once.
    quick, frames = [], [[] for _ in streams]
    for s, (stream, (info, body)) in enumerate(zip(streams, heads, strict=True)):
        points = info["seek"]
        if info["channels"] == 1 and info["depth"] == 8 and points and sum(p[2] for p in points) == info["samples"]:
            for first, offset, _ in points:
                at = body + offset
                start, samples, mode, depth, inner = _read_frame_header(stream, at, info["depth"], 1, info["block"])
                if start != first:
                    raise ValueError("the seek table names another frame")
                frames[s].append([first, at, samples, None, None])
                kind = stream[inner] if inner < len(stream) else 255
                o = (kind >> 1) - 8
                head = int.from_bytes(stream[inner + 1 + o : inner + 3 + o], "big") if 0 <= o <= 2 else 0xFFFF
                if kind & 0x81 == 0 and 0 <= o <= 2 and mode == 0 and depth == 8 and head >> 10 == 0 and (head >> 6) & 15 != 15:
                    quick.append((s, len(frames[s]) - 1, base[s] + inner, samples, o, (head >> 6) & 15))
                elif kind == 2 and mode == 0 and depth == 8:  # plain samples
                    frames[s][-1][3:] = [np.frombuffer(stream, np.int8, samples, inner + 1).astype(np.int64)[:, None], inner + 1 + samples + 2]
                else:
                    frames[s][-1][3:] = _general_frame(stream, inner, samples, mode, depth)
        else:
            at, done = body, 0
            while done < info["samples"] or (not info["samples"] and at < len(stream)):
                start, samples, mode, depth, inner = _read_frame_header(stream, at, info["depth"], info["channels"], info["block"])
                x, end = _general_frame(stream, inner, samples, mode, depth)
                frames[s].append([start, at, samples, x, end])
                at, done = end, done + samples
    if quick:
        col = lambda i: np.array([q[i] for q in quick], np.int64)
        found, ends = _side_by_side(joined, col(2), col(3), col(4), col(5))
        for (s, f, *_), x, end in zip(quick, found, ends.tolist(), strict=True):
            frames[s][f][3:] = [x[:, None], end - int(base[s])]
    starts = np.array([base[s] + f[1] for s, own in enumerate(frames) for f in own], np.int64)
    sizes = np.array([f[4] - f[1] - 2 for own in frames for f in own], np.int64)
    if len(starts):
        if (starts + sizes + 2 > np.repeat(base[1:], [len(own) for own in frames])).any():
            raise ValueError("the stream ends within a frame")
        stored = joined[starts + sizes].astype(np.uint16) << np.uint16(8) | joined[starts + sizes + 1]
        if (crc16(joined, starts, sizes) != stored).any():
            raise ValueError("the checksum of a frame is wrong")
    out = []
    for (info, _), own in zip(heads, frames, strict=True):
        x = np.concatenate([f[3] for f in own]) if own else np.zeros((0, info["channels"]), np.int64)
        if info["samples"] and len(x) != info["samples"]:
            raise ValueError("samples are missing")
        if any(info["md5"]) and hashlib.md5(_little(x, info["depth"])).digest() != info["md5"]:
            raise ValueError("the MD5 of the samples is wrong")
        out.append((x, [(f[0], f[1], f[2]) for f in own], info))
    return out


def _little(x: np.ndarray, depth: int) -> bytes:
    width = (depth + 7) // 8
    if width == 1:
        return x.astype(np.int8).tobytes()
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(*x.shape, 8)[:, :, :width]).tobytes()


def pcm(x: np.ndarray, depth: int) -> bytes:
    """As in WAV files: 8-bit samples without sign, wider ones signed and little endian; channels interleave."""
    return (x + 128).astype(np.uint8).tobytes() if depth <= 8 else _little(x, depth)


def _without(df: DataFrame, *names: str, but: str) -> DataFrame:
    """Without columns of these names, whatever their case, the one to be read excepted."""
    new = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c == but or c.lower() not in new])


def blocks(decoded: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., block, sample, samples, pcm): one row per frame of ``decode_column``'s output, which starts at that sample of its stream; a stream without
    samples has none."""
    total = F.aggregate("seek", F.lit(0).cast("bigint"), lambda n, s: n + s["samples"])
    rows = decoded.where(total > 0).select(*[F.col(f"`{c}`") for c in keep], "pcm", (F.octet_length("pcm") / total).cast("int").alias("__width"), F.posexplode("seek").alias("block", "__at"))
    part = F.substring("pcm", (F.col("__at.sample") * F.col("__width") + 1).cast("int"), (F.col("__at.samples") * F.col("__width")).cast("int"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], "block", F.col("__at.sample").alias("sample"), F.col("__at.samples").alias("samples"), part.alias("pcm"))


def encode_column(df: DataFrame, column: str, to: str = "media") -> DataFrame:
    """Replace a binary column by its FLAC stream, and with it any other column of the new name; NULL stays NULL, repeated rows stay."""
    bounded_batches(df.sparkSession)
    df = _without(df, to, but=column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(column))
            for i, j in steps(offsets):
                media = encode([data[offsets[r] : offsets[r + 1]] for r in range(i, j)])
                part = batch.slice(i, j - i)
                known = part.column(column).is_valid().to_pylist()
                kept = [c for c in part.schema.names if c != column]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array([m if k else None for m, k in zip(media, known, strict=True)], pa.binary())], names=[*kept, to])

    return df.mapInArrow(run, T.StructType([*[f for f in df.schema.fields if f.name != column], T.StructField(to, T.BinaryType())]))


def decode_column(df: DataFrame, column: str = "media", strict: bool = True) -> DataFrame:
    """Add ``pcm``, ``seek`` (sample, byte, samples of each frame) and ``feature`` (a summary of the samples); input columns of these names are replaced."""
    df = _without(df, "pcm", "seek", "feature", but=column)
    point = pa.struct([("sample", pa.int64()), ("byte", pa.int64()), ("samples", pa.int32())])

    def one(stream: bytes):
        try:
            return decode([stream])[0]
        except ValueError:
            if strict:
                raise
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(column))
            for i, j in steps(offsets, SIDE_BY_SIDE):
                part = batch.slice(i, j - i)
                streams = part.column(column).to_pylist()
                try:
                    found = iter(decode([s for s in streams if s is not None]))
                    found = [None if s is None else next(found) for s in streams]
                except ValueError:
                    found = [None if s is None else one(s) for s in streams]
                seek = [None if f is None else [{"sample": a, "byte": b, "samples": n} for a, b, n in f[1]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([None if f is None else pcm(f[0], f[2]["depth"]) for f in found], pa.binary()), pa.array(seek, pa.list_(point)), pa.array([None if f is None else feature(f[0]) for f in found], pa.string())],
                    names=[*part.schema.names, "pcm", "seek", "feature"],
                )

    fields = T._parse_datatype_string("pcm binary, seek array<struct<sample: bigint, byte: bigint, samples: int>>, feature string").fields
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def feature(x: np.ndarray) -> str:
    """Peak, mean, energy and sign changes of the samples, from exact integer sums."""
    if not len(x):
        return "samples=0"
    y = x.astype(np.float64).ravel()  # sums stay below 2**53
    low = x[:, 0] < 0
    return f"samples={len(x)} peak={int(max(x.max(), -x.min()))} mean={y.sum() / y.size:.6f} energy={y.dot(y) / y.size:.6f} turns={int(np.count_nonzero(low[1:] != low[:-1]))}"
