import hashlib
import struct
import zlib

import numpy as np
import pytest

from marketops.llm import flac
from marketops.llm.queries import QUERIES


def samples():
    rng = np.random.default_rng(1)
    return [
        *[rng.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 2, 3, 64, 128, 4096, 4160, 9000, 12288)], np.full(5000, 7, np.uint8), np.cumsum(rng.integers(-2, 3, 10000)).astype(np.uint8),
        np.zeros(64, np.uint8), np.r_[np.zeros(4000, np.uint8), np.full(200, 255, np.uint8)], np.frombuffer(b"hello world " * 700, np.uint8), (128 + 100 * np.sin(np.arange(9000) / 50)).astype(np.uint8),
    ]


def test_round_trip_and_seek_points():
    texts = samples()
    media = flac.encode(texts)
    for text, stream, (x, seek, info) in zip(texts, media, flac.decode(media), strict=True):
        assert flac.pcm(x, 8) == text.tobytes()
        assert [p[0] for p in seek] == list(range(0, len(text), flac.BLOCK)) and info["samples"] == len(text)
        for _, at, _ in seek:
            assert stream[at : at + 2] == b"\xff\xf8"


@pytest.mark.parametrize("at", [-1, -40, -3000, 60])
def test_damage_is_noticed(at):
    stream = bytearray(flac.encode([np.frombuffer(b"some words of a longer text " * 300, np.uint8)])[0])
    stream[at] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""
        return self

    def rice(self, e, k):
        u = (e << 1) ^ (e >> 63)
        self.bits += "0" * (u >> k) + "1"
        return self.put(u, k)

    def bytes(self):
        return int(self.bits + "0" * (-len(self.bits) % 8), 2).to_bytes((len(self.bits) + 7) // 8, "big")


def stream_of(frame_body, samples, mode, depth, channels):
    head = bytes([0xFF, 0xF8, 0x70, mode << 4 | {8: 1, 16: 4}[depth] << 1, 0]) + struct.pack(">H", samples - 1)
    frame = head + bytes([flac.crc8(head)]) + frame_body
    crc = int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    info = struct.pack(">HH", 4096, 4096) + bytes(6) + (44100 << 44 | (channels - 1) << 41 | (depth - 1) << 36 | samples).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + frame + struct.pack(">H", crc)


def test_linear_prediction_partitions_escapes_and_stereo():
    rng = np.random.default_rng(2)
    left = np.cumsum(rng.integers(-20, 21, 64)).astype(int)
    side = rng.integers(-30, 31, 64).astype(int)
    w = Writer()
    # LPC of order 2, coefficients 7 and -3 over 2**2, two Rice partitions, the second as an escape of 12 bits
    w.put(0, 1).put(32 + 1, 6).put(0, 1).put(left[0], 16).put(left[1], 16).put(3, 4).put(2, 5).put(7, 4).put(-3, 4).put(0, 2).put(1, 4).put(4, 4)
    for i in range(2, 64):
        if i == 32:
            w.put(15, 4).put(12, 5)
        e = int(left[i]) - ((7 * int(left[i - 1]) - 3 * int(left[i - 2])) >> 2)
        w.rice(e, 4) if i < 32 else w.put(e, 12)
    # the side channel, one bit deeper, with two wasted bits, plain
    w.put(0, 1).put(1, 6).put(1, 1).put(1, 2)
    for s in side:
        w.put(int(s), 15)
    (x, seek, _), = flac.decode([stream_of(w.bytes(), 64, 8, 16, 2)])
    assert x[:, 0].tolist() == left.tolist() and x[:, 1].tolist() == (left - (side << 2)).tolist()
    assert flac.pcm(x, 16) == x.astype("<i2").tobytes()


def test_a_published_stream():
    # Fixed value: the first example stream of RFC 9639, appendix D.
    raw = bytes.fromhex("664c61438000002210001000" "00000f00000f0ac442f00000" "00013e84b41807dc69030758" "6a3dad1a2e0ffff869180000" "bf0358fd03128baa9a")
    (x, seek, info), = flac.decode([raw])
    assert x.tolist() == [[25588, 10416]] and info["depth"] == 16
    assert hashlib.md5(flac.pcm(x, 16)).hexdigest() == "3e84b41807dc690307586a3dad1a2e0f"


def test_blocks_start_at_their_samples(spark):
    texts = [bytes([i % 251 for i in range(n)]) for n in (0, 64, 4096, 4097, 12_345)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw binary")
    rows = flac.blocks(flac.decode_column(flac.encode_column(df, "raw")), ["id"]).orderBy("id", "block").collect()
    assert [(r.id, r.block, r["sample"]) for r in rows] == [(i, b, b * flac.BLOCK) for i, t in enumerate(texts) for b in range(-(-len(t or b"") // flac.BLOCK))]
    for i, t in enumerate(texts):
        mine = [r for r in rows if r.id == i]
        assert b"".join(bytes(r.pcm) for r in mine) == (t or b"") and all(len(r.pcm) == r.samples for r in mine)


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(b"abc" * 50, 1, 2, 3, 4, 5)] * 2, "raw binary, pcm int, Seek int, feature int, media int, id int")
    rows = flac.decode_column(flac.encode_column(df, "raw")).collect()
    assert [bytes(r.pcm) for r in rows] == [b"abc" * 50] * 2 and sorted(rows[0].asDict()) == ["feature", "id", "media", "pcm", "seek"]


def test_columns(spark, awkward, nothing):
    media = flac.encode_column(awkward.selectExpr("doc_id", "cast(text as binary) AS raw"), "raw")
    for r in flac.decode_column(media).collect():
        assert (r.media is None) == (r.pcm is None)
    broken = spark.createDataFrame([(1, b"fLaC no"), (2, None)], "id int, media binary")
    assert [r.pcm for r in flac.decode_column(broken, strict=False).collect()] == [None, None]
    assert flac.decode_column(flac.encode_column(nothing.selectExpr("cast(text as binary) AS raw"), "raw")).collect() == []


def test_query(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_flac"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id]
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = flac.encode([np.frombuffer(payload, np.uint8)])[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
