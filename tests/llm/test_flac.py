import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tessera.llm.flac import BIAS, BLOCK, RATE, crc_of, decode_streams, encode_streams, flac_roundtrip, pcm_blocks, read_samples

R = np.random.default_rng(3)
TEXTS = [b"", b"a", b"hello world " * 200, bytes(R.integers(0, 256, 5000).astype(np.uint8)), b"\xff" * 600, b"x" * 575, b"x" * 576, b"y" * 577, bytes(106 + (90 * np.sin(np.arange(9000) / 20)).astype(int).astype(np.uint8)), b"\x00\xff" * 1000]


def encoded():
    data = np.frombuffer(b"".join(TEXTS), np.uint8)
    return encode_streams(data, np.concatenate([[0], np.cumsum([len(t) for t in TEXTS])]))


def test_roundtrip_and_seek():
    payloads, streams = encoded()
    assert payloads == [t + b"\xff" * (max(1, -(-len(t) // BLOCK)) * BLOCK - len(t)) for t in TEXTS]
    assert decode_streams(streams) == payloads
    for p, s in zip(payloads, streams, strict=True):
        for first, count in ((0, 10), (len(p) // 2, 700), (len(p) - 5, 50)):
            assert read_samples(s, first, count) == p[first : first + count]
    assert len(streams[8]) < len(payloads[8]) * 0.7


def test_damage_is_found():
    stream = bytearray(encoded()[1][2])
    for at in (len(stream) - 1, len(stream) - 100):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            decode_streams([bytes(bad)])


def bitstring(parts):
    bits = "".join(format(v & (1 << w) - 1, f"0{w}b") if w else "" for v, w in parts)
    return int((bits + "0" * (-len(bits) % 8) or "0"), 2).to_bytes((len(bits) + 7) // 8, "big")


def test_partitions_escapes_and_no_seek_table():
    """A hand-made stream: fixed order 2, two Rice partitions (one escaped, one of method 1), two frames, no seek table."""
    r = random.Random(1)
    samples = [[r.randrange(-20, 20) for _ in range(192)] for _ in range(2)]
    frames = b""
    for number, s in enumerate(samples):
        head = bytes([0xFF, 0xF8, 0x14, 0x02, number])
        head += bytes([int(crc_of(np.frombuffer(head, np.uint8), np.array([0]), np.array([5]), False)[0])])
        residual = [s[t] - 2 * s[t - 1] + s[t - 2] for t in range(2, 192)]
        parts = [(0b001010 << 1, 8), (s[0], 8), (s[1], 8), (1, 2), (1, 4), (31, 5), (9, 5)] + [(x, 9) for x in residual[:94]] + [(2, 5)]
        for x in residual[94:]:
            u = 2 * x if x >= 0 else -2 * x - 1
            parts += [(0, u >> 2), (1, 1), (u & 3, 2)]
        frame = head + bitstring([p for p in parts if p[1]])
        crc = int(crc_of(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]), True)[0])
        frames += frame + struct.pack(">H", crc)
    flat = np.array(sum(samples, []))
    info = struct.pack(">HH", 192, 192) + bytes(6) + (RATE << 44 | 7 << 36 | 384).to_bytes(8, "big") + hashlib.md5(flat.astype(np.int8).tobytes()).digest()
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frames
    assert np.frombuffer(decode_streams([stream])[0], np.uint8).astype(int).tolist() == ((flat + BIAS) % 256).tolist()


def test_operator(spark):
    texts = [None, "", "a", "a", "é" * 1000, "long text " * 30_000, "\x00"]
    df = spark.createDataFrame([(i if i != 3 else 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = sorted(tuple(r)[:5] for r in flac_roundtrip(df).collect())
    want = []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // BLOCK)) * BLOCK - len(b))
        want.append((i if i != 3 else 2, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == sorted(want)
    assert flac_roundtrip(df.limit(0)).count() == 0
    media = spark.createDataFrame([(b"k", encoded()[1][2])], "key binary, media binary")
    assert b"".join(r.pcm for r in pcm_blocks(media).orderBy("first_sample").collect()) == encoded()[0][2]
