"""FLAC streams (mono, 8 bits): vectorised encoder and decoder over many frames at once.

The decoder follows the format: frame headers with CRC-8, constant, verbatim, fixed and linear-predictor subframes,
Rice partitions of both methods with escapes, frame CRC-16 and the stream's MD5. Frames that a seek table locates are
decoded side by side, one sample of all of them at a time; without one, the frames of a stream follow one another.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import text_chunks
from .storage import bounded_batches, shared_if_small, written

BLOCK = 576
RATE = 8000
#: Frames worked on side by side.
LANES = 4096
#: A sample is its byte minus BIAS, modulo 256, as a signed number: frequent text bytes become small samples.
BIAS = 106
ORDER = 2  # of the encoder's own linear predictors
PRECISION, SHIFT = 6, 5
BROADCAST_DIGESTS = 200_000

# Fixed values of the format: predictors of the fixed subframes, checksum polynomials.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_POLY8, _POLY16 = 0x07, 0x8005


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out, top, mask = np.arange(256, dtype=np.int64) << (bits - 8), 1 << (bits - 1), (1 << bits) - 1
    for _ in range(8):
        out = np.where(out & top, out << 1 ^ poly, out << 1) & mask
    return out.astype(np.uint16)


_CRC8, _CRC16 = _crc_table(_POLY8, 8), _crc_table(_POLY16, 16)


def crc_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, wide: bool) -> np.ndarray:
    """CRC-16 (or CRC-8) of data[starts:starts+lengths] for all ranges side by side."""
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    crc = np.zeros(len(starts), np.uint16)
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    for t, n in enumerate(active.tolist()):
        byte = data[at[:n] + t]
        c = crc[:n]
        crc[:n] = c << 8 ^ _CRC16[(c >> 8) ^ byte] if wide else _CRC8[c ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


# -- writing -------------------------------------------------------------------------------------------------------
def _put_bits(words: np.ndarray, position: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    """Add values of at most 24 bits at ascending bit positions to 32-bit big-endian words."""
    if not len(position):
        return
    index = position >> 5
    wide = value.astype(np.uint64) << (64 - (position & 31) - width).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    words[index[first]] += np.add.reduceat(wide >> np.uint64(32), first)
    words[index[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)


def _coded_numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded to 7, lengths) of the format's UTF-8-like frame numbers."""
    out = np.zeros((len(n), 7), np.uint8)
    size = np.select([n < 1 << 7, n < 1 << 11, n < 1 << 16, n < 1 << 21, n < 1 << 26, n < 1 << 31], [1, 2, 3, 4, 5, 6], 7)
    for k in range(1, 8):
        rows = np.flatnonzero(size == k)
        if not len(rows):
            continue
        v = n[rows]
        if k == 1:
            out[rows, 0] = v
            continue
        for j in range(k - 1, 0, -1):
            out[rows, j] = 0x80 | v & 0x3F
            v = v >> 6
        out[rows, 0] = (0xFF00 >> k & 0xFF) | v
    return out, size


def _linear_predictors(s: np.ndarray) -> np.ndarray:
    """Quantised least-squares coefficients (rows x ORDER) of each row of samples."""
    x = s.astype(np.float32)
    r = np.stack([(x[:, ORDER:] * x[:, ORDER - j : x.shape[1] - j]).sum(1) for j in range(ORDER + 1)], 1).astype(np.float64)
    lag = np.abs(np.subtract.outer(np.arange(ORDER), np.arange(ORDER)))
    matrix = r[:, lag] + np.eye(ORDER) * (1e-3 * r[:, :1, None] + 1)
    a = np.linalg.solve(matrix, r[:, 1:, None])[:, :, 0]
    return np.clip(np.rint(a * (1 << SHIFT)), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int32)


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zigzag values, parameter, bits) of each row, by the best of the two parameters next to the mean."""
    u = (residual << 1) ^ (residual >> 31)
    mean = u.mean(1) + 1e-9
    k = np.clip(np.floor(np.log2(mean * 0.7 + 0.5)), 0, 12).astype(np.int64)
    bits = [(u >> (k + d)[:, None]).sum(1) + u.shape[1] * (1 + k + d) for d in (0, 1)]
    better = bits[1] < bits[0]
    return u, k + better, np.where(better, bits[1], bits[0])


def to_samples(payload: np.ndarray) -> np.ndarray:
    return (payload - np.uint8(BIAS)).view(np.int8)


def to_payload(samples: np.ndarray) -> np.ndarray:
    return samples.astype(np.uint8) + np.uint8(BIAS)


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each frame) of rows of BLOCK bytes."""
    s = to_samples(samples).astype(np.int32)
    n = len(s)
    coefficients = _linear_predictors(s)
    predicted = sum(coefficients[:, j, None] * s[:, ORDER - 1 - j : BLOCK - 1 - j] for j in range(ORDER)) >> SHIFT
    choices = [(s, 0, 8), (np.diff(s, axis=1), 1, 8), (s[:, ORDER:] - predicted, ORDER, 8 + 9 + ORDER * PRECISION)]
    coded = [_rice(r) for r, _, _ in choices]
    cost = np.stack([bits + 10 + extra + 8 * order for (_, _, bits), (_, order, extra) in zip(coded, choices, strict=True)] + [np.full(n, 8 + 8 * BLOCK)], 1)
    kind = cost.argmin(1)
    size = cost[np.arange(n), kind]
    constant = (s == s[:, :1]).all(1)
    kind[constant], size[constant] = 4, 16
    number, number_size = _coded_numbers(numbers)
    head = 5 + number_size
    length = head + (size + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(int(start[-1]) // 4 * 4 + 12, np.uint8)
    words = np.zeros(len(out) // 4, np.uint64)
    body = 8 * (start[:-1] + head)
    for which, (_, order, _) in enumerate(choices):
        rows = np.flatnonzero(kind == which)
        if not len(rows):
            continue
        u, k = coded[which][0][rows], coded[which][1][rows]
        at = body[rows][:, None]
        fields = [(np.full(len(rows), (0b100000 | order - 1 if which == 2 else 0b001000 | order) << 1), 8)]
        fields += [(s[rows, j] & 0xFF, 8) for j in range(order)]
        if which == 2:
            fields += [(np.full(len(rows), PRECISION - 1 << 5 | SHIFT), 9)] + [(coefficients[rows, j] & (1 << PRECISION) - 1, PRECISION) for j in range(ORDER)]
        fields += [(k, 10)]  # method 0, partition order 0, parameter
        widths = np.array([w for _, w in fields])
        begin = at + np.concatenate([[0], np.cumsum(widths)[:-1]])
        _put_bits(words, begin.ravel(), np.stack([v for v, _ in fields], 1).ravel(), np.broadcast_to(widths, begin.shape).ravel())
        value_bits = (k + 1)[:, None]
        each = (u >> k[:, None]) + value_bits
        end = at + widths.sum() + np.cumsum(each, 1)
        value = (np.int64(1) << k)[:, None] | u & ((np.int64(1) << k) - 1)[:, None]
        _put_bits(words, (end - value_bits).ravel(), value.ravel(), np.broadcast_to(value_bits, end.shape).ravel())
    out[:] = (words & np.uint64(0xFFFFFFFF)).astype(">u4").view(np.uint8)
    rows = np.flatnonzero(kind == 3)
    if len(rows):
        out[start[rows] + head[rows]] = 0b000001 << 1
        out[(start[rows] + head[rows] + 1)[:, None] + np.arange(BLOCK)] = (s[rows] & 0xFF).astype(np.uint8)
    rows = np.flatnonzero(kind == 4)
    out[start[rows] + head[rows]] = 0
    out[start[rows] + head[rows] + 1] = (s[rows, 0] & 0xFF).astype(np.uint8)
    at = start[:-1]
    # Fixed block size of 576 (code 2), 8 kHz (code 4), mono, 8 bits (code 1).
    for j, byte in enumerate((0xFF, 0xF8, 0x24, 0x02)):
        out[at + j] = byte
    for j in range(int(number_size.max())):
        rows = np.flatnonzero(number_size > j)
        out[at[rows] + 4 + j] = number[rows, j]
    out[at + head - 1] = crc_of(out, at, head - 1, wide=False)
    crc = crc_of(out, at, length - 2, wide=True)
    out[at + length - 2], out[at + length - 1] = crc >> 8, crc & 0xFF
    return out[: start[-1]], length


def stream_header(payload: bytes, lengths: np.ndarray) -> bytes:
    """Stream marker, STREAMINFO and a seek table with a point for each frame."""
    digest = hashlib.md5(to_samples(np.frombuffer(payload, np.uint8)).tobytes()).digest()
    total = len(payload)
    info = struct.pack(">HH", BLOCK, BLOCK) + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + digest
    points = np.zeros(len(lengths), [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
    points["sample"] = np.arange(len(lengths)) * BLOCK
    points["offset"] = np.cumsum(lengths) - lengths
    points["samples"] = BLOCK
    # A metadata block holds under 2**24 bytes: a longer table keeps every m-th point.
    every = -(-points.nbytes // ((1 << 24) - 18))
    table = points[::every].tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table


def encode_streams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(payloads, streams): each text with bytes 255 up to a positive multiple of BLOCK, and its FLAC stream."""
    size = np.diff(offsets)
    frames = np.maximum(1, -(-size // BLOCK))
    first = np.concatenate([[0], np.cumsum(frames)])
    padded = np.full(int(first[-1]) * BLOCK, 255, np.uint8)
    for at, a, b in zip((BLOCK * first[:-1]).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        padded[at : at + b - a] = data[a:b]
    number = np.arange(first[-1]) - np.repeat(first[:-1], frames)
    matrix, parts, lengths = padded.reshape(-1, BLOCK), [], []
    for lo in range(0, len(matrix), LANES):
        part, length = encode_frames(matrix[lo : lo + LANES], number[lo : lo + LANES])
        parts.append(part)
        lengths.append(length)
    body, lengths = np.concatenate(parts).tobytes(), np.concatenate(lengths)
    at = np.concatenate([[0], np.cumsum(lengths)])
    raw = padded.tobytes()
    payloads = [raw[BLOCK * a : BLOCK * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    streams = [stream_header(p, lengths[a:b]) + body[at[a] : at[b]] for p, a, b in zip(payloads, first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return payloads, streams


# -- reading -------------------------------------------------------------------------------------------------------
class StreamInfo:
    def __init__(self, stream: bytes):
        if stream[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, self.points = 4, False, []
        while not last:
            kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
            last, block = bool(kind & 0x80), stream[at + 4 : at + 4 + size]
            if kind & 0x7F == 0:
                self.block = struct.unpack(">H", block[2:4])[0]
                packed = int.from_bytes(block[10:18], "big")
                self.channels, self.bits, self.total = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.md5 = block[18:34]
            elif kind & 0x7F == 3:
                table = np.frombuffer(block, [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
                self.points = table[table["sample"] != 2**64 - 1]
            at += 4 + size
        self.start = at
        if self.channels != 1 or self.bits != 8:
            raise ValueError("only mono streams of 8 bits are decoded")


_CLZ = np.full(1 << 16, 16, np.uint64)
for _b in range(16):
    _CLZ[1 << _b : 2 << _b] = 15 - _b


class _Bits:
    """A bit position for each lane over one byte buffer."""

    def __init__(self, data: np.ndarray, position: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.zeros(len(data) + 8, np.uint64)
        for k in range(8):
            self.words <<= np.uint64(8)
            self.words |= padded[k : k + len(self.words)]
        self.position = position.astype(np.uint64)

    def window(self, lanes=slice(None)) -> np.ndarray:
        p = self.position[lanes]
        return self.words[(p >> np.uint64(3)).astype(np.int64)] << (p & np.uint64(7))

    def take(self, width, lanes=slice(None)) -> np.ndarray:
        """Unsigned value of ``width`` (at most 32) bits."""
        width = np.asarray(width, np.uint64)
        out = np.where(width > 0, self.window(lanes) >> np.minimum(np.uint64(64) - width, np.uint64(63)), np.uint64(0))
        self.position[lanes] += width
        return out.astype(np.int64)


def _signed(value: np.ndarray, width) -> np.ndarray:
    half = np.int64(1) << (np.asarray(width, np.int64) - 1)
    return (value ^ half) - half


# Fixed values of the format: block sizes by header code (6 and 7 follow the header).
_BLOCK_SIZES = np.array([0, 192, 576, 1152, 2304, 4608, 0, 0, *(256 << k for k in range(8))])


def decode_frames(data: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray] | np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(samples as rows, block sizes, frame or sample numbers, ends) of the frames that begin at the bytes ``starts``."""
    n = len(starts)
    bits = _Bits(data, 8 * starts)
    if (bits.take(15) != 0x7FFC).any():
        raise ValueError("no frame begins here")
    bits.take(1)
    code, rate = bits.take(4), bits.take(4)
    if (bits.take(4) != 0).any() or not np.isin(bits.take(3), (0, 1)).all():
        raise ValueError("only mono frames of 8 bits are decoded")
    bits.take(1)
    lead = bits.take(8)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    number = np.where(more == 0, lead, lead & (0x3F >> more))
    for j in range(int(more.max()) if n else 0):
        lanes = np.flatnonzero(more > j)
        number[lanes] = number[lanes] << 6 | bits.take(8, lanes) & 0x3F
    block = _BLOCK_SIZES[code]
    for c, width in ((6, 8), (7, 16)):
        lanes = np.flatnonzero(code == c)
        block[lanes] = bits.take(width, lanes) + 1
    for c, width in ((12, 8), (13, 16), (14, 16)):
        bits.take(width, np.flatnonzero(rate == c))
    ends = (bits.position >> np.uint64(3)).astype(np.int64)
    if (crc_of(data, starts, ends - starts, wide=False) != bits.take(8)).any():
        raise ValueError("frame header checksum mismatch")
    kind = bits.take(8)
    if (kind & 0x81).any():
        raise ValueError("subframes with wasted bits are not decoded")
    kind >>= 1
    longest = int(block.max()) if n else 0
    out = np.zeros((longest, n), np.int32)
    lanes = np.flatnonzero(kind == 0)
    out[:, lanes] = _signed(bits.take(8, lanes), 8)
    lanes = np.flatnonzero(kind == 1)
    for t in range(longest if len(lanes) else 0):
        own = lanes[block[lanes] > t]
        out[t, own] = _signed(bits.take(8, own), 8)
    lanes = np.flatnonzero(kind >= 8)
    if len(lanes):
        _decode_predicted(bits, lanes, kind[lanes], block[lanes], out)
    ends = (bits.position + np.uint64(7) >> np.uint64(3)).astype(np.int64)
    if (crc_of(data, starts, ends - starts, wide=True) != (data[ends].astype(np.uint16) << 8 | data[ends + 1])).any():
        raise ValueError("frame checksum mismatch")
    return out, block, number, ends + 2


def _decode_predicted(bits: _Bits, lanes: np.ndarray, kind: np.ndarray, block: np.ndarray, out: np.ndarray) -> None:
    """Warm-up samples, coefficients, Rice residuals and the prediction, one sample of all lanes at a time."""
    m, linear = len(lanes), kind >= 32
    order = np.where(linear, (kind & 31) + 1, kind & 7)
    if ((kind > 12) & ~linear).any():
        raise ValueError("reserved subframe type")
    top = int(order.max())
    for t in range(top):
        own = np.flatnonzero(order > t)
        out[t, lanes[own]] = _signed(bits.take(8, lanes[own]), 8)
    coefficient, shift = np.zeros((top, m), np.int64), np.zeros(m, np.int64)
    for k, values in enumerate(FIXED):
        own = np.flatnonzero(~linear & (order == k))
        for j, v in enumerate(values if len(own) else ()):
            coefficient[j, own] = v
    own = np.flatnonzero(linear)
    if len(own):
        precision = bits.take(4, lanes[own]) + 1
        shift[own] = bits.take(5, lanes[own])
        for j in range(int(order[own].max())):
            some = order[own] > j
            coefficient[j, own[some]] = _signed(bits.take(precision[some], lanes[own[some]]), precision[some])
    wide = np.where(bits.take(2, lanes) == 1, 5, 4)
    part = block >> bits.take(4, lanes)
    width, raw = np.zeros(m, np.uint64), np.full(m, -1, np.int64)
    position, whole = bits.position[lanes], bits.words
    one, seven, three, top_bits, sixty4 = np.uint64(1), np.uint64(7), np.uint64(3), np.uint64(48), np.uint64(64)
    simple = bool((block == block[0]).all() and (part == block).all())
    longest, first = int(block.max()), int(order.min())
    samples = out[:, lanes]
    for t in range(first, longest):
        if t <= top or not simple:
            new = np.flatnonzero((order == t) | (t > order) & (t % part == 0) & (t < block))
            if len(new):
                bits.position[lanes] = position
                value = bits.take(wide[new], lanes[new])
                escape = value == (1 << wide[new]) - 1
                width[new], raw[new] = value.astype(np.uint64), -1
                if escape.any():
                    raw[new[escape]] = bits.take(5, lanes[new[escape]])
                position = bits.position[lanes]
            live = (order <= t) & (t < block)
            everyone = bool(live.all())
        window = whole[(position >> three).astype(np.int64)] << (position & seven)
        zeros = _CLZ[window >> top_bits]
        far = np.flatnonzero(zeros == 16)
        extra = None
        if len(far) and not everyone:
            far = far[live[far]]
        if len(far):
            far = far[raw[far] < 0]
            extra = np.zeros(m, np.uint64)
            run = far
            while len(run):
                extra[run] += np.uint64(16)
                p = position[run] + extra[run]
                if int(p.max()) >> 3 >= len(whole):
                    raise ValueError("residual without end")
                w = whole[(p >> three).astype(np.int64)] << (p & seven)
                window[run] = w
                zeros[run] = _CLZ[w >> top_bits]
                run = run[zeros[run] == 16]
        quotient = zeros if extra is None else zeros + extra
        low = (window << (zeros + one)) >> np.minimum(sixty4 - width, np.uint64(63))
        low[width == 0] = 0
        u = (quotient << width | low).astype(np.int64)
        residual = (u >> 1) ^ -(u & 1)
        used = quotient + one + width
        if not everyone or (raw >= 0).any():
            escaped = np.flatnonzero((raw >= 0) & live)
            if len(escaped):
                bits.position[lanes[escaped]] = position[escaped]
                residual[escaped] = np.where(raw[escaped] > 0, _signed(bits.take(raw[escaped], lanes[escaped]), np.maximum(raw[escaped], 1)), 0)
                used[escaped] = raw[escaped].astype(np.uint64)
            used[~live] = 0
        position = position + used
        predicted = np.zeros(m, np.int64)
        for j in range(min(top, t)):
            predicted += coefficient[j] * samples[t - 1 - j]
        value = residual + (predicted >> shift)
        samples[t] = value if everyone else np.where(live, value, samples[t])
    out[:, lanes] = samples
    bits.position[lanes] = position


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """The payload bytes of each stream, all frame checksums and the stream MD5 verified."""
    infos = [StreamInfo(s) for s in streams]
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    data = np.frombuffer(b"".join(streams), np.uint8)
    out = [np.empty(i.total, np.uint8) for i in infos]
    at, owner, until = [], [], []
    for k, i in enumerate(infos):
        points = i.points if len(i.points) else np.zeros(1, [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
        at.append(points["offset"].astype(np.int64) + i.start + base[k])
        owner.append(np.full(len(points), k))
        until.append(np.append(points["sample"][1:].astype(np.int64), i.total))
    at, owner, until = map(np.concatenate, (at, owner, until))
    block = np.array([i.block for i in infos])
    for lo in range(0, len(at), LANES):
        lanes = np.arange(lo, min(lo + LANES, len(at)))
        begin, end = base[owner[lanes[0]]], base[owner[lanes[-1]] + 1]
        while len(lanes):
            samples, size, number, ends = decode_frames(data[begin:end], at[lanes] - begin)
            position = number * block[owner[lanes]]
            rows = to_payload(samples.T)
            for r, (k, p, n) in enumerate(zip(owner[lanes].tolist(), position.tolist(), size.tolist(), strict=True)):
                out[k][p : p + n] = rows[r, :n]
            at[lanes] = ends + begin
            lanes = lanes[position + size < until[lanes]]
    payloads = [x.tobytes() for x in out]
    for p, i in zip(payloads, infos, strict=True):
        if i.md5 != bytes(16) and hashlib.md5(to_samples(np.frombuffer(p, np.uint8)).tobytes()).digest() != i.md5:
            raise ValueError("stream checksum mismatch")
    return payloads


def read_samples(stream: bytes, first: int, count: int) -> bytes:
    """``count`` sample bytes from sample ``first`` on: begins at the last seek point before and decodes only what it needs."""
    info = StreamInfo(stream)
    at, position = info.start, 0
    if len(info.points):
        k = max(0, int(np.searchsorted(info.points["sample"].astype(np.int64), first, "right")) - 1)
        at, position = info.start + int(info.points["offset"][k]), int(info.points["sample"][k])
    end, data, parts, skip = min(first + count, info.total), np.frombuffer(stream, np.uint8), [], first - position
    while position < end:
        samples, size, _, ends = decode_frames(data, np.array([at]))
        parts.append(to_payload(samples[: size[0], 0]).tobytes())
        at, position = int(ends[0]), position + int(size[0])
    return b"".join(parts)[skip : skip + max(0, end - first)]


def pcm_blocks(media: DataFrame) -> DataFrame:
    """key, first_sample, pcm of every frame of the streams of ``media`` (key, media): blocks at seekable sample offsets.

    Repeated rows give their blocks again, a null key is kept, an empty table gives no rows; a null stream is an error, as
    one that fails its checksums.
    """

    def run(batches):
        for batch in batches:
            for key, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                info, payload = StreamInfo(stream), decode_streams([stream])[0]
                starts = list(range(0, info.total, info.block))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(starts), batch.column(0).type), pa.array(starts, pa.int64()), pa.array([payload[a : a + info.block] for a in starts], pa.binary())], ["key", "first_sample", "pcm"])

    bounded_batches(media.sparkSession)
    schema = media.select("key").schema.add("first_sample", "long").add("pcm", "binary")
    return media.select("key", "media").mapInArrow(run, schema)


def _features(payload: bytes) -> str:
    s = to_samples(np.frombuffer(payload, np.uint8))
    crossings = int(((s[1:] >= 0) != (s[:-1] >= 0)).sum())
    return f"samples={len(s)};min={s.min()};max={s.max()};sum={int(s.sum(dtype=np.int64))};energy={int((s.astype(np.int64) ** 2).sum())};crossings={crossings}"


def encode_texts(docs: DataFrame) -> DataFrame:
    """key, n_bytes, media of each row of ``docs`` (key, text), row by row: null text is empty (one frame of padding), repeated
    rows and null keys stay, other columns are ignored, an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                _, streams = encode_streams(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(streams, pa.binary())], ["key", "n_bytes", "media"])

    return docs.select("key", "text").mapInArrow(run, "key binary, n_bytes long, media binary")


def media_report(media: DataFrame) -> DataFrame:
    """Decode each stream of ``media`` (key, n_bytes, media) and describe payload and stored form, row by row.

    Repeated rows and null keys stay; a null stream is an error, as one that fails its checksums.
    """

    def run(batches):
        for batch in batches:
            streams = batch.column(2).to_pylist()
            lo = 0
            while lo < len(streams):
                hi, size = lo, 0
                while hi < len(streams) and (hi == lo or size + len(streams[hi]) <= 2 << 20):
                    size += len(streams[hi])
                    hi += 1
                payloads = decode_streams(streams[lo:hi])
                part = streams[lo:hi]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                        pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()), pa.array([len(x) for x in part], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in part]), pa.array([_features(p) for p in payloads]),
                    ],
                    ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )
                lo = hi

    return media.select("key", "n_bytes", "media").mapInArrow(run, "key binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def flac_roundtrip(docs: DataFrame) -> DataFrame:
    """doc_id and ``media_report`` of every row of ``docs`` (doc_id, text; other columns are ignored).

    Streams are made once for each distinct text, written to shared storage and read back. Null text is empty: one
    frame of padding. Repeated rows and ids stay, one result row each. Empty table: no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    keys = written(rows.select("doc_id", "key"), "flac-keys")
    repeated = written(keys.groupBy("key").agg(F.min("doc_id").alias("as_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "as_id", F.lit(True).alias("listed")), "flac-repeated")
    one = rows.join(shared_if_small(repeated, BROADCAST_DIGESTS), "key", "left").where("listed is null or doc_id <=> as_id")
    media = written(encode_texts(one), "flac-media")
    report = media_report(media).dropDuplicates(["key"])
    return keys.join(report, "key").drop("key")
