"""FLAC: texts' bytes as audio, and the decoder that turns FLAC streams into seekable PCM blocks.

The decoder finds frames by their sync code, a header that agrees with the stream's, its CRC-8 and the running number,
verifies the CRC-16 of every frame and the MD5 of every stream that has one, and decodes all frames of an Arrow batch in
step: one array operation a sample position reads the next Rice code of every frame, and one restores the next sample of
every linear predictor. It reads mono streams of 8 bits with fixed block size and constant, verbatim, fixed and LPC
subframes; anything else raises ``ValueError``. Its PCM blocks are written a row a block with the offset of their first
sample; a range of samples is read from the blocks that meet it.

The encoder stores a payload in blocks of 576 samples and picks for each block the shortest of constant, verbatim, fixed
predictors of order 0 to 2 and a linear predictor of order 4, with Rice parameters for 8 partitions.

Defined results: a null or empty text is a payload of 576 bytes 255; equal texts have equal streams; a very long text is one
stream of many blocks; null and repeated ids keep a stream for each row; a null stream has one row without samples; an empty
table has no blocks; other columns are ignored; a damaged stream raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.llm.base import map_texts, only, scratch, slices

BLOCK, RATE, PAD = 576, 8000, 255
LPC_ORDER, LPC_PRECISION, LPC_SHIFT = 4, 12, 9
PARTITION_ORDER = 3
#: Frames in a PCM block.
BLOCK_FRAMES = 64
#: Taps of the fixed predictors, by order.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


@lru_cache(maxsize=2)
def crc_table(bits: int) -> np.ndarray:
    """CRC-8 (polynomial 0x07) or CRC-16 (0x8005), a byte at a time, highest bit first."""
    poly, top, mask = {8: (0x07, 0x80, 0xFF), 16: (0x8005, 0x8000, 0xFFFF)}[bits]
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c & top else 0)
        out[i] = c & mask
    return out


def crc8(data: bytes) -> int:
    table, c = crc_table(8), 0
    for b in data:
        c = int(table[c ^ b])
    return c


def crc16(buffer: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches of a buffer in step; stretches are aligned at their ends, as leading zeros change nothing."""
    table, c = crc_table(16), np.zeros(len(begins), np.uint16)
    for back in range(int((ends - begins).max(initial=0)), 0, -1):
        at = ends - back
        byte = np.where(at >= begins, buffer[np.maximum(at, 0)], 0)
        c = (c << np.uint16(8)) ^ table[(c >> np.uint16(8)) ^ byte]
    return c


def number_bytes(n: int) -> bytes:
    """A frame number in the extended UTF-8 form of the format."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> 6 * i & 0x3F) for i in reversed(range(size - 1))]
    return bytes([(0xFF << (8 - size) & 0xFF) | n >> 6 * (size - 1), *tail])


def number_at(data: bytes, at: int) -> tuple[int, int]:
    """A frame number and the place after it; -1 where there is none."""
    first = data[at]
    if first < 0x80:
        return first, at + 1
    size = 8 - (first ^ 0xFF).bit_length()
    if size < 2 or size > 7 or at + size > len(data):
        return -1, at
    n = first & (0x7F >> size)
    for b in data[at + 1 : at + size]:
        if b & 0xC0 != 0x80:
            return -1, at
        n = n << 6 | b & 0x3F
    return n, at + size


@lru_cache(maxsize=4096)
def frame_header(n: int) -> bytes:
    # sync and fixed block size; 576 samples at 8 kHz; mono, 8 bits
    head = b"\xff\xf8\x24\x02" + number_bytes(n)
    return head + bytes([crc8(head)])


def payload_of(text: str | None) -> bytes:
    body = (text or "").encode()
    return body + bytes([PAD]) * (-len(body) % BLOCK if body else BLOCK)


def residuals(x: np.ndarray, taps: np.ndarray, shift: int) -> np.ndarray:
    """What a predictor leaves of each row after its warm-up. ``taps``: a row for each row of ``x``, latest sample first."""
    order = taps.shape[1]
    if not order:
        return x
    guess = sum(taps[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j] for j in range(order))
    return x[:, order:] - (guess >> shift)


def linear_taps(x: np.ndarray) -> np.ndarray:
    """Quantised linear predictors by the Levinson-Durbin recursion, all rows at once."""
    p = LPC_ORDER
    y = x.astype(np.float64)
    r = np.stack([(y[:, k:] * y[:, : y.shape[1] - k]).sum(1) for k in range(p + 1)], 1)
    r[:, 0] += 1e-9 + 1e-4 * r[:, 0]
    a, error = np.zeros((len(x), p)), r[:, 0].copy()
    for i in range(p):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -most, most).astype(np.int32)


def rice(res: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, the best Rice parameter of each partition, and the bits of each row."""
    folded = ((res << 1) ^ (res >> 31)).astype(np.int32)
    parts = 1 << PARTITION_ORDER
    wide = np.concatenate([np.zeros((len(res), order), np.int32), folded], 1).reshape(len(res), parts, -1)
    counts = np.full(parts, BLOCK // parts)
    counts[0] -= order
    cost = np.stack([(wide >> k).sum(2) + counts * (k + 1) for k in range(11)], 2)
    k = cost.argmin(2)
    return folded, k, cost.min(2).sum(1) + 4 * parts + 6


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of blocks of samples (rows of ``x``): their bytes end to end, and where each ends."""
    n, none = len(x), np.zeros((len(x), 0), np.int32)
    tries = []  # (order, taps, shift, residuals, parameters, bits)
    for order in range(3):
        taps = np.tile(np.array(FIXED[order], np.int32), (n, 1)) if order else none
        res = residuals(x, taps, 0)
        folded, k, bits = rice(res, order)
        tries.append((order, None, folded, k, bits + 8 + 8 * order))
    taps = linear_taps(x)
    folded, k, bits = rice(residuals(x, taps, LPC_SHIFT), LPC_ORDER)
    tries.append((LPC_ORDER, taps, folded, k, bits + 8 + 8 * LPC_ORDER + 9 + LPC_PRECISION * LPC_ORDER))
    sizes = np.stack([*(t[4] for t in tries), np.full(n, 8 + 8 * BLOCK), np.where((x == x[:, :1]).all(1), 16, 1 << 30)], 1)
    kind = sizes.argmin(1)

    heads = [frame_header(int(i)) for i in numbers]
    head_len = np.array([len(h) for h in heads])
    body_len = (sizes[np.arange(n), kind] + 7) // 8
    ends = np.cumsum(head_len + body_len + 2)
    begins = ends - (head_len + body_len + 2)
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    for size in np.unique(head_len):
        rows = np.flatnonzero(head_len == size)
        out[begins[rows][:, None] + np.arange(size)] = np.frombuffer(b"".join(heads[i] for i in rows), np.uint8).reshape(-1, size)
    first = begins + head_len
    for c in range(6):
        rows = np.flatnonzero(kind == c)
        if not len(rows):
            continue
        if c == 5:
            out[first[rows]], out[first[rows] + 1] = 0, x[rows, 0].astype(np.int8).view(np.uint8)
        elif c == 4:
            out[first[rows]] = 2
            out[first[rows][:, None] + 1 + np.arange(BLOCK)] = x[rows].astype(np.int8).view(np.uint8)
        else:
            order, taps, folded, k, _ = tries[c]
            write_rice(out, first[rows], order, None if taps is None else taps[rows], x[rows], folded[rows], k[rows])
    crc = crc16(out, begins, ends - 2)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 0xFF
    return out, ends


def write_rice(out: np.ndarray, at: np.ndarray, order: int, taps: np.ndarray | None, x: np.ndarray, folded: np.ndarray, k: np.ndarray) -> None:
    """Subframes of one kind as fields (value, bits) a row; of a field's bits all above its low 16 are zero."""
    n, parts = len(x), 1 << PARTITION_ORDER
    full = lambda v, w, m=1: (np.full((n, m), v), np.full((n, m), w))
    fields = [full((8 + order if taps is None else 32 + order - 1) << 1, 8)]
    if order:
        fields.append((x[:, :order] & 0xFF, np.full((n, order), 8)))
    if taps is not None:
        fields += [full(LPC_PRECISION - 1, 4), full(LPC_SHIFT, 5), (taps & (1 << LPC_PRECISION) - 1, np.full(taps.shape, LPC_PRECISION))]
    fields.append(full(PARTITION_ORDER, 6))
    step, a = BLOCK // parts, 0
    for p in range(parts):
        b = a + step - (order if p == 0 else 0)
        kk, u = k[:, p : p + 1], folded[:, a:b]
        fields += [(kk, np.full((n, 1), 4)), (1 << kk | u & (1 << kk) - 1, (u >> kk) + 1 + kk)]
        a = b
    value = np.concatenate([f[0] for f in fields], 1).astype(np.int32)
    width = np.concatenate([f[1] for f in fields], 1)
    stop = np.cumsum(width, 1)
    bits_in = (stop[:, -1] + 7) // 8 * 8
    base = np.cumsum(bits_in) - bits_in
    last = (stop + base[:, None] - 1).ravel()
    bits = np.zeros(int(bits_in.sum()), np.uint8)
    value = value.ravel()
    low = np.minimum(width.ravel(), 16)
    for j in range(int(value.max()).bit_length()):
        on = np.flatnonzero((value >> j & 1).astype(bool) & (low > j))
        bits[last[on] - j] = 1
    packed = np.packbits(bits)
    sizes = bits_in // 8
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(at - starts, sizes) + np.arange(len(packed))] = packed


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads of whole blocks."""
    if not payloads:
        return []
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    x = (joined.astype(np.int32) - 128).reshape(-1, BLOCK)
    frames = [len(p) // BLOCK for p in payloads]
    numbers = np.concatenate([np.arange(f) for f in frames])
    data, ends = encode_frames(x, numbers)
    raw, out, i, begin = data.tobytes(), [], 0, 0
    sizes = np.diff(ends, prepend=0)
    for p, f in zip(payloads, frames):
        mine = sizes[i : i + f]
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        packed = RATE << 44 | 0 << 41 | 7 << 36 | len(p)
        info = BLOCK.to_bytes(2) * 2 + int(mine.min()).to_bytes(3) + int(mine.max()).to_bytes(3) + packed.to_bytes(8) + md5
        end = int(ends[i + f - 1])
        out.append(b"fLaC\x80\x00\x00\x22" + info + raw[begin:end])
        begin, i = end, i + f
    return out


class Stream:
    """What the metadata of a stream says, and where its frames lie.

    A stretch inside a frame can look like the next header. Then some CRC-16 does not hold or ``whole`` is false, and the
    stream is read again with ``checked``: a header then counts only where the CRC-16 of the frame before it holds.
    """

    def __init__(self, data: bytes, checked: bool = False):
        if data[:4] != b"fLaC" or len(data) < 42:
            raise ValueError("not a FLAC stream")
        at, last = 4, False
        while not last:
            kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4])
            last = data[at] >= 0x80
            if kind == 0:
                info = data[at + 4 : at + 4 + size]
            at += 4 + size
        packed = int.from_bytes(info[10:18])
        self.block, self.total, self.md5 = int.from_bytes(info[2:4]), packed & (1 << 36) - 1, info[18:34]
        if packed >> 41 & 7 or (packed >> 36 & 31) != 7 or self.block != int.from_bytes(info[:2]):
            raise ValueError("only mono streams of 8 bits and fixed block size are read")
        self.rate, frames = packed >> 44, -(-self.total // self.block)
        self.begins, self.bodies = [], []
        buffer = np.frombuffer(data, np.uint8) if checked else None
        for m in SYNC.finditer(data, at):
            i = m.start()
            n, after = number_at(data, i + 4) if i + 6 < len(data) else (-1, i)
            after += {6: 1, 7: 2}.get(data[i + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(data[i + 2] & 15, 0) if n >= 0 else 0
            if n == len(self.begins) < frames and after < len(data) and crc8(data[i:after]) == data[after] and (self.begins or i == at) and self.agrees(data, i, after, n == frames - 1):
                if checked and self.begins and crc16(buffer, np.array(self.begins[-1:]), np.array([i])).any():
                    continue
                self.begins.append(i)
                self.bodies.append(after + 1)
        self.ends = [*self.begins[1:], len(data)]
        self.whole = len(self.begins) == frames
        if checked and not self.whole:
            raise ValueError("frames are missing")

    def agrees(self, data: bytes, i: int, after: int, last: bool) -> bool:
        """Whether the header from ``i`` to its CRC-8 at ``after`` has the stream's block size, rate, channel and bits."""
        sized, rated = data[i + 2] >> 4, data[i + 2] & 15
        tail = after - {12: 1, 13: 2, 14: 2}.get(rated, 0)
        size = int.from_bytes(data[tail - sized + 5 : tail]) + 1 if sized in (6, 7) else 192 if sized == 1 else 576 << sized - 2 if 2 <= sized <= 5 else 256 << sized - 8 if sized >= 8 else 0
        rate = int.from_bytes(data[tail:after]) * {12: 1000, 13: 1, 14: 10}[rated] if 12 <= rated <= 14 else (self.rate, *RATES)[rated] if rated < 12 else -1
        want = self.total - (-(-self.total // self.block) - 1) * self.block if last else self.block
        return size == want and rate == self.rate and data[i + 3] in (0, 2)

    def verify(self, samples: np.ndarray) -> np.ndarray:
        """``samples``, if they have the stream's MD5 or it has none."""
        if self.md5 != bytes(16) and hashlib.md5((samples ^ 0x80).tobytes()).digest() != self.md5:
            raise ValueError("the samples do not have the stream's MD5")
        return samples


SYNC = re.compile(rb"\xff\xf8")
#: Sample rates by their code in a frame header, from 1.
RATES = (88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000)


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """Samples (0 to 255) of each stream, frames of all streams decoded in step."""
    found = [f if (f := Stream(s)).whole else Stream(s, checked=True) for s in streams]
    if not found:
        return []
    offsets = np.cumsum([0, *map(len, streams[:-1])])
    buffer = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    places = lambda: (np.concatenate([np.array(getattr(f, k), np.int64) + o for f, o in zip(found, offsets)]) for k in ("begins", "bodies", "ends"))
    begins, bodies, ends = places()
    bad = crc16(buffer, begins, ends).nonzero()[0]
    if len(bad):
        for i in np.unique(np.searchsorted(offsets, begins[bad], "right") - 1).tolist():
            found[i] = Stream(streams[i], checked=True)
        begins, bodies, ends = places()
        if crc16(buffer, begins, ends).any():
            raise ValueError("a frame's checksum does not hold")
    if {f.block for f in found} - {BLOCK} or any(f.total % BLOCK for f in found):
        # other block sizes go stream by stream, each with its own length of frames
        return [f.verify(decode_frames(np.frombuffer(s + bytes(16), np.uint8), np.array(f.bodies), np.array(f.ends), f.block, f.total)) for s, f in zip(streams, found)]
    samples = decode_frames(buffer, bodies, ends, BLOCK, BLOCK * len(begins))
    out, at = [], 0
    for f in found:
        out.append(f.verify(samples[at : at + f.total]))
        at += f.total
    return out


def decode_frames(buffer: np.ndarray, bodies: np.ndarray, ends: np.ndarray, block: int, total: int) -> np.ndarray:
    """All frames' samples end to end as bytes; only the last may be shorter than ``block``."""
    x = np.zeros((block, len(bodies)), np.int32)
    whole = total // block
    for part, size in ((np.arange(whole), block), (np.arange(whole, len(bodies)), total - whole * block)):
        kinds = buffer[bodies[part]]
        if (kinds & 0x81).any():
            raise ValueError("wasted bits are not read")
        for kind in np.unique(kinds):
            rows = part[kinds == kind]
            code, at = int(kind) >> 1, bodies[rows] + 1
            if code == 0:
                x[:size, rows] = buffer[at].view(np.int8)
            elif code == 1:
                x[:size, rows] = buffer[at[None, :] + np.arange(size)[:, None]].view(np.int8)
            elif 8 <= code <= 12:
                order = code - 8
                taps = np.tile(np.array(FIXED[order], np.int32)[:, None], (1, len(rows)))
                x[:size, rows] = predicted(buffer, at, order, taps, np.zeros(len(rows), np.int32), at * 8 + 8 * order, size)
            elif code >= 32:
                order = code - 31
                bit = (at + order) * 8
                precision, bit = take(buffer, bit, 4)
                shift, bit = take(buffer, bit, 5)
                taps = np.zeros((order, len(rows)), np.int32)
                for j in range(order):
                    taps[j], bit = take(buffer, bit, precision + 1, signed=True)
                x[:size, rows] = predicted(buffer, at, order, taps, shift.astype(np.int32), bit, size)
            else:
                raise ValueError(f"subframe type {code}")
    return (x.T.reshape(-1)[:total] + 128).astype(np.uint8)


def words_at(buffer: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """64 bits from each bit position (57 of them sure), highest first."""
    view = np.lib.stride_tricks.as_strided(buffer[:8].view(">u8"), (len(buffer) - 7,), (1,))
    return view[bit >> 3].astype(np.uint64) << (bit & 7).astype(np.uint64)


def take(buffer: np.ndarray, bit: np.ndarray, width, signed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    width = np.asarray(width, np.int64)
    v = np.where(width > 0, words_at(buffer, bit) >> (np.uint64(64) - np.maximum(width, 1).astype(np.uint64)), 0).astype(np.int64)
    if signed:
        v -= (v >> np.maximum(width - 1, 0) & 1) << width
    return v, bit + width


def predicted(buffer: np.ndarray, at: np.ndarray, order: int, taps: np.ndarray, shift: np.ndarray, bit: np.ndarray, size: int) -> np.ndarray:
    """Samples of frames of one predictor order: warm-up, then Rice residuals and prediction in step."""
    x = np.zeros((size, len(at)), np.int32)
    for t in range(order):
        x[t] = buffer[at + t].view(np.int8)
    head, bit = take(buffer, bit, 6)
    if (head >> 4 > 1).any():
        raise ValueError("residual coding method")
    for h in np.unique(head):
        rows = np.flatnonzero(head == h)
        parts, long = 1 << (int(h) & 15), 4 + (int(h) >> 4)
        if size % parts or size // parts < order:
            raise ValueError("partition order")
        x[order:, rows] = codes(buffer, bit[rows], parts, long, order, size)
    for t in range(order, size):
        if order:
            guess = taps[0] * x[t - 1]
            for j in range(1, order):
                guess += taps[j] * x[t - 1 - j]
            x[t] += guess >> shift
    return x


def codes(buffer: np.ndarray, bit: np.ndarray, parts: int, long: int, order: int, size: int) -> np.ndarray:
    """Residuals of frames of one layout of partitions."""
    out, t = np.zeros((size - order, len(bit)), np.int32), 0
    view = np.lib.stride_tricks.as_strided(buffer[:8].view(">u8"), (len(buffer) - 7,), (1,))
    for p in range(parts):
        k, bit = take(buffer, bit, long)
        raw = k == (1 << long) - 1
        if raw.any():
            raw_width, raw_bit = take(buffer, bit, 5)
            bit = np.where(raw, raw_bit, bit)
        up = np.uint64(64) - np.maximum(k, 1).astype(np.uint64)
        some = k > 0
        every, none_raw = bool(some.all()), not raw.any()
        for _ in range(size // parts - (order if p == 0 else 0)):
            w = view[bit >> 3].astype(np.uint64) << (bit & 7).astype(np.uint64)
            # leading zeros by the exponent of the top 53 bits as a double
            q = 1075 - ((w >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52)
            if (q > 40).any():
                q = slow_zeros(buffer, bit, raw)
                low, after = take(buffer, bit + q + 1, k)
            else:
                low = ((w << (q + 1).astype(np.uint64)) >> up).astype(np.int64)
                if not every:
                    low = np.where(some, low, 0)
                after = bit + q + 1 + k
                wide = q + 1 + k > 57
                if wide.any():
                    low, after = take(buffer, bit + q + 1, k)
            u = q << k | low
            v = (u >> 1) ^ -(u & 1)
            if not none_raw:
                r, raw_after = take(buffer, bit, np.where(raw, raw_width, 0), signed=True)
                v, after = np.where(raw, r, v), np.where(raw, raw_after, after)
            out[t], bit = v, after
            t += 1
    return out


def slow_zeros(buffer: np.ndarray, bit: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Zeros before the next one, however many."""
    q, open_ = np.zeros(len(bit), np.int64), ~skip
    while open_.any():
        if ((bit[open_] + q[open_]) >> 3 >= len(buffer) - 8).any():
            raise ValueError("a code runs past the end")
        top = words_at(buffer, bit + np.where(open_, q, 0)) >> np.uint64(32)
        zeros = np.where(top == 0, 32, 31 - np.frexp(top.astype(np.float64))[1] + 1)
        q += np.where(open_, zeros, 0)
        open_ &= top == 0
    return q


def feature(x: np.ndarray) -> str:
    """Sample count, mean, root mean square about 128, zero crossings and peak, as text."""
    y = x.astype(np.int64) - 128
    return f"{len(x)}|{y.sum() / len(y):.4f}|{np.sqrt((y * y).sum() / len(y)):.4f}|{int(((y[1:] >= 0) != (y[:-1] >= 0)).sum())}|{int(np.abs(y).max())}"


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a FLAC stream) for rows of (doc_id, text)."""

    def make():
        def work(ids, texts):
            return {"doc_id": ids, "n_bytes": [len((t or "").encode()) for t in texts], "media": encode_streams([payload_of(t) for t in texts])}

        return work

    return map_texts(docs, make, "doc_id long, n_bytes long, media binary")


BLOCKS = (
    "part int, stream long, doc_id long, n_bytes long, media_bytes long, media_sha256 string, n_blocks int, "
    "sample_offset long, n_samples int, pcm binary"
)


def decode(media: DataFrame, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """A row a PCM block for rows of (doc_id, n_bytes, media), in order of a stream's ``sample_offset``.

    ``part`` and ``stream`` number the streams, so that repeated and null ids stay apart. A null stream has one row without
    samples.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(BLOCKS)
    arrow = to_arrow_schema(schema)
    step = block_frames * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in slices(batch.column(2)):
                rows = [[] for _ in arrow]
                docs, sizes, streams = (batch.column(i).slice(a, b - a).to_pylist() for i in range(3))
                samples = iter(decode_streams([s for s in streams if s is not None]))
                for doc, size, stream in zip(docs, sizes, streams):
                    x = None if stream is None else next(samples)
                    head = (part, number, doc, size, stream and len(stream), stream and hashlib.sha256(stream).hexdigest())
                    number += 1
                    starts = [None] if x is None else range(0, len(x), step)
                    for i in starts:
                        pcm = None if x is None else x[i : i + step].tobytes()
                        for column, v in zip(rows, (*head, 0 if x is None else len(starts), i, pcm and len(pcm), pcm)):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, arrow)], schema=arrow)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def write_blocks(media: DataFrame, path: str, block_frames: int = BLOCK_FRAMES) -> None:
    """PCM blocks of FLAC streams as Parquet: decoded, verified and written in one pass, each task its own files."""
    decode(media, block_frames).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def read_range(spark: SparkSession, path: str, doc_id: int, first: int, last: int) -> DataFrame:
    """Samples ``first`` to ``last`` (exclusive) of a document from its written blocks: (part, stream, sample_offset, pcm).

    Only blocks that meet the range are read: the filters on doc_id and sample_offset reach the scan.
    """
    hit = read_blocks(spark, path).where((F.col("doc_id") == doc_id) & (F.col("sample_offset") < last) & (F.col("sample_offset") + F.col("n_samples") > first))
    begin = F.greatest(F.lit(first), F.col("sample_offset"))
    size = F.least(F.lit(last), F.col("sample_offset") + F.col("n_samples")) - begin
    return hit.select("part", "stream", begin.alias("sample_offset"), F.col("pcm").substr((begin - F.col("sample_offset") + 1).cast("int"), size.cast("int")).alias("pcm"))


def digests(blocks: DataFrame) -> DataFrame:
    """What written blocks hold, a row a stream: sizes, digests and the feature of the samples read.

    Most streams are one block and go as they are; the blocks of longer ones are gathered by their stream.
    """
    own = ("doc_id", "n_bytes", "media_bytes", "media_sha256")
    block = F.struct("sample_offset", "pcm")
    short = blocks.where("n_blocks <= 1").select(*own, F.array(block).alias("b"))
    long = blocks.where("n_blocks > 1").groupBy("part", "stream").agg(*[F.first(c).alias(c) for c in own], F.sort_array(F.collect_list(block)).alias("b")).select(*own, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[], [], [], []]
            for i in range(batch.num_rows):
                pcm = b"".join([x["pcm"] or b"" for x in batch.column(4)[i].as_py()])
                for column, v in zip(found, (len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-32:]), feature(np.frombuffer(pcm, np.uint8)) if pcm else None)):
                    column.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, found, kinds)], names=[*own, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return short.unionByName(long).mapInArrow(run, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document as FLAC, decoded into PCM blocks in the shared folder, which are read back.

    ``media_bytes`` and ``media_sha256`` are those of the FLAC stream, which is not what is stored: the blocks are.
    """
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    path = scratch(spark, "pcm")
    write_blocks(encode(docs), path)
    return digests(read_blocks(spark, path)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
