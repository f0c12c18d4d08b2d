"""FLAC streams: round trips, damage, and what other encoders write."""

import hashlib
import random

import numpy as np
import pytest

from kinoframe.llm import flac
from kinoframe.llm.base import only
from tests.llm.conftest import TEXTS


def payloads():
    pick = random.Random(2)
    noise = bytes(pick.randrange(256) for _ in range(5760))
    swings = bytes(pick.choice((0, 255)) for _ in range(2880))
    spike = bytes([128] * 575 + [0] + [128] * 575 + [255])
    return [flac.payload_of(t) for _, t in TEXTS] + [noise, swings, spike, bytes(576), b"\xff" * 1152, noise[:576] + bytes(5184)]


def test_round_trip_of_all_kinds_of_frames():
    found = flac.encode_streams(payloads())
    kinds = {s[b] >> 1 for s in found for b in flac.Stream(s).bodies}
    assert 0 in kinds and 1 in kinds and 35 in kinds and kinds & {8, 9, 10}
    assert [x.tobytes() for x in flac.decode_streams(found)] == payloads()
    # alone and in company a stream is the same
    assert [flac.encode_streams([p])[0] for p in payloads()] == found


def test_damage_is_found():
    stream = flac.encode_streams([flac.payload_of("some text " * 300)])[0]
    for at in (30, 60, len(stream) // 2, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 0x10
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(bad)])
    with pytest.raises(ValueError):
        flac.decode_streams([stream[:-3]])


@pytest.mark.parametrize("number, at", [(1, 100), (2, 700)])
def test_a_header_inside_a_frame_is_passed_over(number, at):
    pick = random.Random(5)
    noise = bytearray(pick.randrange(256) for _ in range(1152))
    fake = flac.frame_header(number)
    noise[at : at + len(fake)] = bytes(b ^ 0x80 for b in fake)
    streams = flac.encode_streams([bytes(576), bytes(noise), bytes(1152)])
    assert streams[1].count(fake) == (2 if number == 1 else 1)
    assert [x.tobytes() for x in flac.decode_streams(streams)] == [bytes(576), bytes(noise), bytes(1152)]


def test_other_block_sizes_are_verified():
    samples = bytes(random.Random(6).randrange(256) for _ in range(192 + 50))
    frames = b""
    for head, part in ((b"\xff\xf8\x14\x02\x00", samples[:192]), (b"\xff\xf8\x64\x02\x01\x31", samples[192:])):
        frame = head + bytes([flac.crc8(head), 2]) + part
        frames += frame + int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2)
    info = (192).to_bytes(2) * 2 + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8)
    stream = lambda md5: b"fLaC\x80\x00\x00\x22" + info + md5 + frames
    good = hashlib.md5(samples).digest()
    assert flac.decode_streams([stream(good)])[0].tobytes() == bytes(b ^ 0x80 for b in samples)
    with pytest.raises(ValueError):
        flac.decode_streams([stream(good[::-1])])


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, width):
        self.text += format(value & (1 << width) - 1, f"0{width}b") if width else ""

    def bytes(self):
        self.text += "0" * (-len(self.text) % 8)
        return bytes(int(self.text[i : i + 8], 2) for i in range(0, len(self.text), 8))


def by_hand(samples, order, escape=False):
    """A stream of one frame of 576 samples by a plain writer: fixed predictor, one partition, 5-bit parameters."""
    x = [s - 128 for s in samples]
    taps = flac.FIXED[order]
    res = [x[t] - sum(c * x[t - 1 - j] for j, c in enumerate(taps)) for t in range(order, 576)]
    b = Bits()
    b.put((8 + order) << 1, 8)
    for v in x[:order]:
        b.put(v, 8)
    b.put(1 << 4, 6)
    if escape:
        b.put(31, 5)
        b.put(12, 5)
        for r in res:
            b.put(r, 12)
    else:
        b.put(2, 5)
        for r in res:
            u = r << 1 if r >= 0 else -r * 2 - 1
            b.put(1, (u >> 2) + 1)
            b.put(u & 3, 2)
    frame = flac.frame_header(0) + b.bytes()
    crc = int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    md5 = hashlib.md5(bytes(v & 255 for v in x)).digest()
    info = (576).to_bytes(2) * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 576).to_bytes(8) + md5
    return b"fLaC\x00\x00\x00\x22" + info + b"\x81\x00\x00\x02hi" + frame + crc.to_bytes(2)


@pytest.mark.parametrize("order", range(5))
@pytest.mark.parametrize("escape", [False, True])
def test_other_writers_streams(order, escape):
    pick = random.Random(order)
    samples, v = [], 128
    for _ in range(576):
        v = min(255, max(0, v + pick.randrange(-9, 10)))
        samples.append(v)
    samples[300] = 255  # long unary codes
    assert flac.decode_streams([by_hand(samples, order, escape)])[0].tolist() == samples


def test_frame_numbers_and_checksums():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 1 << 21, (1 << 31) - 1, (1 << 36) - 1):
        data = flac.number_bytes(n)
        assert flac.number_at(data + b"\x00", 0) == (n, len(data))
    assert flac.crc8(b"123456789") == 0xF4
    assert int(flac.crc16(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0]) == 0xFEE8


def test_operator_on_edge_cases(spark, docs, nothing, tmp_path):
    flac.write_blocks(flac.encode(only(docs, "doc_id", "text")), f"{tmp_path}/a")
    back = flac.read_blocks(spark, f"{tmp_path}/a")
    streams = {}
    for r in back.collect():
        streams.setdefault((r.part, r.stream, r.doc_id), []).append((r.sample_offset, bytes(r.pcm)))
    got = sorted((i, b"".join(x for _, x in sorted(v))) for (_, _, i), v in streams.items())
    assert got == sorted((i, flac.payload_of(t)) for i, t in TEXTS)
    for v in streams.values():
        assert [a for a, _ in sorted(v)] == list(range(0, sum(len(x) for _, x in v), flac.BLOCK_FRAMES * flac.BLOCK))
    whole = flac.payload_of("word " * 30_000)
    for first, last in ((0, 10), (36_860, 36_870), (100, 120_000), (149_999, 10**9)):
        part = flac.read_range(spark, f"{tmp_path}/a", 10, first, last).collect()
        assert b"".join(bytes(r.pcm) for r in sorted(part, key=lambda r: r.sample_offset)) == whole[first:last]
    assert flac.decode(flac.encode(only(nothing, "doc_id", "text"))).count() == 0
    nulls = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    only_row = flac.decode(nulls).first()
    assert only_row.pcm is None and only_row.n_blocks == 0 and flac.digests(flac.decode(nulls)).first().payload_bytes == 0


def test_headers_planted_in_noise_are_passed_over():
    """Verbatim frames of noise that hold the header of this frame, the next or a later one."""
    pick = random.Random(9)
    streams, want = [], []
    for _ in range(400):
        blocks = pick.randrange(1, 4)
        body = bytearray(pick.randbytes(blocks * 576))
        for _ in range(3):
            fake = flac.frame_header(pick.randrange(blocks + 1))
            at = pick.randrange(len(body) - len(fake))
            body[at : at + len(fake)] = bytes(b ^ 0x80 for b in fake)
        want.append(bytes(body))
    streams = flac.encode_streams(want)
    assert [x.tobytes() for x in flac.decode_streams(streams)] == want


def test_a_text_that_spells_a_frame_header():
    # two-byte characters of which 0x81 ends one: FF F8 with other header bits, inside a verbatim frame
    pick = random.Random(10)
    for _ in range(200):
        noise = "".join(chr(pick.choice((pick.randrange(1, 128), pick.randrange(128, 2048)))) for _ in range(pick.randrange(300, 900)))
        at = pick.randrange(len(noise))
        text = noise[:at] + "\x7fx" + chr(pick.randrange(97, 123)) + "\u0101\u00c1" + noise[at:]
        payload = flac.payload_of(text)
        assert flac.decode_streams(flac.encode_streams([payload]))[0].tobytes() == payload
