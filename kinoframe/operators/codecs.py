"""Codec configurations: H.264 parameter sets and their records, AAC configurations.

Parsers are small functions of bytes that run by Arrow batches; each gives its fields and, where the bytes break a rule, the
problem in words and no fields. Rules are those of H.264 (7.3.2, 7.4.2, E.2.1) and ISO/IEC 14496-3 (1.6).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoframe.operators.bitstream import AAC_RATES, annexb_units, by_rows

SPS, PPS = 7, 8
#: Profiles whose sets have a chroma block.
CHROMA_PROFILES = {100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135, 144}
#: Profiles whose record ends after the parameter sets.
SHORT_PROFILES = {66, 77, 88}


class Broken(ValueError):
    """What is wrong with a configuration."""


class Bits:
    """Bits of a payload from the highest on, as one whole number."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise Broken("cut off")
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def flag(self) -> bool:
        return self.take(1) == 1

    def code(self, most: int | None = None, what: str = "") -> int:
        """An unsigned Exp-Golomb code, at most ``most``."""
        zeros = self.left - (self.value & (1 << self.left) - 1).bit_length()
        if zeros > 31:
            raise Broken("cut off" if zeros == self.left else "code too long")
        self.take(zeros)
        n = self.take(zeros + 1) - 1
        if most is not None and n > most:
            raise Broken(f"{what} {n} above {most}")
        return n

    def signed(self, low: int | None = None, high: int = 0, what: str = "") -> int:
        k = self.code()
        n = (k + 1) // 2 if k % 2 else -(k // 2)
        if low is not None and not low <= n <= high:
            raise Broken(f"{what} {n} outside {low} to {high}")
        return n

    def more(self) -> bool:
        """Whether there is more than the closing bit."""
        rest = self.value & (1 << self.left) - 1
        return rest != 0 and rest & -rest != 1 << self.left - 1

    def close(self) -> None:
        """A one and zeros to the end of its byte, which must be the last."""
        if not self.flag():
            raise Broken("no stop bit")
        if self.left >= 8:
            raise Broken("bytes after the end")
        if self.take(self.left):
            raise Broken("padding is not zero")


def unescaped(payload: bytes) -> bytes:
    """A payload without its emulation prevention bytes."""
    out, at = [], 0
    while (hit := payload.find(b"\x00\x00\x03", at)) >= 0:
        out.append(payload[at : hit + 2])
        at = hit + 3
    return b"".join([*out, payload[at:]])


def scaling_list(bits: Bits, size: int) -> None:
    last = scale = 8
    for _ in range(size):
        if scale:
            scale = (last + bits.signed(-128, 127, "delta_scale")) % 256
        last = scale or last


def hrd(bits: Bits) -> None:
    count = bits.code(31, "cpb_cnt_minus1") + 1
    bits.take(8)
    for _ in range(count):
        bits.code(), bits.code(), bits.take(1)
    bits.take(20)


def usability(bits: Bits, references: int) -> None:
    """The parameters that say how to show the pictures: read over, with their limits."""
    if bits.flag() and bits.take(8) == 255:
        bits.take(32)
    if bits.flag():
        bits.take(1)
    if bits.flag():
        bits.take(4)
        if bits.flag():
            bits.take(24)
    if bits.flag():
        for side in ("top", "bottom"):
            bits.code(5, f"chroma_sample_loc_type_{side}_field")
    if bits.flag():
        if not (bits.take(32) and bits.take(32)):
            raise Broken("timing of zero")
        bits.take(1)
    timed = False
    for _ in range(2):
        if bits.flag():
            hrd(bits)
            timed = True
    bits.take(2 if timed else 1)
    if bits.flag():
        bits.take(1)
        for what in ("max_bytes_per_pic_denom", "max_bits_per_mb_denom", "log2_max_mv_length_horizontal", "log2_max_mv_length_vertical"):
            bits.code(16, what)
        reorder, held = bits.code(16, "max_num_reorder_frames"), bits.code(16, "max_dec_frame_buffering")
        if reorder > held or held < references:
            raise Broken("fewer frames held than needed")


def sequence_set(nal: bytes) -> dict:
    """Fields of a sequence parameter set, header byte included."""
    bits = Bits(unescaped(nal[1:]))
    profile, constraints = bits.take(8), bits.take(8)
    if constraints & 3:
        raise Broken("reserved bits are set")
    level, number = bits.take(8), bits.code(31, "seq_parameter_set_id")
    chroma, luma_bits, chroma_bits = 1, 8, 8
    if profile in CHROMA_PROFILES:
        chroma = bits.code(3, "chroma_format_idc")
        if chroma == 3:
            bits.take(1)
        luma_bits, chroma_bits = bits.code(6, "bit_depth_luma_minus8") + 8, bits.code(6, "bit_depth_chroma_minus8") + 8
        bits.take(1)
        if bits.flag():
            for i in range(12 if chroma == 3 else 8):
                if bits.flag():
                    scaling_list(bits, 16 if i < 6 else 64)
    bits.code(12, "log2_max_frame_num_minus4")
    order = bits.code(2, "pic_order_cnt_type")
    if order == 0:
        bits.code(12, "log2_max_pic_order_cnt_lsb_minus4")
    elif order == 1:
        bits.take(1), bits.signed(), bits.signed()
        for _ in range(bits.code(255, "num_ref_frames_in_pic_order_cnt_cycle")):
            bits.signed()
    references = bits.code(16, "max_num_ref_frames")
    bits.take(1)
    across, down = bits.code() + 1, bits.code() + 1
    frames = bits.flag()
    if not frames:
        bits.take(1)
    width, height = 16 * across, 16 * down * (1 if frames else 2)
    if max(width, height) > 65535 or (8 * width + 1024) * (height + 128) >= 1 << 31:
        raise Broken(f"a picture of {width}x{height}")
    bits.take(1)
    shown = [width, height]
    if bits.flag():
        left, right, top, bottom = (bits.code() for _ in range(4))
        shown[0] -= (left + right) * (2 if chroma in (1, 2) else 1)
        shown[1] -= (top + bottom) * (2 if chroma == 1 else 1) * (1 if frames else 2)
        if min(shown) <= 0:
            raise Broken("nothing is left of the picture")
    if bits.flag():
        usability(bits, references)
    bits.close()
    return {"id": number, "profile": profile, "constraints": constraints, "level": level, "chroma": chroma, "luma_bits": luma_bits, "chroma_bits": chroma_bits, "width": shown[0], "height": shown[1], "coded_width": width, "coded_height": height}


def slice_groups(bits: Bits, groups: int, cells: int, across: int, down: int) -> None:
    kind = bits.code(6, "slice_group_map_type")
    if kind == 0:
        for _ in range(groups):
            bits.code(cells - 1, "run_length_minus1")
    elif kind == 2:
        for _ in range(groups - 1):
            first, last = bits.code(), bits.code(cells - 1, "bottom_right")
            if first > last or first % across > last % across:
                raise Broken("corners of a slice group")
    elif kind >= 3 and kind <= 5:
        bits.take(1)
        bits.code(cells - 1, "slice_group_change_rate_minus1")
    elif kind == 6:
        if bits.code() + 1 != cells:
            raise Broken("size of the slice group map")
        for _ in range(cells):
            if bits.take((groups - 1).bit_length()) >= groups:
                raise Broken("slice group")


def picture_set(nal: bytes, sets: dict[int, dict]) -> tuple[int, int]:
    """Numbers of a picture parameter set and of the sequence set it refers to, one of ``sets``."""
    bits = Bits(unescaped(nal[1:]))
    number, of = bits.code(255, "pic_parameter_set_id"), bits.code(31, "seq_parameter_set_id")
    if of not in sets:
        raise Broken(f"refers to sequence set {of}, which is not there")
    sps = sets[of]
    bits.take(2)
    if groups := bits.code(7, "num_slice_groups_minus1"):
        across, down = sps["coded_width"] // 16, sps["coded_height"] // 16
        slice_groups(bits, groups + 1, across * down, across, down)
    bits.code(31, "num_ref_idx_l0_default_active_minus1"), bits.code(31, "num_ref_idx_l1_default_active_minus1")
    bits.take(1)
    if bits.take(2) > 2:
        raise Broken("weighted_bipred_idc 3")
    bits.signed(-(26 + 6 * (sps["luma_bits"] - 8)), 25, "pic_init_qp_minus26")
    bits.signed(-26, 25, "pic_init_qs_minus26")
    bits.signed(-12, 12, "chroma_qp_index_offset")
    bits.take(3)
    if bits.more():
        wide = bits.flag()
        if bits.flag():
            for i in range(6 + (0 if not wide else 6 if sps["chroma"] == 3 else 2)):
                if bits.flag():
                    scaling_list(bits, 16 if i < 6 else 64)
        bits.signed(-12, 12, "second_chroma_qp_index_offset")
    bits.close()
    return number, of


def record_units(data: bytes) -> tuple[list[bytes], list[bytes], bytes]:
    """Sequence sets, picture sets, and what follows them, of a decoder configuration record."""
    if len(data) < 7 or data[0] != 1:
        raise Broken("no record of version 1")
    if data[4] != 0xFF or data[5] & 0xE0 != 0xE0:
        raise Broken("reserved bits, or lengths that do not have 4 bytes")
    at, found = 5, []
    for kind, mask in ((SPS, 0x1F), (PPS, 0xFF)):
        if at >= len(data):
            raise Broken("cut off")
        units, count = [], data[at] & mask
        at += 1
        for _ in range(count):
            size = int.from_bytes(data[at : at + 2])
            unit = data[at + 2 : at + 2 + size]
            if not size or len(unit) < size:
                raise Broken("a set is cut off")
            if unit[0] & 0x80 or unit[0] & 31 != kind:
                raise Broken(f"a unit of type {unit[0] & 31} among those of type {kind}")
            units.append(unit)
            at += 2 + size
        found.append(units)
    return found[0], found[1], data[at:]


def extension_of(sps: dict) -> bytes:
    """What a record of a high profile ends with: chroma format and bit depths."""
    return b"" if sps["profile"] in SHORT_PROFILES else bytes([0xFC | sps["chroma"], 0xF8 | sps["luma_bits"] - 8, 0xF8 | sps["chroma_bits"] - 8, 0])


def configuration(data: bytes) -> dict:
    """Parameter sets of a record or of an Annex-B stream: the first one's fields, codec string, record and fingerprint.

    Two configurations are the same if, by number, their sets hold the same bytes, the last of a number counting, and each
    picture set the same sequence set; headers and order do not matter.
    """
    tail = None
    if data[:1] == b"\x01":
        sequence, picture, tail = record_units(data)
    else:
        units, problem = annexb_units(data)
        if problem:
            raise Broken(problem)
        for u in units:
            if u[0] & 0x80 or u[0] & 31 not in (SPS, PPS):
                raise Broken(f"a unit of type {u[0] & 31}")
        sequence, picture = ([u for u in units if u[0] & 31 == k] for k in (SPS, PPS))
        if units[0][0] & 31 != SPS:
            raise Broken("a picture set in front of its sequence set")
    if not sequence or not picture:
        raise Broken("no sequence set or no picture set")
    first, sets, bodies, slots = None, {}, {}, {}
    for u in sequence:
        sps = sequence_set(u)
        first = first or sps
        sets[sps["id"]], bodies[sps["id"]] = sps, u[1:]
    for u in picture:
        number, of = picture_set(u, sets)
        slots[number] = u[1:] + b"|" + bodies[of]
    if tail is not None:
        if data[1:4] != sequence[0][1:4]:
            raise Broken("profile and level are not those of the first set")
        if tail and first["profile"] not in SHORT_PROFILES and tail[:3] != extension_of(first)[:3]:
            raise Broken("the ending is not that of the first set")
    print_ = hashlib.sha256(repr((sorted(bodies.items()), sorted(slots.items()))).encode()).hexdigest()
    return {**first, "codec": "avc1." + sequence[0][1:4].hex().upper(), "n_sps": len(sequence), "n_pps": len(picture), "record": record_of(sequence, picture, first), "fingerprint": print_}


def record_of(sequence: list[bytes], picture: list[bytes], first: dict) -> bytes:
    """A decoder configuration record with lengths of 4 bytes."""
    if len(sequence) > 31 or len(picture) > 255 or max(map(len, sequence + picture)) > 65535:
        raise Broken("too many or too large sets for a record")
    listed = lambda units: b"".join(len(u).to_bytes(2) + u for u in units)
    return bytes([1]) + sequence[0][1:4] + bytes([0xFF, 0xE0 | len(sequence)]) + listed(sequence) + bytes([len(picture)]) + listed(picture) + extension_of(first)


def told(parse: Callable[[bytes], dict], names: list[str]) -> Callable[[bytes], tuple]:
    """A parser's fields in order, then its problem."""

    def work(data: bytes) -> tuple:
        try:
            found = parse(data)
            return (*(found[n] for n in names), None)
        except (Broken, IndexError) as e:
            return (*(None for _ in names), str(e) or "cut off")

    return work


SEQUENCE = "id int, profile int, constraints int, level int, chroma int, luma_bits int, chroma_bits int, width int, height int"
CONFIGURATION = f"{SEQUENCE}, codec string, n_sps int, n_pps int, record binary, fingerprint string"


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def sequence_sets(rows: DataFrame, binary: str = "data") -> DataFrame:
    """Rows with the fields of a sequence parameter set (a NAL unit), or its problem."""
    return by_rows(rows, binary, told(sequence_set, names_of(SEQUENCE)), f"{SEQUENCE}, problem string")


def configurations(rows: DataFrame, binary: str = "data") -> DataFrame:
    """Rows with the fields of an H.264 configuration (a record or Annex-B), or its problem."""
    return by_rows(rows, binary, told(configuration, names_of(CONFIGURATION)), f"{CONFIGURATION}, problem string")


def changes(found: DataFrame) -> DataFrame:
    """Rows of a stream whose configuration is not the one before it; streams without a change have none."""
    from kinoframe.operators.scan import ordered

    return found.withColumn("_before", F.lag("fingerprint").over(ordered())).where(F.col("_before") != F.col("fingerprint")).drop("_before")


# --- AAC ---

#: Object types that share one layout of what follows the channels.
GENERAL = {1, 2, 3, 4, 6, 7, 17, 19, 20, 21, 22, 23}


def object_type(bits: Bits) -> int:
    n = bits.take(5)
    return 32 + bits.take(6) if n == 31 else n


def rate_of(bits: Bits) -> tuple[int, int]:
    """Index and hertz; index 15 has the number itself."""
    n = bits.take(4)
    if n in (13, 14):
        raise Broken(f"reserved rate {n}")
    return n, bits.take(24) if n == 15 else AAC_RATES[n]


def program_channels(bits: Bits, rate: int) -> int:
    """Channels of a program configuration element."""
    bits.take(6)
    if bits.take(4) != rate:
        raise Broken("the program's rate is not the stream's")
    front, side, back, low, data, coupling = (bits.take(n) for n in (4, 4, 4, 2, 3, 4))
    for n in (4, 4, 3):
        if bits.flag():
            bits.take(n)
    channels = 0
    for _ in range(front + side + back):
        channels += 2 if bits.flag() else 1
        bits.take(4)
    bits.take(4 * low + 4 * data + 5 * coupling)
    return channels + low


def audio_configuration(data: bytes) -> dict:
    """Fields of an AudioSpecificConfig: core object type, rate and channels, and the extension it signals."""
    bits = Bits(data)
    kind = object_type(bits)
    if not kind:
        raise Broken("no object type")
    index, hz = rate_of(bits)
    channels = bits.take(4)
    extension, extended = None, None
    if kind in (5, 29):  # a wrapper: the rate of the extension, then the core
        extension = "ps" if kind == 29 else "sbr"
        extended = rate_of(bits)[1]
        kind = object_type(bits)
        if kind == 22:
            bits.take(4)
    if 8 <= channels <= 10 or channels > 14:
        raise Broken(f"channel configuration {channels}")
    count = [0, 1, 2, 3, 4, 5, 6, 8, 0, 0, 0, 7, 8, 24, 8][channels]
    if not channels and kind not in GENERAL:
        raise Broken("no channels")
    if kind in GENERAL:
        bits.take(1)
        if bits.flag():
            bits.take(14)
        bits.take(1)
        if not channels:
            count = program_channels(bits, index)
    return {"object_type": kind, "sample_rate": hz, "channels": count, "extension": extension, "extended_rate": extended, "codec": f"mp4a.40.{kind if extension is None else {'sbr': 5, 'ps': 29}[extension]}"}


AUDIO = "object_type int, sample_rate int, channels int, extension string, extended_rate int, codec string"


def audio_configurations(rows: DataFrame, binary: str = "data") -> DataFrame:
    """Rows with the fields of an AAC configuration, or its problem."""
    return by_rows(rows, binary, told(audio_configuration, names_of(AUDIO)), f"{AUDIO}, problem string")


# --- bit fields as text, to write configurations with column functions ---


def field(n: Column, width: int) -> Column:
    return F.lpad(F.bin(n), width, "0")


def exp_golomb(n: Column) -> Column:
    """An unsigned Exp-Golomb code as zeros and ones."""
    own = F.bin(n + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(own) - 1), own)


def packed_bits(text: Column) -> Column:
    """Zeros and ones with a closing one, padded with zeros to bytes."""
    closed = F.concat(text, F.lit("1"))
    size = F.ceil(F.length(closed) / 8).cast("int")
    whole = F.rpad(closed, size * 8, F.lit("0"))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.conv(F.substr(whole, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")), ""))
