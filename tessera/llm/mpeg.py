"""MPEG audio: lossless storage of bytes as 8-bit samples of Layer I frames, and a reader for Layers I to III.

The writer makes an ID3v2 tag, a silent frame that carries the Xing table (frames, bytes, 100 seek
points), and frames of 384 samples at 48 kHz, mono, 448 kbit/s, with checksums. All 32 subbands have
8 bits a sample, so that the samples of a frame are 384 bytes in a row; the code 255 is not allowed
there, and no UTF-8 text has that byte. The last frame may be partly filled; the tag has the count.

The reader skips tags, resynchronises on frame headers (a header counts if the next one fits, or the
data ends), verifies checksums, reads Xing, Info and VBRI tables with their seek points, and reports the exact duration in
samples and the offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunked

# Bit rates in kbit/s by table and index, sampling rates by version, samples in a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 3: (11025, 12000, 8000)}  # 3: version 2.5
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

HEADER = bytes((0xFF, 0xFE, 0xE4, 0xC0))  # MPEG 1, Layer I, with checksum; 448 kbit/s, 48 kHz; mono
FRAME, BODY, PER_FRAME = 448, 46, 384
UNIT = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t.astype(np.uint16)


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """MPEG's checksum of each row of bytes (polynomial 0x8005, start 0xFFFF)."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for j in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ CRC[(c >> np.uint16(8)) ^ rows[:, j]]
    return c


#: Layer II: bits of an allocation code by subband, for each table of the standard.
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4, "b": (4,) * 11 + (3,) * 12 + (2,) * 7, "c": (4,) * 2 + (3,) * 6, "d": (4,) * 2 + (3,) * 10,
    "lsf": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def crc16_bits(bits: str) -> int:
    """The same checksum of a text of 0 and 1."""
    c = 0xFFFF
    for b in bits:
        c = (c << 1 ^ (0x8005 if (c >> 15) ^ (b == "1") else 0)) & 0xFFFF
    return c


def layer2_protected(frame: bytes, f: Frame) -> str | None:
    """The bits that a Layer II checksum covers: half of the header, allocation codes and scfsi; None if the frame ends before."""
    channels = 1 if f.mono else 2
    per = f.kbps // channels
    if f.version != 1:
        table = "lsf"
    elif per <= 48:
        table = "d" if f.rate == 32000 else "c"
    else:
        table = "b" if f.rate != 48000 and per >= 96 else "a"
    widths = ALLOCATION[table]
    bound = min(f.bound, len(widths))
    body = "".join(f"{b:08b}" for b in frame[6 : 6 + 64])
    at = used = 0
    for i, w in enumerate(widths):
        for _ in range(channels if i < bound else 1):
            if int(body[at : at + w] or "0", 2):
                used += channels if i >= bound else 1
            at += w
    at += 2 * used
    return f"{frame[2]:08b}{frame[3]:08b}{body[:at]}" if at <= 8 * (len(frame) - 6) else None


def failures(block: np.ndarray, f: Frame) -> int:
    """How many of these protected frames, a row each and with one header, do not have the checksum of what it covers."""
    told = block[:, 4].astype(np.uint16) << np.uint16(8) | block[:, 5]
    if f.layer == 2:
        covered = [layer2_protected(row.tobytes(), f) for row in block]
        return sum(c is None or crc16_bits(c) != t for c, t in zip(covered, told.tolist()))
    if f.layer == 1:
        width = 16 if f.mono else (32 + f.bound) // 2
    else:
        width = (17 if f.mono else 32) if f.version == 1 else 9 if f.mono else 17
    if 6 + width > f.size:
        return len(block)
    return int((crc16(np.concatenate([block[:, 2:4], block[:, 6 : 6 + width]], 1)) != told).sum())


def pad(data: bytes) -> bytes:
    """data and bytes 0, up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def _prefix(allocation: int) -> bytes:
    """Header, checksum, allocation and scale factors of a frame whose subbands all have one allocation code."""
    bits = bytes([allocation * 17]) * 16
    crc = int(crc16(np.frombuffer(HEADER[2:] + bits, np.uint8)[None, :])[0])
    return HEADER + struct.pack(">H", crc) + bits


DATA_PREFIX, SILENT_PREFIX = _prefix(7) + bytes(24), _prefix(0)  # code 7: 8 bits a sample


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


def _unsynchsafe(b: bytes) -> int:
    return sum((x & 127) << s for x, s in zip(b, (21, 14, 7, 0)))


def write(payload: bytes) -> bytes:
    """The stored form of payload, which must not have the byte 255."""
    if b"\xff" in payload:
        raise ValueError("8-bit samples of Layer I cannot hold the code 255")
    frames = -(-len(payload) // PER_FRAME)
    out = np.zeros((frames, FRAME), np.uint8)
    out[:, :BODY] = np.frombuffer(DATA_PREFIX, np.uint8)
    out[:, BODY : BODY + PER_FRAME] = np.frombuffer(payload + bytes(frames * PER_FRAME - len(payload)), np.uint8).reshape(frames, PER_FRAME)
    text = b"\x00payload_bytes\x00" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    tag = b"ID3\x03\x00\x00" + _synchsafe(len(tag)) + tag
    size = (frames + 1) * FRAME
    toc = bytes(min(255, 256 * ((frames + 1) * i // 100) // (frames + 1)) for i in range(100))
    first = SILENT_PREFIX + b"Xing" + struct.pack(">III", 7, frames, size) + toc
    return tag + first + bytes(FRAME - len(first)) + out.tobytes()


@dataclass
class Frame:
    version: int
    layer: int
    protected: bool
    rate: int
    kbps: int
    mono: bool
    size: int
    samples: int
    bound: int  # the first subband whose allocation both channels share; 32 without joint stereo


def header(data: bytes, at: int) -> Frame | None:
    """The frame whose header is at this offset, or None. Free-format frames (no bit rate) are not accepted."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = {3: 1, 2: 2, 0: 3}.get(data[at + 1] >> 3 & 3), 4 - (data[at + 1] >> 1 & 3)
    index, rate = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    table = min(version, 2), layer
    kbps, hz, padding = BITRATES[table][index], RATES[version][rate], data[at + 2] >> 1 & 1
    samples = SAMPLES[table]
    size = (12000 * kbps // hz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + padding
    return Frame(version, layer, not data[at + 1] & 1, hz, kbps, data[at + 3] >> 6 == 3, size, samples, 4 + 4 * (data[at + 3] >> 4 & 3) if data[at + 3] >> 6 == 1 else 32)


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int = 0
    table_bytes: int = 0
    seek: list[int] = field(default_factory=list)  # bytes from the start of the table's frame
    rate: int = 0
    samples: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    checked: int = 0
    bad: int = 0
    skipped: int = 0
    payload: bytes = b""


def _tags(data: bytes, at: int, into: dict[str, str]) -> int:
    """Read ID3v2 tags from this offset on; where they end."""
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        end = at + 10 + _unsynchsafe(data[at + 6 : at + 10]) + 10 * bool(data[at + 5] & 16)
        i, major = at + 10, data[at + 3]
        while major >= 3 and i + 10 <= min(end, len(data)) and data[i : i + 4].isalnum():
            size = _unsynchsafe(data[i + 4 : i + 8]) if major == 4 else int.from_bytes(data[i + 4 : i + 8], "big")
            value = data[i + 10 : min(i + 10 + size, end)]
            if data[i : i + 1] == b"T" and value:
                text = value[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1"), "replace")
                name, _, rest = text.partition("\0") if data[i : i + 4] == b"TXXX" else (data[i : i + 4].decode("latin-1"), "", text)
                into[name] = rest.rstrip("\0")
            i += 10 + size
        at = end
    return at


def _table(data: bytes, at: int, f: Frame, audio: Audio) -> bool:
    """Read a variable-bitrate table from the frame; whether there was one."""
    side = (32 if not f.mono else 17) if f.version == 1 else (17 if not f.mono else 9)
    where = at + 4 + (side if f.layer == 3 else 2 * f.protected + 16)
    name = data[where : where + 4]
    if name in (b"Xing", b"Info"):
        flags, i = int.from_bytes(data[where + 4 : where + 8], "big"), where + 8
        if flags & 1:
            audio.table_frames, i = int.from_bytes(data[i : i + 4], "big"), i + 4
        if flags & 2:
            audio.table_bytes, i = int.from_bytes(data[i : i + 4], "big"), i + 4
        if flags & 4:
            audio.seek = [x * (audio.table_bytes or len(data) - at) // 256 for x in data[i : i + 100]]
    elif data[at + 36 : at + 40] == b"VBRI":
        name = b"VBRI"
        if at + 62 > len(data):
            return False
        audio.table_bytes, audio.table_frames, n, scale, width, _ = struct.unpack(">IIHHHH", data[at + 46 : at + 62])
        toc = data[at + 62 : at + 62 + n * width]
        parts = [scale * int.from_bytes(toc[i : i + width], "big") for i in range(0, len(toc) // width * width, width)] if width else []
        audio.seek = [0, *accumulate(parts)][:-1]
    else:
        return False
    audio.table = name.decode()
    return True


def _equal(block: np.ndarray, first: np.ndarray) -> int:
    """How many rows from the first on start with these bytes; looks at few more rows than those."""
    n, width = 0, 8
    while n < len(block):
        same = (block[n : n + width, : len(first)] == first).all(1)
        if not same.all():
            return n + int(same.argmin())
        n, width = n + len(same), 2 * width
    return n


def read(data: bytes) -> Audio:
    """Parse a stream. The payload is what frames of this module's writer hold, cut to the tag's count."""
    audio = Audio()
    at = _tags(data, 0, audio.tags)
    end = len(data) - 128 * (data[-128:-125] == b"TAG")
    offsets, payload, samples, seen, synced = [], [], 0, False, False
    while at < end:
        f = header(data, at)
        if f and at + f.size <= end and (synced or at + f.size + 4 > end or header(data, at + f.size)):
            if not seen and _table(data, at, f, audio):
                seen, at, synced = True, at + f.size, True
                continue
            # All frames that follow with the same four header bytes lie at one distance: take them at once.
            h, n = data[at : at + 4], 1
            block = np.frombuffer(data, np.uint8, (end - at) // f.size * f.size, at).reshape(-1, f.size)
            n = _equal(block, np.frombuffer(h, np.uint8))
            seen, synced = True, True
            offsets.append(at + f.size * np.arange(n, dtype=np.int64))
            samples, audio.rate = samples + n * f.samples, f.rate
            if f.protected:
                audio.checked, audio.bad = audio.checked + n, audio.bad + failures(block[:n], f)
            if h == HEADER:
                payload.append(block[:n, BODY : BODY + PER_FRAME].tobytes())
            at += n * f.size
        else:
            synced = False
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            audio.skipped, at = audio.skipped + step - at, step
    audio.samples, audio.payload = samples, b"".join(payload)
    audio.offsets = np.concatenate(offsets) if offsets else audio.offsets
    if (n := audio.tags.get("payload_bytes", "")).isdigit():
        audio.payload = audio.payload[: int(n)]
    return audio


def feature(audio: Audio) -> str:
    """Rate, exact duration in samples, frames, checksum failures, table and a digest of the frame offsets."""
    seek = zlib.crc32(audio.offsets.astype("<i8").tobytes())
    return f"{audio.rate}:{audio.samples}:{len(audio.offsets)}:{audio.bad}:{audio.table}{audio.table_frames}:{seek:08x}"


SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, duration_samples bigint, frames bigint, frame_offsets array<bigint>, seek_points array<bigint>, media binary"


def store(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """One row for each row of docs (doc_id, text): the text's UTF-8 bytes as MPEG audio, read back and described.

    A null text counts as empty and is stored as 64 bytes 0, like an empty one. Repeated rows give
    repeated rows, a null doc_id stays null, an empty table gives an empty table, other columns are not
    read. frame_offsets are the bytes at which frames start, seek_points those of the table, counted from
    its own frame. A text is stored whole, one at a time. with_media=False leaves `media` null.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode("utf-8")
                media = write(pad(raw))
                audio = read(media)
                got = audio.payload
                rows.append((len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(audio), audio.samples, len(audio.offsets), audio.offsets, audio.seek, media if with_media else None))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds[1:]))], names=names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
