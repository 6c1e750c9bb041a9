"""Media column of MPEG audio: bytes kept in a Layer III frame stream, and a reader that trusts nothing.

Writing. A payload is cut into units of 576 bytes. Each unit travels as the ancillary data of one frame (MPEG-1 Layer III,
48 kHz, stereo, protected): empty side information, so a player hears silence, then a length of two bytes, the unit without
its trailing 255s, and zeros. A frame takes the smallest bitrate that holds its unit, so streams have a variable bitrate and
carry a Xing frame with frame count, byte count and a seek table of 100 entries. An ID3v2 tag holds the length before padding,
an ID3v1 tag ends the stream.

Reading. Tags (ID3v1, ID3v2.2 to 2.4 with extended headers, unsynchronisation and all four text encodings) and tables of
variable bitrates (Xing, Info, VBRI) are parsed. The stream's kind (version, layer, rate, channels) is that of its first two
headers that agree and follow each other at the frame's length. Where a frame begins at the end of the one before, its header
must be of the stream's kind; elsewhere (resynchronisation: bytes passed over count as lost) its checksum must hold as well and
the next header of that kind, a tag or the end must follow. CRC-16 is verified in frames of layer III and I; those of layer II,
whose protected part depends on allocation tables, are counted as unchecked. A frame of a bad checksum keeps its place: its unit
is read as padding. Durations are exact: samples over rate, summed by rate.

The media table holds the stream, its exact duration and the byte offset of every frame; seek() reads from there alone.

Style: mapInArrow, one row in, one row out, batches bounded by bytes; no shuffle. Equal payloads give equal streams.

Cases: null or empty text gives one unit of padding; streams without any frame have n_frames 0, a null rate and no payload;
repeated rows give equal rows; other columns are not read; a very long text is a batch of its own (some 10 bytes of memory for
each of its bytes).
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, utf8, written

UNIT = 576
PAD = b"\xff"
SIDE = 32  # bytes of side information of a stereo frame of MPEG-1

#: Fixed values of the format: kbit/s by index for (version 1 layer I, II, III; version 2 layer I, II and III).
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    size: int
    samples: int
    rate: int
    kbps: int
    protected: bool
    side: int
    layer: int
    version: int
    checked: int  # protected bytes behind the checksum: side information or bit allocation; -1 where tables would be needed

    @property
    def kind(self) -> tuple[int, int, int, int]:
        """What all frames of a stream share."""
        return self.version, self.layer, self.rate, self.side


@functools.lru_cache(maxsize=4096)
def header(head: bytes) -> Header | None:
    """The frame header in four bytes, or None if it is not valid (free-format streams are not accepted)."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    bits, rate = head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3 or head[3] & 3 == 2:
        return None
    kbps, hz, pad, mono = BITRATES[1 if version == 3 else 2, layer][bits], RATES[version][rate], head[2] >> 1 & 1, head[3] >> 6 == 3
    if layer == 1:
        size, samples = (12_000 * kbps // hz + pad) * 4, 384
    else:
        samples = 1152 if layer == 2 or version == 3 else 576
        size = samples // 8 * 1000 * kbps // hz + pad
    side = ((17 if mono else 32) if version == 3 else (9 if mono else 17)) if layer == 3 else 0
    # layer I: 4 bits for each subband and channel, one for both channels from the bound of joint stereo on
    bound = 4 * (1 + (head[3] >> 4 & 3)) if head[3] >> 6 == 1 else 32
    checked = {3: side, 2: -1, 1: (16 if mono else (32 + bound) // 2)}[layer]
    return Header(size, samples, hz, kbps, not head[1] & 1, side, layer, version, checked)


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


_CRC = _crc_table()


@functools.lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def _head(kbps: int, protected: bool = True) -> bytes:
    """MPEG-1 Layer III, 48 kHz, stereo, original."""
    return bytes((0xFF, 0xFA if protected else 0xFB, BITRATES[1, 3].index(kbps) << 4 | 1 << 2, 0x04))


def _frame_start(kbps: int) -> bytes:
    h = _head(kbps)
    return h + crc16(h[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)


#: kbit/s and bytes of a unit that fit a frame of 3 bytes a kbit/s, less header, checksum, side information and length.
FITS = [(kbps, 3 * kbps - 4 - 2 - SIDE - 2) for kbps in BITRATES[1, 3][1:]]
STARTS = {kbps: _frame_start(kbps) for kbps, _ in FITS}
FULL = next(kbps for kbps, room in FITS if room >= UNIT)


def synchsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def id3v2(fields: dict[str, str]) -> bytes:
    body = b""
    for key, value in fields.items():
        text = b"\x00" + key.encode("latin-1") + b"\x00" + value.encode("latin-1")
        body += b"TXXX" + len(text).to_bytes(4, "big") + b"\x00\x00" + text
    return b"ID3\x03\x00\x00" + synchsafe(len(body)) + body


def _xing(offsets: np.ndarray, total: int) -> bytes:
    """The frame before the others: counts and, for each hundredth of the time, where it begins in 256ths of the bytes."""
    at = offsets[np.arange(100) * len(offsets) // 100]
    toc = np.minimum(255, at * 256 // total).astype(np.uint8).tobytes()
    body = _head(64, protected=False) + bytes(SIDE) + b"Xing" + (7).to_bytes(4, "big") + len(offsets).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return body.ljust(192, b"\0")


def payload_of(text: bytes) -> bytes:
    """Padded with 255 to a positive multiple of the unit."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, PAD)


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A stream for a payload of whole units; n_bytes goes into its tag."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    # the unit without its trailing 255s
    lengths = UNIT - (units[:, ::-1] != 255).argmax(axis=1)
    lengths[(units == 255).all(axis=1)] = 0
    rooms = np.array([room for _, room in FITS])
    which = np.searchsorted(rooms, lengths)
    sizes = np.array([3 * kbps for kbps, _ in FITS])[which]
    offsets = 192 + np.concatenate(([0], np.cumsum(sizes)[:-1]))
    parts = []
    i, n = 0, len(units)
    same = np.flatnonzero(lengths != UNIT)
    while i < n:  # runs of full units at once
        k = np.searchsorted(same, i)
        end = same[k] if k < len(same) else n
        if end > i:
            block = np.zeros((end - i, 3 * FULL), np.uint8)
            start = STARTS[FULL] + UNIT.to_bytes(2, "big")
            block[:, : len(start)] = np.frombuffer(start, np.uint8)
            block[:, len(start) : len(start) + UNIT] = units[i:end]
            parts.append(block.tobytes())
        if end < n:
            kbps, size = FITS[which[end]][0], int(lengths[end])
            parts.append((STARTS[kbps] + size.to_bytes(2, "big") + units[end, :size].tobytes()).ljust(3 * kbps, b"\0"))
        i = end + 1
    total = 192 + int(sizes.sum())
    tail = b"TAG" + b"tidewright".ljust(30, b"\0") + bytes(94) + b"\xff"
    return id3v2({"n_bytes": str(n_bytes)}) + _xing(offsets, total) + b"".join(parts) + tail


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)  # of sounding frames
    samples_by_rate: dict[int, int] = field(default_factory=dict)
    kbps: set[int] = field(default_factory=set)
    crc_ok: int = 0
    crc_bad: int = 0
    crc_unchecked: int = 0
    lost: int = 0  # bytes passed over to find a header
    table: str | None = None  # kind of the variable-bitrate table
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: list[int] | None = None
    payload: bytes = b""

    @property
    def samples(self) -> int:
        return sum(self.samples_by_rate.values())

    @property
    def rate(self) -> int | None:
        """The rate of all frames; None if there is none or more than one."""
        return next(iter(self.samples_by_rate)) if len(self.samples_by_rate) == 1 else None

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly."""
        return sum((Fraction(n, rate) for rate, n in self.samples_by_rate.items()), Fraction(0))


def _unsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _tag_text(body: bytes) -> list[str]:
    """The parts of a text frame: its first byte names the encoding, zeros part them."""
    if not body or body[0] > 3:
        return []
    text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0]], "replace")
    return [part.lstrip("\ufeff") for part in text.split("\0")]


def _id3v2(data: bytes) -> tuple[dict[str, str], int]:
    """Text tags of an ID3v2 block at the begin of data, and where it ends; ({}, 0) if there is none."""
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4):
        return {}, 0
    major, flags, size = data[3], data[5], _unsafe(data[6:10])
    stop = min(len(data), 10 + size + 10 * (major == 4 and bool(flags & 0x10)))
    body = data[10 : min(len(data), 10 + size)]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    i, tags = 0, {}
    if flags & 0x40 and major > 2 and len(body) >= 4:
        i = 4 + int.from_bytes(body[:4], "big") if major == 3 else _unsafe(body[:4])
    wide, head = (4, 10) if major > 2 else (3, 6)
    while i + head <= len(body) and body[i]:
        name = body[i : i + wide]
        n = _unsafe(body[i + 4 : i + 8]) if major == 4 else int.from_bytes(body[i + wide : i + 2 * wide], "big")
        part = body[i + head : i + head + n]
        if len(part) < n:
            break
        if major == 4 and (body[i + 9] & 0x02 or flags & 0x80):
            part = part.replace(b"\xff\x00", b"\xff")
        if major == 4 and body[i + 9] & 0x01:
            part = part[4:]
        texts = _tag_text(part) if name[:1] == b"T" else []
        if name in (b"TXXX", b"TXX") and len(texts) > 1:
            tags[texts[0]] = texts[1]
        elif texts:
            tags[name.decode("latin-1")] = texts[0]
        i += head + n
    return tags, stop


def parse_tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Tags, and where the frames begin and end."""
    tags, start = _id3v2(data)
    end = len(data)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["title"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    return tags, start, end


def _table(data: bytes, i: int, h: Header, out: Stream) -> bool:
    """Whether the frame at i holds a variable-bitrate table, which is read then."""
    number = lambda at, n: int.from_bytes(data[at : at + n], "big")
    at = i + 4 + 2 * h.protected + h.side
    name = data[at : at + 4]
    if h.layer == 3 and name in (b"Xing", b"Info") and at + 8 <= i + h.size:
        flags, at = number(at + 4, 4), at + 8
        out.table = name.decode()
        if flags & 1:
            out.table_frames, at = number(at, 4), at + 4
        if flags & 2:
            out.table_bytes, at = number(at, 4), at + 4
        if flags & 4:
            out.toc = list(data[at : at + 100])
        return True
    at = i + 36
    if h.layer == 3 and data[at : at + 4] == b"VBRI" and at + 26 <= i + h.size:
        out.table, out.table_bytes, out.table_frames = "VBRI", number(at + 10, 4), number(at + 14, 4)
        n, scale, width = number(at + 18, 2), number(at + 20, 2), number(at + 22, 2)
        if 1 <= width <= 4 and at + 26 + n * width <= i + h.size:
            sizes = [number(at + 26 + k * width, width) * scale for k in range(n)]
            out.toc = [0, *accumulate(sizes)]
        return True
    return False


def _checksum(data: bytes, i: int, h: Header) -> bool | None:
    """Whether the checksum of the frame at i holds; None if it has none or it cannot be computed."""
    if not h.protected or h.checked < 0 or i + 6 + h.checked > len(data):
        return None
    return crc16(data[i + 2 : i + 4] + data[i + 6 : i + 6 + h.checked]) == int.from_bytes(data[i + 4 : i + 6], "big")


def parse(data: bytes) -> Stream:
    out = Stream()
    out.tags, i, end = parse_tags(data)
    kind, synced, first, parts = None, False, True, []

    def follows(at: int, want: tuple) -> bool:
        """A header of the kind stands there, or the stream ends there."""
        if at == end:
            return True
        h = header(data[at : at + 4]) if at + 4 <= end else None
        return h is not None and h.kind == want

    while i + 4 <= end:
        h = header(data[i : i + 4])
        if h is not None and i + h.size <= end and (kind is None or h.kind == kind):
            ok = synced or (follows(i + h.size, h.kind) and _checksum(data, i, h) is not False)
        else:
            ok = False
        if not ok:
            j = data.find(b"\xff", i + 1, end)
            j = end if j < 0 else j
            out.lost += j - i
            i, synced = j, False
            continue
        kind, synced = h.kind, True
        if not (first and _table(data, i, h, out)):
            out.offsets.append(i)
            out.samples_by_rate[h.rate] = out.samples_by_rate.get(h.rate, 0) + h.samples
            out.kbps.add(h.kbps)
            good = _checksum(data, i, h)
            out.crc_ok += good is True
            out.crc_bad += good is False
            out.crc_unchecked += h.protected and good is None
            if h.layer == 3:
                body = i + 4 + 2 * h.protected + h.side
                n = int.from_bytes(data[body : body + 2], "big")
                whole = good is not False and n <= min(UNIT, i + h.size - body - 2)
                parts.append((data[body + 2 : body + 2 + n] if whole else b"").ljust(UNIT, PAD))
        first = False
        i += h.size
    out.lost += max(0, end - i)
    out.payload = b"".join(parts)
    return out


def seek(data: bytes, offsets: Sequence[int], second: Fraction, rate: int, samples: int = 1152) -> bytes:
    """The unit of the frame that sounds at a second, read from its offset alone."""
    k = int(second * rate // samples)
    h = header(data[offsets[k] : offsets[k] + 4])
    body = offsets[k] + 4 + 2 * h.protected + h.side
    return data[body + 2 : body + 2 + int.from_bytes(data[body : body + 2], "big")].ljust(UNIT, PAD)


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The media table: key, n_bytes, the stream of each text (media), its exact duration as samples and rate, and the offset of every frame."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = utf8(batch.column(1))
            media = [encode(payload_of(x), len(x)) for x in raw]
            found = [parse(m) for m in media]
            return pa.record_batch(
                [
                    batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary()), pa.array((s.samples for s in found), pa.int64()), pa.array((s.rate for s in found), pa.int32()),
                    pa.array((s.offsets for s in found), pa.list_(pa.int64())),
                ],
                names=[key, "n_bytes", "media", "n_samples", "sample_rate", "seek_offsets"],
            )

        return each

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), make, f"{key} {kind}, n_bytes long, media binary, n_samples long, sample_rate int, seek_offsets array<long>", sized_by=1)


def read_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Parses the column media: payload, tags, exact duration (samples and rate), seek offsets and what was found wrong."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [parse(x or b"") for x in batch.column(1).to_pylist()]
            columns = {
                key: batch.column(0),
                "n_bytes": pa.array((int(t) if re.fullmatch(r"[0-9]{1,18}", t := s.tags.get("n_bytes", "")) else None for s in found), pa.int64()),
                "payload": pa.array((s.payload for s in found), pa.binary()),
                "n_samples": pa.array((s.samples for s in found), pa.int64()),
                "sample_rate": pa.array((s.rate for s in found), pa.int32()),
                "duration_us": pa.array((int(s.duration * 1_000_000) for s in found), pa.int64()),
                "n_frames": pa.array((len(s.offsets) for s in found), pa.int64()),
                "seek_offsets": pa.array((s.offsets for s in found), pa.list_(pa.int64())),
                "is_vbr": pa.array((len(s.kbps) > 1 for s in found), pa.bool_()),
                "table_ok": pa.array((s.table_frames == len(s.offsets) and s.toc is not None for s in found), pa.bool_()),
                "crc_ok": pa.array((s.crc_ok for s in found), pa.int64()),
                "crc_bad": pa.array((s.crc_bad for s in found), pa.int64()),
                "crc_unchecked": pa.array((s.crc_unchecked for s in found), pa.int64()),
                "lost_bytes": pa.array((s.lost for s in found), pa.int64()),
            }
            return pa.record_batch(list(columns.values()), names=list(columns))

        return each

    kind = media.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_bytes long, payload binary, n_samples long, sample_rate int, duration_us long, n_frames long, seek_offsets array<long>, is_vbr boolean, table_ok boolean, crc_ok long, crc_bad long, crc_unchecked long, lost_bytes long"
    return map_batches(media.select(key, "media"), make, schema, sized_by=1)


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores the media table of all texts, reads it back and digests the stored bytes: the row that op2 returns.

    index_ok: what the table says of duration and frame offsets is what the stored stream holds.
    """
    stored = written(to_media(docs), "media")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_us", "index_ok")}
            for stream, samples, rate, offsets in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                s = parse(stream)
                values = (
                    int(s.tags["n_bytes"]), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(),
                    f"samples={s.samples};rate={s.rate};frames={len(s.offsets)};vbr={int(len(s.kbps) > 1)};table={int(s.table_frames == len(s.offsets))};crc_ok={s.crc_ok};crc_bad={s.crc_bad};lost={s.lost};seek={zlib.crc32(np.asarray(s.offsets, '<u4').tobytes())}",
                    len(s.offsets), int(s.duration * 1_000_000), (samples, rate, offsets) == (s.samples, s.rate, s.offsets),
                )
                for k, v in zip(rows, values):
                    rows[k].append(v)
            kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string(), "index_ok": pa.bool_()}
            return pa.record_batch([batch.column(0), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items())], names=["doc_id", *rows])

        return each

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_us long, index_ok boolean"
    return map_batches(stored.select(F.col("doc_id").cast("long").alias("doc_id"), "media", "n_samples", "sample_rate", "seek_offsets"), make, schema, sized_by=1)
