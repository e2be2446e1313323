"""Ogg media columns: pages with checksums, packets laced into segments, multiplexed logical streams, granule times."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as w

RATE = 8000  # samples a second of the stored payload
FRAME = 4096  # samples in a packet
FRAME_STEP = 64  # the payload is a positive multiple of this
SOUND, NOTES = 1, 2  # serial numbers of the two logical streams
# Fixed values of the container format.
_HEAD = struct.Struct("<4sBBqIIIB")  # the granule position is signed: -1 where no packet ends
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_SEGMENTS = 255
# Eight-bit samples in the raw audio mapping: name, version, format (unsigned 8 bit), rate, significant bits, channels,
# most frames a packet, extra headers.
_SOUND_HEADER = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, FRAME, 0)
_NOTES_HEADER, _NOTE = b"NOTES   ", struct.Struct("<QQ")  # unpadded length, samples
_TURNED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


class Damaged(ValueError):
    """A page, a packet or a stream that does not follow the format."""


def checksum(page: bytes) -> int:
    """The container's CRC (most significant bit first, no inversion), by way of the common reflected one: both divide
    by the same polynomial, so turning the bits of the input bytes and of the result turns one into the other."""
    value = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(value.to_bytes(4, "little").translate(_TURNED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


@dataclass
class Stream:
    """Writer of one logical stream: packets go into pages of at most 255 segments."""

    serial: int
    out: list[bytes]
    number: int = 0
    lacing: bytearray = field(default_factory=bytearray)
    body: bytearray = field(default_factory=bytearray)
    granule: int = -1
    continued: bool = False

    def packet(self, data: bytes, granule: int) -> None:
        values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        at = taken = 0
        while at < len(values):
            if len(self.lacing) == _SEGMENTS:
                self.flush(goes_on=at > 0)
            part = values[at:at + _SEGMENTS - len(self.lacing)]
            size = sum(part)
            self.lacing += part
            self.body += data[taken:taken + size]
            at, taken = at + len(part), taken + size
        self.granule = granule

    def flush(self, last: bool = False, goes_on: bool = False) -> None:
        flags = _CONTINUED * self.continued | _FIRST * (self.number == 0) | _LAST * last
        self.out.append(page(flags, self.granule, self.serial, self.number, bytes(self.lacing), bytes(self.body)))
        self.number, self.lacing, self.body, self.granule, self.continued = self.number + 1, bytearray(), bytearray(), -1, goes_on


def stored(payload: bytes, n_bytes: int) -> bytes:
    """The payload as 8-bit samples in one logical stream, its unpadded length in a second one; pages alternate."""
    pages: list[bytes] = []
    sound, notes = Stream(SOUND, pages), Stream(NOTES, pages)
    for stream, header in ((sound, _SOUND_HEADER), (notes, _NOTES_HEADER)):
        stream.packet(header, 0)
        stream.flush()
    notes.packet(_NOTE.pack(n_bytes, len(payload)), 0)
    for start in range(0, len(payload), FRAME):
        sound.packet(payload[start:start + FRAME], min(start + FRAME, len(payload)))
        if start == 0:
            sound.flush(last=len(payload) <= FRAME)
            notes.flush(last=True)
    if sound.lacing:
        sound.flush(last=True)
    return b"".join(pages)


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes


def pages(media: bytes) -> Iterator[Page]:
    """All pages in order, each with its checksum verified."""
    at = 0
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise Damaged(f"page cut short at {at}")
        mark, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(media, at)
        if mark != b"OggS" or version:
            raise Damaged(f"no page at {at}")
        start = at + _HEAD.size + segments
        lacing = media[at + _HEAD.size:start]
        stop = start + sum(lacing)
        if len(lacing) < segments or stop > len(media):
            raise Damaged(f"page cut short at {at}")
        if checksum(media[at:at + 22] + b"\0\0\0\0" + media[at + 26:stop]) != crc:
            raise Damaged(f"checksum of the page at {at}")
        yield Page(flags, granule, serial, number, lacing, media[start:stop])
        at = stop


@dataclass
class Packets:
    """What one logical stream holds: its packets, and the granule position each ends at (None: its page ends later)."""

    data: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    n_pages: int = 0
    ended: bool = False


def streams(media: bytes) -> dict[int, Packets]:
    """Logical streams by serial number; raises Damaged for lost pages, open packets or missing ends."""
    out: dict[int, Packets] = {}
    open_parts: dict[int, list[bytes]] = {}
    for p in pages(media):
        own = out.setdefault(p.serial, Packets())
        parts = open_parts.setdefault(p.serial, [])
        if own.ended or p.number != own.n_pages or bool(p.flags & _FIRST) != (own.n_pages == 0):
            raise Damaged(f"stream {p.serial} lacks page {own.n_pages}")
        if bool(p.flags & _CONTINUED) != bool(parts):
            raise Damaged(f"stream {p.serial} has a broken packet on page {p.number}")
        own.n_pages += 1
        own.ended = bool(p.flags & _LAST)
        at = 0
        first = len(own.data)
        for size in p.lacing:
            parts.append(p.body[at:at + size])
            at += size
            if size < 255:
                own.data.append(b"".join(parts))
                own.granules.append(None)
                parts.clear()
        if (len(own.data) > first) != (p.granule >= 0):
            raise Damaged(f"stream {p.serial} has granule position {p.granule} on page {p.number}")
        if len(own.data) > first:
            own.granules[-1] = p.granule
    for serial, own in out.items():
        if not own.ended or open_parts[serial]:
            raise Damaged(f"stream {serial} has no end")
    return out


def times(own: Packets) -> list[tuple[float, float]]:
    """Start and end in seconds of each packet of samples, from granule positions and the packets' own lengths."""
    ends, at = [], None
    for data, granule in zip(reversed(own.data[1:]), reversed(own.granules[1:])):
        at = granule if granule is not None else at
        ends.append((at - len(data), at))
        at -= len(data)
    return [(a / RATE, b / RATE) for a, b in reversed(ends)]


def features(samples: np.ndarray, spans: list[tuple[float, float]], n_pages: int) -> str:
    """Length, loudness, crossings of the middle, peak, and pages, of samples read back."""
    centred = samples.astype(np.int16) - 128
    loud = float(np.sqrt(np.mean(centred.astype(np.float64) ** 2)))
    crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
    return f"{spans[-1][1]:.6f}s rms={loud:.6f} crossings={crossings} peak={int(np.abs(centred).max())} packets={len(spans)} pages={n_pages}"


def read(media: bytes) -> tuple[bytes, int, str]:
    """Payload, unpadded length and features of stored media."""
    found = streams(media)
    if set(found) != {SOUND, NOTES}:
        raise Damaged("not the streams of a stored payload")
    sound, notes = found[SOUND], found[NOTES]
    if len(sound.data) < 2 or sound.data[0] != _SOUND_HEADER or not all(sound.data[1:]):
        raise Damaged("no samples behind a header of samples")
    if len(notes.data) != 2 or notes.data[0] != _NOTES_HEADER or len(notes.data[1]) != _NOTE.size:
        raise Damaged("no note behind a header of notes")
    payload = b"".join(sound.data[1:])
    n_bytes, size = _NOTE.unpack(notes.data[1])
    if size != len(payload) or n_bytes > size or size % FRAME_STEP:
        raise Damaged(f"a note of {n_bytes} bytes in {size} samples over {len(payload)} samples")
    ends = np.cumsum([0, *map(len, sound.data[1:])]).tolist()
    for own, at in ((sound, ends), (notes, [0, 0])):
        if any(granule not in (None, end) for granule, end in zip(own.granules, at)):
            raise Damaged("granule positions do not match the packets of their pages")
    spans = times(sound)
    return payload, n_bytes, features(np.frombuffer(payload, np.uint8), spans, sum(x.n_pages for x in found.values()))


MEDIA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("media", T.BinaryType())])
READ = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()), T.StructField("damage", T.StringType()),
])
_READ = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ("damage", pa.string()),
])


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in w.blocks(batches):
        out = []
        for text in w.texts(batch):
            size = max(FRAME_STEP, -(-len(text) // FRAME_STEP) * FRAME_STEP)
            out.append(stored(text.ljust(size, b"\0"), len(text)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "media"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in w.blocks(batches, "media"):
        rows = []
        for doc, media in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
            if media is None:
                rows.append((doc, *[None] * 7, "no media"))
                continue
            about = (len(media), hashlib.sha256(media).hexdigest())
            try:
                payload, n_bytes, feature = read(media)
            except Damaged as damage:
                rows.append((doc, None, None, None, None, *about, None, str(damage)))
                continue
            rows.append((
                doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME_STEP:]), *about, feature, None,
            ))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)


def encode(docs: DataFrame) -> DataFrame:
    """`(doc_id, media)`: each whole text of `docs(doc_id, text)` as an Ogg file. A null text is empty; empty texts
    are 64 zero samples. Other columns are not read; rows stay as they are, repeated or not; an empty table gives none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded, MEDIA)


def decode(media: DataFrame) -> DataFrame:
    """`READ` for each row of `media(doc_id, media)`: checksums verified, packets put together, streams parted, times
    derived. Media that are null or damaged have nulls and the reason in `damage`; they never end the job."""
    return media.select("doc_id", "media").mapInArrow(_decoded, READ)
