"""Media columns: Ogg streams of 8-bit samples, written and read back.

A payload is cut into packets; packets are dealt in turn to a few logical
streams, laced into segments of up to 255 bytes, and paged with a checksum.
Reading verifies each page's checksum and sequence number, joins packets from
the lacing values (across pages where a packet is continued), tells streams
apart by serial number, and takes times from granule positions.

Both directions run inside the tasks that hold the rows; nothing is shuffled,
and one media value at a time is in memory besides its Arrow batch.

Defined results: a null text is an empty payload, which is padded to one unit;
repeated rows give equal values; damaged media raise ValueError, naming the
page; an empty table gives an empty result. A text of any length is one file,
of as many pages as it takes, and is held whole by the task that reads it. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import in_batches

UNIT = 192
PAD = b"\x20"
RATE = 48_000
STREAMS = 2
#: Bytes in a packet; not a multiple of 255, so that packets end within segments and pages.
PACKET = 8 * UNIT
PAGE_SEGMENTS = 255

_HEADER = struct.Struct("<4sBBqIIIB")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of the polynomial 0x04C11DB7, most significant bit first, from 0 and without a final change.

    zlib's CRC is the same with bits reversed, and inverted before and after.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    short = -len(payload) % unit if payload else unit
    return payload + PAD * short


@dataclass
class _Writer:
    serial: int
    pages: list[bytes] = field(default_factory=list)
    lacing: list[int] = field(default_factory=list)
    body: list[bytes] = field(default_factory=list)
    granule: int = 0
    ended: int = -1  # granule position of the last packet that ends on the page
    continues: bool = False

    def packet(self, data: bytes, samples: int) -> None:
        self.granule += samples
        values = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        for i, n in enumerate(values):
            if len(self.lacing) == PAGE_SEGMENTS:
                self.flush(0)
                self.continues = i > 0
            self.lacing.append(n)
            self.body.append(data[at : at + n])
            at += n
        self.ended = self.granule

    def flush(self, last: int) -> None:
        flags = (_CONTINUED if self.continues else 0) | (_FIRST if not self.pages else 0) | last
        head = _HEADER.pack(b"OggS", 0, flags, self.ended, self.serial, len(self.pages), 0, len(self.lacing))
        page = head + bytes(self.lacing) + b"".join(self.body)
        self.pages.append(page[:22] + page_checksum(page).to_bytes(4, "little") + page[26:])
        self.lacing, self.body, self.ended, self.continues = [], [], -1, False


def encode(payload: bytes, streams: int = STREAMS, packet: int = PACKET, rate: int = RATE) -> bytes:
    """Padded payload to an Ogg file: per stream a header packet, then its packets; pages of the streams take turns."""
    writers = [_Writer(serial=s + 1) for s in range(streams)]
    for w in writers:
        w.packet(b"raw8" + struct.pack("<IIII", rate, streams, packet, len(payload)), 0)
        w.flush(0)
    for k, at in enumerate(range(0, len(payload), packet)):
        part = payload[at : at + packet]
        writers[k % streams].packet(part, len(part))
    for w in writers:
        w.flush(_LAST)
    out = []
    for turn in range(max(len(w.pages) for w in writers)):
        out += [w.pages[turn] for w in writers if turn < len(w.pages)]
    return b"".join(out)


@dataclass
class Stream:
    rate: int = 0
    pages: int = 0
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of each page on which a packet ends
    open: bytes | None = None
    ended: bool = False

    @property
    def seconds(self) -> float:
        return self.granules[-1] / self.rate if self.granules and self.rate else 0.0


def demultiplex(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, each page verified."""
    found: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < _HEADER.size:
            raise ValueError(f"page at byte {at}: cut short")
        magic, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(media, at)
        lacing = media[at + _HEADER.size : at + _HEADER.size + n]
        end = at + _HEADER.size + n + sum(lacing)
        page = media[at:end]
        if magic != b"OggS" or version or len(lacing) < n or end > len(media):
            raise ValueError(f"page at byte {at}: not a page")
        if page_checksum(page[:22] + bytes(4) + page[26:]) != crc:
            raise ValueError(f"page at byte {at}: checksum")
        stream = found.setdefault(serial, Stream())
        if number != stream.pages or bool(flags & _FIRST) != (number == 0) or stream.ended:
            raise ValueError(f"page at byte {at}: out of sequence")
        if bool(flags & _CONTINUED) != (stream.open is not None):
            raise ValueError(f"page at byte {at}: a packet is not continued")
        stream.pages += 1
        parts, stream.open = [stream.open] if stream.open is not None else [], None
        at += _HEADER.size + n
        for size in lacing:
            parts.append(media[at : at + size])
            at += size
            if size < 255:
                stream.packets.append(b"".join(parts))
                parts = []
        if parts:
            stream.open = b"".join(parts)
        if granule >= 0:
            stream.granules.append(granule)
        stream.ended = bool(flags & _LAST)
    return found


def decode(media: bytes) -> tuple[bytes, dict[int, Stream]]:
    """The payload, taking packets of the streams in turn, and the streams."""
    streams = demultiplex(media)
    for stream in streams.values():
        if not stream.packets or stream.packets[0][:4] != b"raw8" or stream.open is not None or not stream.ended:
            raise ValueError("a stream is incomplete")
        stream.rate = struct.unpack_from("<I", stream.packets[0], 4)[0]
    order = [streams[s].packets[1:] for s in sorted(streams)]
    parts = [own[turn] for turn in range(max((len(p) for p in order), default=0)) for own in order if turn < len(own)]
    payload = b"".join(parts)
    if streams and len(payload) != struct.unpack_from("<I", streams[min(streams)].packets[0], 16)[0]:
        raise ValueError("packets are missing")
    return payload, streams


def feature(payload: bytes, streams: dict[int, Stream]) -> str:
    """What the samples and granule positions say: durations, level and zero crossings."""
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.int32) - 128
    level = float(np.sqrt(np.mean(samples.astype(np.float64) ** 2))) if len(samples) else 0.0
    crossings = int(np.count_nonzero(np.diff(np.signbit(samples))))
    longest = max((s.seconds for s in streams.values()), default=0.0)
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};"
        f"rate={max((s.rate for s in streams.values()), default=0)};seconds={longest:.6f};rms={level:.4f};crossings={crossings}"
    )


def to_media(docs: DataFrame, streams: int = STREAMS, packet: int = PACKET) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text of (doc_id, text) as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                sizes, media = [], []
                for value in part.column(1):
                    raw = value.as_py() or b""
                    sizes.append(len(raw))
                    media.append(encode(pad(raw), streams, packet))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, type=pa.int64()), pa.array(media, type=pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return in_batches(rows).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes, so that what is made of them stays small."""
    step = max(1, int(batch.num_rows * most / max(batch.column(column).nbytes, most)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def from_media(files: DataFrame) -> DataFrame:
    """Read the media column back: payload figures, media figures and the feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds"]
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, seconds double"
    )
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(2):
                media = value.as_py()
                payload, streams = decode(media)
                out.append(
                    (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-16:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        feature(payload, streams),
                        max((s.seconds for s in streams.values()), default=0.0),
                    )
                )
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            made = [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    return in_batches(files.select("doc_id", "n_bytes", "media")).mapInArrow(run, schema)
