"""Media columns in the Ogg container.

A page is a 27-byte header (capture pattern, flags, granule position, stream
serial, page sequence number, checksum), a segment table of lacing values and
their bytes. A packet is laced as values of 255 and a last one below; it may go
on over pages. The reader verifies every page's checksum and sequence, splits
the logical streams by serial, and joins the packets of each; a page's granule
position belongs to the last packet that ends in it and gives its time.

The payload's stream has a head packet (rate, channels, sample width) and data
packets of 8-bit samples; its granule positions count samples. A second
logical stream, interleaved with it, has a packet for each of its pages with
that page's sample range and peak values.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

RATE = 8000
PACKET = 4096
PACKETS_A_PAGE = 8
ALIGN = 64
_HEAD = b"\x7fTWPCM8\x00"
_INDEX = b"\x7fTWINDX\x00"
#: Each byte with its bits reversed.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


def checksum(page: bytes) -> int:
    """The container's CRC: polynomial 0x04c11db7, unreflected, from 0. By the reflected CRC of the bit-reversed bytes."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing))
    crc = checksum(head + lacing + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + lacing + body


def paginate(serial: int, packets: list[tuple[bytes, int]], a_page: int) -> list[tuple[int, bytes]]:
    """Pages of one logical stream, each with the granule position reached, from (packet, granule position at its end). The first packet has a page of its own, the others go `a_page` to a page; a page holds at most 255 lacing values, so a long packet goes on in the next."""
    out: list[tuple[int, bytes]] = []
    lacing, body, ended, granule, continued = bytearray(), bytearray(), 0, -1, False
    sequence = 0

    def flush(last: bool, goes_on: bool) -> None:
        nonlocal lacing, body, ended, granule, continued, sequence
        flags = CONTINUED * continued | FIRST * (sequence == 0) | LAST * last
        out.append((granule, page(serial, sequence, granule, flags, bytes(lacing), bytes(body))))
        lacing, body, ended, granule, continued, sequence = bytearray(), bytearray(), 0, -1, goes_on, sequence + 1

    for i, (data, at) in enumerate(packets):
        values = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
        p = 0
        while True:
            room = 255 - len(lacing)
            part, values = values[:room], values[room:]
            size = sum(part)
            lacing += part
            body += data[p : p + size]
            p += size
            if not values:
                break
            flush(False, True)
        ended, granule = ended + 1, at
        last = i == len(packets) - 1
        if last or i == 0 or ended == a_page or len(lacing) == 255:
            flush(last, False)
    return out


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at each packet's end; -1 where its page doesn't tell.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


class OggError(ValueError):
    pass


def demultiplex(data: bytes) -> dict[int, Stream]:
    """All logical streams; raises OggError for a bad checksum, a missing page or a broken packet."""
    streams: dict[int, Stream] = {}
    rest: dict[int, bytearray | None] = {}
    p = 0
    while p < len(data):
        if len(data) - p < 27:
            raise OggError("a page header is cut off")
        magic, version, flags, granule, serial, sequence, crc, n = _PAGE.unpack_from(data, p)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {p}")
        lacing = data[p + 27 : p + 27 + n]
        end = p + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("a page is cut off")
        if checksum(data[p : p + 22] + b"\0\0\0\0" + data[p + 26 : end]) != crc:
            raise OggError(f"page {sequence} of stream {serial} has a wrong checksum")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial], rest[serial] = Stream(serial), None
        s = streams.get(serial)
        if s is None:
            raise OggError(f"stream {serial} doesn't begin")
        if sequence != s.pages or s.ended:
            raise OggError(f"stream {serial}: page {sequence} where {s.pages} is due")
        if bool(flags & CONTINUED) != (rest[serial] is not None):
            raise OggError(f"stream {serial}: page {sequence} doesn't continue its packet")
        s.pages += 1
        s.ended = bool(flags & LAST)
        q, open_, done = p + 27 + n, rest[serial] or bytearray(), 0
        started = rest[serial] is not None
        for v in lacing:
            open_ += data[q : q + v]
            q += v
            started = True
            if v < 255:
                s.packets.append(bytes(open_))
                s.granules.append(-1)
                open_, started, done = bytearray(), False, done + 1
        if done:
            s.granules[-1] = granule
        rest[serial] = open_ if started else None
        p = end
    for serial, open_ in rest.items():
        if open_ is not None:
            raise OggError(f"stream {serial}: its last packet is cut off")
    return streams


def padded(text: str | None) -> tuple[int, bytes]:
    raw = b"" if text is None else text.encode("utf-8", "replace")
    return len(raw), raw + bytes(-len(raw) % ALIGN or (0 if raw else ALIGN))


def encode(payload: bytes) -> bytes:
    """Equal payloads give equal files: the serials derive from the payload."""
    serial = zlib.crc32(payload)
    x = np.frombuffer(payload, np.uint8)
    cuts = range(0, len(payload), PACKET)
    data = [(_HEAD + struct.pack("<IHH", RATE, 1, 8), 0), *((payload[a : a + PACKET], min(a + PACKET, len(payload))) for a in cuts)]
    span = PACKET * PACKETS_A_PAGE
    index = [(_INDEX + struct.pack("<II", serial, span), 0)]
    for a in range(0, len(payload), span):
        y = x[a : a + span]
        index.append((struct.pack("<QQBB", a, a + len(y), int(y.min()), int(y.max())), a + len(y)))
    first, second = paginate(serial, data, PACKETS_A_PAGE), paginate(serial ^ 0xFFFFFFFF, index, 1)
    out = [first[0][1], second[0][1]]
    for a, b in itertools.zip_longest(first[1:], second[1:]):
        out += [x[1] for x in (a, b) if x]
    return b"".join(out)


def decode(data: bytes) -> tuple[bytes, dict]:
    """The payload and what the container says of it; OggError if the two streams don't agree."""
    streams = demultiplex(data)
    main = [s for s in streams.values() if s.packets and s.packets[0].startswith(_HEAD)]
    side = [s for s in streams.values() if s.packets and s.packets[0].startswith(_INDEX)]
    if len(main) != 1 or len(side) != 1:
        raise OggError("the streams of samples and of their index aren't both there")
    rate, channels, bits = struct.unpack("<IHH", main[0].packets[0][len(_HEAD) :])
    payload = b"".join(main[0].packets[1:])
    if main[0].granules[-1] != len(payload):
        raise OggError("granule positions and samples differ")
    times = [g / rate for g in main[0].granules[1:] if g >= 0]
    at = 0
    for packet in side[0].packets[1:]:
        a, b, low, high = struct.unpack("<QQBB", packet)
        x = payload[a:b]
        if a != at or (min(x), max(x)) != (low, high):
            raise OggError("index and samples differ")
        at = b
    if at != len(payload):
        raise OggError("index and samples differ")
    return payload, {"rate": rate, "channels": channels, "bits": bits, "streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": sum(len(s.packets) for s in streams.values()), "times": times}


def to_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, media): the text's UTF-8 bytes, with zero bytes up to a positive multiple of ALIGN, as samples in a container. Null text is empty; a row per row; other columns are ignored."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([encode(p) for _, p in found], pa.binary())], names=["doc_id", "n_bytes", "media"])

    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


_READ = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> doc_id, what is read back from the container, and features of the samples. A container that can't be read gives nulls and its error."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    payload, about = decode(data or b"")
                except OggError as e:
                    rows.append((n, None, None, None, len(data or b""), hashlib.sha256(data or b"").hexdigest(), None, str(e)))
                    continue
                x = np.frombuffer(payload, np.uint8).astype(np.float64)
                crossings = int(np.count_nonzero(np.diff(x >= 128)))
                feature = f"seconds={about['times'][-1]:.6f};pages={about['pages']};packets={about['packets']};streams={about['streams']};mean={x.mean():.4f};rms={np.sqrt(((x - 128) ** 2).mean()):.4f};crossings={crossings}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), feature, None))
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *(c.split()[0] for c in _READ.split(", "))])

    frame = media.select("doc_id", "n_bytes", "media")
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, {_READ}")
