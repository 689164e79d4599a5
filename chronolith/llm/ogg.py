"""Ogg media columns: pages with checksums, lacing, interleaved logical streams, time from granule positions."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import bounded_batches

# Fixed values of the container: capture pattern, page header layout, header type bits.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
SEGMENTS, LACING = 255, 255
# Own choices of the sample streams that are written here.
RATE, STREAMS, PACKET = 8000, 2, 32768
MAGIC = struct.Struct("<8sIBBI")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The container's CRC-32: most significant bit first, polynomial 0x04C11DB7, no start or end value.

    It is the mirror image of the usual CRC-32 over mirrored bytes, so zlib does the work.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = HEADER.pack(CAPTURE, 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def write_stream(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream from (packet, granule position at its end); the first packet has a page of its own."""
    pages: list[bytes] = []
    lacing, body, granule, continued = bytearray(), [], -1, False

    def close(last: bool = False) -> None:
        nonlocal lacing, body, granule
        kind = CONTINUED * continued | FIRST * (not pages) | LAST * last
        pages.append(_page(kind, granule, serial, len(pages), bytes(lacing), b"".join(body)))
        lacing, body, granule = bytearray(), [], -1

    for k, (packet, end) in enumerate(packets):
        values = bytes([LACING]) * (len(packet) // LACING) + bytes([len(packet) % LACING])
        at = 0
        while True:
            room = SEGMENTS - len(lacing)
            part = values[:room]
            lacing += part
            body.append(packet[at : at + sum(part)] if len(part) < len(values) else packet[at:])
            at += len(part) * LACING
            values = values[room:]
            if not values:
                granule = end
                break
            close()
            continued = True
        if k == 0 or len(lacing) == SEGMENTS:
            close(k == len(packets) - 1)
            continued = False
    if lacing:
        close(True)
    return pages


@dataclass
class Stream:
    """One logical stream as read: whole packets with the granule position of the page that ends them (-1: not told), and pages lost before."""

    serial: int
    packets: list[tuple[bytes, int]] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _part: list[bytes] | None = field(default_factory=list)


def read(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of their first pages.

    A page whose checksum is wrong is left out, and reading goes on at the next
    capture pattern; a packet that lost a page is left out, and ``lost`` counts
    the pages that are missing in the numbering.  A repeated page is read once.
    """
    streams: dict[int, Stream] = {}
    at = media.find(CAPTURE)
    while at >= 0 and at + HEADER.size <= len(media):
        _, version, kind, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        lacing = media[at + HEADER.size : at + HEADER.size + n]
        start = at + HEADER.size + n
        end = start + sum(lacing)
        whole = version == 0 and len(lacing) == n and end <= len(media)
        if not whole or checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            at = media.find(CAPTURE, at + 1)
            continue
        s = streams.setdefault(serial, Stream(serial))
        if number < s.pages + s.lost:  # a page that was read before
            at = media.find(CAPTURE, end)
            continue
        if number > s.pages + s.lost:
            s.lost = number - s.pages
            s._part = None
        s.pages += 1
        if not kind & CONTINUED:
            s._part = []  # a packet that was not ended is lost
        elif not s._part:
            s._part = None
        last = max((i for i, v in enumerate(lacing) if v < LACING), default=-1)
        run = 0
        for i, v in enumerate(lacing):
            run += v
            if v < LACING:
                if s._part is not None:
                    s.packets.append((b"".join([*s._part, media[start : start + run]]), granule if i == last else -1))
                s._part = []
                start, run = start + run, 0
        if run and s._part is not None:
            s._part.append(media[start : start + run])
        s.ended = s.ended or bool(kind & LAST)
        at = media.find(CAPTURE, end)
    return streams


def seconds(granule: int, rate: int) -> float:
    """Time at a granule position that counts samples."""
    return granule / rate


def store(payload: bytes) -> bytes:
    """Unsigned 8-bit samples, dealt in packets to the logical streams by turns and interleaved page by page."""
    cut = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    pages = []
    for k in range(STREAMS):
        packets, total = [(MAGIC.pack(b"rawpcm8u", RATE, k, STREAMS, len(payload)), 0)], 0
        for p in cut[k::STREAMS]:
            total += len(p)
            packets.append((p, total))
        pages.append(write_stream(packets, k + 1))
    order = sorted((i, k) for k in range(STREAMS) for i in range(len(pages[k])))
    return b"".join(pages[k][i] for i, k in order)


def load(media: bytes) -> tuple[bytes, float, int]:
    """(payload, seconds told by the granule positions of all streams together, pages); raises ValueError on damage."""
    parts, time, pages = {}, 0.0, 0
    streams = read(media)
    for s in streams.values():
        if s.lost or not s.ended or not s.packets:
            raise ValueError(f"stream {s.serial} is damaged")
        name, rate, k, n, size = MAGIC.unpack(s.packets[0][0])
        if name != b"rawpcm8u" or n != len(streams):
            raise ValueError("not the streams that were stored")
        for i, (packet, _) in enumerate(s.packets[1:]):
            parts[i * n + k] = packet
        time += seconds(max(g for _, g in s.packets), rate)
        pages += s.pages
    payload = b"".join(parts[i] for i in sorted(parts))
    if not streams or len(payload) != size:
        raise ValueError("samples are missing")
    return payload, time, pages


def features(payload: bytes, time: float, pages: int) -> str:
    """Duration, pages, mean, power, zero crossings about the middle of the range, and the loudness of eight stretches: exact integers, so equal samples agree."""
    x = np.frombuffer(payload, dtype=np.uint8)
    n = len(x)
    cuts = [*(k * n // 8 for k in range(8)), n]
    of_value = [np.bincount(x[a:b], minlength=256) for a, b in zip(cuts, cuts[1:], strict=False)]  # how often each sample value occurs
    value = np.arange(256) - 128
    power = [int(c @ (value * value)) for c in of_value]
    loud = x >= 128
    crossings = int(np.count_nonzero(loud[1:] != loud[:-1]))
    stretches = ",".join(str(p // (b - a)) for p, a, b in zip(power, cuts, cuts[1:], strict=False))
    return f"seconds={time:.6f};pages={pages};mean={int(sum(of_value) @ value) * 1000 // n};power={sum(power) // n};crossings={crossings};stretches={stretches}"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (text.as_py() or "").encode()
            media = store(data + bytes(-len(data) % 64 if data else 64))
            payload, time, pages = load(media)
            rows.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, time, pages)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_columns(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` stored as Ogg sample streams and read back, a row for each row.

    The payload is the text in UTF-8 with zero bytes up to a positive multiple of
    64; null counts as empty.  Every row is a round trip: checksums are verified,
    packets reassembled and streams put together before anything is computed.
    Equal texts give equal values.  A long text takes memory in proportion to its bytes, an
    empty table gives no rows, and other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _batches,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
