"""Ogg media columns: write a payload as a multiplexed Ogg file, and read such files back.

A payload is treated as unsigned 8-bit mono PCM at SAMPLE_RATE and dealt, in blocks of BLOCK samples, over LANES
logical streams of one physical Ogg stream. The reader verifies the checksum of every page, checks page numbers,
reassembles packets from the lacing values (also packets that run over several pages), demultiplexes the logical
streams by serial number, derives each packet's time from the granule positions, and puts packets back in order of
time.

Defined results: a null payload is an empty one, and an empty or blank text its padding; an empty file has no streams; equal
payloads give equal files, and repeated rows count each; very long texts are single files, written and read a few
megabytes of files at a time; an empty table gives no rows. A damaged file raises OggError with the place of the damage.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

SAMPLE_RATE = 8000
UNIT = 192  # payloads are padded to a multiple of this many bytes
BLOCK = 4 * UNIT  # samples in a packet
LANES = 2
#: Fixed values of the Ogg format: capture pattern, header flags, the granule position of a page on which no packet ends.
CAPTURE, CONTINUED, FIRST, LAST, NO_GRANULE = b"OggS", 1, 2, 4, -1
HEADER = struct.Struct("<4sBBqIIIB")
ID_HEADER = struct.Struct("<8sIHHI")  # magic, sample rate, lane, lanes, block
MAGIC = b"QUERNPCM"

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, most significant bit first, start and final value 0: zlib's CRC is the same one with bits mirrored."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    page = head + body
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream. packets: (bytes, granule position at its end); the first, an identification header, has a page of its own."""
    pages: list[bytes] = []
    lacing, body, granule, carried = bytearray(), bytearray(), NO_GRANULE, False

    def flush(last: bool, ends_inside: bool) -> None:
        nonlocal lacing, body, granule, carried
        flags = CONTINUED * carried | FIRST * (not pages) | LAST * last
        pages.append(_page(flags, granule, serial, len(pages), bytes(lacing), bytes(body)))
        lacing, body, granule, carried = bytearray(), bytearray(), NO_GRANULE, ends_inside

    for k, (packet, end) in enumerate(packets):
        at = 0
        while True:
            if len(lacing) == 255:
                flush(False, at > 0)
            part = packet[at : at + 255]
            lacing.append(len(part))
            body += part
            at += 255
            if len(part) < 255:
                break
        granule = end
        if k == 0 and len(packets) > 1:
            flush(False, False)
    flush(True, False)
    return pages


def encode(payload: bytes) -> bytes:
    """The payload as one Ogg file of LANES multiplexed logical streams."""
    lanes: list[list[tuple[bytes, int]]] = [[(ID_HEADER.pack(MAGIC, SAMPLE_RATE, n, LANES, BLOCK), 0)] for n in range(LANES)]
    for k, at in enumerate(range(0, len(payload), BLOCK)):
        part = payload[at : at + BLOCK]
        lanes[k % LANES].append((part, at + len(part)))
    streams = [_pages(n + 1, packets) for n, packets in enumerate(lanes)]
    out = [pages[0] for pages in streams]  # all first pages come before any other
    for k in range(1, max(map(len, streams))):
        out += [pages[k] for pages in streams if k < len(pages)]
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: its packets, and for each the granule position known at its end (or NO_GRANULE)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _open: list[bytes] = field(default_factory=list)


def demultiplex(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, with every page's checksum verified and packets reassembled."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise OggError(f"cut page header at byte {at}")
        capture, version, flags, granule, serial, number, checksum, n = HEADER.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + HEADER.size : at + HEADER.size + n]
        start = at + HEADER.size + n
        end = start + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise OggError(f"cut page at byte {at}")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != checksum:
            raise OggError(f"checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or s.pages != number:
            raise OggError(f"page {number} of stream {serial} is out of place")
        if bool(flags & CONTINUED) != bool(s._open):
            raise OggError(f"a packet of stream {serial} is broken off")
        s.pages += 1
        done = len(s.packets)
        for size in lacing:
            s._open.append(media[start : start + size])
            start += size
            if size < 255:
                s.packets.append(b"".join(s._open))
                s.granules.append(NO_GRANULE)
                s._open = []
        if len(s.packets) > done:
            if granule == NO_GRANULE:
                raise OggError(f"page {number} of stream {serial} has no granule position")
            s.granules[-1] = granule
        s.ended = bool(flags & LAST)
        at = end
    for s in streams.values():
        if s._open or not s.ended:
            raise OggError(f"stream {s.serial} doesn't end")
    return streams


def decode(media: bytes) -> tuple[bytes, dict]:
    """The payload, and what the streams tell: a page gives the granule position of its last packet only, so times of the packets before it are counted back from there."""
    timed: list[tuple[int, int, bytes]] = []
    streams = demultiplex(media)
    rate = 0
    for s in streams.values():
        if not s.packets or len(s.packets[0]) != ID_HEADER.size:
            raise OggError(f"stream {s.serial} has no identification header")
        magic, rate, _, lanes, block = ID_HEADER.unpack(s.packets[0])
        if magic != MAGIC:
            raise OggError(f"stream {s.serial} holds another codec")
        end = None
        stride = lanes * block  # blocks between those of this stream belong to the others
        for packet, granule in zip(reversed(s.packets[1:]), reversed(s.granules[1:])):
            if granule != NO_GRANULE:
                end = granule
            timed.append((end - len(packet), s.serial, packet))
            end = end - len(packet) + block - stride
    timed.sort(key=lambda x: x[:2])
    payload = b"".join(x[2] for x in timed)
    at = 0
    for start, serial, packet in timed:
        if start != at:
            raise OggError(f"stream {serial} has a gap at sample {at}")
        at += len(packet)
    return payload, {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": len(timed), "millis": at * 1000 // rate if rate else 0}


def pad(data: bytes) -> bytes:
    """data and bytes 32 up to a positive multiple of UNIT."""
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def signal_feature(payload: bytes, facts: dict) -> str:
    """Level, loudness and zero crossings of the samples, and the streams' structure."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(samples >= 0))) if len(samples) else 0
    total, power = int(samples.sum()), int((samples * samples).sum())
    return "|".join(f"{k}={v}" for k, v in (facts | {"sum": total, "power": power, "crossings": crossings}).items())


def with_media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text's padded bytes as an Ogg file."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_bytes(whole, 1)):
            raw = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.record_batch({"k": b.column(0), "n_bytes": pa.array(map(len, raw), pa.int64()), "media": pa.array([encode(pad(x)) for x in raw], pa.binary())})

    small = df.select(F.col(key).alias("k"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("raw"))
    return small.mapInArrow(run, f"k {kind}, n_bytes bigint, media binary").withColumnRenamed("k", key)


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df with payload_bytes, payload_sha256, tail_crc32 (last 16 bytes) and feature, all from the bytes that its media column holds."""
    import hashlib

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(media)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_bytes(whole, at)):
            sizes, hashes, tails, features = [], [], [], []
            for stored in b.column(at).to_pylist():
                payload, facts = decode(stored or b"")
                sizes.append(len(payload))
                hashes.append(hashlib.sha256(payload).hexdigest())
                tails.append(zlib.crc32(payload[-16:]))
                features.append(signal_feature(payload, facts))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(tails, pa.int64()), pa.array(features, pa.string())],
                names=[*b.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "feature"],
            )

    return df.mapInArrow(run, f"{fields}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string")


def ogg_digest(documents: DataFrame) -> DataFrame:
    """One row per document: its text as an Ogg file, and what reading that file back gives."""
    read = read_media(with_media(documents))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")
