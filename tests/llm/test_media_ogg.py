import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.llm import media_ogg as ogg

from .conftest import TEXTS


@given(st.binary(max_size=200_000) | st.integers(0, 300_000).map(bytes))
def test_round_trip(payload):
    media = ogg.encode(payload)
    assert ogg.decode(media)[0] == payload


def slow_checksum(page):
    crc = 0
    for b in page:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    assert ogg.page_checksum(b"OggS some page") == slow_checksum(b"OggS some page")


def test_packets_run_over_pages():
    streams = ogg.demultiplex(ogg.encode(bytes(range(256)) * 2000))
    assert len(streams) == 2 and max(s.pages for s in streams.values()) > 3


@pytest.mark.parametrize("at", [0, 5, 30, 100, -1])
def test_damage_is_found(at):
    media = bytearray(ogg.encode(b"x" * 5000))
    media[at] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.decode(bytes(media))


def test_digest(docs, none):
    rows = ogg.ogg_digest(docs).collect()
    assert len(rows) == len(TEXTS)
    texts = dict(TEXTS)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + b" " * (-len(raw) % 192) or b" " * 192
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        media = ogg.encode(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert ogg.ogg_digest(none).count() == 0


def slow_crc(page):
    """CRC-32 by the polynomial 04c11db7, bit by bit."""
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_pages_by_a_reader_of_their_own():
    """Pages read by the format's description alone: capture pattern, checksum, page numbers, flags, lacing, granule positions."""
    payload = bytes(random.Random(1).randrange(256) for _ in range(ogg.UNIT * 40))
    data = ogg.encode(payload)
    at, streams = 0, {}
    while at < len(data):
        capture, version, flags, granule, serial, number, crc, segments = struct.unpack_from("<4sBBqIIIB", data, at)
        lacing = data[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        page = bytearray(data[at:end])
        page[22:26] = bytes(4)
        assert capture == b"OggS" and version == 0 and slow_crc(page) == crc
        s = streams.setdefault(serial, {"pages": 0, "packets": [b""], "granules": [], "last": False})
        assert number == s["pages"] and bool(flags & 2) == (number == 0) and not s["last"]
        s["pages"] += 1
        s["last"] = bool(flags & 4)
        body = at + 27 + segments
        ended = False
        for n in lacing:
            s["packets"][-1] += data[body : body + n]
            body += n
            if n < 255:
                s["packets"].append(b"")
                ended = True
        assert (granule == -1) == (not ended)
        if ended:
            s["granules"].append(granule)
        at = end
    assert len(streams) == ogg.LANES and all(s["last"] and s["granules"] == sorted(s["granules"]) for s in streams.values())
    samples = sum(len(p) for s in streams.values() for p in s["packets"][1:])
    assert samples == len(payload) and sum(s["granules"][-1] for s in streams.values()) >= len(payload) // ogg.LANES
    lanes = [b"".join(s["packets"][1:]) for s in streams.values()]
    assert sorted(b"".join(lanes)) == sorted(payload) and payload.startswith(lanes[0][: ogg.BLOCK])
