"""Substring dedup with fixed-block anchors.

A window is WINDOW consecutive words of one document; a word goes if a window over it also starts earlier. Any window of
WINDOW words holds a whole reference block of BLOCK words aligned to a multiple of BLOCK in its document, since
WINDOW >= 2 BLOCK - 1. So:

1. Index and probe: aligned blocks are the index, and every rolling window of BLOCK words probes it. Both go to buckets
   by hash; a probe hits if its block is aligned somewhere and occurs at least twice.
2. Extend: only where a hit lies, to all windows of WINDOW words over it, on both sides. These are compared by 96-bit
   hashes of whole windows, not word by word, in a second exchange: a word goes where any window over it has an earlier
   equal, so it takes the earliest of all places, not the one that a hit came from. All but the earliest of equal windows
   are repeats, and runs of them are the maximal exact repeats.
3. Words under repeats are removed.

What is moved is packed: a chunk of documents (up to CHUNK_WORDS words) sends each bucket one block of bytes, with each
hash once, whatever its number of occurrences in the chunk; repeats inside a chunk are settled there. So a passage
that a third of all documents share reaches a bucket once per chunk, and no pairs are made. Texts are moved once.

Defined results: null, empty and blank texts have no words; rows that repeat a doc_id with the same text count as one
document, whose places are equal rather than earlier; a null doc_id counts as the smallest, and doc_ids that aren't whole
numbers are in the order of their hashes; very long texts are chunks of their own; an empty table gives no rows; extra
columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, free_names, number_of

WINDOW = 20
BLOCK = 10
CHUNK_WORDS = 1 << 20
BUCKET_BYTES = 1 << 21
_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
LEAST = -(1 << 63)

#: What chunks send, and what buckets send back: rows for a bucket, or for a chunk (bucket >= buckets, passed on as they are).
_SENT = "bucket int, chunk bigint, kind string, data binary"
_BACK = "chunk bigint, kind string, data binary"
_HITS = "doc_id bigint, text_hash bigint, steps array<int>"


def _pow(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def rolling(h: np.ndarray, width: int, base: np.uint64 = _M) -> np.ndarray:
    """Hash of each run of `width` elements, by doubling; runs that don't fit are cut off."""
    out, done = None, 0
    part, size = h, 1
    left = width
    while left:
        if left & 1:
            out = part if out is None else out[: len(part) - done] + _pow(base, done) * part[done:] if len(part) > done else part[:0]
            done += size
        left >>= 1
        if left:
            part = part[: max(0, len(part) - size)] + _pow(base, size) * part[size:]
            size *= 2
    return out[: max(0, len(h) - width + 1)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class Chunk:
    """Documents read one after the other: their word hashes end to end, and where each begins."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.text_hashes: list[int] = []
        self.parts: list[np.ndarray] = []
        self.places: list[np.ndarray | None] = []
        self.n = 0

    def add(self, doc_id: int | None, text_hash: int, h: np.ndarray, places: np.ndarray | None = None) -> None:
        self.ids.append(LEAST if doc_id is None else doc_id)
        self.text_hashes.append(text_hash)
        self.parts.append(h)
        self.places.append(places)
        self.n += len(h)

    def close(self, width: int) -> None:
        """start: where each document begins; at: all places where a run of `width` words of one document begins; doc: its document."""
        size = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        self.start = np.r_[0, size.cumsum()]
        self.words = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        fits = np.maximum(size - width + 1, 0)
        self.doc = np.repeat(np.arange(len(size)), fits)
        self.at = np.arange(int(fits.sum())) - np.repeat(np.r_[0, fits.cumsum()[:-1]], fits) + self.start[self.doc]

    def table(self) -> bytes:
        return np.array([self.ids, self.text_hashes, self.start[:-1]], np.int64).tobytes()


def _read_table(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(data, np.int64).reshape(3, -1)
    return a[0], a[1], a[2]


def _pack(*columns: np.ndarray) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _steps(at: np.ndarray) -> np.ndarray:
    """Ascending places (bounded by a chunk) as 16-bit steps, in 32 bits where a step is too long for that: tells by its size."""
    step = np.diff(at, prepend=0)
    return step.astype(np.uint16 if not len(step) or step.max() < 1 << 16 else np.uint32)


def _places(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32).astype(np.int64).cumsum()


def _runs(at: np.ndarray) -> bytes:
    """Ascending places as steps behind a byte that tells their width; the steps of a run are alike, and shuffles compress them."""
    step = _steps(at)
    return bytes([step.itemsize]) + step.tobytes()


def _unrun(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if data[0] == 2 else np.uint32, -1, 1).astype(np.int64).cumsum()


def _all_places(lists: list | None) -> np.ndarray:
    """Places from lists of steps, of which there are several only where rows repeat."""
    return np.unique(np.concatenate([np.cumsum(np.asarray(x, np.int64)) for x in lists])) if lists is not None and len(lists) else np.zeros(0, np.int64)


def _sorted_runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key, and for each element in that order whether it begins a run of equal keys."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)


def _chunks(batches: Iterable[pa.RecordBatch], width: int, read: Callable[[pa.RecordBatch], Iterator[tuple]], send: Callable[[Chunk, int], Iterator[tuple]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows that send() makes of each chunk, with the chunk's table of documents."""
    number = TaskContext.get().partitionId() << 24
    chunk = Chunk()

    def flush() -> pa.RecordBatch:
        nonlocal number, chunk
        chunk.close(width)
        rows = list(send(chunk, number))
        rows.append((buckets + number % buckets, "table", chunk.table()))
        out = pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "chunk", "kind", "data"])
        number += 1
        chunk = Chunk()
        return out

    for b in batches:
        for doc in read(b):
            chunk.add(*doc)
            if chunk.n >= CHUNK_WORDS:
                yield flush()
    if chunk.ids:
        yield flush()


def _to_buckets(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket (stable, so places stay ascending), and where each bucket begins in it."""
    bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _send_probes(buckets: int, block: int) -> Callable[[Chunk, int], Iterator[tuple]]:
    def send(c: Chunk, number: int) -> Iterator[tuple]:
        key = mixed(rolling(c.words, block)[c.at]) if len(c.at) else np.zeros(0, np.uint64)
        aligned = (c.at - c.start[c.doc]) % block == 0
        order, begins = _sorted_runs(key)
        run = begins.cumsum() - 1
        first = order[begins]
        many = np.bincount(run, minlength=len(first)) > 1
        indexed = np.zeros(len(first), bool)
        indexed[run[aligned[order]]] = True
        local = np.sort(order[many[run]])
        if len(local):
            yield buckets + number % buckets, "hits", _runs(c.at[local])
        back = np.argsort(first, kind="stable")
        key, at, indexed = key[first[back]], c.at[first[back]], indexed[back]
        order, bounds = _to_buckets(key, buckets)
        low = key.astype(np.uint32)
        for b in np.flatnonzero(np.diff(bounds)):
            some = order[bounds[b] : bounds[b + 1]]
            yield int(b), "probes", _pack(low[some]) + np.packbits(indexed[some]).tobytes() + _steps(at[some]).tobytes()

    return send


def _probe_hits(table: pa.Table) -> Iterator[tuple]:
    """(chunk, places) of the probes of a bucket that hit."""
    chunks, datas = table.column("chunk").to_pylist(), table.column("data").to_pylist()
    lows, flags, places, owner = [], [], [], []
    for i, d in enumerate(datas):
        (low,) = _unpack(d, np.uint32)
        n = len(low)
        bits = -(-n // 8)
        lows.append(low)
        flags.append(np.unpackbits(np.frombuffer(d, np.uint8, bits, 8 + 4 * n), count=n))
        places.append(_places(d[8 + 4 * n + bits :], n))
        owner.append(np.full(n, i, np.int32))
    low, flag, place, own = (np.concatenate(x) for x in (lows, flags, places, owner))
    order, begins = _sorted_runs(low)
    run = begins.cumsum() - 1
    hit = (np.bincount(run) > 1) & (np.bincount(run, weights=flag[order]) > 0)
    found = np.sort(order[hit[run]])
    for i in np.unique(own[found]):
        yield chunks[i], _runs(place[found[own[found] == i]])


def _send_windows(buckets: int, window: int, block: int) -> Callable[[Chunk, int], Iterator[tuple]]:
    def send(c: Chunk, number: int) -> Iterator[tuple]:
        over = np.zeros(len(c.words) + 1, np.int64)  # windows that hold a hit
        for start, part, places in zip(c.start, c.parts, c.places):
            if places is not None and len(places):
                np.add.at(over, start + np.maximum(places - (window - block), 0), 1)
                np.add.at(over, start + np.minimum(places + 1, len(part)), -1)
        wanted = over.cumsum()[c.at] > 0
        at, doc = c.at[wanted], c.doc[wanted]
        a = mixed(rolling(c.words, window)[at]) if len(at) else np.zeros(0, np.uint64)
        b = mixed(rolling(mixed(c.words), window, _MIX)[at]).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        ids = np.array(c.ids, np.int64)[doc]
        inside = at - c.start[doc]
        order = np.lexsort((inside, ids, b, a))
        begins = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(at) else np.zeros(0, bool)
        first = order[begins]
        run = begins.cumsum() - 1
        later = (ids[order] != ids[first][run]) | (inside[order] != inside[first][run])
        repeats = np.sort(order[later])
        if len(repeats):
            yield buckets + number % buckets, "hits", _runs(at[repeats])
        first = np.sort(first)
        a, b, ids, at = a[first], b[first], ids[first], at[first]
        order, bounds = _to_buckets(a, buckets)
        for k in np.flatnonzero(np.diff(bounds)):
            some = order[bounds[k] : bounds[k + 1]]
            # ids byte by byte: their upper bytes are alike, and shuffles compress them away
            yield int(k), "windows", _pack(a[some], b[some]) + ids[some].view(np.uint8).reshape(-1, 8).T.tobytes() + _steps(at[some]).tobytes()

    return send


def _later_windows(table: pa.Table) -> Iterator[tuple]:
    """(chunk, places) of the windows of a bucket that an equal one in an earlier document precedes."""
    chunks, datas = table.column("chunk").to_pylist(), table.column("data").to_pylist()
    columns: list[list[np.ndarray]] = [[] for _ in range(5)]
    for i, d in enumerate(datas):
        a, b = _unpack(d, np.uint64, np.uint32)
        n = len(a)
        ids = np.ascontiguousarray(np.frombuffer(d, np.uint8, 8 * n, 8 + 12 * n).reshape(8, n).T).view(np.int64)[:, 0]
        for c, x in zip(columns, (a, b, ids, _places(d[8 + 20 * n :], n), np.full(n, i, np.int32))):
            c.append(x)
    a, b, ids, at, own = map(np.concatenate, columns)
    order = np.lexsort((ids, b, a))
    begins = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    run = begins.cumsum() - 1
    later = np.sort(order[ids[order] != ids[order[begins]][run]])
    for i in np.unique(own[later]):
        yield chunks[i], _runs(at[later[own[later] == i]])


def _settled(sent: DataFrame, settle: Callable[[pa.Table], Iterator[tuple]]) -> DataFrame:
    """(_repeat_key, _repeat_hash, _repeat_places: lists of steps) that buckets, or chunks by themselves, found."""

    def bucket(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() in ("table", "hits"):
            return t.select(["chunk", "kind", "data"])
        rows = list(settle(t))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array(["hits"] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "kind", "data"])

    def chunk(t: pa.Table) -> pa.Table:
        hits: list[np.ndarray] = []
        table = b""
        for kind, data in zip(t.column("kind").to_pylist(), t.column("data").to_pylist()):
            if kind == "table":
                table = data
            else:
                hits.append(_unrun(data))
        ids, text_hashes, start = _read_table(table)
        place = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        doc = np.searchsorted(start, place, side="right") - 1  # of documents that begin at one place, all but the last are empty
        owner, first = np.unique(doc, return_index=True)
        inside = place - start[doc]
        steps = np.diff(inside, prepend=0)
        steps[first] = inside[first]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(place)], pa.int32()), pa.array(steps.astype(np.int32)))
        return pa.table([pa.array(ids[owner]), pa.array(text_hashes[owner]), lists], names=["doc_id", "text_hash", "steps"])

    found = sent.groupBy("bucket").applyInArrow(bucket, _BACK).groupBy("chunk").applyInArrow(chunk, _HITS)
    rows = found.select(F.col("doc_id").alias("_repeat_key"), F.col("text_hash").alias("_repeat_hash"), "steps")
    return rows.groupBy("_repeat_key", "_repeat_hash").agg(F.collect_list("steps").alias("_repeat_places"))


def _keyed(documents: DataFrame) -> DataFrame:
    """documents with a key that is never null, and a hash that tells texts of one doc_id apart."""
    return documents.withColumn("_repeat_key", number_of("doc_id", documents)).withColumn("_repeat_hash", F.xxhash64("text"))


def repeats(keyed: DataFrame, buckets: int | None = None, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(_repeat_key, _repeat_hash, _repeat_places): where the windows begin that aren't the first of their kind, for rows (_repeat_key, _repeat_hash, text)."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block")
    if buckets is None:  # of about BUCKET_BYTES of text, so that what a group holds doesn't grow with the input
        size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(256, size // BUCKET_BYTES)

    def probes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        read = lambda b: ((k, h, hashes.array((t or "").encode().split())) for k, h, t in zip(*(c.to_pylist() for c in b.columns)))
        yield from _chunks(batches, block, read, _send_probes(buckets, block), buckets)

    needed = ["_repeat_key", "_repeat_hash", "text", "_repeat_places"]

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        read = lambda b: ((k, h, hashes.array((t or "").encode().split()), _all_places(p)) for k, h, t, p in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in needed)))
        yield from _chunks(batches, window, read, _send_windows(buckets, window, block), buckets)

    hits = _settled(keyed.select("_repeat_key", "_repeat_hash", "text").mapInArrow(probes, _SENT), _probe_hits)
    over = keyed.join(hits, ["_repeat_key", "_repeat_hash"])  # with all columns, as the caller joins them: so Spark moves the texts once
    return _settled(over.mapInArrow(windows, _SENT), _later_windows)


def kept_words(text: str | None, lists: list | None, window: int = WINDOW) -> tuple[list[bytes], int]:
    """The words that stay, and how many go."""
    words = (text or "").encode().split()
    places = _all_places(lists)
    if not len(places):
        return words, 0
    over = np.zeros(len(words) + 1, np.int64)
    np.add.at(over, places, 1)
    np.add.at(over, np.minimum(places + window, len(words)), -1)
    gone = over.cumsum()[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def _with_repeats(documents: DataFrame) -> DataFrame:
    """documents with _repeat_places (null where nothing repeats). The texts' exchange is the one that repeats() reads, so Spark makes it once."""
    keyed = _keyed(documents)
    return keyed.join(repeats(keyed), ["_repeat_key", "_repeat_hash"], "left")


def substring_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [kept_words(t, p) for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.record_batch(
                [b.column(0), pa.array([len(k) + n for k, n in kept], pa.int64()), pa.array([n for _, n in kept], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k, _ in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = _with_repeats(documents.select("doc_id", "text")).select("doc_id", "text", "_repeat_places")
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with their columns; texts that lose words are the words left, joined by one space, and n_chars follows."""

    @F.pandas_udf("string")
    def kept_text(text, places):
        return text.combine(places, lambda t, p: b" ".join(kept_words(t, p)[0]).decode())

    used = ("_repeat_key", "_repeat_hash", "_repeat_places")
    aside = {c: free_names(documents, f"_aside_{c}")[0] for c in documents.columns if c.lower() in used}
    documents, columns = documents.withColumnsRenamed(aside), documents.columns
    rows = _with_repeats(documents)
    new = F.when(F.col("_repeat_places").isNull(), F.col("text")).otherwise(kept_text("text", "_repeat_places"))
    out = rows.withColumn("text", new)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("_repeat_places").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in documents.columns)).toDF(*columns)
