"""Cost-balanced packing of documents into sequences of at most CAPACITY tokens.

A document of n tokens gives n // CAPACITY full sequences; what is left of it is packed. In each pack (up to PACK_DOCS
documents of a partition) there are as many sequences as the tokens fill: full ones, and for the rest lengths that are
powers of two, so that nothing is padded. Documents, longest first, go to the sequence of lowest cost that has room,
where a piece of n tokens costs n + n^2 / CAPACITY (linear work and attention). When no sequence has room for a whole
piece, the emptiest one takes its beginning and the rest is put back in order.

No rows are shuffled: a pack is made of the rows a task reads, in bounded memory, and read again they give the same
pack. sequence_id tells the partition and counts within it.

Defined results: a null or empty text has the end id alone, a blank one tokens like others; very long texts give full sequences
and a rest; a null doc_id is packed like others; repeated rows are packed each; of sequences that tie in cost the first takes
a piece; other columns, whatever their names, take no part; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .library_tokens import library_tokens

CAPACITY = 1024
PACK_DOCS = 4096
PACK_TOKENS = 4_000_000
END_ID = 0


def lengths_for(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of sequences that `tokens` tokens fill: full ones, then powers of two."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def balanced(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) that hold every token of the items, of fewer than `capacity` tokens each, once."""
    room = np.array(lengths_for(sum(sizes), capacity), np.int64)
    total = room.copy()
    cost = np.zeros(len(room))
    todo = [(-n, i, 0) for i, n in enumerate(sizes) if n]
    heapify(todo)
    out = []
    while todo:
        n, i, start = heappop(todo)
        n = -n
        s = int(np.where(room >= n, cost, np.inf).argmin())
        if room[s] < n:  # nowhere has room for all of it
            s = int(room.argmax())
        part = min(n, int(room[s]))
        out.append((i, start, part, s, int(total[s] - room[s])))
        room[s] -= part
        cost[s] += part + part * part / capacity
        if part < n:
            heappush(todo, (part - n, i, start + part))
    return out


def _pack(keys: list, ids: list[bytes], first: int, capacity: int) -> tuple[dict[str, list], int]:
    rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}

    def put(i: int, start: int, length: int, sequence: int, offset: int) -> None:
        crc = zlib.crc32(ids[i][4 * start : 4 * (start + length)])
        for k, v in zip(rows, (keys[i], start, length, crc, len(ids[i]) // 4, sequence, offset)):
            rows[k].append(v)

    rest, at = [], []
    for i, x in enumerate(ids):
        n = len(x) // 4
        for k in range(n // capacity):
            put(i, k * capacity, capacity, first, 0)
            first += 1
        rest.append(n % capacity)
        at.append(n - n % capacity)
    last = first
    for i, start, length, sequence, offset in balanced(rest, capacity):
        put(i, at[i] + start, length, first + sequence, offset)
        last = max(last, first + sequence + 1)
    return rows, last


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def packed(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of a document."""
    end = np.array([END_ID], np.uint32).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library_tokens(path, lower=False)
        first = TaskContext.get().partitionId() << 40
        keys: list = []
        ids: list[bytes] = []
        schema = None
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held
            rows, first = _pack(keys, ids, first, capacity)
            keys.clear()
            ids.clear()
            held = 0
            return pa.record_batch([pa.array(rows["doc_id"], schema), *(pa.array(v, pa.int64()) for k, v in rows.items() if k != "doc_id")], names=list(rows))

        for b in batches:
            schema = b.schema.field(0).type
            texts, names = b.column(1).to_pylist(), b.column(0).to_pylist()
            for at in range(0, len(texts), 512):
                some = [x + end for x in tokens.encode([t or "" for t in texts[at : at + 512]])]
                keys += names[at : at + 512]
                ids += some
                held += sum(map(len, some)) // 4
                if len(keys) >= PACK_DOCS or held >= PACK_TOKENS:
                    yield flush()
        if keys:
            yield flush()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
