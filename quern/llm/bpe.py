"""Byte-level BPE with a vocabulary of ranks, by merging rows of padded matrices.

A text is cut by the vocabulary's pattern; each distinct piece is a row of byte tokens in a matrix of rows of about
its length. In each round every row merges its leftmost pair of minimum rank: ranks of pairs come from a hash table
in arrays, the merged rows close up, and rows without a pair leave the matrix. A piece beyond LONG bytes, of which there
are few, makes the same merges in the same order from a heap, as rounds over a row so wide would take its length squared.

Defined results: null and empty texts have no tokens; a blank text has those of its white space; very long texts are cut by the
pattern like any other; repeated rows and equal texts have equal ids; an empty table gives no rows. The vocabulary's path is a parameter; it is read on the driver, and what is sent to
the executors is bounded by the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import PLAIN, ChunkMemory, spaced_chunks

NONE = np.int64(2**31 - 1)
LONG = 256
CELLS = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line has a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """(left id, right id) -> id of the merged token, in an open-addressing hash table of arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.bits = max(10, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        left = np.array([(a << 32) | b for a, b in pairs], np.int64)
        value = np.array(list(pairs.values()), np.int64)
        at = self._slot(left)
        while len(left):  # all try their slot; one wins each free slot, the rest go on
            free = np.flatnonzero(self.keys[at] == -1)
            self.keys[at[free]], self.ranks[at[free]] = left[free], value[free]
            lost = self.keys[at] != left
            won = ~lost
            self.ranks[at[won]] = value[won]
            left, value, at = left[lost], value[lost], (at[lost] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is none; ids below 0 pair with nothing."""
        key = (left << 32) | right
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1) & (left >= 0) & (right >= 0))
        at, key = at[open_], key[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            hit, end = self.keys[at] == key, self.keys[at] == -1
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~(hit | end)
            open_, at, key = open_[go], at[go], key[go]
        out[(left < 0) | (right < 0)] = NONE
        return out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 700_000):
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.whole = {t: np.array([r], np.uint32).tobytes() for t, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.memory = ChunkMemory(spaced_chunks, self.encode_chunks, limit)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        cut: list[list[bytes]] = []
        for c in chunks:
            m = PLAIN.fullmatch(c)
            cut.append([x.encode() for x in (m.groups() if m else self.pattern.findall(c)) if x])
        pieces = list(dict.fromkeys(p for ps in cut for p in ps if p not in self.whole))
        known = dict(zip(pieces, self.encode_pieces(pieces)))
        whole = self.whole
        return [b"".join([whole.get(p) or known[p] for p in ps]) for ps in cut]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, each merged by itself."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = np.where(lengths <= 16, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for w in np.unique(width):
            members = np.flatnonzero(width == w)
            if w > LONG:
                for i in members:
                    out[i] = self._long(pieces[i])
                continue
            step = max(1, CELLS // max(1, int(w)))
            for at in range(0, len(members), step):
                some = members[at : at + step]
                self._rows([pieces[i] for i in some], int(w), some, out)
        return out

    def _rows(self, pieces: list[bytes], width: int, where: np.ndarray, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        column = np.arange(width)
        token = np.where(column < size[:, None], self.byte_ids[raw], -1)
        rank = np.full(token.shape, NONE)
        rank[:, :-1] = self.pairs.lookup(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(len(pieces), width - 1)
        while len(token):
            at = rank.argmin(axis=1)  # the leftmost of the least
            rows = np.arange(len(token))
            least = rank[rows, at]
            ended = least == NONE
            if ended.any():
                for i, n, ids in zip(where[ended], size[ended], token[ended].astype(np.uint32)):
                    out[i] = ids[:n].tobytes()
                go = ~ended
                token, rank, size, where, at, least = token[go], rank[go], size[go], where[go], at[go], least[go]
                if not len(token):
                    break
                rows = np.arange(len(token))
            most = int(size.max())
            token, rank = token[:, :most], rank[:, :most]
            source = np.minimum(np.arange(most) + (np.arange(most) > at[:, None]), most - 1)
            token, rank = np.take_along_axis(token, source, 1), np.take_along_axis(rank, source, 1)
            size = size - 1
            token[rows, at] = least
            token[rows, size] = -1
            rank[rows, size] = NONE
            after = np.minimum(at + 1, most - 1)
            rank[rows, at] = self.pairs.lookup(least, np.where(at + 1 < size, token[rows, after], -1))
            before = np.maximum(at - 1, 0)
            inner = at > 0
            rank[rows[inner], before[inner]] = self.pairs.lookup(token[rows[inner], before[inner]], least[inner])

    def _long(self, piece: bytes) -> bytes:
        """The same merges in the same order, the next one from a heap of (rank, place): a long row alone would be looked through whole in each round."""
        token = self.byte_ids[np.frombuffer(piece, np.uint8)]
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        rank = self.pairs.lookup(token[:-1], token[1:])
        some = np.flatnonzero(rank != NONE)
        ids = token.tolist()
        heap = list(zip(rank[some].tolist(), some.tolist(), token[some].tolist(), token[some + 1].tolist()))
        heapq.heapify(heap)
        while heap:
            least, at, left, right = heapq.heappop(heap)
            to = after[at]
            if ids[at] != left or to >= len(ids) or ids[to] != right:
                continue  # one of the two has been merged
            ids[at], ids[to] = least, -1
            after[at] = after[to]
            if after[to] < len(ids):
                before[after[to]] = at
            sides = [(x, y) for x, y in ((before[at], at), (at, after[at])) if x >= 0 and y < len(ids)]
            found = self.pairs.lookup(np.array([ids[x] for x, _ in sides], np.int64), np.array([ids[y] for _, y in sides], np.int64)) if sides else ()
            for (x, y), r in zip(sides, found):
                if r != NONE:
                    heapq.heappush(heap, (int(r), x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.uint32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.memory.many(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, np.uint32).tolist()))


_codecs: dict[tuple, ByteBPE] = {}


def _codec(ranks: dict[bytes, int], pattern: str) -> ByteBPE:
    """One codec for a Python worker, whatever tasks it runs."""
    key = (len(ranks), pattern, hash(frozenset(list(ranks.items())[:1000])))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = ByteBPE(ranks, pattern)
    return _codecs[key]


def bpe_round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text: encoded, and decoded from its ids."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for b in batches:
            ids = codec.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.record_batch(
                {
                    "doc_id": b.column(0),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
                }
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
