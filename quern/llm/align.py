"""Alignment of two tokenizers: groups of tokens with common ends, links of tokens that overlap, and links' corpus-wide counts.

A (byte-level BPE, on a space and the text) and B (pieces, on the text, before which it puts a space itself) cut the same
bytes. Where tokens of both end, a group ends; tokens whose byte ranges overlap are linked. A pair of ids counts the
documents that hold it linked, and an A id's best pairs are those of its highest count.

How it runs: texts are cut into chunks where neither tokenizer lets a token cross (before the first of some spaces, around
lone line feeds), so a worker tokenizes and aligns each distinct chunk once while it remembers it. A block of documents
(up to Limits.block bytes of text) keeps its documents' links as numbers of the block's distinct pairs, and sends each
distinct pair once, with the number of its documents, to the stripe of the A id (id mod stripes). A stripe adds up what
blocks sent into a dense matrix, its own A ids by all B ids, with np.add.at; rows' maxima are the bests. A second pass over
what was sent answers each block in the order of its pairs, and the answers are co-partitioned with the blocks' links,
which score their documents. Where a stripe is sent more than Limits.sent bytes, its blocks are dealt over several matrices
first, whose cells are added up, and are answered in as many tasks.

Defined results: texts that are null, empty or not given back by both tokenizers (those with U+2581, which B takes for a
space) have no tokens: zeros and an empty string; blank texts have tokens like others; special tokens' strings are plain
text; very long texts without a cut are aligned whole; rows that repeat count each as a document, whatever their doc_id;
other columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .chunks import WHITE
from .common import stored
from .library_tokens import _byte_letters

SPACE = "▁"
_ODD = [*(c for c in WHITE if c not in " \n"), "\0", "  ", " \n", "\n ", "\n\n"]
#: Before a space that follows another character than white space, where A and B both cut.
_CUT = re.compile(f"(?<=[^{WHITE}])(?= )")
_SENT = "block bigint, stripe int, n bigint, codes binary, docs binary, rows array<struct<doc_id:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>, links binary"
_LONG = 200


@dataclass(frozen=True)
class Limits:
    """Bytes of text in a block, stripes of A ids, bytes that one matrix of a stripe is sent."""

    block: int = 1 << 23
    stripes: int = 512
    sent: int = 1 << 29


LIMITS = Limits()


def aligned(a: list[int], b: list[int], a_ends: list[int], b_ends: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links as places (of A, of B) of tokens that overlap, and groups as places (in A, in B) after their last tokens."""
    links, groups = [], []
    i = j = 0
    while i < len(a) and j < len(b):
        links.append((i, j))
        x, y = a_ends[i], b_ends[j]
        if x <= y:
            i += 1
        if y <= x:
            j += 1
        if x == y:
            groups.append((i, j))
    return links, groups


class Aligner:
    """Texts to (codes of linked pairs, n_a, n_b, n_groups, digest of groups). A pair's code is A id x B ids + B id. limit: chunks remembered."""

    def __init__(self, a_path: str, b_path: str, limit: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks use the cores already
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {letter: byte for byte, letter in _byte_letters().items()}
        self.a_bytes = {i: bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.b_ids = len(pieces)
        self.limit = limit
        self.known: dict[str, tuple] = {}

    def _b_encoded(self, chunks: list[str]) -> list[list[int]]:
        """A chunk that begins with a space gets it from B (which gives nothing for an empty text); another one goes behind a line feed, which is a token by itself."""
        spaced = [c[0] == " " != c for c in chunks]
        ids = self.b.encode([c[1:] if s else "\n" + c for s, c in zip(spaced, chunks)], num_threads=1)
        return [x if s else x[2:] for s, x in zip(spaced, ids)]

    def _made(self, chunks: list[str]) -> Iterator[tuple[str, tuple | None]]:
        size = self.b_ids
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        for chunk, ea, b in zip(chunks, self.a.encode_batch_fast(chunks, add_special_tokens=False), self._b_encoded(chunks)):
            a = ea.ids
            ta, tb = [a_bytes[k] for k in a], [b_bytes[k] for k in b]
            if len(a) == 1 and len(b) == 1 and ta == tb:
                links, groups = ((0, 0),), f"{a[0]}|{b[0]}"
                n = 1
            else:
                if b"".join(ta) != (raw := b"".join(tb)) or raw != chunk.encode():
                    yield chunk, None
                    continue
                ends = []
                for ts in (ta, tb):
                    at, own = 0, []
                    for t in ts:
                        at += len(t)
                        own.append(at)
                    ends.append(own)
                links, cuts = aligned(a, b, *ends)
                n = len(cuts)
                i = j = 0
                parts = []
                for x, y in cuts:
                    parts.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
                    i, j = x, y
                groups = ";".join(parts)
            yield chunk, (array("I", [a[x] * size + b[y] for x, y in links]).tobytes(), len(a), len(b), n, groups.encode())

    def chunks(self, text: str) -> list[str]:
        text = " " + text
        if text[-1] in " \n" or text[1] in " \n" or any(x in text for x in _ODD):
            return _CUT.split(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ")[1:].split("\0")

    def many(self, texts: list[str]) -> list[tuple | None]:
        """Of each text, or None where it has no tokens."""
        cut = [self.chunks(t) if t and SPACE not in t else None for t in texts]
        known = self.known
        missing = {c for cs in cut if cs for c in cs if c not in known}
        if len(known) + len(missing) > self.limit:
            for old in list(islice(known, len(known) // 2)):
                del known[old]
            missing = {c for cs in cut if cs for c in cs if c not in known}
        extra = {}
        for chunk, found in self._made(sorted(missing)):
            (known if len(chunk) <= _LONG else extra)[chunk] = found
        out = []
        for cs in cut:
            if cs is None:
                out.append(None)
                continue
            found = [known[c] for c in cs] if not extra else [known[c] if len(c) <= _LONG else extra[c] for c in cs]
            if None in found:
                out.append(None)
                continue
            codes, n_a, n_b, n, groups = zip(*found)
            out.append((b"".join(codes), sum(n_a), sum(n_b), sum(n), hashlib.sha256(b";".join(groups)).hexdigest()))
        return out


def vocabulary_sizes(a_path: str, b_path: str) -> tuple[int, int]:
    """Ids of A and of B. A pair must fit 32 bits."""
    a, b = Tokenizer.from_file(a_path).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    if a * b >= 1 << 32:
        raise ValueError(f"vocabularies of {a} and {b} ids: too large for pairs of 32 bits")
    return a, b


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for a Python worker, whatever tasks it runs."""
    if (a_path, b_path) not in _aligners:
        _aligners.clear()
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _slices(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, so that compression finds their upper bytes alike."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""


def _unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind)[:, 0] if data else np.zeros(0, kind)


def _zipped(arrays: list[np.ndarray]) -> bytes:
    raw = b"".join(map(_planes, arrays))
    return np.array([len(raw), *map(len, arrays)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unzipped(data: bytes, kinds: list) -> list[np.ndarray]:
    head = 8 * (len(kinds) + 1)
    size, *lengths = np.frombuffer(data[:head], np.int64).tolist()
    raw = pa.decompress(data[head:], size, "zstd", asbytes=True)
    out, at = [], 0
    for n, kind in zip(lengths, kinds):
        end = at + n * np.dtype(kind).itemsize
        out.append(_unplanes(raw[at:end], kind))
        at = end
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def by_stripe(codes: np.ndarray, b_ids: int, stripes: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """An order of ascending codes by stripe, the stripes there are, and where each begins and ends in it."""
    stripe = (codes // b_ids) % stripes
    order = np.argsort(stripe, kind="stable")
    kinds, first = np.unique(stripe[order], return_index=True)
    cuts = [*first.tolist(), len(codes)]
    return order, kinds, list(zip(cuts, cuts[1:]))


def sent(documents: DataFrame, a_path: str, b_path: str, limits: Limits = LIMITS) -> DataFrame:
    """Of each block a row of its documents (stripe -1) with their own results and links, and a row of distinct pairs for each stripe that it has some of."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 24
        ids: list[pa.Array] = []
        own: list[tuple] = []
        keys: list[np.ndarray] = []  # document of the block << 32 | code, distinct, in order
        times: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, times))
            doc, code = key >> 32, key & 0xFFFFFFFF
            codes, pair, held = np.unique(code, return_inverse=True, return_counts=True)
            codes = codes.astype(np.uint32)
            per = np.bincount(doc, minlength=len(own)).astype(np.uint32)
            # Pairs ascend in a document; the steps wrap around where the next one begins.
            links = [per, _steps(pair.astype(np.uint32)), n.astype(np.uint32), _steps(codes)]
            order, kinds, spans = by_stripe(codes, with_ids.b_ids, limits.stripes)
            codes, held = codes[order], held[order].astype(np.uint32)
            rows = pa.StructArray.from_arrays(
                [pa.concat_arrays(ids), *(pa.array([r[k] for r in own], pa.int64()) for k in range(4)), pa.array([r[4] for r in own], pa.string())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"],
            )
            listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            yield _batch([number], [-1], [len(key)], [None], [None], listed, [_zipped(links)])
            none = pa.nulls(len(spans), listed.type)
            yield _batch([number] * len(spans), kinds, [z - a for a, z in spans], [_planes(_steps(codes[a:z])) for a, z in spans], [_planes(held[a:z]) for a, z in spans], none, [None] * len(spans))

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = b.column(1).to_pylist()
                for begin, end in _slices([t or "" for t in texts]):
                    base = len(own)
                    found = with_ids.many(texts[begin:end])
                    flat = np.frombuffer(b"".join([f[0] for f in found if f]), np.uint32).astype(np.int64)
                    many = np.array([len(f[0]) // 4 if f else 0 for f in found], np.int64)
                    key, n = np.unique(flat | (np.repeat(np.arange(base, base + len(found)), many) << 32), return_counts=True)
                    keys.append(key)
                    times.append(n)
                    own += [(f[1], f[2], f[3], f[1] + f[2] - f[3], f[4]) if f else (0, 0, 0, 0, "") for f in found]
                    ids.append(b.column(0).slice(begin, end - begin))
                    size += sum(len(t or "") for t in texts[begin:end])
                    if size >= limits.block:
                        yield from flush()
                        number += 1
                        ids, own, keys, times, size = [], [], [], [], 0
        if own:
            yield from flush()

    def _batch(block, stripe, n, codes, docs, rows, links) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(block, pa.int64()), pa.array(stripe, pa.int32()), pa.array(n, pa.int64()), pa.array(codes, pa.binary()), pa.array(docs, pa.binary()), rows, pa.array(links, pa.binary())],
            names=["block", "stripe", "n", "codes", "docs", "rows", "links"],
        )

    return documents.select("doc_id", "text").mapInArrow(run, _SENT.format(kind=kind))


def _cells(limits: Limits, sizes: tuple[int, int]):
    """An empty matrix for the A ids of a stripe, and the cells of codes in it."""
    a_ids, b_ids = sizes
    return np.zeros((-(-a_ids // limits.stripes), b_ids), np.int64), lambda codes: (codes // b_ids // limits.stripes, codes % b_ids)


def _codes(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, np.uint32), dtype=np.uint32)


def matrices(rows: DataFrame, sizes: tuple[int, int], limits: Limits = LIMITS) -> DataFrame:
    """(stripe, deal, codes, docs) of rows of that kind, one of each stripe and deal: the cells above zero of a dense matrix into which all are added. docs are numbers of 32 bits, or of 64 where wide."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cell = _cells(limits, sizes)
        own = None

        def flush() -> Iterator[pa.RecordBatch]:
            a, b = np.nonzero(block)
            code = ((a * limits.stripes + own[0]) * sizes[1] + b).astype(np.uint32)
            n = block[a, b]
            block[a, b] = 0
            columns = [pa.array([own[0]], pa.int32()), pa.array([own[1]], pa.int32()), pa.array([True]), pa.array([_planes(_steps(code))], pa.binary()), pa.array([_planes(n)], pa.binary())]
            yield pa.record_batch(columns, names=["stripe", "deal", "wide", "codes", "docs"])

        for b in batches:
            for stripe, deal, wide, codes, docs in zip(*(c.to_pylist() for c in b.columns)):
                if own and own != (stripe, deal):
                    yield from flush()
                own = stripe, deal
                np.add.at(block, cell(_codes(codes)), _unplanes(docs, np.int64 if wide else np.uint32).astype(np.int64))
        if own:
            yield from flush()

    kept = rows.select("stripe", "deal", "wide", "codes", "docs")
    return kept.repartition("stripe", "deal").sortWithinPartitions("stripe", "deal").mapInArrow(run, "stripe int, deal int, wide boolean, codes binary, docs binary")


def answers(rows: DataFrame, counts: DataFrame, sizes: tuple[int, int], limits: Limits = LIMITS) -> DataFrame:
    """(block, stripe, docs, best) of each row sent: its pairs' counts in their order, and whether they are their A id's highest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cell = _cells(limits, sizes)
        most = None
        for b in batches:
            out: list[tuple] = []
            for stripe, _, number, codes, docs in zip(*(c.to_pylist() for c in b.columns)):
                a, at = cell(_codes(codes))
                if number is None:  # what all blocks sent to the stripe comes before the blocks
                    block[:] = 0
                    block[a, at] = _unplanes(docs, np.int64)
                    most = block.max(axis=1)
                else:
                    n = block[a, at]
                    out.append((number, stripe, _zipped([n]), np.packbits(n == most[a]).tobytes()))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
            yield pa.record_batch(columns, names=["block", "stripe", "docs", "best"])

    none = F.lit(None)
    both = counts.select("stripe", "deal", none.cast("bigint").alias("block"), "codes", "docs").unionAll(rows.select("stripe", "deal", "block", "codes", none.cast("binary").alias("docs")))
    return both.repartition("stripe", "deal").sortWithinPartitions("stripe", "deal", F.asc_nulls_first("block")).mapInArrow(run, "block bigint, stripe int, docs binary, best binary")


def scored(asked: DataFrame, replied: DataFrame, b_ids: int, limits: Limits = LIMITS) -> DataFrame:
    """The rows of all documents, with n_best and count_sum, block by block: the answers to a block in the order of stripes, then its documents with their links."""
    kind = asked.schema["rows"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[np.ndarray] = []
        bests: list[np.ndarray] = []
        for b in batches:
            for stripe, docs, best, rows, links in zip(*(b.column(k) for k in range(1, 6))):
                if stripe.as_py() >= 0:
                    counts.append(_unzipped(docs.as_py(), [np.int64])[0])
                    bests.append(np.unpackbits(np.frombuffer(best.as_py(), np.uint8), count=len(counts[-1])))
                    continue
                per, pair, n, codes = _unzipped(links.as_py(), [np.uint32] * 4)
                pair = np.cumsum(pair, dtype=np.uint32)
                order, _, _ = by_stripe(np.cumsum(codes, dtype=np.uint32), b_ids, limits.stripes)
                count, top = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
                if len(codes):
                    count[order], top[order] = np.concatenate(counts), np.concatenate(bests)
                counts, bests = [], []
                own = pa.RecordBatch.from_struct_array(rows.values)
                ends = np.r_[0, np.cumsum(per, dtype=np.int64)]
                sums = [np.diff(np.r_[0, np.cumsum(x[pair] * n)][ends]) for x in (top, count)]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
                yield pa.record_batch([*(own.column(c) for c in names), *map(pa.array, sums), own.column("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"])

    none = F.lit(None).cast("binary")
    blocks = asked.filter("stripe = -1").select("block", "stripe", none.alias("docs"), none.alias("best"), "rows", "links")
    sent_back = replied.select("block", "stripe", "docs", "best", F.lit(None).cast(asked.schema["rows"].dataType).alias("rows"), none.alias("links"))
    both = sent_back.unionAll(blocks).repartition("block").sortWithinPartitions("block", F.col("stripe") < 0, "stripe")
    return both.mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def tokenizer_alignment(documents: DataFrame, a_path: str, b_path: str, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    sizes = vocabulary_sizes(a_path, b_path)
    asked = stored(sent(documents, a_path, b_path, limits), "links")
    pairs = asked.filter("stripe >= 0").select("block", "stripe", "codes", "docs")
    weight = F.sum(F.octet_length("codes") + F.octet_length("docs"))
    deals = pairs.groupBy("stripe").agg(F.ceil(weight / limits.sent).cast("int").alias("deals"))  # a row per stripe
    dealt = pairs.join(F.broadcast(deals), "stripe").withColumn("deal", F.pmod(F.xxhash64("block"), F.col("deals")).cast("int")).withColumn("wide", F.lit(False))
    counts = matrices(dealt, sizes, limits)
    if (deals.agg(F.max("deals")).first()[0] or 0) > 1:  # one number
        counts = matrices(stored(counts, "matrices").withColumn("deal", F.lit(0)), sizes, limits)
    counts = stored(counts, "matrices")
    each = counts.join(F.broadcast(deals), "stripe").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    return scored(asked, answers(dealt, each, sizes, limits), sizes[1], limits)
