"""Prediction by partial matching over bytes, scoring whole documents.

A text is its UTF-8 bytes and then END, a byte that UTF-8 doesn't use; ORDER of them stand before its first byte. Each
byte is predicted from the ORDER bytes before it, across words and lines. A byte with its context is one number, a gram,
and the trie is the sorted grams with their counts, of which those of shorter contexts follow.

In a context whose counts add up to N over q kinds of symbols, a symbol of count n has probability (n - D) / N, where D is
DISCOUNT; one that it hasn't seen costs an escape of q D / N and goes on to the context one byte shorter, where the symbols
that the longer one has seen are excluded; below order 0 all symbols that are left are alike. A context that was never
seen costs nothing. Counts are occurrences at ORDER and at orders 1 and 0; in between they are update-exclusive: in how
many contexts one byte longer the symbol was seen.

How it runs: a chunk of documents (up to Limits.chunk bytes of text) sends each of its distinct grams once, with its count in
learning texts, to the bucket of the gram's last two context bytes. So a bucket holds the whole trie below its contexts of
two bytes, exclusions included; the counts of shorter contexts are a table of at most 65,536 numbers, which all buckets get.
A bucket first adds up what all chunks sent, one after the other, then answers each chunk with the grams' code lengths,
in the order in which they were sent. Distinct words go the same way and come back with their counts. A chunk's texts
are stored with its grams, so that it scores the very texts that it asked for. No count is cut off.

Defined results: a null or empty text has the end alone; a blank one its white space; very long texts are cut into slices
for memory, with the bytes before as context; rows that repeat count each time, and equal texts have equal scores; a null
doc_id is never held out; without learning texts every symbol costs log10(256); an empty table gives no rows. Words are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, stored

ORDER = 5
DISCOUNT = 0.4
FOLDS, HELD_OUT = 7, 2
END = b"\xff"
SYMBOLS = 256
_SENT = "bucket int, chunk bigint, kind string, n bigint, data binary"
_BACK = "chunk bigint, bucket int, kind string, n bigint, data binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """Bytes of text in a chunk, bytes whose grams are made at a time, and buckets for each kind of key."""

    chunk: int = 1 << 23
    slice: int = 1 << 20
    buckets: int = 1024


LIMITS = Limits()


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _slices(texts: list[bytes], order: int, most: int = LIMITS.slice) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(texts' places, grams, where each text's begin) of a few texts or a part of one at a time; a text's slices are alike wherever it stands."""
    few: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if few and size + len(t) >= most:
            yield few, *_grams([texts[k] for k in few], order)
            few, size = [], 0
        few.append(i)
        size += len(t) + 1
        if len(t) >= most:
            raw = END * order + t + END
            for at in range(0, len(t) + 1, most):
                yield [i], _windows(np.frombuffer(raw, np.uint8, min(most + order, len(raw) - at), at), order), np.zeros(1, np.int64)
            few, size = [], 0
    if few:
        yield few, *_grams([texts[k] for k in few], order)


def _windows(raw: np.ndarray, order: int) -> np.ndarray:
    n = len(raw) - order
    g = raw[order:].astype(np.uint64)
    for k in range(1, order + 1):
        g |= raw[order - k : order - k + n].astype(np.uint64) << np.uint64(8 * k)
    return g


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    pad = END * order
    raw = np.frombuffer(pad + (END + pad).join(texts) + END, np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.r_[0, size.cumsum()[:-1]]
    # Between two texts lie `order` windows that belong to neither.
    return _windows(raw, order)[np.arange(int(size.sum())) + np.repeat(order * np.arange(len(texts)), size)], begins


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def distinct_grams(texts: list[bytes], learnt: list[bool], order: int = ORDER, most: int = LIMITS.slice) -> tuple[np.ndarray, np.ndarray]:
    """All distinct grams, and how often each is in learning texts."""
    parts = []
    for which in (True, False):
        for _, g, _ in _slices([t for t, x in zip(texts, learnt) if x == which], order, most):
            key, n = np.unique(g, return_counts=True)
            parts.append((key, n if which else np.zeros(len(key), np.int64)))
    return _counted(parts)


def distinct_words(hashes: list[np.ndarray], learnt: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    parts = []
    for which in (True, False):
        some = [h for h, x in zip(hashes, learnt) if x == which]
        key, n = np.unique(np.concatenate(some) if some else np.zeros(0, np.uint64), return_counts=True)
        parts.append((key, n if which else np.zeros(len(key), np.int64)))
    return _counted(parts)


def gram_bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    """By the last two bytes of the context."""
    pair = (g >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((pair * _MIX) >> np.uint64(54)).astype(np.int64) % buckets


def word_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return buckets + ((h * _MIX) >> np.uint64(54)).astype(np.int64) % buckets


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket that keeps the keys' own, the buckets there are, and where each begins and ends in it."""
    order = np.argsort(bucket, kind="stable")
    kinds, first = np.unique(bucket[order], return_index=True)
    return order, kinds, np.r_[first, len(bucket)]


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: their upper bytes are alike, and shuffles compress them away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "kind": pa.string(), "n": pa.int64(), "data": pa.binary()}
    columns = [x.split()[0] for x in names.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[c]) for k, c in enumerate(columns)], names=columns)


def _packed(ids: pa.Array, texts: list[bytes]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([ids, pa.array(texts, pa.large_binary())], names=["doc_id", "text"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _parts(texts: list[bytes], most: int = 400_000) -> list[tuple[int, int]]:
    """Texts in a row with at most `most` bytes, or one: rows that are small for the JVM."""
    cuts, size = [0], 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            cuts.append(i)
            size = 0
        size += len(t)
    return list(zip(cuts, [*cuts[1:], len(texts)]))


def _words(hashes: WordHashes, text: bytes) -> np.ndarray:
    return hashes.array(text.lower().split())  # of bytes: only A-Z change, only 09-0D and 20 separate


def sent(documents: DataFrame, order: int = ORDER, limits: Limits = LIMITS) -> DataFrame:
    """What chunks send: rows of kind keys for buckets; pairs, tokens and ends for all; and their own texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        number = TaskContext.get().partitionId() << 24
        ids: list[pa.Array] = []
        texts: list[bytes] = []
        held: list[bool] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            learnt = [not x for x in held]
            key, n = distinct_grams(texts, learnt, order, limits.slice)
            pairs = np.bincount((key & np.uint64(0xFFFF)).astype(np.int64), weights=n, minlength=1 << 16).astype(np.int64)
            some = np.flatnonzero(pairs)
            rows = [(-1, number, "pairs", 0, np.r_[some, pairs[some]].tobytes()), (-1, number, "ends", sum(learnt), b"")]
            words, m = distinct_words([_words(hashes, t) for t in texts], learnt)
            rows.append((-1, number, "tokens", int(m.sum()), b""))
            for k, c, bucket in ((key, n, gram_bucket(key, limits.buckets)), (words, m, word_bucket(words, limits.buckets))):
                by, kinds, cut = _by_bucket(bucket)
                for b, a, z in zip(kinds.tolist(), cut[:-1], cut[1:]):
                    rows.append((b, number, "keys", int(z - a), _planes(k[by[a:z]]) + _planes(c[by[a:z]])))
            yield _rows(rows, _SENT)
            own, parts = pa.concat_arrays(ids), _parts(texts)
            for k, (a, z) in enumerate(parts):  # n: how many parts follow
                yield _rows([(-1, number, "texts", len(parts) - 1 - k, _packed(own.slice(a, z - a), texts[a:z]))], _SENT)

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids.append(b.column(0))
                texts += [(t or "").encode() for t in b.column(1).to_pylist()]
                held += [is_held_out(i) for i in b.column(0).to_pylist()]
                size += sum(map(len, texts[-b.num_rows :]))
                if size >= limits.chunk:
                    yield from flush()
                    number += 1
                    ids, texts, held, size = [], [], [], 0
        if texts:
            yield from flush()

    return documents.select("doc_id", "text").mapInArrow(run, _SENT)


def pair_counts(rows: DataFrame) -> np.ndarray:
    """How often each byte follows each other one in learning texts: at most 65,536 rows, whatever the input."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for data in b.column(0).to_pylist():
                pair, n = np.frombuffer(data, np.int64).reshape(2, -1)
                total[pair] += n
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    found = rows.filter("kind = 'pairs'").select("data").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[np.array(found.column(0), np.int64)] = np.array(found.column(1), np.int64)
    return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values of the wanted keys, of sorted ones; 0 for others."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def code_lengths(grams: np.ndarray, n: np.ndarray, pairs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 of the probability of each gram's symbol in its context, from all learnt grams that end in the same contexts of two bytes, and the counts of pairs."""
    mask = lambda k: np.uint64((1 << 8 * k) - 1)
    symbols: dict[int, tuple[np.ndarray, np.ndarray]] = {order: (grams[n > 0], n[n > 0])}
    for k in range(order - 1, 1, -1):
        key, _ = symbols[k + 1]
        symbols[k] = _counted([(key & mask(k + 1), np.ones(len(key), np.int64))])
    some = np.flatnonzero(pairs)
    symbols[1] = some.astype(np.uint64), pairs[some]
    alone = pairs.reshape(256, 256).sum(0)
    symbols[0] = np.flatnonzero(alone).astype(np.uint64), alone[alone > 0]
    done = np.zeros(len(grams), bool)
    cost = np.zeros(len(grams))
    gone = kinds_gone = np.zeros(len(grams), np.int64)
    for k in range(order, -1, -1):
        key, c = symbols[k]
        context = key >> np.uint64(8)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(key) else np.zeros(0, np.int64)
        total, kinds = (np.add.reduceat(x, first) if len(key) else x for x in (c, np.ones(len(key), np.int64)))
        lower = np.add.reduceat(_found(*symbols[k - 1], key & mask(k)), first) if k and len(key) else np.zeros(len(first), np.int64)
        wanted = (grams >> np.uint64(8)) & mask(k)
        t, q, e = (_found(context[first], x, wanted) for x in (total, kinds, lower))
        seen = _found(key, c, grams & mask(k + 1))
        left, kinds_left = t - gone, q - kinds_gone
        hit = ~done & (seen > 0)
        escape = ~done & (seen == 0) & (left > 0)
        cost[hit] += np.log10((seen[hit] - DISCOUNT) / left[hit])
        cost[escape] += np.log10(kinds_left[escape] * DISCOUNT / left[escape])
        done |= hit
        gone, kinds_gone = e, q
    cost[~done] -= np.log10(np.maximum(SYMBOLS - kinds_gone[~done], 1))
    return cost


def answers(rows: DataFrame, pairs: np.ndarray, order: int = ORDER, limits: Limits = LIMITS) -> DataFrame:
    """What buckets send back: to each chunk the code lengths of its grams, or the counts of its words, in the order sent; and how many distinct words have a count."""
    table = rows.sparkSession.sparkContext.broadcast(pairs)

    def read(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        return _unplanes(data[: 8 * n], np.uint64), _unplanes(data[8 * n :], np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, waiting, held = None, [], 0, 0
        key, value = _counted([])
        asked = False
        for b in batches:
            out: list[tuple] = []
            for k, chunk, phase, n, data in zip(*(c.to_pylist() for c in b.columns)):
                if k != bucket:
                    bucket, parts, waiting, held, asked = k, [], 0, 0, False
                if phase == 0:
                    parts.append(read(n, data))
                    waiting += n
                    if waiting > 2 * held + 100_000:  # so that what is held follows the distinct keys, not the chunks
                        parts = [_counted(parts)]
                        held, waiting = len(parts[0][0]), 0
                    continue
                if not asked:
                    key, c = _counted(parts)
                    value = code_lengths(key, c, table.value, order) if bucket < limits.buckets else c
                    if bucket >= limits.buckets:
                        out.append((-1, bucket, "distinct", int((c > 0).sum()), b""))
                    parts, asked = [], True
                wanted, _ = read(n, data)
                out.append((chunk, bucket, "answer", n, _planes(value[np.searchsorted(key, wanted)])))
            yield _rows(out, _BACK)

    # Each message goes to its bucket twice in one exchange: to be counted, then to be answered.
    twice = rows.filter("kind = 'keys'").select("bucket", "chunk", F.explode(F.array(F.lit(0), F.lit(1))).alias("phase"), "n", "data")
    return twice.repartition("bucket").sortWithinPartitions("bucket", "phase").mapInArrow(run, _BACK)


def _sums(value: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at places; of an empty run, 0."""
    size = np.diff(np.r_[begins, len(value)])
    out = np.zeros(len(begins), value.dtype)
    some = size > 0
    if some.any():
        out[some] = np.add.reduceat(value, begins[some])
    return out


def scored(asked: DataFrame, replied: DataFrame, kind: str, ends: int, order: int = ORDER, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, logs (the sum of log10(c + 1) over tokens) and score, of the chunks' texts."""

    def chunk(ids: pa.Array, texts: list[bytes], replies: dict[int, bytes], hashes: WordHashes) -> pa.RecordBatch:
        held = [is_held_out(i) for i in ids.to_pylist()]
        learnt = [not x for x in held]
        grams, _ = distinct_grams(texts, learnt, order, limits.slice)
        by_word = [_words(hashes, t) for t in texts]
        words, _ = distinct_words(by_word, learnt)
        value = []
        for keys, bucket, of in ((grams, gram_bucket(grams, limits.buckets), np.float64), (words, word_bucket(words, limits.buckets), np.int64)):
            by, kinds, _ = _by_bucket(bucket)
            got = np.zeros(len(keys), of)
            got[by] = np.concatenate([_unplanes(replies[k], of) for k in kinds.tolist()]) if len(keys) else got
            value.append(got)
        score = np.zeros(len(texts))
        index = pd.Index(grams)
        for few, g, begins in _slices(texts, order, limits.slice):
            score[few] += _sums(value[0][index.get_indexer(g)], begins)
        size = np.fromiter(map(len, by_word), np.int64, len(texts))
        begins = np.r_[0, size.cumsum()[:-1]]
        flat = np.concatenate(by_word)
        c = value[1][pd.Index(words).get_indexer(flat)] if len(flat) else np.zeros(0, np.int64)
        known = _sums((c > 0).astype(np.int64), begins) + (ends > 0)
        logs = _sums(np.log10(c + 1.0), begins) + np.log10(ends + 1.0)
        return pa.record_batch([ids, pa.array(held), pa.array(size + 1), pa.array(known), pa.array(logs), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        replies: dict[int, bytes] = {}
        ids: list[pa.Array] = []
        texts: list[bytes] = []
        for b in batches:
            for bucket, what, n, data in zip(*(b.column(k) for k in (1, 2, 3, 4))):
                if what.as_py() == "answer":
                    replies[bucket.as_py()] = data.as_py()
                    continue
                t = pa.ipc.open_stream(data.as_py()).read_all()
                ids += t.column("doc_id").chunks
                texts += t.column("text").to_pylist()
                if n.as_py() == 0:
                    yield chunk(pa.concat_arrays(ids), texts, replies, hashes)
                    replies, ids, texts = {}, [], []

    texts = asked.filter("kind = 'texts'").select("chunk", "bucket", "kind", "n", "data")
    both = replied.filter("kind = 'answer'").unionAll(texts).repartition("chunk").sortWithinPartitions("chunk", "kind", F.desc("n"))  # answers, and then texts to the last part
    return both.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double")


def ppm_scores(documents: DataFrame, order: int = ORDER, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    asked = stored(sent(documents, order, limits), "grams")
    sums = {r["kind"]: r["n"] for r in asked.filter("kind IN ('tokens', 'ends')").groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # two rows
    ends = sums.get("ends", 0)
    total = sums.get("tokens", 0) + ends
    replied = stored(answers(asked, pair_counts(asked), order, limits), "answers")
    distinct = replied.filter("kind = 'distinct'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + (ends > 0)
    rows = scored(asked, replied, documents.schema["doc_id"].dataType.simpleString(), ends, order, limits)
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
