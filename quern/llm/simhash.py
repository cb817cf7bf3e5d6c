"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within RADIUS bits of each other agree on at least two of four 16-bit blocks, so each distinct
fingerprint is grouped under the six pairs of blocks. Groups are compared with fingerprints stored vertically: word k of
plane b holds bit b of 64 fingerprints, carry-save counters over the planes count 64 distances at a time, and a
block of 64 is abandoned once all its distances exceed the radius. A group hands on a star over each of its connected
parts, never its pairs.

A group of more than SMALL is split instead of compared: its members still share their two blocks, so the differing
bits lie in the other 32, of which one third must agree, and then one third of what is left again. After two such steps
a group shares at least 49 bits; there are at most 2^15 distinct fingerprints in it, which bounds the work of a task.

Defined results: null texts are empty; a text without words has fingerprint 0 and is linked like any other; documents of
equal fingerprint are one node; repeated rows count each; a component of documents that all lack a doc_id has none; very
long texts are hashed whole, their bits counted in slices; an empty table gives no rows. near.py finds texts by similarity
with the same comparison at a wider radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, number_of, spread_join, stored
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
SMALL = 2048
ITEMS = 1 << 14  # comparisons of one fingerprint with 64 that are made at a time
WORDS = 1 << 11
_FULL, _ZERO, _ONE = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0), np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()  # of bytes: only A-Z change, only 09-0D and 20 separate
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp's 64 bits as a signed number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """(64 W, len / 64) of fingerprints of W words of 64 bits each: word k of plane b holds bit b of fingerprints 64 k to 64 k + 63."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-(-len(fp) // 64), 64, -1), axis=2, bitorder="little")
    packed = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little"))
    return packed.view(np.uint64)[:, :, 0]


def near_lanes(planes: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each item, the bits of those lanes of its word that are within radius of its query: a number, or W of them."""
    near = np.zeros(len(query), np.uint64)
    query = query.reshape(len(query), -1)
    live = np.arange(len(query))
    width = max(1, radius.bit_length())
    counter = [np.zeros(len(query), np.uint64) for _ in range(width)]
    far = np.zeros(len(query), np.uint64)
    q, w = query, word
    for b in range(0, len(planes), 8):
        differ = [planes[k].take(w) ^ (_ZERO - ((q[:, k // 64] >> np.uint64(k % 64)) & _ONE)) for k in range(b, b + 8)]
        far = far | _added(counter, _eight(differ)) | _above(counter, radius)
        go = far != _FULL
        if not go.all():  # abandoned: all 64 distances exceed the radius
            live, q, w, far = live[go], q[go], w[go], far[go]
            counter = [c[go] for c in counter]
            if not len(live):
                return near
    near[live] = ~far
    return near


def _full_add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits in each lane."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _eight(x: list[np.ndarray]) -> list[np.ndarray]:
    """Four bits, from the lowest, of the sum of eight bits in each lane, by carry-save adders."""
    a, c1 = _full_add(x[0], x[1], x[2])
    b, c2 = _full_add(x[3], x[4], x[5])
    ones, c3 = _full_add(a, b, x[6])
    ones, c4 = ones ^ x[7], ones & x[7]
    twos, d1 = _full_add(c1, c2, c3)
    twos, d2 = twos ^ c4, twos & c4
    return [ones, twos, d1 ^ d2, d1 & d2]


def _added(counter: list[np.ndarray], number: list[np.ndarray]) -> np.ndarray:
    """Adds numbers to counters, in place; lanes that overflow."""
    carry = np.zeros_like(counter[0])
    for k in range(len(counter)):
        if k < len(number):
            counter[k], carry = _full_add(counter[k], number[k], carry)
        else:
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
    for high in number[len(counter) :]:
        carry = carry | high
    return carry


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count exceeds radius, by comparing bit by bit from the top."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], _FULL)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above = above | (equal & counter[k])
            equal = equal & ~counter[k]
    return above


def group_links(groups: list[np.ndarray], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint of its connected part) for the members of groups of distinct fingerprints that aren't the least themselves."""
    size = np.array([len(g) for g in groups], np.int64)
    words = -(-size // 64)
    first_word = np.r_[0, words.cumsum()]
    lanes = np.zeros(64 * int(first_word[-1]), np.uint64)
    valid = np.zeros(len(lanes), bool)
    for g, at in zip(groups, 64 * first_word):
        lanes[at : at + len(g)] = np.sort(g)
        valid[at : at + len(g)] = True
    planes = bit_planes(lanes)
    real = np.packbits(valid.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    label = np.arange(len(lanes))
    members = np.flatnonzero(valid)
    group = np.repeat(np.arange(len(groups)), size)
    span = words[group]  # words that a member is compared with
    ends = span.cumsum()
    at = 0
    while at < len(members):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ITEMS, side="right")))
        some = np.repeat(np.arange(at, end), span[at:end])
        nth = np.arange(len(some)) - np.repeat(ends[at:end] - span[at:end] - (ends[at - 1] if at else 0), span[at:end])
        word = first_word[group[some]] + nth
        near = near_lanes(planes, lanes[members[some]], word) & real[word]
        own = members[some]
        same = own // 64 == word
        near[same] &= ~(np.uint64(1) << (own[same] % 64).astype(np.uint64))
        for i in np.flatnonzero(near):
            hit = 64 * word[i] + np.flatnonzero(np.unpackbits(near[i : i + 1].view(np.uint8), bitorder="little"))
            some_labels = np.unique(np.r_[label[own[i]], label[hit]])
            if len(some_labels) > 1:
                a, z = 64 * first_word[group[some[i]]], 64 * first_word[group[some[i]] + 1]
                part = label[a:z]
                part[np.isin(part, some_labels)] = some_labels[0]
        at = end
    moved = np.flatnonzero(valid & (label != np.arange(len(lanes))))
    return lanes[moved], lanes[label[moved]]


def _compared(grouped: DataFrame) -> DataFrame:
    """(a, b) links of rows (fps: distinct fingerprints)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            flat, offsets = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            ends = np.cumsum(-(-np.diff(offsets) // 64))
            at = 0
            while at < len(ends):  # as many groups at a time as fill about WORDS words of each plane
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, side="right")))
                u, v = group_links([flat[a:z] for a, z in zip(offsets[at:end], offsets[at + 1 : end + 1])])
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["a", "b"])
                at = end

    return grouped.mapInArrow(run, "a bigint, b bigint")


def _thirds(mask: int) -> list[int]:
    """The mask with each third of the bits that it lacks added."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [0, len(free) // 3, 2 * len(free) // 3, len(free)]
    return [mask | sum(1 << b for b in free[cut[k] : cut[k + 1]]) for k in range(3)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, small: int = SMALL) -> DataFrame:
    """Links (a, b) that connect what is within RADIUS, of distinct fingerprints (fp)."""
    masks = [sum(0xFFFF << 16 * k for k in pair) for pair in combinations(range(4), 2)]
    kinds = {m: k for k, m in enumerate(masks)}
    keyed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for m, k in kinds.items()))).alias("x")).select("fp", "x.kind", "x.part")
    found = []
    for level in range(3):
        keyed = stored(keyed, "keyed")
        sizes = keyed.groupBy("kind", "part").agg(F.count("*").alias("n")).filter("n > 1")
        ready = sizes.filter(F.col("n") <= small) if level < 2 else sizes  # of the last level, none has more than 2^15
        grouped = keyed.join(ready, ["kind", "part"]).groupBy("kind", "part").agg(F.collect_list("fp").alias("fps"))
        found.append(_compared(grouped.select("fps")))
        if level == 2:
            break
        finer = {m: _thirds(m) for m in kinds}
        next_kinds = {t: k for k, t in enumerate(dict.fromkeys(t for ts in finer.values() for t in ts))}
        choice = F.lit(None)
        for m, k in kinds.items():
            options = F.array(*(F.struct(F.lit(next_kinds[t]).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(t))).alias("part")) for t in finer[m]))
            choice = F.when(F.col("kind") == k, options).otherwise(choice)
        hot = keyed.join(sizes.filter(F.col("n") > small).select("kind", "part"), ["kind", "part"])
        keyed = hot.select("fp", F.explode(choice).alias("x")).select("fp", "x.kind", "x.part").distinct()  # two groups may lead to one
        kinds = next_kinds
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


def _rooted(fps: DataFrame, small: int = SMALL) -> DataFrame:
    """(fp, root) of all distinct fingerprints: the least fingerprint that each reaches by links."""
    distinct = fps.select("fp").distinct()
    return distinct.join(components(links(distinct, small)), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    fps = stored(fingerprints(documents), "fingerprints")
    groups = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(links(groups.select("fp"), small))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = stored(rooted.join(least, "root").select("fp", "component_id", "n"), "components")
    return spread_join(fps, known.select("fp", "component_id"), "fp", known.select("fp", "n")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_keys(documents: DataFrame, key: str = "_row_key", digest: str = "_row_hash") -> DataFrame:
    """documents with what tells rows apart: a key of doc_id that is never null, and a hash of the text."""
    return documents.withColumn(key, number_of("doc_id", documents)).withColumn(digest, F.xxhash64("text"))


def first_of_each(documents: DataFrame, rooted: DataFrame) -> DataFrame:
    """The row of least (doc_id, text hash) of each root, with its columns; rooted: (_row_key, _row_hash, no_id, root) of all rows. No doc_id is the greatest; rows alike in doc_id and text are one."""
    key, digest = free_names(documents, "_row_key", "_row_hash")
    first = F.min(F.struct("no_id", "_row_key", "_row_hash")).alias("x")
    kept = rooted.groupBy("root").agg(first).select(F.col("x._row_key").alias(key), F.col("x._row_hash").alias(digest)).distinct()
    # The join and dropDuplicates have one key, so texts are moved once.
    return row_keys(documents, key, digest).join(kept, [key, digest], "left_semi").dropDuplicates([key, digest]).drop(key, digest)


def one_of_each(documents: DataFrame) -> DataFrame:
    """The row of least (doc_id, text hash) of each component of fingerprints, with its columns. Rows count each, also without doc_id or with one that others have too; only rows alike in both are one."""
    keyed = row_keys(documents.select("doc_id", "text")).select(F.struct(F.col("doc_id").isNull().alias("no_id"), "_row_key", "_row_hash").alias("doc_id"), "text")
    fps = stored(fingerprints(keyed), "fingerprints")
    return first_of_each(documents, spread_join(fps, stored(_rooted(fps), "roots"), "fp").select("doc_id.*", "root"))
