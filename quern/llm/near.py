"""SimHash near-dedup by similarity: texts whose word shingles have a Jaccard similarity of LEAST or more.

A text is the set of hashes of its SHINGLE words in a row (lower-cased; a shorter text is one shingle); texts of one set
are one node. Its SimHash has COMPARED bits and as many more as bands need. For two sets of similarity s a bit differs
with odds of arccos(2 s / (1 + s)) / pi, 0.15 at 0.8; unrelated ones differ in half their bits.

1. Bands: the bits are cut into bands, and nodes that agree on a whole band meet. Bands are as wide as it takes for about
   64 unrelated nodes to share one, and as many as it takes for a pair of similarity LEAST to share one with odds of RECALL.
2. Those that meet are compared by bits stored vertically (simhash.near_lanes). The radius holds a pair of similarity LEAST
   with odds of 0.999. A node that is near FEW others at most makes a pair with each. Where more are near each other, the
   radius grows, and what a smaller one has connected is not compared again, so that a group hands on a forest of its closest
   pairs, never all pairs.
3. Pairs are confirmed by the similarity of their whole sets, and components are taken over those.
4. A forest says nothing of the pairs that it left out, and some of its own may not be confirmed. So where nodes have many near
   ones, all pairs within the radius whose nodes aren't yet in one component are confirmed too, and components are taken over both.
   That is done where the nodes of a place are gathered with their sets: rows are sent on for nodes and links that connect
   components, never for all pairs.

What a band sends is packed by bucket; the number of buckets follows the number of documents, and a bucket that is far larger
than others has its entries dealt out before they are gathered. A group of more than GROUP nodes is cut into blocks
instead (see _hot_edges), so no task holds more than about two blocks.

Defined results: null texts are empty; texts without words are one node; very long texts are sketched in slices; rows count
each, see simhash.first_of_each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, spread_join, stored
from .components import components
from .simhash import bit_planes, first_of_each, near_lanes, row_keys
from .substring import mixed, rolling

SHINGLE = 5
LEAST = 0.8
RECALL = 0.995
COMPARED = 256
GROUP = 4096
FEW = 8  # near ones of a node that all become pairs
ITEMS = 1 << 14
SET_BYTES = 8 << 20  # of sets that are confirmed with as many others at a time, about
BUCKET = 1 << 17  # entries of bands in a bucket, about
_WORDS = COMPARED // 64
_GOLDEN, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FP = ", ".join(f"f{k} bigint" for k in range(_WORDS))


def differing(least: float) -> float:
    """Odds that a bit of two sets of that similarity differs."""
    return acos(2 * least / (1 + least)) / pi


def band_shape(n: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """(bits in a band, bands) for n nodes."""
    width = min(31, max(8, ceil(log2(max(n, 2))) - 6))
    return width, ceil(log(1 - recall) / log(1 - (1 - differing(least)) ** width))


def radius(least: float = LEAST) -> int:
    p = differing(least)
    return ceil(COMPARED * p + 3.1 * sqrt(COMPARED * p * (1 - p)))


def shingles(text: str | None, hashes: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingle hashes, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(mixed(rolling(hashes.array(words), min(shingle, len(words)))))


def simhash_bits(found: np.ndarray, bits: int) -> np.ndarray:
    """The set's SimHash, a multiple of 64 bits of at least that many, as 0 and 1."""
    seeds = np.arange(-(-bits // 64), dtype=np.uint64) * _GOLDEN
    ones = np.zeros(64 * len(seeds), np.int64)
    for at in range(0, len(found), 4096):
        z = found[at : at + 4096, None] + seeds
        z = (z ^ (z >> np.uint64(30))) * _A
        z = (z ^ (z >> np.uint64(27))) * _B
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return (2 * ones > len(found)).astype(np.uint8)


def sketches(keyed: DataFrame, width: int, bands: int, shingle: int = SHINGLE) -> DataFrame:
    """(no_id, _row_key, _row_hash, node, fp, bands) of rows (no_id, _row_key, _row_hash, text): fp of COMPARED bits, bands a number each (none without words)."""
    bits = max(COMPARED, width * bands)
    weight = 1 << np.arange(width, dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                node, fp, keys = [], [], []
                for t in b.column(3).to_pylist():
                    found = shingles(t, hashes, shingle)
                    node.append(xxhash.xxh64_intdigest(found.tobytes()))
                    s = simhash_bits(found, bits)
                    fp.append(np.packbits(s[:COMPARED], bitorder="little").tobytes())
                    keys.append((s[: width * bands].reshape(bands, width) @ weight).astype(np.int32).tobytes() if len(found) else b"")
                columns = [*b.columns[:3], pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(fp, pa.binary()), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["no_id", "_row_key", "_row_hash", "node", "fp", "bands"])

    return keyed.mapInArrow(run, "no_id boolean, _row_key bigint, _row_hash bigint, node bigint, fp binary, bands binary")


def forest(groups: list[np.ndarray], radii: list[int], items: int = ITEMS) -> tuple[np.ndarray, np.ndarray]:
    """The edges of forest_and_crowd."""
    return forest_and_crowd(groups, radii, items)[:2]


def forest_and_crowd(groups: list[np.ndarray], radii: list[int], items: int = ITEMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j) between members, numbered through all groups, that connect in each group what the last radius connects: those of nodes with a few near ones, and a forest, the closest first; and the crowd, members with more near ones: each near pair of others is an edge. A group: (members, words) of fingerprints."""
    size = np.array([len(g) for g in groups], np.int64)
    words = -(-size // 64)
    first_word = np.r_[0, words.cumsum()]
    first_member = np.r_[0, size.cumsum()]
    place = np.concatenate([64 * w + np.arange(n) for w, n in zip(first_word, size)])  # of members among lanes
    member_of = np.full(64 * int(first_word[-1]), -1, np.int64)
    member_of[place] = np.arange(len(place))
    lanes = np.zeros((len(member_of), groups[0].shape[1]), np.uint64)
    lanes[place] = np.concatenate(groups)
    planes = bit_planes(lanes)
    real = np.packbits((member_of >= 0).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    label = np.where(member_of >= 0, np.arange(len(member_of)), -1)
    group = np.repeat(np.arange(len(groups)), size)
    edges: list[tuple[int, int]] = []

    def items_of(some_members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(members, words): each of the members with each word of its group, about `items` at a time."""
        span = words[group[some_members]]
        ends = span.cumsum()
        at = 0
        while at < len(some_members):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + items, side="right")))
            nth = np.arange(ends[end - 1] - before) - np.repeat(ends[at:end] - span[at:end] - before, span[at:end])
            some = np.repeat(some_members[at:end], span[at:end])
            yield some, first_word[group[some]] + nth
            at = end

    def near_items(some: np.ndarray, word: np.ndarray, r: int) -> np.ndarray:
        own = place[some]
        near = near_lanes(planes, lanes[own], word, r) & real[word]
        same = own // 64 == word
        near[same] &= ~(np.uint64(1) << (own[same] % 64).astype(np.uint64))
        return near

    # Most have nothing near: they are left out after one comparison at the last radius. What is near a few only is an edge to each.
    has, crowd = np.zeros((2, len(place)), bool)
    close = [np.zeros(0, np.int64)]  # pairs, a number each
    for some, word in items_of(np.arange(len(place))):
        near = near_items(some, word, radii[-1])
        hits = np.flatnonzero(near)
        if not len(hits):
            continue
        nth = some[hits] - some[0]
        few = np.bincount(nth, np.bitwise_count(near[hits]))[nth] <= FEW  # of all words of the group
        has[some[hits]] = True
        crowd[some[hits[~few]]] = True
        hits = hits[few]
        i, bit = np.nonzero(np.unpackbits(near[hits].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = some[hits[i]], member_of[64 * word[hits[i]] + bit]
        close.append(np.minimum(a, b) * len(place) + np.maximum(a, b))
    close = np.unique(np.concatenate(close))
    edges += zip((close // len(place)).tolist(), (close % len(place)).tolist())
    for r in radii if has.any() else []:
        for some, word in items_of(np.flatnonzero(has)):
            low = np.where(label < 0, len(label), label).reshape(-1, 64).min(1)
            high = label.reshape(-1, 64).max(1)
            mine = label[place[some]]
            open_ = ~((low[word] == mine) & (high[word] == mine))  # else all of the word is connected already
            some, word = some[open_], word[open_]
            if not len(word):
                continue
            near = near_items(some, word, r)
            for i in np.flatnonzero(near):
                hit = 64 * word[i] + np.flatnonzero(np.unpackbits(near[i : i + 1].view(np.uint8), bitorder="little"))
                mine = label[place[some[i]]]
                kinds, which = np.unique(label[hit], return_index=True)
                other = kinds != mine
                if other.any():
                    edges += [(some[i], member_of[hit[k]]) for k in which[other]]
                    g = group[some[i]]
                    part = label[64 * first_word[g] : 64 * first_word[g + 1]]
                    part[np.isin(part, np.r_[kinds, mine])] = min(kinds[0], mine)
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    return a, b, np.flatnonzero(crowd)


def _edges(node: np.ndarray, fp: np.ndarray, groups: list[np.ndarray], radii: list[int], most: int = 1 << 11) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(edges, places of the crowd) of groups (places of their members), as many groups at a time as fill about `most` words of each plane."""
    ends = np.cumsum([-(-len(g) // 64) for g in groups])
    at = 0
    while at < len(groups):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        some = np.concatenate(groups[at:end])
        i, j, crowd = forest_and_crowd([fp[g] for g in groups[at:end]], radii)
        yield pa.record_batch([pa.array(node[some[i]]), pa.array(node[some[j]])], names=["a", "b"]), some[crowd]
        at = end


def _radii(least: float) -> list[int]:
    r = radius(least)
    return sorted({r * k // 4 for k in (1, 2, 3, 4)})


def candidates(nodes: DataFrame, width: int, bands: int, n: int, least: float = LEAST, group: int = GROUP, bucket_entries: int = BUCKET) -> DataFrame:
    """The pairs of candidates_and_crowds."""
    return candidates_and_crowds(nodes, width, bands, n, least, group, bucket_entries)[0]


def candidates_and_crowds(nodes: DataFrame, width: int, bands: int, n: int, least: float = LEAST, group: int = GROUP, bucket_entries: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """From distinct rows (node, fp, bands): (a, b), pairs of nodes to be confirmed; and (place, a, fp), nodes of each place of which pairs within the radius may be left out."""
    buckets = max(1, ceil(n * bands / bucket_entries / bands)) * bands  # as many for each band
    each = buckets // bands
    radii = _radii(least)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 14):
                b = whole.slice(at, 1 << 14)
                node = np.array(b.column(0))
                fp = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, _WORDS)
                keys = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int32).reshape(-1, bands)
                out = []
                for k in range(bands):
                    bucket = mixed(keys[:, k].astype(np.uint64)) % np.uint64(each)
                    order = np.argsort(bucket, kind="stable")
                    cut = np.searchsorted(bucket[order], np.arange(each + 1, dtype=np.uint64))
                    for j in np.flatnonzero(np.diff(cut)):
                        some = order[cut[j] : cut[j + 1]]
                        out.append((k * each + int(j), keys[some, k].tobytes(), node[some].tobytes(), fp[some].tobytes()))
                yield pa.record_batch([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[x] for r in out], pa.binary()) for x in (1, 2, 3))], names=["bucket", "keys", "nodes", "fps"])

    def unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, node, fp = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("keys", np.int32), ("nodes", np.int64), ("fps", np.uint64)))
        return key, node, fp.reshape(-1, _WORDS)

    def meet(t: pa.Table) -> pa.Table:
        key, node, fp = unpacked(t)
        order = np.lexsort((node, key))  # the same order whatever the partitions
        parts = np.split(order, np.flatnonzero(np.diff(key[order])) + 1)
        found = list(_edges(node, fp, [p for p in parts if 1 < len(p) <= group], radii))
        edges = pa.Table.from_batches([pa.record_batch([pa.array([], pa.int64())] * 2, names=["a", "b"]), *(e for e, _ in found)])
        none = np.zeros(0, np.int64)
        hot = np.concatenate([none, *(p for p in parts if len(p) > group)]).astype(np.int64)
        left = np.concatenate([hot, *(c for _, c in found)])
        band = t.column("bucket")[0].as_py() // each
        columns = {"place": pa.array(band << 32 | key[left].astype(np.int64)), "a": pa.array(node[left]), "fp": pa.array([f.tobytes() for f in fp[left]], pa.binary()), "hot": pa.array(np.arange(len(left)) < len(hot))}
        return pa.concat_tables([edges, pa.table(columns)], promote_options="default").select(["place", "a", "b", "fp", "hot"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                bucket = b.column("bucket")[k].as_py()
                key, node, fp = unpacked(pa.Table.from_batches([b.slice(k, 1)]))
                columns = [np.full(len(key), bucket, np.int32), np.int64(bucket // each) << 32 | key.astype(np.int64), node]
                yield pa.record_batch([*map(pa.array, columns), pa.array([x.tobytes() for x in key], pa.binary()), pa.array([x.tobytes() for x in node], pa.binary()), pa.array([f.tobytes() for f in fp], pa.binary())], names=["bucket", "place", "a", "keys", "nodes", "fps"])

    met_schema = "place bigint, a bigint, b bigint, fp binary, hot boolean"
    packed = nodes.filter(F.octet_length("bands") > 0).select("node", "fp", "bands").mapInArrow(send, "bucket int, keys binary, nodes binary, fps binary")
    sizes = stored(packed.groupBy("bucket").agg(F.sum(F.octet_length("keys") / 4).cast("long").alias("n")), "buckets")
    big = sizes.filter(F.col("n") > 4 * bucket_entries)
    if big.limit(1).count():
        # A band that very many have: the entries of its bucket are told apart before any of them are gathered.
        packed = stored(packed, "packed")
        spread = stored(spread_join(packed, big.select("bucket"), "bucket", sizes).mapInArrow(rows, "bucket int, place bigint, a bigint, keys binary, nodes binary, fps binary"), "spread")
        counts = stored(spread.groupBy("place").agg(F.count("*").alias("n")), "places")
        hot = counts.filter(F.col("n") > group)
        early = spread_join(spread, hot.select("place"), "place", counts).select("place", "a", F.col("fps").alias("fp"))
        rest = spread_join(spread, counts.filter(F.col("n") <= group).select("place"), "place", counts).select("bucket", "keys", "nodes", "fps")
        small = spread_join(packed, sizes.filter(F.col("n") <= 4 * bucket_entries).select("bucket"), "bucket", sizes).select("bucket", "keys", "nodes", "fps")
        met = stored(small.unionAll(rest).groupBy("bucket").applyInArrow(meet, met_schema), "met")
        early = stored(early, "early")
        hot, crowds = (met.filter(c).select("place", "a", "fp").unionAll(early) for c in ("hot", "b IS NULL"))
    else:
        met = stored(packed.groupBy("bucket").applyInArrow(meet, met_schema), "met")
        hot, crowds = (met.filter(c).select("place", "a", "fp") for c in ("hot", "b IS NULL"))
    both, hot = met.filter("b IS NOT NULL").select("a", "b"), stored(hot, "hot")
    if hot.limit(1).count():
        both = both.unionAll(_hot_edges(hot, radii, group))
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), crowds


def _facing(crowds: DataFrame, roots: DataFrame, block: int) -> DataFrame | None:
    """(place, part, block, a, fp, root, own): nodes of places of crowds (place, a, fp) that span components of (node, root), dealt so that each pair of two components meets, one node its own; None where each place is in one component.

    Nodes of a place's largest component needn't be compared with each other: blocks of all others are compared with blocks of the whole place.
    """
    named = crowds.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").select("place", "a", "fp", F.coalesce("root", "a").alias("root"))
    named = stored(named, "named")
    sizes = stored(named.groupBy("place", "root").agg(F.count("*").alias("n")), "sizes")
    places = sizes.groupBy("place").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.max("n").alias("most")).filter("roots > 1")
    parts = lambda n: F.greatest(F.ceil(n / block), F.lit(1))
    places = stored(places.select("place", "main", parts(F.col("n")).alias("blocks"), parts(F.col("n") - F.col("most")).alias("parts")), "crowds")
    if not places.limit(1).count():
        return None
    within = spread_join(named, places, "place", sizes.groupBy("place").agg(F.sum("n").alias("n")))
    others = within.filter(F.col("root") != F.col("main")).withColumn("part", _dealt("parts")).withColumn("block", _each("blocks")).withColumn("own", F.lit(True))
    whole = within.withColumn("block", _dealt("blocks")).withColumn("part", _each("parts")).withColumn("own", F.lit(False))
    columns = ["place", "part", "block", "a", "fp", "root", "own"]
    return others.select(columns).unionAll(whole.select(columns))


def _dealt(n: str) -> Column:
    return F.pmod(F.xxhash64("a"), n)


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _apart(t: pa.Table, r: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(own ones, the whole place, which of these each own one is near without being of its component), by places in a table of _facing, some own ones at a time."""
    root, own = np.array(t.column("root")), np.array(t.column("own"))
    fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, _WORDS)
    mine, whole = np.flatnonzero(own), np.flatnonzero(~own)
    for at in range(0, len(mine), 64):
        some = mine[at : at + 64]
        bits = sum(np.bitwise_count(fp[some, None, k] ^ fp[None, whole, k]).astype(np.uint16) for k in range(_WORDS))
        yield some, whole, (bits <= r) & (root[some, None] != root[None, whole])


def left_out(crowds: DataFrame, roots: DataFrame, r: int, block: int = 2048) -> DataFrame | None:
    """(a, b): all pairs of nodes of one place of crowds (place, a, fp) that differ in at most r bits and whose components, of (node, root), differ; None where each place is in one component. They may be as many as a group's square; links_left_out confirms them without handing them on."""

    def pair(t: pa.Table) -> pa.Table:
        node = np.array(t.column("a"))
        found = [np.zeros((2, 0), np.int64)]
        for some, whole, near in _apart(t, r):
            i, j = np.nonzero(near)
            found.append(np.stack([node[some[i]], node[whole[j]]]))
        a, b = np.concatenate(found, axis=1)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    facing = _facing(crowds, roots, block)
    return None if facing is None else facing.groupBy("place", "part", "block").applyInArrow(pair, "a bigint, b bigint").distinct()


def nodes_left_out(crowds: DataFrame, roots: DataFrame, r: int, block: int = 1 << 14) -> DataFrame | None:
    """The rows of _facing that are of a pair of left_out."""

    def take(t: pa.Table) -> pa.Table:
        takes = np.zeros(t.num_rows, bool)
        for some, whole, near in _apart(t, r):
            takes[some] = near.any(axis=1)
            takes[whole] |= near.any(axis=0)
        return t.filter(pa.array(takes))

    facing = _facing(crowds, roots, block)
    return None if facing is None else facing.groupBy("place", "part", "block").applyInArrow(take, facing.schema)


def links_left_out(facing: DataFrame, sets: DataFrame, r: int, least: float = LEAST, set_bytes: int = SET_BYTES) -> DataFrame:
    """(a, b): links that connect what all similar pairs of left_out would, from its nodes (facing) and the sets (node, found) of these. A link is of two nodes that those before it in a task haven't connected, so there are less than nodes."""

    def similar(t: pa.Table) -> pa.Table:
        node, label = np.array(t.column("a")), np.array(t.column("root")).copy()
        size = np.array(pc.binary_length(t.column("found")), np.int64) // 8
        begin = np.r_[0, size.cumsum()]
        codes = np.unique(np.frombuffer(b"".join(t.column("found").to_pylist()), np.uint64), return_inverse=True)[1].astype(np.int32)
        mark = np.zeros(len(codes), bool)
        out = []
        for some, whole, near in _apart(t, r):
            n, m = size[some, None], size[None, whole]
            near &= np.minimum(n, m) >= least * np.maximum(n, m)
            for k, x in enumerate(some):
                with_ = whole[near[k] & (label[whole] != label[x])]
                if not len(with_):
                    continue
                held = codes[begin[x] : begin[x + 1]]
                mark[held] = True
                both = np.add.reduceat(mark[np.concatenate([codes[begin[y] : begin[y + 1]] for y in with_])], np.r_[0, size[with_].cumsum()[:-1]], dtype=np.int64)
                mark[held] = False
                with_ = with_[both >= least * (size[x] + size[with_] - both)]
                joined, first = np.unique(label[with_], return_index=True)
                out += [(node[x], node[y]) for y in with_[first]]
                if len(joined):
                    label[np.isin(label, joined)] = label[x]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    key = ["place", "part", "block"]
    facing = stored(facing.join(sets.select(F.col("node").alias("a"), F.octet_length("found").cast("long").alias("bytes")), "a"), "facing")
    cuts = lambda own: F.greatest(F.ceil(F.coalesce(F.sum(F.when(F.col("own") == own, F.col("bytes"))), F.lit(0)) / set_bytes), F.lit(1))
    cut = facing.join(facing.groupBy(key).agg(cuts(True).alias("parts"), cuts(False).alias("blocks")), key)
    others = cut.filter("own").withColumn("x", _dealt("parts")).withColumn("y", _each("blocks"))
    whole = cut.filter("not own").withColumn("y", _dealt("blocks")).withColumn("x", _each("parts"))
    columns = [*key, "x", "y", "a", "fp", "root", "own"]
    held = others.select(columns).unionAll(whole.select(columns)).join(sets.select(F.col("node").alias("a"), "found"), "a")
    return held.groupBy(*key, "x", "y").applyInArrow(similar, "a bigint, b bigint").distinct()


def _parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's connected part."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _hot_edges(hot: DataFrame, radii: list[int], group: int) -> DataFrame:
    """(a, b) that connect what is near among the nodes (place, a, fp) of each place of more than `group`.

    Blocks of a place are connected each, and then the largest connected parts of the blocks with each other. What these join to
    is one part, mostly nearly all of the place, and its members needn't be compared again; each other node is compared
    with all. So no near pair is left out, and where a place is a group of copies, its cost is that of its blocks.
    """

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(np.array(t.column("a")), kind="stable")
        return np.array(t.column("a"))[order], np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, _WORDS)[order]

    kind = [("place", pa.int64()), ("block", pa.int64()), ("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("fp", pa.binary()), ("n", pa.int64())]
    names = ", ".join(f"{n} {'bigint' if t == pa.int64() else t}" for n, t in kind)

    def table(place: int, block: int | None, rows: list[tuple]) -> pa.Table:
        """rows: (kind, a, b, fp, n)."""
        columns = [[place] * len(rows), [block] * len(rows), *([r[k] for r in rows] for k in range(5))]
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kind)], names=[n for n, _ in kind])

    def alone(key: tuple, t: pa.Table) -> pa.Table:
        node, fp = arrays(t)
        i, j = forest([fp], radii) if len(node) > 1 else (np.zeros(0, np.int64),) * 2
        label = _parts(len(node), i, j)
        main = np.bincount(label).argmax()
        out = [("edge", int(node[x]), int(node[y]), None, None) for x, y in zip(i, j)]
        out += [("other", int(node[x]), None, fp[x].tobytes(), None) for x in np.flatnonzero(label != main)]
        out.append(("main", int(node[main]), None, fp[main].tobytes(), int((label == main).sum())))
        return table(key[0].as_py(), key[1].as_py(), out)

    def together(key: tuple, t: pa.Table) -> pa.Table:
        fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, _WORDS)
        node, n, block = (np.array(t.column(c)) for c in ("a", "n", "block"))
        i, j = forest([fp], radii) if len(node) > 1 else (np.zeros(0, np.int64),) * 2
        label = _parts(len(node), i, j)
        most = np.bincount(label, weights=n).argmax()
        edges = [("edge", int(node[x]), int(node[y]), None, None) for x, y in zip(i, j)]
        far = [("far", None, None, None, int(x)) for x in block[label != most]]  # blocks whose largest part isn't of that one
        return table(key[0].as_py(), None, edges + far)

    def pair(t: pa.Table) -> pa.Table:
        node, fp = arrays(t)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        return pa.Table.from_batches([e for e, _ in _edges(node[first], fp[first], [np.arange(len(first))], radii)])

    counts = stored(hot.groupBy("place").agg(F.count("*").alias("n")), "places")
    blocks = counts.select("place", F.ceil(F.col("n") / group).alias("blocks"))
    dealt = stored(spread_join(hot, blocks, "place", counts).withColumn("block", F.pmod(F.xxhash64("a"), "blocks")), "dealt")
    single = stored(dealt.select("place", "block", "a", "fp").groupBy("place", "block").applyInArrow(alone, names), "single")
    mains = stored(single.filter("kind = 'main'").select("place", "block", "a", "fp", "n").groupBy("place").applyInArrow(together, names), "mains")
    edges = single.filter("kind = 'edge'").select("a", "b").unionAll(mains.filter("kind = 'edge'").select("a", "b"))
    far = mains.filter("kind = 'far'").select("place", F.col("n").alias("block"))
    rest = dealt.join(far, ["place", "block"], "left_semi").select("place", "blocks", "a", "fp")
    others = single.filter("kind = 'other'").join(far, ["place", "block"], "left_anti").select("place", "a", "fp")
    rest = stored(rest.unionByName(spread_join(stored(others, "others"), blocks, "place").select("place", "blocks", "a", "fp")), "rest")
    left = rest.groupBy("place").agg(F.ceil(F.count("*") / group).alias("parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    some = spread_join(rest, left, "place").withColumn("part", F.pmod(F.xxhash64("a"), "parts")).withColumn("block", each("blocks"))
    whole = spread_join(dealt, left, "place", counts).withColumn("part", each("parts"))
    columns = ["place", "part", "block", "a", "fp"]
    return edges.unionAll(some.select(columns).unionAll(whole.select(columns)).groupBy("place", "part", "block").applyInArrow(pair, "a bigint, b bigint"))


def confirmed(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Those of distinct pairs (a, b) whose sets, of (node, found), are similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            held = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                u, v = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                if min(len(u), len(v)) >= least * max(len(u), len(v)):
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    held[i] = both >= least * (len(u) + len(v) - both)
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(held))

    one, other = (sets.select(F.col("node").alias(n), F.col("found").alias(f)) for n, f in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _sets(documents: DataFrame, rows: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(node, found) of the nodes of pairs, from one row of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield pa.record_batch([b.column(0), pa.array([shingles(t, hashes, shingle).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "found"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = rows.groupBy("node").agg(F.min(F.struct("_row_key", "_row_hash")).alias("x")).join(wanted, "node").select("node", "x.*")
    both = ["_row_key", "_row_hash"]
    texts = row_keys(documents.select("doc_id", "text")).join(one, both).select("node", "text")
    return texts.mapInArrow(run, "node bigint, found binary").dropDuplicates(["node"])


def similar_roots(documents: DataFrame, shingle: int = SHINGLE, least: float = LEAST, group: int = GROUP) -> DataFrame:
    """(no_id, _row_key, _row_hash, root) of every row of documents: the least node that it reaches by links."""
    n = documents.count()
    width, bands = band_shape(n, least)
    keyed = row_keys(documents.select("doc_id", "text")).select(F.col("doc_id").isNull().alias("no_id"), "_row_key", "_row_hash", "text")
    rows = stored(sketches(keyed, width, bands, shingle), "sketches")
    nodes = rows.select("node", "fp", "bands").dropDuplicates(["node"])
    pairs, crowds = candidates_and_crowds(nodes, width, bands, n, least, group)
    pairs = stored(pairs, "candidates")
    sets = stored(_sets(documents, rows, pairs, shingle), "sets")
    links = stored(confirmed(pairs, sets, least), "links")
    roots = components(links)
    if (facing := nodes_left_out(crowds, stored(roots, "first"), radius(least))) is not None:
        facing = stored(facing, "left_out")
        new = facing.select("a", F.col("a").alias("b")).distinct().join(sets.select(F.col("node").alias("a")), "a", "left_anti")
        if new.limit(1).count():
            sets = sets.unionAll(stored(_sets(documents, rows, new, shingle), "sets"))
        roots = components(links.unionAll(links_left_out(facing, sets, radius(least), least)))
    known = rows.groupBy("node").agg(F.count("*").alias("n")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n")
    known = stored(known, "roots")
    return spread_join(rows.select("no_id", "_row_key", "_row_hash", "node"), known.select("node", "root"), "node", known.select("node", "n")).select("no_id", "_row_key", "_row_hash", "root")


def one_of_each_similar(documents: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The row of least (doc_id, text hash) of each group of texts linked by a similarity of `least` or more, with its columns."""
    return first_of_each(documents, similar_roots(documents, shingle, least))
