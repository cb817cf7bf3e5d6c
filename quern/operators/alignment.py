"""Alignment of two sequences: exact edit distance with the tokens that match, and steps told apart by the headings of a page.

Pairs of short sequences, which are most, are done many at a time, by whole tables whose rows are steps on arrays of all of them.
Of longer ones, edit distances are found in a band around the diagonal that is doubled until it holds the distance, row by row on arrays; the
tokens that match come from halving one side, each half with the band that its own distance needs. So a long pair that hardly
differs costs its length, and memory is never more than some rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SHORT = 128  # tokens of the longer side of pairs that are done by whole tables
CELLS = 1 << 21  # of the tables that are held at once, about
_FAR = np.int64(1 << 40)
_MATCHES = "array<struct<left:int,right:int>>"
_METHOD = "struct<sections:array<struct<title:string,steps:array<string>>>,tips:array<string>>"


def _last_row(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Distances of all of a from each beginning of b, right where they are within the band."""
    n, m = len(a), len(b)
    places = np.arange(m + 1)
    old, new = np.where(places <= band, places, _FAR), np.full(m + 1, _FAR)
    for i in range(1, n + 1):
        low, high = max(0, i - band), min(m, i + band)
        if low > high:
            return np.full(m + 1, _FAR)
        if low == 0:
            new[0] = i
        at = max(low, 1)
        best = np.minimum(old[at - 1 : high] + (b[at - 1 : high] != a[i - 1]), old[at : high + 1] + 1)
        if low == 0 and len(best):
            best[0] = min(best[0], i + 1)
        new[at : high + 1] = np.minimum.accumulate(best - places[at : high + 1]) + places[at : high + 1]
        if low:
            new[low - 1] = _FAR
        if high < m:
            new[high + 1 :] = _FAR
        old, new = new, old
    return old


def distance(a: np.ndarray, b: np.ndarray) -> int:
    band = max(1, abs(len(a) - len(b)))
    while (d := int(_last_row(a, b, band)[-1])) > band:
        band *= 2
    return d


def _matches(a: np.ndarray, b: np.ndarray, i: int, j: int, d: int) -> Iterator[tuple[int, int]]:
    while len(a) and len(b) and a[0] == b[0]:  # an optimal script may keep what both begin with
        yield i, j
        a, b, i, j = a[1:], b[1:], i + 1, j + 1
    if not len(a) or not len(b):
        return
    if len(a) == 1:
        if (hit := np.flatnonzero(b == a[0])).size:
            yield i, j + int(hit[0])
        return
    half = len(a) // 2
    band = d + abs(len(a) - len(b))
    front, back = _last_row(a[:half], b, band), _last_row(a[half:][::-1], b[::-1], band)[::-1]
    cut = int((front + back).argmin())
    yield from _matches(a[:half], b[:cut], i, j, int(front[cut]))
    yield from _matches(a[half:], b[cut:], i + half, j + cut, int(back[cut]))


def aligned(left: list[str], right: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """(distance, places that match): insertions, deletions and replacements cost one each; as many tokens match as one of the least scripts keeps."""
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(t, len(codes)) for t in side], np.int64) for side in (left, right))
    d = distance(a, b)
    return d, list(_matches(a, b, 0, 0, d))


def _padded(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, rest: int) -> np.ndarray:
    """A row for each sequence of a flat array of codes, filled up with `rest`."""
    places = np.arange(size.max(initial=0))
    inside = places < size[:, None]
    out = np.full(inside.shape, rest, np.int32)
    out[inside] = codes[(begin[:, None] + places)[inside]]
    return out


def _by_tables(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distances of pairs, rows of a and b with their lengths, and their matches as (pair, place in a, place in b) in no order."""
    pairs, places = np.arange(len(a)), np.arange(b.shape[1] + 1, dtype=np.int16)
    d = np.empty((a.shape[1] + 1, len(a), len(places)), np.int16)
    d[0] = places
    for i in range(1, len(d)):
        d[i, :, 0] = i
        np.minimum(d[i - 1, :, :-1] + (b != a[:, i - 1 : i]), d[i - 1, :, 1:] + 1, out=d[i, :, 1:], casting="unsafe")
        d[i] = np.minimum.accumulate(d[i] - places, axis=1) + places
    found = []
    p, i, j = pairs, n.astype(np.int64), m.astype(np.int64)
    while True:
        left = (i > 0) & (j > 0)
        p, i, j = p[left], i[left], j[left]
        if not len(p):
            break
        now, across, up = d[i, p, j], d[i - 1, p, j - 1], d[i - 1, p, j]
        same = a[p, i - 1] == b[p, j - 1]  # some least script keeps it
        found.append((p[same], i[same] - 1, j[same] - 1))
        both = same | (across + 1 == now)
        one = ~both & (up + 1 == now)
        i, j = i - (both | one), j - ~one
    return d[n, pairs, m], *(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))


def _aligned_columns(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Distances and matches of two columns of token lists."""
    n, m = (np.array(pc.fill_null(pc.list_value_length(c), 0), np.int64) for c in (left, right))
    tokens = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode(null_encoding="encode")
    codes = np.array(tokens.indices, np.int32)
    at_left, at_right = n.cumsum() - n, n.sum() + m.cumsum() - m
    distances, found = np.zeros(len(n), np.int32), [np.zeros((3, 0), np.int64)]
    longer = np.maximum(n, m)
    order = np.argsort(longer, kind="stable")
    order = order[: np.searchsorted(longer[order], SHORT, side="right")]
    while len(order):
        cells = (longer[order] + 1) ** 2 * np.arange(1, len(order) + 1)  # sizes ascend: the last one's table is the largest
        some, order = np.split(order, [max(1, int(np.searchsorted(cells, CELLS, side="right")))])
        a, b = _padded(codes, at_left[some], n[some], -1), _padded(codes, at_right[some], m[some], -2)
        distances[some], p, i, j = _by_tables(a, b, n[some], m[some])
        found.append(np.stack([some[p], i, j]))
    for k in np.flatnonzero(longer > SHORT):
        a, b = codes[at_left[k] :][: n[k]], codes[at_right[k] :][: m[k]]
        distances[k] = distance(a, b)
        hits = np.array(list(_matches(a, b, 0, 0, int(distances[k]))), np.int64).reshape(-1, 2).T
        found.append(np.concatenate([np.full((1, hits.shape[1]), k), hits]))
    pair, i, j = np.concatenate(found, axis=1)
    by_place = np.lexsort((i, pair))
    kept = pa.StructArray.from_arrays([pa.array(x[by_place], pa.int32()) for x in (i, j)], names=["left", "right"])
    ends = np.bincount(pair, minlength=len(n)).cumsum()
    return distances, pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), kept)


def alignments(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, distance, matches) of two columns of token lists; null lists are empty ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            distances, matches = _aligned_columns(b.column(1), b.column(2))
            yield pa.record_batch([b.column(0), pa.array(distances), matches], names=[key, "distance", "matches"])

    return df.select(key, left, right).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, distance int, matches {_MATCHES}")


def _places(steps: list[str], group: list[str], begin: int, most: int) -> list[int] | None:
    """Where a group's anchors are among the steps, in order, from a place on; adjacent anchors may be one step together."""
    found, k = [], 0
    while k < len(group):
        for n in range(1, min(most, len(group) - k) + 1):
            wanted = " ".join(group[k : k + n])
            if wanted in steps[begin:]:
                at = steps.index(wanted, begin)
                break
        else:
            return None
        found.append(at)
        begin, k = at + 1, k + n
    return found


def method_groups(steps: list[str], groups: list[tuple[str, bool, list[str]]], most: int = 4) -> tuple[list[tuple[str, list[str]]], list[str]] | None:
    """(sections, tips) of steps by groups (title, whether tips, anchors): a group has the steps up to its last anchor, with those between that have none, and the last group has the rest. Steps before a page's only tips are a section without title. None where an anchor isn't found in order, or a group would have no step."""
    sections: list[tuple[str, list[str]]] = []
    tips: list[str] = []
    at = 0
    for k, (title, tip, anchors) in enumerate(groups):
        anchors = [x for x in anchors if x]
        places = _places(steps, anchors, at, most) if anchors else None
        if not places:
            return None
        if k == 0 and tip and places[0] > 0:
            sections.append(("", steps[: places[0]]))
            at = places[0]
        end = len(steps) if k + 1 == len(groups) else places[-1] + 1
        own, at = steps[at:end], end
        if not own:
            return None
        if tip:
            tips += own
        else:
            sections.append((title, own))
    return (sections, tips) if at == len(steps) else None


def grouped_methods(df: DataFrame, key: str, steps: str, groups: str) -> DataFrame:
    """(key, method) of columns of steps and of groups (title, tip, steps); a method that doesn't agree with its page is null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("sections", pa.list_(pa.struct([("title", pa.string()), ("steps", pa.list_(pa.string()))]))), ("tips", pa.list_(pa.string()))])
        for b in batches:
            rows = []
            for own, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = method_groups(own or [], [(g["title"], bool(g["tip"]), g["steps"] or []) for g in page or []])
                rows.append(found and {"sections": [{"title": t, "steps": s} for t, s in found[0]], "tips": found[1]})
            yield pa.record_batch([b.column(0), pa.array(rows, kind)], names=[key, "method"])

    return df.select(key, steps, groups).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, method {_METHOD}")
