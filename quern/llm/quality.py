"""Document quality by Bradley-Terry ranking.

A document's strength is linear in features of its text alone: shares of kinds of bytes, words, repeats and lines, and
hashed shares of its words and of its runs of three bytes. It is learned from preference pairs (a document of
label 1 is preferred to one of label 0) by logistic loss on the difference of the two's features. The threshold is the
quantile of the strengths of the learning rows at their share of label 0; the score is a logistic function of the
strength that is CUTOFF there.

Learning uses at most SAMPLE_ROWS labelled rows (those of least hash of doc_id, so the same ones whatever the
partitions) and PAIRS pairs; scoring runs over all rows, with nothing but the fitted weights sent to the executors.

Defined results: a null text is an empty one, and an empty or blank text has the score of its features (all zero); very
long texts count whole, in slices; rows with a null label don't count; without both labels every score is 0.5; repeated
rows are scored each, and equal texts have equal scores, whatever rows stand beside them; of strengths that tie with the
threshold all are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names

CUTOFF = 0.3
FOLDS = 5
SAMPLE_ROWS = 20_000
PAIRS = 60_000
RIDGE, NGRAM_RIDGE = 1e-3, 2e-2
NGRAMS = 128  # hashed shares of words, and as many of runs of three bytes
PLAIN = 2 * 17

_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~(_LOWER | _UPPER | _DIGIT)
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True
_HIGH = np.arange(256) >= 128


def text_features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes, words, repeats and lines, each also as its square root, so that a little of a thing counts."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(PLAIN + 2 * NGRAMS)
    b = np.frombuffer(raw, np.uint8)
    counts = np.bincount(b, minlength=256)
    solid = max(1, int(counts[~_SPACE].sum()))
    letters = max(1, int(counts[_LOWER | _UPPER].sum()))
    is_letter = (_LOWER | _UPPER | _HIGH)[b]
    marks = (_MARK & ~_STOP)[b]
    doubled = int(np.count_nonzero(marks[1:] & marks[:-1]))
    upper_run = int(np.count_nonzero(_UPPER[b[1:]] & _UPPER[b[:-1]]))
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    repeats = sum(a == z for a, z in zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = counts / solid
    lone = sum(len(w) == 1 and not w.isalnum() for w in words)
    f = np.array(
        [
            counts[_UPPER].sum() / letters,
            upper_run / letters,
            (counts[_MARK & ~_STOP].sum()) / solid,
            doubled / solid,
            share[_STOP].sum(),
            share[_DIGIT].sum(),
            share[ord("|")] + share[ord("<")] + share[ord(">")],
            share[ord("!")],
            share[ord("#")] + share[ord("$")] + share[ord("%")] + share[ord("&")] + share[ord("*")],
            repeats / n,
            max(distinct.values()) / n if n > 20 else 0.0,
            1 - len(distinct) / n,
            lone / n,
            1 - len(set(lines)) / max(1, len(lines)),
            np.count_nonzero(is_letter[1:] & ~is_letter[:-1]) / n / 4,
            solid / n / 20,
            1 / (1 + n),
        ]
    )
    by_word = np.bincount(np.fromiter(map(zlib.crc32, map(bytes.lower, words)), np.uint32, n) % NGRAMS, minlength=NGRAMS) / n
    return np.concatenate([f, np.sqrt(np.maximum(f, 0)), np.sqrt(by_word), np.sqrt(_runs_of_three(raw.lower()))])


def _runs_of_three(raw: bytes, most: int = 1 << 20) -> np.ndarray:
    """Hashed shares of all runs of three bytes."""
    out = np.zeros(NGRAMS)
    for at in range(0, max(1, len(raw) - 2), most):
        b = np.frombuffer(raw[at : at + most + 2], np.uint8).astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) if len(b) > 2 else b[:0]
        out += np.bincount(h >> np.uint32(25), minlength=NGRAMS)
    return out / max(1, len(raw) - 2)


@dataclass(frozen=True)
class Ranking:
    """weights on features scaled by mean and spread; score = logistic(scale * (strength - threshold) + logit(CUTOFF))."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        """Each row is summed by itself, so that a strength doesn't depend on the rows beside it."""
        return (np.ascontiguousarray((x - self.mean) / self.spread) * self.weights).sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.scale * (self.strengths(x) - self.threshold) + math.log(CUTOFF / (1 - CUTOFF)), -40, 40)
        return np.array([1 / (1 + math.exp(-v)) for v in z.tolist()])


def minimised(z: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: np.ndarray, block: int = 8192) -> np.ndarray:
    """The weights of least mean logistic loss over pairs of rows of z, with half the ridge on their squares."""
    w = np.zeros(z.shape[1])
    for _ in range(25):
        gradient, curvature = ridge * w, np.diag(ridge)
        for at in range(0, len(better), block):
            d = z[better[at : at + block]] - z[worse[at : at + block]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # of the less preferred
            gradient -= (d * p[:, None]).sum(0) / len(better)
            curvature += (d * (p * (1 - p))[:, None]).T @ d / len(better)
        step = np.linalg.solve(curvature, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranking | None:
    """Newton's method on the pairs' logistic loss with a ridge; None without both labels."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / spread
    draw = np.random.default_rng(seed)
    ridge = np.where(np.arange(x.shape[1]) < PLAIN, RIDGE, NGRAM_RIDGE)
    w = minimised(z, draw.choice(good, pairs), draw.choice(bad, pairs), ridge)
    s = z @ w
    threshold = float(np.quantile(s, len(bad) / (len(bad) + len(good)), method="midpoint"))
    return Ranking(mean, spread, w, threshold, float(2 / max(1e-6, np.median(np.abs(s - threshold)))))


def _with_features(df: DataFrame) -> DataFrame:
    """(label, features) of rows (text, label)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(1), pa.array([text_features(t).tolist() for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], names=["label", "features"])

    return df.select("text", "label").mapInArrow(run, "label int, features array<double>")


def fold(key: str = "doc_id", folds: int = FOLDS):
    return F.crc32(F.col(key).cast("string")) % folds


def _bounded(rated: DataFrame, rows: int) -> DataFrame:
    """At most `rows` of rows (doc_id, text, hash, label), the least by hash, and one of those alike in (doc_id, hash, label)."""
    keys = ["doc_id", "hash", "label"]
    chosen = rated.select(*keys).distinct().orderBy(F.xxhash64("doc_id", "hash"), *keys).limit(rows)
    return rated.join(F.broadcast(chosen), keys, "left_semi").dropDuplicates(keys)


def learn(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Ranking | None:
    """Fits on labelled rows outside the held-out fold, at most `rows` labels and as many of the rows that they match."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
    sample = known.select("doc_id", F.col("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    rated = documents.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(sample), "doc_id")
    got = _with_features(_bounded(rated, rows)).toArrow()
    if not got.num_rows:
        return None
    x = got.column("features").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    label = np.array(got.column("label"))
    order = np.lexsort((*x.T[::-1], label))  # the same order whatever the partitions
    return fit(x[order], label[order])


def scored(documents: DataFrame, ranking: Ranking | None, name: str) -> DataFrame:
    """documents with their scores under a name."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    at = documents.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t) for t in b.column(at).to_pylist()]).reshape(b.num_rows, -1)
            score = np.full(b.num_rows, 0.5) if ranking is None else ranking.scores(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, name])

    return documents.mapInArrow(run, f"{kinds}, `{name}` double")


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = scored(documents.select("doc_id", "text"), learn(documents, labels), "score")
    return rows.select("doc_id", (F.coalesce(fold(), F.lit(0)) == 0).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def kept_by_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their columns."""
    (name,) = free_names(documents, "_quality_score")
    return scored(documents, learn(documents, labels), name).filter(F.col(name) >= CUTOFF).select(*(f"`{c}`" for c in documents.columns))
