"""Nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised residuals.

A vector is filed under its nearest centroid, and what is left of it after the centroid is kept as one code per
subspace. A query probes the lists of the centroids with the largest inner products, estimates the vectors there from tables
of inner products of its parts with code words (asymmetric: the query itself isn't quantised), and reranks the best
REFINE of each part exactly, in double precision, on the original vectors.

The coarse centroids and code words are fitted on at most SAMPLE vectors (those of least hash); every vector is filed.
Equal vectors are filed once, with the K + 1 least ids among them: no more can be in a result. They are gathered in two
steps, salted by id. Lists are gathered to parts of about PART vectors, and a list with more is cut into several parts. A
query goes once to each part that holds a list it probes, and a part hands on only its K best for each query.

How many lists are probed is measured on the whole file: for up to TRIAL vectors, at most a fifth of those drawn, that
nothing was fitted on, their exact neighbours are found in one pass over all vectors, and the least number of lists is taken
that holds TARGET of them. Clustered vectors need few
lists, vectors without clusters many.

Defined results: vectors that are null, empty, zero, of another length than most (of equally common lengths, the least), or
that hold null or non-finite components take no part, neither as queries nor as candidates, nor do rows without an id; long vectors
are ordinary (their parts are longer); rows that repeat an id with one vector count
once; fewer than K candidates give all of them; equal scores are in order of id; an empty table gives no rows. Components may
be of any number type; other columns, whatever their names, don't matter. REFINE bounds what a part reranks exactly for a
query; what that loses is in the recall that tests measure against brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 20
QUERY_STEP = 20
SAMPLE = 50_000
SAMPLE_A_LIST = 40
TARGET = 0.95
TRIAL = 256
SUBSPACES = 16
CODES = 256
REFINE = 512
PART = 1 << 14
QUERY_BLOCK = 1 << 14
SALTS = 256
MOST_LISTS = 4096
CELLS = 1 << 22


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    vectors = vectors.select("vec_id", "embedding" if kind in ("float", "double") else F.col("embedding").cast("array<double>").alias("embedding"))
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(F.coalesce(fine, F.lit(False))).select("vec_id", "embedding")


def distinct_vectors(vectors: DataFrame, keep: int = K + 1) -> DataFrame:
    """(embedding, ids): each vector once, with the `keep` least of its ids, ascending."""
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, keep).alias("ids")
    some = vectors.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(least(F.collect_list("vec_id")))
    return some.groupBy("embedding").agg(least(F.flatten(F.collect_list("ids"))))


def _centroids(x: np.ndarray, k: int, rounds: int, draw: np.random.Generator) -> np.ndarray:
    """k-means; an empty cluster keeps its centroid."""
    c = x[draw.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroid nearest to each vector, CELLS inner products at a time."""
    half, step = (c * c).sum(1) / 2, max(1, CELLS // len(c))
    return np.concatenate([np.zeros(0, np.int64), *((x[k : k + step] @ c.T - half).argmax(1) for k in range(0, len(x), step))])


class Index:
    """Coarse centroids, and code words for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.coarse = _centroids(sample, lists, 12, draw)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.words = [_centroids(rest[:, cut], codes, 8, draw) for cut in self.cuts]
        self.probed = len(self.coarse)

    def file(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and its codes."""
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        return at, np.stack([nearest(rest[:, cut], w) for cut, w in zip(self.cuts, self.words)], 1).astype(np.uint8)

    def probing(self, queries: np.ndarray, neighbours: list[np.ndarray], target: float = TARGET) -> int:
        """The least number of lists that hold a share of the queries' neighbours, of which their lists are given."""
        rank = np.argsort(self.probes(queries, len(self.coarse)), axis=1)
        found = np.concatenate([np.zeros(0, np.int64), *(r[n] for r, n in zip(rank, neighbours))])
        return int(np.ceil(np.quantile(found, target))) + 1 if len(found) else len(self.coarse)

    def probes(self, q: np.ndarray, n: int | None = None) -> np.ndarray:
        n, step = min(n or self.probed, len(self.coarse)), max(1, CELLS // len(self.coarse))
        return np.concatenate([np.zeros((0, n), np.int64), *(np.argsort(-(q[k : k + step] @ self.coarse.T), axis=1, kind="stable")[:, :n] for k in range(0, len(q), step))])

    def estimates(self, q: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Estimated inner products of queries with vectors, of their lists and codes."""
        out = (q @ self.coarse.T).astype(np.float32)[:, at]
        for m, (cut, w) in enumerate(zip(self.cuts, self.words)):
            out += (q[:, cut] @ w.T).astype(np.float32)[:, codes[:, m]]
        return out


def _matrix(column, kind=np.float32) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def search_part(index: Index, queries: np.ndarray, own: np.ndarray, asked: list, vectors: np.ndarray, at: np.ndarray, codes: np.ndarray, ids: list[list[int]], k: int = K, refine: int = REFINE) -> tuple[list, list, list]:
    """(query, id, score) rows: of the vectors in the lists that each query asks for (asked: for each query its lists here), the k best ids, reranked exactly."""
    found: tuple[list, list, list] = ([], [], [])
    n = min(max(refine, k + 1), len(vectors))
    for begin in range(0, len(queries), 64):
        q = queries[begin : begin + 64]
        guess = index.estimates(q.astype(np.float32), at, codes)
        wanted = np.zeros((len(q), len(index.coarse)), bool)
        for i in range(len(q)):
            wanted[i, asked[begin + i]] = True
        guess[~wanted[:, at]] = -np.inf
        short = np.argpartition(-guess, n - 1, axis=1)[:, :n] if n < len(vectors) else np.broadcast_to(np.arange(n), (len(q), n))
        score = np.einsum("qnd,qd->qn", vectors[short], q)
        score[np.take_along_axis(guess, short, 1) == -np.inf] = -np.inf
        cuts = -np.partition(-score, min(n, k + 1) - 1, axis=1)[:, min(n, k + 1) - 1]  # one more than k, as the query may be among them
        for i, cut in enumerate(cuts):
            me = int(own[begin + i])
            rows = sorted(((-score[i, j], v) for j in np.flatnonzero((score[i] >= cut) & (score[i] > -np.inf)) for v in ids[short[i, j]] if v != me))[:k]
            found[0].extend([me] * len(rows))
            found[1].extend(v for _, v in rows)
            found[2].extend(-s for s, _ in rows)
    return found


def parts_of(sizes: np.ndarray, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first part, and in how many parts it is: lists share a part until it is full, and one with more has parts of its own."""
    first, blocks = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // part))
    number, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > part:
            number, held = number + 1, 0
        first[k] = number
        if blocks[k] > 1:
            number, held = number + int(blocks[k]), 0
        else:
            held += int(n)
    return first, blocks


def trial_neighbours(filed: DataFrame, trial: np.ndarray, k: int) -> list[np.ndarray]:
    """The lists of the exact k nearest filed vectors of each trial vector, itself left out: one pass, and at most `trial` x k rows to the driver."""
    shared = filed.sparkSession.sparkContext.broadcast(trial)

    def best(batches):
        q = shared.value
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), np.float64)
                score = q @ x.T
                score[(q[:, None, :1] == x[None, :, :1])[:, :, 0] & (np.abs(score - (q * q).sum(1)[:, None]) < 1e-12)] = -np.inf
                n = min(k, b.num_rows)
                top = np.argpartition(-score, n - 1, axis=1)[:, :n]
                at = np.array(b.column(1))[top]
                yield pa.record_batch([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), n)), pa.array(np.take_along_axis(score, top, 1).ravel()), pa.array(at.ravel())], names=["trial", "score", "list"])

    rows = filed.select("embedding", "list").mapInArrow(best, "trial int, score double, list int").filter(F.col("score") > float("-inf"))
    order = Window.partitionBy("trial").orderBy(F.desc("score"), "list")
    near = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("trial").agg(F.collect_list("list").alias("lists")).collect()
    by_trial = {r["trial"]: np.array(r["lists"]) for r in near}
    return [by_trial.get(i, np.zeros(0, np.int64)) for i in range(len(trial))]


def nearest_neighbours(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, probed: int | None = None, sample: int = SAMPLE, part: int = PART, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of each query, a row whose id `step` divides. probed: lists for a query, if not as many as are found to be needed."""
    spark = vectors.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score double"
    sized = usable(vectors).withColumn("vec_id", F.col("vec_id").cast("long"))
    common = sized.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], out)
    good = sized.filter(F.size("embedding") == common["d"])
    kind = good.schema["embedding"].dataType.simpleString()
    lone = stored(distinct_vectors(good, k + 1), "vectors")
    n = lone.count()
    lists = lists or max(1, min(MOST_LISTS, int(2 * n**0.5)))
    sample = min(sample, SAMPLE_A_LIST * lists + CODES)
    drawn = _matrix(lone.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(sample + TRIAL).select("embedding").toArrow().column(0), np.float64)
    held = min(TRIAL, len(drawn) // 5)  # never fitted on
    fitted, trial = drawn[: len(drawn) - held], drawn[len(drawn) - held :]
    model = Index(fitted.astype(np.float32), lists)
    first = spark.sparkContext.broadcast(model)

    def file(batches):
        for b in batches:
            if b.num_rows:
                at, codes = first.value.file(_matrix(b.column(0)))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["embedding", "ids", "list", "codes"])

    filed = stored(lone.mapInArrow(file, f"embedding {kind}, ids array<bigint>, list int, codes binary"), "inverted-file")
    if probed is None:
        probed = model.probing(trial.astype(np.float32), trial_neighbours(filed, trial, min(k, n - 1))) if held else len(model.coarse)
    sizes = np.zeros(len(model.coarse), np.int64)
    for r in filed.groupBy("list").count().collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["count"]
    begin, blocks = parts_of(sizes, part)
    index = spark.sparkContext.broadcast((model, probed, sizes, begin, blocks))

    queries = stored(good.filter(F.col("vec_id") % step == 0).dropDuplicates(["vec_id"]).select("vec_id", "embedding"), "queries")
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def probe(batches):
        model, probed, sizes, begin, blocks = index.value
        for b in batches:
            for i, row in enumerate(model.probes(_matrix(b.column(1)), probed) if b.num_rows else []):
                row = row[sizes[row] > 0]
                reach = np.repeat(begin[row], blocks[row]) + np.concatenate([np.arange(x) for x in blocks[row]]) if len(row) else row
                owner = np.repeat(row, blocks[row])
                by = np.argsort(reach, kind="stable")
                parts, cut = np.unique(reach[by], return_index=True)
                wanted = [x.astype(np.int32) for x in np.split(owner[by], cut[1:])] if len(parts) else []
                m = len(parts)
                block = int(row[0]) % query_blocks if m else 0
                yield pa.record_batch([pa.array([b.column(0)[i].as_py()] * m, pa.int64()), b.column(1).slice(i, 1).take(pa.array([0] * m, pa.int32())), pa.array(parts, pa.int64()), pa.array(wanted, pa.list_(pa.int32())), pa.array([block] * m, pa.int64())], names=["query_id", "query", "part", "lists", "qb"])

    # Queries of one block have their best list in common, so they probe few parts besides; a part goes to the blocks that probe it only.
    asked = stored(queries.mapInArrow(probe, f"query_id bigint, query {kind}, part bigint, lists array<int>, qb bigint"), "asked")
    wanted = asked.select(F.col("part").alias("part"), F.col("qb").alias("qb")).distinct()
    of_list = spark.createDataFrame(list(zip(range(len(begin)), begin.tolist(), blocks.tolist())), "list int, begin bigint, blocks bigint")  # at most MOST_LISTS rows
    placed = filed.join(F.broadcast(of_list), "list").withColumn("part", F.col("begin") + F.pmod(F.xxhash64("embedding"), F.col("blocks"))).join(wanted, "part")

    def search(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        codes = np.frombuffer(b"".join(v.column("codes").to_pylist()), np.uint8).reshape(v.num_rows, -1)
        asked_lists = [np.array(x) for x in q.column("lists").to_pylist()]
        a, b, c = search_part(index.value[0], _matrix(q.column("query"), np.float64), np.array(q.column("query_id")), asked_lists, _matrix(v.column("embedding"), np.float64), np.array(v.column("list")), codes, v.column("ids").to_pylist(), k)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    key = ("part", "qb")
    left, right = asked.select(*key, "query_id", "query", "lists").groupBy(*key), placed.select(*key, "embedding", "ids", "list", "codes").groupBy(*key)
    found = left.cogroup(right).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
