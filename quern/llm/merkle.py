"""A Merkle manifest of a dataset: a leaf per row, a tree of runs of 8 per group of rows, and a tree over the groups.

H is SHA-256 in lowercase hex, of its inputs one after the other. A leaf is H of a row's fields, each framed by its length.
Leaves of a group (a lang) ascend by doc_id, and every 8 consecutive nodes become their H until one remains, the subroot;
subroots in the groups' order become the root in the same way.

How it runs: leaves are hashed where the rows lie, and only they are range-partitioned and numbered, from counts of ranges
of keys. Numbers cut each group into aligned buckets of 8**LEVELS leaves, so that a bucket is a whole subtree, whatever
the group's size. Buckets are Arrow tables on which DuckDB runs the level queries (string_agg in order, then sha256);
Spark adds the levels above them, an aggregation of at most 8 nodes each, and hands their siblings down again. A second
pass over the buckets joins these outer parts of the proofs and folds each leaf, in DuckDB too.

Defined results: a null field is `-`, so null and empty texts differ; rows without lang are a group of their own, the
first; a null doc_id sorts first and is never tampered with; rows of equal doc_id sort by leaf, and rows that are equal in
all fields have proofs of their own places; very long texts are hashed whole; other columns, whatever their names, take no
part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FAN = 8
LEVELS = 4  # of a bucket, which has FAN ** LEVELS leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(field: Column) -> Column:
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The leaf of a row of documents that has this text."""
    return F.sha2(F.concat(*(framed(text if name == "text" else F.col(name)) for name in FIELDS)), 256)


def with_lowered(documents: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and tampered: the leaf with A-Z of the text in lower case, for rows whose crc32 of doc_id is divisible by 3; else null."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return documents.select("doc_id", "lang", leaf_of(F.col("text")).alias("leaf"), F.when(chosen, leaf_of(F.translate("text", upper, upper.lower()))).alias("tampered"))


def height(n: int, fan: int = FAN) -> int:
    """Levels above n nodes."""
    h = 0
    while fan**h < n:
        h += 1
    return h


def numbered(leaves: DataFrame) -> DataFrame:
    """Adds group (the place of lang among all, null first), size (rows of that lang) and pos (the row's place among them, by doc_id). Ranges of keys are counted, never gathered; rows that are equal in all else are told apart by where they lie, so that no key is too large for a range."""
    order = ("lang", "doc_id", "leaf", "tie")
    thin = stored(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    ordered = stored(thin.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("place", F.monotonically_increasing_id()), "leaves").withColumn("part", F.shiftrightunsigned("place", 33))
    ranges = stored(ordered.groupBy("part", "lang").agg(F.count("*").alias("n"), F.min("place").alias("first")), "ranges")  # as many rows as there are ranges and groups together
    groups = ranges.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("size"), F.min("part").alias("home"))
    homes = groups.groupBy("home").count()  # a row per range
    begins = homes.select("home", (F.sum("count").over(Window.orderBy("home")) - F.col("count")).alias("begins"))
    groups = groups.join(begins, "home").withColumn("group", F.col("begins") + F.row_number().over(Window.partitionBy("home").orderBy(F.asc_nulls_first("of"))) - 1)
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part")) - F.col("n")
    spots = ranges.withColumn("before", before).join(groups, F.col("lang").eqNullSafe(F.col("of"))).select(F.col("part").alias("p"), "of", "first", "before", "size", "group")
    found = ordered.join(spots, (F.col("part") == F.col("p")) & F.col("lang").eqNullSafe(F.col("of")))
    return stored(found.select("group", "size", (F.col("before") + F.col("place") - F.col("first")).alias("pos"), "doc_id", "leaf", "tampered"), "leaves")


_engine: list[duckdb.DuckDBPyConnection] = []


def engine() -> duckdb.DuckDBPyConnection:
    """One DuckDB for a Python worker, in memory; a bucket is far below its limit."""
    if not _engine:
        _engine.append(duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""}))
    return _engine[0]


def _level_queries(levels: int, fan: int) -> str:
    """Tables n0 to n<levels> of (pos, h): the leaves of a bucket and the nodes above them."""
    out = [f"n0 AS MATERIALIZED (SELECT pos % {fan**levels if levels else 1} AS pos, leaf AS h FROM bucket)"]
    for k in range(levels):
        out.append(f"n{k + 1} AS MATERIALIZED (SELECT pos // {fan} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM n{k} GROUP BY 1)")
    return "WITH " + ", ".join(out)


def _fold_query(levels: int, outer: int, fan: int) -> str:
    """Every row with the digest of its whole proof and the root that its leaf folds to. Parameters: left and right siblings of each outer level."""
    run = f"PARTITION BY pos // {fan} ORDER BY pos ROWS BETWEEN"
    sides = [
        f"s{k} AS MATERIALIZED (SELECT pos, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM n{k})"
        for k in range(levels)
    ]
    left = [f"s{k}.l" for k in range(levels)] + [f"${2 * k + 1}::VARCHAR" for k in range(outer)]
    right = [f"s{k}.r" for k in range(levels)] + [f"${2 * k + 2}::VARCHAR" for k in range(outer)]
    proof, fold = "''", "coalesce(b.tampered, b.leaf)"
    for l, r in zip(left, right):
        proof, fold = f"{proof} || {l} || {r}", f"sha256({l} || {fold} || {r})"
    joins = "".join(f" JOIN s{k} ON s{k}.pos = (b.pos % {fan**levels}) // {fan**k}" for k in range(levels))
    return ", ".join([_level_queries(levels, fan), *sides]) + f" SELECT b.doc_id, b.leaf, sha256({proof}) AS proof_sha256, {fold} AS folded_root FROM bucket b{joins} ORDER BY b.pos"


def bucket_root(fan: int, levels: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, bucket: pa.Table) -> pa.Table:
        size = bucket.column("size")[0].as_py()
        inner = min(levels, height(size, fan))
        con = engine()
        con.register("bucket", bucket)
        ((root,),) = con.execute(f"{_level_queries(inner, fan)} SELECT h FROM n{inner}").fetchall()
        con.unregister("bucket")
        return pa.table({"group": [key[0].as_py()], "pos": [key[1].as_py()], "height": pa.array([height(size, fan)], pa.int32()), "h": [root]})

    return run


def _parents(nodes: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """One level up: keys, pos, run (the children in order), h, and what else nodes of one parent have in common."""
    run = F.array_sort(F.collect_list(F.struct("pos", "h")))  # pos most `fan`
    up = nodes.groupBy(*keys, F.floor(F.col("pos") / fan).alias("up")).agg(run.alias("run"))
    return stored(up.select(*keys, F.col("up").alias("pos"), F.col("run.h").alias("run"), F.sha2(F.array_join("run.h", ""), 256).alias("h")), "level")


def _handed_down(parents: DataFrame, paths: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """Paths of the children, from those of their parents: lefts and rights hold the siblings of each level, lowest first."""
    both = parents.select(*keys, "pos", "run").join(paths, [*keys, "pos"])
    others = [c for c in paths.columns if c not in (*keys, "pos", "lefts", "rights")]
    child = both.select(*keys, *others, "pos", "run", "lefts", "rights", F.posexplode("run").alias("k", "own"))
    left = F.array_join(F.slice("run", F.lit(1), F.col("k")), "")
    right = F.array_join(F.slice("run", F.col("k") + 2, F.lit(fan)), "")
    return child.select(*keys, *others, (F.col("pos") * fan + F.col("k")).alias("pos"), F.concat(F.array(left), "lefts").alias("lefts"), F.concat(F.array(right), "rights").alias("rights"))


def outer_paths(roots: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(group, pos, subroot, root, lefts, rights) of each bucket, from the buckets' roots: the levels above them, each an aggregation, and their siblings handed down."""
    most, groups = roots.agg(F.max("height"), F.countDistinct("group")).first()  # two numbers
    heights = roots.filter("pos = 0").select("group", "height")
    nodes, steps = roots.select("group", "pos", "h", "height"), []
    for level in range(levels, most or 0):
        up = _parents(nodes.filter(F.col("height") > level), ["group"], fan)
        steps.append((level, up))
        nodes = up.select("group", "pos", "h").join(heights, "group").unionByName(nodes.filter(F.col("height") <= level))
    subroots = stored(nodes.select("group", "height", F.col("h").alias("subroot")), "subroots")
    tops, top = [], subroots.select(F.col("group").alias("pos"), F.col("subroot").alias("h"))
    for _ in range(height(groups, fan)):
        tops.append(_parents(top, [], fan))
        top = tops[-1].select("pos", "h")
    none = F.array().cast("array<string>")
    paths = top.select("pos", F.col("h").alias("root"), none.alias("lefts"), none.alias("rights"))
    for up in reversed(tops):
        paths = _handed_down(up, paths, [], fan)
    paths = paths.withColumnRenamed("pos", "group").join(subroots, "group").withColumn("pos", F.lit(0).cast("long"))
    for level, up in reversed(steps):
        paths = _handed_down(up, paths.filter(F.col("height") > level), ["group"], fan).unionByName(paths.filter(F.col("height") <= level))
    return stored(paths.select("group", "pos", "subroot", "root", "lefts", "rights"), "paths")


def folded(fan: int, levels: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, bucket: pa.Table, path: pa.Table) -> pa.Table:
        (outer,) = path.to_pylist()
        inner = min(levels, height(bucket.column("size")[0].as_py(), fan))
        sides = [x for pair in zip(outer["lefts"], outer["rights"]) for x in pair]
        con = engine()
        con.register("bucket", bucket)
        rows = con.sql(_fold_query(inner, len(sides) // 2, fan), params=sides).to_arrow_table()
        con.unregister("bucket")
        n = rows.num_rows
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "leaf": rows.column("leaf"),
                "subroot": pa.array([outer["subroot"]] * n),
                "root": pa.array([outer["root"]] * n),
                "proof_sha256": rows.column("proof_sha256"),
                "folded_root": rows.column("folded_root"),
            }
        )

    return run


def merkle_manifest(documents: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = numbered(with_lowered(documents)).withColumn("b", F.floor(F.col("pos") / fan**levels))
    roots = stored(rows.select("group", "b", "size", "pos", "leaf").groupBy("group", "b").applyInArrow(bucket_root(fan, levels), "group bigint, pos bigint, height int, h string"), "bucket-roots")
    paths = outer_paths(roots, fan, levels).withColumnRenamed("pos", "b")
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    found = rows.groupBy("group", "b").cogroup(paths.groupBy("group", "b")).applyInArrow(folded(fan, levels), schema)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
