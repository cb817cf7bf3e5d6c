"""Sets of artifacts that are taken only whole: manifests, unions of sources, checkpoint copies, promotion, and digests of what is in them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import IntegrityError, require_none

SHA256 = re.compile(r"[0-9a-f]{64}")


@dataclass(frozen=True)
class Manifest:
    """What an artifact says of itself. A partial one says why, and that its snapshot was looked at."""

    source_key: str
    complete: bool
    language: str
    failed: int
    rows: int
    hashes: dict[str, str]
    partial_note: str = ""
    snapshot_validated: bool = False
    failed_normalizations: int = 0


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """A manifest from a JSON file that Spark reads."""
    schema = "sourceKey string, complete boolean, language string, failedRecipeCount long, activeRecipeCount long, catalogHash string, detailHash string, summaryHash string, coverageNote string, snapshotValidated boolean, normalizationFailures long"
    r = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).first()
    if r is None:
        raise IntegrityError(f"no manifest at {path}")
    hashes = {k: r[k] or "" for k in ("catalogHash", "detailHash", "summaryHash")}
    return Manifest(r["sourceKey"] or "", bool(r["complete"]), r["language"] or "", -1 if r["failedRecipeCount"] is None else r["failedRecipeCount"], r["activeRecipeCount"] or 0, hashes, r["coverageNote"] or "", bool(r["snapshotValidated"]), r["normalizationFailures"] or 0)


def require_manifest(m: Manifest, language: str, allow_partial: bool = False) -> None:
    """Raises unless the artifact is complete, of the language, without failures and fully hashed; a partial one needs its note, its validated snapshot and no failed normalization."""
    problems = [f"{k} is no SHA-256" for k, h in sorted(m.hashes.items()) if not SHA256.fullmatch(h)]
    if m.language != language:
        problems.append(f"language {m.language!r}")
    if not m.complete or m.failed:
        if not allow_partial:
            problems.append("incomplete" if not m.complete else f"{m.failed} failures")
        elif not (m.partial_note.strip() and m.snapshot_validated and not m.failed_normalizations):
            problems.append("a partial artifact needs a note, a validated snapshot and no failed normalization")
    if problems:
        raise IntegrityError(f"{m.source_key}: {', '.join(problems)}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"))


def united(frames: dict[str, tuple[Manifest, DataFrame]], key: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows of all sources, problems): problems tell rows of another source than their manifest's, ids that repeat, and counts that differ from the manifests'."""
    parts = [df.withColumn("_declared", F.lit(m.source_key)) for _, (m, df) in sorted(frames.items())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    spark = rows.sparkSession
    foreign = rows.filter(~F.col(source).eqNullSafe(F.col("_declared"))).groupBy("_declared").agg(F.count("*").alias("n")).select(F.lit("foreign source").alias("problem"), F.col("_declared").alias("what"), "n")
    repeated = rows.groupBy(F.col(key).cast("string").alias("what")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated id").alias("problem"), "what", "n")
    counts = rows.groupBy("_declared").agg(F.count("*").alias("n"))
    said = spark.createDataFrame([(m.source_key, m.rows) for m, _ in frames.values()], "_declared string, said long")
    wrong = said.join(counts, "_declared", "left").filter(~F.coalesce("n", F.lit(0)).eqNullSafe(F.col("said"))).select(F.lit("wrong count").alias("problem"), F.col("_declared").alias("what"), F.coalesce("n", F.lit(0)).alias("n"))
    return rows.drop("_declared"), foreign.unionAll(repeated).unionAll(wrong)


def vocabulary_options(rows: DataFrame, facet: str, id_: str, title: str) -> tuple[DataFrame, DataFrame]:
    """(facet -> its options in order, problems): a dimension of facets; blank options and ids of several titles are problems."""
    each = rows.groupBy(facet, id_).agg(F.count_distinct(title).alias("n"), F.min(title).alias(title))
    bad = each.filter((F.col("n") != 1) | (F.trim(title) == ""))
    options = each.groupBy(facet).agg(F.array_sort(F.collect_list(F.struct(id_, title))).alias("options"))
    return options, bad.select(facet, id_, "n")


def copied_checkpoint(rows: DataFrame, key: str, keep: Column, broken: Column, run_key: str) -> DataFrame:
    """Rows of a checkpoint for another run: those to keep, under the new run's key. A row that is broken, or a key that repeats, fails the job when it is read."""
    fine = rows.filter(F.when(F.coalesce(broken, F.lit(True)), F.raise_error(F.concat(F.lit("broken row "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True)))
    kept = fine.filter(F.coalesce(keep, F.lit(False))).withColumn("run_key", F.lit(run_key))
    once = kept.groupBy(key).agg(F.count("*").alias("_n"))
    alone = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("boolean"))
    return kept.join(once.filter(alone).select(key), key, "left_semi")


def promoted(spark: SparkSession, parts: dict[str, DataFrame], path: str, problems: Callable[[], DataFrame]) -> None:
    """Writes a set under a new path, and its manifest last, so that a reader that finds the manifest finds all; nothing is written when there are problems."""
    require_none(problems(), "not promoted")
    counts = []
    for name, df in sorted(parts.items()):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        counts.append((name, spark.read.parquet(f"{path}/{name}").count()))
    spark.createDataFrame(counts, "name string, rows long").coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")


def tree_digest(rows: DataFrame, frame: Column, order: Column) -> DataFrame:
    """(digest, n): a SHA-256 of framed rows in the order of the SHA-256 of their keys, as a tree: frames are hashed where they are, and only digests are gathered, by six digits of their keys' hashes, then by four and by two."""
    level = rows.select(F.sha2(order.cast("string"), 256).alias("k"), F.sha2(frame, 256).alias("f"), F.lit(1).cast("long").alias("n"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "f"))), lambda x: x["f"]), ""), 256)
    for digits in (6, 4, 2):
        level = level.groupBy(F.substring("k", 1, digits).alias("p")).agg(joined.alias("f"), F.sum("n").alias("n")).withColumnRenamed("p", "k")
    return level.agg(joined.alias("digest"), F.sum("n").alias("n"))


def framed(*parts: Column) -> Column:
    """Texts one after the other, each behind its length in bytes, so that no two sequences read the same."""
    return F.concat(*(F.concat(F.octet_length(F.coalesce(p.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts))


def refreshed_manifest(rows: DataFrame, key: str, payload: Column) -> DataFrame:
    """One row (rows, largest, digest) of a table after a change."""
    size = F.octet_length(payload)
    return tree_digest(rows, framed(F.col(key), payload), F.col(key)).crossJoin(F.broadcast(rows.agg(F.max(size).alias("largest"))))  # one row each


def plan_summary(changes: DataFrame, collection: str, patch: str) -> DataFrame:
    """(kind, name, n): writes of each collection, and changes of each field."""
    writes = changes.groupBy(F.col(collection).alias("name")).agg(F.count("*").alias("n")).select(F.lit("collection").alias("kind"), "name", "n")
    fields = changes.select(F.explode(F.map_keys(patch)).alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("field").alias("kind"), "name", "n")
    return writes.unionAll(fields)
