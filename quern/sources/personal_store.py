"""Users' documents in a keyed table on disk: local writes that wait for acknowledgement, snapshots from elsewhere, claims.

A row is (owner, collection, document_id, payload, time, revision, observed, imported): a null payload is a tombstone, and a
revision says that a local write isn't acknowledged yet. Each function below is one transaction on the newest snapshot, so
it is done wholly or not at all; a claim's token is a row like others, so that it is done with the rows it moves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as me
from . import snapshots as sn

KEYS = ["owner", "collection", "document_id"]
SCHEMA = "owner string, collection string, document_id string, payload string, time bigint, revision string, observed boolean, imported boolean"
CLAIMS = "_claims"


def opened(spark: SparkSession, path: str, buckets: int = sn.BUCKETS) -> sn.Snapshot:
    """The newest snapshot; of a new folder the first, empty one."""
    if not sn.versions(spark, path):
        try:
            return sn.create(spark.createDataFrame([], SCHEMA), path, KEYS, buckets)
        except sn.Conflict:
            pass  # another one has opened it
    return sn.snapshot(spark, path)


def transaction(spark: SparkSession, path: str, step: Callable[[sn.Snapshot], sn.Snapshot], attempts: int = 5) -> sn.Snapshot:
    """A step on the newest snapshot, again on the next newest while other writers come first."""
    for _ in range(attempts - 1):
        try:
            return step(opened(spark, path))
        except sn.Conflict:
            continue
    return step(opened(spark, path))


def documents(spark: SparkSession, path: str, owner: str | None = None) -> DataFrame:
    """Rows that aren't deleted, of one owner or of all."""
    rows = sn.rows_of(spark, path, opened(spark, path)).filter(F.col("payload").isNotNull() & (F.col("collection") != CLAIMS))
    return rows if owner is None else rows.filter(F.col("owner") == owner)


def pending(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a local write that isn't acknowledged, tombstones too."""
    return sn.rows_of(spark, path, opened(spark, path)).filter(F.col("revision").isNotNull())


def write(path: str, changes: DataFrame) -> sn.Snapshot:
    """Local writes (keys, payload, time), one for a key: each puts its row with a new revision. A write that says what the row says changes nothing."""

    def step(base: sn.Snapshot) -> sn.Snapshot:
        def change(old: DataFrame) -> DataFrame:
            new = changes.select(*KEYS, F.col("payload").alias("_payload"), F.col("time").cast("bigint").alias("_time"), F.lit(True).alias("_new"))
            both = old.withColumn("_old", F.lit(True)).join(new, KEYS, "full_outer")
            same = F.col("_new").isNull() | (F.col("_old").isNotNull() & F.col("payload").eqNullSafe(F.col("_payload")))
            revision = F.sha2(F.concat_ws("|", *KEYS, F.coalesce("_payload", F.lit("")), F.coalesce("revision", "payload", F.lit("")), F.col("_time").cast("string")), 256)
            pick = lambda c, value: F.when(same, F.col(c)).otherwise(value).alias(c)
            return both.select(*KEYS, pick("payload", F.col("_payload")), pick("time", F.col("_time")), pick("revision", revision), pick("observed", F.lit(False)), pick("imported", F.lit(False)))

        return sn.rewritten(path, base, changes, change)

    return transaction(changes.sparkSession, path, step)


def acknowledge(path: str, acks: DataFrame) -> sn.Snapshot:
    """(keys, revision): clears exactly those revisions; one that a later write has replaced stays."""
    return transaction(acks.sparkSession, path, lambda base: sn.rewritten(path, base, acks, lambda old: me.acknowledged(old, acks, KEYS).select(*old.columns)))


def receive(path: str, received: DataFrame, authoritative: bool) -> sn.Snapshot:
    """Merges what came from elsewhere (keys, payload, time), see merge.merge_snapshot. An authoritative snapshot speaks for whole collections of the owners it names, so their keys are touched too."""
    spark = received.sparkSession

    def step(base: sn.Snapshot) -> sn.Snapshot:
        spoken = received.select("owner", "collection").distinct()
        touched = received.select(*KEYS)
        if authoritative:
            touched = touched.unionAll(sn.rows_of(spark, path, base).join(spoken, ["owner", "collection"], "left_semi").select(*KEYS))

        def change(old: DataFrame) -> DataFrame:
            mine = old.join(spoken, ["owner", "collection"], "left_semi") if authoritative else old
            merged = me.merge_snapshot(mine, received, KEYS, authoritative).select(*old.columns)
            return merged.unionByName(old.join(spoken, ["owner", "collection"], "left_anti")) if authoritative else merged

        return sn.rewritten(path, base, touched, change)

    return transaction(spark, path, step)


def claim(path: str, token: str, guest: str, owner: str, spark: SparkSession) -> sn.Snapshot:
    """A guest's rows become an owner's, see merge.claimed; a token that was used changes nothing."""

    def step(base: sn.Snapshot) -> sn.Snapshot:
        rows = sn.rows_of(spark, path, base)
        mark = spark.createDataFrame([(owner, CLAIMS, token, "done", 0, None, True, False)], SCHEMA)
        if rows.filter((F.col("collection") == CLAIMS) & (F.col("document_id") == token)).limit(1).count():
            return base
        own = rows.filter(F.col("owner") == guest)
        touched = own.select(*KEYS).unionAll(own.select(F.lit(owner).alias("owner"), "collection", "document_id")).unionAll(mark.select(*KEYS))
        return sn.rewritten(path, base, touched, lambda old: me.claimed(old, guest, owner, KEYS[1:]).select(*old.columns).unionByName(mark))

    return transaction(spark, path, step)
