"""Merging versions of records: last write wins, tombstones, revisions, mutation logs, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order without ties."""
    return df.withColumn("version_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("version_rank = 1").drop("version_rank")


def last_write_wins(frames: list[DataFrame], keys: list[str], time: str) -> DataFrame:
    """Of each key the latest row; of equal times that of the later frame. Rows with a blank key go."""
    rows = None
    for k, f in enumerate(frames):
        for c in keys:
            f = f.filter(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
        f = f.withColumn("input", F.lit(k))
        rows = f if rows is None else rows.unionByName(f)
    return latest(rows, keys, [F.desc(time), F.desc("input")])


def merge_snapshot(current: DataFrame, received: DataFrame, keys: list[str], authoritative: bool) -> DataFrame:
    """current with a received snapshot merged in. Rows have payload (null: deleted), time, revision (null: nothing pending), observed, imported.

    A pending revision stays until an authoritative snapshot shows its payload (then it is observed) or, for an imported
    row, something newer. Without one, an authoritative snapshot replaces the row, or deletes one it lacks; a cache
    only adds rows and newer versions, and never brings back what is deleted.
    """
    a = current.select(*keys, F.struct("payload", "time", "revision", "observed", "imported").alias("a"))
    b = received.select(*keys, F.struct("payload", "time", F.lit(None).cast("string").alias("revision"), F.lit(False).alias("observed"), F.lit(False).alias("imported")).alias("b"))
    both = a.join(b, keys, "full_outer")
    old, new = F.col("a"), F.col("b")
    pending = old.isNotNull() & old["revision"].isNotNull()
    newer = new.isNotNull() & (new["time"] > old["time"])
    if authoritative:
        matches = new.isNotNull() & old["payload"].eqNullSafe(new["payload"])
        kept = (
            F.when(pending & old["imported"] & newer, new)
            .when(pending & matches, old.withField("observed", F.lit(True)).withField("imported", F.lit(False)))
            .when(pending, old.withField("imported", F.lit(False)))
            .when(new.isNotNull(), new)
            .otherwise(old.withField("payload", F.lit(None).cast("string")))
        )
    else:
        kept = F.when(old.isNull(), new).when(pending | old["payload"].isNull(), old).when(newer, new).otherwise(old)
    return both.select(*keys, kept.alias("r")).select(*keys, "r.*")


def mutations(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What changed between two states: (keys, payload, revision); a removed row has a null payload. The revision is a hash, so it is the same when computed again."""
    both = before.select(*keys, F.col("payload").alias("old"), F.lit(True).alias("was")).join(after.select(*keys, F.col("payload").alias("new"), F.lit(True).alias("is")), keys, "full_outer")
    changed = both.filter(~F.col("old").eqNullSafe(F.col("new")) | F.col("was").isNull() | F.col("is").isNull())
    return changed.select(*keys, F.col("new").alias("payload"), F.sha2(F.concat_ws("|", *keys, F.coalesce("new", F.lit("")), F.coalesce("old", F.lit(""))), 256).alias("revision"))


def acknowledged(rows: DataFrame, acks: DataFrame, keys: list[str]) -> DataFrame:
    """Clears the pending revision of rows for which exactly that one is acknowledged."""
    hit = acks.select(*keys, F.col("revision").alias("acked")).distinct()
    joined = rows.join(hit, [rows[k] == hit[k] for k in keys] + [rows["revision"] == hit["acked"]], "left").drop(*(hit[k] for k in keys))
    return joined.withColumn("revision", F.when(F.col("acked").isNull(), F.col("revision"))).drop("acked")


def claimed(rows: DataFrame, guest: str, owner: str, keys: list[str]) -> DataFrame:
    """A guest's rows moved to an owner; where both have one, the newer stays, the owner's of equals."""
    moved = rows.withColumn("mine", (F.col("owner") == owner).cast("int")).withColumn("owner", F.when(F.col("owner") == guest, F.lit(owner)).otherwise(F.col("owner")))
    return latest(moved, ["owner", *keys], [F.desc("time"), F.desc("mine")]).drop("mine")


def patch(target: DataFrame, live: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, patch): for rows in both, a map of the fields that differ, as texts (null-safe)."""
    a, b = target.alias("t"), live.alias("l")
    joined = a.join(b, F.col(f"t.{key}") == F.col(f"l.{key}"))
    names = F.array(*(F.when(~F.col(f"t.{f}").eqNullSafe(F.col(f"l.{f}")), F.lit(f)) for f in fields))
    values = F.array(*(F.coalesce(F.col(f"t.{f}").cast("string"), F.lit("null")) for f in fields))
    pairs = F.filter(F.arrays_zip(names.alias("field"), values.alias("value")), lambda x: x["field"].isNotNull())
    return joined.select(F.col(f"t.{key}").alias(key), F.map_from_entries(pairs).alias("patch")).filter(F.size("patch") > 0)


def same_identity(target: DataFrame, live: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """target; reading a row whose live row has another identity (such as its source) fails the job, since a patch would join two things."""
    other = live.select(F.col(key).alias("_key"), F.struct(*identity).alias("_live"))
    joined = target.join(other, F.col(key) == F.col("_key"), "left")
    fine = F.col("_live").isNull() | F.col("_live").eqNullSafe(F.struct(*identity))
    checked = joined.filter(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("another identity: "), F.col(key).cast("string"))).cast("boolean")))
    return checked.drop("_key", "_live")


def claimed_once(rows: DataFrame, claims: DataFrame, done: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, tokens): claims (token, guest, owner) whose token isn't done move the guests' rows to the owners; where an owner has one of the same key, the newer stays, and the owner's of equals. The tokens that are done then, so that a claim that comes again changes nothing."""
    fresh = claims.join(done.select("token"), "token", "left_anti")
    to = fresh.groupBy("guest").agg(F.min("owner").alias("_to"))
    moved = rows.join(to, rows["owner"] == to["guest"], "left").withColumn("_mine", F.col("_to").isNull().cast("int"))
    moved = moved.withColumn("owner", F.coalesce("_to", "owner")).drop("guest", "_to")
    return latest(moved, ["owner", *keys], [F.desc("time"), F.desc("_mine")]).drop("_mine"), done.select("token").unionByName(fresh.select("token")).distinct()
