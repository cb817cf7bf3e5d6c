"""Stateful streams: newest version per key, tombstone merging, settled values, event windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def event_windows(events: DataFrame, time: str, group: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window of event time; what is later than the watermark is left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), group).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), group, "n", "total")


def merged_versions(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The state of each key after each batch. Updates have payload (null: deleted), time and authoritative; a cache's update never brings back what is deleted, nor replaces what is newer."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        payload, time = state.get if state.exists else (None, -1)
        rows = pd.concat(list(frames)).sort_values(["time", "authoritative"], kind="stable")
        rows = rows.assign(payload=rows["payload"].astype(object).where(rows["payload"].notna(), None))
        sure = rows["authoritative"].to_numpy(bool)
        begin = len(rows) - sure[::-1].argmax() - 1 if sure.any() else -1 if state.exists else 0
        if begin >= 0:  # the last that is sure, or the first of all, stands whatever was before
            payload, time = rows["payload"].iloc[begin], int(rows["time"].iloc[begin])
        if payload is not None:  # what is deleted stays so; else newer times follow one another until one deletes
            newer = rows.iloc[begin + 1 :]
            newer = newer[newer["time"] > time].drop_duplicates("time")
            if len(newer):
                gone = newer["payload"].isna().to_numpy()
                last = newer.iloc[gone.argmax() if gone.any() else -1]
                payload, time = last["payload"], int(last["time"])
        state.update((payload, time))
        yield pd.DataFrame([[*key, payload, time]], columns=[*keys, "payload", "time"])

    kinds = ", ".join(f"{k} {updates.schema[k].dataType.simpleString()}" for k in keys)
    return updates.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, payload string, time long", "payload string, time long", "update", GroupStateTimeout.NoTimeout)


def keep_latest(stream: DataFrame, path: str, keys: list[str], time: str, checkpoint: str, buckets: int = 64):
    """A query that keeps the newest row of each key in a table of buckets below path: a batch writes anew only the buckets that its keys fall into, each under the batch's number. So a batch that is run again gives the same. latest_table() reads it, drop_superseded() deletes what newer batches have replaced."""
    from ..operators.merge import latest

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        fresh = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets`
        before = latest_table(spark, path, fresh.schema, number).filter(F.col("bucket").isin(touched))
        ties = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
        now = latest(before.unionByName(fresh), keys, [F.desc(time), F.desc(ties)]).withColumn("batch", F.lit(number))
        now.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def settled_values(changes: DataFrame, owner: str, value: str, time: str, quiet: str = "275 milliseconds", late: str = "1 minute") -> DataFrame:
    """Values of each owner that stood for a while: a session of changes ends when none comes for so long, and its last value is the one that stood. What is later than the watermark is left out."""
    last = F.max_by(value, time)
    found = changes.withWatermark(time, late).groupBy(owner, F.session_window(time, quiet)).agg(last.alias(value), F.count("*").alias("changes"))
    return found.select(owner, F.col("session_window.end").alias("at"), value, "changes")


def combined(changes: DataFrame, owner: str, names: list[str]) -> DataFrame:
    """At every batch, the newest value of each of several inputs by owner, null before it has one. Changes have input, value and time; of equal times the later input's name counts."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values = (list(x) for x in state.get) if state.exists else ([-1] * len(names), [None] * len(names))
        rows = pd.concat(list(frames))
        newest = rows.sort_values("time", kind="stable").drop_duplicates("input", keep="last")
        for name, value, time in zip(newest["input"], newest["value"], newest["time"]):
            k = names.index(name) if name in names else -1
            if k >= 0 and time >= times[k]:
                times[k], values[k] = int(time), None if pd.isna(value) else str(value)
        state.update((times, values))
        yield pd.DataFrame([[*key, *values]], columns=[owner, *names])

    kind = changes.schema[owner].dataType.simpleString()
    fields = ", ".join(f"`{n}` string" for n in names)
    return changes.groupBy(owner).applyInPandasWithState(step, f"{owner} {kind}, {fields}", "times array<long>, held array<string>", "update", GroupStateTimeout.NoTimeout)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(batch, bucket, folder) of all that is there."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "batch=*/bucket=*"))
    names = [str(f.getPath().toString()) for f in found or []]
    return [(int(n.split("/batch=")[1].split("/")[0]), int(n.rsplit("=", 1)[1]), n) for n in names]


def _newest(versions: list[tuple[int, int, str]], before: int | None) -> dict[int, str]:
    out: dict[int, tuple[int, str]] = {}
    for number, bucket, name in versions:
        if (before is None or number < before) and number >= out.get(bucket, (-1, ""))[0]:
            out[bucket] = (number, name)
    return {b: name for b, (_, name) in out.items()}


def latest_table(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """The newest version of each bucket, of batches before a number where one is given."""
    newest = _newest(_versions(spark, path), before)
    if not newest:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*newest.values()).drop("batch")


def drop_superseded(spark: SparkSession, path: str) -> int:
    """Deletes the versions of buckets that newer batches have replaced, once nothing reads them; how many."""
    versions = _versions(spark, path)
    stay = set(_newest(versions, None).values())
    old = [name for _, _, name in versions if name not in stay]
    for name in old:
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(old)
