"""Tables that a job needs again: written once to the folder that driver and executors share, and read back; and rows that are dealt out to all tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a run on one machine (master local) gets a temporary folder, and a cluster an error."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """df, written to a new table of the shared folder: what follows doesn't compute it again, and a lost executor doesn't lose it."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df, its rows dealt over the session's shuffle partitions: a small file is one task, however many rows it packs and however much each of them costs after it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
