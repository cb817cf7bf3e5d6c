"""What the operators of this package share: reading tables, shared storage, hashing of words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Arrow batches of the session are bounded by bytes, since texts may be long and workers are many."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a run on one machine (master local) gets a temporary one, and a cluster an error."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _stored.append(path)
    return path


_stored: list[str] = []


def drop_stored(spark: SparkSession) -> int:
    """Deletes the tables that operators of this session have stored so far, once nothing reads them any more; how many."""
    n = 0
    while _stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read back: what follows doesn't recompute it, and a lost executor doesn't lose it. Results read it lazily; drop_stored() deletes what a session has stored when they were used."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HOT = 1000


def spread_join(rows: DataFrame, known: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """rows joined with known (a row per key) so that no key is too large for a task: a key that more than a HOT-th of the rows have is joined by broadcast, of at most HOT rows of known. rows are read twice, so store them first. counts: (key, n) of rows, where they are known."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.broadcast(known.join(counts.filter(F.col("n") > max(total // HOT, 10_000)).select(key), key, "left_semi"))
    few = rows.join(hot, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(known, key)
    return few.unionByName(rest)


def by_bytes(batch: pa.RecordBatch, at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in a column of texts or bytes have at most `most` bytes together, or are one value."""
    size = np.array(pc.fill_null(pc.binary_length(batch.column(at)), 0), np.int64)
    ends = size.cumsum()
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Those names, with underscores before them until df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return tuple(out)


def number_of(column: str, df: DataFrame) -> Column:
    """A number that orders whole numbers as they are, hashes other kinds of key, and puts null before all."""
    c = F.col(column)
    whole = df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.coalesce(c.cast("long") if whole else F.when(c.isNotNull(), F.xxhash64(c)), F.lit(-(1 << 63)))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; of null, none."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash. Starts anew when it holds `limit` words, so memory stays bounded."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
