"""Token ids as Parquet list columns: written in order, with chosen encodings, row groups and page indexes.

Rows (doc_id, part, before, n_tokens, ids) are range-partitioned and sorted by doc_id before they are encoded, so files
and row groups hold ranges of ids and the page index lets a reader take only the pages it needs. Ids are
dictionary- or delta-encoded; doc_id and the counts, which rise slowly, delta-encoded. `part` is the file's range and
`before` the ids of its earlier documents, so that a document's place in the whole stream of ids needs only the totals
of the ranges: as many rows as there are ranges.

Defined results: a null or empty text has the end id alone, and so has a blank one, as the vocabulary drops white space; very
long texts are one list; a null doc_id sorts first; rows of equal doc_id sort by text, and equal rows have their places one
after the other; other columns, whatever their names, take no part; an empty table gives no rows. Rows of one doc_id are one
range: the order by doc_id is the contract, and a doc_id that very many rows share makes a long file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path
from .library_tokens import library_tokens

END_ID = 1
ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 512
IDS = "ids.list.element"


def encoded(documents: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, before, n_tokens, ids) in ascending order of doc_id; texts are moved rather than ids, which take more room."""
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library_tokens(path, lower=True)
        part, before = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids = [x + end for x in tokens.encode([t or "" for t in b.column(1).to_pylist()])]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                flat = np.frombuffer(b"".join(ids), np.int32)
                bounds = np.r_[0, n.cumsum()]
                yield pa.record_batch(
                    {
                        "doc_id": b.column(0),
                        "part": pa.array(np.full(len(ids), part, np.int32)),
                        "before": pa.array(before + bounds[:-1]),
                        "n_tokens": pa.array(n),
                        "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)),
                    }
                )
                before += int(bounds[-1])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {kind}, part int, before bigint, n_tokens bigint, ids array<int>")


def write_ids(rows: DataFrame, path: str, encoding: str = "dictionary") -> None:
    """Writes Parquet with the column index that the writer adds by itself. encoding of the ids: dictionary or delta."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding}")
    options = {
        "compression": "zstd",
        "parquet.compression.codec.zstd.level": "1",
        "parquet.writer.version": "PARQUET_2_0",  # whose integers are delta-encoded where they have no dictionary
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "false",
        f"parquet.enable.dictionary#{IDS}": str(encoding == "dictionary").lower(),
    }
    rows.write.options(**options).parquet(path)


def read_ids(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    return spark.read.schema(f"doc_id {kind}, part int, before bigint, n_tokens bigint, ids array<int>").parquet(path)


def read_range(spark: SparkSession, path: str, low: int, high: int, columns: tuple[str, ...] = ("doc_id", "ids"), kind: str = "bigint") -> DataFrame:
    """Some columns of the documents of a range of doc_id: row groups and pages of other ranges, and the other columns, aren't read. Counts alone don't read ids."""
    return read_ids(spark, path, kind).filter(F.col("doc_id").between(low, high)).select(*columns)


def ids_digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).view(np.uint8))
            bounds = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:z]) for a, z in zip((4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist())]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    read = rows.select("doc_id", "part", "before", "ids").mapInArrow(run, f"doc_id {kind}, part int, before bigint, n_tokens bigint, ids_crc32 bigint")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per range
    begins = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begins"))
    return read.join(F.broadcast(begins), "part").select("doc_id", (F.col("begins") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def stored_ids_digest(documents: DataFrame, path: str) -> DataFrame:
    """Encodes, writes and reads back: what the stored files hold of each document."""
    spark = documents.sparkSession
    to = new_path(spark, "token-ids")
    write_ids(encoded(documents, path), to)
    return ids_digest(read_ids(spark, to, documents.schema["doc_id"].dataType.simpleString()))
