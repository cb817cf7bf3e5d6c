"""Record files: JSON lines or arrays with a schema, compressed payload columns, canonical writers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def read_records(spark: SparkSession, path: str, schema: str, lines: bool = True, strict: bool = True) -> DataFrame:
    """JSON lines, or files that each hold an array or one object. strict: a bad record fails the job; else it is kept in _corrupt_record."""
    reader = spark.read.option("multiLine", not lines)
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    return reader.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_wrapped(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """Records of files that each hold one object with a list of them in a field, such as {"recipes": [...]}."""
    whole = spark.read.schema(f"{field} array<struct<{_as_struct(schema)}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.explode(field).alias("r")).select("r.*")


def _as_struct(schema: str) -> str:
    return ", ".join(":".join(f.split(None, 1)) for f in schema.split(", "))


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line, text) of the lines of JSON-lines files that are no record, with their numbers from 1. Files are read whole, one in a task, as only a file knows its line numbers; blank lines and a byte-order mark are fine."""
    lines = spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(F.regexp_replace(F.col("content").cast("string"), "^\ufeff", ""), "\r?\n")).alias("at", "text"))
    known = F.from_json("text", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.filter(F.trim("text") != "").withColumn("bad", known["_corrupt_record"].isNotNull()).filter("bad").select("path", (F.col("at") + 1).alias("line"), "text")


def union_of(frames: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Rows of several sources with a source column. Checks belong to the caller: see audit.duplicates."""
    out = None
    for name, df in sorted(frames.items()):
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


@F.pandas_udf(StringType())
def inflated(payload: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of zlib-compressed bytes; null of others."""

    def one(b: bytes | None) -> str | None:
        try:
            return None if b is None else zlib.decompress(b).decode()
        except (zlib.error, UnicodeDecodeError):
            return None

    for s in payload:
        yield s.map(one)


def require_same_id(rows: DataFrame, key: str, payload: str, field: str = "id") -> DataFrame:
    """rows; reading one whose JSON payload has another id than its row fails the job."""
    same = F.get_json_object(payload, f"$.{field}").eqNullSafe(F.col(key).cast("string"))
    return rows.filter(F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("payload of another id: "), F.col(key).cast("string"))).cast("boolean")))


@F.pandas_udf(BinaryType())
def deflated(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else zlib.compress(t.encode(), 9))


def write_canonical(df: DataFrame, path: str) -> None:
    """JSON lines with their fields in alphabetic order; the committer publishes all or nothing."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
