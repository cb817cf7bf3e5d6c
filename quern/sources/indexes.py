"""A catalog's index on disk: title keys with trigram postings, and bitmaps of facet tokens.

Rows are numbered in order of their key, range by range, and a span is SPAN numbers in a row. grams holds the numbers of the
titles that have a run of three characters, a row per (gram, span); titles have a space before and behind, so that words
have grams of their own. facets holds one bitmap per (facet, token, span): the sorted numbers where they are few, bits
where they are many. Both are sorted and written in small row groups, so a query reads the groups of its own grams or
tokens only, and all that is combined belongs to one span, whatever the catalog's size or a token's share of it.

keys holds (number, key, title). What grams suggest is verified with the titles; what bitmaps say is exact. The index names
the version of its key rules and its counts, and one that is stale or incomplete isn't opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import IntegrityError
from . import snapshots as sn

SPAN = 1 << 16
GRAM = 3
GROUP_BYTES = 1 << 20


def _number(place: Column) -> tuple[Column, Column]:
    """(span, number in it) of a row's place."""
    return F.shiftright(place, 16).alias("span"), place.bitwiseAND(F.lit(SPAN - 1)).cast("int").alias("nth")


def _write(rows: DataFrame, path: str, *order: str) -> None:
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", 64).parquet(path)


def packed(nths: list[int]) -> bytes:
    """Sorted numbers below SPAN: two bytes each, or bits if these are fewer."""
    few = np.array(nths, np.uint16)
    if 16 * len(few) <= SPAN:
        return b"n" + few.tobytes()
    bits = np.zeros(SPAN, np.uint8)
    bits[few] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def bits_of(data: bytes) -> np.ndarray:
    """A bitmap's SPAN bits, eight in a byte."""
    if data[:1] == b"b":
        return np.frombuffer(data, np.uint8, offset=1)
    bits = np.zeros(SPAN, np.uint8)
    bits[np.frombuffer(data, np.uint16, offset=1)] = 1
    return np.packbits(bits, bitorder="little")


def _with_bitmaps(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (names, nths: a sorted list) with the bitmap instead of the list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = pa.array([packed(x) for x in b.column(len(names)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], data], names=[*names, "bits"])

    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.select(*names, "nths").mapInArrow(run, f"{schema}, bits binary")


def build(rows: DataFrame, key: str, title: Column, facets: DataFrame, path: str, rules: str) -> int:
    """Writes the index of rows (key, title: its search key) and facets (key, facet, token) as a new version. Keys are unique."""
    spark = rows.sparkSession
    folder = f"{path}/data/{uuid.uuid4().hex}"
    numbered = rows.select(F.col(key).alias("key"), F.coalesce(title, F.lit("")).alias("title")).repartitionByRange("key").sortWithinPartitions("key").withColumn("place", F.monotonically_increasing_id())
    numbered.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/keys")
    keys = spark.read.parquet(f"{folder}/keys")
    spaced = F.concat(F.lit(" "), F.col("title"), F.lit(" "))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(spaced) - GRAM + 1, F.lit(1))), lambda i: F.substring(spaced, i, F.lit(GRAM))))
    listed = keys.select(F.explode(grams).alias("gram"), *_number(F.col("place"))).groupBy("gram", "span").agg(F.array_sort(F.collect_list("nth")).alias("nths"))  # at most SPAN
    _write(_with_bitmaps(listed, ["gram", "span"]), f"{folder}/grams", "gram", "span")
    tokens = facets.select(F.col(key).alias("key"), "facet", "token").join(keys.select("key", "place"), "key")
    sets = tokens.groupBy("facet", "token", *_number(F.col("place"))[:1]).agg(F.array_sort(F.collect_set(_number(F.col("place"))[1])).alias("nths"))
    _write(_with_bitmaps(sets, ["facet", "token", "span"]), f"{folder}/facets", "facet", "token", "span")
    counts = {n: spark.read.parquet(f"{folder}/{n}").count() for n in ("keys", "grams", "facets")}
    version = (sn.versions(spark, path) or [-1])[-1] + 1
    sn.put_once(spark, f"{path}/snapshots/{version:012d}.json", json.dumps({"folder": folder, "rules": rules, "counts": counts}))
    return version


def opened(spark: SparkSession, path: str, rules: str, rows: int | None = None) -> str:
    """The folder of the newest version, if it is of these key rules and has that many rows; else IntegrityError."""
    if not (known := sn.versions(spark, path)):
        raise IntegrityError(f"no index at {path}")
    found = json.loads(spark.read.text(f"{path}/snapshots/{known[-1]:012d}.json", wholetext=True).first()[0])
    if found["rules"] != rules:
        raise IntegrityError(f"stale title keys: {found['rules']}, not {rules}")
    if rows is not None and found["counts"]["keys"] != rows:
        raise IntegrityError(f"incomplete title keys: {found['counts']['keys']} of {rows}")
    return found["folder"]


def _grams(term: str) -> list[str]:
    return sorted({term[k : k + GRAM] for k in range(len(term) - GRAM + 1)})


def _spans(rows: DataFrame, combine, schema: str = "span long, n long, bits binary") -> DataFrame:
    """(span, n, bits) of what combine makes of each span's rows: name -> bits; spans with none are left out."""

    def run(t: pa.Table) -> pa.Table:
        got: dict[str, np.ndarray] = {}
        for name, data in zip(t.column("name").to_pylist(), t.column("bits").to_pylist()):
            own = bits_of(data)
            got[name] = got[name] | own if name in got else own
        out = combine(got)
        n = 0 if out is None else int(np.unpackbits(out).sum())
        return pa.table({"span": t.column("span")[:1] if n else t.column("span")[:0], "n": pa.array([n] if n else [], pa.int64()), "bits": pa.array([b"b" + out.tobytes()] if n else [], pa.binary())})

    return rows.select("span", "name", "bits").groupBy("span").applyInArrow(run, schema)


def _places(spans: DataFrame) -> DataFrame:
    """(place) of the bits of spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for span, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.record_batch([pa.array(span * SPAN + np.flatnonzero(np.unpackbits(bits_of(data), bitorder="little")))], names=["place"])

    return spans.select("span", "bits").mapInArrow(run, "place long")


def titled(spark: SparkSession, folder: str, terms: list[str], whole_words: bool = False) -> DataFrame:
    """(key, title) of titles that hold all terms (in key form), anywhere or as whole words. A term shorter than a gram is looked up in all grams that hold it."""
    keys = spark.read.parquet(f"{folder}/keys")
    spaced = F.concat(F.lit(" "), F.col("title"), F.lit(" "))
    wanted = [f" {t} " if whole_words else t for t in terms]
    test = reduce(and_, (F.contains(spaced, F.lit(t)) for t in wanted), F.lit(True))
    groups = [(t, _grams(t)) for t in wanted]
    if not any(wanted):
        return keys.select("key", "title")
    postings = spark.read.parquet(f"{folder}/grams")
    exact = sorted({g for _, gs in groups for g in gs})
    short = [t for t, gs in groups if not gs and t]
    found = postings.filter(F.col("gram").isin(exact)).select("span", F.col("gram").alias("name"), "bits") if exact else None
    for t in short:
        more = postings.filter(F.contains("gram", F.lit(t))).select("span", F.lit(f"short {t}").alias("name"), "bits")
        found = more if found is None else found.unionAll(more)
    names = exact + [f"short {t}" for t in short]
    both = _spans(found, lambda got: reduce(np.bitwise_and, (got[n] for n in names)) if all(n in got for n in names) else None)
    return keys.join(_places(both), "place").filter(test).select("key", "title")


def selected(spark: SparkSession, folder: str, groups: dict[str, list[str]], without: dict[str, list[str]] | None = None) -> DataFrame:
    """(span, n, bits) of rows with any token of each group's facet, and none of those without. With no group, all rows but those."""
    facets = spark.read.parquet(f"{folder}/facets")
    without = without or {}
    asked = [(F.col("facet") == f) & F.col("token").isin(ts) for part in (groups, without) for f, ts in part.items()]
    rows = facets.filter(reduce(or_, asked, F.lit(False)))
    named = rows.select("span", F.to_json(F.array("facet", "token")).alias("name"), "bits")
    if not groups:
        every = spark.read.parquet(f"{folder}/keys").select(*_number(F.col("place"))).groupBy("span").agg(F.array_sort(F.collect_list("nth")).alias("nths"))
        named = named.unionAll(_with_bitmaps(every, ["span"]).select("span", F.lit("").alias("name"), "bits"))
    name = lambda f, t: json.dumps([f, t], separators=(",", ":"), ensure_ascii=False)

    def combine(got: dict[str, np.ndarray]) -> np.ndarray | None:
        out = got.get("")
        for f, ts in groups.items():
            some = [got[name(f, t)] for t in ts if name(f, t) in got]
            if not some:
                return None
            any_ = reduce(np.bitwise_or, some)
            out = any_ if out is None else out & any_
        for f, ts in without.items():
            for t in ts:
                if out is not None and name(f, t) in got:
                    out = out & ~got[name(f, t)]
        return out

    return _spans(named, combine)


def counted(spans: DataFrame) -> DataFrame:
    """(n): how many rows were selected, from bitmaps alone."""
    return spans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def keys_of(spark: SparkSession, folder: str, spans: DataFrame) -> DataFrame:
    return spark.read.parquet(f"{folder}/keys").join(_places(spans), "place").select("key")


def token_counts(spark: SparkSession, folder: str, within: DataFrame | None = None) -> DataFrame:
    """(facet, token, n): how many rows have each token, of all or of those selected: what a vocabulary with counts shows."""
    facets = spark.read.parquet(f"{folder}/facets")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [int(np.unpackbits(bits_of(x) & (bits_of(y) if y is not None else np.uint8(255))).sum()) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["facet", "token", "n"])

    if within is None:
        both = facets.select("facet", "token", "bits", F.lit(None).cast("binary").alias("own"))
    else:
        both = facets.join(within.select("span", F.col("bits").alias("own")), "span").select("facet", "token", "bits", "own")
    return both.mapInArrow(run, "facet string, token string, n long").groupBy("facet", "token").agg(F.sum("n").alias("n")).filter("n > 0")
