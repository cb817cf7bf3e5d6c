"""Choosing rows: counted random picks that can be repeated, autocomplete, bounded sets, order of ids."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.parse import SAFE_ID

FEW = 10_000
CUTS = 64


def _as_literal(value, kind) -> Column:
    return (F.struct(*(F.lit(v).alias(n) for n, v in value.asDict().items())) if isinstance(value, Row) else F.lit(value)).cast(kind)


def _narrowed(rows: DataFrame, key: str, index: int) -> tuple[DataFrame, int, int, bool]:
    """The rows between two sampled keys that hold a place, the place among them, how many they are, and whether they are fewer than before."""
    n = rows.count()
    kind = rows.schema[key].dataType
    sampled = rows.select(key).sample(min(1.0, 2 * CUTS / n), seed=11).limit(8 * CUTS).collect()
    cuts = [_as_literal(c, kind) for c in sorted({r[0] for r in sampled})[::2]]
    if not cuts:
        return rows, index, n, False
    below = rows.agg(*(F.count_if(F.col(key) < c).alias(f"n{i}") for i, c in enumerate(cuts))).first()
    low = max((i for i in range(len(cuts)) if below[i] <= index), default=None)
    high = min((i for i in range(len(cuts)) if below[i] > index), default=None)
    start, end = (0 if low is None else below[low]), (n if high is None else below[high])
    if low is not None:
        rows = rows.filter(F.col(key) >= cuts[low])
    if high is not None:
        rows = rows.filter(F.col(key) < cuts[high])
    return rows, index - start, end - start, end - start < n


def pick_at(df: DataFrame, index: int, key: str, few: int = FEW) -> DataFrame:
    """The row at a place in order of a key (unique, not null).

    Sorting up to a far place would bring all rows before it to one task. So the range of keys that holds the place is
    narrowed: a few keys are sampled, one pass counts the rows below each, and only the range between two of them is looked at
    again, until it has few rows. Samples change how many passes it takes, not the row.
    """
    n, fewer = df.count(), True
    rows = df
    while n > few and fewer:
        rows, index, n, fewer = _narrowed(rows, key, index)
    return rows.orderBy(key).offset(index).limit(1)


def seeded_place(seed: int, n: int) -> int:
    """A place below n that a seed always gives: 60 bits of its SHA-256."""
    return int(hashlib.sha256(str(seed).encode()).hexdigest()[:15], 16) % n


def seeded_pick(df: DataFrame, seed: int, key: str, few: int = FEW) -> DataFrame:
    """A uniform choice that a seed repeats: the rows are counted, and only the place goes to the cluster."""
    n = df.count()
    return pick_at(df, seeded_place(seed, n), key, few) if n else df.limit(0)


def mixed_pick(own: DataFrame, shared: DataFrame, seed: int, key: str) -> DataFrame:
    """A uniform choice over two sides as one: each is chosen as often as it has rows, and the row within it by what is left of the place."""
    first, second = own.count(), shared.count()
    if not first + second:
        return shared.limit(0)
    place = seeded_place(seed, first + second)
    return pick_at(own, place, key) if place < first else pick_at(shared, place - first, key)


def wrapping_pick(df: DataFrame, start: int, rank: Column, key: str, excluded: list, few: int = FEW) -> DataFrame:
    """The first row that isn't excluded, going round from a place in order of a rank that has no ties (a column, or a struct of several). At most as many rows as are excluded, and one, are looked at beyond the place."""
    rows = df.withColumn("_rank", rank)
    n = rows.count()
    if not n:
        return df.limit(0)
    reach = len(set(excluded)) + 1
    at = _as_literal(pick_at(rows, start % n, "_rank", few).select("_rank").first()[0], rows.schema["_rank"].dataType)
    ahead = rows.filter(F.col("_rank") >= at).orderBy("_rank").limit(reach)
    round_ = rows.filter(F.col("_rank") < at).orderBy("_rank").limit(reach)
    both = ahead.withColumn("lap", F.lit(0)).unionAll(round_.withColumn("lap", F.lit(1)))
    return both.filter(~F.col(key).isin(list(excluded))).orderBy("lap", "_rank").limit(1).drop("lap", "_rank")


def autocomplete(df: DataFrame, text: str, key: str, names: str, limit: int = 30) -> DataFrame:
    """Rows any of whose names holds the text; those that begin with it first, then by key."""
    hit = F.exists(names, lambda a: F.contains(a, F.lit(text)))
    begins = F.exists(names, lambda a: F.startswith(a, F.lit(text)))
    return df.filter(hit).withColumn("begins", begins).orderBy(F.desc("begins"), key).limit(limit)


def numeric_first(key: Column) -> list[Column]:
    """Ids of digits by their number, then all others as texts."""
    digits = key.rlike(r"^\d+$")
    return [F.when(digits, 0).otherwise(1), F.when(digits, key.try_cast("decimal(38,0)")), key]


def first_of(frames: list[DataFrame], key: str, limit: int | None = None) -> DataFrame:
    """Rows of several frames, in that order; of a key the first. Frames need a place column that orders them."""
    rows = None
    for k, f in enumerate(frames):
        f = f.withColumn("part", F.lit(k))
        rows = f if rows is None else rows.unionByName(f)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("part", "place"))
    out = rows.withColumn("rank", rank).filter("rank = 1").drop("rank")
    return out.orderBy("part", "place").limit(limit) if limit else out


def reference_set(frames: list[DataFrame], key: str, most: int = 1024) -> DataFrame:
    """(key) of the first `most` distinct safe ids of several frames in that order, and in each by its place: what a user's plans, favourites and history refer to."""
    ids = None
    for k, f in enumerate(frames):
        own = f.filter(F.col(key).cast("string").rlike(SAFE_ID)).groupBy(key).agg(F.min("place").alias("place")).withColumn("part", F.lit(k))
        ids = own if ids is None else ids.unionAll(own.select(*ids.columns))
    first = ids.groupBy(key).agg(F.min(F.struct("part", "place")).alias("first"))
    return first.orderBy("first", key).limit(most).select(key)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; the order must have no ties."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def by_request(df: DataFrame, wanted: list, key: str) -> DataFrame:
    """Rows of the wanted keys in the order they were asked for; unknown ones are left out. The list is a parameter, so it is small."""
    spark = df.sparkSession
    ask = spark.createDataFrame(list(enumerate(dict.fromkeys(wanted))), f"place int, {key} {df.schema[key].dataType.simpleString()}")
    return df.join(F.broadcast(ask), key).orderBy("place")


def most_common(df: DataFrame, group: str, value: str, place: str, n: int) -> DataFrame:
    """(group, value, n) of the n most common values of each group; of equally common ones, those that come first by place."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(place).alias("_first"))
    return top_per_group(counts, [group], [F.desc("n"), F.asc("_first")], n).select(group, value, "n")
