"""Checks on tables: integrity, violations, drift, transitions, coverage, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    pass


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def require_none(df: DataFrame, what: str) -> None:
    """Raises when a frame of findings has any; only the first few come to the driver."""
    if found := df.limit(5).collect():
        raise IntegrityError(f"{what}: {[r.asDict() for r in found]}")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, violations) of rows that break a rule; a rule is a condition that must hold, and null breaks it."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in sorted(rules.items()))))
    return df.select(key, broken.alias("violations")).filter(F.size("violations") > 0)


def drift(stored: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that either side lacks or whose columns differ from what is derived anew: (key, kind, differing)."""
    a = stored.select(F.col(key).alias("sk"), F.struct(*columns).alias("s"))
    b = derived.select(F.col(key).alias("dk"), F.struct(*columns).alias("d"))
    joined = a.join(b, F.col("sk") == F.col("dk"), "full_outer")
    differing = F.array_compact(F.array(*(F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")), F.lit(c)) for c in columns)))
    kind = F.when(F.col("sk").isNull(), "missing").when(F.col("dk").isNull(), "extra").when(F.size(differing) > 0, "differs")
    return joined.select(F.coalesce("sk", "dk").alias(key), kind.alias("kind"), F.when(kind == "differs", F.array_join(differing, ",")).otherwise("").alias("differing")).filter(F.col("kind").isNotNull())


def rederived(stored: DataFrame, derived: DataFrame, key: str, columns: list[str], payload: str) -> DataFrame:
    """drift(), where what was derived is from the same evidence: a row whose payload has another digest is of kind `payload`, whatever else differs."""
    digest = F.sha2(F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary")), 256).alias("_payload")
    both = stored.select(F.col(key).alias("_key"), digest).join(derived.select(F.col(key).alias("_other"), digest.alias("_derived")), F.col("_key") == F.col("_other"))
    changed = both.filter(F.col("_payload") != F.col("_derived")).select("_key")
    found = drift(stored, derived, key, columns)
    rest = found.join(changed, F.col(key) == F.col("_key"), "left_anti")
    return rest.unionAll(changed.select(F.col("_key").alias(key), F.lit("payload").alias("kind"), F.lit("").alias("differing")))


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    return df.groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, group: str, conditions: dict[str, Column]) -> DataFrame:
    """Rows of each group, and how many meet each condition."""
    return df.groupBy(group).agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in sorted(conditions.items())))


def largest(df: DataFrame, size: Column, key: str) -> DataFrame:
    """The largest size and the least key that has it."""
    return df.agg(F.max(size).alias("size"), F.max_by(key, F.struct(size, -F.col(key))).alias(key))


def digest(df: DataFrame, group: list[str], key: str, json: Column) -> DataFrame:
    """A SHA-256 of each group's rows that doesn't depend on their order or place: rows are hashed, and hashes are hashed in order, as a tree: by their first six digits, then by four, by two, and all. Repeated rows count."""
    level = df.select(*group, F.sha2(F.concat_ws("|", F.col(key).cast("string"), json), 256).alias("k")).withColumn("h", F.col("k"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256)
    for digits in (6, 4, 2):
        level = level.groupBy(*group, F.substring("k", 1, digits).alias("p")).agg(joined.alias("h")).withColumnRenamed("p", "k")
    return level.groupBy(*group).agg(joined.alias("digest"))


def set_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two sets lacks, with the side that has them. None: the sets are equal."""
    return a.subtract(b).withColumn("only_in", F.lit("left")).unionAll(b.subtract(a).withColumn("only_in", F.lit("right")))


def intersection(frames: list[DataFrame]) -> DataFrame:
    """Rows that all of some sets have."""
    out = frames[0].distinct()
    for f in frames[1:]:
        out = out.intersect(f)
    return out


def set_differences(df: DataFrame, key: str, stored: Column, derived: Column) -> DataFrame:
    """(key, missing, extra) of rows whose stored set isn't the derived one: what it lacks, and what it has beyond."""
    lists = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    s, d = lists(stored), lists(derived)
    out = df.select(key, F.array_except(d, s).alias("missing"), F.array_except(s, d).alias("extra"))
    return out.filter((F.size("missing") > 0) | (F.size("extra") > 0))


def eligibility(df: DataFrame, groups: list[str], stored: Column, derived: Column) -> DataFrame:
    """(group, value, stored, derived): eligible rows as stored and as found anew, by each grouping and in all."""
    rows = df.withColumns({"_stored": stored, "_derived": derived})
    sets = rows.groupingSets([[g] for g in groups] + [[]], *groups).agg(F.count_if("_stored").alias("stored"), F.count_if("_derived").alias("derived"), F.grouping_id().alias("_id"))
    name = F.lit("all")
    value = F.lit("")
    for k, g in enumerate(groups):
        alone = (1 << len(groups)) - 1 - (1 << (len(groups) - 1 - k))
        name, value = F.when(F.col("_id") == alone, F.lit(g)).otherwise(name), F.when(F.col("_id") == alone, F.coalesce(F.col(g).cast("string"), F.lit(""))).otherwise(value)
    return sets.select(name.alias("name"), value.alias("value"), "stored", "derived")
