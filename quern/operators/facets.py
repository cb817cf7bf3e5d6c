"""Facets: long tables of tokens, conditions by semi and anti joins, vocabularies and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet_rows(df: DataFrame, key: str, groups: dict[str, Column]) -> DataFrame:
    """(key, facet, label) of array columns, a row for each label."""
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, groups)), F.array(*groups.values()))).alias("facet", "labels")
    return df.select(key, pairs).select(key, "facet", F.explode("labels").alias("label"))


def having(df: DataFrame, facets: DataFrame, key: str, facet: str, tokens: list[str]) -> DataFrame:
    """Rows with any of the tokens in a facet."""
    return df.join(facets.filter((F.col("facet") == facet) & F.col("token").isin(tokens)), key, "left_semi")


def having_all(df: DataFrame, facets: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """Rows with any token of each group: one semi join however many groups there are."""
    cases = [F.max(((F.col("facet") == g) & F.col("token").isin(t)).cast("int")).alias(f"has_{k}") for k, (g, t) in enumerate(sorted(groups.items()))]
    wanted = facets.filter(F.col("facet").isin(list(groups))).groupBy(key).agg(*cases)
    for k in range(len(cases)):
        wanted = wanted.filter(F.col(f"has_{k}") == 1)
    return df.join(wanted, key, "left_semi")


def lacking(df: DataFrame, facets: DataFrame, key: str, facet: str, part: str) -> DataFrame:
    """Rows none of whose tokens in a facet holds the text. Null keys stay, as they have no facet."""
    return df.join(facets.filter((F.col("facet") == facet) & F.contains("token", F.lit(part))), key, "left_anti")


def vocabulary(facets: DataFrame) -> DataFrame:
    """Tokens of each facet with their least label."""
    return facets.groupBy("facet", "token").agg(F.min("label").alias("label"))


def first_labels(facets: DataFrame, place: str) -> DataFrame:
    """Tokens with the label that comes first."""
    return facets.groupBy("facet", "token").agg(F.min_by("label", place).alias("label"))


def merged_options(options: DataFrame) -> DataFrame:
    """Options of several parts as one: counts added up, and the first label that isn't blank."""
    label = F.min_by("label", F.when(F.trim("label") != "", F.col("place")))
    return options.groupBy("key").agg(F.coalesce(label, F.lit("")).alias("label"), F.sum("n").alias("n"))


def canonical(tokens: Column, aliases: dict[str, str]) -> Column:
    """Tokens by an alias table, each once, in order of token. The table is a parameter of known size."""
    table = F.create_map(*(F.lit(x) for pair in sorted(aliases.items()) for x in pair)) if aliases else None
    named = F.transform(tokens, lambda t: F.coalesce(table[t], t)) if aliases else tokens
    return F.array_sort(F.array_distinct(named))


def expanded(token: str, groups: list[list[str]]) -> list[str]:
    """All tokens of the alias groups that a token is in; else the token alone."""
    found = [t for g in groups if token in g for t in g]
    return list(dict.fromkeys(found)) or [token]


def modal_label(df: DataFrame, group: str, label: str, greatest: bool = True) -> DataFrame:
    """The most frequent label of each group; of equals the greatest, or the least in lower case."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    if greatest:
        return counts.groupBy(group).agg(F.max_by(label, F.struct("n", label)).alias("label"), F.max("n").alias("n"))
    least = F.struct((-F.col("n")).alias("n"), F.lower(label).alias("low"), F.col(label).alias("label"))
    return counts.groupBy(group).agg(F.min_by(label, least).alias("label"), F.max("n").alias("n"))


def best_variant(df: DataFrame, key: Column, label: str, place: str) -> DataFrame:
    """The best written label of each key: lower case counts 2, accents 1, then the first."""
    quality = F.when(F.lower(label) == F.col(label), 2).otherwise(0) + F.when(F.col(label).rlike(r"[^\x00-\x7f]"), 1).otherwise(0)
    return df.groupBy(key.alias("key")).agg(F.max_by(label, F.struct(quality.alias("q"), (-F.col(place)).alias("p"))).alias("label"))


def collisions(df: DataFrame, key: str, variant: str) -> DataFrame:
    """Keys that several variants share."""
    return df.groupBy(key).agg(F.count_distinct(variant).alias("variants"), F.count("*").alias("n")).filter("variants > 1")
