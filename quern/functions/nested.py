"""Functions on nested and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Compact JSON of the columns in alphabetic order; missing values are left out."""
    return F.to_json(F.struct(*sorted(columns or df.columns)))


def encoded_size(json: Column) -> Column:
    return F.octet_length(json)


def without_defaults(df: DataFrame, defaults: dict) -> Column:
    """Canonical JSON of the columns that differ from their defaults."""
    kept = [F.nullif(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in sorted(df.columns)]
    return F.to_json(F.struct(*kept))


def nested_count(sections: Column, items: str) -> Column:
    """How many items all sections have together."""
    return F.aggregate(sections, F.lit(0), lambda acc, s: acc + F.coalesce(F.size(s[items]), F.lit(0)))


def positions(sections: Column, items: str) -> Column:
    """Items of all sections with a running number from 1."""
    flat = F.flatten(F.transform(sections, lambda s: s[items]))
    return F.transform(flat, lambda x, i: F.struct((i + 1).alias("number"), x.alias("item")))
