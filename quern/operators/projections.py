"""Shapes of records: documents, courses, nutrition, sections, search texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ordered_distinct, search_token


def effective_source(key: Column, url: Column, by_domain: dict[str, str]) -> Column:
    """A source's key: its own, else by domain, else the domain itself."""
    domain = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    named = domain
    for d, k in sorted(by_domain.items()):
        named = F.when(domain == d, k).otherwise(named)
    return F.coalesce(F.nullif(F.lower(F.trim(key)), F.lit("")), named)


def search_text(*parts: Column) -> Column:
    """Normalized parts, each once, in order."""
    keys = F.filter(F.transform(F.array(*parts), lambda p: search_token(p)), lambda t: t != "")
    return F.array_join(F.array_distinct(keys), " ")


def courses(plans: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """A row for each course of a plan that is set."""
    return plans.unpivot(keys, names, "course", "item").filter(F.col("item").isNotNull())


def plans(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """courses() back again."""
    return rows.groupBy(*keys).pivot("course", names).agg(F.first("item"))


def nutrients(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """A row for each nutrient of a record that has an amount."""
    return df.unpivot([key], names, "nutrient", "amount").filter(F.trim(F.col("amount").cast("string")) != "")


def without_repeats(values: Column) -> Column:
    """Labels, each once however it is written."""
    return ordered_distinct(values, search_token)


def documents(df: DataFrame, key: str, summary: list[str], hidden: list[str]) -> DataFrame:
    """(key, summary, detail): JSON of the short form, and of all but the hidden columns."""
    rest = [c for c in df.columns if c != key and c not in hidden]
    return df.select(key, F.to_json(F.struct(*sorted(summary))).alias("summary"), F.to_json(F.struct(*sorted(rest))).alias("detail"))


def payload_envelope(payload: Column, origin: dict[str, Column], version: int, active: Column) -> Column:
    """The third form of a document: what it was made from, whole, with where it is from. A missing payload has no envelope."""
    fields = origin | {"payload": payload, "schemaVersion": F.lit(version), "active": F.coalesce(active, F.lit(False))}
    return F.when(payload.isNotNull(), F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items()))), {"ignoreNullFields": "false"}))


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Memberships that are on after all toggles: those toggled an odd number of times."""
    return events.groupBy(*keys).agg(F.count("*").alias("toggles")).filter("toggles % 2 = 1")
