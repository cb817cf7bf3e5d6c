"""Validators: rules on records, catalogs, documents' shapes, users' content, preferences, pages before reuse, and plans read back.

Rules are named conditions that must hold (see audit.violations), so a validator is one column, and what breaks is data.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions.parse import SAFE_ID, canonical_url, ease, quick, stable_key, url_id
from .audit import IntegrityError
from .merge import patch

DEEPEST = 20
LATEST_MILLIS = 253402300799999


def record_rules(c: dict[str, Column], hosts: tuple[str, ...] | None = None) -> dict[str, Column]:
    """Rules of a record by the columns it has: id, title, url, rating, minutes (total), parts (their sum), preparations, steps, ease, quick, labels."""
    known = lambda x: x.isNull() | (x >= 0)
    rules = {
        "id": lambda: c["id"].cast("string").rlike(SAFE_ID),
        "title": lambda: F.length(F.trim(c["title"])).between(1, 300),
        "url": lambda: c["url"].isNull() | (canonical_url(c["url"], hosts) == c["url"]),
        "rating": lambda: ~F.isnan(c["rating"]) & c["rating"].between(0, 10),
        "minutes": lambda: known(c["minutes"]) & (c["minutes"] < 60 * 24 * 366),
        "parts": lambda: (c["minutes"] == 0) | (c["minutes"] >= c["parts"]),
        "ease": lambda: c["ease"] == ease(c["preparations"], c["steps"]),
        "quick": lambda: c["quick"] == quick(c["minutes"]),
        "labels": lambda: (F.size(F.array_distinct(c["labels"])) == F.size(c["labels"])) & ~F.exists(c["labels"], lambda x: x.isNull() | (F.trim(x) == "")),
    }
    needs = {"parts": ("minutes", "parts"), "ease": ("ease", "preparations", "steps"), "quick": ("quick", "minutes")}
    return {name: rule() for name, rule in rules.items() if all(x in c for x in needs.get(name, (name,)))}


def whole_record_rules(c: dict[str, Column], language: str, hosts: tuple[str, ...], path: str, most: dict[str, int] | None = None) -> dict[str, Column]:
    """Rules of a whole record beyond record_rules, by the columns it has: what is stored must be what is derived from the rest.

    language; canonical (of url, of a host, its path by a pattern whose group is provider_id); identity (id is the provider's);
    key (stable_key of the id); prep, cook and total (whole minutes up to their most; the total is at least known parts' sum and
    no more than it where both are known); preparations and counts (steps of sections, (title, steps)); sections (with steps, none
    of them blank); images and videos (https, none twice); created and updated (in order); rating10 (rating rescaled from five);
    nutrition (amounts that aren't negative).
    """
    most = {"prep": 10_080, "cook": 10_080, "total": 20_160, "preparations": 100, "steps": 1_000} | (most or {})
    known = lambda x: F.coalesce(x, F.lit(0))
    whole = lambda name: lambda: c[name].isNull() | (c[name].between(0, most[name]) & (c[name] == F.floor(c[name])))
    once = lambda name: lambda: c[name].isNull() | ((F.size(F.array_distinct(c[name])) == F.size(c[name])) & F.forall(c[name], lambda u: u.rlike(r"^https://[^/?#\s]+/")))
    parts = lambda: known(c["prep"]) + known(c["cook"])
    rules = {
        "language": lambda: c["language"] == language,
        "canonical": lambda: canonical_url(c["url"], hosts, path).eqNullSafe(c["canonical"]) & c["canonical"].isNotNull(),
        "identity": lambda: (c["id"].cast("string") == c["provider_id"].cast("string")) & (url_id(c["url"], path) == c["id"].cast("string")),
        "key": lambda: c["key"] == stable_key(c["id"].cast("string")),
        "prep": whole("prep"), "cook": whole("cook"), "preparations": whole("preparations"),
        "total": lambda: whole("total")() & ((known(c["total"]) == 0) | F.when((known(c["prep"]) > 0) & (known(c["cook"]) > 0), c["total"] == parts()).otherwise(c["total"] >= parts())),
        "counts": lambda: c["steps"].between(0, most["steps"]) & (c["steps"] == F.aggregate(c["sections"], F.lit(0), lambda n, s: n + F.size(s["steps"]))),
        "sections": lambda: F.forall(c["sections"], lambda s: (F.size(s["steps"]) > 0) & F.forall(s["steps"], lambda t: F.trim(t) != "")),
        "images": once("images"), "videos": once("videos"),
        "updated": lambda: c["created"].isNull() | c["updated"].isNull() | (c["created"] <= c["updated"]),
        "rating10": lambda: c["rating"].between(0, 5) & (F.abs(c["rating10"] - 2 * c["rating"]) < 1e-9),
        "nutrition": lambda: F.forall(F.map_values(c["nutrition"]), lambda x: x.isNull() | (x >= 0)),
    }
    needs = {"canonical": ("url", "canonical"), "identity": ("id", "provider_id", "url"), "key": ("key", "id"), "total": ("total", "prep", "cook"), "counts": ("steps", "sections"), "updated": ("created", "updated"), "rating10": ("rating", "rating10")}
    return {name: rule() for name, rule in rules.items() if all(x in c for x in needs.get(name, (name,)))}


def unknown_fields(schema: StructType, allowed: set[str]) -> list[str]:
    return sorted(f for f in schema.fieldNames() if f not in allowed)


def shape_problems(kind: DataType, path: str = "", depth: int = 1, deepest: int = DEEPEST) -> list[str]:
    """Places of a type that lie too deep, and arrays directly in arrays. A schema tells it for all rows."""
    if depth > deepest:
        return [f"{path}: deeper than {deepest}"]
    if isinstance(kind, StructType):
        return [p for f in kind for p in shape_problems(f.dataType, f"{path}.{f.name}".lstrip("."), depth + 1, deepest)]
    if isinstance(kind, MapType):
        return shape_problems(kind.valueType, f"{path}{{}}", depth + 1, deepest)
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        own = [f"{path}: an array in an array"] if isinstance(inner, ArrayType) else []
        return own + shape_problems(inner, f"{path}[]", depth + 1, deepest)
    return []


def json_depth(text: Column) -> Column:
    """How deep the containers of a JSON text lie in each other; braces in its strings don't count."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r'"(?:[^"\\]|\\.)*"', "")
    signs = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    step = lambda acc, s: F.struct(
        (acc["now"] + F.when(s.isin("{", "["), 1).when(s.isin("}", "]"), -1).otherwise(0)).alias("now"),
        F.greatest(acc["most"], acc["now"] + F.when(s.isin("{", "["), 1).otherwise(0)).alias("most"),
    )
    return F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def array_in_array(text: Column) -> Column:
    """A JSON text has an array directly in an array, at any place of it. The containers that are open are a text of their signs."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r'"(?:[^"\\]|\\.)*"', "")
    signs = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    opened = lambda acc, s: F.struct(F.concat(acc["open"], s).alias("open"), (acc["found"] | ((s == "[") & acc["open"].endswith("["))).alias("found"))
    closed = lambda acc: F.struct(F.substring(acc["open"], F.lit(1), F.length(acc["open"]) - 1).alias("open"), acc["found"].alias("found"))
    step = lambda acc, s: F.when(s.isin("[", "{"), opened(acc, s)).when(s.isin("]", "}"), closed(acc)).otherwise(acc)
    return F.aggregate(signs, F.struct(F.lit("").alias("open"), F.lit(False).alias("found")), step)["found"]


def catalog_problems(df: DataFrame, key: str, provider: str, full: Column) -> DataFrame:
    """(problem, n) of a catalog: no rows, ids that repeat, several providers, lean rows among full ones."""
    each = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    whole = df.agg(F.count("*").alias("rows"), F.count_distinct(provider).alias("providers"), F.count_if(full).alias("full"))
    found = whole.crossJoin(F.broadcast(each))  # one row each
    problems = {
        "empty": F.when(F.col("rows") == 0, 1),
        "repeated ids": F.when(F.col("repeated") > 0, F.col("repeated")),
        "several providers": F.when(F.col("providers") > 1, F.col("providers")),
        "mixed": F.when((F.col("full") > 0) & (F.col("full") < F.col("rows")), F.col("rows") - F.col("full")),
    }
    rows = F.array(*(F.struct(F.lit(name).alias("problem"), n.cast("long").alias("n")) for name, n in problems.items()))
    return found.select(F.explode(rows).alias("x")).select("x.*").filter(F.col("n").isNotNull())


def content_rules(text: Column, most: int, millis: Column | None = None, amount: Column | None = None, most_amount: float = 1e6) -> dict[str, Column]:
    """Rules of what users write: not blank, not too long, no control characters but tabs and line ends, times within bounds, amounts within range."""
    rules = {"blank": F.trim(F.regexp_replace(text, r"\s+", " ")) != "", "long": F.length(text) <= most, "control": ~text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")}
    if millis is not None:
        rules["time"] = millis.between(1, LATEST_MILLIS)
    if amount is not None:
        rules["amount"] = ~F.isnan(amount) & amount.between(0, most_amount)
    return rules


def valid_or_null(document: Column, *rules: Column) -> Column:
    """A document that breaks a rule reads as absent."""
    return F.when(reduce(and_, (F.coalesce(r, F.lit(False)) for r in rules)), document)


def preference_rules(weekdays: Column, categories: Column, sources: Column, known_categories: list[str], known_sources: list[str], most: int = 50) -> list[Column]:
    """Weekdays 1 to 7, categories and sources that are known, none twice, and not too many."""
    rules = [F.forall(weekdays, lambda d: d.between(1, 7)), F.size(F.array_distinct(weekdays)) == F.size(weekdays)]
    among = lambda known: lambda x: x.isin(*known)
    for names, known in ((categories, known_categories), (sources, known_sources)):
        rules += [F.forall(names, among(known)), F.size(F.array_distinct(names)) == F.size(names), F.size(names) <= most]
    return rules


def checkpoint_rules(c: dict[str, Column], hosts: tuple[str, ...], lang: str) -> dict[str, Column]:
    """What a stored page must be before it is used again: its own id, an address of a known host, the time that discovery tells, and the language."""
    return {"identity": c["id"] == c["expected_id"], "url": canonical_url(c["url"], hosts).isNotNull(), "lastmod": c["lastmod"].eqNullSafe(c["expected_lastmod"]), "lang": F.lower(c["lang"]) == lang}


def unapplied(target: DataFrame, live: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The patches that are still to be made after a plan was carried out: none, if it was."""
    return patch(target, live, key, fields)


def require_plan(version: str, expected_version: str, fields: list[str], mask: set[str], written: int, planned: int) -> None:
    """Raises if a plan is of another vocabulary, changes fields beyond its mask, or is incomplete."""
    if version != expected_version:
        raise IntegrityError(f"vocabulary {version}, not {expected_version}")
    if beyond := sorted(set(fields) - mask):
        raise IntegrityError(f"fields beyond the mask: {beyond}")
    if written != planned:
        raise IntegrityError(f"{written} of {planned} writes")
