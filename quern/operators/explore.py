"""Faceted exploring: predicates from criteria, a ranking, and pages."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import active_in
from ..functions.parse import quick
from ..functions.text import contains_all, contains_words, starts_words

PAGE, LARGEST_PAGE = 24, 100


@dataclass(frozen=True)
class Preferences:
    """What is never shown: sources, categories (machine keys, compared as they are), rows with excluded ingredients."""

    excluded_sources: frozenset[str] = frozenset()
    excluded_categories: frozenset[str] = frozenset({"other"})
    excluded_tokens: frozenset[str] = frozenset()
    vegan_only: bool = False


@dataclass(frozen=True)
class Criteria:
    """0 and empty mean no condition. facets: group -> tokens, any of a group, all groups. terms: keyed title terms. language: rows must be active and of it, or of a region of it."""

    category: str = ""
    ease: str = ""
    min_rating: float = 0.0
    max_minutes: int = 0
    quick_only: bool = False
    sources: frozenset[str] = frozenset()
    terms: tuple[str, ...] = ()
    whole_words: bool = False
    facets: dict[str, frozenset[str]] = field(default_factory=dict)
    language: str = ""
    preferences: Preferences = Preferences(excluded_categories=frozenset())

    def valid(self, most_rating: float = 10.0) -> bool:
        return 0 <= self.min_rating <= most_rating and self.max_minutes >= 0


def known_only(q: Criteria, sources: frozenset[str], categories: frozenset[str]) -> Criteria:
    """Criteria without sources and categories that aren't known: a stale choice neither hides nor shows anything. Where all chosen sources are unknown, none is chosen."""
    p = q.preferences
    kept = replace(p, excluded_sources=p.excluded_sources & sources, excluded_categories=p.excluded_categories & categories)
    return replace(q, sources=q.sources & sources, preferences=kept)


def rating_above(rating: Column, least: float, most: float = 10.0) -> Column:
    """Strictly above, of ratings that are numbers within range; 0 is no condition."""
    return ~F.isnan(rating) & rating.between(0, most) & (rating > least) if least > 0 else F.lit(True)


def within_minutes(minutes: Column, most: int) -> Column:
    """Unknown times (0) never meet a limit."""
    return (minutes > 0) & (minutes <= most) if most > 0 else F.lit(True)


def any_of(tokens: Column, wanted: frozenset[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, sorted(wanted))))


def nowhere_in(texts: Column, tokens: frozenset[str]) -> Column:
    """No text holds any of the tokens."""
    return ~F.exists(texts, lambda t: reduce(or_, (F.contains(t, F.lit(x)) for x in sorted(tokens)), F.lit(False)))


def preferred(p: Preferences, c: dict[str, Column]) -> Column:
    tests = []
    if p.excluded_sources:
        tests.append(~c["source"].isin(*sorted(p.excluded_sources)))
    if p.excluded_categories:
        tests.append(~c["category"].isin(*sorted(p.excluded_categories)))
    if p.excluded_tokens:
        tests.append(nowhere_in(c["texts"], p.excluded_tokens))
    if p.vegan_only:
        tests.append(c["vegan"])
    return reduce(and_, tests, F.lit(True))


def predicate(q: Criteria, c: dict[str, Column], most_rating: float = 10.0) -> Column:
    """The condition of some criteria on columns named category, ease, rating, minutes, source, title_key, facets, texts, vegan, active, language. Only those that are asked for need be there."""
    tests = [preferred(q.preferences, c)]
    if q.language:
        tests.append(active_in(c["active"], c["language"], q.language))
    if q.category:
        tests.append(c["category"] == q.category)
    if q.ease:
        tests.append(c["ease"] == q.ease)
    if q.min_rating:
        tests.append(rating_above(c["rating"], q.min_rating, most_rating))
    if q.max_minutes:
        tests.append(within_minutes(c["minutes"], q.max_minutes))
    if q.quick_only:
        tests.append(quick(c["minutes"]))
    if q.sources:
        tests.append(c["source"].isin(*sorted(q.sources)))
    if q.terms:
        tests.append((contains_words if q.whole_words else contains_all)(c["title_key"], list(q.terms)))
    for group, wanted in sorted(q.facets.items()):
        tests.append(any_of(c[group], wanted))
    return reduce(and_, tests)


def ranking(q: Criteria, c: dict[str, Column]) -> list[Column]:
    """Titles whose words begin with the terms come first, then by rating, title and id."""
    first = [starts_words(c["title_key"], list(q.terms)).desc()] if q.terms else []
    return [*first, c["rating"].desc(), c["title_key"].asc(), c["id"].asc()]


def page(df: DataFrame, order: list[Column], limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page in an order that has no ties."""
    if not 1 <= limit <= LARGEST_PAGE or offset < 0:
        raise ValueError(f"a page has 1 to {LARGEST_PAGE} rows from a place of 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def counted_page(df: DataFrame, order: list[Column], limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page whose rows tell how many there are in all (total) and whether more follow (has_more). The rows are counted by themselves, without sorting them."""
    total = df.count()
    return page(df, order, limit, offset).withColumn("total", F.lit(total).cast("long")).withColumn("has_more", F.lit(offset + limit < total))


def explore(df: DataFrame, q: Criteria, columns: dict[str, Column], limit: int = PAGE, offset: int = 0, most_rating: float = 10.0) -> DataFrame:
    """A ranked page; criteria that aren't valid give an empty one, never a wider one."""
    found = df.filter(predicate(q, columns, most_rating)) if q.valid(most_rating) else df.limit(0)
    return page(found, ranking(q, columns), limit, offset)


def own_first(own: DataFrame, shared: DataFrame, order: list[str], limit: int = PAGE, offset: int = 0) -> DataFrame:
    """Pages that go through one's own rows first and then through the shared ones."""
    both = own.withColumn("part", F.lit(0)).unionByName(shared.withColumn("part", F.lit(1)))
    return page(both, [F.col("part"), *map(F.col, order)], limit, offset)
