"""Weekly plans as states: what is locked, completed or on a blank day stays; other cells get choices of their own.

A cell is (date, course, category, locked, completed, blank, item); blank days are empty on purpose. Each choice depends on a
seed, its cell and a draw alone, so it doesn't matter in which order, or where, cells are filled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

MAIN = "main"


def kept_cell() -> Column:
    """Completed or locked, or of a day that is blank on purpose."""
    return F.coalesce(F.col("locked"), F.lit(False)) | F.coalesce(F.col("completed"), F.lit(False)) | F.coalesce(F.col("blank"), F.lit(False))


def cell_place(seed: int, draw: int, n: Column, course: Column | None = None) -> Column:
    """A place below n: 60 bits of the SHA-256 of seed, date, course and draw."""
    course = F.col("course") if course is None else course
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("date").cast("string"), course, F.lit(str(draw))), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n


def drawn(cells: DataFrame, candidates: DataFrame, seed: int, wanted: Column, draw: int = 0, place: Callable[[Column], Column] | None = None) -> DataFrame:
    """cells with an item of their category, from candidates (category, item), where it is wanted; null where the category has none.

    A category's candidates stand in order of a hash prefix and then of their item. Only counts by prefix are summed up, and only
    the candidates of the prefixes that cells point at are numbered, so a category may hold most of all candidates.
    """
    keyed = candidates.select("category", "item", F.substring(F.md5(F.col("item").cast("string")), 1, 3).alias("prefix"))
    by = Window.partitionBy("category").orderBy("prefix")  # at most 4,096 prefixes
    counts = keyed.groupBy("category", "prefix").agg(F.count("*").alias("n"))
    counts = counts.withColumn("start", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["start"])
    total = counts.groupBy("category").agg(F.sum("n").alias("total"))
    place = place or (lambda n: cell_place(seed, draw, n))
    asked = cells.filter(wanted).join(total, "category").withColumn("place", place(F.col("total"))).select("date", "course", "category", "place")
    spans = counts.select(F.col("category").alias("c"), "prefix", "start", (F.col("start") + F.col("n")).alias("stop"))
    asked = asked.join(spans, (F.col("category") == F.col("c")) & (F.col("place") >= F.col("start")) & (F.col("place") < F.col("stop")))
    asked = asked.select("date", "course", "category", "prefix", (F.col("place") - F.col("start")).alias("nth"))
    few = keyed.join(asked.select("category", "prefix").distinct(), ["category", "prefix"], "left_semi")
    numbered = few.withColumn("nth", (F.row_number().over(Window.partitionBy("category", "prefix").orderBy("item")) - 1).cast("long"))
    chosen = asked.join(numbered, ["category", "prefix", "nth"]).select("date", "course", F.col("item").alias("_chosen"))
    return cells.join(chosen, ["date", "course"], "left").withColumn("item", F.when(wanted, F.col("_chosen")).otherwise(F.col("item"))).drop("_chosen")


def ensured(cells: DataFrame, candidates: DataFrame, seed: int, usable: Column | None = None) -> DataFrame:
    """Main cells that are empty, or whose item can't be used any more, get one; saved side courses stay as they are."""
    lacking = F.col("item").isNull() if usable is None else F.col("item").isNull() | ~F.coalesce(usable, F.lit(False))
    return drawn(cells, candidates, seed, ~kept_cell() & (F.col("course") == MAIN) & lacking)


def rerolled_week(cells: DataFrame, candidates: DataFrame, seed: int, draw: int) -> DataFrame:
    """Every cell that isn't kept is drawn anew; what was there may come again, and a cell without candidates becomes empty."""
    return drawn(cells, candidates, seed, ~kept_cell(), draw)


def rerolled(cells: DataFrame, candidates: DataFrame, seed: int, draw: int, date: Column, course: str) -> DataFrame:
    """One cell is drawn anew, kept or not, since it is asked for. A day that was blank is so no more, unless nothing was found."""
    asked = (F.col("date") == date) & (F.col("course") == course)
    out = drawn(cells, candidates, seed, asked, draw)
    return out.withColumn("blank", F.col("blank") & ~(asked & F.col("item").isNotNull()))


def menu(cells: DataFrame, candidates: DataFrame, seed: int, date: Column) -> DataFrame:
    """The side courses of a day that are missing are drawn; saved ones are never redrawn, and a blank day stays blank."""
    missing = (F.col("date") == date) & (F.col("course") != MAIN) & F.col("item").isNull() & ~F.coalesce(F.col("blank"), F.lit(False))
    return drawn(cells, candidates, seed, missing)


def weekday_category(day: Column, defaults: dict[int, str], other: str) -> Column:
    """A category by weekday (Monday is 0)."""
    out = F.lit(other)
    for k, c in sorted(defaults.items()):
        out = F.when(F.weekday(day) == k, c).otherwise(out)
    return out


ANY = "any"
COURSES = (MAIN, "side", "dessert")


@dataclass(frozen=True)
class Choice:
    """What plans are drawn under. favourites: items that alone may be chosen, if any are given; week_excluded: items that favourites don't count as in a week; excluded_categories: never chosen; side_never: categories that a side of any category isn't of."""

    favourites: DataFrame | None = None
    week_excluded: DataFrame | None = None
    excluded_categories: tuple[str, ...] = ("other",)
    side_never: tuple[str, ...] = ("dessert",)


def pool(candidates: DataFrame, choice: Choice) -> DataFrame:
    """Candidates (item, category, ease, rating, minutes, for_side) that a choice leaves."""
    rows = candidates.filter(~F.col("category").isin(*choice.excluded_categories)) if choice.excluded_categories else candidates
    if choice.favourites is not None:
        rows = rows.join(choice.favourites.select("item").distinct(), "item", "left_semi")
        if choice.week_excluded is not None:
            rows = rows.join(choice.week_excluded.select("item").distinct(), "item", "left_anti")
    return rows


def filter_set(cells: DataFrame) -> DataFrame:
    """cells (date, course, category, ease, min_rating, max_minutes, ...) with _set: cells of equal filters have one, a side of any category one of its own."""
    side = (F.col("course") == "side") & (F.col("category") == ANY)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("category", "ease", "min_rating", "max_minutes")]
    return cells.withColumn("_set", F.concat_ws("|", *parts, side.cast("string")))


def matched(cells: DataFrame, candidates: DataFrame, choice: Choice) -> DataFrame:
    """(category: a filter set, item): every candidate by the sets that it meets. Sets and candidates meet by category, `any` being one that all have, so each set is counted once however many cells have it."""
    some = ("_set", "course", "category", "ease", "min_rating", "max_minutes")
    sets = cells.select(*some).withColumn("side", (F.col("course") == "side") & (F.col("category") == ANY)).drop("course").dropDuplicates(["_set"])
    sets = sets.select("_set", "side", "category", *(F.col(c).alias(f"_{c}") for c in ("ease", "min_rating", "max_minutes")))
    rows = pool(candidates, choice).withColumn("own", F.col("category")).withColumn("category", F.explode(F.array("category", F.lit(ANY))))
    least, most, ease = F.coalesce("_min_rating", F.lit(0.0)), F.coalesce("_max_minutes", F.lit(0)), F.coalesce("_ease", F.lit(""))
    meets = ((least <= 0) | (F.col("rating") > least)) & ((most <= 0) | ((F.col("minutes") > 0) & (F.col("minutes") <= most))) & (ease.isin("", ANY) | (F.col("ease") == ease))
    fits = ~F.col("side") | (F.coalesce("for_side", F.lit(False)) & ~F.col("own").isin(*choice.side_never, ""))
    return rows.join(sets, "category").filter(meets & fits).select(F.col("_set").alias("category"), "item").distinct()


def chosen(cells: DataFrame, sets: DataFrame, seed: int, wanted: Column, draw: int, course: str) -> DataFrame:
    """Cells of one course with an item of their filter set where it is wanted, not one of the day's other courses: the place that is drawn, or the next ones after it, around the end. Without one, null."""
    others = cells.filter(F.col("course") != course).groupBy("date").agg(F.collect_set("item").alias("_others"))
    tries = len(COURSES)  # each other course takes one away at most
    asked = cells.filter(wanted & (F.col("course") == course)).select("date", F.col("course").alias("_course"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("_try"), F.col("_set").alias("category"))
    asked = asked.select("date", F.concat_ws("#", "_course", "_try").alias("course"), "category", "_try", F.lit(None).cast("long").alias("item"))
    found = drawn(asked, sets, seed, F.lit(True), draw, place=lambda n: (cell_place(seed, draw, n, F.lit(course)) + F.col("_try")) % n)
    first = found.join(others, "date", "left").filter(F.col("item").isNotNull() & (~F.coalesce(F.array_contains("_others", F.col("item")), F.lit(False)) if course != MAIN else F.lit(True)))
    first = first.groupBy("date").agg(F.min_by("item", "_try").alias("_item"))
    hit = wanted & (F.col("course") == course)
    return cells.join(first, "date", "left").withColumn("item", F.when(hit, F.col("_item")).otherwise(F.col("item"))).drop("_item")


def planned(cells: DataFrame, candidates: DataFrame, seed: int, wanted: Column, choice: Choice = Choice(), draw: int = 0) -> DataFrame:
    """The cells that are wanted get items by their own filters, course by course, so that a side knows the main course of its day, and a dessert both."""
    rows = kept(filter_set(cells).withColumn("_wanted", F.coalesce(wanted, F.lit(False))), "cells")
    sets = kept(matched(rows.filter("_wanted"), candidates, choice), "sets")
    for course in COURSES:  # each needs the whole of the one before, several times
        rows = kept(chosen(rows, sets, seed, F.col("_wanted"), draw, course), "cells")
    return rows.drop("_set", "_wanted")


def reset(cells: DataFrame, weekdays: dict[str, set[int]], defaults: dict[str, dict[int, str]], other: str = ANY) -> DataFrame:
    """cells, with reset: of courses and weekdays (Monday is 0) that are to be reset, and neither done nor kept; these take the weekday's own category, by course. A side or dessert that isn't there isn't reset."""
    hit, category = F.lit(False), F.col("category")
    for course, days in weekdays.items():
        own = (F.col("course") == course) & F.weekday("date").isin(*sorted(days)) & ~kept_cell()
        own = own if course == MAIN else own & F.col("item").isNotNull()
        category = F.when(own, weekday_category(F.col("date"), defaults.get(course, {}), other)).otherwise(category)
        hit = hit | own
    return cells.withColumn("category", category).withColumn("reset", hit)


def ensured_week(cells: DataFrame, candidates: DataFrame, seed: int, usable: Column, weekdays: dict[str, set[int]], defaults: dict[str, dict[int, str]], choice: Choice = Choice(), draw: int = 0) -> DataFrame:
    """A week as it is opened: what is to be reset, and main courses that are missing or can't be used any more, are drawn; all else stays, blank days too."""
    rows = reset(cells, weekdays, defaults)
    lacking = (F.col("course") == MAIN) & (F.col("item").isNull() | ~F.coalesce(usable, F.lit(False))) & ~kept_cell()
    return planned(rows, candidates, seed, F.col("reset") | lacking, choice, draw).drop("reset")
