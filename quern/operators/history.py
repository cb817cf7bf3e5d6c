"""Histories and calendars: events joined with plans, months, weeks, grids, shopping groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_legacy(stored: DataFrame, plans: DataFrame, match: list[str], key: str, time: str) -> DataFrame:
    """Stored events, and one for each completed plan that has none; of a key one. Their order belongs to the page that shows them."""
    missing = plans.join(stored.select(*match), match, "left_anti")
    both = stored.withColumn("legacy", F.lit(False)).unionByName(missing.withColumn("legacy", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("legacy", F.desc(time))
    return both.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def by_month(events: DataFrame, time: str) -> DataFrame:
    return events.withColumn("month", F.date_format(time, "yyyy-MM"))


def week(df: DataFrame, any_day: Column) -> DataFrame:
    """The seven days, from Monday, of each row's week."""
    monday = F.date_trunc("week", any_day).cast("date")
    return df.withColumn("day", F.explode(F.sequence(monday, F.date_add(monday, 6))))


def month_grid(df: DataFrame, any_day: Column) -> DataFrame:
    """42 cells from the Monday on or before the month's first day; cells of other months have no day."""
    first = F.trunc(any_day, "MM")
    start = F.date_sub(first, F.weekday(first))
    out = df.select("*", first.alias("month_first"), F.posexplode(F.sequence(start, F.date_add(start, 41))).alias("cell", "date"))
    return out.withColumn("day", F.when(F.trunc("date", "MM") == F.col("month_first"), F.dayofmonth("date"))).drop("month_first")


def shopping_groups(items: DataFrame, group: str, title: str, checked: str) -> DataFrame:
    """Items of each group, unchecked first and by title, with counts; the group without a name sorts last."""
    entry = F.struct(F.col(checked).alias("checked"), F.col(title).alias("title"))
    out = items.groupBy(group).agg(F.array_sort(F.collect_list(entry)).alias("items"), F.count_if(~F.col(checked)).alias("pending"), F.count_if(F.col(checked)).alias("done"))
    return out.withColumn("nameless", (F.coalesce(F.trim(F.col(group).cast("string")), F.lit("")) == ""))


def retained(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group."""
    return df.withColumn("back", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("back") <= n).drop("back")


def settled(df: DataFrame, owner: str, value: str, time: str, quiet_ms: int = 275) -> DataFrame:
    """Values that stood for a while (a blank one needs none) and differ from the one before that did."""
    by = Window.partitionBy(owner).orderBy(time, "place")
    stood = F.lead(time).over(by).isNull() | ((F.unix_millis(F.lead(time).over(by).cast("timestamp")) - F.unix_millis(F.col(time).cast("timestamp"))) >= quiet_ms) | (F.trim(value) == "")
    kept = df.withColumn("stood", stood).filter("stood").drop("stood")
    before = F.lag(value).over(by)
    return kept.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col(value))).drop("before")


def current_generation(df: DataFrame, owner: str, generation: str) -> DataFrame:
    """Results of the newest request of each owner: older ones are superseded."""
    newest = df.groupBy(owner).agg(F.max(generation).alias(generation))
    return df.join(newest, [owner, generation], "left_semi")


def fresh(checked: Column, now: Column, days: int = 90) -> Column:
    """No new check is due; a clock that went back counts as due."""
    return F.coalesce((now >= checked) & (now < F.date_add(checked, days)), F.lit(False))


def reduced_state(df: DataFrame, group: str, failed: Column, ready: Column) -> DataFrame:
    """error if any failed; cloud if all are ready; else connecting."""
    state = F.when(F.bool_or(failed), "error").when(F.bool_and(ready), "cloud").otherwise("connecting")
    return df.groupBy(group).agg(state.alias("state"))


def completions(toggles: DataFrame, keys: list[str], time: str) -> DataFrame:
    """State of each key after all its toggles: done if there is an odd number; then since the last of them."""
    state = F.count("*") % 2 == 1
    return toggles.groupBy(*keys).agg(state.alias("done"), F.when(state, F.max(time)).alias("since"))


def combined_latest(frames: dict[str, DataFrame], owner: str, time: str) -> DataFrame:
    """At every change of one of several inputs (owner, time, place, value), the newest value of each: null before it has one."""
    rows = None
    for name, df in sorted(frames.items()):
        df = df.select(owner, time, "place", *(F.when(F.lit(n == name), F.col("value")).alias(n) for n in sorted(frames)))
        rows = df if rows is None else rows.unionByName(df)
    by = Window.partitionBy(owner).orderBy(time, "place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(owner, time, "place", *(F.last(n, ignorenulls=True).over(by).alias(n) for n in sorted(frames)))


def running_steps(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with step, their place in their group; groups are records' own lists, which are small."""
    return rows.withColumn("step", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def in_month(df: DataFrame, time: str, first: str) -> DataFrame:
    """Rows of the month that begins at a day, as a range of times, which reaches the scan."""
    start = F.lit(first).cast("date")
    return df.filter((F.col(time) >= start.cast("timestamp")) & (F.col(time) < F.add_months(start, 1).cast("timestamp")))


def month_with_own(events: DataFrame, own: DataFrame, time: str, first: str, on: Column) -> DataFrame:
    """A month's events, with one's own rows that they meet."""
    return in_month(events, time, first).join(own, on, "left")
