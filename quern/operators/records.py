"""Joins and rules of personal and published records: enrichment, positional alignment, guarded commits, conflicts, chunks, taxonomies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import SAFE_ID
from ..sources.shared import kept


def enriched(events: DataFrame, items: DataFrame, plans: DataFrame, item: str, date: str) -> DataFrame:
    """Events with the title of their item, else the one planned for their date, else their own. Events without a date go."""
    dated = events.filter(F.col(date).isNotNull())
    named = items.select(F.col(item), F.col("title").alias("item_title"))
    planned = plans.select(F.col(date), F.col("title").alias("plan_title")).dropDuplicates([date])
    out = dated.join(named, item, "left").join(planned, date, "left")
    return out.withColumn("title", F.coalesce(F.nullif(F.col("item_title"), F.lit("")), "plan_title", "title")).drop("item_title", "plan_title")


def favourites(items: DataFrame, favourite: DataFrame, key: str) -> DataFrame:
    """Items that are favourites, with what the favourite's row has; of repeated favourites one."""
    return items.join(favourite.dropDuplicates([key]), key)


def own_over_shared(own: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """Of each key the own row, else the shared one."""
    return own.unionByName(shared.join(own.select(key), key, "left_anti"))


def associations(pairs: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facet, option, id) turned round: (id, facet, options), and the ids that aren't active."""
    unknown = pairs.select("id").distinct().join(active.select("id"), "id", "left_anti")
    known = pairs.join(active.select("id"), "id", "left_semi").groupBy("id", "facet").agg(F.array_sort(F.collect_set("option")).alias("options"))
    return known, unknown


def aligned(left: Column, right: Column) -> Column:
    """Pairs of two lists by place; none where their lengths differ."""
    pairs = F.arrays_zip(left.alias("left"), right.alias("right"))
    placed = F.transform(pairs, lambda x, i: F.struct((i + 1).alias("place"), x["left"].alias("left"), x["right"].alias("right")))
    return F.when((F.size(left) == F.size(right)) & (F.size(left) > 0), placed)


def baseline(found: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(name, found, expected) of the numbers of a one-row frame that aren't what a manifest says."""
    names = sorted(expected)
    rows = found.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("found"), F.lit(expected[n]).cast("long").alias("expected")) for n in names))).alias("x")).select("x.*")
    return rows.filter(~F.col("found").eqNullSafe(F.col("expected")))


def guarded_commit(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """(key, outcome): a change is applied if the row still has the version it was read with, else it is stale or missing."""
    now = table.select(key, F.col(version).alias("now"))
    outcome = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col(version), "applied").otherwise("stale")
    return changes.join(now, key, "left").select(key, outcome.alias("outcome"))


def matched_completions(events: DataFrame, courses: DataFrame) -> DataFrame:
    """Events of the same date, item and time as a course, whose event id is the same or blank."""
    c = courses.select("date", "item", "time", F.col("event_id").alias("course_event"))
    return events.join(c, ["date", "item", "time"]).filter((F.col("course_event") == F.col("event_id")) | (F.coalesce("course_event", F.lit("")) == ""))


def conflicts_renamed(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows whose key another payload has too get a key of their own, from a hash of both; the first payload keeps it."""
    first = F.min(payload).over(Window.partitionBy(key))
    renamed = F.when(F.col(payload) == first, F.col(key)).otherwise(F.concat(F.col(key), F.lit("_"), F.substring(F.sha2(F.concat_ws("|", F.col(key), F.col(payload)), 256), 1, 16)))
    return rows.withColumn("renamed", renamed).dropDuplicates(["renamed"])


def _next_starts(cost: np.ndarray, limits: np.ndarray, most_rows: int) -> np.ndarray:
    """Of each row, if a chunk begins with it, the row with which the next one does. cost: a column of costs for each limit."""
    n = len(cost)
    out = np.minimum(np.arange(n) + most_rows, n)
    for k, limit in enumerate(limits):
        total = np.concatenate([np.zeros(1, cost.dtype), np.cumsum(cost[:, k])])
        out = np.minimum(out, np.searchsorted(total, total[:-1] + limit, side="right") - 1)
    return np.maximum(out, np.arange(n) + 1)  # a row beyond a limit is a chunk by itself


def _doubled(step: np.ndarray, until: int) -> np.ndarray:
    """Of each row, the first row from `until` on that its chain of next rows comes to, by doubling the chain's length."""
    out = np.append(step, [len(step)])
    while (short := out[:-1] < until).any():
        out[:-1] = np.where(short, out[out[:-1]], out[:-1])
    return out[:-1]


def greedy_chunks(rows: DataFrame, group: str, key: str, costs: dict[str, int], most_rows: int, width: int = 100_000) -> DataFrame:
    """rows with chunk, from 0 in each group: in order of a unique whole number, a row joins the chunk before it unless that has most_rows rows or a sum of costs would pass its limit (column -> limit); so only a chunk of one row can be beyond a limit.

    Where chunks begin depends on all rows before, but a range of rows is left through one of most_rows places of the next one,
    whatever was before: ranges are tables from the place of their first chunk to that of the next range's. These are composed
    by doubling, from ranges to pairs, fours and so on, and the places that come out are the only thing that ranges need to
    know of each other. Rows are numbered from counts of spans of keys; a range has the rows of a task, with most_rows more.
    """
    width = max(width, most_rows)
    names = sorted(costs)
    limits = np.array([costs[c] for c in names], np.int64)
    span = F.floor(F.col(key) / width)
    earlier = Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(group, span.alias("_span")).agg(F.count("*").alias("_n")).select(group, "_span", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_span").orderBy(key)) - 1
    placed = rows.select(group, key, span.alias("_span"), *(F.col(c).cast("long").alias(f"_c{k}") for k, c in enumerate(names))).withColumn("_within", within)
    same = [F.col(group).eqNullSafe(F.col("_of")), F.col("_span") == F.col("_at")]
    placed = placed.join(counts.select(F.col(group).alias("_of"), F.col("_span").alias("_at"), "_before"), same).withColumn("_row", F.col("_before") + F.col("_within")).drop("_of", "_at", "_span", "_before", "_within")
    own = F.floor(F.col("_row") / width)
    shared = F.when((F.col("_row") % width < most_rows) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))  # the first rows of a range end the one before, too
    spread = placed.withColumn("_range", F.explode(shared))
    kind = rows.schema[group].dataType.simpleString()

    def costs_of(part: pd.DataFrame) -> np.ndarray:
        return part[[f"_c{k}" for k in range(len(names))]].fillna(0).to_numpy(np.int64).reshape(len(part), len(names))

    def exits(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row")
        own = int((part["_row"] // width == part["_range"]).sum())
        out = _doubled(_next_starts(costs_of(part), limits, most_rows), own)[: min(most_rows, own)] - own
        return pd.DataFrame({group: part[group].iloc[:1], "_range": part["_range"].iloc[:1], "_exits": [out.tolist()]})

    tables = spread.groupBy(group, "_range").applyInPandas(exits, f"{group} {kind}, _range long, _exits array<int>")
    entries = _entries(kept(tables.withColumn("_group", F.xxhash64(group)), "ranges"))

    def numbered(keys: tuple, part: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row")
        step = _next_starts(costs_of(part), limits, most_rows)
        start = np.zeros(len(part), np.int64)
        at = int(entry["_entry"].iloc[0]) if len(entry) else len(part)
        while at < len(part):
            start[at] = 1
            at = int(step[at])
        own = (part["_row"] // width == part["_range"]).to_numpy()
        return pd.DataFrame({group: part[group], key: part[key], "_range": part["_range"], "_nth": start.cumsum(), "_starts": int(start[own].sum())})[own]

    key_kind = rows.schema[key].dataType.simpleString()
    found = spread.withColumn("_group", F.xxhash64(group)).groupBy("_group", "_range").cogroup(entries.groupBy("_group", "_range")).applyInPandas(numbered, f"{group} {kind}, {key} {key_kind}, _range long, _nth long, _starts long")
    found = kept(found, "chunks")
    each = found.groupBy(group, "_range").agg(F.max("_starts").alias("_n"))
    base = each.select(F.col(group).alias("_of"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    chunk = (F.col("_base") + F.col("_nth") - 1).cast("int").alias("chunk")
    numbers = found.join(base, [F.col(group).eqNullSafe(F.col("_of")), F.col("_range") == F.col("_at")]).select(F.col(group).alias("_of"), F.col(key).alias("_key"), chunk)
    return rows.join(numbers, [F.col(group).eqNullSafe(F.col("_of")), F.col(key) == F.col("_key")]).drop("_of", "_key")


def _entries(tables: DataFrame) -> DataFrame:
    """(_group, _range, _entry): the place in each range where its first chunk begins, from the ranges' tables. Round k composes tables of 2**k ranges, and gives the entries of twice as many."""
    last = tables.agg(F.max("_range")).first()[0] or 0  # one number
    known = tables.filter("_range = 0").select("_group", F.col("_range").cast("long").alias("_range"), F.lit(0).alias("_entry"))
    steps, k = tables.select("_group", "_range", "_exits"), 0
    while last >> k:
        reached = known.join(steps, ["_group", "_range"]).select("_group", (F.col("_range") + (1 << k)).alias("_range"), F.get("_exits", F.col("_entry")).alias("_entry"))
        known = kept(known.unionAll(reached.filter(F.col("_entry").isNotNull())), "entries")
        after = steps.select("_group", (F.col("_range") - (1 << k)).alias("_range"), F.col("_exits").alias("_then"))
        steps = kept(steps.join(after, ["_group", "_range"]).select("_group", "_range", F.transform("_exits", lambda x: F.get("_then", x)).alias("_exits")), "ranges")
        k += 1
    return known


def sync_status(recovering: Column, failed: Column, ready: Column, pending: Column) -> Column:
    """The first that holds: recovering, error, connecting, pending, synced."""
    return F.when(recovering, "recovering").when(failed, "error").when(~ready, "connecting").when(pending > 0, "pending").otherwise("synced")


def backoff_seconds(attempt: Column) -> Column:
    """5, 10, 20, and then 30."""
    return F.least(F.lit(30), F.lit(5) * F.pow(F.lit(2), F.least(attempt, F.lit(10)))).cast("int")


def usable_plan(completed: Column, locked: Column, filters_match: Column, favourite: Column, preferred: Column) -> Column:
    """Done or kept; else what the filters match, is a favourite and agrees with the preferences."""
    return completed | locked | (filters_match & favourite & F.coalesce(preferred, F.lit(False)))


def safe_id(key: Column) -> Column:
    return F.coalesce(key.rlike(SAFE_ID), F.lit(False))


def moved_labels(labels: Column, moves: dict[str, str]) -> Column:
    """Labels without those that belong to another facet, and (in order) the facets they go to: struct(kept, moved)."""
    table = F.create_map(*(F.lit(x) for p in sorted(moves.items()) for x in p))
    return F.struct(F.filter(labels, lambda t: table[t].isNull()).alias("kept"), F.array_distinct(F.transform(F.filter(labels, lambda t: table[t].isNotNull()), lambda t: table[t])).alias("moved"))


def by_precedence(labels: Column, ranks: list[str], other: str) -> Column:
    """The label that comes first in a list of precedence; another where none does."""
    found = F.filter(F.array(*map(F.lit, ranks)), lambda r: F.array_contains(labels, r))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(other))


def split_labels(text: Column) -> Column:
    """Labels of a list written with commas, semicolons or bars."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,;|]"), lambda x: F.trim(x)), lambda x: x != "")


def included(available: Column, excluded: Column) -> Column:
    """What is left of the available; where nothing would be, all of it."""
    left = F.array_except(available, excluded)
    return F.when(F.size(left) == 0, available).otherwise(left)


def stale_guard(results: DataFrame, state: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Results whose context is still the state's, null being like null."""
    s = state.select(F.col(key).alias("state_key"), *(F.col(k).alias(f"state_{k}") for k in keys))
    test = F.col(key) == F.col("state_key")
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"state_{k}"))
    return results.join(s, test, "left_semi")


def decoded_list(blob: Column, item: str) -> Column:
    """The list that a JSON text holds; of a text that can't be read, none."""
    return F.coalesce(F.from_json(blob, f"array<{item}>"), F.array().cast(f"array<{item}>"))


def default_day(saved: Column, today: Column, planned: Column, month: Column) -> Column:
    """The saved day if it is of the month, else today if it is, else the first planned, else the month's first."""
    first = F.trunc(month, "MM")
    within = lambda d: F.when(F.trunc(d, "MM") == first, d)
    return F.coalesce(within(saved), within(today), planned, first)


def encoded_lists(rows: DataFrame, key: str, date: str, fields: list[str]) -> DataFrame:
    """(key, blob): a key's rows as a JSON list, newest date first and then in order of their other fields; rows without a date go. Lists are one owner's own, so small."""
    dated = rows.filter(F.trim(F.coalesce(F.col(date).cast("string"), F.lit(""))) != "")
    entry = F.struct(F.col(date).cast("string").alias("d"), F.to_json(F.struct(*sorted({date, *fields}))).alias("j"))
    newest = lambda a, b: F.when(a["d"] > b["d"], -1).when(a["d"] < b["d"], 1).when(a["j"] < b["j"], -1).when(a["j"] > b["j"], 1).otherwise(0)
    ordered = F.array_sort(F.collect_list(entry), newest)
    return dated.groupBy(key).agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["j"]), ","), F.lit("]")).alias("blob"))


def upload_order(changes: DataFrame, kind: str, removed: Column, kinds: list[str]) -> DataFrame:
    """changes with stage: what others refer to goes first and is removed last, so no reference dangles between two chunks."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    place = F.when(place == 0, len(kinds) + 1).otherwise(place)
    return changes.withColumn("stage", F.when(removed, 2 * len(kinds) + 2 - place).otherwise(place - 1).cast("int"))
