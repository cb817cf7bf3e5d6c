"""Personal records: their codec, notes and lists, content of a day, legacy histories, completions written back to plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_token


def encoded(rows: DataFrame, owner: str, collection: str, key: Column, time: Column, fields: list[str]) -> DataFrame:
    """(owner, collection, document_id, payload, time): an entity as a keyed row of canonical JSON, its fields in order of their names."""
    return rows.select(F.col(owner).alias("owner"), F.lit(collection).alias("collection"), key.cast("string").alias("document_id"), F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}).alias("payload"), time.alias("time"))


def decoded(rows: DataFrame, collection: str, schema: str) -> DataFrame:
    """The entities of a collection; tombstones and what can't be read are left out."""
    own = rows.filter((F.col("collection") == collection) & F.col("payload").isNotNull())
    return own.select("owner", "document_id", "time", F.from_json("payload", schema, {"mode": "PERMISSIVE"}).alias("x")).filter(F.col("x").isNotNull()).select("owner", "document_id", "time", "x.*")


def with_notes(items: DataFrame, notes: DataFrame, key: str, text: str, time: str) -> DataFrame:
    """items with their note, the newest where there are several."""
    newest = notes.groupBy(key).agg(F.max_by(text, time).alias("note"))
    return items.join(newest, key, "left")


def list_members(lists: DataFrame, favourites: DataFrame, list_key: str, item: str) -> DataFrame:
    """(list, items, n): of the items (an array) of each list those that are favourites still, in their order."""
    placed = lists.select(list_key, F.posexplode_outer(item + "s").alias("place", item))
    held = placed.join(favourites.select(F.col(item).alias("_held")).distinct(), F.col(item) == F.col("_held"), "left")
    own = F.array_sort(F.collect_list(F.when(F.col("_held").isNotNull(), F.struct("place", item))))
    return held.groupBy(list_key).agg(F.transform(own, lambda x: x[item]).alias(item + "s")).withColumn("n", F.size(item + "s"))


def unique_name(name: Column, most: int = 40) -> Column:
    """A list's name: white space as single spaces, cut to a length."""
    return F.trim(F.substring(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")), 1, most))


def name_faults(lists: DataFrame, owner: str, name: str, reserved: str) -> DataFrame:
    """(owner, token, fault): names of an owner that are blank, reserved or, letters and accents folded, the same."""
    tokens = lists.select(owner, search_token(unique_name(F.col(name))).alias("token"))
    each = tokens.groupBy(owner, "token").agg(F.count("*").alias("n"))
    fault = F.when(F.col("token") == "", "blank").when(F.col("token") == search_token(F.lit(reserved)), "reserved").when(F.col("n") > 1, "repeated")
    return each.select(owner, "token", fault.alias("fault")).filter(F.col("fault").isNotNull())


def today_content(plans: DataFrame, items: DataFrame, date: str, item: str, today: Column) -> DataFrame:
    """Today's plans with the title and image of their item; what an item lacks is the plan's own."""
    now = plans.filter(F.col(date) == today)
    found = items.select(item, F.col("title").alias("_title"), F.col("image").alias("_image"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return now.join(found, item, "left").withColumn("title", F.coalesce(blank(F.col("_title")), "title")).withColumn("image", F.coalesce(blank(F.col("_image")), "image")).drop("_title", "_image")


def resolved_category(aliases: dict[str, str], *choices: Column) -> Column:
    """The first of the choices that isn't blank, under the name that aliases give it."""
    first = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in choices))
    table = F.create_map(*(F.lit(x) for p in sorted(aliases.items()) for x in p))
    return F.coalesce(table[first], first)


def completed_in(history: DataFrame, done: Column, date: str, month: Column) -> DataFrame:
    """What was done in a month. Its order, latest first, belongs to the page that shows it."""
    first = F.trunc(month, "MM")
    return history.filter(done & (F.col(date) >= first) & (F.col(date) < F.add_months(first, 1)))


def remapped(history: DataFrame, plans: DataFrame, key: str, payload: str, reference: str) -> tuple[DataFrame, DataFrame]:
    """History rows whose id another payload has too under ids of their own, and plans whose references (id and payload) follow them."""
    first = F.min(payload).over(Window.partitionBy(key))
    own = F.concat(F.col(key), F.lit("_"), F.substring(F.sha2(F.concat_ws("|", F.col(key), F.col(payload)), 256), 1, 16))
    renamed = history.withColumn("renamed", F.when(F.col(payload) == first, F.col(key)).otherwise(own)).dropDuplicates(["renamed"])
    moves = renamed.filter(F.col("renamed") != F.col(key)).select(F.col(key).alias(reference), payload, "renamed")
    follow = plans.join(moves, [reference, payload], "left").withColumn(reference, F.coalesce("renamed", reference)).drop("renamed")
    return renamed.drop(key).withColumnRenamed("renamed", key), follow


def normalized_history(events: DataFrame, plans: DataFrame, owner: str, date: str, item: str) -> DataFrame:
    """(owner, date, item, event_id, made): events under stable ids, from a hash of what they are, and one made for each completed plan that has none."""
    stable = lambda: F.concat(F.lit("cooked_"), F.substring(F.sha2(F.concat_ws("|", F.col(owner).cast("string"), F.col(date).cast("string"), F.col(item).cast("string")), 256), 1, 32))
    own = events.select(owner, date, item).distinct().withColumn("event_id", stable()).withColumn("made", F.lit(False))
    lacking = plans.filter("completed").select(owner, date, item).distinct().join(own, [owner, date, item], "left_anti")
    return own.unionByName(lacking.withColumn("event_id", stable()).withColumn("made", F.lit(True)))


def completed_courses(toggles: DataFrame, plans: DataFrame, keys: list[str], place: str) -> tuple[DataFrame, DataFrame]:
    """plans with completed (an odd number of toggles turns it round) and event_id, and the history rows of those that are done: each toggle either adds one or takes it away."""
    n = toggles.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(place).alias("_last"))
    done = F.col("completed") != (F.coalesce(F.col("_n"), F.lit(0)) % 2 == 1)
    out = plans.join(n, keys, "left").withColumn("completed", done)
    event = F.concat(F.lit("cooked_"), F.substring(F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.col("_last").cast("string")), 256), 1, 32))
    out = out.withColumn("event_id", F.when(F.col("completed") & F.col("_last").isNotNull(), event).otherwise("")).drop("_n", "_last")
    return out, out.filter("completed").select(*keys, "event_id")


def toggled_category(available: Column, excluded: Column, key: Column) -> Column:
    """Excluded categories after one was tapped. From all shown, it alone stays; else it goes in or out of those shown; none or all shown means none excluded."""
    shown = F.array_except(available, excluded)
    shown = F.when(F.size(shown) == 0, available).otherwise(shown)
    all_ = F.size(shown) == F.size(available)
    next_ = F.when(all_, F.array(key)).when(F.array_contains(shown, key), F.array_except(shown, F.array(key))).otherwise(F.array_union(shown, F.array(key)))
    none = F.array().cast("array<string>")
    left = F.when((F.size(next_) == 0) | (F.size(next_) == F.size(available)), none).otherwise(F.array_except(available, next_))
    return F.when(F.array_contains(available, key), left).otherwise(excluded)


def vegan_reconciled(available: Column, excluded: Column, incompatible: list[str]) -> Column:
    """Excluded categories when only vegan ones are wanted: an explicit choice keeps what is compatible; where nothing would be, none is excluded."""
    shown = F.array_except(available, excluded)
    shown = F.when(F.size(shown) == 0, available).otherwise(shown)
    left = F.array_except(shown, F.array(*map(F.lit, incompatible)))
    none = F.array().cast("array<string>")
    return F.when(F.size(excluded) == 0, excluded).when(F.size(left) == 0, none).otherwise(F.array_except(available, left))
