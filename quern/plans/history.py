"""Merging, history, calendars, planning and streams over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history as hi
from ..operators import merge as me
from ..operators import projections as pr
from .registry import query


def versions(table, odd: int) -> DataFrame:
    """Events as versions of (user, type): every other event is a deletion of it where its value is small."""
    e = table("events").filter(F.col("event_id") % 2 == odd)
    rows = e.select("user_id", "event_type", F.when(F.col("value") >= 5, F.col("value").cast("string")).alias("payload"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), "event_id")
    return me.latest(rows, ["user_id", "event_type"], [F.desc("time"), F.desc("event_id")])


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_per_key(table):
    return me.latest(table("events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, input DESC, event_id DESC) AS r FROM (
 SELECT user_id, event_id, ts, 0 AS input FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'view') WHERE k = 1
 UNION ALL SELECT user_id, event_id, ts, 1 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'click') WHERE k = 1)) WHERE r = 1""")
def last_write_wins(table):
    kinds = [me.latest(table("events").filter(F.col("event_type") == k), ["user_id"], [F.desc("ts"), F.desc("event_id")]).withColumn("day", F.date_trunc("day", "ts")) for k in ("view", "click")]
    return me.last_write_wins(kinds, ["user_id"], "day").select("user_id", "event_id")


_VERSIONS = """v AS (SELECT event_id % 2 AS odd, user_id, event_type, CASE WHEN value >= 5 THEN CAST(value AS VARCHAR) END AS payload, epoch_us(ts) AS time, event_id FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY odd, user_id, event_type ORDER BY time DESC, event_id DESC) AS r FROM v) WHERE r = 1),
a AS (SELECT * FROM l WHERE odd = 0), b AS (SELECT * FROM l WHERE odd = 1)"""


@query(f"""
WITH {_VERSIONS} SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type,
 CASE WHEN a.user_id IS NULL THEN b.event_id WHEN a.payload IS NULL THEN a.event_id WHEN b.time > a.time THEN b.event_id ELSE a.event_id END AS winner
FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def merge_tombstones(table):
    keys = ["user_id", "event_type"]
    rows = [versions(table, odd).select(*keys, F.col("payload"), "time", F.lit(None).cast("string").alias("revision"), F.lit(False).alias("observed"), F.lit(False).alias("imported"), "event_id") for odd in (0, 1)]
    merged = me.merge_snapshot(rows[0], rows[1], keys, authoritative=False)
    ids = rows[0].unionByName(rows[1]).select(*keys, "time", F.col("event_id").alias("winner"))
    return merged.select(*keys, "time").join(ids, [*keys, "time"]).select(*keys, "winner")


@query(f"""
WITH {_VERSIONS} SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, a.user_id IS NULL AS added, b.user_id IS NULL AS removed
FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE a.payload IS DISTINCT FROM b.payload OR a.user_id IS NULL OR b.user_id IS NULL""")
def mutation_log(table):
    keys = ["user_id", "event_type"]
    a, b = versions(table, 0), versions(table, 1)
    log = me.mutations(a, b, keys)
    return log.join(a.select(*keys, F.lit(True).alias("a")), keys, "left").join(b.select(*keys, F.lit(True).alias("b")), keys, "left").select(*keys, F.col("a").isNull().alias("added"), F.col("b").isNull().alias("removed"))


@query("SELECT event_type, CAST(epoch_us(max(ts)) AS BIGINT) AS newest, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type, CASE WHEN user_id % 10 = 3 THEN user_id - 1 ELSE user_id END ORDER BY ts DESC, user_id % 10 = 2 DESC) AS r FROM events) WHERE r = 1 GROUP BY event_type")
def guest_claim(table):
    last = F.col("user_id") % 10
    rows = table("events").select("event_type", F.floor(F.col("user_id") / 10).alias("tens"), F.when(last == 3, "guest").when(last == 2, "owner").otherwise(last.cast("string")).alias("owner"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time"))
    return me.claimed(rows, "guest", "owner", ["event_type", "tens"]).groupBy("event_type").agg(F.max("time").alias("newest"), F.count("*").alias("n"))


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN quality IS DISTINCT FROM q THEN 'quality=' || quality END, CASE WHEN toxic IS DISTINCT FROM t THEN 'toxic=' || toxic END], lambda x: x IS NOT NULL), ';') AS patch
FROM (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS q, CASE WHEN doc_id % 5 = 0 THEN 1 - toxic ELSE toxic END AS t FROM labels) WHERE quality <> q OR toxic <> t""")
def patch_diff(table):
    target = table("labels")
    live = target.withColumn("quality", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    entries = F.transform(F.array_sort(F.map_entries("patch")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return me.patch(target, live, "doc_id", ["quality", "toxic"]).select("doc_id", F.array_join(entries, ";").alias("patch"))


@query("""
SELECT o_orderkey, o_custkey, legacy FROM (SELECT o_orderkey, o_custkey, false AS legacy FROM orders WHERE o_orderstatus = 'F' UNION ALL
 SELECT o_orderkey, o_custkey, true FROM orders o WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_orderstatus = 'F' AND f.o_orderkey = o.o_orderkey))""")
def history_union(table):
    o = table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    out = hi.with_legacy(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'P'"), ["o_orderkey"], "o_orderkey", "o_orderdate")
    return out.select("o_orderkey", "o_custkey", "legacy")


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def history_by_month(table):
    return hi.by_month(table("events"), "ts").groupBy("month", "event_type").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT CAST(date_trunc('week', TIMESTAMP '2024-01-10') AS DATE) + CAST(i AS INTEGER) AS day FROM range(7) t(i))
SELECT CAST(day AS VARCHAR) AS day, count(e.event_id) AS n FROM d LEFT JOIN events e ON CAST(e.ts AS DATE) = d.day AND e.event_type = 'purchase' GROUP BY 1""")
def week_skeleton(table):
    events = table("events").filter("event_type = 'purchase'").select(F.to_date("ts").alias("day"), "event_id")
    days = hi.week(events.sparkSession.range(1), F.lit("2024-01-10").cast("timestamp"))
    return days.join(events, "day", "left").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("event_id").alias("n"))


@query("""
WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), g AS (SELECT month, i AS cell, month - CAST((isodow(month) - 1) AS INTEGER) + CAST(i AS INTEGER) AS date FROM m, range(42) t(i))
SELECT CAST(month AS VARCHAR) AS month, CAST(cell AS INTEGER) AS cell, CAST(date AS VARCHAR) AS date, CASE WHEN date_trunc('month', date) = month THEN CAST(day(date) AS INTEGER) END AS day FROM g""")
def month_grid(table):
    months = table("orders").select(F.trunc("o_orderdate", "MM").alias("today")).distinct()
    return hi.month_grid(months, F.col("today")).select(F.col("today").cast("string").alias("month"), "cell", F.col("date").cast("string").alias("date"), "day")


@query("""
SELECT l_orderkey, count(*) FILTER (NOT done) AS pending, count(*) FILTER (done) AS done, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY done, l_partkey) AS items
FROM (SELECT l_orderkey, l_partkey, l_linestatus = 'F' AS done FROM lineitem) GROUP BY l_orderkey""")
def shopping_groups(table):
    items = table("lineitem").withColumn("bought", F.col("l_linestatus") == "F")
    out = hi.shopping_groups(items, "l_orderkey", "l_partkey", "bought")
    return out.select("l_orderkey", "pending", "done", F.array_join(F.transform("items", lambda x: x["title"].cast("string")), ",").alias("items"))


@query("""
WITH s AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
k AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM s WHERE nxt IS NULL OR epoch_ms(nxt) - epoch_ms(ts) >= 3600000)
SELECT event_id, user_id, event_type FROM k WHERE prev IS NULL OR prev <> event_type""")
def debounce_distinct(table):
    return hi.settled(table("events").withColumn("place", F.col("event_id")), "user_id", "event_type", "ts", 3_600_000).select("event_id", "user_id", "event_type")


@query("SELECT event_id FROM events e WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events m WHERE m.user_id = e.user_id)")
def newest_generation(table):
    return hi.current_generation(table("events").withColumn("day", F.date_trunc("day", "ts")), "user_id", "day").select("event_id")


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 40) THEN 'error' WHEN bool_and(value < 30) THEN 'cloud' ELSE 'connecting' END AS state FROM events GROUP BY user_id")
def state_reduction(table):
    return hi.reduced_state(table("events"), "user_id", (F.col("event_type") == "error") & (F.col("value") > 40), F.col("value") < 30)


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def retained_tail(table):
    return hi.retained(table("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("event_id")


@query("SELECT user_id, event_type, count(*) AS toggles FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def membership_toggle(table):
    return pr.toggled(table("events"), ["user_id", "event_type"])


@query("SELECT o_orderkey, course, item FROM (SELECT o_orderkey, 'main' AS course, CAST(o_custkey AS VARCHAR) AS item FROM orders UNION ALL SELECT o_orderkey, 'side', CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END FROM orders) WHERE item IS NOT NULL")
def course_unpivot(table):
    o = table("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("main"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("side"))
    return pr.courses(o, ["o_orderkey"], ["main", "side"])


@query("SELECT user_id, max(value) FILTER (event_type = 'view') AS view_top, max(value) FILTER (event_type = 'click') AS click_top FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def course_pivot(table):
    top = table("events").filter("event_type IN ('view', 'click')").groupBy("user_id", F.col("event_type").alias("course")).agg(F.max("value").alias("item"))
    return pr.plans(top, ["user_id"], ["view", "click"]).select("user_id", F.col("view").alias("view_top"), F.col("click").alias("click_top"))


@query("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(table):
    from ..streaming.state import event_windows as windows

    out = windows(table("events"), "ts", "event_type")
    return out.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
SELECT before, after, count(*) AS n FROM (SELECT o_orderstatus AS after, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS NOT NULL GROUP BY 1, 2""")
def transition_matrix(table):
    from pyspark.sql import Window

    from ..operators.audit import transitions

    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table("orders").select(F.col("o_orderstatus").alias("to"), F.lag("o_orderstatus").over(by).alias("from")).filter(F.col("from").isNotNull())
    return transitions(rows, "from", "to")
