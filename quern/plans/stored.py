"""Queries through tables on disk: keyed snapshots, users' documents, title and facet indexes. Each writes to a new table of the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_token
from ..sources import indexes as ix
from ..sources import personal_store as ps
from ..sources import snapshots as sn
from ..sources.shared import shared_folder
from .catalog import facet_table
from .history import _VERSIONS, versions
from .registry import query


def new_table(df: DataFrame, label: str) -> str:
    return f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"


@query("""
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'changed' END AS kind FROM labels WHERE doc_id % 11 = 0 OR doc_id % 7 = 0
UNION ALL SELECT -1 - doc_id, 'added' FROM labels WHERE doc_id % 13 = 0""")
def snapshot_differences(table):
    """What a commit changed, found from digests of buckets."""
    labels = table("labels")
    path = new_table(labels, "labels")
    first = sn.create(labels, path, ["doc_id"], 16)
    k = F.col("doc_id")
    changed = labels.filter((k % 7 == 0) & (k % 11 != 0)).withColumn("quality", F.lit(1) - F.col("quality"))
    added = labels.filter(k % 13 == 0).withColumn("doc_id", -1 - k)
    second = sn.upserted(path, first, changed.unionByName(added), labels.filter(k % 11 == 0).select("doc_id"))
    return sn.differing(labels.sparkSession, path, first, second)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 AND c_custkey % 3 <> 0 THEN 'new' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 4 = 1 AND c_custkey % 3 <> 0 THEN c_nationkey + 1 ELSE c_nationkey END AS version FROM customer""")
def guarded_rows(table):
    """Changes of every fourth row, a third of them read before another writer: those stay as they were. The rows come through the gate of their digests."""
    rows = table("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("version"))
    path = new_table(rows, "customers")
    first = sn.create(rows, path, ["c_custkey"], 8)
    changes = rows.filter("c_custkey % 4 = 1").select("c_custkey", F.lit("new").alias("segment"), F.when(F.col("c_custkey") % 3 == 0, F.col("version") - 1).otherwise(F.col("version")).alias("version"))
    changes = changes.unionByName(changes.limit(1).withColumn("c_custkey", F.lit(-5).cast("bigint")))
    sn.compare_and_set(path, first, changes, "version")
    return sn.verified(rows.sparkSession, path)


@query(f"""
WITH {_VERSIONS}, m AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type,
 CASE WHEN a.user_id IS NULL THEN b.payload WHEN a.payload IS NULL THEN NULL WHEN b.time > a.time THEN b.payload ELSE a.payload END AS payload
FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type)
SELECT CAST(user_id AS VARCHAR) AS owner, event_type AS document_id, payload FROM m WHERE payload IS NOT NULL""")
def stored_merge(table):
    """merge_tombstones through the store: local writes that are acknowledged, and then what a cache has."""
    rows = [versions(table, odd).select(F.col("user_id").cast("string").alias("owner"), F.lit("events").alias("collection"), F.col("event_type").alias("document_id"), "payload", "time") for odd in (0, 1)]
    spark, path = rows[0].sparkSession, new_table(rows[0], "personal")
    ps.opened(spark, path, 8)
    ps.write(path, rows[0])
    ps.acknowledge(path, ps.pending(spark, path).select(*ps.KEYS, "revision"))
    ps.receive(path, rows[1], authoritative=False)
    return ps.documents(spark, path).select("owner", "document_id", "payload")


def part_index(table) -> tuple:
    part = table("part")
    path = new_table(part, "index")
    ix.build(part, "p_partkey", search_token(F.col("p_name")), facet_table(table), path, "search_token")
    return part.sparkSession, ix.opened(part.sparkSession, path, "search_token", part.count())


@query("SELECT p_partkey AS key, p_name AS title FROM part WHERE contains(' ' || p_name || ' ', ' ring ') AND contains(' ' || p_name || ' ', ' red ')")
def indexed_title_words(table):
    return ix.titled(*part_index(table), ["ring", "red"], whole_words=True)


@query("SELECT p_partkey AS key, p_name AS title FROM part WHERE contains(p_name, 'in') AND contains(p_name, 'red')")
def indexed_title_terms(table):
    return ix.titled(*part_index(table), ["in", "red"])


@query("SELECT p_partkey AS key FROM part WHERE len(list_intersect(string_split(p_name, ' '), ['red', 'blue', 'ring'])) > 0 AND p_brand IN ('Brand#3', 'Brand#4') AND NOT list_contains(string_split(p_name, ' '), 'bolt')")
def bitmap_rows(table):
    spark, folder = part_index(table)
    return ix.keys_of(spark, folder, ix.selected(spark, folder, {"word": ["red", "blue", "ring"], "brand": ["brand 3", "brand 4"]}, {"word": ["bolt"]}))


@query("""
SELECT facet, token, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, 'word' AS facet, unnest(string_split(p_name, ' ')) AS token FROM part WHERE p_brand = 'Brand#2'
 UNION ALL SELECT p_partkey, 'brand', trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) FROM part WHERE p_brand = 'Brand#2') GROUP BY 1, 2""")
def bitmap_counts(table):
    """A vocabulary with counts among the rows of a brand, from bitmaps alone."""
    spark, folder = part_index(table)
    return ix.token_counts(spark, folder, ix.selected(spark, folder, {"brand": ["brand 2"]}))
