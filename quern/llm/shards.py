"""Sharding by fixed virtual slots, with DataFrame functions only.

Records are hashed into SLOTS virtual slots; bytes are aggregated per slot; a versioned map says which shard holds
which slot. Only that map, SLOTS small rows whatever the input's size, comes to the driver, where slots go to the
shard with the fewest bytes, largest slots first. Rebalancing edits the map (a new version) and moves whole slots.

Equal texts, null being like empty, share a slot, hence a shard. Only a text whose copies hold more than a HOT_SHARE-th of
a shard's fair share of bytes is salted over all slots, so that no group of copies makes a shard large. There are at most
HOT_SHARE x shards such texts, so their table has a proven bound and may be broadcast; their rows are marked as parted.

A slot may hold any number of rows, such as all empty texts. Rows are numbered within parts of a slot of about PART_ROWS
each, and where a part begins in its shard follows from the parts' counts.

Law: `bytes`. Nulls: a null text is an empty one, of size 16; a null doc_id is an ordinary row. Blank texts are ordinary
texts, very long ones count with all their bytes, and a text above a shard's fair share makes a shard of its own size.
Repeated rows each get a place of their own; ties of doc_id are broken by the row's place in the table. Other columns,
whatever their names, take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stored

SLOTS = 4096
SHARDS = 40
HOT_SHARE = 2
OVERHEAD = 16
PART_ROWS = 100_000


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def with_virtual_slot(df: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id with size, text_crc32, tie (the row's place in the table), virtual_slot and parted: whether the row is one of a group of copies that is dealt over all slots."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(df.select("doc_id", record_size(text).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("tie")), "slots")
    total = F.coalesce(F.sum("size"), F.lit(0)).alias("total")
    groups = rows.groupBy("text_hash", "size").agg(F.sum("size").alias("bytes"))
    fair = rows.agg(total).select((F.col("total") / shards / HOT_SHARE).alias("most"))
    hot = groups.join(F.broadcast(fair), F.col("bytes") > F.col("most")).select("text_hash", "size", F.lit(True).alias("hot"))
    marked = rows.join(F.broadcast(hot), ["text_hash", "size"], "left")  # at most HOT_SHARE * shards rows
    slot = F.when(F.col("hot"), F.xxhash64("text_hash", "tie")).otherwise(F.xxhash64("text_hash", F.lit("slot")))
    return marked.select("doc_id", "size", "text_crc32", "tie", F.pmod(slot, F.lit(slots)).cast("int").alias("virtual_slot"), F.coalesce("hot", F.lit(False)).alias("parted"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def new_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot: slots by descending bytes, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    at = [0] * slots
    for slot in sorted(range(slots), key=lambda k: (-sizes.get(k, 0), k)):
        load, shard = heapq.heappop(heap)
        at[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
    return at


def rebalanced(at: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """The next version of a map for `shards` shards: slots move, one at a time, from the fullest shard to the emptiest while that lowers the larger of the two loads. Where shards are new, only they take slots."""
    takers = sorted(set(range(shards)) - set(at)) or list(range(shards))
    at = [s if s < shards else -1 for s in at]
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, s in enumerate(at):
        if s >= 0:
            load[s] += sizes.get(slot, 0)
            held[s].append(slot)
    for slot in sorted((k for k, s in enumerate(at) if s < 0), key=lambda k: -sizes.get(k, 0)):  # of shards that are given up
        s = min(range(shards), key=lambda x: (load[x], x))
        at[slot], load[s] = s, load[s] + sizes.get(slot, 0)
        held[s].append(slot)
    while True:
        a, b = max(range(shards), key=lambda x: (load[x], -x)), min(takers, key=lambda x: (load[x], x))
        gap = load[a] - load[b]
        slot = max((k for k in held[a] if 0 < sizes.get(k, 0) < gap), key=lambda k: (min(sizes[k], gap - sizes[k]), -k), default=None)
        if slot is None:
            return at
        at[slot] = b
        held[a].remove(slot)
        held[b].append(slot)
        load[a], load[b] = load[a] - sizes[slot], load[b] + sizes[slot]


def save_map(spark: SparkSession, at: list[int], version: int, path: str) -> DataFrame:
    """Writes one version of a map below path; all versions stay readable there."""
    literal = F.split(F.lit(",".join(map(str, at))), ",")
    rows = spark.range(1).select(F.posexplode(literal).alias("virtual_slot", "s")).select("virtual_slot", F.col("s").cast("int").alias("shard"))
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")
    return load_map(spark, path, version)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def place(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds shard, and slot: the row's place in its shard, gapless from 0. slot_map and sizes have a row per virtual slot, so both are broadcast; counts of the slots' parts stay distributed."""
    known = slot_map.join(sizes, "virtual_slot").select("virtual_slot", "shard", F.greatest(F.ceil(F.col("n") / part_rows), F.lit(1)).alias("parts"))
    dealt = rows.join(F.broadcast(known), "virtual_slot").withColumn("part", F.pmod(F.xxhash64("tie"), "parts")).drop("parts")
    counts = dealt.groupBy("virtual_slot", "part", "shard").agg(F.count("*").alias("n"))
    begins = counts.select("virtual_slot", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "part")) - F.col("n")).alias("begins"))
    within = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size", "tie")) - 1
    return dealt.withColumn("within", within).join(begins, ["virtual_slot", "part"]).withColumn("slot", (F.col("begins") + F.col("within")).cast("long"))


def virtual_slot_shards(documents: DataFrame, shards: int = SHARDS, slots: int = SLOTS, part_rows: int = PART_ROWS) -> DataFrame:
    """All rows with their shard by the stored map, version 1."""
    spark = documents.sparkSession
    rows = stored(with_virtual_slot(documents, shards, slots), "slots")
    sizes = stored(slot_sizes(rows), "slot-sizes")
    counted = {r["virtual_slot"]: r["bytes"] for r in sizes.collect()}  # at most `slots` rows
    slot_map = save_map(spark, new_map(counted, shards, slots), 1, new_path(spark, "slot-map"))
    placed = place(rows, slot_map, sizes, part_rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "parted", F.lit(1).alias("map_version"))
