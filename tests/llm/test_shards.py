import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quern.llm import shards

from .conftest import TEXTS


def test_places_and_groups(docs, none):
    rows = shards.virtual_slot_shards(docs).collect()
    texts = dict(TEXTS)
    assert len(rows) == len(TEXTS)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    assert shards.virtual_slot_shards(none).count() == 0


def test_near_equal_bytes_gapless_slots_and_a_hot_group(spark):
    draw = np.random.default_rng(1)
    rows = [(i, "x" * int(n)) for i, n in enumerate(draw.lognormal(6, 1, 4000))] + [(10_000 + i, "hot " * 50) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = shards.virtual_slot_shards(df).collect()
    size, place, of = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        place[r["shard"]].append(r["slot"])
        if r["doc_id"] < 10_000:
            of[len(rows[r["doc_id"]][1])].add(r["shard"])
    assert len(size) == 40 and max(size.values()) < 1.02 * min(size.values())
    assert all(sorted(p) == list(range(len(p))) for p in place.values())
    assert all(len(s) == 1 for s in of.values())  # equal texts stay together


def test_a_new_shard_takes_whole_slots(spark, tmp_path):
    sizes = {k: (k * 7919) % 1000 + 1 for k in range(shards.SLOTS)}
    first = shards.new_map(sizes, 40)
    second = shards.rebalanced(first, sizes, 41)
    load = Counter()
    for k, s in enumerate(second):
        load[s] += sizes[k]
    assert max(load.values()) - min(load.values()) < 2000
    assert all(b == 40 or a == b for a, b in zip(first, second))
    shards.save_map(spark, first, 1, str(tmp_path))
    shards.save_map(spark, second, 2, str(tmp_path))
    assert shards.load_map(spark, str(tmp_path), 1).filter("shard = 40").count() == 0 < shards.load_map(spark, str(tmp_path), 2).filter("shard = 40").count()
    assert max(shards.rebalanced(second, sizes, 39)) == 38


def test_only_groups_too_large_for_a_shard_are_parted(spark):
    rows = [(i, f"text {i} " * 20) for i in range(2000)] + [(10_000 + i, "hot " * 50) for i in range(2000)] + [(20_000 + i, "pair") for i in range(2)]
    got = shards.virtual_slot_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"] for r in got if r["parted"]} == {10_000 + i for i in range(2000)}
    assert len({r["shard"] for r in got if r["doc_id"] >= 20_000}) == 1


def by_hand(rows, n_shards):
    """Slot, shard and whether it is parted of each text, and how the slots are laid out: hashes, sizes and the map anew."""
    size = lambda t: len((t or "").encode()) + 16
    total, copies = sum(size(t) for _, t in rows), Counter(t or "" for _, t in rows)
    parted = {t for t, n in copies.items() if n * size(t) > total / n_shards / 2}
    slot = {t: xxhash.xxh64_intdigest(b"slot", xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), 42)), 42)) for t in copies}
    slot = {t: (h - (1 << 64) if h >> 63 else h) % 4096 for t, h in slot.items()}
    return slot, parted


@pytest.mark.parametrize("part_rows", [100_000, 50])
def test_slots_map_and_places_by_hand(spark, part_rows):
    draw = np.random.default_rng(2)
    rows = [(int(i), "y" * int(n)) for i, n in enumerate(draw.lognormal(5, 1, 3000))] + [(5000 + i if i % 3 else None, None if i % 2 else "") for i in range(600)] + [(8000 + i, "hot " * 300) for i in range(300)]
    got = shards.virtual_slot_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), part_rows=part_rows).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t or "") + 16) for i, t in rows)
    slot, parted = by_hand(rows, 40)
    texts = {len(t or "") + 16: t or "" for _, t in rows}
    load, where, shard_of = Counter(), defaultdict(set), {}
    for r in got:
        text = texts[r["size"]]
        assert r["parted"] == (text in parted) and (r["parted"] or r["virtual_slot"] == slot[text])
        load[r["virtual_slot"]] += r["size"]
        assert shard_of.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
        where[r["shard"]].add(r["slot"])
    loads = [0] * 40
    for k in sorted(load, key=lambda k: (-load[k], k)):
        s = loads.index(min(loads))
        assert shard_of[k] == s
        loads[s] += load[k]
    assert parted == {"hot " * 300}
    for s, places in where.items():
        assert places == set(range(sum(r["shard"] == s for r in got)))
    assert len({(r["virtual_slot"], r["shard"]) for r in got if r["size"] == 16}) == 1  # null and empty texts are one group
