import json

import pytest
from pyspark.sql import functions as F

from quern.operators.audit import IntegrityError
from quern.sources import catalog
from quern.sources import personal_store as ps
from quern.sources import snapshots as sn


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def base(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(k if k else None, f"v{k}", [k]) for k in range(200)], "k long, v string, l array<long>")
    return path, sn.create(df, path, ["k"], buckets=16)


def test_commits_write_only_touched_buckets(spark, base):
    path, first = base
    change = spark.createDataFrame([(7, "new", [1]), (1000, "more", None)], "k long, v string, l array<long>")
    second = sn.upserted(path, first, change, spark.createDataFrame([(9,), (None,)], "k long"))
    assert (first.rows, second.rows, second.version) == (200, 199, 1)
    commits = [p.commit for p in second.parts.values()]
    assert 12 <= sum(c == first.parts[0].commit for c in commits) < 16
    got = {r["k"]: r["v"] for r in sn.read(spark, path).collect()}
    assert got == {k: f"v{k}" for k in range(1, 200) if k != 9} | {7: "new", 1000: "more"}
    assert sn.read(spark, path, 0).count() == 200
    assert rows(sn.differing(spark, path, first, second)) == [(1000, "added"), (7, "changed"), (9, "removed"), (None, "removed")]
    assert sn.differing(spark, path, first, first).count() == 0
    assert sn.forgotten(spark, path) >= 0 and sn.versions(spark, path) == [1] and sn.read(spark, path).count() == 199


def test_of_two_writers_one_wins(spark, base):
    path, first = base
    one = spark.createDataFrame([(1, "a", None)], "k long, v string, l array<long>")
    sn.upserted(path, first, one)
    with pytest.raises(sn.Conflict):
        sn.upserted(path, first, one.withColumn("v", F.lit("b")))
    assert sn.read(spark, path).filter("k = 1").first()["v"] == "a" and sn.versions(spark, path) == [0, 1]
    assert sn.upserted(path, sn.snapshot(spark, path), one.withColumn("v", F.lit("b"))).version == 2


def test_a_writer_that_dies_leaves_the_old_snapshot(spark, base):
    path, first = base
    broken = spark.range(3).select(F.col("id").alias("k"), F.raise_error(F.lit("dies")).cast("string").alias("v"), F.lit(None).cast("array<long>").alias("l"))
    with pytest.raises(Exception, match="dies"):
        sn.upserted(path, first, broken)
    assert sn.snapshot(spark, path) == first and sn.verified(spark, path).count() == 200
    sn.forgotten(spark, path)
    assert sn.verified(spark, path).count() == 200


def test_reads_are_gated_by_digests(spark, base):
    path, first = base
    assert sn.verified(spark, path).count() == 200
    other = sn.create(sn.read(spark, path).repartition(7), path + "2", ["k"], buckets=16)
    assert other.digest == first.digest  # of the rows, not of files
    k, part = next(iter(first.parts.items()))
    spark.createDataFrame([(5000, "foreign", None)], "k long, v string, l array<long>").write.mode("append").parquet(f"{path}/data/{part.commit}/_bucket={k}")
    with pytest.raises(IntegrityError, match="aren't what snapshot 0 says"):
        sn.verified(spark, path)


def test_keys_and_buckets_are_checked(spark, base, tmp_path):
    path, first = base
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(IntegrityError, match="keys repeat"):
        sn.create(twice, str(tmp_path / "u"), ["k"])
    with pytest.raises(IntegrityError, match="no snapshot"):
        sn.read(spark, str(tmp_path / "u"))
    with pytest.raises(IntegrityError, match="untouched"):
        sn.rewritten(path, first, spark.createDataFrame([(1,)], "k long"), lambda old: sn.read(spark, path))
    empty = sn.create(twice.limit(0), str(tmp_path / "e"), ["k"])
    assert empty.parts == {} and sn.read(spark, str(tmp_path / "e")).columns == ["k", "v"] and sn.verified(spark, str(tmp_path / "e")).count() == 0
    json.loads((tmp_path / "e/snapshots/000000000000.json").read_text())


def test_compare_and_set(spark, tmp_path):
    path = str(tmp_path / "c")
    first = sn.create(spark.createDataFrame([(1, "a", 5), (2, "b", 5), (None, "n", 1)], "k int, v string, n int"), path, ["k"])
    changes = spark.createDataFrame([(1, "A", 5), (2, "B", 4), (3, "C", 1), (None, "N", 1)], "k int, v string, n int")
    second, outcomes = sn.compare_and_set(path, first, changes, "n")
    assert rows(outcomes) == [(1, "applied"), (2, "stale"), (3, "missing"), (None, "applied")]
    assert rows(sn.read(spark, path)) == [(1, "A", 6), (2, "b", 5), (None, "N", 2)]
    assert rows(sn.compare_and_set(path, second, changes.filter("k = 1"), "n")[1]) == [(1, "stale")]


def test_catalog_versions(spark, tmp_path):
    path = str(tmp_path / "k")
    facets = spark.createDataFrame([(1, "x", "t")], "id int, facet string, token string")
    first = spark.createDataFrame([(1, "a")], "id int, name string")
    assert catalog.write_catalog(first, facets, path, {}) == 0
    with pytest.raises(Exception, match="rule broken: named"):
        catalog.write_catalog(first.withColumn("name", F.lit("")), facets, path, {"named": F.col("name") != ""})
    assert rows(catalog.read_catalog(spark, path)[0]) == [(1, "a")]
    assert catalog.write_catalog(first.withColumn("name", F.lit("b")), facets, path, {}) == 1
    assert rows(catalog.read_catalog(spark, path)[0]) == [(1, "b")] and rows(catalog.read_catalog(spark, path, 0)[0]) == [(1, "a")]
    with pytest.raises(ValueError):
        catalog.read_catalog(spark, str(tmp_path / "none"))


def test_personal_store(spark, tmp_path):
    path = str(tmp_path / "p")
    frame = lambda *r: spark.createDataFrame(list(r), "owner string, collection string, document_id string, payload string, time long")
    ps.write(path, frame(("o", "notes", "1", "x", 5), ("o", "notes", "2", "y", 5), ("g", "notes", "1", "z", 9)))
    assert ps.pending(spark, path).count() == 3
    old = ps.pending(spark, path).filter("owner = 'o'").select(*ps.KEYS, "revision")
    old = spark.createDataFrame(old.collect(), old.schema)
    ps.write(path, frame(("o", "notes", "1", "x2", 6)))
    ps.acknowledge(path, old)  # of document 1 a later write waits
    assert rows(ps.pending(spark, path).select("owner", "document_id", "payload")) == [("g", "1", "z"), ("o", "1", "x2")]
    version = sn.snapshot(spark, path).version
    ps.write(path, frame(("o", "notes", "2", "y", 50)))
    assert rows(ps.pending(spark, path).select("document_id")) == [("1",), ("1",)] and sn.snapshot(spark, path).version == version + 1
    ps.receive(path, frame(("o", "notes", "3", "far", 7)), authoritative=True)  # without 2, which nothing waits for
    assert rows(ps.documents(spark, path, "o").select("document_id", "payload")) == [("1", "x2"), ("3", "far")]
    ps.claim(path, "t", "g", "o", spark)
    claimed = rows(ps.documents(spark, path).select("owner", "document_id", "payload"))
    assert claimed == [("o", "1", "z"), ("o", "3", "far")]
    ps.write(path, frame(("g", "notes", "1", "again", 99)))
    ps.claim(path, "t", "g", "o", spark)
    assert rows(ps.documents(spark, path, "g").select("payload")) == [("again",)]
