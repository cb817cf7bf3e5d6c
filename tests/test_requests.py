import pytest
from pyspark.sql import functions as F

from quern.streaming import requests as rq
from quern.streaming.state import event_stream

BASE = 1_700_000_000_000


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)


def driven(spark, tmp_path, name, batches, schema, stream):
    """The rows of a stream whose batches have those seconds as times; each batch's watermark is the time of those before."""
    kinds = f"{schema}, ms long"
    for rows in batches:
        df = spark.createDataFrame([(*r[:-1], BASE + int(1000 * r[-1])) for r in rows], kinds)
        df.withColumn("time", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = event_stream(spark, str(tmp_path / "in"), f"{schema}, time timestamp")
    q = stream(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def test_only_the_newest_requests_results(spark, store, tmp_path):
    batches = [
        [("a", 1, None, 0), ("a", 1, "one", 1), ("b", 1, None, 1)],
        [("a", 2, None, 2), ("a", 1, "late", 3), ("a", 2, "two", 4)],
        [("b", 1, "x", 5), ("a", 1, None, 6), ("a", 1, "old again", 7)],
        [("c", 1, None, 30)],  # a's and b's requests are over by now
        [("a", 2, "too late", 31), ("a", 3, None, 32), ("a", 3, "three", 33)],
        [("c", 9, None, 34)],
    ]
    got = driven(spark, tmp_path, "current", batches, "owner string, generation long, payload string", lambda s: rq.current_results(s, "owner", 10_000))
    results = sorted(r[:3] for r in got if r[3] == "result")
    assert results == [("a", 1, "one"), ("a", 2, "two"), ("a", 3, "three"), ("b", 1, "x")]
    assert sorted(r[:2] for r in got if r[3] == "expired") == [("a", 2), ("b", 1)]


def test_failures_wait_longer_each_time(spark, store, tmp_path):
    batches = [
        [("a", False, 0), ("b", False, 0)],
        [("b", True, 1)],  # done before it was due
        [("z", True, 6)],
        [("a", False, 7)],
        [("z", True, 18)],
        [("a", True, 19)],
        [("a", False, 20)],
        [("z", True, 60)],
        [("z", True, 61)],
    ]
    got = driven(spark, tmp_path, "retried", batches, "id string, done boolean", lambda s: rq.retries(s, "id"))
    assert sorted(got) == [("a", 1, BASE + 5_000), ("a", 1, BASE + 25_000), ("a", 2, BASE + 17_000)]


def test_waits():
    assert [rq.wait_millis(k) for k in range(5)] == [5_000, 10_000, 20_000, 30_000, 30_000] and rq.wait_millis(1000) == 30_000
