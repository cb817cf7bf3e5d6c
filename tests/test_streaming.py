import random

from pyspark.sql import functions as F

from quern.streaming import state

SCHEMA = "k int, payload string, time long, authoritative boolean"


def write(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def test_late_cache_does_not_bring_back(spark, tmp_path):
    write(spark, tmp_path / "in", [[(1, "a", 1, True)], [(1, None, 2, True)], [(1, "late", 9, False), (2, "b", 1, False)]])
    stream = state.event_stream(spark, str(tmp_path / "in"), SCHEMA)
    q = state.merged_versions(stream, ["k"]).writeStream.outputMode("update").format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [tuple(r) for r in spark.table("merged").collect()]
    assert [r[1] for r in rows if r[0] == 1][-1] is None and (2, "b", 1) in rows


def test_latest_table(spark, tmp_path):
    write(spark, tmp_path / "in", [[(1, "a", 1, True), (2, "x", 5, True)], [(1, "b", 2, True)], [(1, "old", 0, True)]])
    stream = state.event_stream(spark, str(tmp_path / "in"), SCHEMA)
    q = state.keep_latest(stream, str(tmp_path / "out"), ["k"], "time", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    kind = "k int, payload string, time long, authoritative boolean, bucket int"
    now = lambda: {r["k"]: r["payload"] for r in state.latest_table(spark, str(tmp_path / "out"), kind).collect()}
    assert now() == {1: "b", 2: "x"}
    assert state.drop_superseded(spark, str(tmp_path / "out")) == 2 and now() == {1: "b", 2: "x"}


def test_merging_is_that_of_one_update_after_the_other(spark, tmp_path):
    draw = random.Random(4)
    batches = [[(draw.randint(1, 6), draw.choice([None, "a", "b", "c"]), draw.randint(1, 9), draw.random() < 0.3) for _ in range(12)] for _ in range(6)]
    want = {}
    for rows in batches:
        for k, p, t, sure in sorted(rows, key=lambda r: (r[2], r[3])):
            known = k in want
            payload, time = want.get(k, (None, -1))
            if sure or not known or (payload is not None and t > time):
                want[k] = (p, t)
    write(spark, tmp_path / "in", batches)
    stream = state.event_stream(spark, str(tmp_path / "in"), SCHEMA)
    q = state.merged_versions(stream, ["k"]).writeStream.outputMode("update").format("memory").queryName("sequence").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.table("sequence").collect():
        got[r["k"]] = (r["payload"], r["time"])
    assert got == want


def test_windows_drop_what_is_too_late(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 11:00:00", "a", 2.0), ("2024-01-02 01:00:00", "a", 4.0)], "t string, g string, value double").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted((r["n"], r["total"]) for r in state.event_windows(df, "t", "g").collect()) == [(1, 4.0), (2, 3.0)]


def run(df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_settled_values_as_a_stream(spark, tmp_path):
    t = lambda s, ms: f"2024-01-01 00:00:{s:02d}.{ms:03d}"
    first = [("o", "a", t(1, 0)), ("o", "ab", t(1, 100)), ("o", "abc", t(1, 300)), ("o", "x", t(3, 0)), ("p", "q", t(1, 0))]
    for rows in (first, [("o", "later", "2024-01-01 01:00:00")], [("z", "end", "2024-01-01 02:00:00")]):
        spark.createDataFrame(rows, "k string, v string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = state.event_stream(spark, str(tmp_path / "in"), "k string, v string, at timestamp")
    run(state.settled_values(stream, "k", "v", "at"), "settled", "append", tmp_path)
    got = sorted((r["k"], r["v"], r["changes"]) for r in spark.table("settled").collect())
    assert got[:3] == [("o", "abc", 3), ("o", "later", 1), ("o", "x", 1)] and ("p", "q", 1) in got


def test_combined_as_a_stream(spark, tmp_path):
    for rows in ([("o", "a", "1", 1), ("o", "b", "2", 5)], [("o", "a", "old", 0), ("o", "b", None, 6), ("p", "a", "z", 1)]):
        spark.createDataFrame(rows, "k string, input string, value string, time long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = state.event_stream(spark, str(tmp_path / "in"), "k string, input string, value string, time long")
    run(state.combined(stream, "k", ["a", "b"]), "combined", "update", tmp_path)
    last = {}
    for r in spark.table("combined").collect():
        last[r["k"]] = (r["a"], r["b"])
    assert last == {"o": ("1", None), "p": ("z", None)}
