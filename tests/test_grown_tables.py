"""Queries against their SQL on tables of more, or odder, rows than those given."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from quern.plans import checks, recipes, records, texts  # noqa: F401
from quern.plans.registry import ORACLE_SQL, QUERIES


def agrees(spark, tmp_path, name, **tables):
    """Rows of a query over tables that are written for it; its SQL must give the same."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()))
    assert got == sorted(con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall())
    return got


def test_completions_of_events_of_one_time(spark, tmp_path):
    events = spark.range(12).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") % 2).alias("ts"), F.lit("view").alias("event_type"))
    assert len(agrees(spark, tmp_path, "completion_match", events=events)) == 8


def test_keys_whose_bits_a_double_rounds_up(spark, tmp_path):
    orders = spark.createDataFrame([(235460,), (4332905,), (7,)], "o_orderkey long")
    assert (235460, 3288155182) in {(k, head) for head, k in agrees(spark, tmp_path, "namespaced_keys", orders=orders)}


def test_cut_off_entities_of_pages(spark, tmp_path):
    html = ["<h1>a&amp;&amp</h1>", "<h1>a &quo</h1>", '<h1>&amp;amp; &amp;quot;</h1><div class="ad">b&ampx; &</div>', "<h1>x &quot;y&quot; &am</h1>"]
    pages = spark.createDataFrame([(i, f"https://a.org/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    assert [r[-1] for r in agrees(spark, tmp_path, "scoped_pages", pages=pages) if r[2] == 0] == ["a&&amp"]


def test_cut_off_entities_of_page_trees(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.org/1", '<nav><ul><li><a href="/a">x &amp;&amp</a></li><li><a href="/b">&lt;y &am</a></li></ul></nav>')], "page_id long, url string, html string")
    agrees(spark, tmp_path, "page_trees", pages=pages)


def test_a_table_of_one_file_is_dealt_out_before_costly_work(spark, tmp_path):
    part = spark.createDataFrame([(i, f"red bolt {i}", "Brand#1", "SMALL", i) for i in range(60)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1)
    part.write.parquet(f"{tmp_path}/part.parquet")
    for name in ("normalized_payloads", "linked_data_records", "ingredient_drafts", "name_distances"):
        assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 4, name


def test_what_goes_to_python_is_bounded_by_bytes(spark, tmp_path):
    """payload_codec over long texts: no batch has more than the bound and a text."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100_000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["payload_codec"](spark, str(tmp_path))
    sizes = [r[0] for r in df.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()]
    assert sum(sizes) >= 40_000_000 and max(sizes) < 5_000_000
