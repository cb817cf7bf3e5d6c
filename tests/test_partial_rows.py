import json

import pytest
from pyspark.sql import functions as F

from quern.functions.parse import canonical_url, strict_month, url_id
from quern.operators import audit, projections, select
from quern.sources import catalog, pages


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def values(spark, texts, *columns):
    return [tuple(r)[1:] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *columns).orderBy("i").collect()]


def test_paths_with_ids(spark):
    rule = r"^/r/(\d+)(?:-[a-z]+)?$"
    texts = ["https://www.A.org/r/12/?x#y", "https://a.org/r/12-pie", "https://a.org/other/12", "https://b.org/r/1", "http://a.org/r/3", "https://u@a.org/r/4", None]
    got = values(spark, texts, canonical_url(F.col("t"), ("a.org",), rule), url_id(F.col("t"), rule))
    assert got == [("https://a.org/r/12", "12"), ("https://a.org/r/12-pie", "12"), (None, None), (None, "1"), (None, "3"), (None, "4"), (None, None)]


def test_strict_months(spark):
    texts = ["2024-02", "2024-02-29", "2023-02-29", "1899-12", "2100-12-31", "2101-01", "2024-13", "2024-2", " 2024-02", "", None]
    got = [str(x) if x else None for (x,) in values(spark, texts, strict_month(F.col("t")))]
    assert got == ["2024-02-01", "2024-02-01", None, None, "2100-12-01", None, None, None, None, None, None]


def test_sitemaps_of_indexes(spark, tmp_path):
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    urls = lambda *locs: "<urlset>" + "".join(f"<url><loc>{u}</loc><lastmod>{t}</lastmod></url>" for u, t in locs) + "</urlset>"
    for name, text in {"top": index("x/a", "x/more"), "more": index("x/b", "x/top"), "a": urls(("/r/1-x", "2024-01-01"), ("/r/2", "2024-01-01")), "b": urls(("/r/1-a", "2023-01-01"), ("/about", "2024-01-01"))}.items():
        (tmp_path / f"{name}.xml").write_text(text)
    place = lambda u: str(tmp_path / f"{u.split('/')[-1]}.xml")
    found = pages.traversed_sitemaps(spark, place("x/top"), place)
    assert found.count() == 4
    assert rows(pages.by_page_id(found, r"/r/(\d+)")) == [("1", "/r/1-a", "2024-01-01"), ("2", "/r/2", "2024-01-01")]
    with pytest.raises(ValueError, match="more than 3"):
        pages.traversed_sitemaps(spark, place("x/top"), place, most=3)


def test_outcomes(spark):
    data = [(200, "https://a.org/1", None, "1", "1", True), (200, "https://a.org/1", "https://a.org/2", "2", "1", True), (200, "https://a.org/1", "http://www.a.org/1/?q", "9", "1", True), (200, "https://a.org/1", None, None, "1", None), (404, "https://a.org/1", None, None, "1", None), (None, "https://a.org/1", None, None, "1", None)]
    df = spark.createDataFrame(data, "s int, u string, l string, i string, e string, ok boolean")
    assert [r[0] for r in df.select(pages.crawl_outcome(*map(F.col, ("s", "u", "l", "i", "e", "ok")))).collect()] == ["record", "redirect", "alias", "stub", "failure", "failure"]


def test_resumed_checkpoints(spark):
    payloads, facets = spark.createDataFrame([(1, "t", "p")], "id int, lastmod string, payload string"), spark.createDataFrame([("r1", "f", "o"), ("r0", "f", "o"), (None, "f", "o")], "run_key string, facet string, option string")
    kept, of_run = catalog.resumed(payloads, facets, "r1")
    assert kept.count() == 1 and rows(of_run) == [("r1", "f", "o")]
    assert [x.count() for x in catalog.resumed(payloads, facets, "r1", resume=False)] == [0, 0]


def test_envelopes(spark):
    df = spark.createDataFrame([(1, '{"a":1}', True), (2, None, True), (3, "x", None)], "k int, p string, on boolean")
    got = [r[0] for r in df.orderBy("k").select(projections.payload_envelope(F.col("p"), {"source": F.lit("s"), "id": F.col("k").cast("string"), "updated": F.lit(None).cast("string")}, 2, F.col("on"))).collect()]
    assert json.loads(got[0]) == {"source": "s", "id": "1", "updated": None, "payload": '{"a":1}', "schemaVersion": 2, "active": True} and got[1] is None and json.loads(got[2])["active"] is False


def test_rederivation_wants_the_same_payload(spark):
    stored = spark.createDataFrame([(1, "a", "p"), (2, "b", "p"), (3, "c", "p"), (4, "d", None)], "k int, c string, p string")
    derived = spark.createDataFrame([(1, "a", "p"), (2, "x", "p"), (3, "y", "q"), (5, "e", "p")], "k int, c string, p string")
    assert rows(audit.rederived(stored, derived, "k", ["c"], "p")) == [(2, "differs", "c"), (3, "payload", ""), (4, "extra", ""), (5, "missing", "")]


def test_bounded_references(spark):
    frame = lambda *ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, place long")
    frames = [frame("p1", "p2", "p1", "bad id!"), frame("f1", "p2", None), frame("h1", "f1", "h2")]
    got = lambda n: [r[0] for r in select.reference_set(frames, "id", n).collect()]
    assert got(10) == ["p1", "p2", "f1", "h1", "h2"] and got(3) == ["p1", "p2", "f1"]
    many = spark.range(3000).select(F.concat(F.lit("x"), "id").alias("id"), F.col("id").alias("place"))
    assert select.reference_set([many, many], "id").count() == 1024
