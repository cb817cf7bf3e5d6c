import random

import pytest
from pyspark.sql import functions as F

from quern.operators import audit, explore, facets, history, merge, planner, select, validate
from quern.operators import records as records_
from quern.sources import catalog, pages, records


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pages_join_to_the_full_order(spark):
    df = spark.range(57).withColumn("v", F.col("id") % 7)
    order = [F.desc("v"), F.asc("id")]
    parts = [r for k in range(0, 60, 10) for r in explore.page(df, order, 10, k).collect()]
    assert parts == df.orderBy(*order).collect()
    with pytest.raises(ValueError):
        explore.page(df, order, 101)


def test_preferences(spark):
    df = spark.createDataFrame([(1, "a", ["milk", "egg"]), (2, "other", ["oat"]), (3, "b", ["oatmilk"])], "id int, category string, texts array<string>")
    p = explore.Preferences(excluded_tokens=frozenset({"milk"}), excluded_sources=frozenset())
    c = {n: F.col(n) for n in df.columns}
    assert rows(df.filter(explore.preferred(p, c)).select("id")) == []
    assert rows(df.filter(explore.preferred(explore.Preferences(excluded_tokens=frozenset({"egg"})), c)).select("id")) == [(3,)]


def test_semi_and_anti_are_all(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    f = df.filter("k % 3 = 0").select("k", F.lit("g").alias("facet"), F.lit("red").alias("token"))
    assert facets.having(df, f, "k", "g", ["red"]).count() + facets.lacking(df, f, "k", "g", "red").count() == 20


def test_seeded_pick_repeats(spark):
    df = spark.range(100)
    assert len({select.seeded_pick(df, 5, "id").first()[0] for _ in range(3)}) == 1
    assert select.seeded_pick(df.limit(0), 5, "id").count() == 0


def test_wrapping_pick_goes_round(spark):
    df = spark.range(5)
    assert select.wrapping_pick(df, 4, F.col("id"), "id", [4, 0]).first()[0] == 1
    assert select.wrapping_pick(df, 0, F.col("id"), "id", [0, 1, 2, 3, 4]).count() == 0


SCHEMA = "k int, payload string, time long, revision string, observed boolean, imported boolean"


def test_merge_keeps_deletions_and_pending(spark):
    now = spark.createDataFrame([(1, None, 5, None, True, False), (2, "a", 5, None, True, False), (3, "p", 5, "r", False, False), (4, "i", 5, "r", False, True), (5, "x", 5, None, True, False)], SCHEMA)
    got = spark.createDataFrame([(1, "back", 9, None, True, False), (2, "b", 6, None, True, False), (3, "p", 7, None, True, False), (4, "j", 8, None, True, False), (6, "new", 1, None, True, False)], SCHEMA)
    cache = {r["k"]: r["payload"] for r in merge.merge_snapshot(now, got, ["k"], False).collect()}
    assert cache == {1: None, 2: "b", 3: "p", 4: "i", 5: "x", 6: "new"}
    sure = {r["k"]: (r["payload"], r["observed"], r["revision"]) for r in merge.merge_snapshot(now, got, ["k"], True).collect()}
    assert sure == {1: ("back", False, None), 2: ("b", False, None), 3: ("p", True, "r"), 4: ("j", False, None), 5: (None, True, None), 6: ("new", False, None)}


def test_mutations_and_acknowledgement(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, payload string")
    after = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k int, payload string")
    log = merge.mutations(before, after, ["k"])
    assert rows(log.select("k", "payload").fillna("-")) == [(2, "B"), (3, "-"), (4, "d")]
    assert merge.acknowledged(log, log.filter("k = 2"), ["k"]).filter("revision is null").first()["k"] == 2


def test_claim_prefers_newer(spark):
    df = spark.createDataFrame([("g", 1, 5), ("o", 1, 5), ("g", 2, 9), ("o", 2, 3), ("g", 3, 1)], "owner string, k int, time long")
    assert rows(merge.claimed(df, "g", "o", ["k"])) == [("o", 1, 5), ("o", 2, 9), ("o", 3, 1)]


def test_drift_finds_a_changed_column(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    assert audit.drift(a, a, "k", ["v"]).count() == 0
    b = a.withColumn("v", F.when(F.col("k") == 2, "z").otherwise(F.col("v"))).filter("k <> 1")
    assert rows(audit.drift(a, b, "k", ["v"])) == [(1, "extra", ""), (2, "differs", "v")]


def test_digest_has_no_order(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 2)
    d = lambda x: rows(audit.digest(x, ["g"], "id", F.to_json(F.struct("id"))))
    assert d(df) == d(df.repartition(7).orderBy(F.desc("id"))) != d(df.filter("id <> 3"))


def test_require_none(spark):
    with pytest.raises(audit.IntegrityError):
        audit.require_none(audit.duplicates(spark.createDataFrame([(1,), (1,)], "k int"), "k"), "twice")


def test_month_grid_begins_on_monday(spark):
    grid = history.month_grid(spark.range(1).select(F.lit("2024-02-14").cast("date").alias("d")), F.col("d")).orderBy("cell").collect()
    assert len(grid) == 42 and [r["day"] for r in grid[:4]] == [None, None, None, 1] and str(grid[0]["date"]) == "2024-01-29"


CELLS = "date string, course string, category string, locked boolean, completed boolean, blank boolean, item long"


def items(df):
    return {(r["date"], r["course"]): r["item"] for r in df.collect()}


def test_week_states(spark):
    rows = [("d1", "main", "A", True, False, False, None), ("d2", "main", "A", False, True, False, 9), ("d3", "main", "A", False, False, False, None), ("d4", "main", "none", False, False, False, None), ("d5", "main", "A", False, False, True, None), ("d6", "main", "A", False, False, False, 4), ("d6", "side", "A", False, False, False, None)]
    cells = spark.createDataFrame(rows, CELLS)
    food = spark.range(10).select(F.lit("A").alias("category"), F.col("id").alias("item"))
    plan = items(planner.ensured(cells, food, 3))
    assert plan["d1", "main"] is None and plan["d2", "main"] == 9 and plan["d3", "main"] in range(10) and plan["d4", "main"] is None and plan["d5", "main"] is None
    assert plan["d6", "main"] == 4 and plan["d6", "side"] is None
    assert plan == items(planner.ensured(cells.repartition(3), food.repartition(2), 3))
    again = items(planner.rerolled_week(cells, food, 3, 1))
    assert again["d1", "main"] is None and again["d2", "main"] == 9 and again["d5", "main"] is None and again["d6", "side"] in range(10)
    menu = items(planner.menu(cells, food, 3, F.lit("d6")))
    assert menu["d6", "main"] == 4 and menu["d6", "side"] in range(10) and menu["d3", "main"] is None
    blank = planner.rerolled(cells, food, 3, 1, F.lit("d5"), "main").filter("date = 'd5'").first()
    assert blank["item"] in range(10) and not blank["blank"]
    nothing = planner.rerolled(cells, food.limit(0), 3, 1, F.lit("d5"), "main").filter("date = 'd5'").first()
    assert nothing["item"] is None and nothing["blank"]


def test_draws_are_uniform_and_differ(spark):
    cells = spark.range(3000).select(F.concat(F.lit("d"), "id").alias("date"), F.lit("main").alias("course"), F.lit("A").alias("category"), *(F.lit(False).alias(c) for c in ("locked", "completed", "blank")), F.lit(None).cast("long").alias("item"))
    food = spark.range(10).select(F.lit("A").alias("category"), F.col("id").alias("item"))
    counts = [r["count"] for r in planner.ensured(cells, food, 3).groupBy("item").count().collect()]
    assert len(counts) == 10 and 230 < min(counts) and max(counts) < 370


def test_picks_by_narrowing(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("id"))
    for k in (0, 1, 777, 4998, 4999):
        assert select.pick_at(df, k, "id", few=20).first()[0] == k
    tied = df.withColumn("rank", F.struct((F.col("id") % 3).alias("a"), F.col("id").alias("b")))
    order = sorted(range(5000), key=lambda i: (i % 3, i))
    for k in (0, 2500, 4999):
        assert select.pick_at(tied, k, "rank", few=20).first()["id"] == order[k]
    assert select.pick_at(df.limit(0), 0, "id").count() == 0


def test_mixed_pick_takes_both_sides(spark):
    own, shared = spark.range(3), spark.range(100, 103)
    assert {select.mixed_pick(own, shared, seed, "id").first()[0] for seed in range(40)} == {0, 1, 2, 100, 101, 102}
    assert select.mixed_pick(own.limit(0), shared.limit(0), 1, "id").count() == 0


@pytest.mark.parametrize("width", [7, 50, 100_000])
def test_chunks_are_those_of_one_walk(spark, width):
    draw = random.Random(width)
    data = [(draw.choice(["a", "b", None]), 3 * k, draw.choice([1, 10, 40, 90, 250]), draw.choice([0, 0, 2, 3])) for k in range(400)] + [("c", 1, 500, 9), ("d", 7, None, None)]
    df = spark.createDataFrame(data, "g string, k long, n int, reads int").repartition(3)
    got = {r["k"] if r["g"] != "d" else -1: (r["g"], r["chunk"]) for r in records_.greedy_chunks(df, "g", "k", {"n": 200, "reads": 9}, 6, width=width).collect()}
    assert len(got) == len(data)
    state = {}
    for g, k, n, reads in sorted(data, key=lambda r: r[1]):
        n, reads = n or 0, reads or 0
        chunk, count, size, read = state.get(g, (0, 0, 0, 0))
        if count and (count >= 6 or size + n > 200 or read + reads > 9):
            chunk, count, size, read = chunk + 1, 0, 0, 0
        state[g] = chunk, count + 1, size + n, read + reads
        assert got[k if g != "d" else -1] == (g, chunk)
    assert records_.greedy_chunks(df.limit(0), "g", "k", {"n": 5}, 6).collect() == []
    six = spark.createDataFrame([("a", k, 60) for k in range(6)], "g string, k long, n int")
    assert len({r["chunk"] for r in records_.greedy_chunks(six, "g", "k", {"n": 100}, 6).collect()}) == 6


def test_arrays_directly_in_arrays(spark):
    texts = {"[1,[2]]": True, '[{"a":1},[2]]': True, "[[1]]": True, '[{"a":[1]}]': False, '["[[", "],["]': False, '{"a":[{"b":[{"c":[]}, [1]]}]}': True, "[]": False, '[1,{"a":[2]},3]': False, None: False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["x"] for r in df.withColumn("x", validate.array_in_array(F.col("t"))).collect()} == texts


def test_counted_page(spark):
    df = spark.range(30)
    assert [(r["id"], r["total"], r["has_more"]) for r in explore.counted_page(df, [F.asc("id")], 3, 26).collect()] == [(26, 30, True), (27, 30, True), (28, 30, True)]
    assert explore.counted_page(df, [F.asc("id")], 5, 30).count() == 0 and not explore.counted_page(df, [F.asc("id")], 5, 25).first()["has_more"]


def test_catalog_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    tokens = spark.createDataFrame([(1, "x", "t")], "id int, facet string, token string")
    catalog.write_catalog(df, tokens, str(tmp_path / "c"), {"named": F.col("name") != ""})
    got, found = catalog.read_catalog(spark, str(tmp_path / "c"))
    assert rows(got) == [(1, "a"), (2, "b")] and found.count() == 1
    assert [r["id"] for r in catalog.lookup(got, "id", [2, 7, 1]).collect()] == [2, 1]
    with pytest.raises(Exception, match="rule broken"):
        catalog.write_catalog(df, tokens, str(tmp_path / "d"), {"id": F.col("id") > 1})


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":1,"t":"x"}\n\n{"id":2}\n')
    assert rows(records.read_records(spark, str(tmp_path / "a.jsonl"), "id int, t string").fillna("")) == [(1, "x"), (2, "")]
    (tmp_path / "b.jsonl").write_text('{"id":1}\n{oops\n')
    assert sorted((r["id"] or 0, r["_corrupt_record"] is None) for r in records.read_records(spark, str(tmp_path / "b.jsonl"), "id int", strict=False).collect()) == [(0, False), (1, True)]
    with pytest.raises(Exception):
        records.read_records(spark, str(tmp_path / "b.jsonl"), "id int").collect()


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>/a</loc><lastmod>2024-01-01</lastmod></url><url><loc>/a</loc><lastmod>2024-02-01</lastmod></url><url><loc>/b</loc></url></urlset>")
    assert {tuple(r) for r in pages.read_sitemap(spark, str(tmp_path / "s.xml")).collect()} == {("/a", "2024-02-01"), ("/b", None)}


def test_sitemap_index_and_ids(spark, tmp_path):
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc>/s1</loc><lastmod>2024-01-01</lastmod></sitemap><sitemap><loc>/s2</loc></sitemap></sitemapindex>")
    assert {tuple(r) for r in pages.read_sitemap_index(spark, str(tmp_path / "i.xml")).collect()} == {("/s1", "2024-01-01"), ("/s2", None)}
    entries = spark.createDataFrame([("/r/1-old", "2024-01"), ("/r/1-new", "2024-02"), ("/r/2", None), ("/about", "2024-03")], "loc string, lastmod string")
    assert {tuple(r) for r in pages.by_page_id(entries, r"^/r/([0-9]+)").collect()} == {("1", "/r/1-new", "2024-02"), ("2", "/r/2", None)}


def test_wrapped_records_and_bad_lines(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"recipes": [{"id": 1, "t": "a"},\n {"id": 2, "t": "b"}]}')
    assert rows(records.read_wrapped(spark, str(tmp_path / "w.json"), "id int, t string", "recipes")) == [(1, "a"), (2, "b")]
    (tmp_path / "b.jsonl").write_text('\ufeff{"id":1}\n\n{oops\n{"id":2}\n[bad', encoding="utf-8")
    assert [(r["line"], r["text"]) for r in records.bad_lines(spark, str(tmp_path / "b.jsonl"), "id int").orderBy("line").collect()] == [(3, "{oops"), (5, "[bad")]


def test_payload_must_be_of_its_row(spark):
    fine = spark.createDataFrame([("1", '{"id":"1"}')], "id string, payload string")
    assert records.require_same_id(fine, "id", "payload").count() == 1
    with pytest.raises(Exception, match="another id"):
        records.require_same_id(fine.withColumn("id", F.lit("2")), "id", "payload").collect()


def test_reference_tables_as_rows(spark):
    df = spark.createDataFrame([(1, '[{"a":1},"x"]'), (2, "{}"), (3, "nothing"), (4, None)], "k int, body string")
    assert sorted((r["k"], r["data"], r["error"]) for r in pages.resolved_tables(df, "k", "body").collect()) == [(1, '{"a": "x"}', ""), (2, None, "no table"), (3, None, "no JSON"), (4, None, "no JSON")]


def test_links_of_a_page(spark):
    df = spark.createDataFrame([("https://www.a.org/p?x=1", '<a href="/q/">1</a><a href="//b.org/r">2</a><a href="mailto:x">3</a><a href="/q">4</a>')], "url string, html string")
    assert rows(pages.canonical_links(df)) == [("a.org/p", "a.org/q"), ("a.org/p", "b.org/r")]
    assert pages.chosen([{"url": "https://a/x"}, {"url": "https://a/y/"}], "https://a/y")["url"].endswith("y/") and pages.chosen([{}, {}], "z") is None and pages.chosen([{"n": 1}], "z") == {"n": 1}
