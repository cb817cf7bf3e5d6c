import random

import pytest
from pyspark.sql import functions as F

from quern.functions.text import title_key
from quern.operators.audit import IntegrityError
from quern.sources import indexes as ix


def scanned(df):
    """Rows that came out of a query's file scans, after row groups and pages were left out."""
    df.collect()
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        if p.nodeName().startswith("Scan parquet") or p.nodeName() == "FileScan parquet":
            m = p.metrics().get("numOutputRows")
            total += m.get().value() if m.isDefined() else 0
        if p.nodeName() == "AdaptiveSparkPlan":
            plans.append(p.executedPlan())
        if "QueryStage" in p.nodeName():
            plans.append(p.plan())
        kids = p.children()
        plans += [kids.apply(i) for i in range(kids.size())]
    return total


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    draw = random.Random(5)
    words = ["red", "ring", "spring", "in", "blue", "ingot", "σουβλάκι", "été", "a", "of"]
    data = [(7 * k, " ".join(draw.choices(words, k=draw.randint(0, 4))) + (f" no{k}" if k % 3 else "")) for k in range(3000)]
    df = spark.createDataFrame(data, "k long, t string").repartition(4)
    facets = df.select("k", F.explode(F.split("t", " ")).alias("token"), F.lit("word").alias("facet")).filter("token <> ''").unionAll(df.select("k", F.concat(F.lit("b"), F.col("k") % 5), F.lit("brand")))
    path = str(tmp_path_factory.mktemp("index"))
    ix.build(df, "k", title_key(F.col("t")), facets, path, "rules 1")
    return df.withColumn("title", title_key(F.col("t"))), facets, path


def keys(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize("terms", [["ring"], ["in"], ["spring", "red"], ["suvlaki"], ["no17"], ["a"], ["zzzz"], [], ["red ring"]])
@pytest.mark.parametrize("whole", [False, True])
def test_titles_as_by_scan(spark, catalog, terms, whole):
    df, _, path = catalog
    folder = ix.opened(spark, path, "rules 1", 3000)
    test = F.lit(True)
    for t in terms:
        test = test & (F.contains(F.concat(F.lit(" "), F.col("title"), F.lit(" ")), F.lit(f" {t} " if whole else t)))
    assert keys(ix.titled(spark, folder, terms, whole).select("key")) == keys(df.filter(test).select("k"))


def test_fewer_rows_are_read(spark, catalog):
    folder = ix.opened(spark, catalog[2], "rules 1")
    grams = spark.read.parquet(f"{folder}/grams")
    assert scanned(grams.filter(F.col("gram").isin(["ing", "rin"]))) < grams.count() / 2
    facets = spark.read.parquet(f"{folder}/facets")
    assert scanned(facets.filter((F.col("facet") == "brand") & F.col("token").isin(["b1"]))) < facets.count() / 2


@pytest.mark.parametrize("groups,without", [({"word": ["red"]}, {}), ({"word": ["red", "ring"], "brand": ["b1", "b2"]}, {"word": ["in"]}), ({"brand": ["b3"]}, {"word": ["none", "été"]}), ({}, {"brand": ["b0"]}), ({"word": ["none"]}, {}), ({}, {})])
def test_facets_as_by_joins(spark, catalog, groups, without):
    df, facets, path = catalog
    folder = ix.opened(spark, path, "rules 1")
    want = df.select("k")
    for how, part in (("left_semi", groups), ("left_anti", without)):
        for f, ts in part.items():
            want = want.join(facets.filter((F.col("facet") == f) & F.col("token").isin(ts)), "k", how)
    spans = ix.selected(spark, folder, groups, without)
    assert keys(ix.keys_of(spark, folder, spans)) == keys(want)
    assert ix.counted(spans).first()["n"] == want.count()


def test_counts_of_tokens(spark, catalog):
    _, facets, path = catalog
    folder = ix.opened(spark, path, "rules 1")
    count = lambda df: {(r["facet"], r["token"]): r["n"] for r in df.collect()}
    assert count(ix.token_counts(spark, folder)) == count(facets.groupBy("facet", "token").agg(F.count_distinct("k").alias("n")))
    reds = facets.filter("facet = 'word' and token = 'red'").select("k").distinct()
    assert count(ix.token_counts(spark, folder, ix.selected(spark, folder, {"word": ["red"]}))) == count(facets.join(reds, "k").groupBy("facet", "token").agg(F.count_distinct("k").alias("n")))


def test_stale_and_incomplete_indexes_are_not_opened(spark, catalog, tmp_path):
    for bad in (lambda: ix.opened(spark, catalog[2], "rules 2"), lambda: ix.opened(spark, catalog[2], "rules 1", 2999), lambda: ix.opened(spark, str(tmp_path), "rules 1")):
        with pytest.raises(IntegrityError):
            bad()


def test_bitmaps_of_few_and_many():
    for nths in ([], [0], [65535], list(range(0, 65536, 3)), list(range(65536))):
        assert list(ix.np.flatnonzero(ix.np.unpackbits(ix.bits_of(ix.packed(nths)), bitorder="little"))) == nths
