import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quern.operators import merge, normalize, personal, validate
from quern.operators.audit import IntegrityError
from quern.sources import catalog, release

H = "a" * 64


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def manifest(**more):
    return release.Manifest(**({"source_key": "s", "complete": True, "language": "el", "failed": 0, "rows": 2, "hashes": {"catalogHash": H}} | more))


def test_manifest_gate():
    release.require_manifest(manifest(), "el")
    for bad in ({"language": "en"}, {"hashes": {"catalogHash": "x"}}, {"complete": False}, {"failed": 3}):
        with pytest.raises(IntegrityError):
            release.require_manifest(manifest(**bad), "el")
    partial = {"complete": False, "partial_note": "why", "snapshot_validated": True}
    release.require_manifest(manifest(**partial), "el", allow_partial=True)
    for bad in ({"partial_note": " "}, {"snapshot_validated": False}, {"failed_normalizations": 1}):
        with pytest.raises(IntegrityError):
            release.require_manifest(manifest(**partial | bad), "el", allow_partial=True)


def test_manifest_file(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"sourceKey": "s", "complete": true, "language": "el", "failedRecipeCount": 0, "activeRecipeCount": 2,\n "catalogHash": "%s", "detailHash": "%s", "summaryHash": "%s"}' % (H, H, H))
    release.require_manifest(release.read_manifest(spark, str(tmp_path / "m.json")), "el")
    assert release.file_digests(spark, str(tmp_path / "m.json")).first()["digest"] != H


def test_union_of_sources(spark):
    a, b = (spark.createDataFrame(r, "id int, source string") for r in ([(1, "a"), (2, "a")], [(3, "b"), (2, "x")]))
    _, problems = release.united({"a": (manifest(source_key="a"), a), "b": (manifest(source_key="b", rows=5), b)}, "id", "source")
    assert rows(problems) == [("foreign source", "b", 1), ("repeated id", "2", 2), ("wrong count", "b", 2)]


def test_promotion_is_whole_or_nothing(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(IntegrityError):
        release.promoted(spark, {"x": df}, str(tmp_path / "bad"), lambda: df)
    assert not (tmp_path / "bad").exists()
    release.promoted(spark, {"x": df}, str(tmp_path / "good"), lambda: df.limit(0))
    assert rows(spark.read.parquet(str(tmp_path / "good/manifest"))) == [("x", 3)]


def test_checkpoint_copy(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, "c")], "k int, v string")
    assert rows(release.copied_checkpoint(df.filter("k <> 2"), "k", F.col("k") > 1, F.col("v") == "", "r")) == [(3, "c", "r")]
    with pytest.raises(Exception, match="broken row 2"):
        release.copied_checkpoint(df, "k", F.lit(True), F.col("v") == "", "r").collect()
    with pytest.raises(Exception, match="repeated key 1"):
        release.copied_checkpoint(df.unionAll(df.limit(1)).filter("k <> 2"), "k", F.lit(True), F.col("v") == "", "r").collect()


def test_tree_digest_has_no_partitions(spark):
    df = spark.range(3000)
    d = lambda x: release.tree_digest(x, release.framed(F.col("id"), F.lit("v")), F.col("id")).first()
    assert d(df) == d(df.repartition(7)) and d(df)["digest"] != d(df.filter("id <> 5"))["digest"]


def test_frames_are_told_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    assert df.select(release.framed(F.col("x"), F.col("y")).alias("f")).distinct().count() == 2


def test_shapes():
    deep = IntegerType()
    for _ in range(25):
        deep = StructType([StructField("x", deep)])
    assert validate.shape_problems(deep) and not validate.shape_problems(StructType([StructField("a", ArrayType(StructType([StructField("b", ArrayType(IntegerType()))])))]))
    assert validate.shape_problems(StructType([StructField("a", ArrayType(ArrayType(IntegerType())))])) == ["a: an array in an array"]
    assert validate.unknown_fields(StructType([StructField("a", deep), StructField("z", deep)]), {"a"}) == ["z"]


def test_plans_are_of_one_vocabulary():
    validate.require_plan("v1", "v1", ["a"], {"a"}, 3, 3)
    for bad in (("v2", "v1", ["a"], {"a"}, 3, 3), ("v1", "v1", ["b"], {"a"}, 3, 3), ("v1", "v1", [], {"a"}, 2, 3)):
        with pytest.raises(IntegrityError):
            validate.require_plan(*bad)


def test_odd_payloads(spark):
    df = spark.createDataFrame([(1, None), (2, "oops"), (3, "{}"), (4, '{"title":" a  b ","average_score":"9,5","make_time":"2 hours","tags":["x"," ","x"]}')], "k int, p string")
    got = {r["k"]: r for r in normalize.records_of_payloads(df, "k", "p").collect()}
    assert [got[k]["title"] for k in (1, 2, 3, 4)] == ["", "", "", "a b"] and got[3]["totalMinutes"] == 0 and not got[3]["quickRecipe"]
    assert (got[4]["prepMinutes"], got[4]["rating10"], got[4]["tags"]) == (120, 9.5, ["x"])


def test_codec_round_trip(spark):
    df = spark.createDataFrame([("o", 1, "a", 5.0), ("o", 2, None, None)], "owner string, k int, name string, v double")
    rows_ = personal.encoded(df, "owner", "c", F.col("k"), F.lit(7), ["name", "k", "v"])
    assert sorted((r["document_id"], r["name"], r["v"]) for r in personal.decoded(rows_, "c", "k int, name string, v double").collect()) == [("1", "a", 5.0), ("2", None, None)]
    assert personal.decoded(rows_, "other", "k int").count() == 0 and personal.decoded(rows_.withColumn("payload", F.lit(None).cast("string")), "c", "k int").count() == 0


def test_aliases_expand():
    groups = {"Bolt": ["bolt", "screw"], "Ring": ["ring"]}
    assert normalize.expanded(frozenset({"screw", "x"}), groups) == {"screw", "bolt", "x"} and normalize.expanded(frozenset({"x"}), groups) == {"x"}


def test_a_patch_needs_the_same_identity(spark):
    a = spark.createDataFrame([(1, "s", "x"), (2, "s", "y")], "k int, source string, v string")
    assert merge.same_identity(a, a.withColumn("v", F.lit("z")), "k", ["source"]).count() == 2
    with pytest.raises(Exception, match="another identity: 2"):
        merge.same_identity(a, a.withColumn("source", F.when(F.col("k") == 2, "t").otherwise("s")), "k", ["source"]).collect()


def test_changed_pages(spark):
    store = spark.createDataFrame([("u", "1", None, None, "pending")], "url string, lastmod string, body binary, digest string, status string")
    now = catalog.stored_pages(store, spark.createDataFrame([("u", "1", "text"), ("w", "1", None)], "url string, lastmod string, body string"))
    assert rows(now.select("url", "status")) == [("u", "done"), ("w", "failed")]
    again = spark.createDataFrame([("u", "2", "text"), ("x", "2", "new")], "url string, lastmod string, body string")
    assert rows(catalog.changed_pages(now, again).select("url")) == [("x",)]


def test_runs_keep_to_themselves(spark):
    old = spark.createDataFrame([(1, "a", "r1")], "k int, v string, run_key string")
    out = catalog.upserted_run(old, spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"], "r2")
    assert rows(out.select("run_key", "k", "v")) == [("r1", 1, "a"), ("r2", 1, "b"), ("r2", 2, "c")]
