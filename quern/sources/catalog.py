"""Catalogs on disk: partitioned tables with checks on the way in, lookups, checkpoints that are reused, retirement."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.select import by_request
from . import snapshots as sn
from .records import deflated


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df; reading a row that breaks a rule fails the job with the rule's name."""
    for name, rule in sorted(rules.items()):
        df = df.filter(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"rule broken: {name}")).cast("boolean")))
    return df


def write_catalog(records: DataFrame, facets: DataFrame, path: str, rules: dict[str, Column]) -> int:
    """Writes records, and facets by facet, as a new version, whose number is returned. The version is named last, by a rename; one that a rule or a lost writer ends leaves the versions before it as they were."""
    spark = records.sparkSession
    version = (sn.versions(spark, path) or [-1])[-1] + 1
    folder = f"data/{uuid.uuid4().hex}"
    checked(records, rules).write.parquet(f"{path}/{folder}/records")
    facets.repartition("facet").write.partitionBy("facet").parquet(f"{path}/{folder}/facets")
    sn.put_once(spark, f"{path}/snapshots/{version:012d}.json", json.dumps({"folder": folder}))
    return version


def read_catalog(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, facets) of a version, or of the newest."""
    if version is None:
        if not (known := sn.versions(spark, path)):
            raise ValueError(f"the catalog at {path} isn't complete")
        version = known[-1]
    folder = json.loads(spark.read.text(f"{path}/snapshots/{version:012d}.json", wholetext=True).first()[0])["folder"]
    return spark.read.parquet(f"{path}/{folder}/records"), spark.read.parquet(f"{path}/{folder}/facets")


def lookup(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows of some keys, in the order asked for."""
    return by_request(df, wanted, key).drop("place")


def reused(discovered: DataFrame, checkpoint: DataFrame, key: str, version: str) -> DataFrame:
    """discovered with the checkpoint's payload where key and version are the same, and what must be fetched."""
    known = checkpoint.select(key, version, "payload").dropDuplicates([key, version])
    return discovered.join(known, [key, version], "left").withColumn("fetch", F.col("payload").isNull())


def upserted(checkpoint: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    both = checkpoint.withColumn("part", F.lit(0)).unionByName(fresh.withColumn("part", F.lit(1)))
    return both.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("part")))).filter("r = 1").drop("r", "part")


def retired(previous: DataFrame, discovered: DataFrame, key: str) -> DataFrame:
    """Previous rows that aren't found any more, marked as no longer active."""
    return previous.join(discovered.select(key), key, "left_anti").withColumn("active", F.lit(False))


def reconciled(sitemap: DataFrame, api: DataFrame, key: str, modified: str) -> DataFrame:
    """The API's rows with the later of two times; require that audit.set_equality of sitemap keys finds none missing first."""
    s = sitemap.select(key, F.col(modified).alias("other"))
    return api.join(s, key, "left").withColumn(modified, F.greatest(modified, "other")).drop("other")


def page_states(stored: DataFrame, discovered: DataFrame) -> DataFrame:
    """(url, lastmod, status): stored pages, pending again where discovery has another time, and new ones, pending."""
    found = discovered.groupBy("url").agg(F.max("lastmod").alias("found"))
    both = stored.join(found, "url", "full_outer")
    changed = F.col("found").isNotNull() & ~F.col("found").eqNullSafe(F.col("lastmod"))
    return both.select("url", F.when(changed, F.col("found")).otherwise(F.col("lastmod")).alias("lastmod"), F.when(changed | F.col("status").isNull(), "pending").otherwise(F.col("status")).alias("status"))


def accounted(outcomes: DataFrame, discovered: DataFrame, key: str) -> DataFrame:
    """Keys that discovery and the outcomes don't share, or that have several outcomes: none if all is accounted for."""
    each = outcomes.groupBy(key).agg(F.count("*").alias("n"))
    both = discovered.select(key).distinct().withColumn("found", F.lit(True)).join(each, key, "full_outer")
    fault = F.when(F.col("found").isNull(), "undiscovered").when(F.col("n").isNull(), "without outcome").when(F.col("n") > 1, "several outcomes")
    return both.select(key, fault.alias("fault")).filter(F.col("fault").isNotNull())


def sitemap_only(sitemap: DataFrame, api: DataFrame, key: str) -> DataFrame:
    """Keys that only the sitemap has: require_none() of these comes before reconciled()."""
    return sitemap.select(key).join(api.select(key), key, "left_anti")


def stored_pages(store: DataFrame, fetched: DataFrame) -> DataFrame:
    """(url, lastmod, body, digest, status) of a page store after pages (url, lastmod, body) were fetched: bodies compressed, each with the SHA-256 of its text. What was fetched is done, a body that is missing has failed, and other pages stay."""
    body = F.col("body")
    fresh = fetched.select("url", "lastmod", deflated(body).alias("body"), F.sha2(body, 256).alias("digest"), F.when(body.isNull(), "failed").otherwise("done").alias("status"))
    return upserted(store, fresh, ["url"])


def changed_pages(store: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched pages whose text differs from the stored one's, by digest."""
    known = store.select("url", F.col("digest").alias("_known"))
    return fetched.join(known, "url", "left").filter(~F.sha2("body", 256).eqNullSafe(F.col("_known"))).drop("_known")


def upserted_run(checkpoint: DataFrame, fresh: DataFrame, keys: list[str], run: str) -> DataFrame:
    """upserted() for one run: rows of other runs stay as they are, and fresh rows are the run's."""
    return upserted(checkpoint, fresh.withColumn("run_key", F.lit(run)), ["run_key", *keys])


def resumed(payloads: DataFrame, facets: DataFrame, run: str, resume: bool = True) -> tuple[DataFrame, DataFrame]:
    """A crawl's checkpoints (id, lastmod, payload) and (run_key, facet, option, ids) as a run may use them: facets of another run's key, or of another taxonomy's, go, while payloads stay, as they are told apart by their own time. Without resume all go."""
    if not resume:
        return payloads.limit(0), facets.limit(0)
    return payloads, facets.filter(F.col("run_key").eqNullSafe(F.lit(run)))
