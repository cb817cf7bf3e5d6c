"""Keyed tables on disk as numbered snapshots: copy-on-write by buckets, one atomic commit, and digests that tell where two differ.

A table is a folder. data/<commit>/_bucket=<k> holds the rows of a bucket of keys as one commit wrote them, and
snapshots/<number>.json says of which commit each bucket is, with its rows and digest. A commit writes the buckets that it
touches anew and then puts the next number in place by a rename that fails if the number is taken. So a reader sees a whole
snapshot or none; a writer that dies leaves the newest one as it was, and a writer whose base isn't the newest any more
gets a Conflict, and may read again and retry. The driver holds a line per bucket, whatever the rows.

A row's digest is of its framed fields; those of a 4096th of a bucket's keys are hashed together in order, and so are these of
a bucket. Only written buckets are hashed. Two snapshots are compared from the top: equal roots, then equal buckets, then
rows of the buckets that differ.

Keys are unique and may be null. An empty table has a snapshot without buckets.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.audit import IntegrityError

BUCKETS = 64
SPANS = 4096


class Conflict(RuntimeError):
    """Another writer has committed on the same base."""


@dataclass(frozen=True)
class Part:
    """A bucket: the commit that wrote it, its rows, their digest."""

    commit: str
    rows: int
    digest: str


@dataclass(frozen=True)
class Snapshot:
    version: int
    keys: list[str]
    schema: dict
    buckets: int
    parts: dict[int, Part] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts.values())

    @property
    def digest(self) -> str:
        return hashlib.sha256("".join(f"{k}:{p.digest}" for k, p in sorted(self.parts.items())).encode()).hexdigest()


def _context(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    qualified = place.getFileSystem(conf).makeQualified(place)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf), qualified


def put_once(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file under a name that must be free: first under another name, then renamed. Raises Conflict if it is taken."""
    jvm = spark._jvm
    files, to = _context(spark, path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    temporary = jvm.org.apache.hadoop.fs.Path(to.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        files.rename(temporary, to, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        fs.delete(temporary, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise Conflict(path) from None
        raise


def versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshots")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """One snapshot, or the newest."""
    if version is None:
        if not (known := versions(spark, path)):
            raise IntegrityError(f"no snapshot at {path}")
        version = known[-1]
    text = spark.read.text(f"{path}/snapshots/{version:012d}.json", wholetext=True).first()[0]
    found = json.loads(text)
    return Snapshot(**found | {"parts": {int(k): Part(**p) for k, p in found["parts"].items()}})


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def rows_of(spark: SparkSession, path: str, snap: Snapshot, only: set[int] | None = None) -> DataFrame:
    """The rows of a snapshot, or of some of its buckets."""
    schema = StructType.fromJson(snap.schema)
    places = [f"{path}/data/{p.commit}/_bucket={k}" for k, p in sorted(snap.parts.items()) if only is None or k in only]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return rows_of(spark, path, snapshot(spark, path, version))


def _row_digest(columns: list[str]) -> Column:
    text = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(text, columns)), 256)


def bucket_digests(rows: DataFrame, keys: list[str], buckets: int) -> dict[int, tuple[int, str]]:
    """(rows, digest) of each bucket, a line per bucket. Raises if a key repeats."""
    complex_ = {f.name for f in rows.schema if f.dataType.typeName() in ("array", "map", "struct")}
    named = rows.select(*(F.to_json(c).alias(c) if c in complex_ else F.col(c) for c in rows.columns))
    place = F.struct(bucket_of(keys, buckets).alias("bucket"), F.pmod(F.shiftright(F.xxhash64(*keys), 32), F.lit(SPANS)).alias("span"))
    each = named.select(place.alias("p"), F.sha2(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), *(F.col(k).isNull().cast("string") for k in keys)), 256).alias("k"), _row_digest(rows.columns).alias("h"))
    span = each.groupBy("p").agg(F.count("*").alias("n"), F.size(F.array_distinct(F.collect_list("k"))).alias("keys"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    whole = span.groupBy("p.bucket").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p.span", "h"))), lambda x: F.concat(x["span"].cast("string"), F.lit(":"), x["h"])), ""), 256).alias("h"))
    found = whole.collect()
    if bad := [r["bucket"] for r in found if r["n"] != r["keys"]]:
        raise IntegrityError(f"keys repeat in buckets {bad[:5]}")
    return {r["bucket"]: (r["n"], r["h"]) for r in found}


def _written(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], buckets: int) -> dict[int, Part]:
    commit = uuid.uuid4().hex
    rows.withColumn("_bucket", bucket_of(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/data/{commit}")
    back = spark.read.schema(rows.schema).parquet(f"{path}/data/{commit}")
    return {k: Part(commit, n, h) for k, (n, h) in bucket_digests(back.select(*rows.columns), keys, buckets).items()}


def _committed(spark: SparkSession, path: str, snap: Snapshot) -> Snapshot:
    put_once(spark, f"{path}/snapshots/{snap.version:012d}.json", json.dumps(asdict(snap), sort_keys=True))
    return snap


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> Snapshot:
    """The first snapshot. Raises Conflict if there is one."""
    spark = rows.sparkSession
    return _committed(spark, path, Snapshot(0, keys, rows.schema.jsonValue(), buckets, _written(spark, path, rows, keys, buckets)))


def replaced(rows: DataFrame, path: str, base: Snapshot) -> Snapshot:
    """The next snapshot, with other rows and maybe another schema."""
    spark = rows.sparkSession
    return _committed(spark, path, Snapshot(base.version + 1, base.keys, rows.schema.jsonValue(), base.buckets, _written(spark, path, rows, base.keys, base.buckets)))


def rewritten(path: str, base: Snapshot, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> Snapshot:
    """The next snapshot: the buckets of touched keys with their rows after a change, all others as they are. Raises Conflict if base isn't the newest any more, IntegrityError if the change gives rows of other buckets."""
    spark = touched.sparkSession
    buckets = {r[0] for r in touched.select(bucket_of(base.keys, base.buckets)).distinct().collect()}  # at most one per bucket
    after = change(rows_of(spark, path, base, buckets))
    fresh = _written(spark, path, after.select(*StructType.fromJson(base.schema).fieldNames()), base.keys, base.buckets)
    if beyond := sorted(set(fresh) - buckets):
        raise IntegrityError(f"rows of untouched buckets {beyond[:5]}")
    parts = {k: p for k, p in base.parts.items() if k not in buckets} | fresh
    return _committed(spark, path, Snapshot(base.version + 1, base.keys, base.schema, base.buckets, parts))


def upserted(path: str, base: Snapshot, rows: DataFrame, removed: DataFrame | None = None) -> Snapshot:
    """The next snapshot with rows put by key, and keys removed."""
    keys = base.keys
    gone = rows.select(*keys) if removed is None else rows.select(*keys).unionAll(removed.select(*keys))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    return rewritten(path, base, gone, lambda old: old.join(gone, same(old, gone), "left_anti").unionByName(rows.select(*old.columns)))


def compare_and_set(path: str, base: Snapshot, changes: DataFrame, version: str) -> tuple[Snapshot, DataFrame]:
    """Changes (keys, version: the one they were read with, and new values of other columns; one for a key) applied to rows that still have that version, and (keys, outcome) of each: applied, stale or missing. A number as version grows by one, a text becomes a digest of what was and of the row."""
    keys = base.keys
    fields = [c for c in changes.columns if c not in (*keys, version)]
    asked = changes.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(version).alias("_expected"), F.lit(True).alias("_asked"), *(F.col(f).alias(f"_n_{f}") for f in fields))
    fits = lambda df: [df[k].eqNullSafe(asked[f"_k_{k}"]) for k in keys]

    def change(old: DataFrame) -> DataFrame:
        hit = F.coalesce(F.col("_asked"), F.lit(False)) & F.col("_expected").eqNullSafe(F.col(version))
        new = old.join(asked, fits(old), "left").withColumns({f: F.when(hit, F.col(f"_n_{f}")).otherwise(F.col(f)) for f in fields})
        text = old.schema[version].dataType.typeName() == "string"
        after = F.sha2(F.concat_ws("|", F.col(version), _row_digest([c for c in old.columns if c != version])), 256) if text else F.col(version) + 1
        return new.withColumn(version, F.when(hit, after).otherwise(F.col(version))).select(*old.columns)

    now = rows_of(changes.sparkSession, path, base).select(*(F.col(k).alias(f"_o_{k}") for k in keys), F.col(version).alias("_now"), F.lit(True).alias("_there"))
    outcome = F.when(F.col("_there").isNull(), "missing").when(F.col("_now").eqNullSafe(F.col(version)), "applied").otherwise("stale")
    outcomes = changes.join(now, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys], "left").select(*keys, outcome.alias("outcome"))
    return rewritten(path, base, changes, change), outcomes


def verified(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a snapshot whose files hold what it says; else IntegrityError. Files are hashed before they are given out."""
    snap = snapshot(spark, path, version)
    rows = rows_of(spark, path, snap)
    said = {k: (p.rows, p.digest) for k, p in snap.parts.items()}
    if (found := bucket_digests(rows, snap.keys, snap.buckets)) != said:
        raise IntegrityError(f"{path}: buckets {sorted(k for k in said.keys() | found.keys() if said.get(k) != found.get(k))[:5]} aren't what snapshot {snap.version} says")
    return rows


def differing(spark: SparkSession, path: str, a: Snapshot, b: Snapshot) -> DataFrame:
    """(keys, kind: added, removed, changed) between two snapshots of one table, of which only the buckets that differ are read."""
    own = lambda s: {k: p.digest for k, p in s.parts.items()}
    x, y = own(a), own(b)
    where = set() if a.digest == b.digest else {k for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    keys = a.keys
    sides = [rows_of(spark, path, s, where).select(*(F.col(k).alias(f"{n}_{k}") for k in keys), _row_digest(StructType.fromJson(s.schema).fieldNames()).alias(f"_{n}")) for n, s in (("a", a), ("b", b))]
    both = sides[0].join(sides[1], [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys], "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(*(F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys), kind.alias("kind")).filter(F.col("kind").isNotNull())


def forgotten(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes all snapshots but the newest, and what no kept one refers to, such as what writers left that died or lost; how many folders. Run it when no writer is at work."""
    kept = versions(spark, path)[-keep:]
    used = {p.commit for v in kept for p in snapshot(spark, path, v).parts.values()}
    Path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: N806
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for v in versions(spark, path)[:-keep]:
        fs.delete(Path(f"{path}/snapshots/{v:012d}.json"), False)
    gone = [f.getPath() for f in fs.listStatus(Path(f"{path}/data")) if f.getPath().getName() not in used]
    return sum(fs.delete(p, True) for p in gone)
