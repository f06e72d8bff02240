"""Tables as a base and small deltas over hash buckets, merged on read.

A write stores only the changed rows, a folder for each bucket of their keys' hash, and then a manifest that lists the
versions of every bucket.  The manifest is the commit: a reader takes the newest complete one, so it sees all of a
write or nothing.  A repeated write of a version stores its files anew and replaces its manifest, so who reads the first
attempt's files can go on.  A bucket with many deltas is rewritten as a new base by the write that finds it so; other
buckets are left alone.

A key's newest version counts.  Only the keys of deltas are compared, so bases are read without a shuffle while the
deltas are small, which the manifest knows without a measuring job.
"""

from __future__ import annotations

import uuid
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sizing import MAX_BYTES, MAX_ROWS
from .snapshots import complete_versions

BUCKETS, MAX_DELTAS = 32, 8
MANIFEST = "bucket int, version int, attempt string, n long, key_bytes long"
GONE = "_gone"


@dataclass(frozen=True)
class Part:
    """One version of a bucket: its rows and the bytes of their keys."""

    bucket: int
    version: int
    attempt: str
    n: int
    key_bytes: int


def read_manifest(spark: SparkSession, path: str, before: int | None = None) -> list[Part]:
    """Parts of the newest complete write, or the newest older than ``before``; at most buckets x ``MAX_DELTAS`` and one each."""
    done = [v for v in complete_versions(spark, f"{path}/manifest") if before is None or v < before]
    if not done:
        return []
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{done[-1]}").orderBy("bucket", "version").collect()
    return [Part(*r) for r in rows]


def _stored(spark: SparkSession, path: str, schema: T.StructType, parts: list[Part]) -> DataFrame:
    full = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema], T.StructField(GONE, T.BooleanType()),
                         T.StructField("attempt", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    if not parts:
        return spark.createDataFrame([], full)
    paths = [f"{path}/data/attempt={p.attempt}/version={p.version}/bucket={p.bucket}" for p in parts]
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(*paths)


def _merged(spark: SparkSession, path: str, schema: T.StructType, key: list[str], parts: list[Part]) -> DataFrame:
    """Current rows of the listed parts, with their bucket."""
    of: dict[int, list[Part]] = {}
    for p in parts:
        of.setdefault(p.bucket, []).append(p)
    columns = [F.col(f.name) for f in schema] + [F.col("bucket")]
    alone = [p for own in of.values() if len(own) == 1 for p in own]
    mixed = [p for own in of.values() if len(own) > 1 for p in own]
    out = _stored(spark, path, schema, alone).where(f"NOT {GONE}").select(*columns)
    if not mixed:
        return out
    newer = [p for own in of.values() for p in own[1:]]
    newest = _stored(spark, path, schema, newer).groupBy(*key).agg(F.max("version").alias("_newest"))
    if sum(p.n for p in newer) <= MAX_ROWS and sum(p.key_bytes for p in newer) <= MAX_BYTES:
        newest = F.broadcast(newest)
    rows = _stored(spark, path, schema, mixed).join(newest, key, "left")
    current = F.col("_newest").isNull() | (F.col("version") == F.col("_newest"))
    return out.union(rows.where(current & ~F.col(GONE)).select(*columns))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, key: list[str], before: int | None = None) -> DataFrame:
    """The table as of the newest complete write, or the newest older than ``before``; empty when there is none."""
    schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    return _merged(spark, path, schema, key, read_manifest(spark, path, before)).drop("bucket")


def _write_parts(rows: DataFrame, path: str, version: int, key: list[str]) -> list[Part]:
    """Store ``rows`` (with their bucket) as one version; what was written, by bucket."""
    spark = rows.sparkSession
    attempt = f"a{uuid.uuid4().hex}"
    folder = f"{path}/data/attempt={attempt}/version={version}"
    rows.repartition("bucket").sortWithinPartitions(*key).write.partitionBy("bucket").parquet(folder)
    size = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in key), F.lit(0))
    kinds = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema if f.name in key], T.StructField("bucket", T.IntegerType())])
    found = spark.read.schema(kinds).parquet(folder).groupBy("bucket").agg(F.count("*").alias("n"), F.sum(size).alias("b")).collect()
    return [Part(r["bucket"], version, attempt, r["n"], r["b"]) for r in found]


def write_delta(changes: DataFrame, path: str, key: list[str], version: int, gone: DataFrame | None = None,
                buckets: int = BUCKETS, max_deltas: int = MAX_DELTAS) -> list[int]:
    """Commit ``changes``, at most one row for each key, and the removal of the keys in ``gone``, as ``version`` (1, 2, ...).

    Builds on the newest write before ``version``.  Returns the buckets that were written.  The number of buckets is fixed
    by the first write of a table.
    """
    spark = changes.sparkSession
    schema = changes.schema
    rows = changes.withColumn(GONE, F.lit(False))
    if gone is not None:
        rows = rows.unionByName(gone.select(*key).distinct().withColumn(GONE, F.lit(True)), allowMissingColumns=True)
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    fresh = _write_parts(rows.withColumn("bucket", bucket), path, 2 * version, key)
    parts = read_manifest(spark, path, version) + fresh
    count: dict[int, int] = {}
    for p in parts:
        count[p.bucket] = count.get(p.bucket, 0) + 1
    long = [p for p in parts if count[p.bucket] > max_deltas]
    if long:
        base = _merged(spark, path, schema, key, long).withColumn(GONE, F.lit(False))
        parts = [p for p in parts if count[p.bucket] <= max_deltas] + _write_parts(base, path, 2 * version + 1, key)
    spark.createDataFrame([astuple(p) for p in parts], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{version}")
    return sorted({p.bucket for p in fresh})


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the files that none of the newest ``keep`` manifests lists, and older manifests; returns how many folders went.

    For when nobody writes the table or reads an older write of it.
    """
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = complete_versions(spark, f"{path}/manifest")
    if not done:
        return 0
    listed = {f"attempt={p.attempt}/version={p.version}/bucket={p.bucket}" for v in done[-keep:] for p in read_manifest(spark, path, v + 1)}
    found = fs.globStatus(jvm(f"{path}/data/attempt=*/version=*/bucket=*"))
    gone = [f.getPath() for f in found if "/".join(str(f.getPath()).split("/")[-3:]) not in listed]
    for folder in gone:
        fs.delete(folder, True)
    for v in done[:-keep]:
        fs.delete(jvm(f"{path}/manifest/v{v}"), True)
    return len(gone)
