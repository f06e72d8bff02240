"""Table snapshots: numbered folders, complete once Spark has written ``_SUCCESS``.

A reader takes the newest complete version, so it sees an old or a new
snapshot and never a half-written one.  A retried write overwrites its own
version only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def complete_versions(spark: SparkSession, base: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    numbered = [int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)]
    return sorted(v for v in numbered if fs.exists(path(f"{base}/v{v}/_SUCCESS")))


def read_snapshot(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """Newest complete version, or the newest older than ``before``; None when there is none."""
    versions = [v for v in complete_versions(spark, base) if before is None or v < before]
    return spark.read.parquet(f"{base}/v{versions[-1]}") if versions else None


def write_snapshot(df: DataFrame, base: str, version: int, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{base}/v{version}")
