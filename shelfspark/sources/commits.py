"""Commit dumps.

A job reads an exported dump; it does not run git.  Records are separated by
0x1e and fields by 0x1f.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import strip

RECORD, FIELD = "\x1e", "\x1f"


def _records(spark: SparkSession, dump: str) -> DataFrame:
    lines = spark.read.option("lineSep", RECORD).text(dump)
    return lines.select(strip(F.col("value")).alias("value")).where("value <> ''")


def read_commit_log(spark: SparkSession, dump: str, checkout: str = "") -> DataFrame:
    """``hash, author, time, subject, body`` per record (S8); short records are dropped, a bad time is null."""
    parts = _records(spark, dump).select(F.split("value", FIELD, 5).alias("f")).where(F.size("f") >= 4)
    return parts.select(
        F.lit(checkout).alias("checkout"), F.col("f")[0].alias("hash"), F.col("f")[3].alias("subject"),
        strip(F.coalesce(F.get("f", 4), F.lit(""))).alias("body"), F.col("f")[1].alias("author"),
        F.try_to_timestamp(F.col("f")[2]).alias("authored_at"),
    )


def read_changes(spark: SparkSession, dump: str, checkout: str = "") -> DataFrame:
    """``committer time, hash, paths by line`` per record to one row per changed path."""
    parts = _records(spark, dump).select(F.split("value", FIELD, 3).alias("f")).where(F.size("f") == 3)
    path = F.explode(F.filter(F.transform(F.split(F.col("f")[2], "\n"), strip), lambda p: p != ""))
    return parts.select(
        F.lit(checkout).alias("checkout"), strip(F.col("f")[1]).alias("change_id"),
        F.try_to_timestamp(strip(F.col("f")[0])).alias("at"), path.alias("path"),
    ).where("change_id <> ''")


def read_dirty(spark: SparkSession, listing: str, checkout: str = "") -> DataFrame:
    """Uncommitted tracked paths, one per line."""
    return spark.read.text(listing).select(F.lit(checkout).alias("checkout"), strip(F.col("value")).alias("path")).where(
        "path <> ''"
    )
