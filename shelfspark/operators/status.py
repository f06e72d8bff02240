"""Counts and the status roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import records as R


def last_indexed(files: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """``[checkout, last_indexed]``; a checkout without its own stamp falls back to the shared one.

    ``meta[checkout, last_indexed]`` holds stamps; the fallback only applies to a
    checkout without files while shared files exist.
    """
    if meta is None:
        return files.groupBy("checkout").agg(F.max("indexed_at").alias("last_indexed"))
    counts = files.groupBy("checkout").agg(F.count("*").alias("n"))
    shared_files = counts.agg(F.coalesce(F.max(F.when(F.col("checkout") == "", F.col("n"))), F.lit(0)).alias("legacy"))
    shared_stamp = meta.agg(F.max(F.when(F.col("checkout") == "", F.col("last_indexed"))).alias("shared"))
    rows = meta.join(counts, "checkout", "full").join(F.broadcast(shared_files)).join(F.broadcast(shared_stamp))  # one row each
    falls_back = F.col("n").isNull() & (F.col("legacy") > 0)
    return rows.select(
        "checkout", F.coalesce("last_indexed", F.when(falls_back, F.col("shared"))).alias("last_indexed")
    )


def status(records: DataFrame, files: DataFrame, vectors: DataFrame, attempts: DataFrame,
           extractor: DataFrame | None = None, version: int = 1, model: str | None = None) -> DataFrame:
    """One row per checkout: records, files, missing vectors, queue depth, give-ups, last index time, stale extractor.

    ``vectors[record_id, (model)]``; ``attempts[key, state]`` keyed by record id;
    ``extractor[checkout, version]``.
    """
    have = vectors if model is None else vectors.where(F.col("model") == model)
    marked = (
        records.select("id", "checkout", "status")
        .join(have.select(F.col("record_id").alias("id"), F.lit(True).alias("v")).distinct(), "id", "left")
        .join(attempts.select(F.col("key").alias("id"), "state"), "id", "left")
    )
    lacks = F.col("v").isNull() & R.is_current(F.col("status"))
    rec = marked.groupBy("checkout").agg(
        F.count("*").alias("records"), F.sum(lacks.cast("long")).alias("missing_vectors"),
        F.sum((F.coalesce("state", F.lit("")) == "queued").cast("long")).alias("queue_depth"),
        F.sum((F.coalesce("state", F.lit("")) == "giveup").cast("long")).alias("giveups"),
    )
    code = files.groupBy("checkout").agg(F.count("*").alias("files"), F.max("indexed_at").alias("last_indexed"))
    out = rec.join(code, "checkout", "full")
    if extractor is not None:
        out = out.join(extractor.select("checkout", F.col("version").alias("have")), "checkout", "left")
    else:
        out = out.withColumn("have", F.lit(None).cast("int"))
    stale = (F.coalesce("files", F.lit(0)) > 0) & (F.col("have").isNull() | (F.col("have") < version))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("records", "missing_vectors", "queue_depth", "giveups", "files")]
    return out.select("checkout", *counts, "last_indexed", stale.alias("reindex"))
