"""The stages of the corpus pipeline, each one operator whose decisions take effect.

A stage's result must be written before the next stage starts: a stage deletes the tables that the stages before it
left in the shared folder, so that they do not add up.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_tables, start_record, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LAST = "pack_sequences"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def stage(fn: Stage) -> Stage:
    """Delete what earlier stages left, then remember what this one writes."""
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _left)
        start_record()  # what others wrote is not ours to delete
        out = fn(spark, docs, sf_dir)
        _left[:] = [] if fn.__name__ == LAST else start_record()  # the last result is read when the caller likes
        return out

    return run


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood threshold."""
    from .quality import quality

    judged = quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return judged.where("kept").select(*COLUMNS)


@stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and ``n_chars`` counted anew where that changed the text."""
    from .secrets import find_secrets, redact

    found = find_secrets(docs.select(*COLUMNS)).withColumn("_changed", F.size("all_spans") > 0)
    clean = found.withColumn("text", redact(F.col("text"), F.col("all_spans")))
    return clean.withColumn("n_chars", F.when(F.col("_changed"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


#: No source is seen more often than this in the mixture.
MAX_REPEATS = 2.0


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture shows it, at least once."""
    from .mixing import mix

    mixed = mix(docs.select(*COLUMNS), max_repeats=MAX_REPEATS)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1))))).select(*COLUMNS)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; copies of a document are packed each by itself."""
    from .packing import pack

    return pack(docs.select("doc_id", "text"))


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, or one text when all ids of the group are
    null; repeated rows of it count once."""
    from .ngram_join import find_classes, text_key

    found = find_classes(docs.select("doc_id", "text"))
    roots = found.where("doc_id = component_id").select("doc_id").distinct()
    unnamed = found.where("doc_id IS NULL AND component_id IS NULL").groupBy(
        F.coalesce(F.hex("label"), F.col("key").cast("string"))).agg(F.min("key").alias("key"))
    named = docs.select(*COLUMNS).join(roots, "doc_id", "left_semi").select(*COLUMNS)
    others = docs.select(*COLUMNS, text_key("doc_id", "text")).where("doc_id IS NULL").join(unnamed.select("key"), "key", "left_semi")
    return named.union(others.select(*COLUMNS)).dropDuplicates(["doc_id", "text"])
