"""Keyword index on disk, searched by opening only the blocks that can reach the best hits.

Records of like length share a block of about ``BLOCK_RECORDS``.  ``postings`` has a row for each term and block: how
many records of the block hold it, the highest share of a score that any of them gets from it, and the records
themselves.  The files lie in folders by ``bucket``, a hash of the term, and ``span``, the length class of the block, so
both prune folders, and in a file the rows are sorted by term.

A search reads the small columns of its buckets first.  Their counts give the weight of each term over the whole corpus,
and their maxima bound what a query can score in a block.  Two rounds open records: the blocks with the highest bounds,
which give every query and class of hits a score that ``limit`` records reach, then the blocks whose bound reaches it.
A block left out holds no record that could be among the best, so the result equals that of a full search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stemming import stem_vocabulary
from ..session import cut_lineage
from .sizing import is_small, lookup_join

BUCKETS = 64
BLOCK_RECORDS = 256
#: Blocks of each query and class that the first round opens.
FIRST_BLOCKS = 4
#: Scores are rounded to six digits before they are ranked.
ROUNDING = 1e-6


@dataclass(frozen=True)
class StoredIndex:
    """``postings[bucket, span, key, block, n, best, items]`` and ``stats[n_docs, avg_length]`` (one row)."""

    postings: DataFrame
    stats: DataFrame
    stemmed: bool
    buckets: int


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def share(tf: Column, length: Column, avg_length: Column) -> Column:
    """A posting's part of the score before the term's weight."""
    return X.bm25_term(F.lit(1.0), tf, length, avg_length)


def write_postings(tokens: DataFrame, path: str, stem: bool, buckets: int = BUCKETS, block_records: int = BLOCK_RECORDS) -> None:
    """Store the postings of ``tokens[record_id, type, status, tokens]``.

    The corpus is read twice: for its length classes and totals (a row for each class reaches the driver), and for the
    postings.
    """
    spark = tokens.sparkSession
    docs = tokens.withColumn("length", F.size("tokens")).withColumn("span", F.floor(2 * F.log2(F.col("length") + 1)).cast("int"))
    classes = docs.groupBy("span").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect()
    n_docs, n_tokens = sum(r["n"] for r in classes), sum(r["tokens"] for r in classes)
    avg_length = n_tokens / n_docs if n_docs else None
    spark.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(avg_length).cast("double").alias("avg_length"),
                          F.lit(stem).alias("stemmed"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/stats")
    blocks = F.lit(1)
    for r in classes:
        blocks = F.when(F.col("span") == r["span"], -(-r["n"] // block_records)).otherwise(blocks)
    placed = docs.withColumn("block", F.pmod(F.xxhash64("record_id"), blocks.cast("long")))
    block_postings(placed, avg_length, stem, buckets).write.mode("overwrite").partitionBy("bucket", "span").parquet(f"{path}/postings")


def block_postings(placed: DataFrame, avg_length: float | None, stem: bool, buckets: int) -> DataFrame:
    """``[bucket, span, key, block, n, best, items]`` of ``placed[record_id, type, status, tokens, length, span, block]``,
    dealt and sorted for their folders.

    Tokens are dealt by record while they are lists, so a record's words are counted where they lie; postings are dealt once,
    to the folders they are written to.  A folder holds all records of a term and block.
    """
    record = ["span", "block", "record_id", "type", "status", "length"]
    found = by_record(placed).select(*record, F.explode("tokens").alias("key")).groupBy(*record, "key").agg(F.count("*").alias("tf"))
    if stem:
        stems = stem_vocabulary(found.select(F.col("key").alias("term"))).select(F.col("term").alias("key"), "stem")
        found = lookup_join(found, stems, ["key"], spread=F.xxhash64("record_id")).groupBy(*record, F.col("stem").alias("key")).agg(
            F.sum("tf").alias("tf"))
    folder = ["bucket", "span", "part"]
    dealt = found.withColumns({"bucket": bucket_of(F.col("key"), buckets), "part": F.pmod("block", F.lit(8))}).repartition(*folder)
    return dealt.groupBy(*folder, "key", "block").agg(
        F.count("*").alias("n"), F.max(share(F.col("tf"), F.col("length"), F.lit(avg_length))).alias("best"),
        F.collect_list(F.struct("record_id", "type", "status", "length", "tf")).alias("items"),
    ).drop("part").sortWithinPartitions("bucket", "span", "key", "block")


def open_index(spark: SparkSession, path: str) -> StoredIndex:
    stats = spark.read.parquet(f"{path}/stats")
    row = stats.first()
    schema = ("key string, block long, n long, best double, items array<struct<record_id: string, type: string, status: string, "
              "length: int, tf: long>>, bucket int, span int")
    return StoredIndex(spark.read.schema(schema).parquet(f"{path}/postings"), stats.select("n_docs", "avg_length"), row["stemmed"], row["buckets"])


def _of_buckets(index: StoredIndex, keys: DataFrame) -> DataFrame:
    """Postings in the folders of some keys; at most ``buckets`` numbers reach the driver."""
    wanted = [r[0] for r in keys.select(bucket_of(F.col("key"), index.buckets)).distinct().collect()]
    return index.postings.where(F.col("bucket").isin(wanted))


def by_record(postings: DataFrame) -> DataFrame:
    """Postings dealt by record before they meet queries.

    The pairs of queries and records, far more than the postings, are then summed and cut where they arise.
    """
    return postings.repartition("record_id")


def postings_of(index: StoredIndex, terms: DataFrame) -> DataFrame:
    """``[record_id, type, status, length, key, tf]`` of the queried keys."""
    keys = terms.select("key").distinct()
    found = lookup_join(_of_buckets(index, keys), keys, ["key"], spread=F.col("block"))
    return found.select("key", F.inline("items"))


def weigh_terms(index: StoredIndex, terms: DataFrame) -> DataFrame:
    """``terms`` with their weight over the whole corpus; terms that no record holds are left out."""
    sizes = _of_buckets(index, terms).select("key", "n")
    df = lookup_join(sizes, terms.select("key").distinct(), ["key"]).groupBy("key").agg(F.sum("n").alias("df"))
    return terms.join(df, "key").join(F.broadcast(index.stats)).withColumn("idf", X.bm25_idf(F.col("n_docs"), F.col("df"))).drop("df", "n_docs")


def bound_blocks(index: StoredIndex, weights: DataFrame) -> DataFrame:
    """``[query_id, span, block, class, bound]``: what a query can reach in a block, for each class of hits it may hold.

    Class 0 holds every token of the query, class 1 enough of its content words, class 2 any.
    """
    # dealt by block before they meet queries, as in ``by_record``
    small = _of_buckets(index, weights).select("key", "span", "block", "best").repartition("span", "block")
    asked = weights.select("query_id", "key", "n_tokens", "n_content", "strict_n", "content_n", "idf")
    part = F.col("idf") * F.col("best")
    blocks = lookup_join(small, asked, ["key"], spread=F.col("block")).groupBy("query_id", "span", "block").agg(
        F.max("n_tokens").alias("n_tokens"), F.max("n_content").alias("n_content"),
        F.sum("strict_n").alias("strict_hit"), F.sum("content_n").alias("covered"),
        F.sum(part * F.col("strict_n")).alias("strict_bound"), F.sum(part * F.col("content_n")).alias("relaxed_bound"),
    )
    relaxed = F.col("n_tokens") > 1

    def entry(number: int, may: Column, bound: str) -> Column:
        return F.when(may, F.struct(F.lit(number).alias("class"), (F.col(bound) + ROUNDING).alias("bound")))

    return blocks.select("query_id", "span", "block", F.inline(F.array_compact(F.array(
        entry(0, F.col("strict_hit") == F.col("n_tokens"), "strict_bound"),
        entry(1, relaxed & (F.col("covered") >= X.min_should_match(F.col("n_content"))) & (F.col("covered") > 0), "relaxed_bound"),
        entry(2, relaxed & (F.col("covered") > 0), "relaxed_bound"),
    ))))


#: Length classes of a bucket when both are told by one number.
SPANS = 1 << 10


def open_records(index: StoredIndex, chosen: DataFrame, weights: DataFrame) -> DataFrame:
    """Postings of the chosen ``[query_id, span, block]`` for all keys of ``weights``, which are known to be few.

    Only the folders that hold chosen blocks are read: their (bucket, span) pairs, at most a few thousand, reach the driver.
    A block may also be scored for queries that did not choose it, which adds no hit above those they have.
    """
    blocks, keys = cut_lineage(chosen.select("span", "block").distinct()), weights.select("key").distinct()
    lengths = [r[0] for r in blocks.select("span").distinct().collect()]
    buckets = [r[0] for r in keys.select(bucket_of(F.col("key"), index.buckets)).distinct().collect()]
    held = index.postings.where((F.col("bucket") * SPANS + F.col("span")).isin([b * SPANS + n for b in buckets for n in lengths]))
    opened = lookup_join(held.select("span", "block", "key", "items").join(F.broadcast(keys), "key", "left_semi"), blocks,
                         ["span", "block"], "left_semi", spread=F.xxhash64("key"))
    return opened.select("key", F.inline("items"))


def open_blocks(index: StoredIndex, chosen: DataFrame, weights: DataFrame) -> DataFrame:
    """Postings of the chosen ``[query_id, span, block]`` with the weights of their terms; folders are read as above."""
    if is_small(weights):
        return by_record(open_records(index, chosen, weights)).join(F.broadcast(weights), "key")
    need = lookup_join(chosen.select("query_id", "span", "block").distinct(), weights, ["query_id"]).withColumn(
        "bucket", bucket_of(F.col("key"), index.buckets))
    need = cut_lineage(need)
    folders = [r[0] for r in need.select(F.col("bucket") * SPANS + F.col("span")).distinct().collect()]
    held = index.postings.where((F.col("bucket") * SPANS + F.col("span")).isin(folders)).select("bucket", "span", "key", "block", "items")
    return lookup_join(held, need, ["bucket", "span", "key", "block"], spread=F.col("block")).select("query_id", *[
        c for c in weights.columns if c not in ("query_id", "bucket")], F.inline("items"))


def first_choice(bounds: DataFrame) -> DataFrame:
    """The blocks with the highest bounds of each query and class."""
    order = Window.partitionBy("query_id", "class").orderBy(F.desc("bound"), "span", "block")
    return bounds.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= FIRST_BLOCKS).drop("pos")


def second_choice(bounds: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """The blocks that can change the result, given the best hits ``found[query_id, class, score, pos]`` of the first round.

    A query with a hit of class 0 needs no other class.  Otherwise a block counts if its bound reaches the score at
    place ``limit``, or if there is no such place yet.
    """
    least = found.groupBy("query_id", "class").agg(F.max(F.when(F.col("pos") == limit, F.col("score"))).alias("least"))
    strict = found.where("class = 0").select("query_id").distinct().withColumn("strict", F.lit(True))
    known = lookup_join(lookup_join(bounds, least, ["query_id", "class"], "left"), strict, ["query_id"], "left")
    return known.where((F.col("least").isNull() | (F.col("bound") >= F.col("least"))) & (F.col("strict").isNull() | (F.col("class") == 0)))

