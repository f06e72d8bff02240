"""Substring index on disk: three-character postings of row keys.

``postings`` has a row for each gram, checkout and block of about ``BLOCK_ROWS`` rows: how many rows of the block hold
the gram, and their numbers.  ``texts`` holds the rows themselves, in folders by a hash of their number.  A row's number
is a hash of its key; rows that share one are tested each by itself, so results are exact.

A search reads the small columns of its grams first.  A block that lacks a gram of the term cannot hold it, and in the
others the rarest grams are opened and their row numbers intersected.  Only the rows that are left have their texts read,
by sending row numbers to the texts: a shuffle moves numbers and terms, no text.

Every place of a text starts a gram, the last two places shorter ones, so a term of one or two characters is found by the
grams that start with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage
from . import sizing
from .sizing import lookup_join
from .stored_index import bucket_of

GRAM = 3
BUCKETS = 64
BLOCK_ROWS = 4096
#: Blocks that share a file of a bucket.
FILE_BLOCKS = 64
#: Grams of a term that are opened in a block; the text decides about the rest.
RAREST = 3


@dataclass(frozen=True)
class SubstringIndex:
    """``postings[bucket, checkout, gram, block, n, rows]`` and ``texts[bucket, row, entry]``."""

    postings: DataFrame
    texts: DataFrame
    keep: list[str]
    fields: list[str]
    buckets: int


def text_grams(text: Column) -> Column:
    """Distinct grams of a text, in time linear in its length."""
    def of(chars: Column) -> Column:
        return F.array_distinct(F.transform(chars, lambda c, i: F.concat(
            c, *[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(1, GRAM)])))

    return X.let(F.filter(F.split(text, ""), lambda c: c != ""), of)


def _folded(field: Column) -> Column:
    return X.ascii_fold(F.coalesce(field, F.lit("")))


def write_substrings(rows: DataFrame, fields: list[str], keep: list[str], path: str, buckets: int = BUCKETS,
                     block_rows: int = BLOCK_ROWS) -> None:
    """Index ``rows[checkout, *keep, *fields]``; ``keep`` identifies a row of a checkout.

    Null fields are empty texts.  Rows without a checkout or without any text are found by no term.
    """
    spark = rows.sparkSession
    blocks = max(1, -(-rows.count() // block_rows))
    entry = F.struct(*dict.fromkeys(["checkout", *keep, *fields]))
    numbered = rows.where("checkout IS NOT NULL").select(F.xxhash64("checkout", *keep).alias("row"), entry.alias("entry"))
    text = F.concat_ws("\n", *[_folded(F.col("entry")[f]) for f in fields])
    pieces = numbered.select("row", F.col("entry")["checkout"].alias("checkout"), F.explode(text_grams(text)).alias("gram"))
    grouped = pieces.groupBy("checkout", "gram", F.pmod("row", F.lit(blocks)).alias("block")).agg(F.collect_set("row").alias("rows"))
    placed = grouped.withColumn("n", F.size("rows")).withColumn("bucket", bucket_of(F.col("gram"), buckets))
    (
        placed.repartition("bucket", F.floor(F.col("block") / FILE_BLOCKS)).sortWithinPartitions("bucket", "checkout", "gram", "block")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    )
    (
        numbered.withColumn("bucket", bucket_of(F.col("row"), buckets)).repartition("bucket", F.pmod("row", F.lit(max(1, blocks // FILE_BLOCKS))))
        .sortWithinPartitions("bucket", "row").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/texts")
    )
    spark.range(1).select(
        F.array(*map(F.lit, keep)).alias("keep"), F.array(*map(F.lit, fields)).alias("fields"), F.lit(buckets).alias("buckets"),
        F.lit(entry_schema(rows, keep, fields)).alias("entry"),
    ).write.mode("overwrite").parquet(f"{path}/info")


def entry_schema(rows: DataFrame, keep: list[str], fields: list[str]) -> str:
    """Type of ``entry``, as an empty index has no file to tell it."""
    return rows.select(*dict.fromkeys(["checkout", *keep, *fields])).schema.simpleString()


def open_substrings(spark: SparkSession, path: str) -> SubstringIndex:
    info = spark.read.parquet(f"{path}/info").first()
    postings = "checkout string, gram string, block long, rows array<long>, n int, bucket int"
    texts = f"row long, entry {info['entry']}, bucket int"
    return SubstringIndex(
        spark.read.schema(postings).parquet(f"{path}/postings"), spark.read.schema(texts).parquet(f"{path}/texts"),
        list(info["keep"]), list(info["fields"]), info["buckets"],
    )


def _of_buckets(index: SubstringIndex, grams: DataFrame) -> DataFrame:
    """Postings in the folders of some grams; at most ``buckets`` numbers reach the driver."""
    wanted = [r[0] for r in grams.select(bucket_of(F.col("gram"), index.buckets)).distinct().collect()]
    return index.postings.where(F.col("bucket").isin(wanted))


def chosen_postings(index: SubstringIndex, words: DataFrame) -> DataFrame:
    """``[checkout, term, gram, block, least]`` to open for ``words[checkout, term]``.

    A row that holds the term is in at least ``least`` of the chosen postings of its block.
    """
    whole = F.filter(text_grams(F.col("term")), lambda g: F.char_length(g) == GRAM)
    long = words.where(F.char_length("term") >= GRAM).select("checkout", "term", F.size(whole).alias("held"), F.explode(whole).alias("gram"))
    sizes = _of_buckets(index, long).select("checkout", "gram", "block", "n")
    at = Window.partitionBy("checkout", "term", "block")
    met = lookup_join(sizes, long, ["checkout", "gram"], spread=F.col("block"))
    rare = met.withColumns({"found": F.count("*").over(at), "pos": F.row_number().over(at.orderBy("n", "gram"))}).where(
        (F.col("found") == F.col("held")) & (F.col("pos") <= RAREST))
    some = rare.select("checkout", "term", "gram", "block", F.least("held", F.lit(RAREST)).alias("least"))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda n: F.substr(F.col("gram"), F.lit(1), n)))
    begun = index.postings.select("checkout", "gram", "block", F.explode(starts).alias("term"))
    short = lookup_join(begun, words.where(F.char_length("term") < GRAM), ["checkout", "term"], spread=F.xxhash64("gram", "block"))
    return some.unionByName(short.select("checkout", "term", "gram", "block", F.lit(1).alias("least")))


def candidates(index: SubstringIndex, words: DataFrame) -> DataFrame:
    """``[checkout, term, row]`` of rows that hold the rarest grams of the term."""
    chosen = cut_lineage(chosen_postings(index, words))
    held = _of_buckets(index, chosen).select("checkout", "gram", "block", "rows")
    opened = lookup_join(held, chosen, ["checkout", "gram", "block"], spread=F.xxhash64("gram", "block"))
    numbers = opened.select("checkout", "term", "least", F.explode("rows").alias("row"))
    return numbers.groupBy("checkout", "term", "row").agg(F.count("*").alias("n"), F.max("least").alias("least")).where(
        "n >= least").select("checkout", "term", "row")


def with_entries(index: SubstringIndex, wanted: DataFrame) -> DataFrame:
    """``wanted[row, ...]`` with the ``entry`` of each row.

    The wanted rows of a run of folders are broadcast to these folders, each run measured below the bounds of a
    broadcast, so every folder is read once and its texts stay where they are.  Folders with more wanted rows than that
    are joined by a shuffle.  At most a number for each folder reaches the driver.
    """
    placed = cut_lineage(wanted.withColumn("bucket", bucket_of(F.col("row"), index.buckets)))
    width = F.octet_length(F.to_json(F.struct(*placed.columns)))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(width).alias("b")).orderBy("bucket").collect()
    runs, n, b = [[]], 0, 0
    crowded = [r["bucket"] for r in sizes if r["n"] > sizing.MAX_ROWS or r["b"] > sizing.MAX_BYTES]
    for r in sizes:
        if r["bucket"] in crowded:
            continue
        if n + r["n"] > sizing.MAX_ROWS or b + r["b"] > sizing.MAX_BYTES:
            runs.append([])
            n, b = 0, 0
        runs[-1].append(r["bucket"])
        n, b = n + r["n"], b + r["b"]
    out = None
    for run in runs:
        part = index.texts.where(F.col("bucket").isin(run)).join(F.broadcast(placed.where(F.col("bucket").isin(run))), ["bucket", "row"])
        out = part if out is None else out.unionByName(part)
    if crowded:
        held = F.col("bucket").isin(crowded)
        out = out.unionByName(index.texts.where(held).join(placed.where(held), ["bucket", "row"]))
    return out.drop("bucket")


def word_hits(index: SubstringIndex, words: DataFrame) -> DataFrame:
    """``[checkout, term, row, *keep, in_<field>...]`` of folded ``words[checkout, term]`` found in any field.

    A word is looked up once; an empty one is found nowhere.
    """
    words = cut_lineage(words.where("term <> ''").distinct())
    met = with_entries(index, candidates(index, words)).where(F.col("entry")["checkout"] == F.col("checkout"))
    flags = {f"in_{f}": F.contains(_folded(F.col("entry")[f]), F.col("term")) for f in index.fields}
    hits = met.select("checkout", "term", "row", *[F.col("entry")[k].alias(k) for k in index.keep], *[c.alias(n) for n, c in flags.items()])
    return hits.where(" OR ".join(flags))


def term_hits(index: SubstringIndex, terms: DataFrame) -> DataFrame:
    """``[query_id, n_terms, need, checkout, term, row, *keep, in_<field>...]`` of terms found in any field.

    ``terms[query_id, checkout, term, n_terms, need]``; an empty term is found nowhere.
    """
    asked = terms.withColumn("term", X.ascii_fold(F.trim("term"))).where("term <> ''")
    return lookup_join(word_hits(index, asked.select("checkout", "term")), asked, ["checkout", "term"], spread=F.col("row"))


def with_fields(index: SubstringIndex, found: DataFrame, names: list[str]) -> DataFrame:
    """``found[checkout, row, *keep, ...]`` with stored columns of its rows; a row stored several times comes back as often."""
    met = with_entries(index, found)
    for k in ["checkout", *index.keep]:
        met = met.where(F.col("entry")[k].eqNullSafe(F.col(k)))
    return met.select(*found.columns, *[F.col("entry")[f].alias(f) for f in names])
