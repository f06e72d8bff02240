"""Export of an archive: documents, catalog, digests, manifest.

A digest is written as ordered rows, not as one string: the reference's single
file per type would put a whole type into one task.  ``sort_key`` columns put
the rows of a file in order; the writer range-partitions on them, so the part
files of a digest concatenate to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from .documents import serialize
from .file_tree import write_files


def _rel() -> Column:
    return F.concat(F.lit("records/"), "scope", F.lit("/"), "type", F.lit("/"), "slug", F.lit(".md"))


def catalog(records: DataFrame) -> DataFrame:
    """``[type_rank, title, id, line]`` of the index, to be ordered by the first three (K2)."""
    severity = R.text_or_empty(F.col("severity"))
    line = F.concat(
        F.lit("- ["), "title", F.lit("]("), _rel(), F.lit(") ("), "status", F.lit(")"),
        F.when(severity != "", F.concat(F.lit(" ["), severity, F.lit("]"))).otherwise(""),
    )
    return records.select(R.type_rank(F.col("type")).alias("type_rank"), "title", "id", line.alias("line"))


def type_digest(records: DataFrame) -> DataFrame:
    """``[file, part, title, id, text]``: a heading row per type, then a row per record (K3).

    The rule digest is written even when it is empty.
    """
    def item(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"- {name}: "), value, F.lit("\n"))).otherwise("")

    text = F.concat(
        F.lit("## "), "title", F.lit("\n\n"), item("Status", F.col("status")), item("Scope", F.col("scope")),
        item("Severity", R.text_or_empty(F.col("severity"))),
        item("Applies to", F.array_join(R.list_or_empty(F.col("applies_to")), ", ")),
        item("Tags", F.array_join(R.list_or_empty(F.col("tags")), ", ")),
        F.lit("\n"), "body", F.lit("\n\n---\n\n"),
    )
    rows = records.select(
        F.concat("type", F.lit("s.md")).alias("file"), F.lit(1).alias("part"), "title", "id", text.alias("text")
    )
    spark = records.sparkSession
    rule = spark.createDataFrame([("rule",)], "type string")
    heads = records.select("type").distinct().unionByName(rule).distinct().select(
        F.concat("type", F.lit("s.md")).alias("file"), F.lit(0).alias("part"), F.lit("").alias("title"), F.lit("").alias("id"),
        F.concat(F.lit("# "), F.initcap("type"), F.lit("s\n\n")).alias("text"),
    )
    return rows.unionByName(heads)


def map_digest(symbols: DataFrame) -> DataFrame:
    """``[file_path, line, seq, text]``: a heading row per file, then its symbols (K4)."""
    rows = symbols.select(
        "file_path", F.col("line").cast("long").alias("line"), F.col("seq").cast("long").alias("seq"),
        F.concat(F.lit("- `"), "name", F.lit("` ("), "kind", F.lit(") line "), F.col("line").cast("string")).alias("text"),
    )
    heads = symbols.select("file_path").distinct().select(
        "file_path", F.lit(-1).cast("long").alias("line"), F.lit(-1).cast("long").alias("seq"), F.concat(F.lit("## "), "file_path").alias("text")
    )
    return rows.unionByName(heads)


def manifest(records: DataFrame) -> DataFrame:
    """``[id, entry]``: record headers as JSON, empty optional fields left out (K5)."""
    def some(name: str) -> Column:
        return F.when(R.text_or_empty(F.col(name)) != "", F.col(name)).alias(name)

    def listed(name: str) -> Column:
        return F.when(F.size(R.list_or_empty(F.col(name))) > 0, F.col(name)).alias(name)

    entry = F.struct(
        "id", "slug", "type", "scope", "title", "status", some("severity"), "source_path", listed("tags"), listed("applies_to"), "content_hash"
    )
    return records.select("id", F.to_json(entry).alias("entry"))


def write_ordered(rows: DataFrame, order: list[str], path: str, by: str | None = None) -> None:
    """Text files whose parts, in name order, hold the rows in ``order``."""
    keys = ([by] if by else []) + order
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if by:
        ranged.select(by, "text").write.mode("overwrite").partitionBy(by).text(path)
    else:
        ranged.select("text").write.mode("overwrite").text(path)


def export_records(records: DataFrame, path: str) -> None:
    """Serialised records below ``path`` by scope and type, a stale tree is replaced (K1)."""
    docs = serialize(records)
    docs.select("scope", "type", F.to_json(F.struct("rel_path", "content")).alias("value")).write.mode("overwrite").partitionBy(
        "scope", "type"
    ).text(path)


def export_files(records: DataFrame, folder: str) -> DataFrame:
    """One markdown file per record below ``folder`` (K1): ``[rel_path, bytes]`` of what is there afterwards.

    The files appear together when all tasks are done, and a stale tree goes, see ``file_tree``.
    """
    write_files(serialize(records), folder)
    spark = records.sparkSession
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select(F.regexp_extract("path", r"/(records/.*)$", 1).alias("rel_path"), F.col("length").alias("bytes"))


def export_archive(records: DataFrame, symbols: DataFrame, path: str) -> None:
    """The whole export."""
    export_records(records, f"{path}/records")
    write_ordered(catalog(records).withColumnRenamed("line", "text"), ["type_rank", "title", "id"], f"{path}/index")
    write_ordered(type_digest(records), ["part", "title", "id"], f"{path}/digests", by="file")
    write_ordered(map_digest(symbols), ["file_path", "line", "seq"], f"{path}/map")
    manifest(records).select("entry").write.mode("overwrite").text(f"{path}/manifest")


