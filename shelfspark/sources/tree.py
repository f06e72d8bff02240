"""Source-tree scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.ignore import indexable


def relative_path(root: str):
    return F.url_decode(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1))


def read_tree(spark: SparkSession, root: str, ignore: DataFrame | None = None, skip_globs: tuple[str, ...] = (),
              checkout: str = "", **names) -> DataFrame:
    """``[checkout, path, content, content_hash]`` of the text files the index keeps.

    ``ignore[dir, line_no, line]`` are the lines of the ignore files; Spark's file
    listing leaves out hidden files, so they are an input.  Paths are judged
    before any content is decoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        relative_path(root).alias("path"), "content"
    )
    if ignore is None:
        ignore = spark.createDataFrame([], "dir string, line_no int, line string")
    globs = spark.createDataFrame([(g,) for g in skip_globs], "pattern string") if skip_globs else None
    kept = indexable(files.select("path"), ignore, globs, **names)
    text = files.join(kept, "path", "left_semi").where(~P.is_binary_content(F.col("content")))
    return text.select(
        F.lit(checkout).alias("checkout"), "path", F.col("content").cast("string").alias("content"),
        F.sha2("content", 256).alias("content_hash"),
    )


def list_files(tree: DataFrame) -> DataFrame:
    """Sorted paths."""
    return tree.select("path").distinct().orderBy("path")
