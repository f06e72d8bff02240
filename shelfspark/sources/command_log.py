"""Command log: batch reader, stream reader and writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import logs as L
from .log_tail import tail_lines


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``[file, line_no, last, value]``: dense line numbers of splittable text files.

    Inside a file split rows come in order, and splits have a known offset.  Lines are
    numbered inside each split (bounded by the split size) and shifted by the
    line counts of the splits before it.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    inside = Window.partitionBy("file", "start").orderBy("at")
    local = raw.withColumn("n", F.row_number().over(inside))
    sizes = raw.groupBy("file", "start").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("file").orderBy("start")
    offsets = sizes.select(
        "file", "start", F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"),
        F.sum("rows").over(Window.partitionBy("file")).alias("last"),
    )
    return local.join(offsets, ["file", "start"]).select("file", (F.col("skip") + F.col("n")).alias("line_no"), "last", "value")


def parse_lines(lines: DataFrame, checkout: Column) -> DataFrame:
    """Log columns of ``lines[line_no, value]``; a line that is no JSON object has a null ``entry``."""
    entry = F.try_parse_json("value")
    parsed = lines.withColumn("entry", entry).withColumn(
        "entry", F.when(F.startswith(F.schema_of_variant("entry"), F.lit("OBJECT")), F.col("entry"))
    )
    ts = F.try_variant_get("entry", "$.ts", "string")

    def text(name: str) -> Column:
        return F.try_variant_get("entry", f"$.{name}", "string")

    return parsed.select(
        checkout.alias("checkout"), "line_no", text("id").alias("id"), L.log_time(ts).alias("ts"), L.log_nanos(ts).alias("ts_ns"),
        text("dir").alias("dir"), text("source").alias("source"), text("command").alias("command"),
        F.try_variant_get("entry", "$.args", "variant").alias("args"), F.try_variant_get("entry", "$.result", "variant").alias("result"),
        text("error").alias("error"), F.try_variant_get("entry", "$.duration_ms", "long").alias("duration_ms"),
        F.col("entry").isNotNull().alias("ok"), *[c for c in ("last", "file") if c in lines.columns],
    )


def read_command_log(spark: SparkSession, path: str, checkout: str | Column = "", stream: bool = False) -> DataFrame:
    """The log as a table (S11), or as a stream of lines as they are appended.

    ``checkout`` may be an expression over ``file``, for folders that hold the logs of several checkouts.  The files of
    a checkout follow each other by their first time, then by name, and ``line_no`` runs through them.  A broken
    last line of a file is a torn write and is dropped; any other broken line fails the job and names the line.

    A stream keeps broken lines, with ``ok`` false and nothing else; a torn last line waits until it is complete.  Its lines
    are known by ``file`` and ``line_no``, the line's position in bytes, which orders the lines of a file.
    """
    owner = F.lit(checkout) if isinstance(checkout, str) else checkout
    if stream:
        lines = tail_lines(spark, path).where(F.trim("value") != "").withColumnRenamed("position", "line_no")
        return parse_lines(lines, owner)
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    rows = parse_lines(lines, owner)
    message = F.concat(F.lit("command log line "), F.col("line_no").cast("string"), F.lit(" is not a JSON object"))
    keep = F.when(F.col("ok"), True).when(F.col("line_no") == F.col("last"), False).otherwise(F.raise_error(message).cast("boolean"))
    kept = rows.where(keep).drop("ok", "last")
    files = kept.groupBy("checkout", "file").agg(F.min("ts_ns").alias("first"), F.max("line_no").alias("lines"))
    before = Window.partitionBy("checkout").orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    skips = files.select("checkout", "file", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("skip"))
    return kept.join(skips, ["checkout", "file"]).withColumn("line_no", F.col("line_no") + F.col("skip")).drop("skip", "file")


def log_lines(calls: DataFrame, limit: int = C.LOG_CLIP_BYTES) -> DataFrame:
    """``[ts, value]``: an ``in`` and an ``out`` line per call, with a shared id (K7).

    ``calls[id, source, command, args, result, error, started, finished]`` with
    JSON text in ``args`` and ``result``.  A missing id is a hash of the call, so
    a retried task writes the same one.
    """
    made = F.concat(F.lit("c_"), F.substr(F.sha2(F.to_json(F.struct("source", "command", "args", "started")), 256), F.lit(1), F.lit(16)))
    call = calls.withColumn("id", F.coalesce("id", made))

    def stamp(at: str) -> Column:
        return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    def field(name: str) -> Column:
        return F.parse_json(L.clip_json(F.col(name), limit)).alias(name)

    opened = call.select(
        F.col("started").alias("ts"),
        F.to_json(F.struct("id", stamp("started").alias("ts"), F.lit("in").alias("dir"), "source", "command", field("args"))).alias("value"),
    )
    took = (F.unix_millis("finished") - F.unix_millis("started")).alias("duration_ms")
    closed = call.select(
        F.col("finished").alias("ts"),
        F.to_json(
            F.struct("id", stamp("finished").alias("ts"), F.lit("out").alias("dir"), "source", "command", field("result"), "error", took)
        ).alias("value"),
    )
    return opened.unionByName(closed)


def append_log(calls: DataFrame, path: str) -> None:
    """Append the lines in time order (K7)."""
    lines = log_lines(calls)
    lines.repartitionByRange("ts").sortWithinPartitions("ts").select("value").write.mode("append").text(path)
