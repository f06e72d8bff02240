"""Source excerpts next to followed links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths as P
from ..functions import records as R
from .globs import match_patterns, record_patterns
from .sizing import lookup_join


def excerpt(files: DataFrame, per_record: int = C.EXCERPT_FILES, per_file: int = C.EXCERPT_FILE_BYTES,
            total: int = C.EXCERPT_TOTAL_BYTES) -> DataFrame:
    """``files[query_id, link_pos, path, content]`` to ``[query_id, link_pos, path, text, omitted]``.

    The first files of every link in path order, a bounded piece of each, until
    the response's budget is used up in link order.
    """
    usable = files.where(~P.escapes_root(F.col("path")) & (F.octet_length("content") > 0))
    by_link = Window.partitionBy("query_id", "link_pos").orderBy("path")
    heads = usable.withColumn("n", F.row_number().over(by_link)).where(F.col("n") <= per_record + 1)
    cut = heads.withColumn("text", R.clip_utf8(F.col("content"), per_file)).drop("content")
    counted = F.when(F.col("n") <= per_record, F.octet_length("text")).otherwise(0)
    before = Window.partitionBy("query_id").orderBy("link_pos", "path").rowsBetween(Window.unboundedPreceding, -1)
    spent = cut.withColumn("remaining", F.lit(total) - F.coalesce(F.sum(counted).over(before), F.lit(0)))
    whole = Window.partitionBy("query_id", "link_pos")
    more = F.max(((F.col("n") > per_record) | (F.col("remaining") <= 0)).cast("int")).over(whole) > 0
    fits = F.octet_length("text") <= F.col("remaining")
    # the last file may only get what is left, cut at a character
    part = F.coalesce(
        *[F.try_validate_utf8(F.expr(f"substring(encode(text, 'UTF-8'), 1, greatest(remaining - {b}, 0))").cast("string")) for b in range(4)]
    )
    return spent.withColumn("omitted", more).where((F.col("n") <= per_record) & (F.col("remaining") > 0)).select(
        "query_id", "link_pos", "path", F.when(fits, F.col("text")).otherwise(part).alias("text"), "omitted"
    )


def link_files(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Files a followed link's globs match: ``targets[query_id, link_pos, checkout, applies_to]``."""
    owned = record_patterns(targets.select(F.struct("query_id", "link_pos", "checkout").alias("id"), "applies_to"))
    hits = match_patterns(owned, files)
    pairs = lookup_join(hits, owned, ["pattern"], spread=F.xxhash64("path")).select("record_id.*", "path").distinct()
    return pairs.join(files.select("checkout", "path", "content"), ["checkout", "path"])
