"""Record links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import records as R
from .sizing import lookup_join

EDGE = ["kind", "from_checkout", "from_id", "to_root", "to_id"]


def list_links(links: DataFrame, checkout: str = "") -> DataFrame:
    """Edges in order; with a checkout only those that start there."""
    kept = links if checkout == "" else links.where(F.col("from_checkout") == checkout)
    return kept.select(*EDGE).orderBy(*EDGE)


def _missing(record: Column) -> Column:
    return F.concat(F.lit("record links: record "), record, F.lit(" not found"))


def _with_target(edges: DataFrame, records: DataFrame, columns: list[Column]) -> DataFrame:
    """Left join the target record; a missing one is kept with a message."""
    target = records.select(F.col("id").alias("to_id"), F.struct(*columns).alias("record"))
    joined = edges.join(target, "to_id", "left")
    return joined.withColumn("missing", F.when(F.col("record").isNull(), _missing(F.col("to_id"))))


def pins_of(links: DataFrame, asked: DataFrame) -> DataFrame:
    """``[query_id, *EDGE]``: the pins every query of a checkout gets; a query without a checkout gets none.

    ``asked[query_id, checkout]``.  A query asks for the pins of its checkout and
    for the shared ones, so one equi join finds both.
    """
    pins = links.where("kind = 'pin'").select(*EDGE)
    wanted = asked.where("checkout <> ''").select("query_id", F.explode(F.array("checkout", F.lit(""))).alias("from_checkout"))
    return lookup_join(wanted, pins, ["from_checkout"], spread=F.xxhash64("query_id")).select("query_id", *EDGE)


def follow_edges(hits: DataFrame, links: DataFrame, asked: DataFrame) -> DataFrame:
    """``[query_id, *EDGE]``: pins of the checkout, and edges that start at a hit.

    Edges from hits are joined on the hit id, so only pins meet a query without a key.
    """
    pins = pins_of(links, asked)
    origin = hits.select("query_id", F.col("record_id").alias("from_id")).join(
        asked.select("query_id", "checkout"), "query_id"
    )
    from_hits = links.where("kind <> 'pin'").join(origin, "from_id").where(
        (F.col("checkout") == "") | (F.col("from_checkout") == "") | (F.col("from_checkout") == F.col("checkout"))
    )
    return pins.unionByName(from_hits.select("query_id", *EDGE))


def follow_records(hits: DataFrame, links: DataFrame, asked: DataFrame, records: DataFrame) -> DataFrame:
    """Pin and record edges of a search with their target."""
    edges = follow_edges(hits, links, asked).where("kind <> 'repo'")
    return _with_target(edges, records, R.search_card())


def links_of(record_ids: DataFrame, links: DataFrame, records: DataFrame) -> DataFrame:
    """Record and repo edges of fetched records; repo edges run no search."""
    keys = record_ids.select(F.col("id").alias("from_id")).distinct()
    edges = lookup_join(links.where("kind IN ('record', 'repo')"), keys, ["from_id"], "left_semi")
    done = _with_target(edges, records, R.record_card())
    return done.withColumn("missing", F.when(F.col("kind") == "record", F.col("missing")))


def validate_links(links: DataFrame, records: DataFrame, primary: str | None = None) -> DataFrame:
    """Edges plus the list of ``violations``."""
    known = records.select("id", "type")
    joined = (
        links.join(known.select(F.col("id").alias("from_id"), F.lit(True).alias("_from")), "from_id", "left")
        .join(known.select(F.col("id").alias("to_id"), F.col("type").alias("_type")), "to_id", "left")
    )
    kind, from_id, to_id, to_root = (F.trim(F.col(c)) for c in ("kind", "from_id", "to_id", "to_root"))
    start = F.when(F.col("from_checkout") == "", F.lit(primary or "")).otherwise(F.col("from_checkout"))
    checks = [
        F.when(~kind.isin(*C.LINK_KINDS), "unknown kind"),
        F.when((kind == "pin") & (from_id != ""), "pin does not take from_id"),
        F.when(kind.isin("record", "repo") & (from_id == ""), "from_id is required"),
        F.when((kind == "repo") & (to_id != ""), "repo does not take a record id"),
        F.when(kind.isin("record", "pin") & (to_id == ""), "record id is empty"),
        F.when(to_root == "", "checkout path is empty"),
        F.when((to_root != "") & (start == to_root), "checkout cannot link to itself"),
        F.when((kind != "pin") & (from_id != "") & F.col("_from").isNull(), "from record not found"),
        F.when((kind != "repo") & (to_id != "") & F.col("_type").isNull(), "target record not found"),
        F.when((kind != "repo") & F.col("_type").isNotNull() & ~F.col("_type").isin(*C.TYPES), "target has no valid type"),
    ]
    return joined.select(*EDGE, F.array_compact(F.array(*checks)).alias("violations"))


def add_links(base: DataFrame, delta: DataFrame, records: DataFrame, primary: str) -> tuple[DataFrame, DataFrame]:
    """New edge table and the rejected edges (W7); a duplicate changes nothing."""
    from .tables import insert_or_ignore

    checked = validate_links(delta, records, primary)
    fresh = checked.where(F.size("violations") == 0).select(
        "kind", F.when(F.col("from_checkout") == "", primary).otherwise(F.col("from_checkout")).alias("from_checkout"),
        *[F.trim(F.col(c)).alias(c) for c in EDGE[2:]],
    )
    return insert_or_ignore(base.select(*EDGE), fresh, EDGE), checked.where(F.size("violations") > 0)


def remove_links(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Removing a missing edge is no error."""
    return base.join(delta.select(*EDGE), EDGE, "left_anti")
