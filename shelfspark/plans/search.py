"""Search with followed links, and fetching records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import records as R
from ..functions import text as X
from ..operators import links as K
from ..operators.excerpts import excerpt, link_files
from ..operators.fusion import hybrid_search
from ..operators.keyword import Index
from ..operators.sizing import lookup_join
from ..operators.tables import get_records
from ..operators.vectors import file_search


def search_with_links(index: Index, vectors: DataFrame, queries: DataFrame, records: DataFrame, links: DataFrame,
                      files: DataFrame | None = None, file_vectors: DataFrame | None = None, top_k: int = C.TOP_K,
                      floor: float = C.VECTOR_FLOOR, model: str | None = None) -> dict[str, DataFrame]:
    """``results``, ``code``, ``links``, ``link_hits`` and ``excerpts`` of a query batch.

    ``queries[query_id, checkout, text, embedding]``.  A repo link shows the
    query's own hits that are shared or belong to the linked checkout: the
    search is the same for every target, so it is filtered, not run again, and
    fewer than ``top_k`` hits may remain (J14).
    """
    hits = hybrid_search(index, vectors, queries, records, top_k, floor, model)
    asked = queries.select("query_id", "checkout")
    edges = K.follow_edges(hits, links, asked)
    order = Window.partitionBy("query_id").orderBy(*K.EDGE)
    placed = edges.withColumn("link_pos", F.row_number().over(order))
    cards = records.select(F.col("id").alias("to_id"), F.struct(*R.search_card()).alias("record"), F.col("body"))
    terms = queries.select("query_id", X.search_terms(F.col("text")).alias("_terms"))
    targets = lookup_join(placed.where("kind <> 'repo'").join(cards, "to_id", "left"), terms, ["query_id"])
    shown = targets.withColumn(
        "missing", F.when(F.col("record").isNull(), F.concat(F.lit("record links: record "), "to_id", F.lit(" not found")))
    ).withColumn("snippet", F.when(F.col("record").isNotNull(), X.snippet(F.col("body"), F.col("_terms")))).drop("body", "_terms")
    repo = placed.where("kind = 'repo'")
    link_hits = repo.select("query_id", "link_pos", "to_root").join(
        hits.select("query_id", "record_id", "checkout", "score", "cosine", "source", "rank"), "query_id"
    ).where(F.col("checkout").isin("") | (F.col("checkout") == F.col("to_root")))
    out = {
        "results": hits,
        "links": shown.unionByName(repo, allowMissingColumns=True),
        "link_hits": link_hits,
    }
    if file_vectors is not None:
        coded = queries.where(F.col("embedding").isNotNull())
        out["code"] = file_search(file_vectors, coded, top_k)
    if files is not None:
        out["excerpts"] = excerpt(link_files(_excerpt_targets(shown, link_hits, records), files))
    return out


def _excerpt_targets(shown: DataFrame, link_hits: DataFrame, records: DataFrame) -> DataFrame:
    """Which globs of which checkout show source: the linked record, or the first hit of a repo link."""
    direct = shown.where("record IS NOT NULL").select(
        "query_id", "link_pos", F.col("to_root").alias("checkout"), F.col("record.applies_to").alias("applies_to")
    )
    first = link_hits.groupBy("query_id", "link_pos", "to_root").agg(F.min_by("record_id", "rank").alias("id"))
    globs = records.select("id", R.list_or_empty(F.col("applies_to")).alias("applies_to"))
    via_repo = first.join(globs, "id").select("query_id", "link_pos", F.col("to_root").alias("checkout"), "applies_to")
    return direct.unionByName(via_repo)


def get_record(records: DataFrame, links: DataFrame, keys: DataFrame, home: str | None = None) -> dict[str, DataFrame]:
    """``records``: cards of the wanted ids or slugs; ``links``: their edges."""
    found = get_records(records, keys, links, home)
    cards = records.select(*R.record_card()).join(found, "id")
    return {"records": cards, "links": K.links_of(found.select("id").distinct(), links, records)}
