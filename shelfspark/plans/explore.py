"""Explore code: symbols, imports, importers and commits of a query batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import code
from ..operators.substring_index import SubstringIndex
from ..session import cut_lineage


def explore(symbols: DataFrame | SubstringIndex, files: DataFrame | None, edges: DataFrame, commits: DataFrame | SubstringIndex,
            queries: DataFrame, limit: int = C.EXPLORE_LIMIT, edge_index: SubstringIndex | None = None) -> dict[str, DataFrame]:
    """``queries[query_id, checkout, text]``; an empty text finds nothing.  Symbols and commits may be stored indexes."""
    queries = queries.where(F.trim("text") != "")
    # at most ``limit`` symbols a query and the edges are read by several sections, and measured: written once
    found, edges = cut_lineage(code.search_symbols(symbols, files, queries, limit)), cut_lineage(edges)
    checkout = queries.select("query_id", "checkout")
    hit_files = found.select("query_id", "file_path").distinct().join(checkout, "query_id")
    return {
        "symbols": found,
        "imports": code.imports_of(edges, hit_files, limit),
        "importers": code.importers_of(edges, hit_files, queries, limit, edge_index),
        "commits": code.search_commits(commits, queries, limit),
    }
