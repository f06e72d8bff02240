"""Queries over the driver tables with an SQL oracle each."""

from __future__ import annotations

import importlib

MODULES = ("retrieval_queries", "scalar_queries", "table_queries", "rule_queries", "call_queries", "code_queries", "report_queries")


def load() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
