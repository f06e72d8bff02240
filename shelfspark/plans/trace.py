"""Trace report over a command log (C11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import calls as K
from ..operators import changes as D


def trace(calls: DataFrame, changes: DataFrame | None = None, records: DataFrame | None = None,
          after: Column | None = None, until: Column | None = None) -> dict[str, DataFrame]:
    """One DataFrame per section; ``calls`` comes from ``pair_calls``.

    The log is paired and its values are read once, into a stored table of typed calls; every section reads the columns
    it needs of that table.  ``changes[checkout, path]`` adds the sections about consulted and missed records.
    """
    seen = K.store_calls(K.reported_calls(calls, after, until))
    used = K.uses(seen)
    hits = K.search_hits(seen)
    ok = seen.where("error = ''")
    out = {
        "counts": K.call_counts(seen),
        "searches": K.classify_searches(seen),
        "gets": K.follow_through(K.named_records(seen, "get").select("checkout", "seq", "at", "at_us", "id", "title"), hits),
        "remembers_without_search": K.without_search(
            ok.where("name = 'remember'").select("checkout", "seq", "at", "at_us", "id", "title"), seen.where("name = 'search'")),
        "check_matches": K.named_records(seen, "check").select("checkout", "seq", "at", "id", "title", "applies_to", "reason", "severity"),
        "cites": K.cite_calls(ok).where("id <> ''"),
        "citation_rate": K.citation_rate(used),
        "consulted": K.consulted(used),
    }
    if changes is not None and records is not None:
        out["changed"] = changes.select("checkout", "path").groupBy("checkout").agg(F.count("*").alias("n_paths")).withColumn(
            "wide", F.col("n_paths") > C.WIDE_PATHS
        )
        out["overlap"] = D.overlap(out["consulted"], records, changes)
        out["missed_rules"] = D.missed_rules(used, records, changes).join(
            records.select(F.col("id").alias("record_id"), "title", "applies_to"), "record_id"
        )
    return out
