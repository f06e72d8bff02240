"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns
of ``documents``.  Between stages the table is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import stages
from shelfspark.llm.common import table, written

STAGES = [
    ("quality rules", stages.keep_good),
    ("n-gram Jaccard join", stages.one_of_each),
    ("secret scans", stages.redact_secrets),
    ("mixing sources", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

#: Hashed n-gram models, permutations and token ids have no SQL form; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
