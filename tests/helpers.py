"""Small builders for archive tables."""

import datetime as dt

from pyspark.sql import functions as F

from shelfspark.functions import records as R

T0 = dt.datetime(2026, 1, 5, 12, 0, 0)
FIELDS = {
    "id": "string", "checkout": "string", "slug": "string", "type": "string", "scope": "string", "title": "string",
    "status": "string", "severity": "string", "body": "string", "source_path": "string", "tags": "array<string>",
    "applies_to": "array<string>", "supersedes": "array<string>", "superseded_by": "string", "provenance_commit": "string",
    "created_at": "timestamp",
}


def records(spark, *rows):
    """Records from dicts; only ``id`` is required."""
    base = dict(
        checkout="", type="decision", scope="repo", status="accepted", severity=None, body="", tags=[], applies_to=[],
        supersedes=[], superseded_by=None, provenance_commit=None, created_at=T0,
    )
    data = []
    for row in rows:
        full = {**base, "slug": row["id"], "title": row["id"], "source_path": row["id"] + ".md", **row}
        data.append(tuple(full[k] for k in FIELDS))
    df = spark.createDataFrame(data, ", ".join(f"{k} {t}" for k, t in FIELDS.items()))
    return R.with_content_hash(df).withColumn("updated_at", F.col("created_at"))


def vectors(spark, rows, model="test"):
    data = [(k, model, len(v), [float(x) for x in v]) for k, v in rows.items()]
    return spark.createDataFrame(data, "record_id string, model string, dim int, embedding array<float>")


def query(spark, text, embedding=(1.0, 0.0), **extra):
    names = ["query_id", "text", "embedding", *extra]
    types = {"query_id": "int", "text": "string", "embedding": "array<float>"}
    schema = ", ".join(f"{n} {types.get(n, 'string')}" for n in names)
    return spark.createDataFrame([(1, text, list(embedding) if embedding else None, *extra.values())], schema)
