"""Explicit schemas of the archive tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()
STRINGS = T.ArrayType(_S)
FLOATS = T.ArrayType(T.FloatType())


def _table(required: dict, optional: dict) -> T.StructType:
    fields = [T.StructField(n, t, False) for n, t in required.items()]
    return T.StructType(fields + [T.StructField(n, t, True) for n, t in optional.items()])


RECORDS = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("checkout", _S, False),
        T.StructField("slug", _S, False),
        T.StructField("type", _S, False),
        T.StructField("scope", _S, False),
        T.StructField("title", _S, False),
        T.StructField("status", _S, False),
        T.StructField("severity", _S, True),
        T.StructField("body", _S, False),
        T.StructField("source_path", _S, True),
        T.StructField("tags", STRINGS, True),
        T.StructField("applies_to", STRINGS, True),
        T.StructField("supersedes", STRINGS, True),
        T.StructField("superseded_by", _S, True),
        T.StructField("provenance_commit", _S, True),
        T.StructField("content_hash", _S, False),
        T.StructField("created_at", _TS, True),
        T.StructField("updated_at", _TS, True),
    ]
)
RECORD_VECTORS = _table({"record_id": _S, "model": _S, "dim": _I, "embedding": FLOATS}, {"text_hash": _S})
FILES = _table({"checkout": _S, "path": _S, "content_hash": _S}, {"package_name": _S, "indexed_at": _TS})
SYMBOLS = _table(
    {"checkout": _S, "file_path": _S, "seq": _I, "name": _S, "kind": _S, "line": _I},
    {"doc": _S, "exported": _B},
)
EDGES = _table({"checkout": _S, "from_file": _S, "to_path": _S, "edge_type": _S}, {})
COMMITS = _table(
    {"checkout": _S, "hash": _S}, {"subject": _S, "body": _S, "author": _S, "authored_at": _TS}
)
LINKS = _table({"kind": _S, "from_checkout": _S, "from_id": _S, "to_root": _S, "to_id": _S}, {})
CHANGES = _table({"checkout": _S, "change_id": _S}, {"at": _TS, "path": _S})
ATTEMPTS = _table({"key": _S, "attempts": _I}, {"last_error": _S, "state": _S})

#: One line of the command log; ``args`` and ``result`` stay JSON text here and
#: become variants in the reader.
LOG_LINE = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("ts", _S),
        T.StructField("dir", _S),
        T.StructField("source", _S),
        T.StructField("command", _S),
        T.StructField("args", T.VariantType()),
        T.StructField("result", T.VariantType()),
        T.StructField("error", _S),
        T.StructField("duration_ms", _L),
    ]
)
