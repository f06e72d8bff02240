"""Command-log expressions: field access in both casings, times, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .records import clip_utf8, strip


def field(value: Column, *names: str, kind: str = "string") -> Column:
    """First present field among ``names`` of a variant object."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{n}", kind) for n in names])


def record_fields(item: Column) -> Column:
    """id, title, status and applies_to of a hit, nested under a record or flat."""
    def pick(lower: str, upper: str, kind: str = "string") -> Column:
        return F.coalesce(
            *[F.try_variant_get(item, f"$.{p}{n}", kind) for p in ("Record.", "record.", "") for n in (upper, lower)]
        )

    return F.struct(
        F.coalesce(pick("id", "ID"), F.lit("")).alias("id"),
        F.coalesce(pick("title", "Title"), F.lit("")).alias("title"),
        F.coalesce(pick("status", "Status"), F.lit("")).alias("status"),
        F.coalesce(pick("applies_to", "AppliesTo", "array<string>"), F.array().cast("array<string>")).alias(
            "applies_to"
        ),
        F.coalesce(field(item, "Source", "source"), F.lit("")).alias("source"),
    )


def base_command(command: Column) -> Column:
    """Last word of the command."""
    return F.substring_index(F.trim(command), " ", -1)


def log_time(ts: Column) -> Column:
    """RFC 3339 with or without a fraction; null when it is neither."""
    shaped = F.regexp_like(ts, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"))
    return F.when(shaped, F.try_to_timestamp(ts))


def log_nanos(ts: Column) -> Column:
    """Nanoseconds since the epoch; Spark's timestamps stop at microseconds."""
    fraction = F.rpad(F.substr(F.regexp_extract(ts, r"\.(\d+)", 1), F.lit(1), F.lit(9)), 9, "0")
    whole = log_time(F.regexp_replace(ts, r"\.\d+", ""))
    return F.when(
        log_time(ts).isNotNull(),
        F.unix_seconds(whole) * F.lit(1_000_000_000) + fraction.cast("long"),
    )


def truthy(value: Column) -> Column:
    """A JSON true or the word true."""
    return F.lower(F.trim(F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("")))) == "true"


def due_only(args: Column) -> Column:
    """Whether a review call only asked for the clock."""
    def flag(path: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.try_variant_get(args, path, "string"), F.lit("")))) == "true"

    return flag("$.due") | flag("$.flags.due")


def valid_effect(effect: Column) -> Column:
    """A citation's effect is one non-empty line."""
    clean = strip(F.coalesce(effect, F.lit("")))
    return (clean != "") & ~F.regexp_like(clean, F.lit(r"[\r\n]"))


def clip_json(json: Column, limit: int = C.LOG_CLIP_BYTES) -> Column:
    """Replace an oversized JSON text by its size and a preview (K6)."""
    size = F.octet_length(json)
    clipped = F.to_json(
        F.struct(F.lit(True).alias("truncated"), size.alias("bytes"), clip_utf8(json, limit).alias("preview"))
    )
    return F.when(size > limit, clipped).otherwise(json)


def link_target(kind: Column, to: Column) -> Column:
    """``checkout#id`` at the last ``#``; a repo link is a path only.

    Null when the value does not parse.
    """
    value = strip(to)
    root = strip(F.regexp_extract(value, "(?s)^(.+)#([^#]+)$", 1))
    ident = strip(F.regexp_extract(value, "(?s)^(.+)#([^#]+)$", 2))
    name = F.trim(kind)
    return F.when(
        (name == "repo") & (value != ""), F.struct(value.alias("to_root"), F.lit("").alias("to_id"))
    ).when(
        name.isin("record", "pin") & (root != "") & (ident != ""),
        F.struct(root.alias("to_root"), ident.alias("to_id")),
    )
