"""Record expressions: predicates, validation, cards, hashes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

GLOBAL_PREFIX = "global"
DEV_PREFIX = "user"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def list_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.array().cast("array<string>"))


def is_retired(status: Column) -> Column:
    return text_or_empty(status).isin(*C.RETIRED)


def is_current(status: Column) -> Column:
    return ~is_retired(status)


def is_enforceable(type_: Column, severity: Column) -> Column:
    return (type_ == "rule") & text_or_empty(severity).isin("must", "must-not")


def passes_filter(type_: Column, status: Column, want_type: Column | None = None,
                  want_status: Column | None = None) -> Column:
    """Optional type; an exact status, else everything not retired."""
    ok = F.lit(True)
    if want_type is not None:
        ok = ok & ((text_or_empty(want_type) == "") | (type_ == want_type))
    if want_status is None:
        return ok & is_current(status)
    wanted = text_or_empty(want_status)
    return ok & F.when(wanted == "", is_current(status)).otherwise(text_or_empty(status) == wanted)


def same_tenant(left: Column, right: Column) -> Column:
    """Either side shared, or the same checkout."""
    return (left == "") | (right == "") | (left == right)


def in_window(at: Column, after: Column | None = None, until: Column | None = None) -> Column:
    """Inclusive on both ends; an absent bound is open, an absent time fails any bound (P10)."""
    ok = F.lit(True)
    if after is not None:
        ok = ok & F.when(after.isNull(), True).otherwise(F.coalesce(at >= after, F.lit(False)))
    if until is not None:
        ok = ok & F.when(until.isNull(), True).otherwise(F.coalesce(at <= until, F.lit(False)))
    return ok


def scope_rank(scope: Column) -> Column:
    ranks = F.lit(0)
    for name, rank in C.SCOPE_RANK.items():
        ranks = F.when(scope == name, rank).otherwise(ranks)
    return ranks


def type_rank(type_: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in C.TYPE_ORDER]), type_).cast("int")


def violations(type_: Column, scope: Column, status: Column, severity: Column, title: Column,
               slug: Column) -> Column:
    """What is wrong with a record, as a list; empty when valid."""
    checks = [
        F.when(text_or_empty(type_) == "", "type is required").when(~type_.isin(*C.TYPES), "invalid type"),
        F.when(text_or_empty(scope) == "", "scope is required").when(~scope.isin(*C.SCOPES), "invalid scope"),
        F.when(~default_status(status).isin(*C.STATUSES), "invalid status"),
        F.when(
            (type_ == "rule") & (text_or_empty(severity) != "") & ~severity.isin(*C.SEVERITIES),
            "invalid severity",
        ),
        F.when(text_or_empty(title) == "", "title is required"),
        F.when(text_or_empty(slug).isin("", "."), "slug is required"),
    ]
    return F.array_compact(F.array(*checks))


def default_status(status: Column) -> Column:
    return F.when(text_or_empty(status) == "", "accepted").otherwise(status)


def patched(new: Column, old: Column) -> Column:
    """A non-empty new value wins."""
    return F.when(text_or_empty(new) != "", new).otherwise(old)


def patched_list(new: Column, old: Column) -> Column:
    return F.when(F.size(list_or_empty(new)) > 0, new).otherwise(old)


def content_hash(type_, scope, title, status, severity, body, tags, applies_to) -> Column:
    """SHA-256 over the fields without separators."""
    parts = [text_or_empty(c) for c in (type_, scope, title, status, severity, body)]
    lists = [F.array_join(list_or_empty(c), "") for c in (tags, applies_to)]
    return F.sha2(F.concat(*parts, *lists), 256)


def embed_text(title, type_, scope, severity, tags, applies_to, body) -> Column:
    """What the embedding model sees."""
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), text_or_empty(title)),
        F.concat(F.lit("Type: "), text_or_empty(type_)),
        F.concat(F.lit("Scope: "), text_or_empty(scope)),
        F.when(text_or_empty(severity) != "", F.concat(F.lit("Severity: "), severity)),
        F.when(F.size(list_or_empty(tags)) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))),
        F.when(
            F.size(list_or_empty(applies_to)) > 0,
            F.concat(F.lit("AppliesTo: "), F.array_join(applies_to, ", ")),
        ),
    )
    return F.concat(lines, F.lit("\n\n"), strip(text_or_empty(body)))


def strip(text: Column) -> Column:
    """Trim every kind of white space, line breaks included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clip_utf8(text: Column, limit: int) -> Column:
    """The first ``limit`` bytes, without a broken character at the end."""
    raw = F.encode(text, "UTF-8")
    return F.coalesce(
        *[F.try_validate_utf8(F.substring(raw, 1, limit - back).cast("string")) for back in range(min(4, limit))]
    )


def title_from_body(body: Column) -> Column:
    """First ``# `` heading, else the first 80 bytes, else a placeholder."""
    heading = F.regexp_extract(body, r"(?m)^[^\S\n]*# (.*)$", 1)
    has_heading = F.regexp_like(body, F.lit(r"(?m)^[^\S\n]*# "))
    first = strip(text_or_empty(body))
    return (
        F.when(has_heading, strip(heading))
        .when(F.octet_length(first) > 80, F.concat(clip_utf8(first, 80), F.lit("...")))
        .when(first != "", first)
        .otherwise("Untitled")
    )


def inline_list(value: Column) -> Column:
    """``[a, "b"]`` to an array; a bare scalar is one item."""
    trimmed = strip(text_or_empty(value))
    inner = F.regexp_replace(F.regexp_replace(trimmed, r"^\[", ""), r"\]$", "")
    items = F.filter(F.transform(F.split(inner, ","), lambda p: unquote(strip(p))), lambda p: p != "")
    return (
        F.when(trimmed.isin("", "[]"), F.array().cast("array<string>"))
        .when(~F.startswith(trimmed, F.lit("[")), F.array(trimmed))
        .otherwise(items)
    )


def unquote(value: Column) -> Column:
    """Strip one pair of equal quotes around a value."""
    quoted = F.regexp_like(value, F.lit("(?s)^(\".*\"|'.*')$")) & (F.char_length(value) >= 2)
    return F.when(quoted, F.substr(value, F.lit(2), F.char_length(value) - 2)).otherwise(value)


def slugify(title: Column) -> Column:
    """Lower case, every run outside a-z0-9 to one dash, no dash at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")


def slug_from_path(path: Column) -> Column:
    """File name without its extension."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def scope_from_path(path: Column) -> Column:
    """Scope named by a virtual home prefix, else empty."""
    def under(prefix: str) -> Column:
        return (path == prefix) | F.startswith(path, F.lit(prefix + "/"))

    return F.when(under(DEV_PREFIX), "dev").when(under(GLOBAL_PREFIX), "global").otherwise("")


def default_path(scope: Column, slug: Column, repo_dir: str = "records") -> Column:
    """Where a new record of that scope is stored."""
    prefix = F.when(scope == "dev", DEV_PREFIX).when(scope == "global", GLOBAL_PREFIX).otherwise(repo_dir)
    return F.concat(prefix, F.lit("/"), slug, F.lit(".md"))


def search_card() -> list[Column]:
    """Record columns of a search result (P16); null lists become empty."""
    return [
        F.col("id"), F.col("slug"), F.col("type"), F.col("scope"), F.col("title"), F.col("status"),
        list_or_empty(F.col("applies_to")).alias("applies_to"),
        text_or_empty(F.col("superseded_by")).alias("superseded_by"), F.col("checkout"),
    ]


def record_card() -> list[Column]:
    """Columns of a fetched record."""
    return [
        F.col("id"), F.col("slug"), F.col("type"), F.col("scope"), F.col("title"), F.col("status"),
        text_or_empty(F.col("severity")).alias("severity"), F.col("body"),
        list_or_empty(F.col("tags")).alias("tags"),
        list_or_empty(F.col("applies_to")).alias("applies_to"),
        text_or_empty(F.col("superseded_by")).alias("superseded_by"),
    ]


def with_content_hash(df):
    """Recompute F15 from the columns of a records table."""
    cols = [F.col(c) for c in ("type", "scope", "title", "status", "severity", "body", "tags", "applies_to")]
    return df.withColumn("content_hash", content_hash(*cols))


def with_embed_text(df):
    cols = [F.col(c) for c in ("title", "type", "scope", "severity", "tags", "applies_to", "body")]
    return df.withColumn("embed_text", embed_text(*cols))
