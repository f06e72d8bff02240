"""Typed documents: front matter parsing and the document reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.text import let


def front_matter(content: Column) -> Column:
    """Split a document into ``fields`` (map), ``body`` and ``closed`` (S3).

    One JVM expression per document: the block between the ``---`` lines, its
    ``key: value`` lines, the last value of a repeated key.
    """
    text = F.regexp_replace(F.coalesce(content, F.lit("")), "^﻿", "")
    opened = F.regexp_like(text, F.lit(r"^---\r?\n"))
    rest = F.regexp_replace(text, r"^---\r?\n", "")
    end = F.instr(rest, "\n---")
    closed = opened & (end > 0)
    block = F.when(closed, F.substr(rest, F.lit(1), end - 1)).otherwise("")
    body = F.when(closed, F.regexp_replace(F.substr(rest, end + 4), "^\n", "")).otherwise(text)
    lines = F.filter(
        F.transform(F.split(block, "\n"), R.strip),
        lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & (F.instr(x, ":") > 1),
    )
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            R.strip(F.substring_index(x, ":", 1)).alias("k"), R.unquote(R.strip(F.substr(x, F.instr(x, ":") + 1))).alias("v")
        ),
    )

    def as_map(bound: Column) -> Column:
        # a later line of the same key wins, so every entry carries that value
        final = F.transform(
            F.array_distinct(F.filter(F.transform(bound, lambda p: p["k"]), lambda k: k != "")),
            lambda k: F.struct(k.alias("k"), F.element_at(F.filter(bound, lambda p: p["k"] == k), -1)["v"].alias("v")),
        )
        return F.map_from_entries(final)

    fields = let(pairs, as_map)
    return F.struct(
        fields.alias("fields"), body.alias("body"), (~opened | closed).alias("closed")
    )


def parse_documents(docs: DataFrame) -> DataFrame:
    """``[source_path, content, fallback_scope, checkout]`` to records plus ``violations``.

    Documents without an id in their front matter are not records.
    """
    parsed = docs.withColumn("fm", front_matter(F.col("content"))).withColumn("f", F.col("fm.fields"))
    kept = parsed.where(F.trim(F.coalesce(F.col("f")["id"], F.lit(""))) != "")

    def given(key: str) -> Column:
        return R.text_or_empty(F.col("f")[key])

    def non_empty(value: Column) -> Column:
        return F.when(value != "", value)

    path = F.col("source_path")
    fields = kept.select(
        given("id").alias("id"),
        F.col("checkout"),
        R.slug_from_path(path).alias("slug"),
        F.coalesce(non_empty(given("type")), F.lit("decision")).alias("type"),
        F.coalesce(
            F.col("f")["scope"], non_empty(R.scope_from_path(path)), non_empty(F.col("fallback_scope")), F.lit("repo")
        ).alias("scope"),
        F.coalesce(non_empty(given("title")), R.title_from_body(R.strip(F.col("fm.body")))).alias("title"),
        R.default_status(given("status")).alias("status"),
        non_empty(given("severity")).alias("severity"),
        R.strip(F.col("fm.body")).alias("body"),
        path.alias("source_path"),
        R.inline_list(given("tags")).alias("tags"),
        R.inline_list(given("applies_to")).alias("applies_to"),
        R.inline_list(given("supersedes")).alias("supersedes"),
        non_empty(given("superseded_by")).alias("superseded_by"),
        non_empty(given("provenance_commit")).alias("provenance_commit"),
        # the hash sees the status as written, before the default
        R.content_hash(
            F.coalesce(non_empty(given("type")), F.lit("decision")),
            F.coalesce(
                F.col("f")["scope"], non_empty(R.scope_from_path(path)), non_empty(F.col("fallback_scope")), F.lit("repo")
            ),
            F.coalesce(non_empty(given("title")), R.title_from_body(R.strip(F.col("fm.body")))),
            given("status"), given("severity"), R.strip(F.col("fm.body")),
            R.inline_list(given("tags")), R.inline_list(given("applies_to")),
        ).alias("content_hash"),
    )
    cols = [F.col(c) for c in ("type", "scope", "status", "severity", "title", "slug")]
    return fields.withColumn("violations", R.violations(*cols))


def read_documents(spark: SparkSession, roots: dict[str, str], checkout: str = "") -> DataFrame:
    """Every markdown file below the roots as a record.

    ``roots`` maps a folder to the scope its files fall back to.  Paths are
    relative to the root, with the virtual prefix of home scopes in front.
    """
    frames = []
    for root, scope in roots.items():
        files = (
            spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.{md,MD,Md,mD}").load(root)
        )
        prefix = {"dev": f"{R.DEV_PREFIX}/", "global": f"{R.GLOBAL_PREFIX}/"}.get(scope, "")
        relative = F.substring_index(F.col("_metadata.file_path"), root.rstrip("/") + "/", -1)
        frames.append(
            files.select(
                F.concat(F.lit(prefix), F.url_decode(relative)).alias("source_path"),
                F.col("value").alias("content"), F.lit(scope).alias("fallback_scope"),
                F.lit(checkout).alias("checkout"),
            )
        )
    docs = frames[0]
    for frame in frames[1:]:
        docs = docs.unionByName(frame)
    # the scope a document states decides where it belongs, not the folder it lies in
    return parse_documents(docs).withColumn("checkout", F.when(F.col("scope") == "repo", F.col("checkout")).otherwise(""))


def serialize(records: DataFrame) -> DataFrame:
    """``[rel_path, content]``: front matter in fixed key order, then the body (K1)."""
    def quote(value: Column) -> Column:
        special = F.regexp_like(value, F.lit(r"[:#\[\]{}\"'\n]"))
        escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
        return F.when(special, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(value)

    def line(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}: "), value)

    def listed(key: str) -> Column:
        items = R.list_or_empty(F.col(key))
        return F.when(
            F.size(items) > 0, line(key, F.concat(F.lit("["), F.array_join(F.transform(items, quote), ", "), F.lit("]")))
        )

    def optional(key: str) -> Column:
        return F.when(R.text_or_empty(F.col(key)) != "", line(key, F.col(key)))

    content = F.concat_ws(
        "\n", F.lit("---"), line("id", F.col("id")), line("type", F.col("type")), line("scope", F.col("scope")),
        line("status", F.col("status")), line("title", quote(F.col("title"))), optional("severity"),
        listed("applies_to"), listed("tags"), listed("supersedes"), optional("superseded_by"),
        optional("provenance_commit"), F.lit("---"), F.lit(""), R.strip(F.col("body")), F.lit(""),
    )
    rel = F.concat_ws("/", F.lit("records"), "scope", "type", F.concat("slug", F.lit(".md")))
    return records.select(rel.alias("rel_path"), "scope", "type", content.alias("content"))


