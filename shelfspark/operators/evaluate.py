"""Retrieval evaluation and corpus checks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from .sizing import lookup_join


def golden_ids(records: DataFrame, rule_token: str, pitfall_token: str) -> DataFrame:
    """Accepted rules and decisions holding one token, accepted pitfalls holding the other."""
    holds = (F.col("type").isin("rule", "decision") & F.contains("body", F.lit(rule_token))) | (
        (F.col("type") == "pitfall") & F.contains("body", F.lit(pitfall_token))
    )
    return records.where((F.col("status") == "accepted") & holds).select("id")


def golden_ranks(hits: DataFrame, golden: DataFrame) -> DataFrame:
    """First rank of a golden id per search (A13): ``[run, seq, rank]``, null when not surfaced.

    ``hits[run, seq, pos, id]`` with positions from 0.
    """
    best = lookup_join(hits, golden.select("id").distinct(), ["id"], "left_semi").groupBy("run", "seq").agg(
        F.min(F.col("pos") + 1).alias("rank")
    )
    return hits.select("run", "seq").distinct().join(best, ["run", "seq"], "left")


def retrieval_eval(hits: DataFrame, gets: DataFrame, cites: DataFrame, golden: DataFrame) -> DataFrame:
    """Per run: searches, surfaced, best and reciprocal rank, read, cited, invalid citations.

    ``gets[run, id]``, ``cites[run, id, invalid]``.
    """
    ranks = golden_ranks(hits, golden).groupBy("run").agg(
        F.count("*").alias("searches"), F.coalesce(F.bool_or(F.col("rank").isNotNull()), F.lit(False)).alias("golden_surfaced"),
        F.min("rank").alias("best_rank"),
        # exact decimals: a sum of doubles would depend on the order of addition
        (F.coalesce(F.sum((F.lit(1.0) / F.col("rank")).cast("decimal(20,12)")), F.lit(0)).cast("double") / F.count("*"))
        .alias("mean_reciprocal_rank"),
    )
    marked = golden.select("id").distinct().withColumn("g", F.lit(True))

    def flagged(df: DataFrame) -> DataFrame:
        return lookup_join(df, marked, ["id"], "left").withColumn("g", F.coalesce("g", F.lit(False)))

    read = flagged(gets).groupBy("run").agg(F.count("*").alias("gets"), F.bool_or("g").alias("golden_read"))
    cited = flagged(cites).groupBy("run").agg(
        F.count("*").alias("cites"), F.sum(F.col("invalid").cast("long")).alias("cites_invalid"),
        F.bool_or(F.col("g") & ~F.col("invalid")).alias("golden_cited"),
    )
    return ranks.join(read, "run", "full").join(cited, "run", "full").na.fill(0).na.fill(False)


def compare_runs(scores: DataFrame) -> DataFrame:
    """Passes and runs per arm."""
    return scores.groupBy("arm").agg(F.sum(F.col("passed").cast("long")).alias("passed"), F.count("*").alias("runs"))


def runs_by_arm(scores: DataFrame, arms: list[str], value: str = "score") -> DataFrame:
    """One row per run, one column per arm."""
    return scores.groupBy("run").pivot("arm", arms).agg(F.first(value))


def archive_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records that differ between two snapshots: ``[id, change]``."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "id",
            F.struct(
                "type", "status", R.text_or_empty(F.col("superseded_by")).alias("s"), F.char_length("body").alias("n"), "title"
            ).alias(name),
        )

    both = digest(before, "a").join(digest(after, "b"), "id", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("id", change.alias("change")).where("change IS NOT NULL")


def session_time(stamps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seconds per run over paired start and end stamps, and the starts without an end.

    ``stamps[run, part, kind, at]``.
    """
    starts = stamps.where("kind = 'start'").select("run", "part", F.col("at").alias("start"))
    ends = stamps.where("kind = 'end'").select("run", "part", F.col("at").alias("end"))
    seconds = F.unix_seconds("end") - F.unix_seconds("start")
    paired = starts.join(ends, ["run", "part"]).groupBy("run").agg(F.sum(seconds).alias("seconds"))
    return paired, starts.join(ends, ["run", "part"], "left_anti")


def transcript_counters(lines: DataFrame, pattern: str) -> DataFrame:
    """Tool calls per transcript, and whether any command matches the pattern.

    ``lines[transcript, line]`` of JSON text.
    """
    blocks = lines.select("transcript", F.explode_outer(
        F.try_variant_get(F.try_parse_json("line"), "$.message.content", "array<variant>")
    ).alias("b"))
    tool = F.coalesce(F.try_variant_get("b", "$.type", "string") == "tool_use", F.lit(False))
    command = F.coalesce(F.try_variant_get("b", "$.input.command", "string"), F.lit(""))
    return blocks.groupBy("transcript").agg(
        F.sum(tool.cast("long")).alias("tool_calls"),
        F.bool_or(tool & F.regexp_like(command, F.lit(pattern))).alias("history_read"),
    )


def transport(log: DataFrame) -> DataFrame:
    """Which channel each run's log used: mcp, cli or none."""
    seen = log.groupBy("run").agg(F.bool_or(F.col("source") == "mcp").alias("mcp"), F.bool_or(F.col("source") != "").alias("any"))
    return seen.select("run", F.when(F.col("mcp"), "mcp").when(F.col("any"), "cli").otherwise("none").alias("transport"))


def context_check(docs: DataFrame, token: str, marker: str, within: int = 3) -> DataFrame:
    """Is a marker near every line that holds the token? ``[doc_id, ok]``.

    One JVM expression per document, no shuffle.
    """
    lines = F.split("text", "\n")

    def near(line: Column, at: Column) -> Column:
        first = F.greatest(at - within, F.lit(0))
        around = F.slice(lines, first + 1, at + within + 1 - first)
        return ~F.contains(line, F.lit(token)) | F.exists(around, lambda x: F.regexp_like(x, F.lit(f"(?i){marker}")))

    return docs.select("doc_id", F.forall(F.transform(lines, near), lambda ok: ok).alias("ok"))


@dataclass(frozen=True)
class Rule:
    """A corpus assertion: some (or no) accepted record of the types holds all tokens in its body."""

    name: str
    types: tuple[str, ...]
    tokens: tuple[str, ...]
    expect: bool = True


def assert_corpus(records: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``[rule, ok]``: every rule in one pass over the accepted records."""
    rules = list(rules)
    live = records.where((F.col("status") == "accepted") & (R.text_or_empty(F.col("superseded_by")) == ""))

    def holds(rule: Rule) -> Column:
        test = F.col("type").isin(*rule.types)
        for token in rule.tokens:
            test = test & F.contains("body", F.lit(token))
        return F.coalesce(F.bool_or(test), F.lit(False))

    row = live.agg(*[(holds(r) == F.lit(r.expect)).alias(f"r{i}") for i, r in enumerate(rules)])
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("ok")) for i, r in enumerate(rules)])
    return row.select(F.inline(pairs))
