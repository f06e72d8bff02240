"""Command-log analytics: pairing, classification, consulted records, clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import logs as L
from ..functions import records as R
from ..session import new_folder
from .scan import BLOCK_ROWS, block_of, carry_forward, exists_within

VARIANTS = "array<variant>"


def pair_by_id(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``[checkout, in_line, out_line]`` of lines with an id.

    An ``out`` belongs to the line just before it of the same id when that is an
    ``in``; otherwise it stands alone.
    """
    step = carry_forward(
        lines.select("checkout", "id", "line_no", "dir", block_of(F.col("line_no"), block_rows).alias("_block")),
        ["checkout", "id"], "_block", [F.col("line_no")], F.struct("dir", "line_no"), "prev",
    )
    outs = step.where("dir = 'out'").select(
        "checkout", F.when(F.col("prev.dir") == "in", F.col("prev.line_no")).alias("in_line"),
        F.col("line_no").alias("out_line"),
    )
    return _with_open_calls(outs, lines)


def pair_fifo(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``[checkout, in_line, out_line]`` of lines without an id, first in first out per command.

    The queue length is a running sum that never drops below zero.  With
    ``low`` the running minimum of the plain sum, ``-low`` outs have met an empty
    queue so far; the others pair with the ``in`` of the same ordinal.  Sums
    and minima are taken inside line blocks and then over block totals, so one
    busy command is not one task.
    """
    key = ["checkout", "name"]
    part = lines.select(
        *key, "line_no", "dir", F.when(F.col("dir") == "in", 1).otherwise(-1).alias("step"),
        block_of(F.col("line_no"), block_rows).alias("block"),
    )
    inside = Window.partitionBy(*key, "block").orderBy("line_no")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = part.select(
        "*", F.sum("step").over(upto).alias("bal"),
        F.sum(F.when(F.col("dir") == "in", 1).otherwise(0)).over(upto).alias("ins"),
        F.sum(F.when(F.col("dir") == "out", 1).otherwise(0)).over(upto).alias("outs"),
    ).select(
        "*", F.min("bal").over(upto).alias("low"),
        F.min("bal").over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias("low_before"),
    )
    totals = local.groupBy(*key, "block").agg(
        F.sum("step").alias("t_bal"), F.min("bal").alias("t_low"), F.max("ins").alias("t_ins"), F.max("outs").alias("t_outs")
    )
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *key, "block", "t_low", F.coalesce(F.sum("t_bal").over(earlier), F.lit(0)).alias("s_bal"),
        F.coalesce(F.sum("t_ins").over(earlier), F.lit(0)).alias("s_ins"),
        F.coalesce(F.sum("t_outs").over(earlier), F.lit(0)).alias("s_outs"),
    )
    starts = starts.withColumn(
        "s_low", F.coalesce(F.min(F.col("s_bal") + F.col("t_low")).over(earlier), F.lit(0))
    ).drop("t_low")
    rows = local.join(starts, [*key, "block"]).select(
        *key, "line_no", "dir", (F.col("s_ins") + F.col("ins")).alias("in_no"), (F.col("s_outs") + F.col("outs")).alias("out_no"),
        (F.col("s_bal") + F.col("bal")).alias("balance"),
        F.least(F.lit(0), F.col("s_low"), F.col("s_bal") + F.col("low")).alias("lowest"),
        F.least(F.lit(0), F.col("s_low"), F.col("s_bal") + F.col("low_before")).alias("lowest_before"),
    )
    ins = rows.where("dir = 'in'").select(*key, F.col("in_no").alias("ordinal"), F.col("line_no").alias("in_line"))
    outs = rows.where("dir = 'out'").withColumn("alone", F.col("balance") < F.col("lowest_before"))
    matched = outs.where("NOT alone").select(
        *key, (F.col("out_no") + F.col("lowest")).alias("ordinal"), F.col("line_no").alias("out_line")
    )
    pairs = ins.join(matched, [*key, "ordinal"], "left").select("checkout", "in_line", "out_line")
    lone = outs.where("alone").select("checkout", F.lit(None).cast("long").alias("in_line"), F.col("line_no").alias("out_line"))
    return pairs.unionByName(lone)


def _with_open_calls(outs: DataFrame, lines: DataFrame) -> DataFrame:
    taken = outs.where("in_line IS NOT NULL").select("checkout", F.col("in_line").alias("line_no"))
    open_ins = lines.where("dir = 'in'").join(taken, ["checkout", "line_no"], "left_anti")
    return outs.unionByName(
        open_ins.select("checkout", F.col("line_no").alias("in_line"), F.lit(None).cast("long").alias("out_line"))
    )


def pair_calls(log: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per call (J17): ``[checkout, seq, name, has_out, at, at_us, source, args, result, error]``.

    ``log`` has the columns of the command log; ``seq`` is the position of the
    ``in`` line, or of an ``out`` without one.  ``at`` is the ``out`` time when
    it parses, else the ``in`` time.
    """
    lines = log.withColumn("name", L.base_command(F.col("command"))).withColumn("id", R.text_or_empty(F.col("id")))
    pairs = pair_by_id(lines.where("id <> ''"), block_rows).unionByName(pair_fifo(lines.where("id = ''"), block_rows))
    opened = lines.where("dir = 'in'").select(
        "checkout", F.col("line_no").alias("in_line"), F.col("name").alias("in_name"), F.col("ts").alias("in_ts"),
        F.col("ts_ns").alias("in_ns"), F.col("source").alias("in_source"), "args",
    )
    closed = lines.where("dir = 'out'").select(
        "checkout", F.col("line_no").alias("out_line"), F.col("name").alias("out_name"), F.col("ts").alias("out_ts"),
        F.col("ts_ns").alias("out_ns"), F.col("source").alias("out_source"), "result", "error",
    )
    rows = pairs.join(opened, ["checkout", "in_line"], "left").join(closed, ["checkout", "out_line"], "left")
    at = F.coalesce("out_ts", "in_ts")
    return rows.select(
        "checkout", F.coalesce("in_line", "out_line").alias("seq"), F.coalesce("in_name", "out_name").alias("name"),
        F.col("out_line").isNotNull().alias("has_out"), at.alias("at"), F.unix_micros(at).alias("at_us"),
        F.coalesce("out_ns", "in_ns").alias("at_ns"), F.col("out_ts").alias("out_at"),
        F.coalesce("in_source", "out_source").alias("source"), "args", "result",
        R.text_or_empty(F.col("error")).alias("error"),
    )


def reported_calls(calls: DataFrame, after: Column | None = None, until: Column | None = None) -> DataFrame:
    """Completed calls in the window, maintenance commands left out (A4, P10)."""
    return calls.where(~F.col("name").isin(*C.MAINTENANCE_COMMANDS) & F.col("has_out")).where(
        R.in_window(F.col("at"), after, until)
    )


def call_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("checkout", "name").agg(F.count("*").alias("n"))


def search_results(result: Column) -> Column:
    """Hits of a search result that have an id, in order."""
    items = F.coalesce(
        F.try_variant_get(result, "$.results", VARIANTS), F.try_variant_get(result, "$.Results", VARIANTS),
        F.try_variant_get(result, "$", VARIANTS),
    )
    return F.filter(F.transform(items, L.record_fields), lambda h: h["id"] != "")


def check_results(result: Column) -> Column:
    """Matches of a check result: id, title, globs, reason and severity."""
    items = F.coalesce(
        F.try_variant_get(result, "$.Matches", VARIANTS), F.try_variant_get(result, "$.matches", VARIANTS)
    )
    def of(item: Column) -> Column:
        hit = L.record_fields(item)
        return F.struct(
            hit["id"].alias("id"), hit["title"].alias("title"), hit["applies_to"].alias("applies_to"),
            F.coalesce(L.field(item, "Reason", "reason"), F.lit("")).alias("reason"),
            F.coalesce(L.field(item, "Severity", "severity"), hit["status"]).alias("severity"),
        )

    return F.filter(F.transform(items, of), lambda h: h["id"] != "")


def call_query(args: Column) -> Column:
    """The searched text: a query field, else the joined positional arguments."""
    direct = F.coalesce(L.field(args, "query", "Query"), F.lit(""))
    return F.when(direct != "", direct).otherwise(
        F.coalesce(F.array_join(F.try_variant_get(args, "$.args", "array<string>"), " "), F.lit(""))
    )


ITEM = ("struct<id: string, title: string, status: string, applies_to: array<string>, source: string, reason: string, "
        "severity: string>")


def type_calls(calls: DataFrame) -> DataFrame:
    """What the reports need of each call, its variants read once.

    ``[checkout, seq, name, at, at_us, error, truncated, query, id, title, effect, items]``: ``items`` are the records a
    search, get, check or cite names, in order.  ``id`` and ``title`` are those of a citation or a new record.  Typed
    calls come back as they are, so the functions below take either form.
    """
    if "items" in calls.columns:
        return calls
    result, args, name = F.col("result"), F.col("args"), F.col("name")
    none = F.lit(None).cast("string")

    def item(h: Column, status: Column, source: Column, reason: Column, severity: Column) -> Column:
        return F.struct(h["id"].alias("id"), h["title"].alias("title"), status.alias("status"), h["applies_to"].alias("applies_to"),
                        source.alias("source"), reason.alias("reason"), severity.alias("severity")).cast(ITEM)

    found = F.transform(search_results(result), lambda h: item(h, h["status"], h["source"], none, none))
    met = F.transform(check_results(result), lambda h: item(h, none, none, h["reason"], h["severity"]))
    got = L.record_fields(result)
    ident, effect = cited(result, args)
    quoted = F.struct(ident.alias("id"), F.lit("").alias("title"), F.array().cast("array<string>").alias("applies_to"))
    items = (
        F.when(name == "search", found).when(name == "get", F.array(item(got, got["status"], got["source"], none, none)))
        .when(name == "check", met).when(name == "cite", F.array(item(quoted, none, none, none, none)))
    )
    return calls.select(
        "checkout", "seq", "name", "at", "at_us", "error",
        ((name == "search") & F.coalesce(F.try_variant_get(result, "$.truncated", "boolean"), F.lit(False))).alias("truncated"),
        F.when(name == "search", call_query(args)).alias("query"),
        F.when(name == "cite", ident).when(name == "remember", L.field(result, "id", "ID")).alias("id"),
        F.when(name == "remember", remember_title(args)).alias("title"), F.when(name == "cite", effect).alias("effect"),
        F.coalesce(items, F.array().cast(f"array<{ITEM}>")).alias("items"),
    )


def store_calls(calls: DataFrame) -> DataFrame:
    """Typed calls written to the shared folder, so every section of a report reads a few columns of one table."""
    typed = type_calls(calls)
    path = new_folder(calls.sparkSession, "typed-calls")
    typed.write.parquet(path)
    return calls.sparkSession.read.schema(typed.schema).parquet(path)


def classify_searches(calls: DataFrame) -> DataFrame:
    """One row per search call with its kind and flags (A5).

    Kind is failed, truncated, empty or hits.  A tool failure that carries no
    error text is empty here, while the review clock counts it as failed.
    """
    s = type_calls(calls).where("name = 'search'")
    kind = (
        F.when(F.col("error") != "", "failed").when(F.col("truncated"), "truncated")
        .when(F.size("items") == 0, "empty").otherwise("hits")
    )
    s = s.withColumn("kind", kind)
    real = F.col("kind") == "hits"
    top = F.get("items", 0)
    return s.select(
        "checkout", "seq", "at", "query", "kind",
        (real & F.forall("items", lambda h: F.lower(h["source"]) == "fts")).alias("keyword_only"),
        (real & F.forall("items", lambda h: F.lower(h["source"]) == "vector")).alias("vector_only"),
        (real & (F.lower(top["status"]) == "superseded")).alias("superseded_top"),
        F.when(real, top["id"]).alias("top_id"),
    )


def named_records(calls: DataFrame, *names: str) -> DataFrame:
    """``[checkout, seq, name, at, at_us, pos, <item fields>]`` of the records that successful calls of these names list."""
    rows = type_calls(calls).where(F.col("name").isin(*names) & (F.col("error") == "") & ~F.col("truncated"))
    return rows.select("checkout", "seq", "name", "at", "at_us", F.posexplode("items").alias("pos", "h")).select(
        "checkout", "seq", "name", "at", "at_us", "pos", "h.*").where("id <> ''")


def search_hits(calls: DataFrame) -> DataFrame:
    """``[checkout, seq, at_us, pos, id, title, applies_to, source]`` of successful searches."""
    return named_records(calls, "search").select(
        "checkout", "seq", "at", "at_us", "pos", "id", "title", "applies_to", F.lower("source").alias("source"))


def uses(calls: DataFrame) -> DataFrame:
    """Every consultation of a record: ``[checkout, seq, pos, at, id, title, applies_to, retrieved, cited]``.

    Vector-only search hits do not count; a citation is consulted but not retrieved.
    """
    rows = named_records(calls, "search", "get", "check", "cite").where((F.col("name") != "search") | (F.lower("source") != "vector"))
    return rows.select("checkout", "seq", "pos", "at", "id", "title", "applies_to", (F.col("name") != "cite").alias("retrieved"),
                       (F.col("name") == "cite").alias("cited"))


def cited(result: Column, args: Column) -> tuple[Column, Column]:
    """Id and effect of a citation; the result wins over the arguments."""
    def first(*values: Column) -> Column:
        return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))

    ident = first(L.field(result, "id", "ID"), L.field(args, "id", "ID"), F.try_variant_get(args, "$.args[0]", "string"))
    return ident, first(L.field(result, "effect", "Effect"), L.field(args, "effect", "Effect"), L.field(args, "flags.effect", "flags.Effect"))


def cite_calls(calls: DataFrame) -> DataFrame:
    """``[checkout, seq, at, id, effect]`` of citations."""
    return type_calls(calls).where("name = 'cite'").select("checkout", "seq", "at", "id", "effect")


def consulted(used: DataFrame) -> DataFrame:
    """Distinct consulted ids in first-seen order with the last non-empty title and globs."""
    order = F.struct("seq", "pos")
    title = F.when(F.col("title") != "", F.col("title"))
    globs = F.when(F.size("applies_to") > 0, F.col("applies_to"))
    return used.groupBy("checkout", "id").agg(
        F.min(order).alias("first"),
        F.max_by("title", F.when(title.isNotNull(), order)).alias("title"),
        F.max_by("applies_to", F.when(globs.isNotNull(), order)).alias("applies_to"),
    ).select(
        "checkout", "id", F.col("first.seq").alias("first_seq"), F.col("first.pos").alias("first_pos"),
        R.text_or_empty(F.col("title")).alias("title"), R.list_or_empty(F.col("applies_to")).alias("applies_to"),
    )


def citation_rate(used: DataFrame) -> DataFrame:
    """Distinct cited and retrieved ids per checkout (A6); distinct first, so no set grows in one task."""
    per_id = used.groupBy("checkout", "id").agg(F.bool_or("cited").alias("c"), F.bool_or("retrieved").alias("r"))
    return per_id.groupBy("checkout").agg(
        F.sum(F.col("c").cast("long")).alias("cited"), F.sum(F.col("r").cast("long")).alias("retrieved")
    )


def follow_through(gets: DataFrame, hits: DataFrame, within_seconds: int = C.FOLLOW_SECONDS) -> DataFrame:
    """``gets`` plus ``found``: an earlier search returned that id shortly before.

    Both sides need ``[checkout, id, seq, at_us]``.
    """
    return exists_within(gets, hits.select("checkout", "id", "seq", "at_us"), ["checkout", "id"], within_seconds * 1_000_000)


def without_search(remembers: DataFrame, searches: DataFrame, within_seconds: int = C.FOLLOW_SECONDS) -> DataFrame:
    """New records written with no search at all shortly before (J19); failed searches count as searches."""
    marked = exists_within(
        remembers, searches.select("checkout", "seq", "at_us"), ["checkout"], within_seconds * 1_000_000
    )
    return marked.where("NOT found").drop("found")


def last_review(calls: DataFrame, now: Column, days: int = C.REVIEW_DAYS) -> DataFrame:
    """``[checkout, last_review, due]`` per checkout.

    Only completed full reviews count: not the clock, not a failure, not a tool
    result marked as an error.
    """
    failed = (F.col("error") != "") | F.coalesce(F.try_variant_get("result", "$.is_error", "boolean"), F.lit(False))
    full = (F.col("name") == "review") & F.col("has_out") & ~failed & ~F.coalesce(L.due_only(F.col("args")), F.lit(False))
    return review_clock(calls.select("checkout", F.when(full, F.col("out_at")).alias("at")), now, days)


def review_clock(reviews: DataFrame, now: Column, days: int = C.REVIEW_DAYS) -> DataFrame:
    """Latest review time per checkout, and whether the next one is due."""
    last = reviews.groupBy("checkout").agg(F.max("at").alias("last_review"))
    due = F.col("last_review").isNull() | (now >= F.col("last_review") + F.make_dt_interval(days=F.lit(days)))
    return last.withColumn("due", due)


def remember_title(args: Column) -> Column:
    return F.coalesce(L.field(args, "title", "Title"), L.field(args, "flags.title", "flags.Title"), F.lit(""))
