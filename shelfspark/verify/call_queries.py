"""Queries and oracles: command-log analytics and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import calls, evaluate
from ..operators.evaluate import Rule
from ..session import ROCKSDB_PROVIDER, new_folder
from ..streaming.log import pair_calls_stream
from .adapters import with_views
from .registry import query

MAINTENANCE_SQL = "(" + ", ".join(f"'{c}'" for c in C.MAINTENANCE_COMMANDS) + ")"


FIFO_SQL = """
walk AS (SELECT *, sum(CASE WHEN dir = 'in' THEN 1 ELSE -1 END) OVER w AS bal,
    sum(CASE WHEN dir = 'in' THEN 1 ELSE 0 END) OVER w AS in_no, sum(CASE WHEN dir = 'out' THEN 1 ELSE 0 END) OVER w AS out_no
    FROM v_in_out WINDOW w AS (PARTITION BY checkout ORDER BY line_no)),
low AS (SELECT *, least(0, min(bal) OVER (PARTITION BY checkout ORDER BY line_no)) AS lowest,
    least(0, coalesce(min(bal) OVER (PARTITION BY checkout ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM walk),
ins AS (SELECT checkout, line_no, in_no AS k FROM low WHERE dir = 'in'),
outs AS (SELECT checkout, line_no, CASE WHEN lowest < before THEN NULL ELSE out_no + lowest END AS k FROM low WHERE dir = 'out')"""


@query("paired_fifo_calls", "J17 N8", with_views("v_in_out", FIFO_SQL + """
--
SELECT i.checkout, i.line_no AS in_line, o.line_no AS out_line FROM ins i LEFT JOIN outs o ON o.checkout = i.checkout AND o.k = i.k
UNION ALL SELECT checkout, NULL, line_no FROM outs WHERE k IS NULL"""))
def paired_fifo_calls(t):
    return calls.pair_fifo(t.in_out)


@query("streamed_calls", "X2 N8", with_views("v_in_out", FIFO_SQL + """
--
SELECT i.checkout, i.line_no AS in_line, o.line_no AS out_line FROM ins i LEFT JOIN outs o ON o.checkout = i.checkout AND o.k = i.k
UNION ALL SELECT checkout, NULL, line_no FROM outs WHERE k IS NULL"""))
def streamed_calls(t):
    """The log goes through a stream in several files out of order, up to a last line that moves the watermark past all others."""
    lines = t.in_out.select("checkout", "id", "name", "dir", "line_no", "ts")
    spread = lines.repartition(6, F.xxhash64("line_no"))
    folder = new_folder(t.spark, "log-stream")
    spread.write.parquet(f"{folder}/lines")
    stream = t.spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/lines")
    last = lines.agg(F.max("ts").alias("ts")).select(
        F.lit("end of log").alias("checkout"), F.lit("").alias("id"), F.lit("").alias("name"), F.lit("in").alias("dir"),
        F.lit(0).cast("long").alias("line_no"), (F.col("ts") + F.expr("INTERVAL 4000 DAYS")).alias("ts"))
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)

    def drain():
        calls = pair_calls_stream(stream, "3000 days", "3000 days")
        query = calls.writeStream.format("parquet").option("path", f"{folder}/calls").option(
            "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    drain()
    last.write.mode("append").parquet(f"{folder}/lines")
    last.withColumn("ts", F.col("ts") + F.expr("INTERVAL 8000 DAYS")).write.mode("append").parquet(f"{folder}/lines")
    drain()
    calls = t.spark.read.parquet(f"{folder}/calls").where("checkout <> 'end of log'")
    return calls.select("checkout", "in_line", "out_line")


@query("paired_fifo_calls_in_blocks", "J17 N8", with_views("v_in_out", FIFO_SQL.replace("v_in_out", "one") + """
--
SELECT i.checkout, i.line_no AS in_line, o.line_no AS out_line FROM ins i LEFT JOIN outs o ON o.checkout = i.checkout AND o.k = i.k
UNION ALL SELECT checkout, NULL, line_no FROM outs WHERE k IS NULL""").replace("walk AS", "one AS (SELECT * REPLACE ('' AS checkout) FROM v_in_out), walk AS"))
def paired_fifo_calls_in_blocks(t):
    """The same pairing of one shared command, cut into blocks of 512 lines."""
    one = t.in_out.withColumn("checkout", F.lit(""))
    return calls.pair_fifo(one, 512)


@query("paired_calls_by_id", "J17 N7", """
WITH l AS (SELECT 'c' || (event_id // 3) AS id, event_id AS line_no, CASE WHEN event_type IN ('view', 'signup') THEN 'in' ELSE 'out' END AS dir FROM events),
p AS (SELECT *, lag(dir) OVER (PARTITION BY id ORDER BY line_no) AS pd, lag(line_no) OVER (PARTITION BY id ORDER BY line_no) AS pl FROM l),
outs AS (SELECT CASE WHEN pd = 'in' THEN pl END AS in_line, line_no AS out_line FROM p WHERE dir = 'out')
SELECT in_line, out_line FROM outs
UNION ALL SELECT line_no, NULL FROM l WHERE dir = 'in' AND line_no NOT IN (SELECT in_line FROM outs WHERE in_line IS NOT NULL)""")
def paired_calls_by_id(t):
    lines = t.raw("events").select(
        F.lit("").alias("checkout"), F.concat(F.lit("c"), F.floor(F.col("event_id") / 3).cast("string")).alias("id"),
        F.col("event_id").alias("line_no"),
        F.when(F.col("event_type").isin("view", "signup"), "in").otherwise("out").alias("dir"),
    )
    return calls.pair_by_id(lines, 1000).select("in_line", "out_line")


@query("paired_calls", "J17 F28", """
WITH l AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'in' WHEN 'assistant' THEN 'out' END AS dir, conv_id * 1000 + turn AS line_no FROM conversations),
i AS (SELECT conv_id, line_no, row_number() OVER (PARTITION BY conv_id ORDER BY line_no) AS k FROM l WHERE dir = 'in'),
o AS (SELECT conv_id, line_no, row_number() OVER (PARTITION BY conv_id ORDER BY line_no) AS k FROM l WHERE dir = 'out')
SELECT CAST(i.conv_id AS VARCHAR) AS checkout, i.line_no AS seq, 'search' AS name, o.line_no IS NOT NULL AS has_out,
    coalesce(o.line_no, i.line_no) AS at_sec FROM i LEFT JOIN o ON o.conv_id = i.conv_id AND o.k = i.k""")
def paired_calls(t):
    line = F.col("conv_id") * 1000 + F.col("turn")
    ts = F.timestamp_seconds(line)
    log = t.raw("conversations").where("role IN ('user', 'assistant')").select(
        F.col("conv_id").cast("string").alias("checkout"), line.alias("line_no"), F.lit(None).cast("string").alias("id"),
        ts.alias("ts"), (line * 1_000_000_000).alias("ts_ns"), F.when(F.col("role") == "user", "in").otherwise("out").alias("dir"),
        F.lit("mcp").alias("source"), F.lit("shelf search").alias("command"), F.try_parse_json(F.lit("{}")).alias("args"),
        F.try_parse_json(F.lit("[]")).alias("result"), F.lit("").alias("error"),
    )
    return calls.pair_calls(log).select("checkout", "seq", "name", "has_out", F.unix_seconds("at").alias("at_sec"))


@query("call_counts", "A4 P10", with_views("v_calls", f"""
SELECT checkout, name, CAST(count(*) AS BIGINT) AS n FROM v_calls WHERE called_at >= TIMESTAMP '2024-01-08 00:00:00'
AND called_at <= TIMESTAMP '2024-01-22 00:00:00' AND name NOT IN {MAINTENANCE_SQL} GROUP BY checkout, name"""))
def call_counts(t):
    bounds = [F.lit(x).cast("timestamp") for x in ("2024-01-08 00:00:00", "2024-01-22 00:00:00")]
    return calls.call_counts(calls.reported_calls(t.calls, *bounds))


def _search_log(t):
    """Search calls whose JSON result is built from the events."""
    k = F.get_json_object("props", "$.k").cast("int")
    ident = F.concat(F.lit("rec_"), k.cast("string"))
    status = F.when(k % 10 == 0, "superseded").otherwise("accepted")
    source = F.when(k % 3 == 0, "fts").when(k % 3 == 1, "Vector").otherwise("hybrid")
    nested = F.to_json(F.struct(F.array(
        F.struct(source.alias("source"), F.struct(ident.alias("ID"), status.alias("Status"), F.lit("T").alias("Title")).alias("Record")),
        F.struct(F.lit("fts").alias("source"), F.struct(F.lit("rec_x").alias("ID"), F.lit("accepted").alias("Status"), F.lit("X").alias("Title")).alias("Record")),
    ).alias("results")))
    flat = F.to_json(F.array(F.struct(ident.alias("id"), status.alias("status"), source.alias("source"), F.lit("T").alias("title"))))
    result = (
        F.when(k % 7 == 0, '{"truncated": true, "bytes": 70000}').when(k % 7 == 1, '{"results": []}').when(k % 7 == 2, "[]")
        .when(k % 7 == 3, '{"is_error": true}').when(k % 2 == 0, nested).otherwise(flat)
    )
    args = F.to_json(F.struct(F.array(F.lit("find"), k.cast("string")).alias("args")))
    return t.raw("events").where("event_type = 'view'").select(
        F.col("user_id").cast("string").alias("checkout"), F.col("event_id").alias("seq"), F.lit("search").alias("name"),
        F.lit(True).alias("has_out"), F.col("ts").alias("at"), F.unix_micros("ts").alias("at_us"), F.try_parse_json(args).alias("args"),
        F.try_parse_json(result).alias("result"), F.when(k % 11 == 5, "boom").otherwise("").alias("error"),
    )


LOG_SQL = """
s AS (SELECT CAST(user_id AS VARCHAR) AS checkout, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts FROM events WHERE event_type = 'view'),
c AS (SELECT *, CASE WHEN k % 11 = 5 THEN 'failed' WHEN k % 7 = 0 THEN 'truncated' WHEN k % 7 <= 3 THEN 'empty' ELSE 'hits' END AS kind FROM s)"""


@query("search_classes", "A5 F27", with_views("", LOG_SQL + """
--
SELECT checkout, seq, 'find ' || k AS query, kind, kind = 'hits' AND k % 3 = 0 AS keyword_only,
    kind = 'hits' AND k % 2 = 1 AND k % 3 = 1 AS vector_only, kind = 'hits' AND k % 10 = 0 AS superseded_top,
    CASE WHEN kind = 'hits' THEN 'rec_' || k ELSE '' END AS top_id FROM c"""))
def search_classes(t):
    return calls.classify_searches(_search_log(t)).drop("at").withColumn("top_id", F.coalesce("top_id", F.lit("")))


@query("consulted_records", "A7 A6", with_views("", LOG_SQL + """,
h AS (SELECT checkout, seq, 0 AS pos, 'rec_' || k AS id, 'T' AS title FROM c WHERE kind = 'hits' AND k % 3 <> 1
    UNION ALL SELECT checkout, seq, 1, 'rec_x', 'X' FROM c WHERE kind = 'hits' AND k % 2 = 0)
--
SELECT checkout, id, min(seq) AS first_seq, any_value(title) AS title FROM h GROUP BY checkout, id"""))
def consulted_records(t):
    return calls.consulted(calls.uses(_search_log(t))).select("checkout", "id", "first_seq", "title")


@query("citation_rate", "A6", with_views("v_calls", """
SELECT checkout, CAST(count(DISTINCT hit_id) FILTER (WHERE name = 'cite') AS BIGINT) AS cited,
    CAST(count(DISTINCT hit_id) FILTER (WHERE name IN ('get', 'check')) AS BIGINT) AS retrieved
FROM v_calls WHERE name IN ('cite', 'get', 'check') GROUP BY checkout"""))
def citation_rate(t):
    used = t.calls.where("name IN ('cite', 'get', 'check')").select(
        "checkout", F.col("hit_id").alias("id"), (F.col("name") == "cite").alias("cited"), (F.col("name") != "cite").alias("retrieved")
    )
    return calls.citation_rate(used)


def _hits(t, name):
    return t.calls.where(F.col("name") == name).select("checkout", F.col("hit_id").alias("id"), "seq", "at_us")


@query("followed_gets", "J18", with_views("v_calls", """
SELECT g.checkout, g.seq, g.hit_id AS id, EXISTS (SELECT 1 FROM v_calls s WHERE s.name = 'search' AND s.checkout = g.checkout
    AND s.hit_id = g.hit_id AND s.seq < g.seq AND s.at_us BETWEEN g.at_us - 259200000000 AND g.at_us) AS found
FROM v_calls g WHERE g.name = 'get'"""))
def followed_gets(t):
    # three days: within thirty minutes the generated log has no follow-through at all
    return calls.follow_through(_hits(t, "get"), _hits(t, "search"), 3 * 24 * 3600).select("checkout", "seq", "id", "found")


@query("remembers_without_search", "J19", with_views("v_calls", """
SELECT g.checkout, g.seq FROM v_calls g WHERE g.name = 'remember' AND NOT EXISTS (SELECT 1 FROM v_calls s WHERE s.name = 'search'
    AND s.checkout = g.checkout AND s.seq < g.seq AND s.at_us BETWEEN g.at_us - 1800000000 AND g.at_us)"""))
def remembers_without_search(t):
    return calls.without_search(_hits(t, "remember"), _hits(t, "search")).select("checkout", "seq")


@query("shared_log_follow_through", "J18 J19", with_views("v_calls", """
SELECT g.seq, EXISTS (SELECT 1 FROM v_calls s WHERE s.name = 'search' AND s.hit_id = g.hit_id AND s.seq < g.seq
    AND s.at_us BETWEEN g.at_us - 1800000000 AND g.at_us) AS found FROM v_calls g WHERE g.name = 'get'"""))
def shared_log_follow_through(t):
    """All users in one shared checkout: the hot key case, at the default window."""
    def shared(name):
        return _hits(t, name).withColumn("checkout", F.lit(""))

    return calls.follow_through(shared("get"), shared("search")).select("seq", "found")


@query("review_due", "A8 C13", with_views("v_calls", """
SELECT checkout, epoch_us(max(called_at) FILTER (WHERE name = 'cite' AND seq % 3 <> 0 AND seq % 5 <> 0 AND seq % 7 <> 0)) AS last_us,
    coalesce(TIMESTAMP '2024-02-05 00:00:00' >= max(called_at) FILTER (WHERE name = 'cite' AND seq % 3 <> 0 AND seq % 5 <> 0 AND seq % 7 <> 0)
    + INTERVAL 7 DAYS, true) AS due FROM v_calls GROUP BY checkout"""))
def review_due(t):
    seq = F.col("seq")
    log = t.calls.select(
        "checkout", F.when(F.col("name") == "cite", "review").otherwise(F.col("name")).alias("name"), "has_out", F.col("at").alias("out_at"),
        F.when(seq % 3 == 0, "failed").otherwise("").alias("error"),
        F.try_parse_json(F.when(seq % 5 == 0, '{"is_error": true}').otherwise("{}")).alias("result"),
        F.try_parse_json(F.when(seq % 7 == 0, '{"flags": {"due": "true"}}').otherwise("{}")).alias("args"),
    )
    return calls.last_review(log, F.lit("2024-02-05 00:00:00").cast("timestamp")).select(
        "checkout", F.unix_micros("last_review").alias("last_us"), "due"
    )


@query("golden_evaluation", "A13 C16", with_views("v_records v_calls", """
golden AS (SELECT id FROM v_records WHERE status = 'accepted' AND ((type IN ('rule', 'decision') AND contains(body, 'the')) OR (type = 'pitfall' AND contains(body, 'que')))),
h AS (SELECT checkout AS run, seq // 8 AS s, seq % 8 AS pos, hit_id AS id FROM v_calls WHERE name = 'search'),
r AS (SELECT run, s, min(pos + 1) FILTER (WHERE id IN (SELECT id FROM golden)) AS rank FROM h GROUP BY run, s),
a AS (SELECT run, count(*) AS searches, bool_or(rank IS NOT NULL) AS golden_surfaced, min(rank) AS best_rank, round(CAST(coalesce(sum(CAST(CAST(1 AS DOUBLE) / rank AS DECIMAL(20, 12))), 0) AS DOUBLE) / count(*), 6) AS mrr FROM r GROUP BY run),
g AS (SELECT checkout AS run, count(*) AS gets, bool_or(hit_id IN (SELECT id FROM golden)) AS golden_read FROM v_calls WHERE name = 'get' GROUP BY 1),
c AS (SELECT checkout AS run, count(*) AS cites, sum(CASE WHEN seq % 4 = 0 THEN 1 ELSE 0 END) AS cites_invalid,
    bool_or(hit_id IN (SELECT id FROM golden) AND seq % 4 <> 0) AS golden_cited FROM v_calls WHERE name = 'cite' GROUP BY 1)
--
SELECT coalesce(a.run, g.run, c.run) AS run, CAST(coalesce(searches, 0) AS BIGINT) AS searches, coalesce(golden_surfaced, false) AS golden_surfaced,
    CAST(coalesce(best_rank, 0) AS BIGINT) AS best_rank, coalesce(mrr, 0) AS mrr, CAST(coalesce(gets, 0) AS BIGINT) AS gets,
    coalesce(golden_read, false) AS golden_read, CAST(coalesce(cites, 0) AS BIGINT) AS cites,
    CAST(coalesce(cites_invalid, 0) AS BIGINT) AS cites_invalid, coalesce(golden_cited, false) AS golden_cited
FROM a FULL JOIN g ON g.run = a.run FULL JOIN c ON c.run = coalesce(a.run, g.run)"""))
def golden_evaluation(t):
    golden = evaluate.golden_ids(t.records, "the", "que")
    run, seq = F.col("checkout").alias("run"), F.col("seq")
    hits = t.calls.where("name = 'search'").select(run, F.floor(seq / 8).alias("seq"), (seq % 8).alias("pos"), F.col("hit_id").alias("id"))
    gets = t.calls.where("name = 'get'").select(run, F.col("hit_id").alias("id"))
    cites = t.calls.where("name = 'cite'").select(run, F.col("hit_id").alias("id"), (seq % 4 == 0).alias("invalid"))
    out = evaluate.retrieval_eval(hits, gets, cites, golden)
    return out.withColumn("mrr", F.round("mean_reciprocal_rank", 6)).drop("mean_reciprocal_rank")


@query("golden_ranks", "A13", with_views("v_records v_calls", """
golden AS (SELECT id FROM v_records WHERE type = 'feature'),
h AS (SELECT checkout AS run, seq // 8 AS seq, seq % 8 AS pos, hit_id AS id FROM v_calls WHERE name = 'search')
--
SELECT run, seq, min(pos + 1) FILTER (WHERE id IN (SELECT id FROM golden)) AS rank FROM h GROUP BY run, seq"""))
def golden_ranks(t):
    seq = F.col("seq")
    hits = t.calls.where("name = 'search'").select(
        F.col("checkout").alias("run"), F.floor(seq / 8).alias("seq"), (seq % 8).alias("pos"), F.col("hit_id").alias("id")
    )
    return evaluate.golden_ranks(hits, t.records.where("type = 'feature'").select("id"))


@query("passes_by_arm", "A14", """
SELECT event_type AS arm, CAST(count(*) FILTER (WHERE value >= 10) AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS runs FROM events GROUP BY 1""")
def passes_by_arm(t):
    return evaluate.compare_runs(t.raw("events").select(F.col("event_type").alias("arm"), (F.col("value") >= 10).alias("passed")))


@query("runs_by_arm", "A14", """
SELECT CAST(user_id AS VARCHAR) AS run, max(value) FILTER (WHERE event_type = 'view') AS "view", max(value) FILTER (WHERE event_type = 'click') AS click,
    max(value) FILTER (WHERE event_type = 'error') AS error FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY user_id""")
def runs_by_arm(t):
    best = t.raw("events").where("event_type IN ('view', 'click', 'error')").groupBy("user_id", "event_type").agg(F.max("value").alias("score"))
    return evaluate.runs_by_arm(best.select(F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("arm"), "score"), ["view", "click", "error"])


@query("archive_changes", "A15", with_views("v_records", """
SELECT id, CASE doc_id % 10 WHEN 1 THEN 'removed' ELSE 'changed' END AS change FROM v_records WHERE doc_id % 10 IN (1, 2, 3)
UNION ALL SELECT 'copy_' || doc_id, 'added' FROM v_records WHERE doc_id % 10 = 4"""))
def archive_changes(t):
    n = F.regexp_extract("id", r"(\d+)", 1).cast("long") % 10
    kept = t.records.where(n != 1)
    after = kept.withColumn("title", F.when(n == 2, "other").otherwise(F.col("title"))).withColumn(
        "body", F.when(n == 3, F.concat("body", F.lit("."))).otherwise(F.col("body"))
    )
    copies = t.records.where(n == 4).withColumn("id", F.concat(F.lit("copy_"), F.regexp_extract("id", r"(\d+)", 1)))
    return evaluate.archive_diff(t.records, after.unionByName(copies))


def _stamps(t):
    e = F.col("event_type")
    return t.raw("events").where("event_type IN ('signup', 'purchase')").groupBy("user_id", "event_type", F.dayofmonth("ts").alias("part")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last")
    ).select(
        F.col("user_id").cast("string").alias("run"), "part", F.when(e == "signup", "start").otherwise("end").alias("kind"),
        F.when(e == "signup", F.col("first")).otherwise(F.col("last")).alias("at"),
    )


STAMP_SQL = """
a AS (SELECT CAST(user_id AS VARCHAR) AS run, day(ts) AS part, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY ALL),
b AS (SELECT CAST(user_id AS VARCHAR) AS run, day(ts) AS part, max(ts) AS t1 FROM events WHERE event_type = 'purchase' GROUP BY ALL)"""


@query("session_seconds", "A16", with_views("", STAMP_SQL + """
--
SELECT a.run, CAST(sum(CAST(floor(epoch(t1)) AS BIGINT) - CAST(floor(epoch(t0)) AS BIGINT)) AS BIGINT) AS seconds
FROM a JOIN b ON b.run = a.run AND b.part = a.part GROUP BY a.run"""))
def session_seconds(t):
    return evaluate.session_time(_stamps(t))[0]


@query("unpaired_sessions", "A16", with_views("", STAMP_SQL + """
--
SELECT run, CAST(part AS INTEGER) AS part FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.run = a.run AND b.part = a.part)"""))
def unpaired_sessions(t):
    return evaluate.session_time(_stamps(t))[1].select("run", "part")


@query("transcript_tools", "A17", """
SELECT CAST(conv_id AS VARCHAR) AS transcript, CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS tool_calls,
    bool_or(role = 'assistant' AND regexp_matches(text, '\\bla\\b.*\\bde\\b')) AS history_read FROM conversations GROUP BY conv_id""")
def transcript_tools(t):
    block = F.struct(
        F.when(F.col("role") == "assistant", "tool_use").otherwise("text").alias("type"), F.struct(F.col("text").alias("command")).alias("input")
    )
    line = F.to_json(F.struct(F.struct(F.array(block).alias("content")).alias("message")))
    lines = t.raw("conversations").select(F.col("conv_id").cast("string").alias("transcript"), line.alias("line"))
    return evaluate.transcript_counters(lines, r"\bla\b.*\bde\b")


@query("log_transport", "A17", """
SELECT CAST(user_id AS VARCHAR) AS run, CASE WHEN bool_or(event_type = 'error') THEN 'mcp' WHEN bool_or(event_type <> 'view') THEN 'cli' ELSE 'none' END AS transport
FROM events GROUP BY user_id""")
def log_transport(t):
    source = F.when(F.col("event_type") == "error", "mcp").when(F.col("event_type") == "view", "").otherwise("cli")
    return evaluate.transport(t.raw("events").select(F.col("user_id").cast("string").alias("run"), source.alias("source")))


@query("context_check", "A18", """
WITH l AS (SELECT doc_id, line, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
w AS (SELECT *, bool_or(regexp_matches(line, '(?i)under|unter')) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM l)
SELECT doc_id, bool_and(NOT contains(line, 'the') OR near) AS ok FROM w GROUP BY doc_id""")
def context_check(t):
    return evaluate.context_check(t.documents, "the", "under|unter")


@query("corpus_assertions", "P18", with_views("v_records", """
live AS (SELECT * FROM v_records WHERE status = 'accepted')
--
SELECT 'rule holds both' AS rule, coalesce(bool_or(type IN ('rule', 'decision') AND contains(body, 'the') AND contains(body, 'and')), false) AS ok FROM live
UNION ALL SELECT 'pitfall holds one', coalesce(bool_or(type = 'pitfall' AND contains(body, 'que')), false) FROM live
UNION ALL SELECT 'no rule holds it', NOT coalesce(bool_or(type IN ('rule', 'decision') AND contains(body, 'que')), false) FROM live
UNION ALL SELECT 'no guide holds it', NOT coalesce(bool_or(type = 'guide' AND contains(body, 'NOT-THERE')), false) FROM live"""))
def corpus_assertions(t):
    return evaluate.assert_corpus(t.records, [
        Rule("rule holds both", ("rule", "decision"), ("the", "and")), Rule("pitfall holds one", ("pitfall",), ("que",)),
        Rule("no rule holds it", ("rule", "decision"), ("que",), expect=False), Rule("no guide holds it", ("guide",), ("NOT-THERE",), expect=False),
    ])
