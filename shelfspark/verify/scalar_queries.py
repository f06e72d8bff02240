"""Queries and oracles: scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import logs as L
from ..functions import paths as P
from ..functions import records as R
from ..functions import text as X
from .adapters import NOW, STOP_SQL, WORD_SQL, contains_sql, with_views
from .registry import query

CONTENT_SQL = f"list_filter(list_distinct(list_transform(toks, lambda x: lower(x))), lambda w: NOT list_contains({STOP_SQL}, w))"
MIN_SQL = "CASE WHEN n <= 2 THEN n ELSE (2 * n + 2) // 3 END"


@query("query_tokens", "F1", f"""
SELECT doc_id, array_to_string(regexp_extract_all(text, {WORD_SQL}), ' ') AS tokens FROM documents""")
def query_tokens(t):
    return t.documents.select("doc_id", F.array_join(X.query_tokens(F.col("text")), " ").alias("tokens"))


@query("content_terms", "F2", f"""
WITH w AS (SELECT item_id, w, pos FROM (SELECT item_id, unnest(regexp_extract_all(text, {WORD_SQL})) AS w,
    generate_subscripts(regexp_extract_all(text, {WORD_SQL}), 1) AS pos FROM benchmark)),
firsts AS (SELECT item_id, lower(w) AS k, min(pos) AS pos, arg_min(w, pos) AS w FROM w GROUP BY item_id, lower(w))
SELECT b.item_id, coalesce(string_agg(f.w, ' ' ORDER BY f.pos), '') AS terms FROM benchmark b
LEFT JOIN firsts f ON f.item_id = b.item_id AND NOT list_contains({STOP_SQL}, f.k) GROUP BY b.item_id""")
def content_terms(t):
    terms = X.content_terms(X.query_tokens(F.col("text")))
    return t.raw("benchmark").select("item_id", F.array_join(terms, " ").alias("terms"))


@query("search_terms", "F3 F4 F5", f"""
WITH b AS (SELECT conv_id, turn, trim(text) AS raw, regexp_extract_all(text, {WORD_SQL}) AS toks,
    len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '' AND NOT list_contains({STOP_SQL}, lower(x)))) AS words
    FROM conversations),
c AS (SELECT *, CASE WHEN raw = '' THEN [] WHEN len({CONTENT_SQL}) = 0 THEN [raw] ELSE {CONTENT_SQL} END AS terms FROM b),
d AS (SELECT *, len(terms) AS n FROM c)
SELECT conv_id, turn, array_to_string(list_sort(terms), ' ') AS terms, CAST({MIN_SQL} AS INTEGER) AS need,
    {MIN_SQL} < n AND words > 1 AS retry FROM d""")
def search_terms(t):
    terms = X.search_terms(F.col("text"))
    return t.raw("conversations").select("conv_id", "turn", "text", terms.alias("t")).select(
        "conv_id", "turn", F.array_join(F.array_sort("t"), " ").alias("terms"),
        X.min_should_match(F.size("t")).alias("need"),
        X.partial_terms_ok(F.col("text"), F.size("t")).alias("retry"),
    )


@query("term_snippets", "F11", f"""
WITH pairs AS (SELECT d.doc_id, b.item_id, d.text AS body, regexp_extract_all(b.text, {WORD_SQL}) AS toks
    FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
flat AS (SELECT doc_id, item_id, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS flat, {CONTENT_SQL} AS terms FROM pairs),
hit AS (SELECT *, coalesce(list_min(list_filter(list_transform(terms, lambda x: instr(lower(flat), x)), lambda p: p > 0)), 0) - 1 AS first FROM flat),
cut AS (SELECT *, CASE WHEN first >= 80 THEN first - 80 ELSE 0 END AS start FROM hit)
SELECT doc_id, item_id, (CASE WHEN start > 0 THEN '...' ELSE '' END) || substr(flat, start + 1, 240)
    || (CASE WHEN length(flat) > start + 240 THEN '...' ELSE '' END) AS snippet FROM cut""")
def term_snippets(t):
    asked = t.raw("benchmark")
    n = asked.agg(F.count("*").alias("n"))
    docs = t.documents.join(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n"))
    terms = asked.select("item_id", X.search_terms(F.col("text")).alias("terms"))
    return docs.join(terms, "item_id").select("doc_id", "item_id", X.snippet(F.col("text"), F.col("terms")).alias("snippet"))


@query("match_snippets", "F12")
def match_snippets(t):
    asked = t.raw("benchmark")
    n = asked.agg(F.count("*").alias("n"))
    docs = t.documents.join(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n"))
    terms = asked.select("item_id", X.index_tokens(F.col("text")).alias("terms"))
    return docs.join(terms, "item_id").select(
        "doc_id", "item_id", X.match_snippet(F.col("text"), F.col("terms")).alias("snippet")
    )


@query("embedding_query_text", "F13", f"""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN {C.INSTRUCT_PREFIX!r} || text ELSE text END AS sent FROM conversations""".replace(
    repr(C.INSTRUCT_PREFIX), "'" + C.INSTRUCT_PREFIX.replace("'", "''") + "'"))
def embedding_query_text(t):
    model = F.when(F.col("role") == "user", " Qwen3-Embedding:8b").otherwise("other")
    return t.raw("conversations").select("conv_id", "turn", X.query_for_embedding(model, F.col("text")).alias("sent"))


@query("record_embed_text", "F14", with_views("v_records", r"""
SELECT id, 'Title: ' || title || chr(10) || 'Type: ' || type || chr(10) || 'Scope: ' || scope || chr(10)
    || CASE WHEN severity IS NULL THEN '' ELSE 'Severity: ' || severity || chr(10) END
    || 'Tags: ' || array_to_string(tags, ', ') || chr(10)
    || CASE WHEN len(applies_to) = 0 THEN '' ELSE 'AppliesTo: ' || array_to_string(applies_to, ', ') || chr(10) END
    || chr(10) || regexp_replace(body, '^\s+|\s+$', '', 'g') AS embed_text FROM v_records"""))
def record_embed_text(t):
    return R.with_embed_text(t.records).select("id", "embed_text")


@query("content_hashes", "F15 F16", with_views("v_records", """
SELECT id, content_hash, sha256(body) AS file_hash, sha256(checkout) AS tenant_key FROM v_records"""))
def content_hashes(t):
    return t.records.select(
        "id", "content_hash", F.sha2("body", 256).alias("file_hash"), F.sha2("checkout", 256).alias("tenant_key")
    )


@query("slugs_and_default_paths", "F17 F18 F19", with_views("v_records", """
s AS (SELECT *, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS made FROM v_records)
--
SELECT id, made, CASE scope WHEN 'dev' THEN 'user' WHEN 'global' THEN 'global' ELSE 'records' END || '/' || made || '.md' AS path,
    regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS from_path,
    CASE scope WHEN 'dev' THEN 'dev' WHEN 'global' THEN 'global' ELSE '' END AS path_scope,
    CASE scope WHEN 'repo' THEN 3 WHEN 'global' THEN 2 ELSE 1 END AS scope_rank,
    CASE type WHEN 'rule' THEN 1 WHEN 'decision' THEN 2 WHEN 'feature' THEN 3 WHEN 'guide' THEN 4 WHEN 'map' THEN 5 ELSE 6 END AS type_rank
FROM s"""))
def slugs_and_default_paths(t):
    made = t.records.withColumn("made", R.slugify(F.col("title"))).withColumn(
        "path", R.default_path(F.col("scope"), F.col("made"))
    )
    return made.select(
        "id", "made", "path", R.slug_from_path(F.col("source_path")).alias("from_path"),
        R.scope_from_path(F.col("path")).alias("path_scope"), R.scope_rank(F.col("scope")).alias("scope_rank"),
        R.type_rank(F.col("type")).alias("type_rank"),
    )


FRONT_SQL = """'[' || array_to_string(list_transform(w, lambda x: '"' || x || '" '), ', ') || ']'"""


@query("inline_lists", "S4", f"""
WITH p AS (SELECT doc_id, {FRONT_SQL} AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)),
parts AS (SELECT doc_id, list_transform(string_split(substr(value, 2, length(value) - 2), ','),
    lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS parts FROM p)
SELECT doc_id, array_to_string(list_filter(list_transform(parts, lambda x: CASE WHEN length(x) >= 2 AND
    ((x[1] = '"' AND x[-1] = '"') OR (x[1] = '''' AND x[-1] = '''')) THEN substr(x, 2, length(x) - 2) ELSE x END),
    lambda x: x <> ''), '|') AS items FROM parts""")
def inline_lists(t):
    quoted = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit('"'), x, F.lit('" ')))
    value = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return t.documents.select("doc_id", F.array_join(R.inline_list(value), "|").alias("items"))


@query("titles_from_bodies", "S5", r"""
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || '  # ' || lang || ' ' || source || ' ' ELSE text END AS body FROM documents),
t AS (SELECT *, regexp_replace(body, '^\s+|\s+$', '', 'g') AS first FROM b)
SELECT doc_id, CASE WHEN regexp_matches(body, '(?m)^[^\S\n]*# ') THEN regexp_replace(regexp_extract(body, '(?m)^[^\S\n]*# (.*)$', 1), '^\s+|\s+$', '', 'g')
    WHEN octet_length(encode(first)) > 80 THEN '(cut)' WHEN first <> '' THEN first ELSE 'Untitled' END AS title,
    length(first) AS n_chars FROM t""")
def titles_from_bodies(t):
    body = F.when(
        F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n  # "), "lang", F.lit(" "), "source", F.lit(" "))
    ).otherwise(F.col("text"))
    out = t.documents.select("doc_id", body.alias("body")).select(
        "doc_id", R.title_from_body(F.col("body")).alias("title"), R.strip(F.col("body")).alias("first"),
        F.regexp_like("body", F.lit(r"(?m)^[^\S\n]*# ")).alias("headed"),
    )
    # a byte cut may end inside a character, which SQL cannot trim the same way: shown as (cut)
    return out.select(
        "doc_id",
        F.when(~F.col("headed") & (F.octet_length("first") > 80), "(cut)").otherwise(F.col("title")).alias("title"),
        F.char_length("first").cast("long").alias("n_chars"),
    )


@query("front_matter_ids", "S2 S3", r"""
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'rec_' || doc_id END AS id, lang AS tag, source AS title FROM documents
WHERE doc_id % 4 <> 3""")
def front_matter_ids(t):
    from ..sources.documents import front_matter

    head = F.concat(
        F.lit("---\n# note\ntags: old\nid: "),
        F.when(F.col("doc_id") % 4 == 3, "").otherwise(F.concat(F.lit("rec_"), F.col("doc_id").cast("string"))),
        F.lit("\ntags: '"), "lang", F.lit("'\ntitle:  \""), "source", F.lit("\"\n---\n"), "text",
    )
    parsed = t.documents.select("doc_id", front_matter(head).alias("fm"))
    return parsed.where(F.trim(F.col("fm.fields")["id"]) != "").select(
        "doc_id", F.col("fm.fields")["id"].alias("id"), F.col("fm.fields")["tags"].alias("tag"),
        F.col("fm.fields")["title"].alias("title"),
    )


@query("current_records", "P1 P2", with_views("v_current", "SELECT id, type, status FROM v_current"))
def current_records(t):
    return t.records.where(R.passes_filter(F.col("type"), F.col("status"))).select("id", "type", "status")


@query("records_by_type_and_status", "P1", with_views("v_records", """
SELECT id, slug, status FROM v_records WHERE type = 'rule' AND status = 'superseded'"""))
def records_by_type_and_status(t):
    keep = R.passes_filter(F.col("type"), F.col("status"), F.lit("rule"), F.lit("superseded"))
    return t.records.where(keep).select("id", "slug", "status")


@query("enforceable_rules", "P3", with_views("v_records", """
SELECT id, type, severity FROM v_records WHERE type = 'rule' AND severity IN ('must', 'must-not')"""))
def enforceable_rules(t):
    return t.records.where(R.is_enforceable(F.col("type"), F.col("severity"))).select("id", "type", "severity")


@query("tenant_visibility", "P4", with_views("v_records", """
t AS (SELECT DISTINCT checkout FROM v_records)
--
SELECT t.checkout, CAST(count(*) AS BIGINT) AS visible FROM t JOIN v_records r
ON t.checkout = '' OR r.checkout = '' OR r.checkout = t.checkout GROUP BY t.checkout"""))
def tenant_visibility(t):
    from ..operators.tables import visible_counts

    return visible_counts(t.records)


@query("path_scopes", "P9 P12 P14", with_views("v_pages", """
SELECT page_id, path, path = 'en' OR starts_with(path, 'en/') AS under_en,
    path = '' OR starts_with(path, '/') AS escapes,
    CASE WHEN contains(ltrim(path, '/'), '/') AND split_part(path, '/', 1) <> '' THEN split_part(path, '/', 1) END AS first
FROM v_pages"""))
def path_scopes(t):
    path = F.col("path")
    return t.pages.select(
        "page_id", "path", P.in_scope(path, F.lit("/en/")).alias("under_en"), P.escapes_root(path).alias("escapes"),
        P.anchored_segment(F.concat(F.lit("/"), path)).alias("first"),
    )


@query("events_in_window", "P10", """
SELECT event_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""")
def events_in_window(t):
    bounds = [F.lit(x).cast("timestamp") for x in ("2024-01-05 00:00:00", "2024-01-20 12:00:00")]
    return t.raw("events").where(R.in_window(F.col("ts"), *bounds)).select("event_id", "event_type")


@query("substring_terms", "P11", f"""
SELECT doc_id, {contains_sql('text', "'THE'")} AS has_the, {contains_sql('text', "'É'")} AS has_accent,
    {contains_sql('text', "'100%'")} AS has_percent FROM documents""")
def substring_terms(t):
    hit = [X.contains_term(F.col("text"), F.lit(w)) for w in ("THE", "É", "100%")]
    return t.documents.select("doc_id", hit[0].alias("has_the"), hit[1].alias("has_accent"), hit[2].alias("has_percent"))


@query("record_violations", "P13", with_views("v_records", """
m AS (SELECT id, CASE WHEN doc_id % 11 = 0 THEN 'memo' ELSE type END AS type, CASE WHEN doc_id % 13 = 0 THEN '' ELSE scope END AS scope,
    CASE WHEN doc_id % 17 = 0 THEN 'open' ELSE status END AS status, CASE WHEN doc_id % 5 = 0 THEN 'maybe' ELSE severity END AS severity,
    CASE WHEN doc_id % 19 = 0 THEN '' ELSE title END AS title, CASE WHEN doc_id % 23 = 0 THEN '.' ELSE slug END AS slug FROM v_records)
--
SELECT id, array_to_string(list_filter([
    CASE WHEN type = 'memo' THEN 'invalid type' END, CASE WHEN scope = '' THEN 'scope is required' END,
    CASE WHEN status = 'open' THEN 'invalid status' END, CASE WHEN type = 'rule' AND severity = 'maybe' THEN 'invalid severity' END,
    CASE WHEN title = '' THEN 'title is required' END, CASE WHEN slug = '.' THEN 'slug is required' END],
    lambda x: x IS NOT NULL), ', ') AS problems FROM m"""))
def record_violations(t):
    doc = F.regexp_extract("id", r"(\d+)", 1).cast("long")

    def spoil(n: int, value: str, col: str):
        return F.when(doc % n == 0, value).otherwise(F.col(col))

    found = R.violations(spoil(11, "memo", "type"), spoil(13, "", "scope"), spoil(17, "open", "status"),
                         spoil(5, "maybe", "severity"), spoil(19, "", "title"), spoil(23, ".", "slug"))
    return t.records.select("id", F.array_join(found, ", ").alias("problems"))


@query("record_cards", "P16", with_views("v_records", """
SELECT id, slug, type, scope, title, status, coalesce(severity, '') AS severity, body, array_to_string(tags, ',') AS tags,
    array_to_string(applies_to, ',') AS applies_to, '' AS superseded_by FROM v_records"""))
def record_cards(t):
    card = t.records.select(*R.record_card())
    return card.withColumn("tags", F.array_join("tags", ",")).withColumn("applies_to", F.array_join("applies_to", ","))


@query("patched_records", "P17", with_views("v_records", """
SELECT id, CASE WHEN doc_id % 3 = 0 AND title <> '' THEN 'New: ' || title ELSE title END AS title,
    CASE WHEN doc_id % 4 = 0 THEN 'deprecated' ELSE status END AS status,
    CASE WHEN doc_id % 5 = 0 THEN 'new/**' ELSE array_to_string(applies_to, ',') END AS applies_to FROM v_records"""))
def patched_records(t):
    doc = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    return t.records.select(
        "id",
        R.patched(F.when(doc % 3 == 0, F.concat(F.lit("New: "), "title")).otherwise(""), F.col("title")).alias("title"),
        R.patched(F.when(doc % 4 == 0, "deprecated"), F.col("status")).alias("status"),
        F.array_join(
            R.patched_list(F.when(doc % 5 == 0, F.array(F.lit("new/**"))), F.col("applies_to")), ","
        ).alias("applies_to"),
    )


@query("clipped_log_fields", "K6", """
WITH j AS (SELECT doc_id, to_json({'text': text}) AS j, octet_length(encode(CAST(to_json({'text': text}) AS VARCHAR))) AS n FROM documents)
SELECT doc_id, n > 4096 AS truncated, CASE WHEN n > 4096 THEN n ELSE 0 END AS bytes,
    CASE WHEN n > 4096 THEN '' ELSE CAST(j AS VARCHAR) END AS kept FROM j""")
def clipped_log_fields(t):
    # a limit of 4 KiB, so both outcomes occur in the test tables
    clipped = L.clip_json(F.to_json(F.struct("text")), 4096)
    out = t.documents.select("doc_id", clipped.alias("j")).withColumn(
        "truncated", F.coalesce(F.get_json_object("j", "$.truncated") == "true", F.lit(False))
    )
    return out.select(
        "doc_id", "truncated",
        F.when(F.col("truncated"), F.get_json_object("j", "$.bytes").cast("long")).otherwise(F.lit(0).cast("long")).alias("bytes"),
        F.when(F.col("truncated"), "").otherwise(F.col("j")).alias("kept"),
    )


@query("doc_summaries", "F22", """
SELECT conv_id, turn, trim(split_part(trim(text), chr(10), 1)) AS summary,
    CASE WHEN contains(trim(text), chr(10)) THEN trim(text) ELSE '' END AS block FROM conversations""")
def doc_summaries(t):
    return t.raw("conversations").select(
        "conv_id", "turn", X.doc_summary(F.col("text")).alias("summary"), X.doc_block(F.col("text")).alias("block")
    )


@query("diff_paths", "F20 U1", with_views("v_changes", """
SELECT CAST(change_id AS VARCHAR) AS change_id, string_agg(path, ',' ORDER BY path) AS paths FROM v_changes GROUP BY change_id"""))
def diff_paths(t):
    line = F.concat(
        F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- /dev/null\n+++ b/"), "path",
        F.lit("\tnow\n@@ -0,0 +1 @@\n+line"),
    )
    diffs = t.changes.groupBy("change_id").agg(F.array_join(F.collect_list(line), "\n").alias("diff"))
    return diffs.select(
        F.col("change_id").cast("string").alias("change_id"),
        F.array_join(F.array_sort(P.diff_paths(F.col("diff"))), ",").alias("paths"),
    )


@query("path_lists", "F21 U1", """
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,\\r\\n]'),
    lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '|') AS items FROM documents""")
def path_lists(t):
    return t.documents.select("doc_id", F.array_join(P.split_path_list(F.col("text")), "|").alias("items"))


@query("log_fields", "F27 F28", """
SELECT event_id, 'rec_' || json_extract_string(props, '$.k') AS id, event_type AS status, event_type AS command,
    epoch_us(date_trunc('second', ts)) AS at_us, event_type = 'error' AS failed FROM events""")
def log_fields(t):
    ident = F.concat(F.lit("rec_"), F.get_json_object("props", "$.k"))
    upper = F.to_json(F.struct(F.struct(ident.alias("ID"), F.col("event_type").alias("Status")).alias("Record")))
    lower = F.to_json(F.struct(ident.alias("id"), F.col("event_type").alias("status")))
    raw = F.when(F.col("event_id") % 2 == 0, upper).otherwise(lower)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    flag = F.when(F.col("event_type") == "error", '{"due": "TRUE"}').otherwise('{"flags": {"due": false}}')
    e = t.raw("events").select("event_id", "event_type", raw.alias("raw"), stamp.alias("stamp"), flag.alias("flag"))
    hit = L.record_fields(F.try_parse_json("raw"))
    return e.select(
        "event_id", hit["id"].alias("id"), hit["status"].alias("status"),
        L.base_command(F.concat(F.lit("shelf "), "event_type")).alias("command"),
        F.unix_micros(L.log_time(F.col("stamp"))).alias("at_us"),
        L.due_only(F.try_parse_json("flag")).alias("failed"),
    )


@query("citation_checks", "F29", """
SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''
    AND NOT regexp_matches(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[\\r\\n]') AS ok FROM conversations""")
def citation_checks(t):
    return t.raw("conversations").select("conv_id", "turn", L.valid_effect(F.col("text")).alias("ok"))


@query("link_targets", "F30", with_views("v_links", """
SELECT kind, from_id, to_id AS given, to_root, CASE WHEN kind = 'repo' THEN '' ELSE to_id END AS to_id FROM v_links"""))
def link_targets(t):
    value = F.when(F.col("kind") == "repo", F.col("to_root")).otherwise(F.concat("to_root", F.lit("#"), "to_id"))
    target = L.link_target(F.col("kind"), value)
    return t.links.select("kind", "from_id", F.col("to_id").alias("given"), target.alias("t")).select(
        "kind", "from_id", "given", "t.to_root", "t.to_id"
    )


@query("review_clock_text", "F28", f"SELECT event_id, ts <= TIMESTAMP '{NOW}' AS past FROM events")
def review_clock_text(t):
    now = L.log_time(F.lit(NOW.replace(" ", "T") + "Z"))
    return t.raw("events").select("event_id", (F.col("ts") <= now).alias("past"))
