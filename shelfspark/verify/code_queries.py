"""Queries and oracles: code exploration, extraction, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import code, extract
from ..operators.substring_index import open_substrings
from ..session import new_folder
from ..sources import exports
from .adapters import STOP_SQL, WORD_SQL, ascii_sql, contains_sql, with_views
from .registry import ORACLES, query

# Every distinct part name with its kind is a query; every other one gets a word
# that matches nothing, so the two-thirds retry runs too.
ASKED_SQL = f"""
names AS (SELECT p_name, p_type, min(p_partkey) AS query_id FROM part GROUP BY ALL),
asked AS (SELECT query_id, p_name || ' ' || p_type || CASE WHEN query_id % 2 = 1 THEN ' zzz' ELSE '' END AS text FROM names),
words AS (SELECT query_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, {WORD_SQL}), lambda x: lower(x)),
    lambda x: NOT list_contains({STOP_SQL}, x))) AS terms FROM asked),
terms AS (SELECT query_id, len(terms) AS n, CASE WHEN len(terms) <= 2 THEN len(terms) ELSE (2 * len(terms) + 2) // 3 END AS need, unnest(terms) AS term FROM words)"""


def _asked(t, checkout="main"):
    names = t.raw("part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("query_id"))
    text = F.concat("p_name", F.lit(" "), "p_type", F.when(F.col("query_id") % 2 == 1, " zzz").otherwise(""))
    return names.select("query_id", F.lit(checkout).alias("checkout"), text.alias("text"))


SYMBOL_SQL = ASKED_SQL + f""",
met AS (SELECT q.term, s.file_path, s.seq, s.line, s.exported, {contains_sql('s.name', 'q.term')} AS in_name,
    {contains_sql('s.doc', 'q.term')} AS in_doc FROM (SELECT DISTINCT term FROM terms) q JOIN v_symbols s ON {contains_sql('s.name', 'q.term')} OR {contains_sql('s.doc', 'q.term')}
    OR {contains_sql('s.file_path', 'q.term')} OR {contains_sql('s.package_name', 'q.term')}),
hit AS (SELECT q.query_id, q.n, q.need, m.* FROM terms q JOIN met m ON m.term = q.term),
scored AS (SELECT query_id, n, need, file_path, seq, line, exported, count(*) AS k, sum(in_name::INT) AS name_hits, sum(in_doc::INT) AS doc_hits FROM hit GROUP BY ALL),
classed AS (SELECT *, CASE WHEN k >= n THEN 0 WHEN need < n AND k >= need THEN 1 END AS class FROM scored),
best AS (SELECT * FROM classed QUALIFY class = min(class) OVER (PARTITION BY query_id)),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name_hits DESC, exported DESC, doc_hits DESC, file_path, line, seq) AS rank FROM best
    QUALIFY rank <= 30)"""


@query("symbol_search", "C8 J6 T5 T7 P11", with_views("v_symbols", SYMBOL_SQL + """
--
SELECT query_id, file_path, seq, CAST(name_hits AS BIGINT) AS name_hits, CAST(doc_hits AS BIGINT) AS doc_hits, CAST(rank AS INTEGER) AS rank FROM found"""))
def symbol_search(t):
    return code.search_symbols(t.symbols, t.files, _asked(t)).select("query_id", "file_path", "seq", "name_hits", "doc_hits", "rank")


@query("stored_symbol_search", "C8 J6 T5 T7 P11", ORACLES["symbol_search"])
def stored_symbol_search(t):
    path = new_folder(t.spark, "symbol-index")
    code.write_symbol_index(t.symbols, t.files, path)
    found = code.search_symbols(open_substrings(t.spark, path), None, _asked(t))
    return found.select("query_id", "file_path", "seq", "name_hits", "doc_hits", "rank")


COMMIT_ASKED_SQL = f"""
names AS (SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders),
asked AS (SELECT s || ' ' || p AS query_id, s AS checkout, CASE WHEN p < '3' THEN 'the ' || p ELSE 'find the ' || p END AS text FROM names),
words AS (SELECT query_id, checkout, list_distinct(list_filter(list_transform(regexp_extract_all(text, {WORD_SQL}), lambda x: lower(x)),
    lambda x: NOT list_contains({STOP_SQL}, x))) AS terms FROM asked),
terms AS (SELECT query_id, checkout, len(terms) AS n, CASE WHEN len(terms) <= 2 THEN len(terms) ELSE (2 * len(terms) + 2) // 3 END AS need, unnest(terms) AS term FROM words),
hit AS (SELECT q.query_id, q.n, q.need, c.hash, c.authored_at FROM terms q JOIN v_commits c ON c.checkout = q.checkout AND ({contains_sql('c.subject', 'q.term')} OR {contains_sql('c.body', 'q.term')})),
classed AS (SELECT query_id, hash, authored_at, CASE WHEN count(*) >= any_value(n) THEN 0 WHEN any_value(need) < any_value(n) AND count(*) >= any_value(need) THEN 1 END AS class
    FROM hit GROUP BY query_id, hash, authored_at),
best AS (SELECT * FROM classed QUALIFY class = min(class) OVER (PARTITION BY query_id))"""


@query("commit_search", "C9 T6 T7 F5", with_views("v_commits", COMMIT_ASKED_SQL + """
--
SELECT query_id, hash, CAST(row_number() OVER (PARTITION BY query_id ORDER BY authored_at DESC, hash) AS INTEGER) AS rank FROM best QUALIFY rank <= 30"""))
def commit_search(t):
    return code.search_commits(t.commits, _commits_asked(t)).select("query_id", "hash", "rank")


def _commits_asked(t):
    p = F.col("o_orderpriority")
    return t.raw("orders").select("o_orderstatus", p).distinct().select(
        F.concat_ws(" ", "o_orderstatus", p).alias("query_id"), F.col("o_orderstatus").alias("checkout"), F.concat(F.when(p < "3", "the ").otherwise("find the "), p).alias("text")
    )


@query("stored_commit_search", "C9 T6 T7 F5", with_views("v_commits", COMMIT_ASKED_SQL + """,
found AS (SELECT query_id, hash, row_number() OVER (PARTITION BY query_id ORDER BY authored_at DESC, hash) AS rank FROM best QUALIFY rank <= 30)
--
SELECT f.query_id, f.hash, c.subject, c.body, CAST(f.rank AS INTEGER) AS rank FROM found f JOIN v_commits c ON c.hash = f.hash"""))
def stored_commit_search(t):
    path = new_folder(t.spark, "commit-index")
    code.write_commit_index(t.commits, path)
    return code.search_commits(open_substrings(t.spark, path), _commits_asked(t)).select("query_id", "hash", "subject", "body", "rank")


# Files of a query: pages by language folder and last digit.
PAGE_FILES_SQL = "page_files AS (SELECT DISTINCT 'q' || (page_id % 20) AS query_id, path FROM v_pages)"


def _page_files(t):
    return t.pages.select(
        F.concat(F.lit("q"), (F.col("page_id") % 20).cast("string")).alias("query_id"), F.lit("web").alias("checkout"),
        F.col("path").alias("file_path"),
    ).distinct()


@query("imports_of_files", "J7 T7", with_views("v_pages v_edges", PAGE_FILES_SQL + """,
e AS (SELECT DISTINCT f.query_id, e.* FROM page_files f JOIN v_edges e ON e.from_file = f.path)
--
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY from_file, to_path, edge_type) AS INTEGER) AS rank FROM e QUALIFY rank <= 30"""))
def imports_of_files(t):
    return code.imports_of(t.edges, _page_files(t))


# Every linked word is also a file, so importers have something to find.
WORD_FILES_SQL = """
word_files AS (SELECT DISTINCT substr(to_path, 1, 2) AS query_id, to_path AS path FROM (SELECT 'lib' || to_path AS to_path FROM v_edges) UNION
    SELECT DISTINCT 'U' || substr(to_path, 1, 3), ltrim(to_path, '/') || '.js' FROM v_edges)"""


def _word_files(t):
    lib = t.edges.select(F.concat(F.lit("lib"), "to_path").alias("f"))
    a = lib.select(F.substr("f", F.lit(1), F.lit(2)).alias("query_id"), F.col("f").alias("file_path"))
    b = t.edges.select(
        F.concat(F.lit("U"), F.substr("to_path", F.lit(1), F.lit(3))).alias("query_id"),
        F.concat(F.regexp_replace("to_path", "^/+", ""), F.lit(".js")).alias("file_path"),
    )
    return a.unionByName(b).distinct().withColumn("checkout", F.lit("web"))


IMPORTER_SQL = WORD_FILES_SQL + """,
keys AS (SELECT DISTINCT query_id, unnest([regexp_replace(path, '/?[^/]*$', ''), path,
    CASE WHEN regexp_matches(path, '\\.[^./]*$') THEN regexp_replace(path, '\\.[^./]*$', '') ELSE '' END]) AS key FROM word_files),
by_file AS (SELECT DISTINCT k.query_id, e.* FROM v_edges e JOIN keys k ON k.key NOT IN ('', '.') AND (e.to_path = k.key
    OR ends_with(translate(e.to_path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/' || translate(k.key, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY from_file, to_path, edge_type) AS rank FROM by_file QUALIFY rank <= 30)"""


@query("importers_of_files", "J8 T7", with_views("v_edges", IMPORTER_SQL + """
--
SELECT query_id, from_file, to_path, edge_type, CAST(rank AS INTEGER) AS rank FROM capped"""))
def importers_of_files(t):
    return code.importers_of(t.edges, _word_files(t))


QUERY_IMPORT_SQL = IMPORTER_SQL + f""",
texts AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(query_id), {WORD_SQL}), lambda x: NOT list_contains({STOP_SQL}, x))) AS found
    FROM (SELECT DISTINCT query_id FROM word_files)),
asked AS (SELECT query_id, CASE WHEN len(found) = 0 THEN [trim(query_id)] ELSE found END AS terms FROM texts),
targets AS (SELECT *, {ascii_sql('to_path')} AS folded FROM (SELECT DISTINCT * FROM v_edges)),
by_query AS (SELECT q.query_id, e.* EXCLUDE (folded) FROM asked q JOIN targets e
    ON len(list_filter(q.terms, lambda x: NOT contains(e.folded, {ascii_sql('x')}))) = 0),
capped2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY from_file, to_path, edge_type) AS rank FROM by_query QUALIFY rank <= 30),
merged AS (SELECT query_id, from_file, to_path, edge_type, min(src) AS src FROM (SELECT *, 0 AS src FROM capped UNION ALL SELECT *, 1 FROM capped2) GROUP BY ALL)"""


@query("merged_importers", "J10 J11 J8", with_views("v_edges", QUERY_IMPORT_SQL + """
--
SELECT query_id, from_file, to_path, edge_type, CAST(row_number() OVER (PARTITION BY query_id ORDER BY src, from_file, to_path, edge_type) AS INTEGER) AS rank
FROM merged QUALIFY rank <= 30"""))
def merged_importers(t):
    files = _word_files(t)
    asked = files.select("query_id", "checkout", F.col("query_id").alias("text")).distinct()
    return code.importers_of(t.edges, files, asked)


@query("stored_merged_importers", "J10 J11 J8", ORACLES["merged_importers"])
def stored_merged_importers(t):
    path = new_folder(t.spark, "edge-index")
    code.write_edge_index(t.edges, path)
    files = _word_files(t)
    asked = files.select("query_id", "checkout", F.col("query_id").alias("text")).distinct()
    return code.importers_of(t.edges, files, asked, index=open_substrings(t.spark, path))


CODE_SQL = """
src AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS line FROM src),
made AS (SELECT doc_id, line, CASE line % 5 WHEN 0 THEN 'pub fn ' || raw WHEN 1 THEN '  export class ' || raw WHEN 2 THEN 'import ''' || raw
    WHEN 3 THEN '# type ' || raw ELSE raw END AS raw FROM lines),
t AS (SELECT doc_id, line, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s FROM made)"""


def _code_files(t):
    at = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when((i + 1) % 5 == 0, F.concat(F.lit("pub fn "), x)).when((i + 1) % 5 == 1, F.concat(F.lit("  export class "), x))
        .when((i + 1) % 5 == 2, F.concat(F.lit("import '"), x)).when((i + 1) % 5 == 3, F.concat(F.lit("# type "), x)).otherwise(x),
    )
    return t.documents.select(
        F.lit("").alias("checkout"), F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".zig")).alias("path"),
        F.array_join(at, "\n").alias("content"),
    )


DECL_SQL = "'" + extract.DECLARATION.replace("'", "''") + "'"
STOP_NAME_SQL = "(" + ", ".join(f"'{n}'" for n in C.DECLARATION_STOP_NAMES) + ")"
FUNCTION_SQL = "(" + ", ".join(f"'{n}'" for n in C.FUNCTION_KEYWORDS) + ")"


@query("extracted_symbols", "F23 G2", with_views("", CODE_SQL + f"""
--
SELECT 'src/' || doc_id || '.zig' AS file_path, CAST(line AS INTEGER) AS line, regexp_extract(s, {DECL_SQL}, 2) AS name,
    CASE WHEN lower(regexp_extract(s, {DECL_SQL}, 1)) IN {FUNCTION_SQL} THEN 'function' ELSE lower(regexp_extract(s, {DECL_SQL}, 1)) END AS kind,
    regexp_matches(lower(s), '^(export|pub|public) ') OR regexp_matches(regexp_extract(s, {DECL_SQL}, 2), '^[A-Z]') AS exported
FROM t WHERE regexp_extract(s, {DECL_SQL}, 2) <> '' AND NOT regexp_matches(s, '^(//|#|/\\*|\\*|--)')
    AND lower(regexp_extract(s, {DECL_SQL}, 2)) NOT IN {STOP_NAME_SQL}"""))
def extracted_symbols(t):
    return extract.extract(_code_files(t))[0].select("file_path", "line", "name", "kind", "exported")


IMPORT_SQL = "'" + C.IMPORT_PATTERN + "'"


@query("extracted_imports", "F24", with_views("", CODE_SQL + f"""
--
SELECT 'src/' || doc_id || '.zig' AS from_file, trim(regexp_extract(s, {IMPORT_SQL}, 1), '"''`') AS to_path FROM t
WHERE regexp_matches(s, {IMPORT_SQL}) AND regexp_extract(s, {DECL_SQL}, 2) = '' AND NOT regexp_matches(s, '^(//|#|/\\*|\\*|--)')"""))
def extracted_imports(t):
    return extract.extract(_code_files(t))[1].select("from_file", "to_path")


@query("extracted_docs", "N10 F22")
def extracted_docs(t):
    return extract.extract(_code_files(t))[0].select("file_path", "line", "name", "doc")


@query("archive_catalog", "K2 F19 P16", with_views("v_records", """
SELECT CASE type WHEN 'rule' THEN 1 WHEN 'decision' THEN 2 WHEN 'feature' THEN 3 WHEN 'guide' THEN 4 WHEN 'map' THEN 5 ELSE 6 END AS type_rank,
    '- [' || title || '](records/' || scope || '/' || type || '/' || slug || '.md) (' || status || ')' || CASE WHEN severity IS NULL THEN '' ELSE ' [' || severity || ']' END AS line
FROM v_records"""))
def archive_catalog(t):
    return exports.catalog(t.records).select("type_rank", "line")


@query("type_digests", "K3", with_views("v_records", """
SELECT CASE type WHEN 'map' THEN 'maps.md' ELSE type || 's.md' END AS file, '## ' || title || chr(10) || chr(10) || '- Status: ' || status || chr(10) || '- Scope: ' || scope || chr(10)
    || CASE WHEN severity IS NULL THEN '' ELSE '- Severity: ' || severity || chr(10) END
    || CASE WHEN len(applies_to) = 0 THEN '' ELSE '- Applies to: ' || array_to_string(applies_to, ', ') || chr(10) END
    || '- Tags: ' || array_to_string(tags, ', ') || chr(10) || chr(10) || body || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS text
FROM v_records
UNION ALL SELECT s || '.md', '# ' || upper(s[1]) || substr(s, 2) || chr(10) || chr(10) FROM (
    SELECT unnest(['rules', 'decisions', 'features', 'guides', 'maps', 'pitfalls']) AS s)"""))
def type_digests(t):
    return exports.type_digest(t.records).select("file", "text")


@query("map_digest", "K4", with_views("v_symbols", """
SELECT brand AS file_path, '- `' || name || '` (' || kind || ') line ' || line AS text FROM v_symbols
UNION ALL SELECT DISTINCT brand, '## ' || brand FROM v_symbols"""))
def map_digest(t):
    return exports.map_digest(t.brand_symbols).select("file_path", "text")


@query("archive_manifest", "K5", with_views("v_records", """
SELECT id, slug, type, scope, title, status, coalesce(severity, '') AS severity, source_path, array_to_string(tags, ',') AS tags,
    array_to_string(applies_to, ',') AS applies_to, len(applies_to) > 0 AS has_globs, content_hash FROM v_records"""))
def archive_manifest(t):
    entry = F.col("entry")
    fields = ["id", "slug", "type", "scope", "title", "status", "source_path", "content_hash"]
    m = exports.manifest(t.records)
    listed = F.from_json(entry, "tags array<string>, applies_to array<string>, severity string")
    return m.select(
        *[F.get_json_object(entry, f"$.{f}").alias(f) for f in fields], F.coalesce(listed["severity"], F.lit("")).alias("severity"),
        F.array_join(listed["tags"], ",").alias("tags"), F.coalesce(F.array_join(listed["applies_to"], ","), F.lit("")).alias("applies_to"),
        listed["applies_to"].isNotNull().alias("has_globs"),
    )


@query("exported_archive", "C15 K2 K3 K4 K5", with_views("v_records v_symbols", """
catalog AS (SELECT '- [' || title || '](records/' || scope || '/' || type || '/' || slug || '.md) (' || status || ')' || CASE WHEN severity IS NULL THEN '' ELSE ' [' || severity || ']' END AS text FROM v_records),
digest AS (SELECT '## ' || title || chr(10) || chr(10) || '- Status: ' || status || chr(10) || '- Scope: ' || scope || chr(10)
    || CASE WHEN severity IS NULL THEN '' ELSE '- Severity: ' || severity || chr(10) END
    || CASE WHEN len(applies_to) = 0 THEN '' ELSE '- Applies to: ' || array_to_string(applies_to, ', ') || chr(10) END
    || '- Tags: ' || array_to_string(tags, ', ') || chr(10) || chr(10) || body || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS text FROM v_records
    UNION ALL SELECT '# ' || upper(s[1]) || substr(s, 2) || chr(10) || chr(10) FROM (SELECT unnest(['rules', 'decisions', 'features', 'guides', 'maps', 'pitfalls']) AS s)),
map AS (SELECT '- `' || name || '` (' || kind || ') line ' || line AS text FROM v_symbols UNION ALL SELECT DISTINCT '## ' || brand FROM v_symbols)
--
SELECT section, text, CAST(count(*) AS BIGINT) AS n FROM (
    SELECT 'index' AS section, unnest(string_split(text, chr(10))) AS text FROM catalog
    UNION ALL SELECT 'digests', unnest(string_split(text, chr(10))) FROM digest
    UNION ALL SELECT 'map', unnest(string_split(text, chr(10))) FROM map
    UNION ALL SELECT 'manifest', id FROM v_records) GROUP BY section, text"""))
def exported_archive(t):
    """The files of an export, read back line by line."""
    path = new_folder(t.spark, "export")
    exports.export_archive(t.records, t.brand_symbols, path)

    def lines(name):
        return t.spark.read.option("lineSep", "\n").text(f"{path}/{name}").select(F.lit(name).alias("section"), F.col("value").alias("text"))

    ids = lines("manifest").withColumn("text", F.get_json_object("text", "$.id"))
    return lines("index").union(lines("digests")).union(lines("map")).union(ids).groupBy("section", "text").agg(F.count("*").alias("n"))


@query("serialized_records", "K1 S3 S5")
def serialized_records(t):
    from ..sources.documents import serialize

    return serialize(t.records).select("rel_path", "content")


@query("reparsed_records", "K1 S1 S2 S3 S4 S5", with_views("v_records", r"""
SELECT id, type, scope, status, coalesce(severity, '') AS severity, array_to_string(tags, ',') AS tags, array_to_string(applies_to, ',') AS applies_to,
    regexp_replace(body, '^\s+|\s+$', '', 'g') AS body, slug FROM v_records"""))
def reparsed_records(t):
    """Every record written as a document and parsed back."""
    from ..sources.documents import parse_documents, serialize

    docs = serialize(t.records).select(
        F.col("rel_path").alias("source_path"), "content", F.lit("repo").alias("fallback_scope"), F.lit("").alias("checkout")
    )
    return parse_documents(docs).select(
        "id", "type", "scope", "status", F.coalesce("severity", F.lit("")).alias("severity"), F.array_join("tags", ",").alias("tags"),
        F.array_join("applies_to", ",").alias("applies_to"), "body", "slug",
    )
