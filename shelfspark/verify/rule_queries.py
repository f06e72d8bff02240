"""Queries and oracles: globs, ignore rules, checks, changes and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls, changes, globs, ignore, links, review
from ..session import stored
from .adapters import glob_sql, with_views
from .registry import query

OWNED_SQL = f"""owned AS (SELECT *, unnest(applies_to) AS pattern FROM v_current),
pattern_hits AS (SELECT p.pattern, s.file_path, s.seq FROM (SELECT DISTINCT pattern FROM owned) p JOIN v_symbols s
    ON {glob_sql('s.file_path', 'p.pattern')})"""
START = "2024-01-01 00:00:00"
END = "2024-01-30 00:00:00"


def _paths(t):
    return t.symbols.select(F.col("file_path").alias("path"))


@query("records_matching_paths", "P5 J9", with_views("v_current v_symbols", OWNED_SQL + """
--
SELECT DISTINCT o.id AS record_id, s.file_path AS path FROM owned o JOIN pattern_hits s ON s.pattern = o.pattern"""))
def records_matching_paths(t):
    return globs.match_paths(review.current(t.records), _paths(t))


@query("rule_violations", "C7 P3 J9 F20", with_views("v_current v_changes", f"""
owned AS (SELECT id, checkout, severity, unnest(applies_to) AS pattern FROM v_current WHERE type = 'rule'),
hits AS (SELECT DISTINCT p.path, o.id, o.checkout, o.severity FROM owned o JOIN (SELECT DISTINCT path FROM v_changes) p ON {glob_sql('p.path', 'o.pattern')})
--
SELECT DISTINCT CAST(c.change_id AS VARCHAR) AS change_id, h.id AS record_id, 'applies_to' AS reason, h.severity,
    h.severity IN ('must', 'must-not') AS violation FROM v_changes c JOIN hits h ON h.path = c.path
WHERE h.checkout IN ('', 'src' || (c.change_id % 20))"""))
def rule_violations(t):
    from ..plans.check import check_change

    owner = F.concat(F.lit("src"), (F.col("change_id") % 20).cast("string"))
    return check_change(t.records, t.changes.withColumns({"checkout": owner, "change_id": F.col("change_id").cast("string")}))


@query("related_records", "J25", with_views("v_current v_changes", f"""
owned AS (SELECT id, checkout, unnest(applies_to) AS pattern FROM v_current WHERE type IN ('feature', 'decision')),
hits AS (SELECT DISTINCT p.path, o.id, o.checkout FROM owned o JOIN (SELECT DISTINCT path FROM v_changes) p ON {glob_sql('p.path', 'o.pattern')})
--
SELECT DISTINCT CAST(c.change_id AS VARCHAR) AS change_id, h.id AS record_id FROM v_changes c JOIN hits h ON h.path = c.path
WHERE h.checkout IN ('', CASE WHEN c.change_id % 2 = 0 THEN 'src1' ELSE 'src2' END)"""))
def related_records(t):
    placed = t.changes.select(
        F.col("change_id").cast("string").alias("change_id"),
        F.when(F.col("change_id") % 2 == 0, "src1").otherwise("src2").alias("checkout"), "path",
    )
    return review.related(t.records, placed).select("change_id", "record_id")


@query("stale_globs", "P15 P14 S7", with_views("v_current v_symbols", OWNED_SQL + """,
alive AS (SELECT DISTINCT o.id FROM owned o JOIN pattern_hits s ON s.pattern = o.pattern),
dirs AS (SELECT DISTINCT brand AS dir FROM v_symbols)
--
SELECT DISTINCT o.id, o.title, o.type, o.scope FROM owned o WHERE o.id NOT IN (SELECT id FROM alive) AND (
    (o.scope = 'repo' AND o.checkout = '') OR (o.scope <> 'repo' AND contains(o.pattern, '/')
        AND split_part(o.pattern, '/', 1) IN (SELECT dir FROM dirs)))"""))
def stale_globs(t):
    return review.stale_globs(t.records, t.files, review.top_dirs(t.files), "")


@query("feature_files", "J24", with_views("v_current v_symbols v_changes", OWNED_SQL + """,
hits AS (SELECT DISTINCT o.id, o.title, o.scope, s.file_path, s.seq FROM owned o JOIN pattern_hits s ON s.pattern = o.pattern
    WHERE o.type = 'feature'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_path) AS n FROM hits),
recent AS (SELECT DISTINCT path FROM v_changes WHERE changed_at >= TIMESTAMP '2001-06-01 00:00:00')
--
SELECT id AS record_id, any_value(title) AS title, any_value(scope) AS scope,
    string_agg(file_path, ',' ORDER BY file_path) FILTER (WHERE n <= 4) AS files,
    CAST(greatest(count(*) - 4, 0) AS BIGINT) AS omitted, bool_or(file_path IN (SELECT path FROM recent)) AS changed
FROM numbered GROUP BY id"""))
def feature_files(t):
    recent = changes.changed_paths(t.changes, F.lit("2001-06-01 00:00:00").cast("timestamp"))
    return review.feature_files(t.records, t.files, recent).withColumn("files", F.array_join("files", ","))


@query("changed_paths", "S10 U1", with_views("v_changes", """
SELECT DISTINCT path FROM v_changes WHERE changed_at >= TIMESTAMP '2001-06-01 00:00:00'
UNION SELECT p_brand || '/' || p_partkey FROM part WHERE p_size = 1"""))
def changed_paths(t):
    dirty = t.symbols.where("line = 1").select(F.col("file_path").alias("path"))
    return changes.changed_paths(t.changes, F.lit("2001-06-01 00:00:00").cast("timestamp"), dirty)


@query("change_sizes", "A10", with_views("v_changes", """
SELECT CAST(change_id AS VARCHAR) AS change_id, CAST(count(*) AS BIGINT) AS n_paths, count(*) > 5 AS wide FROM v_changes GROUP BY change_id"""))
def change_sizes(t):
    # no test change has more than 30 paths, so wide means more than 5 here
    return changes.change_sizes(t.changes, 5).select(F.col("change_id").cast("string").alias("change_id"), "n_paths", "wide")


# Changes placed in the month of the log: many share an hour, so ties are exercised.
COMMITS_SQL = f"""
moved AS (SELECT CAST(change_id AS VARCHAR) AS slice_id, path, TIMESTAMP '{START}' + to_hours(CAST(change_id % 720 AS INTEGER)) AS done FROM v_changes),
points AS (SELECT DISTINCT slice_id, done FROM moved WHERE done >= TIMESTAMP '2024-01-03 00:00:00'
    UNION ALL SELECT 'dirty', TIMESTAMP '{END}' WHERE (SELECT max(done) FROM moved) < TIMESTAMP '{END}'),
slices AS (SELECT slice_id, done, lag(done) OVER (ORDER BY done, slice_id) AS prev FROM points),
bounds AS (SELECT slice_id, coalesce(prev, TIMESTAMP '2024-01-03 00:00:00') AS lo, done AS hi, prev IS NULL OR prev = done AS closed FROM slices)"""


def _moved(t):
    at = F.lit(START).cast("timestamp") + F.make_dt_interval(hours=(F.col("change_id") % 720).cast("int"))
    return t.changes.select("checkout", F.col("change_id").cast("string").alias("change_id"), at.alias("at"), "path")


def _slices(t, moved):
    dirty = _paths(t).select(F.lit("").alias("checkout"), "path")
    bounds = [F.lit(x).cast("timestamp") for x in ("2024-01-03 00:00:00", END)]
    return changes.change_slices(moved, *bounds, dirty), dirty


@query("change_slices", "N9", with_views("v_changes", COMMITS_SQL + """
--
SELECT slice_id, epoch_us(lo) AS after_us, epoch_us(hi) AS until_us, closed FROM bounds"""))
def change_slices(t):
    return _slices(t, stored(_moved(t), "moved"))[0].select(
        "slice_id", F.unix_micros("after").alias("after_us"), F.unix_micros("until").alias("until_us"), "closed"
    )


MISSED_SQL = COMMITS_SQL + f""",
paths AS (SELECT slice_id, path FROM moved UNION SELECT 'dirty', path FROM (SELECT p_brand || '/' || p_partkey AS path FROM part)),
sized AS (SELECT b.*, n FROM bounds b JOIN (SELECT slice_id, count(DISTINCT path) AS n FROM paths GROUP BY slice_id) p USING (slice_id)),
narrow AS (SELECT * FROM sized WHERE n <= 5),
used AS (SELECT DISTINCT hit_id AS id, called_at FROM v_calls WHERE name IN ('get', 'check', 'cite')),
owned AS (SELECT id, unnest(applies_to) AS pattern FROM v_current WHERE type = 'rule' AND checkout = ''),
rule_paths AS (SELECT DISTINCT o.id, p.path FROM owned o JOIN (SELECT DISTINCT path FROM paths) p ON {glob_sql('p.path', 'o.pattern')}),
governed AS (SELECT DISTINCT n.slice_id, n.lo, n.hi, n.closed, r.id FROM narrow n JOIN paths p USING (slice_id) JOIN rule_paths r ON r.path = p.path)"""


def _uses(t):
    return t.calls.where("name IN ('get', 'check', 'cite')").select(
        F.lit("").alias("checkout"), "at", F.col("hit_id").alias("id")
    )


def _missed(t):
    moved = stored(_moved(t), "moved")  # read by several jobs
    slices, dirty = _slices(t, moved)
    paths = moved.select("checkout", F.col("change_id").alias("slice_id"), "path").unionByName(
        dirty.withColumn("slice_id", F.lit("dirty"))
    )
    return changes.missed_by_slice(_uses(t), slices, paths, t.records, max_paths=5)


@query("missed_rules_by_slice", "J22 J21 A10", with_views("v_current v_changes v_calls", MISSED_SQL + """
--
SELECT DISTINCT g.id AS record_id FROM governed g WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.id = g.id
    AND (u.called_at > g.lo OR (g.closed AND u.called_at >= g.lo)) AND u.called_at <= g.hi)"""))
def missed_rules_by_slice(t):
    return _missed(t)[0].select("record_id")


@query("wide_slices", "J22 A10", with_views("v_current v_changes v_calls", MISSED_SQL + """
--
SELECT slice_id, CAST(n AS BIGINT) AS n_paths FROM sized WHERE n > 5"""))
def wide_slices(t):
    return _missed(t)[1].select("slice_id", "n_paths")


@query("missed_rules", "J21", with_views("v_current v_changes v_calls", f"""
owned AS (SELECT id, checkout, unnest(applies_to) AS pattern FROM v_current WHERE type = 'rule'),
rule_paths AS (SELECT DISTINCT o.id, o.checkout, p.path FROM owned o JOIN (SELECT DISTINCT path FROM v_changes) p ON {glob_sql('p.path', 'o.pattern')}),
placed AS (SELECT DISTINCT CAST(change_id % 150 AS VARCHAR) AS checkout, path FROM v_changes)
--
SELECT DISTINCT t.checkout, h.id AS record_id FROM placed t JOIN rule_paths h ON h.path = t.path AND h.checkout IN ('', t.checkout)
WHERE NOT EXISTS (SELECT 1 FROM v_calls c WHERE c.checkout = t.checkout AND c.hit_id = h.id AND c.name <> 'remember')"""))
def missed_rules(t):
    used = t.calls.where("name <> 'remember'").select("checkout", F.col("hit_id").alias("id"))
    placed = t.changes.select((F.col("change_id") % 150).cast("string").alias("checkout"), "path").distinct()
    return changes.missed_rules(used, t.records, placed)


@query("consulted_overlap", "J20", with_views("v_records v_changes v_calls", f"""
seen AS (SELECT checkout, hit_id AS key FROM v_calls WHERE name IN ('search', 'get') GROUP BY ALL),
recent AS (SELECT DISTINCT path FROM v_changes WHERE changed_at >= TIMESTAMP '2001-06-01 00:00:00'),
alive AS (SELECT DISTINCT o.id FROM (SELECT id, unnest(applies_to) AS pattern FROM v_records WHERE doc_id % 8 <> 0) o
    JOIN recent p ON {glob_sql('p.path', 'o.pattern')}),
known AS (SELECT * FROM v_records WHERE doc_id % 8 <> 0)
--
SELECT s.checkout, s.key AS id, coalesce(k.title, '') AS title, CASE WHEN k.id IS NULL OR len(k.applies_to) = 0 THEN 'no_glob' ELSE 'overlap' END AS class
FROM seen s LEFT JOIN known k ON k.id = s.key WHERE k.id IS NULL OR len(k.applies_to) = 0 OR k.id IN (SELECT id FROM alive)"""))
def consulted_overlap(t):
    used = t.calls.where("name IN ('search', 'get')").select(
        "checkout", "seq", F.lit(0).alias("pos"), F.col("hit_id").alias("id"), F.lit("").alias("title"),
        F.array().cast("array<string>").alias("applies_to"),
    )
    known = t.records.where(F.regexp_extract("id", r"(\d+)", 1).cast("long") % 8 != 0)
    recent = changes.changed_paths(t.changes, F.lit("2001-06-01 00:00:00").cast("timestamp"))
    return changes.overlap(calls.consulted(used), known, recent)


IGNORE_LINES = """
SELECT '' AS dir, n_nationkey * 4 AS line_no, '/Brand#' || n_nationkey || '/*' || (n_nationkey % 7) AS line FROM nation
UNION ALL SELECT '', n_nationkey * 4 + 1, '*' || (n_nationkey + 10) FROM nation
UNION ALL SELECT '', n_nationkey * 4 + 2, '!*' || (n_nationkey * 3) FROM nation
UNION ALL SELECT '', 1000, 'Brand#9/'
UNION ALL SELECT 'Brand#' || n_nationkey, 0, '!?' || (n_nationkey % 10) FROM nation"""


@query("ignored_paths", "P6", with_views("v_symbols", f"""
lines AS ({IGNORE_LINES}),
rules AS (SELECT dir, line_no, starts_with(line, '!') AS negate, line LIKE '%/' AS dir_only,
    CASE WHEN line LIKE '%/' THEN '^(?:.+/)?' || rtrim(line, '/') WHEN starts_with(line, '/') THEN '^' || replace(replace(ltrim(line, '/'), '*', '[^/]*'), '?', '[^/]')
        ELSE '^(?:.+/)?' || replace(replace(ltrim(line, '!'), '*', '[^/]*'), '?', '[^/]') END || '(?:/.*)?$' AS regex FROM lines),
met AS (SELECT s.file_path AS path, arg_max(r.negate, (CASE WHEN r.dir = '' THEN 0 ELSE 1 END) * 100000 + r.line_no) AS negate
    FROM v_symbols s JOIN rules r ON r.dir = '' OR r.dir = s.brand
    WHERE regexp_matches(CASE WHEN r.dir_only THEN s.brand WHEN r.dir = '' THEN s.file_path ELSE split_part(s.file_path, '/', 2) END, r.regex)
    GROUP BY s.file_path),
dirs AS (SELECT DISTINCT s.brand, arg_max(r.negate, r.line_no) AS negate FROM (SELECT DISTINCT brand FROM v_symbols) s
    JOIN rules r ON r.dir = '' AND regexp_matches(s.brand, r.regex) GROUP BY s.brand)
--
SELECT s.file_path AS path, coalesce(NOT m.negate, false) OR coalesce(NOT d.negate, false) AS ignored FROM v_symbols s
LEFT JOIN met m ON m.path = s.file_path LEFT JOIN dirs d ON d.brand = s.brand"""))
def ignored_paths(t):
    n = F.col("n_nationkey")
    text = n.cast("string")

    def rule(folder, line_no, line):
        return F.struct(folder.alias("dir"), line_no.cast("int").alias("line_no"), line.alias("line"))

    root = F.lit("")
    rules = F.array(
        rule(root, n * 4, F.concat(F.lit("/Brand#"), text, F.lit("/*"), (n % 7).cast("string"))),
        rule(root, n * 4 + 1, F.concat(F.lit("*"), (n + 10).cast("string"))),
        rule(root, n * 4 + 2, F.concat(F.lit("!*"), (n * 3).cast("string"))),
        rule(root, F.lit(1000), F.lit("Brand#9/")),
        rule(F.concat(F.lit("Brand#"), text), F.lit(0), F.concat(F.lit("!?"), (n % 10).cast("string"))),
    )
    lines = t.raw("nation").select(F.inline(rules)).distinct()
    return ignore.ignored(_paths(t), lines)


@query("indexable_pages", "P7 S7", with_views("v_pages", """
SELECT DISTINCT path FROM v_pages WHERE NOT starts_with(path, 'fr/') AND NOT regexp_matches(path, '^de/[^/]*5$')"""))
def indexable_pages(t):
    # French pages are export copies, German ones ending in 5 fall to a skip glob; no ignore file
    none = t.spark.createDataFrame([], "dir string, line_no int, line string")
    skip = t.raw("nation").select(F.concat(F.lit("de/*"), (F.col("n_nationkey") * 0 + 5).cast("string")).alias("pattern"))
    return ignore.indexable(t.pages, none, skip, export_dir="fr")


@query("listed_links", "J16", with_views("v_links", "SELECT * FROM v_links WHERE from_checkout = 'BUILDING'"))
def listed_links(t):
    return links.list_links(t.links, "BUILDING")


@query("links_of_records", "J15 P16", with_views("v_records v_links", """
SELECT l.kind, l.from_id, l.to_root, l.to_id, coalesce(r.title, '') AS title,
    CASE WHEN l.kind = 'record' AND r.id IS NULL THEN 'record links: record ' || l.to_id || ' not found' ELSE '' END AS missing
FROM v_links l LEFT JOIN v_records r ON r.id = l.to_id
WHERE l.kind IN ('record', 'repo') AND l.from_id IN (SELECT id FROM v_records)"""))
def links_of_records(t):
    found = links.links_of(t.records.select("id"), t.links, t.records)
    return found.select(
        "kind", "from_id", "to_root", "to_id", F.coalesce("record.title", F.lit("")).alias("title"),
        F.coalesce("missing", F.lit("")).alias("missing"),
    )


@query("followed_links", "J12 J13", with_views("v_records v_links", """
asked AS (SELECT item_id AS query_id, ['', 'BUILDING', 'MACHINERY'][1 + item_id % 3] AS checkout FROM benchmark),
hits AS (SELECT a.query_id, 'rec_' || (a.query_id * 3 + k) AS from_id FROM asked a, (SELECT unnest(range(30)) AS k)),
followed AS (SELECT a.query_id, l.* FROM asked a JOIN v_links l ON l.kind = 'pin' AND a.checkout <> '' AND l.from_checkout IN ('', a.checkout)
    UNION ALL SELECT a.query_id, l.* FROM asked a JOIN hits h ON h.query_id = a.query_id JOIN v_links l ON l.kind = 'record' AND l.from_id = h.from_id
        AND (a.checkout = '' OR l.from_checkout IN ('', a.checkout)))
--
SELECT f.query_id, f.kind, f.from_id, f.to_id, f.to_root, f.from_checkout, coalesce(r.slug, '') AS slug, r.id IS NULL AS missing
FROM followed f LEFT JOIN v_records r ON r.id = f.to_id"""))
def followed_links(t):
    asked = t.raw("benchmark").select(
        F.col("item_id").alias("query_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("", "BUILDING", "MACHINERY")]), (F.col("item_id") % 3 + 1).cast("int")).alias("checkout"),
    )
    hits = asked.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k")).select(
        "query_id", F.concat(F.lit("rec_"), (F.col("query_id") * 3 + F.col("k")).cast("string")).alias("record_id")
    )
    found = links.follow_records(hits, t.links, asked, t.records)
    return found.select(
        "query_id", "kind", "from_id", "to_id", "to_root", "from_checkout", F.coalesce("record.slug", F.lit("")).alias("slug"),
        F.col("missing").isNotNull().alias("missing"),
    )


@query("link_violations", "J27", with_views("v_records v_links", """
SELECT l.*, array_to_string(list_filter([
    CASE WHEN from_checkout = to_root THEN 'checkout cannot link to itself' END,
    CASE WHEN kind <> 'pin' AND f.id IS NULL THEN 'from record not found' END,
    CASE WHEN kind <> 'repo' AND g.id IS NULL THEN 'target record not found' END], lambda x: x IS NOT NULL), '; ') AS problems
FROM v_links l LEFT JOIN v_records f ON f.id = l.from_id LEFT JOIN v_records g ON g.id = l.to_id"""))
def link_violations(t):
    checked = links.validate_links(t.links, t.records)
    return checked.withColumn("problems", F.array_join("violations", "; ")).drop("violations")


@query("scope_and_dirs", "S7 P9", with_views("v_pages", """
SELECT DISTINCT split_part(path, '/', 1) AS dir FROM v_pages WHERE contains(path, '/')"""))
def scope_and_dirs(t):
    return review.top_dirs(t.pages)


