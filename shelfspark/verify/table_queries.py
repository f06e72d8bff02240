"""Queries and oracles: reads, set operations and snapshot writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import embedding, status, tables
from ..operators.links import EDGE
from ..session import new_folder
from ..sources import deltas
from .adapters import NOW, with_views
from .registry import query

LATER = "2024-03-01 00:00:00"


def _now():
    return F.lit(LATER).cast("timestamp")


def _doc():
    return F.regexp_extract("id", r"(\d+)", 1).cast("long")


def _card(df):
    """A snapshot as comparable columns."""
    return df.select(
        "id", "checkout", "slug", "title", "status", "source_path", F.coalesce("superseded_by", F.lit("")).alias("superseded_by"),
        F.unix_micros("created_at").alias("created_us"), (F.col("updated_at") == _now()).alias("touched"),
    )


CARD_SQL = (
    "id, checkout, slug, title, status, source_path, superseded_by, epoch_us(created_at) AS created_us, touched"
)


@query("resolve_records", "J1 J2 S12", with_views("v_records", """
keys AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'rec_' || c_custkey ELSE 'doc-' || (c_custkey % 70) END AS key FROM customer),
slugs AS (SELECT slug, min(id) AS id FROM v_records GROUP BY slug)
--
SELECT k.key, CASE WHEN r.id IS NOT NULL THEN 'id' ELSE 'slug' END AS found_by, coalesce(r.id, s.id) AS id
FROM keys k LEFT JOIN v_records r ON r.id = k.key LEFT JOIN slugs s ON s.slug = k.key
WHERE coalesce(r.id, s.id) IS NOT NULL"""))
def resolve_records(t):
    key = F.col("c_custkey")
    keys = t.raw("customer").select(
        F.when(key % 2 == 0, F.concat(F.lit("rec_"), key.cast("string")))
        .otherwise(F.concat(F.lit("doc-"), (key % 70).cast("string"))).alias("key")
    )
    return tables.get_records(t.records, keys)


@query("resolve_records_through_links", "J1 S15", with_views("v_records v_links", """
keys AS (SELECT DISTINCT 'rec_' || c_custkey AS key FROM customer),
src AS (SELECT doc_id, id, slug, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 5 = 0 THEN 'home' ELSE
    (CASE doc_id % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'FURNITURE' ELSE 'OTHER' END) END AS checkout FROM v_records),
edges AS (SELECT DISTINCT to_root FROM v_links WHERE from_checkout IN ('', 'home')),
found AS (SELECT k.key, 0 AS tier, 'id' AS found_by, s.id FROM keys k JOIN src s ON s.id = k.key AND s.checkout IN ('', 'home')
    UNION ALL SELECT k.key, 1, 'link', s.id FROM keys k JOIN src s ON s.id = k.key JOIN edges e ON e.to_root = s.checkout)
--
SELECT key, arg_min(found_by, tier) AS found_by, arg_min(id, tier) AS id FROM found GROUP BY key"""))
def resolve_records_through_links(t):
    doc = _doc()
    other = F.when(doc % 4 == 0, "BUILDING").when(doc % 4 == 1, "MACHINERY").when(doc % 4 == 2, "FURNITURE").otherwise("OTHER")
    placed = t.records.withColumn("checkout", F.when(doc % 3 == 0, "").when(doc % 5 == 0, "home").otherwise(other))
    keys = t.raw("customer").select(F.concat(F.lit("rec_"), F.col("c_custkey").cast("string")).alias("key"))
    return tables.get_records(placed, keys, t.links, "home")


@query("wanted_records", "S12 J2", with_views("v_records v_vectors", """
SELECT id, slug, type, title FROM v_records WHERE id IN (SELECT record_id FROM v_vectors)"""))
def wanted_records(t):
    keys = t.vectors.select(F.col("record_id").alias("id"))
    return tables.lookup(t.records, keys, "id").select("id", "slug", "type", "title")


@query("record_counts", "A3 S12 S14", with_views("v_records v_symbols", """
SELECT checkout, CAST(count(*) AS BIGINT) AS n, 'records' AS what FROM v_records GROUP BY checkout
UNION ALL SELECT checkout, CAST(count(*) AS BIGINT), 'symbols' FROM v_symbols GROUP BY checkout"""))
def record_counts(t):
    from ..operators.code import counts_per_checkout

    return counts_per_checkout(t.records).withColumn("what", F.lit("records")).unionByName(
        counts_per_checkout(t.symbols).withColumn("what", F.lit("symbols"))
    )


@query("model_vectors", "S13", with_views("v_vectors", """
SELECT record_id, dim, round(list_sum(embedding), 6) AS total FROM v_vectors WHERE model = 'm1'"""))
def model_vectors(t):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.vectors.where("model = 'm1'").select("record_id", "dim", F.round(total, 6).alias("total"))


@query("symbols_of_files", "S14", with_views("v_symbols", """
SELECT file_path, seq, name, line FROM v_symbols WHERE file_path IN (
    SELECT p_brand || '/' || p_partkey FROM part WHERE p_size >= 25)"""))
def symbols_of_files(t):
    big = t.symbols.where("line >= 25").select("file_path")
    return tables.lookup(t.symbols, big, "file_path").select("file_path", "seq", "name", "line")


@query("merged_tenants", "S16", with_views("v_records", """
SELECT id, CASE WHEN checkout = '' THEN '' ELSE 'old' END AS checkout, title FROM v_records"""))
def merged_tenants(t):
    base = t.records.where("checkout = ''")
    return tables.merge_tenant(base, t.records.where("checkout <> ''"), "old").select("id", "checkout", "title")


@query("kept_commits", "U3", with_views("v_commits", """
SELECT checkout, hash, subject FROM v_commits WHERE hash IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R')"""))
def kept_commits(t):
    keep = t.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("hash"))
    return tables.keep_only(t.commits, keep, ["hash"]).select("checkout", "hash", "subject")


@query("pruned_files", "U4 P9", with_views("v_symbols", """
SELECT file_path AS path FROM v_symbols WHERE NOT (file_path = 'Brand#1' OR starts_with(file_path, 'Brand#1/'))
    OR seq IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"""))
def pruned_files(t):
    seen = t.raw("lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("seq")).distinct()
    paths = t.symbols.join(seen, "seq", "left_semi").select(F.col("file_path").alias("path"))
    return tables.prune_unseen(t.files, paths, "Brand#1/").select("path")


@query("inserted_links", "U5 W7", with_views("v_links", """
base AS (SELECT DISTINCT * FROM v_links WHERE kind <> 'pin'),
delta AS (SELECT DISTINCT * FROM v_links WHERE from_checkout <> 'MACHINERY')
--
SELECT * FROM base UNION SELECT * FROM delta"""))
def inserted_links(t):
    base = t.links.where("kind <> 'pin'").distinct()
    return tables.insert_or_ignore(base, t.links.where("from_checkout <> 'MACHINERY'"), EDGE)


@query("removed_links", "W7", with_views("v_links", """
SELECT DISTINCT * FROM v_links WHERE kind <> 'repo'"""))
def removed_links(t):
    from ..operators.links import remove_links

    return remove_links(t.links.distinct(), t.links.where("kind = 'repo'")).select(*EDGE)


@query("merged_gaps", "U6 J3", with_views("v_current v_vectors", """
a AS (SELECT id, title, 'one' AS archive FROM v_current WHERE id NOT IN (SELECT record_id FROM v_vectors)),
b AS (SELECT id, title, 'two' AS archive FROM v_current)
--
SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)"""))
def merged_gaps(t):
    first = embedding.missing_vectors(t.records, t.vectors).withColumn("archive", F.lit("one"))
    second = t.records.where(R.is_current(F.col("status"))).select("id", "title").withColumn("archive", F.lit("two"))
    return tables.merge_gaps(first, second)


@query("live_vectors", "J26 W11", with_views("v_records v_vectors", """
SELECT record_id, model FROM v_vectors WHERE record_id IN (SELECT id FROM v_records WHERE doc_id % 7 <> 0)"""))
def live_vectors(t):
    return tables.drop_orphans(t.vectors, t.records.where(_doc() % 7 != 0)).select("record_id", "model")


@query("latest_commits", "N4 T6", with_views("v_commits", """
SELECT checkout, hash, subject FROM (SELECT *, row_number() OVER (PARTITION BY checkout ORDER BY authored_at DESC, hash) AS n FROM v_commits)
WHERE n <= 500"""))
def latest_commits(t):
    return tables.latest_commits(t.commits).select("checkout", "hash", "subject")


@query("indexed_commits", "W6 N4", with_views("v_commits", """
keep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY checkout ORDER BY authored_at DESC, hash) AS n FROM v_commits) WHERE n <= 500)
--
SELECT checkout, hash, CASE WHEN CAST(hash AS BIGINT) % 2 = 0 THEN 'stored' ELSE subject END AS subject FROM keep"""))
def indexed_commits(t):
    base = t.commits.where(F.col("hash").cast("long") % 2 == 0).withColumn("subject", F.lit("stored"))
    return tables.index_commits(base, t.commits).select("checkout", "hash", "subject")


@query("deleted_records", "W12", with_views("v_records v_vectors", """
gone AS (SELECT id FROM v_records WHERE type = 'map')
--
SELECT 'records' AS what, id FROM v_records WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'vectors', record_id FROM v_vectors WHERE record_id NOT IN (SELECT id FROM gone)"""))
def deleted_records(t):
    keys = t.records.where("type = 'map'").select("id", F.col("id").alias("record_id"))
    left = tables.delete_records({"records": (t.records, ["id"]), "vectors": (t.vectors, ["record_id"])}, keys)
    return left["records"].select(F.lit("records").alias("what"), "id").unionByName(
        left["vectors"].select(F.lit("vectors").alias("what"), F.col("record_id").alias("id"))
    )


# Every record is written again: unchanged, with a new title, with a new slug only,
# under a fresh id at its old path, or at a new path.
UPSERT_SQL = """
SELECT r.id, r.checkout, CASE WHEN doc_id % 5 = 4 THEN slug || '-x' ELSE slug END AS slug,
    CASE WHEN doc_id % 5 IN (1, 3) THEN 'New ' || title ELSE title END AS title, status,
    CASE WHEN doc_id % 5 = 4 THEN 'moved/' || doc_id || '.md' ELSE source_path END AS source_path, '' AS superseded_by,
    created_at, doc_id % 5 IN (1, 3, 4) AS touched FROM v_records r"""


def _rewrites(t):
    doc = _doc()
    d = t.records.select(
        F.when(doc % 5 == 3, F.concat(F.lit("new_"), doc.cast("string"))).otherwise(F.col("id")).alias("id"), "checkout",
        F.when((doc % 5).isin(2, 4), F.concat("slug", F.lit("-x"))).otherwise(F.col("slug")).alias("slug"), "type", "scope",
        F.when((doc % 5).isin(1, 3), F.concat(F.lit("New "), "title")).otherwise(F.col("title")).alias("title"), "status", "severity", "body",
        F.when(doc % 5 == 4, F.concat(F.lit("moved/"), doc.cast("string"), F.lit(".md"))).otherwise(F.col("source_path")).alias("source_path"),
        "tags", "applies_to", "supersedes", "superseded_by", "provenance_commit",
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    return R.with_content_hash(d)


@query("upserted_records", "W1", with_views("v_records", f"w AS ({UPSERT_SQL})\n--\nSELECT {CARD_SQL} FROM w"))
def upserted_records(t):
    return _card(tables.upsert_records(t.records, _rewrites(t), _now()))


@query("upsert_summary", "W1 A12", with_views("v_records", """
SELECT CASE WHEN doc_id % 5 IN (1, 3, 4) THEN 'updated' ELSE 'unchanged' END AS action, CAST(count(*) AS BIGINT) AS n
FROM v_records GROUP BY 1"""))
def upsert_summary(t):
    return tables.action_summary(tables.plan_upserts(t.records, _rewrites(t), _now()))


@query("remembered_records", "W2 F17 F18", with_views("v_records", """
w AS (SELECT id, checkout, slug, title, status, source_path, '' AS superseded_by, created_at, false AS touched FROM v_records
    UNION ALL SELECT 'p_' || p_partkey, 'home', regexp_replace(lower(p_name || ' ' || p_partkey), '[^a-z0-9]+', '-', 'g'),
        p_name || ' ' || p_partkey, 'accepted', 'records/' || regexp_replace(lower(p_name || ' ' || p_partkey), '[^a-z0-9]+', '-', 'g') || '.md',
        '', TIMESTAMP '@now', true FROM part)
--
SELECT @card FROM w""".replace("@now", LATER).replace("@card", CARD_SQL)))
def remembered_records(t):
    empty = F.lit(None).cast("string")
    no_list = F.array().cast("array<string>")
    drafts = t.raw("part").select(
        F.concat(F.lit("p_"), F.col("p_partkey").cast("string")).alias("id"), empty.alias("checkout"), empty.alias("slug"),
        F.lit("decision").alias("type"), F.lit("repo").alias("scope"), F.concat_ws(" ", "p_name", "p_partkey").alias("title"),
        empty.alias("status"), empty.alias("severity"), F.col("p_type").alias("body"), empty.alias("source_path"),
        no_list.alias("tags"), no_list.alias("applies_to"), no_list.alias("supersedes"), empty.alias("superseded_by"),
        empty.alias("provenance_commit"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    return _card(tables.remember(t.records, drafts, "home", _now()))


@query("retired_records", "W3 P17", with_views("v_records", """
w AS (SELECT id, checkout, slug, title, CASE WHEN type = 'rule' THEN 'superseded' ELSE status END AS status, source_path,
    CASE WHEN type = 'rule' AND status <> 'superseded' THEN 'rec_1' ELSE '' END AS superseded_by, created_at,
    type = 'rule' AND status <> 'superseded' AS touched FROM v_records)
--
SELECT @card FROM w""".replace("@card", CARD_SQL)))
def retired_records(t):
    targets = t.records.where("type = 'rule'").select("id", F.lit("rec_1").alias("superseded_by"))
    return _card(tables.retire(t.records, targets, _now()))


@query("updated_records", "W3 P17", with_views("v_records", """
w AS (SELECT id, checkout, slug, CASE WHEN doc_id % 3 = 0 THEN 'Patched ' || doc_id ELSE title END AS title, status, source_path,
    '' AS superseded_by, created_at, doc_id % 3 = 0 AS touched FROM v_records)
--
SELECT @card FROM w""".replace("@card", CARD_SQL)))
def updated_records(t):
    doc = _doc()
    title = F.when(doc % 3 == 0, F.concat(F.lit("Patched "), doc.cast("string"))).otherwise("")
    plan = tables.plan_updates(t.records, t.records.select("id", title.alias("title")), _now())
    return _card(tables.apply_plan(t.records, plan))


IMPORT_BASE = "doc_id % 4 <> 0"


def _imports(t):
    doc = _doc()
    base = t.records.where(doc % 4 != 0)
    docs = t.records.select(
        F.when(doc % 4 == 1, F.concat(F.lit("x_"), doc.cast("string"))).otherwise(F.col("id")).alias("id"),
        F.when(doc % 4 == 2, "").otherwise(F.col("checkout")).alias("checkout"), "slug", "type", "scope",
        F.when(doc % 4 == 3, F.col("title")).otherwise(F.concat(F.lit("Doc "), "title")).alias("title"), "status", "severity", "body",
        F.when(doc % 4 == 2, "other/place.md").otherwise(F.col("source_path")).alias("source_path"), "tags", "applies_to",
        "supersedes", "superseded_by", "provenance_commit",
    )
    return base, R.with_content_hash(docs)


@query("imported_records", "W4", with_views("v_records", """
w AS (SELECT id, checkout, slug, CASE WHEN doc_id % 4 = 3 THEN title ELSE 'Doc ' || title END AS title, status, source_path, '' AS superseded_by,
    CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '@now' ELSE created_at END AS created_at, doc_id % 4 <> 3 AS touched FROM v_records)
--
SELECT @card FROM w""".replace("@now", LATER).replace("@card", CARD_SQL)))
def imported_records(t):
    return _card(tables.import_merge(*_imports(t), _now())[0])


@query("import_summary", "W4 A12", with_views("v_records", """
SELECT CASE doc_id % 4 WHEN 0 THEN 'imported' WHEN 3 THEN 'skipped' ELSE 'updated' END AS action, CAST(count(*) AS BIGINT) AS n
FROM v_records GROUP BY 1"""))
def import_summary(t):
    return tables.import_merge(*_imports(t), _now())[1]


@query("missing_vectors", "J3", with_views("v_current v_vectors", """
SELECT id, title FROM v_current WHERE id NOT IN (SELECT record_id FROM v_vectors)"""))
def missing_vectors(t):
    return embedding.missing_vectors(t.records, t.vectors)


@query("unembedded_count", "A9", with_views("v_current v_vectors", """
SELECT CAST(count(*) AS BIGINT) AS unembedded FROM v_current WHERE id NOT IN (SELECT record_id FROM v_vectors WHERE model = 'm0')"""))
def unembedded_count(t):
    return embedding.missing_vectors(t.records, t.vectors, "m0").agg(F.count("*").alias("unembedded"))


@query("giveups_with_title", "J4", with_views("v_records v_vectors", """
SELECT v.record_id AS key, coalesce(r.title, '') AS title FROM v_vectors v LEFT JOIN v_records r ON r.id = v.record_id AND r.doc_id % 2 = 0"""))
def giveups_with_title(t):
    giveups = t.vectors.select(F.col("record_id").alias("key"))
    return embedding.giveups_with_title(giveups, t.records.where(_doc() % 2 == 0)).select("key", "title")


@query("vector_mismatches", "J5", with_views("v_records v_vectors", """
SELECT v.record_id, r.content_hash FROM v_vectors v JOIN v_records r ON r.id = v.record_id WHERE v.model <> 'm1' OR v.dim <> 64"""))
def vector_mismatches(t):
    return embedding.vector_mismatch(t.vectors, t.records, "m1", 64)


@query("embed_worklist", "W8 F14", with_views("v_records v_vectors", """
SELECT id AS key FROM v_records WHERE NOT (doc_id % 3 <> 0 AND id IN (SELECT record_id FROM v_vectors WHERE model = 'm1' AND dim = 64))"""))
def embed_worklist(t):
    items = embedding.worklist_items(t.records)
    # every third stored vector was made from an older text
    stored = t.vectors.withColumnRenamed("record_id", "id").join(
        items.select(F.col("key").alias("id"), "text_hash"), "id"
    ).select(
        F.col("id").alias("key"), "model", "dim",
        F.when(_doc() % 3 == 0, "old").otherwise(F.col("text_hash")).alias("text_hash"),
    )
    return embedding.embed_worklist(items, stored, "m1", 64).select("key")


@query("embedding_attempts", "W10", """
WITH a AS (SELECT 'c' || c_custkey AS key, CAST(c_nationkey % 5 AS INTEGER) AS attempts, c_custkey % 3 AS r FROM customer)
SELECT key, CAST(attempts + CASE WHEN r = 1 THEN 1 ELSE 0 END AS INTEGER) AS attempts, CASE WHEN r = 1 THEN 'timeout' ELSE 'before' END AS last_error,
    CASE WHEN r = 1 AND attempts + 1 >= 5 THEN 'giveup' ELSE 'queued' END AS state FROM a WHERE r <> 0""")
def embedding_attempts(t):
    c = t.raw("customer").withColumn("key", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    stored = c.select("key", (F.col("c_nationkey") % 5).alias("attempts"), F.lit("before").alias("last_error"), F.lit("queued").alias("state"))
    ran = c.where("c_custkey % 3 <> 2").select("key", F.when(F.col("c_custkey") % 3 == 1, "timeout").alias("error"))
    return embedding.apply_results(stored, ran)


@query("requeued_giveups", "W10", """
SELECT 'c' || c_custkey AS key, CAST(CASE WHEN c_nationkey % 5 = 4 AND c_custkey % 2 = 0 THEN 0 ELSE c_nationkey % 5 END AS INTEGER) AS attempts,
    CASE WHEN c_nationkey % 5 = 4 AND c_custkey % 2 <> 0 THEN 'giveup' ELSE 'queued' END AS state FROM customer""")
def requeued_giveups(t):
    c = t.raw("customer").withColumn("key", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    n = F.col("c_nationkey") % 5
    stored = c.select("key", n.alias("attempts"), F.lit("timeout").alias("last_error"), F.when(n == 4, "giveup").otherwise("queued").alias("state"))
    return embedding.requeue_rewritten(stored, c.where("c_custkey % 2 = 0")).select("key", "attempts", "state")


@query("embedded_batch", "W9 G1")
def embedded_batch(t):
    done = embedding.embed(embedding.worklist_items(t.records), embedding.hash_embedder(16))
    return done.select("key", "text_hash", F.size("vector").alias("dim"), "error")


FILE_TEXT_SQL = """
lines AS (SELECT brand AS file_path, seq, CASE WHEN exported THEN 0 ELSE 1 END AS grp, name || ' (' || kind || ') — ' || doc AS line FROM v_symbols),
run AS (SELECT *, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY file_path, grp ORDER BY seq) AS n,
    octet_length(encode('file: ' || file_path || chr(10))) AS h FROM lines),
lead AS (SELECT file_path, max(n) AS n0 FROM run WHERE grp = 0 AND n + h <= 2048 GROUP BY file_path),
kept AS (SELECT r.* FROM run r LEFT JOIN lead l USING (file_path) WHERE r.n + r.h + CASE WHEN r.grp = 1 THEN coalesce(l.n0, 0) ELSE 0 END <= 2048)"""


@query("file_embed_texts", "N5 F16", with_views("v_symbols", FILE_TEXT_SQL + """
--
SELECT file_path, text, sha256(text) AS text_hash FROM (SELECT file_path, 'file: ' || file_path || chr(10)
    || string_agg(line || chr(10), '' ORDER BY grp, seq) AS text FROM kept GROUP BY file_path)"""))
def file_embed_texts(t):
    # a 2 KiB budget, so files overflow in the smallest test tables too
    return embedding.file_embed_text(t.brand_symbols, 2048).select("file_path", "text", "text_hash")


@query("changed_files", "W5 F16", """
SELECT 'Brand' || p_brand || '/' || p_partkey AS path, sha256(p_name) AS content_hash FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT 'Brand' || p_brand || '/' || p_partkey, sha256(p_type) FROM part WHERE p_partkey % 3 = 0""")
def changed_files(t):
    key = F.col("p_partkey")
    path = F.concat(F.lit("Brand"), "p_brand", F.lit("/"), key.cast("string")).alias("path")
    text = F.when(key % 3 == 0, F.col("p_type")).otherwise(F.col("p_name"))
    tree = t.raw("part").select(
        F.lit("main").alias("checkout"), path, F.sha2(text, 256).alias("content_hash"), text.alias("content")
    )
    stored = t.raw("part").where(key % 5 != 0).select(
        F.lit("main").alias("checkout"), path, F.sha2("p_name", 256).alias("content_hash")
    )
    from ..operators.extract import extract
    from ..schemas import EDGES, SYMBOLS

    no_symbols, no_edges = t.spark.createDataFrame([], SYMBOLS), t.spark.createDataFrame([], EDGES)
    out = tables.index_files(stored, no_symbols, no_edges, tree, lambda df: extract(df, {}))
    return out["files"].select("path", "content_hash")


@query("status_by_checkout", "C14 A11 A3 A9", with_views("v_records v_vectors", """
r AS (SELECT r.checkout, count(*) AS records, count(*) FILTER (WHERE v.record_id IS NULL AND status = 'accepted') AS missing_vectors,
    count(*) FILTER (WHERE doc_id % 9 IN (1, 2)) AS queue_depth, count(*) FILTER (WHERE doc_id % 9 = 0) AS giveups
    FROM v_records r LEFT JOIN v_vectors v ON v.record_id = r.id GROUP BY r.checkout),
f AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'web' ELSE '' END AS checkout, count(*) AS files FROM pages GROUP BY 1)
--
SELECT coalesce(r.checkout, f.checkout) AS checkout, CAST(coalesce(records, 0) AS BIGINT) AS records,
    CAST(coalesce(missing_vectors, 0) AS BIGINT) AS missing_vectors, CAST(coalesce(queue_depth, 0) AS BIGINT) AS queue_depth,
    CAST(coalesce(giveups, 0) AS BIGINT) AS giveups, CAST(coalesce(files, 0) AS BIGINT) AS files, coalesce(files, 0) > 0 AS reindex
FROM r FULL JOIN f ON f.checkout = r.checkout"""))
def status_by_checkout(t):
    files = t.raw("pages").select(
        F.when(F.col("page_id") % 2 == 0, "web").otherwise("").alias("checkout"), F.lit(NOW).cast("timestamp").alias("indexed_at")
    )
    n = _doc() % 9
    attempts = t.records.where(n.isin(0, 1, 2)).select(
        F.col("id").alias("key"), F.when(n == 0, "giveup").otherwise("queued").alias("state")
    )
    return status.status(t.records, files, t.vectors, attempts).drop("last_indexed")


@query("last_indexed", "N11", """
WITH stamps AS (SELECT CASE c_nationkey WHEN 0 THEN '' ELSE 'c' || c_nationkey END AS checkout,
    CASE WHEN c_nationkey % 2 = 0 THEN max(c_custkey) END AS at_sec FROM customer GROUP BY c_nationkey),
files AS (SELECT CASE s_nationkey % 10 WHEN 0 THEN '' ELSE 'c' || (s_nationkey % 10) END AS checkout, count(*) AS n FROM supplier GROUP BY 1)
SELECT s.checkout, CAST(coalesce(s.at_sec, CASE WHEN f.n IS NULL AND (SELECT n FROM files WHERE checkout = '') > 0
    THEN (SELECT at_sec FROM stamps WHERE checkout = '') END) AS BIGINT) AS at_sec
FROM stamps s FULL JOIN files f ON f.checkout = s.checkout""")
def last_indexed(t):
    nation = F.col("c_nationkey")
    stamps = t.raw("customer").groupBy("c_nationkey").agg(F.max("c_custkey").alias("m")).select(
        F.when(nation == 0, "").otherwise(F.concat(F.lit("c"), nation.cast("string"))).alias("checkout"),
        F.when(nation % 2 == 0, F.timestamp_seconds("m")).alias("last_indexed"),
    )
    place = F.col("s_nationkey") % 10
    files = t.raw("supplier").select(
        F.when(place == 0, "").otherwise(F.concat(F.lit("c"), place.cast("string"))).alias("checkout")
    )
    return status.last_indexed(files, stamps).select("checkout", F.unix_seconds("last_indexed").alias("at_sec"))


@query("delta_table", "W1 X7 S12", """
SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'""")
def delta_table(t):
    """The last event of each user, from four writes of changed keys; an error removes the user."""
    schema = "user_id long, event_id long, event_type string, us long"
    events = t.raw("events").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), "event_type",
                                    F.unix_micros("ts").alias("us"))
    path = new_folder(t.spark, "delta-table")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    placed = events.withColumn("part", 1 + F.floor((F.col("event_id") - low) * 4 / (high - low + 1)))
    for version in range(1, 5):
        now = placed.where(F.col("part") == version).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "us"), "event_id").alias("e")).select("user_id", "e.*")
        deltas.write_delta(now.where("event_type <> 'error'"), path, ["user_id"], version, now.where("event_type = 'error'"), max_deltas=3)
    return deltas.read_table(t.spark, path, schema, ["user_id"])
