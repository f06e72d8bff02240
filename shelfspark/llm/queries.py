"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), keep=["doc_id"])


@query
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    found = secrets.find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", *[secrets.count_kind(F.col("base_spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.span_text(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.span_text(F.col("all_spans")).alias("spans"),
    )


@query
def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    _, index = warc.archive_and_index(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warc.read_index(spark, index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "start", "length")


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(docs, keep=["doc_id", "source"], max_repeats=4.0)


@query
def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import find_classes

    return find_classes(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query
def op6_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parsing import fingerprints

    return fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op2_extract_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import extraction

    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    found = extraction.extract(pages, extraction.trained(pages))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


TERMS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"


@query
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"))
    return chat.digests(chat.format_conversations(rows.union(probe)))


ORACLES["op11_chat_format"] = r"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    replace(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '<text>', '<\text>'), '<more>', '<\more>'), '</turn>', '<\/turn>') AS body,
    replace(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '<text>', '<\text>'), '<more>', '<\more>'), '</turn>', '<\/turn>') AS head
  FROM all_rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(body) + CASE WHEN before = role THEN 6 ELSE 19 + length(head) END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents", "lang", "source", "text"))


ORACLES["op12_source_divergence"] = rf"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TERMS_SQL.format(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")} AS terms FROM documents),
counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs) GROUP BY lang, source, term),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
rated AS (
  SELECT lang, source, term, n, 1 + CAST((1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p
  FROM cells),
whole AS (
  SELECT lang, term, 1 + CAST((1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
  FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT r.lang, r.source, 'term', r.term, CAST(((r.p - w.q) * (r.p - w.q)) // w.q AS BIGINT)
  FROM rated r JOIN whole w ON w.lang = r.lang AND w.term = r.term WHERE r.n > 0 AND r.p > w.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical
    from .common import written

    index = written(lexical.build_index(table(spark, sf_dir, "documents", "doc_id", "text")), "signatures", lexical.GROUPED)
    return lexical.search(index, table(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLES["op13_lexical_search"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL.format(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")} AS terms FROM documents),
sized AS (SELECT r, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized),
counts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
asked AS (SELECT DISTINCT item_id, unnest({TERMS_SQL.format(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")}) AS term FROM benchmark),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term) CROSS JOIN totals),
scored AS (
  SELECT a.item_id, c.r, CAST(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * s.n * t.big_n) // t.big_l)))) AS BIGINT) AS score
  FROM asked a JOIN counts c ON c.term = a.term JOIN weights w ON w.term = a.term JOIN sized s ON s.r = c.r CROSS JOIN totals t
  GROUP BY a.item_id, c.r),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored JOIN sized USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
