"""Queries and oracles: keyword, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, keyword, metric, vectors
from ..session import new_folder
from .adapters import STOP_SQL, WORD_SQL, fold_sql, with_views
from .registry import query

FLOOR = 0.20  # the generated vectors are nearly orthogonal, see the survey

TOKENS_SQL = f"""
docs AS (SELECT id AS record_id, type, status, regexp_extract_all({fold_sql(
    "title || ' ' || body || ' ' || array_to_string(tags, ' ') || ' ' || array_to_string(applies_to, ' ')")}, {WORD_SQL}) AS tokens
    FROM v_records),
stats AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_length FROM docs),
postings AS (SELECT record_id, type, status, length, term, count(*) AS tf FROM (
    SELECT record_id, type, status, len(tokens) AS length, unnest(tokens) AS term FROM docs) GROUP BY ALL),
term_df AS (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM postings GROUP BY term)"""

TERMS_SQL = f"""
qtok AS (SELECT query_id, unnest(regexp_extract_all(text, {WORD_SQL})) AS w FROM v_queries),
qn AS (SELECT query_id, count(*) AS n_tokens,
    count(DISTINCT lower(w)) FILTER (WHERE NOT list_contains({STOP_SQL}, lower(w))) AS n_content FROM qtok GROUP BY query_id),
qstrict AS (SELECT query_id, {fold_sql('w')} AS term, count(*) AS strict_n FROM qtok GROUP BY ALL),
qcontent AS (SELECT query_id, {fold_sql('w')} AS term, count(*) AS content_n FROM (
    SELECT DISTINCT query_id, lower(w) AS w FROM qtok WHERE NOT list_contains({STOP_SQL}, lower(w))) GROUP BY ALL),
qterms AS (SELECT s.query_id, s.term, s.strict_n, coalesce(c.content_n, 0) AS content_n, n.n_tokens, n.n_content,
    CASE WHEN n.n_content <= 2 THEN n.n_content ELSE (2 * n.n_content + 2) // 3 END AS need
    FROM qstrict s JOIN qn n USING (query_id) LEFT JOIN qcontent c ON c.query_id = s.query_id AND c.term = s.term)"""

KEYWORD_SQL = TOKENS_SQL + "," + TERMS_SQL + """,
scored AS (SELECT q.query_id, p.record_id, any_value(n_tokens) AS n_tokens, any_value(need) AS need,
    sum(strict_n) AS strict_hit, sum(content_n) AS covered,
    round(sum(strict_n * s), 6) AS strict_score, round(sum(content_n * s), 6) AS relaxed_score
    FROM (SELECT p.*, greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6)
            * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / avg_length)) AS s
          FROM postings p JOIN term_df USING (term), stats
          WHERE status NOT IN ('superseded', 'deprecated') AND term IN (SELECT term FROM qterms)) p
    JOIN qterms q USING (term) GROUP BY q.query_id, p.record_id),
entries AS (
    SELECT query_id, record_id, 0 AS class, strict_score AS score FROM scored WHERE strict_hit = n_tokens
    UNION ALL
    SELECT query_id, record_id, CASE WHEN covered >= need THEN 1 ELSE 2 END, relaxed_score
    FROM scored s WHERE n_tokens > 1 AND covered > 0
        AND NOT EXISTS (SELECT 1 FROM scored t WHERE t.query_id = s.query_id AND t.strict_hit = t.n_tokens)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, class ORDER BY score DESC, record_id) AS pos FROM entries),
kw AS (SELECT query_id, record_id, score, class = 2 AS any_term,
    CAST(pos + CASE WHEN class = 2 THEN (SELECT count(*) FROM placed s WHERE s.query_id = p.query_id AND s.class = 1 AND s.pos <= 60)
        ELSE 0 END AS INTEGER) AS rank FROM placed p WHERE pos <= 60)"""

VECTOR_SQL = """
pairs AS (SELECT q.query_id, v.record_id, round(list_cosine_similarity(q.embedding, v.embedding), 6) AS cosine
    FROM v_queries q, v_vectors v JOIN v_current r ON r.id = v.record_id WHERE q.embedding IS NOT NULL),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, record_id) AS rank FROM pairs)
    WHERE rank <= 60)"""

FUSE_SQL = KEYWORD_SQL + "," + VECTOR_SQL + f""",
fused AS (SELECT *, (CASE WHEN kw_rank > 0 THEN 1.0::DOUBLE / (60.0::DOUBLE + kw_rank) ELSE 0 END)
        + (CASE WHEN vec_rank > 0 THEN 1.0::DOUBLE / (60.0::DOUBLE + vec_rank) ELSE 0 END) AS score,
    CASE WHEN vec_rank IS NULL THEN 'fts' WHEN kw_rank IS NULL THEN 'vector' ELSE 'hybrid' END AS source
    FROM (SELECT query_id, record_id, kw_rank, CASE WHEN has_vec THEN vec_rank END AS vec_rank,
            CASE WHEN has_vec THEN cosine ELSE 0.0 END AS cosine
          FROM (SELECT *, vec_rank IS NOT NULL AND (strong OR cosine >= {FLOOR}) AS has_vec
                FROM (SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.record_id, v.record_id) AS record_id,
                        k.rank AS kw_rank, v.rank AS vec_rank, v.cosine,
                        k.rank IS NOT NULL AND NOT coalesce(k.any_term, false) AS strong
                      FROM kw k FULL JOIN vec v ON v.query_id = k.query_id AND v.record_id = k.record_id))
          WHERE strong OR has_vec))"""

HYBRID_SQL = FUSE_SQL + """,
layered AS (SELECT f.*, r.checkout, r.type, r.slug, r.scope, r.status, row_number() OVER (
        PARTITION BY f.query_id, r.checkout, r.type, r.slug
        ORDER BY CASE r.scope WHEN 'repo' THEN 3 WHEN 'global' THEN 2 ELSE 1 END DESC, f.score DESC, f.record_id) AS layer
    FROM fused f JOIN v_records r ON r.id = f.record_id),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cosine DESC, record_id) AS rank
    FROM layered WHERE layer = 1) WHERE rank <= 20)"""


def _stored(t):
    path = new_folder(t.spark, "keyword-index")
    keyword.write_index(t.records, path, stem=False)
    return keyword.read_index(t.spark, path)


def _balls(t, rows):
    path = new_folder(t.spark, "vector-balls")
    metric.write_balls(rows, path, 64)  # several balls from the 500 vectors of the smallest tables on
    return metric.open_balls(t.spark, path)


def _vectors(t):
    return fusion.record_vectors_for_search(t.vectors, t.records)


@query("search_hybrid", "C4 C2 F9 F10 N1 N3 T4 U7", with_views("v_records v_current v_vectors v_queries", HYBRID_SQL + """
--
SELECT query_id, record_id, round(score, 9) AS score, cosine, source, CAST(rank AS INTEGER) AS rank FROM hybrid"""))
def search_hybrid(t):
    index = keyword.build_index(t.records, stem=False)
    hits = fusion.hybrid_search(index, t.vectors, t.queries, t.records, floor=FLOOR, with_snippet=False)
    return hits.select("query_id", "record_id", F.round("score", 9).alias("score"), "cosine", "source", "rank")


@query("search_stored_hybrid", "C4 C2 F9 F10 N1 N3 T4 U7", with_views("v_records v_current v_vectors v_queries", HYBRID_SQL + """
--
SELECT query_id, record_id, round(score, 9) AS score, cosine, source, CAST(rank AS INTEGER) AS rank FROM hybrid"""))
def search_stored_hybrid(t):
    hits = fusion.hybrid_search(_stored(t), _balls(t, _vectors(t)), t.queries, t.records, floor=FLOOR, with_snippet=False)
    return hits.select("query_id", "record_id", F.round("score", 9).alias("score"), "cosine", "source", "rank")


@query("search_keyword", "C1 F7 N2 T1 U2", with_views("v_records v_queries", KEYWORD_SQL + """
--
SELECT query_id, record_id, score, any_term, rank FROM kw"""))
def search_keyword(t):
    return keyword.keyword_search(keyword.build_index(t.records, stem=False), t.queries)


@query("search_stored_keyword", "C1 F7 N2 T1 U2", with_views("v_records v_queries", KEYWORD_SQL + """
--
SELECT query_id, record_id, score, any_term, rank FROM kw"""))
def search_stored_keyword(t):
    return keyword.keyword_search(_stored(t), t.queries)


@query("search_keyword_stemmed", "C1 F6 G4")
def search_keyword_stemmed(t):
    return keyword.keyword_search(keyword.build_index(t.records, stem=True), t.queries)


@query("search_vector", "C2 T2 F8", with_views("v_current v_vectors v_queries", VECTOR_SQL + """
--
SELECT query_id, record_id AS key, cosine, CAST(rank AS INTEGER) AS rank FROM vec"""))
def search_vector(t):
    return vectors.vector_search(_vectors(t), t.queries.where("embedding IS NOT NULL"))


@query("search_ball_vectors", "C2 T2 F8", with_views("v_current v_vectors v_queries", VECTOR_SQL + """
--
SELECT query_id, record_id AS key, cosine, CAST(rank AS INTEGER) AS rank FROM vec"""))
def search_ball_vectors(t):
    return vectors.vector_search(_balls(t, _vectors(t)), t.queries.where("embedding IS NOT NULL"))


@query("search_files_by_vector", "C3 T3", with_views("v_vectors v_queries", f"""
pairs AS (SELECT q.query_id, v.model AS checkout, v.record_id AS path,
    round(list_cosine_similarity(q.embedding, v.embedding), 6) AS cosine FROM v_queries q, v_vectors v
    WHERE q.embedding IS NOT NULL AND v.model = 'm' || (q.query_id % 2))
--
SELECT query_id, path, cosine, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, path) AS rank FROM pairs WHERE cosine >= {FLOOR})
WHERE rank <= 20"""))
def search_files_by_vector(t):
    files = t.vectors.select(F.col("model").alias("checkout"), F.col("record_id").alias("path"), "embedding")
    asked = t.queries.where("embedding IS NOT NULL").withColumn(
        "checkout", F.concat(F.lit("m"), (F.col("query_id") % 2).cast("string"))
    )
    return vectors.file_search(files, asked, floor=FLOOR)


@query("search_ball_files", "C3 T3", with_views("v_vectors v_queries", f"""
pairs AS (SELECT q.query_id, v.model AS checkout, v.record_id AS path,
    round(list_cosine_similarity(q.embedding, v.embedding), 6) AS cosine FROM v_queries q, v_vectors v
    WHERE q.embedding IS NOT NULL AND v.model = 'm' || (q.query_id % 2))
--
SELECT query_id, path, cosine, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, path) AS rank FROM pairs WHERE cosine >= {FLOOR})
WHERE rank <= 20"""))
def search_ball_files(t):
    files = t.vectors.select(F.col("model").alias("checkout"), F.col("record_id").alias("path"), "embedding")
    asked = t.queries.where("embedding IS NOT NULL").withColumn(
        "checkout", F.concat(F.lit("m"), (F.col("query_id") % 2).cast("string"))
    )
    return vectors.file_search(_balls(t, vectors.file_vectors_for_search(files)), asked, floor=FLOOR)


@query("fuse_channels", "U7 F9 F10 N1", with_views("v_records v_current v_vectors v_queries", FUSE_SQL + """
--
SELECT query_id, record_id, CAST(kw_rank AS INTEGER) AS kw_rank, CAST(vec_rank AS INTEGER) AS vec_rank, cosine,
    round(score, 9) AS score, source FROM fused"""))
def fuse_channels(t):
    kw = keyword.keyword_search(keyword.build_index(t.records, stem=False), t.queries)
    vec = vectors.vector_search(_vectors(t), t.queries.where("embedding IS NOT NULL"))
    return fusion.fuse(kw, vec, FLOOR).withColumn("score", F.round("score", 9))


@query("corpus_statistics", "A1 F6", with_views("v_records", TOKENS_SQL + """
--
SELECT term, df, CAST(total_tf AS BIGINT) AS total_tf, n_docs, round(avg_length, 6) AS avg_length FROM term_df, stats"""))
def corpus_statistics(t):
    return keyword.corpus_stats(keyword.build_index(t.records, stem=False)).withColumn(
        "avg_length", F.round("avg_length", 6)
    )


@query("term_coverage", "A2 U2", with_views("v_records v_queries", TOKENS_SQL + "," + TERMS_SQL + """
--
SELECT query_id, record_id, CAST(sum(content_n) AS BIGINT) AS covered FROM postings JOIN qterms USING (term)
WHERE content_n > 0 GROUP BY query_id, record_id"""))
def term_coverage(t):
    return keyword.term_coverage(keyword.build_index(t.records, stem=False), t.queries)


SIMILAR_SQL = """
have AS (SELECT r.id, v.embedding FROM v_current r JOIN v_vectors v ON v.record_id = r.id),
near AS (SELECT round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine, a.id AS a_id, b.id AS b_id
    FROM have a JOIN have b ON a.id < b.id),
close AS (SELECT * FROM near WHERE cosine >= 0.40)"""


def _current_vectors(t):
    current = t.records.where("status NOT IN ('superseded', 'deprecated')").select("id")
    return t.vectors.select(F.col("record_id").alias("id"), "embedding").join(current, "id")


@query("stored_term_coverage", "A2 U2", with_views("v_records v_queries", TOKENS_SQL + "," + TERMS_SQL + """
--
SELECT query_id, record_id, CAST(sum(content_n) AS BIGINT) AS covered FROM postings JOIN qterms USING (term)
WHERE content_n > 0 GROUP BY query_id, record_id"""))
def stored_term_coverage(t):
    return keyword.term_coverage(_stored(t), t.queries)


SIMILAR_SQL = """
have AS (SELECT r.id, v.embedding FROM v_current r JOIN v_vectors v ON v.record_id = r.id),
near AS (SELECT round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine, a.id AS a_id, b.id AS b_id
    FROM have a JOIN have b ON a.id < b.id),
close AS (SELECT * FROM near WHERE cosine >= 0.40)"""


def _current_vectors(t):
    current = t.records.where("status NOT IN ('superseded', 'deprecated')").select("id")
    return t.vectors.select(F.col("record_id").alias("id"), "embedding").join(current, "id")


@query("similar_pairs", "J23 F8", with_views("v_current v_vectors", SIMILAR_SQL + """
--
SELECT cosine, a_id, b_id FROM close ORDER BY cosine DESC, a_id, b_id LIMIT 20"""))
def similar_pairs(t):
    return vectors.similar_pairs(_current_vectors(t), floor=0.40)[0]


@query("similar_pairs_omitted", "J23", with_views("v_current v_vectors", SIMILAR_SQL + """
--
SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(greatest(count(*) - 20, 0) AS BIGINT) AS omitted FROM close"""))
def similar_pairs_omitted(t):
    return vectors.similar_pairs(_current_vectors(t), floor=0.40)[1]
