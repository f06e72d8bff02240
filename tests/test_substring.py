"""Substring index against plain ``in`` tests over every row."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import code, sizing
from shelfspark.operators import substring_index as S

SCHEMA = "checkout string, key int, title string, body string, extra string"
LONG = "ab" * 150_000 + "needle"


def fold(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def rows():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("aAbBcÉ😀 \n%_") for _ in range(rnd.randint(0, 12)))
    out = [(rnd.choice(["", "x", "y"]), i, word(), rnd.choice([None, word() + " " + word()]), "z") for i in range(300)]
    out += [("x", 400, None, None, None), ("x", 401, "", "", ""), ("x", 402, LONG, "", ""), (None, 403, "abc", "abc", ""),
            ("x", 404, "ends ab", "c", ""), ("y", None, "null key abc", None, "")]
    return out


TERMS = ["a", "É", "ab", "abc", "😀", "😀a", "%_", "aab", "needle", "b\na", "bc", "zzz", "", " aB ", "c\nc", "ababab", "abcabcabc"]


def brute(data):
    found = set()
    for checkout, key, title, body, _ in data:
        for c in ("", "x", "y"):
            for term in TERMS:
                t = fold(term.strip(" "))
                flags = (t in fold(title or ""), t in fold(body or ""))
                if t and checkout == c and any(flags):
                    found.add((f"{c}:{term}", key, *flags))
    return found


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("substrings"))
    S.write_substrings(spark.createDataFrame(rows(), SCHEMA).coalesce(2), ["title", "body"], ["key"], path, buckets=4, block_rows=50)
    return S.open_substrings(spark, path)


def asked(spark):
    data = [(f"{c}:{t}", c, t, 1, 1) for c in ("", "x", "y") for t in TERMS]
    return spark.createDataFrame(data, "query_id string, checkout string, term string, n_terms int, need int").coalesce(1)


@pytest.mark.parametrize("most", [sizing.MAX_ROWS, 40])
def test_hits_equal_brute_force(spark, stored, monkeypatch, most):
    monkeypatch.setattr(sizing, "MAX_ROWS", most)  # 40: folders in several runs, and crowded ones by a shuffle
    got = [tuple(r) for r in S.term_hits(stored, asked(spark)).select("query_id", "key", "in_title", "in_body").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows())


def test_only_blocks_with_every_gram_are_opened(spark, stored):
    words = spark.createDataFrame([("x", "needle"), ("x", "zzz")], "checkout string, term string")
    chosen = S.chosen_postings(stored, words).collect()
    assert {r.term for r in chosen} == {"needle"}
    assert len({r.block for r in chosen}) == 1 and len(chosen) == S.RAREST


def shuffled_columns(df):
    """Input columns of every shuffle in the plan."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = [p for p in text.split("\n\n") if ") Exchange" in p.split("\n")[0]]
    return "\n".join(p for p in parts)


def test_texts_are_not_shuffled(spark, stored):
    hits = S.term_hits(stored, asked(spark))
    assert "entry" not in shuffled_columns(hits) and "title" not in shuffled_columns(hits).replace("in_title", "")
    shown = S.with_fields(stored, hits.select("checkout", "row", "key").distinct(), ["body"])
    assert "entry" not in shuffled_columns(shown) and "body" not in shuffled_columns(shown)
    assert "PartitionFilters" in shown._jdf.queryExecution().toString()


def test_repeated_rows_and_equal_numbers(spark, tmp_path):
    data = [("x", 1, "abc", "first", ""), ("x", 1, "abc", "first", ""), ("x", None, "abc", "lone", "")]
    S.write_substrings(spark.createDataFrame(data, SCHEMA), ["title"], ["key"], str(tmp_path), buckets=2)
    index = S.open_substrings(spark, str(tmp_path))
    terms = spark.createDataFrame([("q", "x", "bc", 1, 1)], "query_id string, checkout string, term string, n_terms int, need int")
    hits = S.term_hits(index, terms)
    assert sorted(str(r.key) for r in hits.collect()) == ["1", "1", "None"]


def test_empty_index_and_no_terms(spark, stored, tmp_path):
    S.write_substrings(spark.createDataFrame([], SCHEMA), ["title", "body"], ["key"], str(tmp_path))
    empty = S.open_substrings(spark, str(tmp_path))
    assert S.term_hits(empty, asked(spark)).count() == 0
    assert S.term_hits(stored, asked(spark).limit(0)).count() == 0


def test_stored_searches_equal_plain_ones(spark, tmp_path):
    rnd = random.Random(3)
    words = ["jar", "seal", "Shelf", "wax", "stamp", "crate"]
    pick = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    symbols = spark.createDataFrame(
        [("m", f"p{i % 9}/{pick(1)}.go", i, pick(1) + pick(1), "function", i, rnd.choice([None, pick(4)]), i % 2 == 0) for i in range(200)],
        "checkout string, file_path string, seq int, name string, kind string, line int, doc string, exported boolean")
    files = symbols.select("checkout", F.col("file_path").alias("path")).distinct().withColumn("package_name", F.lit("pantry"))
    commits = spark.createDataFrame(
        [("m", f"h{i:03}", pick(3), rnd.choice([None, pick(6)]), dt.datetime(2026, 1, 1 + i % 5)) for i in range(100)],
        "checkout string, hash string, subject string, body string, authored_at timestamp")
    queries = spark.createDataFrame(
        [(f"q{i}", "m", t) for i, t in enumerate(["jar", "seal wax stamp", "jar crate zzz", "go", "zzz", "p3", "find the wax crate"])],
        "query_id string, checkout string, text string")
    code.write_symbol_index(symbols, files, f"{tmp_path}/s", buckets=4, block_rows=30)
    code.write_commit_index(commits, f"{tmp_path}/c", buckets=4, block_rows=30)
    plain = code.search_symbols(symbols, files, queries)
    found = code.search_symbols(S.open_substrings(spark, f"{tmp_path}/s"), None, queries)
    assert sorted(found.columns) == sorted(plain.columns)
    key = lambda r: (r["query_id"], r["rank"])
    assert sorted(map(tuple, found.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    plain = code.search_commits(commits, queries)
    found = code.search_commits(S.open_substrings(spark, f"{tmp_path}/c"), queries)
    assert sorted(found.select(plain.columns).collect(), key=key) == sorted(plain.collect(), key=key)


def test_symbol_search_equals_brute_force(spark):
    rnd = random.Random(5)
    words = ["jar", "seal", "wax", "stamp"]
    rows = [("m", f"p{rnd.randrange(40):02}", i, f"{rnd.choice(words)} {rnd.choice(words)}", "function", i % 3, rnd.choice(["", "jar wax"]), i % 2 == 0) for i in range(120)]
    symbols = spark.createDataFrame(rows, "checkout string, file_path string, seq int, name string, kind string, line int, doc string, exported boolean")
    files = spark.createDataFrame([], "checkout string, path string, package_name string")
    texts = ["jar", "seal wax", "jar stamp zzz", "stamp p07"]
    queries = spark.createDataFrame([(i, "m", t) for i, t in enumerate(texts)], "query_id int, checkout string, text string")
    for limit in (1, 4, 200):
        want = set()
        for i, text in enumerate(texts):
            terms = text.split()
            need = len(terms) if len(terms) <= 2 else -(-2 * len(terms) // 3)
            found = []
            for _, path, seq, name, _, line, doc, exported in rows:
                n = sum(t in f"{name}\n{doc}\n{path}" for t in terms)
                if n:
                    found.append((n, -sum(t in name for t in terms), not exported, -sum(t in doc for t in terms), path, line, seq))
            kept = [f for f in found if f[0] == len(terms)] or [f for f in found if need < len(terms) and f[0] >= need]
            want |= {(i, f[6], -f[1], -f[3], rank) for rank, f in enumerate(sorted(kept, key=lambda f: f[1:])[:limit], 1)}
        got = code.search_symbols(symbols, files, queries, limit).select("query_id", "seq", "name_hits", "doc_hits", "rank")
        assert {tuple(r) for r in got.collect()} == want


def test_queries_meet_groups_of_symbols(spark, monkeypatch):
    """Symbols in which the same words are found meet the queries as one group of at most ``limit`` members."""
    symbols = spark.range(500).select(
        F.lit("m").alias("checkout"), F.concat(F.lit("p"), "id").alias("file_path"), F.col("id").alias("seq"), F.lit("jar").alias("name"),
        F.lit("function").alias("kind"), F.lit(1).alias("line"), F.lit("").alias("doc"), F.lit(True).alias("exported"))
    files = spark.createDataFrame([], "checkout string, path string, package_name string")
    queries = spark.range(20).select(F.col("id").alias("query_id"), F.lit("m").alias("checkout"), F.lit("jar").alias("text"))
    written, cut = [], code.cut_lineage
    monkeypatch.setattr(code, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    found = code.search_symbols(symbols, files, queries, 7)
    assert written[0].select(F.size("members")).collect() == [(7,)] and written[1].count() == 20
    assert found.count() == 140
