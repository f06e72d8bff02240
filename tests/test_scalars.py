"""Literal cases for scalar expressions."""

import time

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import logs as L
from shelfspark.functions import paths as P
from shelfspark.functions import records as R
from shelfspark.functions import text as X
from shelfspark.functions.stemming import porter


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    data = [tuple(v for _, v in values.values()) or (1,)]
    return spark.createDataFrame(data, schema).select(column.alias("out")).first()["out"]


def text(spark, fn, value):
    return one(spark, fn(F.col("v")), v=("string", value))


@pytest.mark.parametrize("value,want", [
    ("", []), ("   ", []), ("/", []), ("***", []), ("docs/decisions/foo.md", ["docs", "decisions", "foo", "md"]),
    ("qwen3-embedding:0.6b", ["qwen3", "embedding", "0", "6b"]), ("foo AND bar", ["foo", "AND", "bar"]),
    ("NEAR(foo, bar)", ["NEAR", "foo", "bar"]), ("internal/**", ["internal"]),
])
def test_query_tokens(spark, value, want):
    assert text(spark, X.query_tokens, value) == want


def test_content_terms_keep_first_spelling(spark):
    assert text(spark, lambda c: X.content_terms(X.query_tokens(c)), "How the Store stores the STORE") == ["Store", "stores"]


@pytest.mark.parametrize("value,want", [("the", ["the"]), ("  % ", ["%"]), ("", []), ("Seal the Jar", ["seal", "jar"])])
def test_search_terms(spark, value, want):
    assert text(spark, X.search_terms, value) == want


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (6, 4)])
def test_min_should_match(spark, n, want):
    assert one(spark, X.min_should_match(F.col("n")), n=("int", n)) == want


@pytest.mark.parametrize("value,want", [("wax stamp notes", True), ("unique-token-beta", False), ("the unique-token-beta", False), ("two words", False)])
def test_partial_terms(spark, value, want):
    assert text(spark, lambda c: X.partial_terms_ok(c, F.size(X.search_terms(c))), value) is want


def test_literal_wildcards(spark):
    df = spark.createDataFrame([("has_underscore",), ("plain",), ("100%",)], "v string")
    assert [r.v for r in df.where(X.contains_term(F.col("v"), F.lit("_"))).collect()] == ["has_underscore"]
    assert [r.v for r in df.where(X.contains_term(F.col("v"), F.lit("%"))).collect()] == ["100%"]


def test_ascii_fold_only(spark):
    assert one(spark, X.contains_term(F.lit("Straße ÉTÉ"), F.lit("STRA"))) is True
    assert one(spark, X.contains_term(F.lit("été"), F.lit("É"))) is False


def test_snippet_lead(spark):
    out = text(spark, lambda c: X.snippet(c, X.search_terms(F.lit("retrieve"))), "á" * 300 + " retrieve")
    assert out.startswith("...") and out[3:].index("retrieve") == 80


def test_match_snippet_prefers_most_terms(spark):
    body = " ".join(["pad"] * 50 + ["alpha"] + ["pad"] * 60 + ["beta", "alpha"] + ["pad"] * 50)
    out = text(spark, lambda c: X.match_snippet(c, F.array(F.lit("alpha"), F.lit("beta"))), body)
    assert out.startswith("...beta alpha") and out.endswith("...")


def test_best_passage_cost_follows_the_words():
    """Windows full of other terms cost no more a hit than windows full of one."""
    def seconds(words):
        start = time.process_time()
        X._best_passage(" ".join(words), set(words), 400)
        return time.process_time() - start

    one, many = ["alpha"] * 20_000, [f"w{i % 397}" for i in range(20_000)]
    assert min(seconds(many) for _ in range(3)) < 2 * min(seconds(one) for _ in range(3))
    assert X._best_passage("Ñandú_x, _-_ café; ΣΑΣ fin", ("nandux", "cafe", "σας"), 3) == "Ñandú_x, _-_ café;..."
    assert X._best_passage("a b a c a d", ("a", "c", "d"), 2) == "...a c..."


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"),
    ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"),
    ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
    ("conditional", "condit"), ("decisions", "decis"), ("decision", "decis"), ("vietnamization", "vietnam"), ("predication", "predic"),
    ("operator", "oper"), ("feudalism", "feudal"), ("hopefulness", "hope"), ("formaliti", "formal"), ("triplicate", "triplic"),
    ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustable", "adjust"), ("replacement", "replac"),
    ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"),
])
def test_porter_published_samples(word, stem):
    assert porter(word) == stem


def test_query_prefix(spark):
    assert one(spark, X.query_for_embedding(F.lit(" QWEN3-embedding:8b"), F.lit("q"))).endswith("Query:q")
    assert one(spark, X.query_for_embedding(F.lit("other"), F.lit("q"))) == "q"


def test_embed_text(spark):
    none, tags = F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("b"))
    empty = F.array().cast("array<string>")
    got = one(spark, R.embed_text(F.lit("T"), F.lit("rule"), F.lit("repo"), none, tags, empty, F.lit(" body \n")))
    assert got == "Title: T\nType: rule\nScope: repo\nTags: a, b\n\nbody"


@pytest.mark.parametrize("body,want", [
    ("x\n  # Head line \ny", "Head line"), ("", "Untitled"), ("short", "short"), ("é" * 60, "é" * 40 + "..."), ("a" + "é" * 60, "a" + "é" * 39 + "..."),
])
def test_title(spark, body, want):
    assert text(spark, R.title_from_body, body) == want


@pytest.mark.parametrize("value,want", [
    ("", []), ("[]", []), ("one", ["one"]), ('[a, "b c", \'d\']', ["a", "b c", "d"]), ('["a,b"]', ['"a', 'b"']), ("[ , x]", ["x"]),
])
def test_inline_list(spark, value, want):
    assert text(spark, R.inline_list, value) == want


@pytest.mark.parametrize("value,want", [("Hello,  World!", "hello-world"), ("--", ""), ("Ünï 9", "n-9")])
def test_slugify(spark, value, want):
    assert text(spark, R.slugify, value) == want


@pytest.mark.parametrize("value,want", [("a/b/foo.tar.md", "foo.tar"), ("foo", "foo"), ("user/x.md", "x")])
def test_slug_from_path(spark, value, want):
    assert text(spark, R.slug_from_path, value) == want


@pytest.mark.parametrize("value,want", [("user/a.md", "dev"), ("global/a.md", "global"), ("users/a.md", ""), ("records/a.md", "")])
def test_scope_from_path(spark, value, want):
    assert text(spark, R.scope_from_path, value) == want


@pytest.mark.parametrize("value,want", [
    (".", True), ("", True), ("/etc", True), ("../x", True), ("a/../../x", True), ("a/..", True), ("a/../b", False), ("a/b", False),
])
def test_escapes_root(spark, value, want):
    assert text(spark, P.escapes_root, value) is want


@pytest.mark.parametrize("value,want", [("src/*.go", "src"), ("/src/x", "src"), ("**/x", None), ("*.go", None), ("s?c/x", None), ("*src/x", "src")])
def test_anchored_segment(spark, value, want):
    assert text(spark, P.anchored_segment, value) == want


def test_scope_membership(spark):
    assert one(spark, P.is_under(F.lit("a/b"), F.lit(""))) is False
    assert one(spark, P.in_scope(F.lit("a/b"), F.lit("."))) is True
    assert one(spark, P.in_scope(F.lit("ab/c"), F.lit("/a/"))) is False


def test_path_list(spark):
    assert text(spark, P.split_path_list, "a, b\nc") == ["a", "b", "c"]


DIFF = '''diff --git a/internal/store/old.go b/internal/store/old.go
--- a/internal/store/old.go
+++ /dev/null
@@ -1 +0,0 @@
diff --git "a/docs/with \\"q\\".md" "b/docs/with \\"q\\".md"
diff --git a/cmd/new.go b/cmd/new.go
--- /dev/null
+++ b/cmd/new.go\t2026-01-01
--- not a header but read as one
'''


def test_diff_paths(spark):
    got = text(spark, P.diff_paths, DIFF)
    assert set(got) == {"internal/store/old.go", "cmd/new.go", 'docs/with "q".md', "not a header but read as one"}
    assert text(spark, P.diff_paths, "") == []


def test_diff_paths_read_a_header_once(spark):
    plan = spark.createDataFrame([(DIFF,)], "d string").select(P.diff_paths(F.col("d")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(", 12, ") == 1
    odd = "x diff --git a/n b/n\n+line\n\ndiff --git a/p b/p\r\r\n+++ b/q\tnow\n--- dev/null\n +++ b/r"
    assert text(spark, P.diff_paths, odd) == ["p", "q"]


def test_log_times(spark):
    nanos = text(spark, L.log_nanos, "2026-01-02T03:04:05.123456789Z")
    assert nanos % 1_000_000_000 == 123456789
    assert text(spark, L.log_nanos, "2026-01-02T03:04:05Z") % 1_000_000_000 == 0
    assert text(spark, L.log_time, "yesterday") is None


@pytest.mark.parametrize("value,want", [("shelf search", "search"), ("get", "get"), (" a b c ", "c")])
def test_base_command(spark, value, want):
    assert text(spark, L.base_command, value) == want


@pytest.mark.parametrize("kind,to,want", [
    ("repo", "/x", ("/x", "")), ("record", "/a#b#id", ("/a#b", "id")), ("pin", "#id", None), ("record", "/a#", None), ("other", "/a#x", None), ("repo", " ", None),
])
def test_link_target(spark, kind, to, want):
    got = one(spark, L.link_target(F.lit(kind), F.lit(to)))
    assert (tuple(got) if got else None) == want


def test_clip_keeps_characters_whole(spark):
    got = one(spark, L.clip_json(F.lit('"' + "é" * 40 + '"'), 20))
    assert '"truncated":true' in got and '"bytes":82' in got


def test_patch_and_validation(spark):
    assert one(spark, R.patched(F.lit(""), F.lit("old"))) == "old"
    bad = R.violations(F.lit("memo"), F.lit(""), F.lit(""), F.lit(None).cast("string"), F.lit(""), F.lit("."))
    assert one(spark, bad) == ["invalid type", "scope is required", "title is required", "slug is required"]
    severe = R.violations(F.lit("rule"), F.lit("repo"), F.lit("accepted"), F.lit("often"), F.lit("t"), F.lit("s"))
    assert one(spark, severe) == ["invalid severity"]
