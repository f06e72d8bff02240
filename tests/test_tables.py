"""Snapshot writes, embedding tables, links, sources and exports."""

import datetime as dt
import os

import pytest
from helpers import T0, query, records, vectors
from pyspark.sql import functions as F

from shelfspark.functions import records as R
from shelfspark.operators import embedding as E
from shelfspark.operators import links as K
from shelfspark.operators import sizing
from shelfspark.operators import tables as W
from shelfspark.operators.excerpts import excerpt
from shelfspark.operators.keyword import build_index
from shelfspark.plans.search import get_record, search_with_links
from shelfspark.sources import commits as C
from shelfspark.sources import documents as D
from shelfspark.sources import exports as X
from shelfspark.sources.file_tree import write_files
from shelfspark.sources import snapshots as S
from shelfspark.sources import tree as T

def later():
    return F.lit(T0 + dt.timedelta(days=1)).cast("timestamp")


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_upsert_keeps_created_and_ignores_equal_hash(spark):
    base = records(spark, dict(id="a", body="old"), dict(id="b", body="same"))
    hour = T0 + dt.timedelta(hours=1)
    updates = records(
        spark, dict(id="a", body="new", created_at=hour), dict(id="b", body="same", slug="lost", created_at=hour),
        dict(id="fresh", source_path="b2.md", body="x", created_at=None), dict(id="renamed", source_path="a.md", body="newest", created_at=None),
    ).drop("updated_at").withColumn("seq", F.when(F.col("id") == "renamed", 2).otherwise(1))
    got = by_id(W.upsert_records(base, updates, later()))
    assert set(got) == {"a", "b", "fresh"}
    assert got["a"].body == "newest" and got["a"].created_at == T0 and got["a"].updated_at > T0
    assert got["b"].slug == "b" and got["b"].updated_at == T0


def test_retire_twice_keeps_first_target(spark):
    base = records(spark, dict(id="a"), dict(id="b"))
    target = spark.createDataFrame([("a", "b")], "id string, superseded_by string")
    once = W.retire(base, target, later())
    twice = W.retire(once, target.withColumn("superseded_by", F.lit("c")), later())
    row = by_id(twice)["a"]
    assert (row.status, row.superseded_by) == ("superseded", "b")


def test_import_by_id_keeps_path_and_checkout(spark):
    base = records(spark, dict(id="a", title="old", checkout="/repo"), dict(id="p", source_path="docs/p.md", body="x"))
    docs = records(
        spark, dict(id="a", title="new", source_path="moved.md"), dict(id="q", source_path="docs/p.md", body="y"), dict(id="n", body="z"),
    ).drop("updated_at")
    snapshot, summary = W.import_merge(base, docs, later())
    got = by_id(snapshot)
    assert (got["a"].title, got["a"].source_path, got["a"].checkout, got["a"].created_at) == ("new", "a.md", "/repo", T0)
    assert set(got) == {"a", "p", "n"} and got["p"].body == "y"
    assert {r.action: r.n for r in summary.collect()} == {"updated": 2, "imported": 1}
    assert {r.action: r.n for r in W.import_merge(snapshot, docs.where("id = 'a'"), later())[1].collect()} == {"skipped": 1}


def test_remember_defaults(spark):
    drafts = records(spark, dict(id="", title="My Note!", slug="", source_path="", status=""), dict(id="", title="Dev", slug="", source_path="", scope="dev", checkout="/x")).drop("updated_at")
    got = {r.title: r for r in W.remember(records(spark, dict(id="z")), drafts, "/repo", later()).collect()}
    assert (got["My Note!"].slug, got["My Note!"].source_path, got["My Note!"].checkout) == ("my-note", "records/my-note.md", "/repo")
    assert got["My Note!"].id.startswith("rec_") and got["My Note!"].status == "accepted"
    assert (got["Dev"].source_path, got["Dev"].checkout) == ("user/dev.md", "")


def test_keep_set(spark):
    base = spark.createDataFrame([("aaa",), ("bbb",)], "hash string")
    keep = spark.createDataFrame([("bbb",)], "hash string")
    assert W.keep_only(base, keep, ["hash"]).count() == 1
    assert W.keep_only(base, keep.where("false"), ["hash"]).count() == 0


def test_duplicate_merge_raises(spark):
    one, two = records(spark, dict(id="a")), records(spark, dict(id="a"), dict(id="b"))
    with pytest.raises(ValueError, match="record a"):
        W.merge_tenant(one, two, "/x")
    assert by_id(W.merge_tenant(one, two.where("id = 'b'"), "/x"))["b"].checkout == "/x"


def test_commit_window(spark):
    rows = [("", "new", T0), ("", "old", T0 - dt.timedelta(days=1))]
    dump = spark.createDataFrame(rows, "checkout string, hash string, authored_at timestamp")
    assert [r.hash for r in W.index_commits(dump, dump, 1).collect()] == ["new"]


def test_embed_flow(spark):
    recs = records(spark, *[dict(id=f"r{i}", body="bad" if i == 0 else "ok") for i in range(20)])
    items = E.worklist_items(recs)
    plain = E.hash_embedder(4)

    def flaky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("model is down")
        return plain(texts)

    none = spark.createDataFrame([], "key string, text_hash string, model string, dim int, embedding array<float>")
    done = E.embed(E.embed_worklist(items, none, "m", 4), flaky, batch=6)
    stored = E.store_vectors(none, done, "m")
    assert stored.count() == 19
    assert [r.key for r in E.embed_worklist(items, stored, "m", 4).collect()] == ["r0"]
    assert E.embed_worklist(items, stored, "other", 4).count() == 20
    status = R.with_content_hash(recs.withColumn("status", F.lit("deprecated")))
    assert E.embed_worklist(E.worklist_items(status), stored, "m", 4).count() == 1
    attempts = spark.createDataFrame([("r0", 3, None, "queued")], "key string, attempts int, last_error string, state string")
    for want in ((4, "queued"), (5, "giveup")):
        attempts = E.apply_results(attempts, done)
        row = attempts.first()
        assert (row.attempts, row.state, row.last_error) == (*want, "model is down")
    again = E.requeue_rewritten(attempts, items)
    assert (again.first()["attempts"], again.first()["state"]) == (0, "queued")
    assert E.requeue_rewritten(again, items).first()["attempts"] == 0


def test_file_text_stops_per_group(spark):
    rows = [("", "f", i, n, "k", i, d, e) for i, (n, d, e) in enumerate([("long", "x" * 60, True), ("next", "", True), ("s", "", False), ("é", "d\nmore", False)])]
    df = spark.createDataFrame(rows, "checkout string, file_path string, seq int, name string, kind string, line int, doc string, exported boolean")
    assert E.file_embed_text(df, 40).first()["text"] == "file: f\ns (k)\né (k) — d\n"
    assert E.file_embed_text(df).first()["text"].startswith("file: f\nlong (k) — xxx")


def links(spark, *rows):
    return spark.createDataFrame(rows, "kind string, from_checkout string, from_id string, to_root string, to_id string")


def test_link_checks_and_inserts(spark):
    recs = records(spark, dict(id="a"), dict(id="b"))
    delta = links(
        spark, ("record", "", "a", "/b", "b"), ("record", "", "a", "/b", "b"), ("pin", "", "", "/b", "a"), ("repo", "", "a", "/b", ""),
        ("record", "", "a", "/a", "b"), ("record", "", "a", "/b", "zz"), ("pin", "", "a", "/b", "b"), ("what", "", "a", "/b", "b"),
    )
    table, bad = K.add_links(links(spark).limit(0), delta, recs, "/a")
    assert [r.kind for r in K.list_links(table).collect()] == ["pin", "record", "repo"]
    assert bad.count() == 4
    assert K.remove_links(table, table.limit(1)).count() == 2 and K.remove_links(table, links(spark, ("pin", "x", "", "y", "z"))).count() == 3


def test_search_follows_links(spark):
    recs = records(
        spark, dict(id="hit", body="billing plan", applies_to=["x/*"]), dict(id="linked", body="far billing text", slug="l", applies_to=["src/*.go"]),
        dict(id="there", body="billing", checkout="/b", slug="t"), dict(id="elsewhere", body="billing", checkout="/c", slug="e"),
    )
    table = links(
        spark, ("pin", "/a", "", "/b", "linked"), ("pin", "/z", "", "/b", "linked"), ("record", "", "hit", "/b", "gone"), ("repo", "/a", "hit", "/b", ""),
        ("record", "/a", "linked-not-hit", "/b", "linked"),
    )
    code = spark.createDataFrame([("/b", "src/a.go", "package a"), ("/b", "src/b.txt", "no")], "checkout string, path string, content string")
    out = search_with_links(build_index(recs), vectors(spark, {"hit": [1, 0]}), query(spark, "billing", checkout="/a"), recs, table, code)
    got = {(r.kind, r.from_checkout): r for r in out["links"].collect()}
    assert set(got) == {("pin", "/a"), ("record", ""), ("repo", "/a")}
    assert got["pin", "/a"].record.slug == "l" and got["pin", "/a"].snippet == "far billing text"
    assert got["record", ""].missing == "record links: record gone not found"
    assert {r.record_id for r in out["link_hits"].collect()} == {"hit", "linked", "there"}
    assert [(r.path, r.text, r.omitted) for r in out["excerpts"].collect()] == [("src/a.go", "package a", False)]
    rootless = search_with_links(build_index(recs), vectors(spark, {"hit": [1, 0]}), query(spark, "billing", checkout=""), recs, table)
    assert {r.kind for r in rootless["links"].collect()} == {"record", "repo"}


def test_excerpt_budget(spark):
    rows = [(1, link, f"f{i}", "é" * 20) for link in (1, 2) for i in range(6)]
    df = spark.createDataFrame(rows, "query_id int, link_pos int, path string, content string")
    got = excerpt(df, per_record=4, per_file=11, total=55).orderBy("link_pos", "path").collect()
    assert [(r.link_pos, len(r.text), r.omitted) for r in got] == [(1, 5, True)] * 4 + [(2, 5, True), (2, 2, True)]


def test_get_record(spark):
    recs = records(spark, dict(id="a", slug="s"), dict(id="b", slug="s"), dict(id="far", slug="remote", checkout="/b"))
    table = links(spark, ("repo", "", "a", "/b", ""), ("record", "", "a", "/b", "gone"), ("pin", "", "", "/b", "b"))
    keys = spark.createDataFrame([("s",), ("b",), ("remote",), ("none",)], "key string")
    out = get_record(recs, table, keys, home="/a")
    assert {(r.key, r.id, r.found_by) for r in out["records"].collect()} == {("s", "a", "slug"), ("b", "b", "id"), ("remote", "far", "link")}
    assert {(r.kind, r.missing) for r in out["links"].collect()} == {("repo", None), ("record", "record links: record gone not found")}


DOC = """---
id: rec_1
type: rule
severity: must-not
# a comment
title: "First: title"
title: 'Second'
applies_to: ["src/**", docs/*.md]
bad line
---

# Head

Body: text
"""


def test_read_documents(spark, tmp_path):
    for rel, content in {"a/one.md": DOC, "a/two.MD": "---\ntype: map\n---\nno id", "b.txt": DOC, "c/no.md": "plain", "open.md": "---\nid: x\nnever closed"}.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(content)
    rows = D.read_documents(spark, {str(tmp_path): "repo"}, "/repo").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.id, r.type, r.severity, r.title, r.slug, r.source_path, r.checkout) == ("rec_1", "rule", "must-not", "Second", "one", "a/one.md", "/repo")
    assert r.applies_to == ["src/**", "docs/*.md"] and r.body == "# Head\n\nBody: text" and r.violations == [] and r.status == "accepted"
    dev = D.read_documents(spark, {str(tmp_path): "dev"}).first()
    assert (dev.scope, dev.source_path, dev.checkout) == ("dev", "user/a/one.md", "")


def test_export_files_read_back(spark, tmp_path):
    recs = records(
        spark, dict(id="a", title='He said: "x"', body="text\n", tags=["t:1", "u"], severity="must", type="rule"), dict(id="b", type="map", body="# H"),
    )
    folder = str(tmp_path / "out")
    written = X.export_files(recs, folder).collect()
    assert {r.rel_path for r in written} == {"records/repo/rule/a.md", "records/repo/map/b.md"} and all(r.bytes > 40 for r in written)
    back = by_id(D.read_documents(spark, {folder: "repo"}))
    assert (back["a"].body, back["a"].severity, back["b"].type) == ("text", "must", "map")
    # a later export replaces the tree; nothing else is left beside it
    assert [r.rel_path for r in X.export_files(recs.where("id = 'b'"), folder).collect()] == ["records/repo/map/b.md"]
    assert os.listdir(tmp_path) == ["out"]


def test_a_failed_export_leaves_the_old_tree(spark, tmp_path):
    folder = str(tmp_path / "out")
    write_files(spark.createDataFrame([("a/x.md", "old")], "rel_path string, content string"), folder)
    bad = spark.createDataFrame([(f"a/{i}.md", "new") for i in range(20)] + [("../x.md", "new")], "rel_path string, content string").repartition(4)
    with pytest.raises(Exception, match="not a path inside the folder"):
        write_files(bad, folder)
    assert os.listdir(tmp_path) == ["out"] and os.listdir(f"{folder}/a") == ["x.md"]
    write_files(bad.limit(0), folder)
    assert os.listdir(folder) == []


def test_export_archive(spark, tmp_path):
    recs = records(spark, dict(id="b", title="B", type="map"), dict(id="a", title="A", type="map"))
    symbols = spark.createDataFrame([("f", 2, 1, "n", "k"), ("f", 1, 0, "m", "k")], "file_path string, line int, seq int, name string, kind string")
    X.export_archive(recs, symbols, str(tmp_path))
    index = [r.value for r in spark.read.text(f"{tmp_path}/index").collect()]
    assert index == ["- [A](records/repo/map/a.md) (accepted)", "- [B](records/repo/map/b.md) (accepted)"]
    assert spark.read.text(f"{tmp_path}/digests/file=rules.md").first()["value"] == "# Rules"
    assert [r.value for r in spark.read.text(f"{tmp_path}/map").collect()] == ["## f", "- `m` (k) line 1", "- `n` (k) line 2"]
    assert spark.read.text(f"{tmp_path}/manifest").count() == 2


def test_tree_scan(spark, tmp_path):
    for rel, content in {"src/a.go": b"package a", "src/b.bin": b"\x00\x01", "build/x.go": b"x", "logo.png": b"p", "records/r.md": b"r", "gen/a.pb.go": b"g"}.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(content)
    ignore = spark.createDataFrame([("", 0, "build/")], "dir string, line_no int, line string")
    tree = T.read_tree(spark, str(tmp_path), ignore, ("*.pb.go",), "/repo")
    assert [(r.checkout, r.path, r.content) for r in tree.select("checkout", "path", "content").collect()] == [("/repo", "src/a.go", "package a")]
    assert [r.path for r in T.list_files(tree).collect()] == ["src/a.go"]


def test_commit_dumps(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("\x1eh1\x1fAnn\x1f2026-01-02T03:04:05+01:00\x1fsubject\x1fbody\nline\n\x1eh2\x1fBob\x1fnever\x1fs2\n\x1eshort\x1fx\n")
    rows = {r.hash: r for r in C.read_commit_log(spark, str(log)).collect()}
    assert set(rows) == {"h1", "h2"} and rows["h2"].authored_at is None and rows["h2"].body == ""
    assert rows["h1"].authored_at == dt.datetime(2026, 1, 2, 2, 4, 5) and rows["h1"].body == "body\nline"
    changed = tmp_path / "changes"
    changed.write_text("\x1e2026-01-02T03:04:05Z\x1fh1\x1f\na.go\nb.go\n\x1e2026-01-03T03:04:05Z\x1fh2\x1f\na.go\n")
    assert sorted((r.change_id, r.path) for r in C.read_changes(spark, str(changed)).collect()) == [("h1", "a.go"), ("h1", "b.go"), ("h2", "a.go")]


def test_snapshots(spark, tmp_path):
    base = str(tmp_path / "t")
    assert S.read_snapshot(spark, base) is None
    S.write_snapshot(spark.range(2), base, 1)
    S.write_snapshot(spark.range(5), base, 2)
    (tmp_path / "t" / "v9").mkdir()
    assert S.read_snapshot(spark, base).count() == 5 and S.read_snapshot(spark, base, 2).count() == 2


def test_index_files_only_touches_changes(spark):
    from shelfspark.operators.extract import extract
    from shelfspark.schemas import EDGES, SYMBOLS

    def tree(rows):
        return spark.createDataFrame([("", p, c) for p, c in rows], "checkout string, path string, content string").withColumn("content_hash", F.sha2("content", 256))

    seen = []

    def spy(df):
        seen.append(sorted(r.path for r in df.collect()))
        return extract(df, {})

    empty = {"files": spark.createDataFrame([], "checkout string, path string, content_hash string"), "symbols": spark.createDataFrame([], SYMBOLS), "edges": spark.createDataFrame([], EDGES)}
    first = W.index_files(empty["files"], empty["symbols"], empty["edges"], tree([("a.zig", "fn one()"), ("b.zig", "fn two()"), ("gone.zig", "fn old()")]), spy)
    second = W.index_files(first["files"], first["symbols"], first["edges"], tree([("a.zig", "fn one()"), ("b.zig", "import x")]), spy)
    assert seen == [["a.zig", "b.zig", "gone.zig"], ["b.zig"]]
    assert [r.name for r in second["symbols"].collect()] == ["one"] and [r.to_path for r in second["edges"].collect()] == ["x"]
    assert sorted(r.path for r in second["files"].collect()) == ["a.zig", "b.zig"]
    W.index_files(second["files"], second["symbols"], second["edges"], tree([("a.zig", "fn one()")]), spy, stale=True)
    assert seen[-1] == ["a.zig"]


def test_invalid_drafts_are_refused_and_told(spark):
    base = records(spark, {"id": "r1"})
    drafts = records(spark, {"id": "n1", "type": "nonsense"}, {"id": "n2"}).drop("updated_at")
    now = F.lit(T0).cast("timestamp")
    done = W.complete_drafts(drafts, "", now)
    accepted, refused = W.split_valid(done)
    assert [r.id for r in accepted.collect()] == ["n2"] and refused.first()["violations"] == ["invalid type"]
    assert sorted(r.id for r in W.remember(base, drafts, "", now).collect()) == ["n2", "r1"]
    keys = spark.createDataFrame([("r1",), ("gone",)], "id string")
    assert [r.id for r in W.not_found(base, keys).collect()] == ["gone"]


def test_repeated_keys_without_order_agree(spark):
    rows = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "c")], "key string, v string")
    got = {W.last_per(rows.repartition(n), ["key"]).first()["v"] for n in (1, 2, 3)}
    assert got == {"c"}


@pytest.mark.parametrize("small", [True, False])
def test_repeated_and_null_keys_keep_their_last_row(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(W, "is_small", lambda df: False)
    data = [("a", None, 1), ("a", None, 2), (None, None, 3), (None, None, 4), ("a", "x", 5), ("b", "x", 6), ("b", "y", 7)]
    got = W.last_per(spark.createDataFrame(data, "k string, l string, v int").repartition(3), ["k", "l"])
    assert sorted(r.v for r in got.collect()) == [2, 4, 5, 6, 7]


def test_rows_of_keys_that_are_not_repeated_are_neither_shuffled_nor_sorted(spark):
    data = [("a", "r1"), ("b", "r1"), ("b", "r2"), (None, "r1")]
    assert not any(x in _plan(W.last_per(spark.createDataFrame(data, "k string, body string"), ["k", "body"])) for x in ("Window", "Exchange", "Sort"))
    base = records(spark, {"id": "a", "body": "old"}, {"id": "b"}).coalesce(1)
    plan = W.plan_updates(base, spark.createDataFrame([("a", "new")], "id string, title string"), later())
    assert "Window" not in _plan(plan)
    after = by_id(W.apply_plan(base, plan))
    assert (after["a"].title, after["a"].body, after["b"].title) == ("new", "old", "b")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_side_measured_as_large_is_never_broadcast(spark, monkeypatch, how):
    rows = spark.createDataFrame([(n % 7, n) for n in range(40)], "k int, v int")
    keys = spark.range(5).select(F.col("id").cast("int").alias("k"))
    monkeypatch.setattr(sizing, "is_small", lambda df: False)
    found = sizing.lookup_join(rows, keys, ["k"], how)
    assert "Broadcast" not in _plan(found)
    assert sorted(found.select("v").collect()) == sorted(rows.join(keys, "k", how).select("v").collect())


def test_indexing_files_broadcasts_no_table(spark):
    from shelfspark.schemas import EDGES, SYMBOLS

    schema = "checkout string, path string, content_hash string"
    files = spark.createDataFrame([("", "a", "1"), ("", "b", "1"), ("", "gone", "1")], schema)
    tree = spark.createDataFrame([("", "a", "1", "x"), ("", "b", "2", "y"), ("", "c", "1", "z")], schema + ", content string")
    none = spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], EDGES)
    seen = []
    out = W.index_files(files, *none, tree, lambda df: seen.append(df) or none)
    assert "Broadcast" not in _plan(seen[0]) and "Broadcast" not in _plan(W.prune_unseen(files, tree))
    assert sorted(tuple(r) for r in out["files"].collect()) == [("", "a", "1"), ("", "b", "2"), ("", "c", "1")]
