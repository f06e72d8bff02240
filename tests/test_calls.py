"""Log pairing, trace sections and the review clock."""

import datetime as dt
import json
import random
import re
from collections import deque

import pytest
from helpers import T0, records
from pyspark.sql import functions as F

from shelfspark.operators import calls as K
from shelfspark.operators.scan import exists_within
from shelfspark.plans.review import review, review_due
from shelfspark.plans.trace import trace
from shelfspark.sources.command_log import append_log, read_command_log


def write_log(path, entries, tail="\n"):
    path.write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries) + tail)
    return str(path)


def stamp(minutes, extra=""):
    return (T0 + dt.timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S") + extra + "Z"


def call(ident, command, minutes, args=None, result=None, error=None, source="mcp"):
    first = {"id": ident, "ts": stamp(minutes), "dir": "in", "source": source, "command": command, "args": args}
    last = {"id": ident, "ts": stamp(minutes), "dir": "out", "source": source, "command": command, "result": result}
    return [first, {**last, "error": error} if error else last]


def load(spark, tmp_path, entries):
    return K.pair_calls(read_command_log(spark, write_log(tmp_path / "log.jsonl", entries)))


DIGEST = (
    call("c1", "shelf search", 0, {"query": "hit"}, [{"id": "rec_a", "source": "fts", "status": "superseded", "title": "A"}])
    + call("c2", "shelf search", 1, {"args": ["no", "hits"]}, [])
    + call("c3", "shelf search", 2, {"query": "big"}, {"truncated": True, "bytes": 9})
    + call("c4", "shelf get", 3, None, {"ID": "rec_a", "Title": "A"})
    + call("c5", "shelf get", 4, None, {"id": "rec_b"})
    + call("c6", "shelf remember", 5, {"title": "early"}, {"id": "rec_n"})
    + call("c7", "shelf remember", 40, {"flags": {"title": "late"}}, {"id": "rec_m"})
    + call("c8", "shelf check", 41, None, {"matches": [{"record": {"id": "rec_c"}, "reason": "applies_to", "severity": "must"}]})
    + call("c9", "shelf cite", 42, {"args": ["rec_a"], "flags": {"effect": "used"}}, {})
    + call("c10", "shelf index", 43)
)


def test_digest(spark, tmp_path):
    out = trace(load(spark, tmp_path, DIGEST))
    kinds = {r["query"]: r for r in out["searches"].collect()}
    assert (kinds["hit"].kind, kinds["no hits"].kind, kinds["big"].kind) == ("hits", "empty", "truncated")
    assert kinds["hit"].keyword_only and kinds["hit"].superseded_top and not kinds["hit"].vector_only
    assert {(r.id, r.found) for r in out["gets"].collect()} == {("rec_a", True), ("rec_b", False)}
    assert [r.title for r in out["remembers_without_search"].collect()] == ["late"]
    rate = out["citation_rate"].first()
    assert (rate.cited, rate.retrieved) == (1, 3)
    assert {r.name: r.n for r in out["counts"].collect()} == {"search": 3, "get": 2, "remember": 2, "check": 1, "cite": 1}
    assert [(r.id, r.effect) for r in out["cites"].collect()] == [("rec_a", "used")]
    assert [(r.id, r.reason, r.severity) for r in out["check_matches"].collect()] == [("rec_c", "applies_to", "must")]


def test_sections_read_stored_calls_only(spark, tmp_path):
    """The log is paired once: every section is a scan of the typed calls with the columns it needs."""
    out = trace(load(spark, tmp_path, DIGEST))
    for name, section in out.items():
        files = section.inputFiles()
        assert files and all("/typed-calls-" in f for f in files), name
    plan = out["counts"]._jdf.queryExecution().toString()
    assert "ReadSchema: struct<checkout:string,name:string>" in plan
    assert "variant" not in plan.lower()


def test_out_of_order_ids(spark, tmp_path):
    stuck = {"ts": stamp(0), "dir": "in", "command": "search", "args": {"query": "stuck"}}
    a, b = call("c_a", "search", 1, {"query": "alpha"}, []), call("c_b", "search", 2, {"query": "beta"}, [{"id": "r", "source": "fts"}])
    calls = load(spark, tmp_path, [stuck, a[0], b[0], b[1], a[1]])
    got = {r["query"]: (r.kind, r.keyword_only) for r in trace(calls)["searches"].collect()}
    assert got == {"alpha": ("empty", False), "beta": ("hits", True)}


def test_second_out_stands_alone(spark, tmp_path):
    a = call("c_a", "get", 1, None, {"id": "x"})
    calls = load(spark, tmp_path, [a[0], a[1], a[1]])
    assert sorted((r.seq, r.has_out) for r in calls.collect()) == [(1, True), (3, True)]


def test_vector_only_hits_follow_but_are_not_consulted(spark, tmp_path):
    log = call("c1", "search", 0, {"query": "q"}, {"results": [{"id": "v", "source": "vector"}]}) + call("c2", "get", 5, None, {"id": "v"})
    out = trace(load(spark, tmp_path, log))
    assert out["gets"].first()["found"] is True
    used = K.uses(K.reported_calls(load(spark, tmp_path, log[:2])))
    assert used.count() == 0


def test_window_bounds_are_inclusive(spark, tmp_path):
    calls = load(spark, tmp_path, DIGEST)
    bounds = [F.lit(T0 + dt.timedelta(minutes=m)).cast("timestamp") for m in (3, 5)]
    assert {r.name: r.n for r in K.call_counts(K.reported_calls(calls, *bounds)).collect()} == {"get": 2, "remember": 1}


def test_torn_last_line_and_bad_line(spark, tmp_path):
    path = write_log(tmp_path / "torn.jsonl", [*DIGEST[:2], "", '{"id": "x'], tail="")
    assert read_command_log(spark, path).count() == 2
    bad = write_log(tmp_path / "bad.jsonl", [DIGEST[0], "{nope", DIGEST[1]])
    with pytest.raises(Exception, match="command log line 2"):
        read_command_log(spark, bad).collect()


def test_line_numbers_over_file_splits(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    write_log(path, [{"id": f"c{i}", "dir": "in", "command": "get", "ts": stamp(0)} for i in range(500)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = read_command_log(spark, str(path)).select("line_no", "id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line_no, r.id) for r in rows) == [(i + 1, f"c{i}") for i in range(500)]


def test_append_and_read_back(spark, tmp_path):
    rows = [(f"id{i}" if i else None, "cli", "shelf get", '{"id": "r"}', json.dumps({"text": "x" * 70000 * i}), None, T0, T0 + dt.timedelta(seconds=i)) for i in range(2)]
    schema = "id string, source string, command string, args string, result string, error string, started timestamp, finished timestamp"
    append_log(spark.createDataFrame(rows, schema), str(tmp_path / "log"))
    calls = K.pair_calls(read_command_log(spark, str(tmp_path / "log")).coalesce(1))
    got = calls.select("has_out", F.try_variant_get("result", "$.truncated", "boolean").alias("t")).collect()
    assert sorted((r.has_out, bool(r.t)) for r in got) == [(True, False), (True, True)]


def fifo(lines):
    queues, out = {}, []
    for checkout, name, line, direction in lines:
        q = queues.setdefault((checkout, name), deque())
        if direction == "in":
            q.append(line)
        else:
            out.append((checkout, q.popleft() if q else None, line))
    return out + [(c, x, None) for (c, _), q in queues.items() for x in q]


@pytest.mark.parametrize("block", [3, 7, 1 << 16])
def test_fifo_against_a_deque(spark, block):
    rng = random.Random(block)
    lines = [(rng.choice("ab"), rng.choice(["get", "get", "search"]), i, rng.choice(["in", "out"])) for i in range(400)]
    df = spark.createDataFrame(lines, "checkout string, name string, line_no long, dir string").repartition(4)
    got = {tuple(r) for r in K.pair_fifo(df, block).select("checkout", "in_line", "out_line").collect()}
    assert got == set(fifo(lines))


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_id_pairing_against_a_loop(spark, block):
    rng = random.Random(block)
    lines = [(rng.choice("abc"), i, rng.choice(["in", "out"])) for i in range(200)]
    slot, want = {}, set()
    for ident, line, direction in lines:
        if direction == "in":
            if ident in slot:
                want.add((slot[ident], None))
            slot[ident] = line
        else:
            want.add((slot.pop(ident, None), line))
    want |= {(x, None) for x in slot.values()}
    df = spark.createDataFrame([("", *x) for x in lines], "checkout string, id string, line_no long, dir string")
    assert {(r.in_line, r.out_line) for r in K.pair_by_id(df, block).collect()} == want


@pytest.mark.parametrize("span", [1, 5, 40])
def test_exists_within_against_a_loop(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice("xy"), i, rng.randrange(120)) for i in range(300)]  # time is not call order
    probes, events = [r for r in rows if r[1] % 2], [r for r in rows if not r[1] % 2]
    schema = "k string, seq long, at_us long"
    got = exists_within(spark.createDataFrame(probes, schema), spark.createDataFrame(events, schema), ["k"], span).collect()
    want = {p[1]: any(e[0] == p[0] and e[1] < p[1] and p[2] - span <= e[2] <= p[2] for e in events) for p in probes}
    assert {r.seq: r.found for r in got} == want


def test_review_clock(spark, tmp_path):
    log = (
        call("c1", "shelf review", 0, {}, {}) + call("c2", "shelf review", 10, {"flags": {"due": "TRUE"}}, {})
        + call("c3", "shelf review", 20, {}, None, "boom") + call("c4", "shelf review", 30, {}, {"is_error": True})
        + [{"id": "c5", "ts": stamp(40), "dir": "in", "command": "shelf review"}]
    )
    calls = load(spark, tmp_path, log)
    for days, due in ((7, True), (8, False)):
        row = review_due(calls, F.lit(T0 + dt.timedelta(days=7)).cast("timestamp"), days).first()
        assert row.last_review == T0 and row.due is due


def test_never_reviewed_is_due(spark, tmp_path):
    assert review_due(load(spark, tmp_path, DIGEST), F.lit(T0).cast("timestamp")).first()["due"] is True


def test_weekly_review(spark, tmp_path):
    recs = records(
        spark, dict(id="rec_a", type="rule", applies_to=["src/**"]), dict(id="rec_miss", type="rule", applies_to=["src/**"]),
        dict(id="stale", applies_to=["gone/**"]), dict(id="feat", type="feature", applies_to=["src/**"]),
        dict(id="gone_rule", type="rule", applies_to=["src/**"], status="deprecated"),
    )
    vecs = spark.createDataFrame(
        [("rec_a", "m", [1.0, 0.0]), ("feat", "m", [0.85, 0.526]), ("stale", "m", [0.0, 1.0])], "record_id string, model string, embedding array<float>"
    )
    commits = spark.createDataFrame([("", "h1", T0 + dt.timedelta(minutes=50), "src/a.go")], "checkout string, change_id string, at timestamp, path string")
    files = spark.createDataFrame([(f"src/{c}.go",) for c in "abcde"], "path string")
    none = spark.createDataFrame([], "checkout string, path string")
    now = F.lit(T0 + dt.timedelta(days=1)).cast("timestamp")
    out = review(load(spark, tmp_path, DIGEST), commits, none, files, recs, vecs, now)
    assert [r.record_id for r in out["missed_rules"].collect()] == ["rec_miss"]
    assert [r.id for r in out["stale_globs"].collect()] == ["stale"]
    assert [(r.record_id, len(r.files), r.omitted, r.changed) for r in out["features"].collect()] == [("feat", 4, 1, True)]
    assert [(r.a_id, r.b_id) for r in out["similar"].collect()] == [("feat", "rec_a")]
    assert out["unembedded"].first()["n"] == 1 and out["changed_paths"].first()["n_paths"] == 1


def test_weekly_review_reads_its_tables_once(spark, tmp_path):
    recs = records(spark, dict(id="rule", type="rule", applies_to=["src/**"], body="a body"), dict(id="feat", type="feature", applies_to=["src/**"]))
    vecs = spark.createDataFrame([("feat", "m", [1.0, 0.0])], "record_id string, model string, embedding array<float>")
    commits = spark.createDataFrame([("", "h1", T0 + dt.timedelta(minutes=50), "src/a.go")], "checkout string, change_id string, at timestamp, path string")
    files = spark.createDataFrame([("src/a.go",)], "path string")
    none = spark.createDataFrame([], "checkout string, path string")
    out = review(load(spark, tmp_path, DIGEST), commits, none, files, recs, vecs, F.lit(T0 + dt.timedelta(days=1)).cast("timestamp"))
    for name in ("missed_rules", "wide_slices", "changed_paths", "stale_globs", "features", "unembedded"):
        plan = out[name]._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"LogicalRDD \[(id#\d+, checkout#|checkout#\d+, change_id#)", plan), name  # neither records nor commits
    assert [r.record_id for r in out["features"].collect()] == ["feat"] and out["unembedded"].first()["n"] == 1


def test_several_files_of_two_checkouts(spark, tmp_path):
    for folder, offset in (("a", 0), ("b", 0)):
        for part in range(2):
            lines = []
            for i in range(2):
                at = T0 + dt.timedelta(seconds=100 * (1 - part) + 10 * i + offset)
                stamp = at.strftime("%Y-%m-%dT%H:%M:%SZ")
                ident = f"{folder}{part}{i}"
                lines += [json.dumps({"id": ident, "ts": stamp, "dir": d, "source": "cli", "command": "shelf get"}) for d in ("in", "out")]
            target = tmp_path / folder
            target.mkdir(exist_ok=True)
            (target / f"part-{part}.jsonl").write_text("\n".join(lines) + "\n")
    owner = F.regexp_extract("file", "/([ab])/part", 1)
    log = read_command_log(spark, str(tmp_path / "*"), owner)
    rows = sorted((r.checkout, r.line_no, r.id) for r in log.collect())
    # the second file is earlier in time, so its lines come first
    assert [r[2] for r in rows if r[0] == "a"] == ["a10", "a10", "a11", "a11", "a00", "a00", "a01", "a01"]
    assert [r[1] for r in rows if r[0] == "b"] == list(range(1, 9))
    assert K.pair_calls(log).count() == 8
