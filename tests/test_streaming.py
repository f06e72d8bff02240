"""Streams against their batch twins, with shuffled arrival."""

import datetime as dt
import glob
import io
import json
import os
import random
import time

import pandas as pd
from helpers import T0, records
from pyspark.sql import functions as F

from shelfspark.functions import logs as L
from shelfspark.operators import calls as K
from shelfspark.operators import embedding as E
from shelfspark.operators.tables import upsert_records
from shelfspark.sources.command_log import read_command_log
from shelfspark.schemas import ATTEMPTS, RECORDS
from shelfspark.sources import deltas as D
from shelfspark.sources import log_tail as T
from shelfspark.sources.log_tail import tail_lines
from shelfspark.streaming import ingest as I
from shelfspark.streaming import log as S

END = T0 + dt.timedelta(days=30)


def as_stream(spark, df, folder, batches=3, seed=5):
    """Write a table in several parquet files and stream them one by one."""
    rows = df.collect()
    random.Random(seed).shuffle(rows) if seed is not None else None
    step = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return df.sparkSession.table(name)


def log(spark, n=80, seed=1):
    rng = random.Random(seed)
    rows = [("u" + rng.choice("ab"), f"i{i % 5}", i, T0 + dt.timedelta(minutes=3 * i)) for i in range(n)]
    return spark.createDataFrame(rows, "checkout string, id string, seq long, at timestamp").withColumn("at_us", F.unix_micros("at"))


def split(df):
    return df.where("seq % 2 = 0"), df.where("seq % 2 = 1")


def closing(spark):
    """A late row per side moves the watermark past everything else."""
    return spark.createDataFrame([("zz", "zz", -1, END), ("zz", "zz", -2, END)], "checkout string, id string, seq long, at timestamp").withColumn("at_us", F.unix_micros("at"))


def test_follow_through_stream(spark, tmp_path):
    hits, gets = split(log(spark))
    want = {r.seq for r in K.follow_through(gets, hits).where("found").collect()}
    # shuffled arrival stays inside the watermark only when one batch holds it
    s_hits, s_gets = as_stream(spark, hits, tmp_path / "h", 1), as_stream(spark, gets, tmp_path / "g", 1)
    got = drain(S.followed_gets_stream(s_gets, s_hits), "followed", tmp_path)
    assert {r.seq for r in got.collect()} == want and want


def test_absence_streams(spark, tmp_path):
    hits, gets = split(log(spark))
    late = closing(spark)
    want = {r.seq for r in K.follow_through(gets, hits).where("NOT found").collect()}

    def stream(df, name):
        return as_stream(spark, df.orderBy("at").unionByName(late.limit(1)), tmp_path / name, 2, None)

    got = drain(S.unmatched_gets_stream(stream(gets, "g"), stream(hits, "h")), "unmatched", tmp_path)
    assert {r.seq for r in got.collect()} - {-1, -2} == want and want
    sparse = hits.where("seq % 14 = 0")
    alone = {r.seq for r in K.without_search(gets, sparse).collect()}
    got = drain(S.without_search_stream(stream(gets, "g2"), stream(sparse, "h2")), "alone", tmp_path)
    assert {r.seq for r in got.collect()} - {-1, -2} == alone and alone


def paired(df):
    return {(r.checkout, r.in_line, r.out_line) for r in df.collect() if r.checkout != "zz"}


def test_pairing_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        known = rng.random() < 0.5
        rows.append((rng.choice("ab"), f"c{rng.randrange(30)}" if known else "", "get", rng.choice(["in", "out"]), i, T0 + dt.timedelta(seconds=i // 2)))
    df = spark.createDataFrame(rows, "checkout string, id string, name string, dir string, line_no long, ts timestamp")
    want = paired(K.pair_by_id(df.where("id <> ''"))) | paired(K.pair_fifo(df.where("id = ''")))
    assert {(a is None, b is None) for _, a, b in want} == {(False, False), (True, False), (False, True)}  # pairs, lone replies, open calls
    last = spark.createDataFrame([("zz", "", "get", "in", 0, END)], df.schema)
    stream = as_stream(spark, df, tmp_path / "l", 3)  # shuffled
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    got = drain(S.pair_calls_stream(stream, "1 hour"), "paired", tmp_path)
    assert paired(got) == want and got.where("checkout <> 'zz'").count() == len(want)


def test_pairing_stream_leaves_broken_lines_out(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    text = [json.dumps({"ts": f"2026-01-05T12:00:0{i}.12345678{i % 3}Z", "dir": d, "command": "shelf get", **k}) for i, (d, k) in enumerate(
        [("in", {}), ("in", {"id": "x"}), ("out", {}), ("out", {"id": "x"}), ("out", {"id": "y"}), ("aside", {})])]
    text.insert(2, "not json")
    text.insert(4, "[1]")
    (folder / "a.jsonl").write_text("\n".join(text) + "\n" + json.dumps({"ts": "no time", "dir": "in", "command": "get"}) + "\n")
    (folder / "z.jsonl").write_text(json.dumps({"ts": "2027-01-01T00:00:00Z", "dir": "in", "command": "get"}) + "\n")
    log = read_command_log(spark, str(folder), "/a", stream=True).withColumn("name", L.base_command(F.col("command")))
    # a tail ends an availableNow run after one batch, so the batch that the watermark asks for needs a running query
    q = S.pair_calls_stream(log, "1 minute", "1 hour").writeStream.format("memory").queryName("unbroken").option("checkpointLocation", str(tmp_path / "ck")).start()
    until = time.time() + 120
    while spark.table("unbroken").count() < 3 and time.time() < until:
        q.processAllAvailable()
    q.stop()
    got = spark.table("unbroken").collect()
    at = {line: sum(len(t) + 1 for t in text[:i]) for i, line in enumerate(text)}
    places = [at[t] for t in text]
    assert sorted(((r.in_line, r.out_line) for r in got), key=str) == sorted([(places[0], places[3]), (places[1], places[5]), (None, places[6])], key=str)
    assert {r.name for r in got} == {"get"} and {r.in_file or r.out_file for r in got} == {str(folder / "a.jsonl")}


def test_open_calls_expire(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    rows = [("a", "", "get", "in", 1, T0), ("a", "", "get", "in", 2, T0 + 3 * hour), ("a", "", "get", "out", 3, T0 + 4 * hour),
            ("a", "k", "get", "in", 4, T0), ("a", "k", "get", "out", 5, T0 + 2 * hour), ("zz", "", "get", "in", 6, END)]
    rows.sort(key=lambda r: r[5])
    df = spark.createDataFrame(rows, "checkout string, id string, name string, dir string, line_no long, ts timestamp")
    got = drain(S.pair_calls_stream(as_stream(spark, df, tmp_path / "l", 6, None), "10 minutes", "2 hours"), "expired", tmp_path)
    assert paired(got) == {("a", 1, None), ("a", 2, 3), ("a", 4, None), ("a", None, 5)}


def test_tail_waits_for_the_rest_of_a_line(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.log").write_bytes(b"one\ntwo")
    (folder / "_temporary").write_bytes(b"no\n")

    def run():
        lines = tail_lines(spark, str(folder))
        q = lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        return sorted((os.path.basename(r.file), r.position, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a.log", 0, "one")]
    with open(folder / "a.log", "ab") as f:
        f.write(b" and more\n\nthr")
    (folder / "b.log").write_bytes("ünï\n".encode())
    assert run() == [("a.log", 0, "one"), ("a.log", 4, "two and more"), ("a.log", 17, ""), ("b.log", 0, "ünï")]
    (folder / "b.log").write_bytes(b"x\n")  # replaced by a shorter file
    assert ("b.log", 0, "x") in run()


def test_ranges_of_a_file_meet_at_lines():
    rng = random.Random(3)
    text = b"".join(bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12))) + b"\n" for _ in range(60))
    whole = list(T.lines_between(io.BytesIO(text), 0, len(text), len(text)))
    assert [v for _, v in whole] == text.split(b"\n")[:-1] and all(text[p : p + len(v)] == v for p, v in whole)
    for size in (1, 5, 7, 64, 10_000):
        parts = [x for a in range(0, len(text), size) for x in T.lines_between(io.BytesIO(text), a, min(a + size, len(text)), len(text))]
        assert parts == whole
    assert T.last_line_end(io.BytesIO(text + b"torn"), 0, len(text) + 4) == len(text)
    assert T.last_line_end(io.BytesIO(b"torn"), 0, 4) == 0


def test_call_counts_stream(spark, tmp_path):
    df = log(spark).select("checkout", F.when(F.col("seq") % 3 == 0, "index").otherwise("get").alias("name"), F.lit(True).alias("has_out"), "at")
    want = {(r.start, r.checkout, r.name, r.n) for r in df.where("name = 'get'").groupBy(F.window("at", "1 hour").start.alias("start"), "checkout", "name").agg(F.count("*").alias("n")).collect()}
    got = drain(S.call_counts_stream(as_stream(spark, df, tmp_path / "c", 2, None)), "counts", tmp_path, "complete")
    assert {tuple(r) for r in got.collect()} == want


def test_review_timer(spark, tmp_path):
    rows = [("a", T0), ("a", T0 + dt.timedelta(days=3)), ("b", T0 + dt.timedelta(days=1)), ("zz", END)]
    df = spark.createDataFrame(rows, "checkout string, at timestamp")
    got = drain(S.review_timer(as_stream(spark, df, tmp_path / "r", 2, None)), "due", tmp_path)
    ms = {r.checkout: r.due_ms for r in got.collect()}
    day = 24 * 3600 * 1000
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert ms == {"a": start + 10 * day, "b": start + 8 * day}


def test_log_stream_and_reviews(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    lines = [{"ts": "2026-01-05T12:00:00Z", "dir": "out", "command": "shelf review", "result": {}}, {"ts": "2026-01-05T13:00:00Z", "dir": "out", "command": "shelf review", "result": {"is_error": True}}]
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{torn")
    stream = read_command_log(spark, str(folder), "/a", stream=True)
    got = drain(S.full_reviews(stream), "reviews", tmp_path).collect()
    assert [tuple(r) for r in got] == [("/a", T0)]


def test_ingest_stream_with_replay(spark, tmp_path):
    now = F.lit(END).cast("timestamp")
    docs = records(spark, *[dict(id=f"r{i}", body=f"v{i}") for i in range(6)]).drop("updated_at")
    stream = as_stream(spark, docs, tmp_path / "in", 2, None)
    base = str(tmp_path / "base")
    I.ingest_stream(stream, base, str(tmp_path / "ck"), now).awaitTermination(240)
    first = D.read_table(spark, base, RECORDS, ["id"])
    assert sorted(r.id for r in first.collect()) == [f"r{i}" for i in range(6)]
    # a lost checkpoint replays every batch: the same rows again change nothing
    again = upsert_records(first, docs, F.lit(END + dt.timedelta(days=1)).cast("timestamp"))
    assert {r.updated_at for r in again.collect()} == {END}
    manifest = D.read_manifest(spark, base)
    I.ingest_stream(stream, base, str(tmp_path / "ck2"), now).awaitTermination(240)
    assert [(p.bucket, p.version, p.n) for p in D.read_manifest(spark, base)] == [(p.bucket, p.version, p.n) for p in manifest]
    assert sorted(map(tuple, D.read_table(spark, base, RECORDS, ["id"]).collect())) == sorted(map(tuple, first.collect()))


ROW = "k string, part int, v string"


def test_delta_table_against_a_dictionary(spark, tmp_path):
    rng = random.Random(6)
    base, want = str(tmp_path / "t"), {}
    assert D.read_table(spark, base, ROW, ["k", "part"]).count() == 0
    history = []
    for version in range(1, 8):
        put = {(f"k{rng.randrange(40)}", rng.randrange(2)): f"v{version}" for _ in range(rng.choice([0, 1, 12]))}
        drop = [k for k in rng.sample(sorted(want), min(len(want), 3)) if k not in put]
        changes = spark.createDataFrame([(*k, v) for k, v in put.items()], ROW)
        gone = spark.createDataFrame(drop, "k string, part int")
        D.write_delta(changes, base, ["k", "part"], version, gone, buckets=4, max_deltas=3)
        want = {k: v for k, v in {**want, **put}.items() if k not in drop}
        history.append(dict(want))
        got = {(r.k, r.part): r.v for r in D.read_table(spark, base, ROW, ["k", "part"]).collect()}
        assert got == want
    assert max(sum(p.bucket == b for p in D.read_manifest(spark, base)) for b in range(4)) <= 3  # longer ones were compacted
    for version, rows in enumerate(history, 1):  # every version can still be read
        assert {(r.k, r.part): r.v for r in D.read_table(spark, base, ROW, ["k", "part"], version + 1).collect()} == rows
    assert D.vacuum(spark, base) > 0
    assert {(r.k, r.part): r.v for r in D.read_table(spark, base, ROW, ["k", "part"]).collect()} == want


def test_a_delta_touches_only_its_buckets(spark, tmp_path):
    base = str(tmp_path / "t")
    D.write_delta(spark.createDataFrame([(f"k{i}", 0, "old") for i in range(200)], ROW), base, ["k"], 1, buckets=8)
    assert D.write_delta(spark.createDataFrame([("k7", 0, "new")], ROW), base, ["k"], 2, buckets=8).__len__() == 1
    assert len(glob.glob(f"{base}/data/*/version=4/bucket=*")) == 1
    D.write_delta(spark.createDataFrame([("k7", 0, "new")], ROW), base, ["k"], 2, buckets=8)  # a replay
    table = D.read_table(spark, base, ROW, ["k"])
    assert table.count() == 200 and table.where("v = 'new'").count() == 1
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan  # bases are not shuffled


def test_an_unfinished_write_is_not_seen(spark, tmp_path):
    base = str(tmp_path / "t")
    D.write_delta(spark.createDataFrame([("a", 0, "1")], ROW), base, ["k"], 1)
    D.write_delta(spark.createDataFrame([("a", 0, "2")], ROW), base, ["k"], 2)
    os.remove(f"{base}/manifest/v2/_SUCCESS")
    assert [r.v for r in D.read_table(spark, base, ROW, ["k"]).collect()] == ["1"]


def test_embed_stream(spark, tmp_path):
    recs = records(spark, dict(id="a", body="fine"), dict(id="b", body="never"), dict(id="c", body="fine too"))
    plain = E.hash_embedder(4)

    def embedder(texts):
        if any("never" in t for t in texts):
            raise RuntimeError("no")
        return plain(texts)

    items = as_stream(spark, E.worklist_items(recs), tmp_path / "items", 1)
    vec, att = str(tmp_path / "vec"), str(tmp_path / "att")
    I.embed_stream(items, vec, att, embedder, "m", 4, str(tmp_path / "ck"), max_attempts=3).awaitTermination(240)
    assert sorted(r.key for r in D.read_table(spark, vec, I.VECTORS, ["key"]).collect()) == ["a", "c"]
    assert [(r.key, r.attempts, r.state) for r in D.read_table(spark, att, ATTEMPTS, ["key"]).collect()] == [("b", 3, "giveup")]
    # the same item in the next batch succeeds: its attempts go, the other vectors stay as they are
    manifest = D.read_manifest(spark, vec)
    E.worklist_items(recs).where("key = 'b'").coalesce(1).write.mode("append").parquet(str(tmp_path / "items"))
    I.embed_stream(items, vec, att, plain, "m", 4, str(tmp_path / "ck"), max_attempts=3).awaitTermination(240)
    assert sorted(r.key for r in D.read_table(spark, vec, I.VECTORS, ["key"]).collect()) == ["a", "b", "c"]
    assert D.read_table(spark, att, ATTEMPTS, ["key"]).count() == 0 and len(D.read_manifest(spark, vec)) == len(manifest) + 1


def test_pairing_makes_no_frame_without_calls():
    """A key whose lines only wait yields nothing; a frame of no rows cost more than its lines."""
    class State:
        def __init__(self):
            self.held = []

        def appendList(self, rows):
            self.held += rows

        put = appendList

        def get(self):
            return iter(self.held)

        def clear(self):
            self.held = []

    class Handle:
        def getListState(self, name, schema):
            return State()

        def registerTimer(self, ms):
            self.at = ms

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    pairing = S.CallPairing(10**9)
    pairing.init(Handle())
    lines = pd.DataFrame({"us": [5000, 9000], "ns": [5000000, 9000000], "file": ["", ""], "line_no": [2, 3], "dir": ["in", "out"], "name": ["n", "n"]})
    assert list(pairing.handleInputRows(("c", "", "n"), iter([lines]), None)) == []
    assert list(pairing.handleExpiredTimer(("c", "", "n"), Now(1), None)) == []
    (calls,) = pairing.handleExpiredTimer(("c", "", "n"), Now(20), None)
    assert calls[["checkout", "name", "in_line", "out_line"]].values.tolist() == [["c", "n", 2, 3]]
    assert [calls[c].iloc[0].value for c in ("in_ts", "out_ts")] == [5_000_000, 9_000_000]
