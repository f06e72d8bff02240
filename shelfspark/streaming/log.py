"""Streaming twins of the log operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as C
from ..functions import logs as L

PAIR = ("checkout string, name string, in_file string, in_line long, out_file string, out_line long, "
        "in_ts timestamp, out_ts timestamp")
LINE = "us long, ns long, file string, line_no long, dir string, name string"


class CallPairing(StatefulProcessor):
    """Calls of one id, or of one command's lines without ids, in the order of the log.

    Lines wait until the watermark has passed them, so their order of arrival does not matter.  Then an ``out`` takes the
    oldest open ``in``, or stands alone; with ids a second ``in`` replaces the first, which stays open.  An ``in`` that found no
    ``out`` within the expiry is emitted as open.  All of it goes by the times of the lines, so a replay gives the same calls.
    """

    def __init__(self, expiry_us: int):
        self.expiry_us = expiry_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", LINE)
        self.open = handle.getListState("open", LINE)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            new = list(zip(*[frame[c].tolist() for c in ("us", "ns", "file", "line_no", "dir", "name")]))
            if new:
                self.waiting.appendList(new)
                first = min([x[0] for x in new] + ([] if first is None else [first]))
        if first is not None:
            self._wake(first)
        yield from ()  # calls come with the timers; a frame of no rows for each key would cost more than its lines

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(x) for x in self.waiting.get()]
        ready = sorted((x for x in waiting if x[0] <= now), key=lambda x: x[:4])
        rest = [x for x in waiting if x[0] > now]
        queue = deque(tuple(x) for x in self.open.get())
        calls: list[tuple] = []

        def expire(us: int) -> None:
            while queue and queue[0][0] + self.expiry_us <= us:
                calls.append((queue.popleft(), None))

        for line in ready:
            expire(line[0])
            if line[4] == "in":
                if key[1] and queue:
                    calls.append((queue.popleft(), None))
                queue.append(line)
            else:
                calls.append((queue.popleft() if queue else None, line))
        expire(now)
        for state, held in ((self.waiting, rest), (self.open, list(queue))):
            state.clear()
            if held:
                state.put(held)
        nexts = [x[0] for x in rest] + ([queue[0][0] + self.expiry_us] if queue else [])
        if nexts:
            self._wake(min(nexts))
        if calls:
            yield self._frame(key, calls)

    @staticmethod
    def _frame(key, calls: list[tuple]) -> pd.DataFrame:
        def side(lines: list, at: int) -> list:
            return [x and x[at] for x in lines]

        ins, outs = zip(*calls)
        return pd.DataFrame({
            "checkout": pd.Series([key[0]] * len(calls), dtype="object"),
            "name": pd.Series([(a or b)[5] for a, b in calls], dtype="object"),
            "in_file": pd.Series(side(ins, 2), dtype="object"), "in_line": pd.array(side(ins, 3), dtype="Int64"),
            "out_file": pd.Series(side(outs, 2), dtype="object"), "out_line": pd.array(side(outs, 3), dtype="Int64"),
            "in_ts": pd.to_datetime(pd.array(side(ins, 0), dtype="Int64"), unit="us", utc=True),
            "out_ts": pd.to_datetime(pd.array(side(outs, 0), dtype="Int64"), unit="us", utc=True),
        })

    def close(self) -> None:
        pass


def pair_calls_stream(log: DataFrame, delay: str = "10 minutes", expiry: str = "24 hours") -> DataFrame:
    """Calls of a log stream (X2), the twin of pairing in a batch; needs the RocksDB state store.

    ``log[checkout, id, name, dir, line_no, ts, (ts_ns), (file), (ok)]``.  Returns every call once: with both lines, with a
    lone ``out``, or with an ``in`` that stayed open for ``expiry``.  A call appears when the watermark, ``delay`` behind the
    newest line, has passed its ``out``; lines that come later than that are dropped.  Lines that are broken, have no readable
    time or neither direction take no part.  The state of a key holds its lines of the last ``delay`` and its open calls.
    """
    if "ok" in log.columns:
        log = log.where("ok")
    micros = F.unix_micros("ts")
    lines = log.where(F.col("dir").isin("in", "out") & F.col("ts").isNotNull()).select(
        F.coalesce("checkout", F.lit("")).alias("checkout"), F.coalesce("id", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name"),
        "dir", F.coalesce("line_no", F.lit(0).cast("long")).alias("line_no"), "ts",
        (F.coalesce("file", F.lit("")) if "file" in log.columns else F.lit("")).alias("file"),
        (F.coalesce("ts_ns", micros * 1000) if "ts_ns" in log.columns else micros * 1000).alias("ns"), micros.alias("us"),
    ).withColumn("queue", F.when(F.col("id") == "", F.col("name")).otherwise(""))
    span = lines.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {expiry})").first()[0]
    return lines.withWatermark("ts", delay).groupBy("checkout", "id", "queue").transformWithStateInPandas(
        CallPairing(span), PAIR, "Append", "EventTime"
    )


def _interval(left: DataFrame, right: DataFrame, keys: list[str], within: str, how: str) -> DataFrame:
    l_side = left.withWatermark("at", within).alias("l")
    r_side = right.withWatermark("at", within).alias("r")
    on = F.expr(f"r.at <= l.at AND r.at >= l.at - INTERVAL {within} AND r.seq < l.seq")
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return l_side.join(r_side, on, how)


def followed_gets_stream(gets: DataFrame, hits: DataFrame, within: str = "30 minutes") -> DataFrame:
    """Gets that follow a search returning the id (X3): ``[checkout, id, seq, at]`` on both sides."""
    return _interval(gets, hits, ["checkout", "id"], within, "leftSemi").select("checkout", "id", "seq", "at")


def unmatched_gets_stream(gets: DataFrame, hits: DataFrame, within: str = "30 minutes") -> DataFrame:
    """Gets without such a search, known once the watermark has passed."""
    joined = _interval(gets, hits, ["checkout", "id"], within, "leftOuter")
    return joined.where("r.seq IS NULL").select("l.checkout", "l.id", "l.seq", "l.at")


def without_search_stream(remembers: DataFrame, searches: DataFrame, within: str = "30 minutes") -> DataFrame:
    """New records with no search shortly before, known once the watermark has passed."""
    joined = _interval(remembers, searches, ["checkout"], within, "leftOuter")
    return joined.where("r.seq IS NULL").select("l.checkout", "l.seq", "l.at")


def call_counts_stream(calls: DataFrame, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Calls per command and window (X5); rows later than the watermark are dropped."""
    kept = calls.where(~F.col("name").isin(*C.MAINTENANCE_COMMANDS) & F.col("has_out"))
    return (
        kept.withWatermark("at", watermark).groupBy(F.window("at", window), "checkout", "name").agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "checkout", "name", "n")
    )


class ReviewTimer(StatefulProcessor):
    """Emits a row when a checkout's last review is ``days`` old in event time."""

    def __init__(self, days: int):
        self.span_ms = days * 24 * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(frame["at_ms"].max()) for frame in rows)
        known = self.last.get()[0] if self.last.exists() else None
        if known is None or newest > known:
            if known is not None:
                self.handle.deleteTimer(known + self.span_ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.span_ms)
        yield pd.DataFrame({"checkout": [], "last_review_ms": [], "due_ms": []}).astype(
            {"checkout": "object", "last_review_ms": "int64", "due_ms": "int64"}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = int(expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame({"checkout": [key[0]], "last_review_ms": [due - self.span_ms], "due_ms": [due]})

    def close(self) -> None:
        pass


def review_timer(reviews: DataFrame, days: int = C.REVIEW_DAYS, watermark: str = "1 hour") -> DataFrame:
    """``[checkout, last_review_ms, due_ms]`` when a review becomes due (X6): ``reviews[checkout, at]`` streaming."""
    timed = reviews.withWatermark("at", watermark).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("checkout").transformWithStateInPandas(
        ReviewTimer(days), "checkout string, last_review_ms long, due_ms long", "Append", "EventTime"
    )


def full_reviews(lines: DataFrame) -> DataFrame:
    """``[checkout, at]`` of ``out`` lines of successful reviews; a clock check carries ``due`` in its result or arguments."""
    failed: Column = (F.coalesce("error", F.lit("")) != "") | F.coalesce(
        F.try_variant_get("result", "$.is_error", "boolean"), F.lit(False)
    )
    done = lines.where((F.col("dir") == "out") & (L.base_command(F.col("command")) == "review") & ~failed)
    return done.where(~F.coalesce(L.due_only(F.col("args")), F.lit(False))).select("checkout", F.col("ts").alias("at"))
