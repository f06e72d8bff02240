"""Chat formatting: conversations as one marked text with a loss mask, and back.

Template (:class:`Template`): adjacent rows of one role are merged into one block,
``<turn>role<text>first text<more>second text</turn>``; blocks follow each other.  Inside roles and texts a
backslash is doubled and a control string gets a backslash after its first character, so no control string is
left there and dropping one backslash before each character restores the text.

The rows of a conversation are cut into ranges of ``CHUNK`` turn numbers; each range is sorted, merged and
concatenated by itself, so a conversation with very many rows is formatted by many tasks, and only the finished
pieces meet in the row that is the result.  Everything is built from Spark expressions.

Defined results: rows follow ``turn`` (null first), then role, then text; repeated rows stay, each is a turn.
Null role and null text count as empty.  Null ``conv_id`` is one conversation.  No rows, no conversations.
Other columns are ignored.  A conversation is one row, so its formatted text has to fit into one (2 GB).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sums

#: Turn numbers of one range.
CHUNK = 256
#: Characters of a page, see ``cut``.
PAGE = 1024
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Control strings.  Each starts with the same character, which stands nowhere else in them."""

    turn: str = "<turn>"
    text: str = "<text>"
    more: str = "<more>"
    end: str = "</turn>"

    def __post_init__(self) -> None:
        first = {m[:1] for m in self.marks}
        if len(first) != 1 or len(set(self.marks)) != 4 or any(len(m) < 2 or m[0] in m[1:] or ESCAPE in m for m in self.marks):
            raise ValueError("four different marks of two characters or more, one first character found only there, no backslash")
        if any(a != b and a.startswith(b) for a in self.marks for b in self.marks):
            raise ValueError("no mark may start another")

    @property
    def marks(self) -> tuple[str, str, str, str]:
        return self.turn, self.text, self.more, self.end

    def escape(self, text: Column) -> Column:
        text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
        for mark in self.marks:
            text = F.replace(text, F.lit(mark), F.lit(mark[0] + ESCAPE + mark[1:]))
        return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _split(text: Column, mark: str, limit: int = -1) -> Column:
    return F.split(text, re.escape(mark), limit)


def _opening(template: Template, role: Column, before: Column) -> Column:
    """What stands before a text: its block's start, or the mark between merged texts."""
    start = F.concat(F.lit(template.turn), template.escape(role), F.lit(template.text))
    return F.when(before.isNull(), start).when(before == role, F.lit(template.more)).otherwise(F.concat(F.lit(template.end), start))


def _sizes(texts: Column) -> Column:
    return F.transform(texts, F.char_length)


def _starts(sizes: Column) -> Column:
    """Sum of the sizes before each place."""
    return let(running_sums(sizes), lambda s: F.transform(s, lambda x, i: F.coalesce(F.get(s, i - 1), F.lit(0).cast("long"))))


def format_conversations(rows: DataFrame, template: Template = Template(), loss_role: str = "assistant", chunk: int = CHUNK) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text)``: ``conv_id``, ``n_turns``, ``formatted`` and
    ``loss``, the spans ``(start, length)`` in code points of ``formatted`` that hold the texts of ``loss_role``."""
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = rows.groupBy("conv_id", F.floor(F.col("turn") / chunk).alias("part")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    pieces = ranges.select(
        "conv_id", "part", F.col("items")[0]["role"].alias("first"), F.element_at("items", -1)["role"].alias("last"),
        F.transform("items", lambda x: x["role"] == loss_role).alias("masked"),
        F.transform("items", lambda x: template.escape(x["text"])).alias("texts"),
        # the first text of a range gets its mark when the ranges meet
        F.transform("items", lambda x, i: F.when(i > 0, _opening(template, x["role"], F.get("items", i - 1)["role"])).otherwise("")).alias("marks"),
    )
    pieces = pieces.withColumn("at", _starts(F.transform("texts", lambda x, i: F.char_length(x) + F.char_length(F.get("marks", i))))).select(
        "conv_id", F.struct(
            "part", "first", "last", F.size("texts").alias("n"),
            F.array_join(F.flatten(F.zip_with("marks", "texts", lambda m, t: F.array(m, t))), "").alias("body"),
            F.filter(F.transform("texts", lambda x, i: F.when(F.get("masked", i), F.struct(
                (F.get("at", i) + F.char_length(F.get("marks", i))).alias("start"), F.char_length(x).cast("long").alias("length")))),
                lambda s: s.isNotNull()).alias("loss"),
        ).alias("piece"),
    )
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    whole = whole.withColumn("marks", F.transform("pieces", lambda p, i: _opening(template, p["first"], F.get("pieces", i - 1)["last"])))
    whole = whole.withColumn("at", _starts(F.transform("pieces", lambda p, i: F.char_length(p["body"]) + F.char_length(F.get("marks", i)))))
    return whole.select(
        "conv_id", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_turns"),
        F.concat(F.array_join(F.flatten(F.zip_with("marks", "pieces", lambda m, p: F.array(m, p["body"]))), ""), F.lit(template.end)).alias("formatted"),
        F.flatten(F.transform("pieces", lambda p, i: F.transform(p["loss"], lambda s: F.struct(
            (s["start"] + F.get("at", i) + F.char_length(F.get("marks", i))).alias("start"), s["length"].alias("length"))))).alias("loss"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns ``(role, text)`` of a formatted conversation."""
    blocks = F.filter(_split(formatted, template.end), lambda b: b != "")

    def turns(block: Column) -> Column:
        return let(_split(F.substr(block, F.lit(len(template.turn) + 1)), template.text, 2), lambda parts: F.transform(
            _split(parts[1], template.more), lambda t: F.struct(unescape(parts[0]).alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def cut(text: Column, spans: Column) -> Column:
    """The substrings of ``text`` at ``spans``, in time linear in both: the text is paged first."""
    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))

    def one(pages: Column, s: Column) -> Column:
        first = F.floor(s["start"] / PAGE).cast("int")
        last = F.floor((s["start"] + s["length"]) / PAGE).cast("int")
        near = F.array_join(F.slice(pages, first + 1, last - first + 1), "")
        return F.substr(near, (s["start"] - first * PAGE + 1).cast("int"), s["length"].cast("int"))

    return let(pages, lambda p: F.transform(spans, lambda s: one(p, s)))


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What reading back gives: turns and their digest, the text under the loss mask and its digest."""
    read = formatted.select(
        "conv_id", "formatted", read_turns(F.col("formatted"), template).alias("turns"),
        F.array_join(F.transform(cut(F.col("formatted"), F.col("loss")), unescape), "").alias("learned"),
    )
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
