"""Secret scans: patterns for known kinds, and sliding-window entropy for unknown ones.

``known_spans`` finds the three fixed patterns.  ``entropy_spans`` takes candidate strings
(maximal runs of one character class), slides a window over each and keeps the windows whose
Shannon entropy reaches the class's threshold.  Entropy is updated by the counts of the leaving and
the entering character only, in fixed-point integers; running sums give it for every window.  Windows
that touch become one span.  Candidates on the allow-list are left alone: see ``CLASSES`` for its rules, one of letter case among them.

Everything is expressions on one row: no shuffle, no Python.  Places are code points, the end
is exclusive.

Null or empty text: no spans.  Repeated rows get equal spans.  Empty tables give empty results.
Other columns are carried along; the columns added here replace columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sums

#: Patterns of the known kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6


@dataclass(frozen=True)
class CharClass:
    """Candidates of one character class.  ``allowed``: candidates found by this pattern are no secrets.

    ``words``: a piece between / _ = - that holds one of them is cut out, and the rest of the run is looked at.
    """

    kind: str
    characters: str
    window: int
    bits: float
    allowed: str
    words: str = ""


#: Allow-list: no digit or no letter (words, numbers), one repeated short block; UUIDs; documentation keys.
_COMMON = r"^[^0-9]+$|^[^A-Za-z]+$|^(.{1,8})\1+.{0,8}$"
_UUID = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
_WORDS = r"(?i:example|xxxx|0123456789|abcdefgh)"
#: Runs of one letter case with separators are mostly paths and names, so the first class leaves them alone; the classes
#: of one case find keys in their pieces of 24 or more.  Runs of lower-case hexadecimal digits are known spans.
CLASSES = (
    CharClass("entropy_base64", "A-Za-z0-9+/_=-", 24, 3.9, f"{_COMMON}|{_UUID}|^[^a-z]+$|^[^A-Z]+$", _WORDS),
    CharClass("entropy_hex", "0-9A-Fa-f", 32, 3.0, f"{_COMMON}|{_WORDS}"),
    CharClass("entropy_lower", "a-z0-9", 24, 3.4, f"{_COMMON}|{_WORDS}|^[0-9a-f]+$"),
    CharClass("entropy_upper", "A-Z0-9", 24, 3.4, f"{_COMMON}|{_WORDS}"),
)
#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", *[c.kind for c in CLASSES])
SCALE = 1 << 20
#: Characters of a run that are looked at together.
PAGE = 256
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _runs(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs of start, end and s (the matched text)."""
    def of(found: Column, gaps: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.char_length(m) + F.char_length(F.get(gaps, i)))
        return let(running_sums(sizes), lambda ends: F.transform(found, lambda m, i: F.struct(
            (F.get(ends, i) - F.char_length(m)).cast("int").alias("start"), F.get(ends, i).cast("int").alias("end"), m.alias("s"))))

    none = F.lit(None).cast("array<struct<start:int,end:int,s:string>>")
    some = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(
        F.split(text, pattern, -1), lambda gaps: of(found, gaps)))
    return F.coalesce(F.when(text.rlike(pattern), some).otherwise(none), F.array().cast("array<struct<start:int,end:int,s:string>>"))


def _spans(runs: Column, kind: str) -> Column:
    return F.transform(runs, lambda r: F.struct(
        r["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), r["end"].alias("end"))).cast(SPAN)


def known_spans(text: Column) -> Column:
    """Spans of the kinds assign, access and hex, sorted by start, then kind."""
    t = F.coalesce(text, F.lit(""))
    long_value = lambda r: F.char_length(F.regexp_extract(r["s"], ASSIGN, 2)) >= ASSIGN_VALUE
    assign = F.filter(_runs(t, ASSIGN), long_value)
    return F.sort_array(F.concat(_spans(assign, "assign"), _spans(_runs(t, ACCESS), "access"), _spans(_runs(t, HEX), "hex")))


def _window_places(s: Column, window: int, bits: float) -> Column:
    """Last places of the windows of ``s`` whose entropy is at least ``bits``.

    A long run is looked at page by page, each with the ``window`` - 1 characters before it, so that every window lies
    in one piece and the time is linear in the run: a character of a piece is reached without a walk through the run.
    """
    page = max(PAGE, window)

    def piece(pages: Column, k: Column) -> Column:
        before = F.when(k > 0, F.right(F.get(pages, k - 1), F.lit(window - 1))).otherwise("")
        return F.concat(before, F.get(pages, k))

    def places(pages: Column, k: Column) -> Column:
        shift = F.when(k > 0, k * page - (window - 1)).otherwise(0)
        return let(shift, lambda d: F.transform(let(piece(pages, k), lambda x: _places_of_piece(x, window, bits)), lambda i: i + d))

    return let(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{page}}}"), F.lit(0)),
               lambda pages: F.flatten(F.transform(F.sequence(F.lit(0), F.size(pages) - 1), lambda k: places(pages, k))))


def _places_of_piece(s: Column, window: int, bits: float) -> Column:
    """As ``_window_places``, by running sums over the whole piece."""
    parts = F.array(*[F.lit(round(c * math.log2(c) * SCALE) if c else 0).cast("long") for c in range(window + 1)])
    most = round((math.log2(window) - bits) * window * SCALE)  # entropy = log2(window) - sum(c log2 c) / window
    inside = lambda x, c: F.char_length(x) - F.char_length(F.replace(x, c, F.lit("")))

    def change(i: Column, f: Column) -> Column:
        """Change of the sum of c log2 c when the window's end moves to place i."""
        leaving = F.when(i >= window, F.substring(s, i - window + 1, F.lit(1)))
        entering = F.substring(s, i + 1, F.lit(1))
        before = F.substring(s, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)))
        after = F.substring(s, F.greatest(i - window + 1, F.lit(0)) + 1, F.least(i, F.lit(window - 1)))
        drop = F.coalesce(let(inside(before, leaving), lambda n: F.get(f, n - 1) - F.get(f, n)), F.lit(0).cast("long"))
        return drop + let(inside(after, entering), lambda n: F.get(f, n + 1) - F.get(f, n))

    places = F.sequence(F.lit(0), F.char_length(s) - 1)
    sums = let(parts, lambda f: running_sums(F.transform(places, lambda i: change(i, f))))
    return let(sums, lambda v: F.filter(places, lambda i: (i >= window - 1) & (F.get(v, i) <= most)))


def _cut(run: Column, words: str, pattern: str) -> Column:
    """What matches ``pattern`` in a run without its pieces that hold one of ``words``, as runs."""
    piece = f"[/_=-]?(?<![A-Za-z0-9+])[A-Za-z0-9+]*?{words}[A-Za-z0-9+]*[/_=-]?"
    blanks = lambda m: F.coalesce(F.repeat(F.lit(" "), F.char_length(m)), F.lit(""))
    left = let(F.regexp_extract_all(run["s"], F.lit(piece), F.lit(0)), lambda found: F.array_join(
        F.transform(F.split(run["s"], piece, -1), lambda g, i: F.concat(g, blanks(F.get(found, i)))), ""))
    return F.transform(let(left, lambda s: _runs(s, pattern)), lambda r: F.struct(
        (run["start"] + r["start"]).alias("start"), (run["start"] + r["end"]).alias("end"), r["s"].alias("s")))


def _class_spans(text: Column, c: CharClass) -> Column:
    pattern = f"[{c.characters}]{{{c.window},}}"
    runs = _runs(text, pattern)
    if c.words:
        runs = F.flatten(F.transform(runs, lambda r: F.when(r["s"].rlike(c.words), _cut(r, c.words, pattern)).otherwise(F.array(r))))
    wanted = F.filter(runs, lambda r: ~r["s"].rlike(c.allowed))

    def merged(r: Column, ends: Column) -> Column:
        """Union of the windows that end at ``ends``, which are sorted."""
        first = F.filter(ends, lambda e, i: F.coalesce(e - F.get(ends, i - 1) > c.window, F.lit(True)))
        last = F.filter(ends, lambda e, i: F.coalesce(F.get(ends, i + 1) - e > c.window, F.lit(True)))
        return let(last, lambda z: F.transform(first, lambda a, i: F.struct(
            (r["start"] + a - c.window + 1).alias("start"), (r["start"] + F.get(z, i) + 1).alias("end"))))

    found = F.flatten(F.transform(wanted, lambda r: let(
        _window_places(r["s"], c.window, c.bits), lambda ends: merged(r, ends))))
    return _spans(found, c.kind)


def entropy_spans(text: Column, classes: tuple[CharClass, ...] = CLASSES) -> Column:
    """Spans of windows with high entropy, sorted by start, then kind."""
    t = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[_class_spans(t, c) for c in classes]))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, text: str = "text", classes: tuple[CharClass, ...] = CLASSES) -> DataFrame:
    """Add ``base_spans`` (known kinds) and ``all_spans`` (with high-entropy windows) to every document."""
    return docs.withColumn("base_spans", known_spans(F.col(text))).withColumn(
        "all_spans", F.sort_array(F.concat("base_spans", entropy_spans(F.col(text), classes))))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each union of overlapping spans replaced by ``mark``; null stays null."""
    def of(s: Column) -> Column:
        reach = running_max(F.transform(s, lambda x: x["end"]))
        return let(reach, lambda ends: let(
            F.filter(s, lambda x, i: F.coalesce(x["start"] > F.get(ends, i - 1), F.lit(True))),
            lambda firsts: let(
                F.filter(ends, lambda e, i: F.coalesce(F.get(s, i + 1)["start"] > e, F.lit(True))),
                lambda lasts: F.concat(
                    F.array_join(F.transform(firsts, lambda x, i: F.concat(
                        let(F.coalesce(F.get(lasts, i - 1), F.lit(0)), lambda a: F.substring(text, a + 1, x["start"] - a)),
                        F.lit(mark))), ""),
                    let(F.element_at(lasts, -1), lambda a: F.substring(text, a + 1, F.char_length(text) - a))))))

    return F.when(F.size(spans) > 0, let(spans, of)).otherwise(text)


def running_max(values: Column) -> Column:
    """Inclusive running maxima of an array, by doubling."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    return F.aggregate(rounds, values, lambda acc, k: F.transform(
        acc, lambda x, i: F.greatest(x, F.get(acc, i - F.pow(F.lit(2), k).cast("int")))))
