"""Path expressions, including the paths named by a diff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .records import strip
from .text import let


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Parent directory, empty at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def ancestors(path: Column) -> Column:
    """Every directory above the path, the top as an empty string."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def is_under(path: Column, directory: Column) -> Column:
    """The directory itself or anything below; an empty directory holds nothing."""
    return (directory != "") & ((path == directory) | F.startswith(path, F.concat(directory, F.lit("/"))))


def in_scope(path: Column, scope: Column) -> Column:
    """Like ``is_under`` but an empty scope or ``.`` holds everything."""
    clean = F.regexp_replace(F.coalesce(scope, F.lit("")), "^/+|/+$", "")
    return clean.isin("", ".") | is_under(path, clean)


def escapes_root(path: Column) -> Column:
    """True for ``.``, absolute paths and paths that climb out.

    The depth after every segment is a running sum, so ``a/../../b`` is caught.
    """
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    steps = F.transform(segments, lambda s: F.when(s == "..", -1).otherwise(1))
    walk = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, s: F.struct((acc["at"] + s).alias("at"), F.least(acc["low"], acc["at"] + s).alias("low")),
    )
    return F.startswith(path, F.lit("/")) | (walk["low"] < 0) | (walk["at"] == 0)


def is_binary_name(path: Column) -> Column:
    return extension(path).isin(*C.BINARY_EXTENSIONS)


def is_binary_content(content: Column) -> Column:
    """Non-empty and not UTF-8, or holding a NUL byte."""
    broken = ~F.is_valid_utf8(content.cast("string"))
    has_nul = F.position(F.lit(b"\x00"), content) > 0
    return (F.octet_length(content) > 0) & (broken | has_nul)


def split_path_list(text: Column) -> Column:
    """Items between commas and line breaks, trimmed, without empties."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,\r\n]"), strip)
    return F.filter(items, lambda p: p != "")


def anchored_segment(pattern: Column) -> Column:
    """First directory of a pattern when it is literal, else null."""
    clean = F.regexp_replace(strip(pattern), "^/", "")
    first = F.regexp_replace(F.substring_index(clean, "/", 1), r"^\*+|\*+$", "")
    usable = F.contains(clean, F.lit("/")) & (first != "") & ~F.regexp_like(first, F.lit(r"[*?\[]"))
    return F.when(usable, first)


def diff_paths(diff: Column) -> Column:
    """Distinct paths a unified diff names, in first-seen order.

    A header with two quoted names gives both; a backslash keeps the next character.
    """
    # only the lines that can name a path are looked at one by one
    naming = F.regexp_extract_all(F.coalesce(diff, F.lit("")), F.lit(r"(?<![^\n])(?:diff --git |\+\+\+ |--- )[^\n]*"), F.lit(0))
    none = F.array().cast("array<string>")

    def quoted(line: Column) -> Column:
        names = F.transform(
            F.regexp_extract_all(line, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)),
            lambda x: F.regexp_replace(F.regexp_replace(x, r"\\(.)", "$1"), "^[ab]/", ""),
        )
        return let(names, lambda found: F.when(F.size(found) >= 2, F.slice(found, 1, 2)).otherwise(none))

    def plain(rest: Column) -> Column:
        return let(F.instr(rest, " b/"), lambda cut: F.when(cut == 0, none).otherwise(F.array(
            F.regexp_replace(F.substr(rest, F.lit(1), cut - 1), "^a/", ""), F.regexp_replace(F.substr(rest, cut + 1), "^b/", ""))))

    def header(line: Column) -> Column:
        return let(strip(F.substr(line, F.lit(12))), lambda rest: F.when(F.startswith(rest, F.lit('"')), quoted(line)).otherwise(plain(rest)))

    def file_line(line: Column) -> Column:
        return let(F.substring_index(strip(F.substr(line, F.lit(5))), "\t", 1), lambda rest: F.when(
            rest.isin("/dev/null", "dev/null"), none).otherwise(F.array(F.regexp_replace(rest, "^[ab]/", ""))))

    def of_line(raw: Column) -> Column:
        return let(F.regexp_replace(raw, r"\r+$", ""), lambda line: F.when(
            F.startswith(line, F.lit("diff --git ")), header(line)).otherwise(file_line(line)))

    found = F.flatten(F.transform(naming, of_line))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda p: p != ""))
