"""Declarations and imports from source text.

Lines are scanned inside one JVM expression per file; a file never has to be
regrouped.  Comment blocks are found by running maxima over the classified lines.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths as P
from ..functions import records as R
from ..functions import text as X

DECLARATION = (
    "(?i)^(?:(?:" + "|".join(C.DECLARATION_MODIFIERS) + r")\s+)*(" + "|".join(C.DECLARATION_KEYWORDS) + r")\s+([A-Za-z_][A-Za-z0-9_]*)"
)
COMMENT = r"^(//|#|/\*|\*|--)"
LOOK_UP = 8

#: ``extractor(path, content) -> (symbols, imports)``; a symbol is (name, kind, line, exported).
Extractor = Callable[[str, str], tuple[list[tuple[str, str, int, bool]], list[str]]]


def clean_import(target: Column) -> Column:
    return F.regexp_replace(F.trim(target), "^[\"'`]+|[\"'`]+$", "")


def matching_lines(content: Column, *patterns: tuple[str, bool]) -> Column:
    """``{line, text}`` of code lines that match, or do not match, every pattern."""
    def numbered(raw: Column, at: Column) -> Column:
        return F.struct((at + 1).alias("line"), R.strip(raw).alias("text"))

    def wanted(s: Column) -> Column:
        ok = (s["text"] != "") & ~F.regexp_like(s["text"], F.lit(COMMENT))
        for pattern, expect in patterns:
            found = F.regexp_like(s["text"], F.lit(pattern))
            ok = ok & (found if expect else ~found)
        return ok

    return F.filter(F.transform(F.split(content, "\n"), numbered), wanted)


def _code(files: DataFrame) -> DataFrame:
    return files.where(~P.extension(F.col("path")).isin(*C.PROSE_EXTENSIONS))


def declaration(text: Column) -> list[Column]:
    """Name, kind and whether it is exported, of a line that declares something."""
    name, keyword = F.regexp_extract(text, DECLARATION, 2), F.lower(F.regexp_extract(text, DECLARATION, 1))
    exported = F.regexp_like(F.lower(text), F.lit("^(export|pub|public) ")) | F.regexp_like(name, F.lit("^[A-Z]"))
    kind = F.when(keyword.isin(*C.FUNCTION_KEYWORDS), "function").otherwise(keyword)
    return [name.alias("name"), kind.alias("kind"), exported.alias("exported")]


def _join_doc(parts: Column) -> Column:
    return R.strip(F.array_join(F.slice(F.filter(parts, lambda p: p != ""), 1, C.DOC_LINES), "\n"))


def _line_kinds(lines: Column) -> Column:
    """One struct a line: stripped text, comment mark, and by running maxima the last line that says something, the
    first line of the comment run it stands in, and the last line that opens a block comment (places from 0, or -1)."""
    def kind(text: Column) -> Column:
        skip = (text == "") | F.startswith(text, F.lit("@"))
        return F.when(skip, "").when(F.startswith(text, F.lit("//")), "//").when(F.startswith(text, F.lit("#")), "#").otherwise("x")

    rows = F.transform(F.transform(lines, R.strip), lambda t: F.struct(t.alias("text"), kind(t).alias("kind")))

    def seen(rows: Column, found) -> Column:
        return X.running_max(F.transform(rows, lambda r, i: F.when(found(r, i), i).otherwise(-1)))

    def same(rows: Column, r: Column, i: Column) -> Column:
        return (i > 0) & (F.get(rows, i - 1)["kind"] == r["kind"])

    def joined(rows: Column) -> Column:
        return X.let(seen(rows, lambda r, i: r["kind"] != ""), lambda solid: X.let(
            seen(rows, lambda r, i: ~same(rows, r, i)), lambda first: X.let(
                seen(rows, lambda r, i: F.contains(r["text"], F.lit("/*"))), lambda opened: F.transform(rows, lambda r, i: F.struct(
                    r["text"].alias("text"), r["kind"].alias("kind"), F.get(solid, i).alias("solid"), F.get(first, i).alias("first"),
                    F.get(opened, i).alias("opened"))))))

    return X.let(rows, joined)


def _texts(rows: Column, first: Column, last: Column) -> Column:
    return F.transform(F.slice(rows, first + 1, F.greatest(last - first + 1, F.lit(0))), lambda r: r["text"])


def comment_above(rows: Column, line: Column) -> Column:
    """Comment that ends just above a declaration, blank and ``@`` lines skipped (N10); ``rows`` from ``_line_kinds``."""
    def block(at: Column, end: Column) -> Column:
        marked = _texts(rows, end["first"], at)
        slashes = F.transform(marked, lambda t: R.strip(F.regexp_replace(R.strip(F.substr(t, F.lit(3))), "^/", "")))
        hashes = F.transform(marked, lambda t: R.strip(F.substr(t, F.lit(2))))
        whole = F.array_join(_texts(rows, F.greatest(end["opened"], F.lit(0)), at), "\n")
        inside = F.split(F.regexp_extract(whole, r"(?s)/\*(.*?)(?:\*/|\z)", 1), "\n")
        starred = F.transform(inside, lambda t: R.strip(F.regexp_replace(R.strip(t), r"^\*", "")))
        return (
            F.when(end["kind"] == "//", _join_doc(slashes)).when(end["kind"] == "#", _join_doc(hashes))
            .when(F.contains(end["text"], F.lit("*/")), _join_doc(starred)).otherwise("")
        )

    nearest = F.coalesce(F.get(rows, line - 2)["solid"], F.lit(-1))
    return X.let(nearest, lambda at: F.when(
        (at >= 0) & (at >= line - LOOK_UP), X.let(F.get(rows, at), lambda end: block(at, end))).otherwise(""))


def docstring_below(rows: Column, line: Column) -> Column:
    """Triple-quoted text right below a declaration (F26); ``rows`` from ``_line_kinds``."""
    def of(below: Column) -> Column:
        skipped = F.size(F.filter(below, lambda r, i: ~F.exists(F.slice(below, 1, i + 1), lambda x: x["kind"] != "")))
        text = F.array_join(F.transform(F.slice(below, skipped + 1, C.DOC_LINES), lambda r: r["text"]), "\n")
        return X.let(text, lambda t: F.when(F.substr(t, F.lit(1), F.lit(3)).isin('"""', "'''"), _join_doc(F.split(
            F.split(F.substr(t, F.lit(4)), F.substr(t, F.lit(1), F.lit(3)), 2)[0], "\n"))).otherwise(""))

    return X.let(F.slice(rows, line + 1, C.DOC_LINES), of)


def docs_at(content: Column, at: Column) -> Column:
    """Doc block of each of the declaration lines ``at`` (counted from 1) of one file."""
    def doc(rows: Column, line: Column) -> Column:
        return X.let(comment_above(rows, line), lambda above: F.when(above != "", above).otherwise(docstring_below(rows, line)))

    return X.let(_line_kinds(F.split(content, "\n")), lambda rows: F.transform(at, lambda line: doc(rows, line)))


def generic_symbols(files: DataFrame, docs: bool = True) -> DataFrame:
    """Declarations, with their doc block unless ``docs`` is off."""
    found = _code(files).select(
        "checkout", "path", "content", matching_lines(F.col("content"), (DECLARATION, True)).alias("s")
    ).where(F.size("s") > 0)
    text = docs_at(F.col("content"), F.transform("s", lambda x: x["line"])) if docs else F.transform("s", lambda x: F.lit(""))
    rows = found.withColumn("docs", text).select("checkout", "path", F.posexplode(F.arrays_zip("s", "docs")).alias("seq", "z"))
    named = rows.select(
        "checkout", F.col("path").alias("file_path"), "seq", F.col("z.s.line").alias("line"), F.col("z.docs").alias("doc"),
        *declaration(F.col("z.s.text")),
    )
    return named.where(~F.lower("name").isin(*C.DECLARATION_STOP_NAMES)).select(
        "checkout", "file_path", "seq", "name", "kind", "line", "doc", "exported"
    )


def generic_edges(files: DataFrame) -> DataFrame:
    """Import lines that declare nothing."""
    lines = matching_lines(F.col("content"), (C.IMPORT_PATTERN, True), (DECLARATION, False))
    found = _code(files).select("checkout", "path", F.inline(lines))
    return found.select(
        "checkout", F.col("path").alias("from_file"),
        clean_import(F.regexp_extract("text", C.IMPORT_PATTERN, 1)).alias("to_path"), F.lit("import").alias("edge_type"),
    )


# Top-level declarations of Gleam, and the constructors inside a type.
GLEAM_TOP = re.compile(
    r"^(?:(?P<pub>pub )?(?:pub\s+)?(?:fn\s+(?P<function>[A-Za-z_]\w*)|(?:opaque\s+)?type\s+(?P<type>[A-Za-z_]\w*)"
    r"|const\s+(?P<constant>[A-Za-z_]\w*))|import\s+(?P<target>[\w/]+))", re.A | re.M)
GLEAM_CONSTRUCTOR = re.compile(r"^[ \t]*([A-Z]\w*)\s*?(?:\(|$)", re.A | re.M)


def gleam_extractor(path: str, content: str):
    """Gleam files (F25): top-level declarations, and constructors between the braces of a type.

    Declarations are those at the start of a line outside every type's braces; braces are matched by running sums.
    """
    symbols, imports, end = [], [], 0
    breaks = [m.start() for m in re.finditer("\n", content)]
    for m in GLEAM_TOP.finditer(content):
        if m.start() < end:
            continue
        if m["target"]:
            imports.append(m["target"])
            continue
        kind, public = m.lastgroup if m.lastgroup != "pub" else "type", m["pub"] is not None
        line = bisect_left(breaks, m.start())
        symbols.append((m[kind], kind, line + 1, public))
        stop = breaks[line] if line < len(breaks) else len(content)
        if kind == "type" and "{" in content[m.end() : stop]:
            braces = [(b.start(), 1 if b[0] == "{" else -1) for b in re.finditer(r"[{}]", content[m.end() :])]
            depths = accumulate(step for _, step in braces)
            end = m.end() + next((at for (at, _), depth in zip(braces, depths) if depth == 0), len(content))
            inside = GLEAM_CONSTRUCTOR.finditer(content, stop + 1, max(end, stop + 1))
            symbols += [(c[1], "constructor", bisect_left(breaks, c.start(1)) + 1, public) for c in inside]
    return symbols, imports


DEFAULT_EXTRACTORS: dict[str, Extractor] = {".gleam": gleam_extractor}
EXTRACTED = (
    "checkout string, path string, content string, "
    "symbols array<struct<name: string, kind: string, line: int, exported: boolean>>, imports array<string>"
)


def custom_rows(files: DataFrame, extractors: dict[str, Extractor]) -> DataFrame:
    """Run plug-in extractors on files of their extension (G2); one row a file that has anything."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for checkout, path, content in zip(frame["checkout"], frame["path"], frame["content"]):
                use = extractors.get("." + path.rsplit(".", 1)[-1].lower())
                symbols, imports = use(path, content) if use else ([], [])
                if symbols or imports:
                    named = [dict(zip(("name", "kind", "line", "exported"), x)) for x in symbols]
                    rows.append((checkout, path, content, named, list(imports)))
            yield pd.DataFrame(rows, columns=["checkout", "path", "content", "symbols", "imports"])

    wanted = files.where(P.extension(F.col("path")).isin(*extractors)).select("checkout", "path", "content")
    return wanted.mapInPandas(run, EXTRACTED)


def extract(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> tuple[DataFrame, DataFrame]:
    """Symbols and import edges of ``files[checkout, path, content]``.

    Files with a plug-in extractor use it; when it finds nothing, and for every
    other file, the generic scan does.
    """
    extractors = DEFAULT_EXTRACTORS if extractors is None else extractors
    if not extractors:
        return generic_symbols(files), generic_edges(files)
    custom = custom_rows(files, extractors)
    done = custom.select("checkout", "path").distinct()
    docs = docs_at(F.col("content"), F.transform("symbols", lambda x: x["line"]))
    zipped = custom.select("checkout", "path", F.posexplode(F.arrays_zip("symbols", docs.alias("docs"))).alias("seq", "z"))
    own_symbols = zipped.select(
        "checkout", F.col("path").alias("file_path"), "seq", F.col("z.symbols.name").alias("name"), F.col("z.symbols.kind").alias("kind"),
        F.col("z.symbols.line").alias("line"), F.col("z.docs").alias("doc"), F.col("z.symbols.exported").alias("exported"),
    )
    own_edges = custom.select("checkout", F.col("path").alias("from_file"), F.explode("imports").alias("to_path")).withColumn(
        "edge_type", F.lit("import"))
    rest = files.join(done, ["checkout", "path"], "left_anti")
    return (
        own_symbols.unionByName(generic_symbols(rest)),
        own_edges.unionByName(generic_edges(rest)),
    )
