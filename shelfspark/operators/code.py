"""Code exploration: symbols, commits, imports.

A term matches anywhere inside a text, which is a theta join.  Every term is
reduced to its first characters (up to three) and every text to the pieces of
that length it contains; rows that share a piece are tested.  Symbols, commits
and edges may also come as a stored ``SubstringIndex``, which reads the texts of
candidates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths as P
from ..functions import text as X
from ..session import cut_lineage
from . import substring_index
from .sizing import lookup_join
from .substring_index import SubstringIndex

GRAM = 3


def code_terms(queries: DataFrame) -> DataFrame:
    """``[query_id, checkout, term, n_terms, need]``: ``need`` is how many terms the retry asks for, null when not allowed."""
    terms = X.search_terms(F.col("text"))
    q = queries.select("query_id", "checkout", "text", terms.alias("terms")).withColumn("n_terms", F.size("terms"))
    need = F.when(X.partial_terms_ok(F.col("text"), F.col("n_terms")), X.min_should_match(F.col("n_terms")))
    return q.select("query_id", "checkout", "n_terms", need.alias("need"), F.explode("terms").alias("term"))


def _folded_terms(terms: DataFrame) -> DataFrame:
    return terms.withColumn("term", X.ascii_fold(F.trim("term")))


def word_hits(rows: DataFrame, fields: list[str], words: DataFrame, keep: list[str]) -> DataFrame:
    """``[checkout, term, *keep, *fields, in_<field>...]`` of the distinct, folded ``words[checkout, term]`` found in any field.

    ``rows`` carries ``checkout`` and the fields; ``keep`` identifies a row.
    """
    folded = [X.ascii_fold(F.coalesce(F.col(f), F.lit(""))) for f in fields]
    text = F.concat_ws("\n", *folded)
    words = words.withColumn("gram", F.substr("term", F.lit(1), F.lit(GRAM)))
    sizes = sorted(r["n"] for r in words.select(F.char_length("gram").alias("n")).distinct().collect() if r["n"])

    def grams(chars: Column, n: int) -> Column:
        return F.transform(chars, lambda c, i: F.concat(c, *[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(1, n)]))

    # the text is folded once a row, not once a place; the last pieces are shorter
    found = X.let(F.split(text, ""), lambda chars: F.concat(*[grams(chars, n) for n in sizes])) if sizes else F.array().cast("array<string>")
    carried = list(dict.fromkeys(["checkout", *keep, *fields]))
    pieces = rows.select(*carried, F.explode(F.array_distinct(found)).alias("gram"))
    # every distinct word is tested once, however many queries hold it
    met = lookup_join(pieces, words, ["checkout", "gram"], spread=F.xxhash64(*keep)).drop("gram")
    flags = [F.contains(f, F.col("term")) for f in folded]
    hit = flags[0]
    for flag in flags[1:]:
        hit = hit | flag
    return met.where(hit).withColumns({f"in_{f}": flag for f, flag in zip(fields, flags)})


def term_hits(rows: DataFrame, fields: list[str], terms: DataFrame, keep: list[str]) -> DataFrame:
    """``word_hits`` with the queries that ask for the word: ``[query_id, n_terms, need]``."""
    asked = _folded_terms(terms)
    hits = word_hits(rows, fields, asked.select("checkout", "term").distinct(), keep)
    return lookup_join(hits, asked, ["checkout", "term"], spread=F.xxhash64(*keep))


def strict_then_partial(hits: DataFrame, asked: DataFrame, keep: list[str], sums: dict[str, str], same: list[str],
                        order: list[Column], within: list[Column], limit: int, shown: list[str]) -> DataFrame:
    """Rows with every term; the two-thirds retry only for queries without such a row.

    ``hits[checkout, term, *keep, *shown, in_<field>...]`` of distinct words, ``asked[query_id, checkout, term, n_terms,
    need]``.  ``sums`` names a flag for each count; ``order`` ranks by counts and ``same`` columns, ``within`` by other
    columns of ``keep``.

    Rows of a checkout in which the same words are found in the same fields, and which agree in ``same``, stand in the
    order ``within`` for every query.  So queries meet such groups, not rows, and a group needs only its first ``limit``
    rows.  Both classes of hits are cut to the ``limit`` best groups before they meet.
    """
    flags = list(sums.values())
    row = list(dict.fromkeys(["checkout", *keep]))
    held = F.array_sort(F.collect_list(F.struct("term", *flags))).alias("words")
    rows = hits.groupBy(*row).agg(held, *[F.first(c).alias(c) for c in shown])
    alike = ["checkout", "words", *same]
    pos = F.row_number().over(Window.partitionBy(*alike).orderBy(*within))
    members = F.array_sort(F.collect_list(F.struct("pos", *[c for c in [*row, *shown] if c not in ["checkout", *same]]))).alias("members")
    groups = rows.withColumn("pos", pos).where(F.col("pos") <= limit).groupBy(*alike).agg(members)
    # written once, which also fixes the numbers
    groups = cut_lineage(groups.withColumn("group", F.monotonically_increasing_id()))

    head = F.col("members")[0]
    words = groups.select("group", "checkout", F.explode("words").alias("word")).select("group", "checkout", "word.*")
    scored = lookup_join(words, asked, ["checkout", "term"], spread=F.col("group")).groupBy("query_id", "n_terms", "need", "group").agg(
        F.count_distinct("term").alias("n_hit"), *[F.sum(F.col(flag).cast("int")).alias(name) for name, flag in sums.items()])
    cls = F.when(F.col("n_hit") >= F.col("n_terms"), 0).when(F.col("n_hit") >= F.col("need"), 1)
    classed = scored.withColumn("class", cls).where("class IS NOT NULL").drop("n_hit", "need", "n_terms")
    heads = groups.select("group", *same, head.alias("head")).select("group", *same, "head.*")
    ranked = lookup_join(classed, heads, ["group"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id", "class").orderBy(*order, *within))
    ).where(F.col("rank") <= limit)
    best = ranked.withColumn("best", F.min("class").over(Window.partitionBy("query_id"))).where("class = best")
    chosen = cut_lineage(best.select("query_id", "group", *sums))  # at most ``limit`` groups a query
    of_group = groups.select("group", "checkout", *same, F.explode("members").alias("m")).select("group", "checkout", *same, "m.*").drop("pos")
    full = lookup_join(of_group, chosen, ["group"]).drop("group")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, *within))
    return full.withColumn("rank", at).where(F.col("rank") <= limit).select("query_id", *keep, *sums, *shown, "rank")


SYMBOL_KEEP = ["file_path", "seq", "name", "kind", "line", "exported"]
SYMBOL_FIELDS = ["name", "doc", "file_path", "package_name"]
COMMIT_KEEP = ["hash", "authored_at"]
COMMIT_FIELDS = ["subject", "body"]


def with_packages(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with the package name of their file."""
    return symbols.join(
        files.select("checkout", F.col("path").alias("file_path"), "package_name"), ["checkout", "file_path"], "left"
    )


def write_symbol_index(symbols: DataFrame, files: DataFrame, path: str, **sizes: int) -> None:
    """Store symbols for ``search_symbols``."""
    substring_index.write_substrings(with_packages(symbols, files), SYMBOL_FIELDS, SYMBOL_KEEP, path, **sizes)


def write_commit_index(commits: DataFrame, path: str, **sizes: int) -> None:
    """Store commits for ``search_commits``."""
    substring_index.write_substrings(commits, COMMIT_FIELDS, COMMIT_KEEP, path, **sizes)


def write_edge_index(edges: DataFrame, path: str, **sizes: int) -> None:
    """Store distinct edges for ``importers_by_query``."""
    substring_index.write_substrings(edges.select("checkout", *EDGE).distinct(), ["to_path"], EDGE, path, **sizes)


def _ranked_search(table: DataFrame | SubstringIndex, fields: list[str], keep: list[str], queries: DataFrame, sums: dict[str, str],
                   same: list[str], order: list[Column], within: list[Column], limit: int, shown: list[str]) -> DataFrame:
    """A stored index ranks keys and counts; the shown texts are read for the final hits only."""
    asked = _folded_terms(code_terms(queries))
    if isinstance(table, SubstringIndex):
        hits = substring_index.word_hits(table, asked.select("checkout", "term"))
        best = strict_then_partial(hits, asked, ["checkout", "row", *table.keep], sums, same, order, within, limit, [])
        return substring_index.with_fields(table, best, shown).drop("checkout", "row")
    hits = word_hits(table, fields, asked.select("checkout", "term").distinct(), keep)
    return strict_then_partial(hits, asked, keep, sums, same, order, within, limit, shown)


def search_symbols(symbols: DataFrame | SubstringIndex, files: DataFrame | None, queries: DataFrame, limit: int = C.EXPLORE_LIMIT) -> DataFrame:
    """Symbols whose name, doc, path or package holds the terms.

    Order: name hits, exported, doc hits, path, line, then ``seq``.  A stored
    index holds the packages, so it needs no ``files``.
    """
    table = symbols if isinstance(symbols, SubstringIndex) else with_packages(symbols, files)
    order = [F.desc("name_hits"), F.desc("exported"), F.desc("doc_hits")]
    within = [F.col("file_path"), F.col("line"), F.col("seq")]
    sums = {"name_hits": "in_name", "doc_hits": "in_doc"}
    return _ranked_search(table, SYMBOL_FIELDS, SYMBOL_KEEP, queries, sums, ["exported"], order, within, limit, ["doc"])


def search_commits(commits: DataFrame | SubstringIndex, queries: DataFrame, limit: int = C.EXPLORE_LIMIT) -> DataFrame:
    """Commits whose subject or body holds the terms, newest first."""
    within = [F.desc("authored_at"), F.col("hash")]
    return _ranked_search(commits, COMMIT_FIELDS, COMMIT_KEEP, queries, {}, [], [], within, limit, COMMIT_FIELDS)


def _capped(edges: DataFrame, limit: int, first: list[Column] | None = None) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(*(first or []), "from_file", "to_path", "edge_type")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


EDGE = ["from_file", "to_path", "edge_type"]


def imports_of(edges: DataFrame, files: DataFrame, limit: int = C.EXPLORE_LIMIT) -> DataFrame:
    """Distinct edges that start at a file of the query (J7): ``files[query_id, checkout, file_path]``."""
    asked = files.select("query_id", "checkout", F.col("file_path").alias("from_file")).distinct()
    found = lookup_join(edges, asked, ["checkout", "from_file"]).select("query_id", *EDGE).distinct()
    return _capped(found, limit)


def file_keys(path: Column) -> Column:
    """Directory, path and path without its extension, as import targets name them."""
    stem = F.when(P.extension(path) != "", F.regexp_replace(path, r"\.[^./]*$", "")).otherwise("")
    return F.array_distinct(F.filter(F.array(P.dir_name(path), path, stem), lambda k: ~k.isin("", ".")))


def importers_by_file(edges: DataFrame, files: DataFrame, limit: int = C.EXPLORE_LIMIT) -> DataFrame:
    """Distinct edges whose target is a key of a file, or ends with ``/key``.

    Every target lists its suffixes after a slash, which makes the suffix match
    an equi join.  Suffixes fold ASCII case, the whole target does not.
    """
    keys = files.select("query_id", "checkout", F.explode(file_keys(F.col("file_path"))).alias("key")).distinct()
    exact = lookup_join(edges.withColumn("key", F.col("to_path")), keys, ["checkout", "key"])
    parts = F.split(X.ascii_fold(F.col("to_path")), "/")
    suffixes = F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/")
    )
    tails = edges.where(F.contains("to_path", F.lit("/"))).withColumn("key", F.explode(suffixes))
    folded = keys.select("query_id", "checkout", X.ascii_fold(F.col("key")).alias("key")).distinct()
    ending = lookup_join(tails, folded, ["checkout", "key"])
    found = exact.select("query_id", *EDGE).unionByName(ending.select("query_id", *EDGE)).distinct()
    return _capped(found, limit)


def importers_by_query(edges: DataFrame | SubstringIndex, queries: DataFrame, limit: int = C.EXPLORE_LIMIT) -> DataFrame:
    """Distinct edges whose target holds every query term."""
    if isinstance(edges, SubstringIndex):
        hits = substring_index.term_hits(edges, code_terms(queries))
    else:
        # a target is tested once, however many files import it
        hits = term_hits(edges.select("checkout", "to_path").distinct(), ["to_path"], code_terms(queries), ["checkout", "to_path"])
        held = hits.groupBy("query_id", "n_terms", "checkout", "to_path").agg(F.count_distinct("term").alias("n")).where("n = n_terms")
        found = lookup_join(edges, held.select("query_id", "checkout", "to_path"), ["checkout", "to_path"])
        return _capped(found.select("query_id", *EDGE).distinct(), limit)
    full = hits.groupBy("query_id", "n_terms", *EDGE).agg(F.count_distinct("term").alias("n")).where("n = n_terms")
    return _capped(full.select("query_id", *EDGE), limit)


def merge_edges(first: DataFrame, second: DataFrame, limit: int = C.EXPLORE_LIMIT) -> DataFrame:
    """Concatenate, drop repeats, cap (J11): the first list comes first."""
    both = first.select("query_id", *EDGE, F.lit(0).alias("src")).unionByName(
        second.select("query_id", *EDGE, F.lit(1).alias("src"))
    )
    merged = both.groupBy("query_id", *EDGE).agg(F.min("src").alias("src"))
    return _capped(merged, limit, [F.col("src")]).drop("src")


def importers_of(edges: DataFrame, files: DataFrame, queries: DataFrame | None = None, limit: int = C.EXPLORE_LIMIT,
                 index: SubstringIndex | None = None) -> DataFrame:
    """Importers by file, then by query if there are queries; ``index`` holds the edges for the latter."""
    by_file = importers_by_file(edges, files, limit)
    return by_file if queries is None else merge_edges(by_file, importers_by_query(index or edges, queries, limit), limit)


def symbols_in_order(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy("checkout", "file_path", "line", "seq")


def counts_per_checkout(table: DataFrame) -> DataFrame:
    return table.groupBy("checkout").agg(F.count("*").alias("n"))

