"""Text expressions: tokens, terms, BM25 arithmetic and snippets."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C

WORD = r"[\p{L}\p{N}]+"


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letter, derived from Unicode NFD."""
    pairs = []
    for block in (range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        for code in block:
            decomposed = unicodedata.normalize("NFD", chr(code))
            if len(decomposed) > 1 and decomposed[0].isascii():
                pairs.append((chr(code), decomposed[0].lower()))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


FOLD_FROM, FOLD_TO = _fold_table()
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
_MARKS = re.compile(r"[\W_]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``.

    An expression named twice inside a lambda would run again for every element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def string_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def query_tokens(text: Column) -> Column:
    """Runs of letters and numbers, case kept (F1)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def content_terms(tokens: Column) -> Column:
    """Tokens without stopwords, first spelling of every lower-case word (F2)."""
    def pick(bound: Column) -> Column:
        keep = F.filter(
            F.array_distinct(bound["low"]), lambda w: ~F.array_contains(string_array(C.STOPWORDS), w)
        )
        return F.transform(
            keep, lambda w: F.element_at(bound["raw"], F.array_position(bound["low"], w).cast("int"))
        )

    return let(F.struct(tokens.alias("raw"), F.transform(tokens, F.lower).alias("low")), pick)


def search_terms(text: Column) -> Column:
    """Lower-case content terms; the trimmed text itself when none is left."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    terms = F.transform(content_terms(query_tokens(raw)), F.lower)
    return (
        F.when(raw == "", F.array().cast("array<string>"))
        .when(F.size(terms) == 0, F.array(raw))
        .otherwise(terms)
    )


def min_should_match(n: Column) -> Column:
    """All of up to two terms, else two thirds rounded up."""
    return F.when(n <= 2, n).otherwise(F.floor((2 * n + 2) / 3)).cast("int")


def partial_terms_ok(text: Column, n_terms: Column) -> Column:
    """Whether the two-thirds retry is allowed."""
    words = F.filter(
        F.split(F.coalesce(text, F.lit("")), r"\s+"),
        lambda w: (w != "") & ~F.array_contains(string_array(C.STOPWORDS), F.lower(w)),
    )
    return (min_should_match(n_terms) < n_terms) & (F.size(words) > 1)


def fold(text: Column) -> Column:
    """Lower case without accents (F6, before stemming)."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def index_tokens(*texts: Column) -> Column:
    """Folded tokens of all indexed columns, in order."""
    joined = F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])
    return F.regexp_extract_all(fold(joined), F.lit(WORD), F.lit(0))


def bm25_idf(n_docs: Column, df: Column) -> Column:
    raw = F.log((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return F.greatest(raw, F.lit(C.BM25_IDF_FLOOR))


def bm25_term(idf: Column, tf: Column, length: Column, avg_length: Column) -> Column:
    """One term's share of the score (F7); higher is better."""
    norm = F.lit(1.0 - C.BM25_B) + F.lit(C.BM25_B) * length / avg_length
    return idf * (tf * F.lit(C.BM25_K1 + 1.0)) / (tf + F.lit(C.BM25_K1) * norm)


def ascii_fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def contains_term(text: Column, term: Column) -> Column:
    """Literal substring, folding ASCII case only."""
    return F.contains(ascii_fold(F.coalesce(text, F.lit(""))), ascii_fold(F.trim(term)))


def snippet(body: Column, terms: Column) -> Column:
    """A window around the earliest lower-case term (F11); ``terms`` from F3 tokens."""
    def window(flat: Column) -> Column:
        hits = F.filter(
            let(F.lower(flat), lambda low: F.transform(terms, lambda t: F.instr(low, t))), lambda p: p > 0
        )
        first = F.coalesce(F.array_min(hits), F.lit(0)) - 1
        start = F.when(first >= C.SNIPPET_LEAD, first - C.SNIPPET_LEAD).otherwise(0)
        return let(
            start,
            lambda at: F.concat(
                F.when(at > 0, "...").otherwise(""),
                F.substr(flat, at + 1, F.lit(C.SNIPPET_WINDOW)),
                F.when(F.char_length(flat) > at + C.SNIPPET_WINDOW, "...").otherwise(""),
            ),
        )

    return let(F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " ")), window)


def _best_passage(body: str, terms, width: int) -> str:
    words = body.split()
    wanted = set(terms)
    hits = []
    for i, key in enumerate(body.lower().split()):  # lower case moves no word boundary
        if not key.isascii():
            key = key.translate(_FOLD)
        if not key.isalnum():
            key = _MARKS.sub("", key)
        if key in wanted:
            hits.append((i, key))
    best, start, counts, left = 0, 0, {}, 0
    for at, key in hits:
        counts[key] = counts.get(key, 0) + 1
        while hits[left][0] <= at - width:
            gone = hits[left][1]
            counts[gone] -= 1
            if not counts[gone]:
                del counts[gone]
            left += 1
        if len(counts) > best:
            best, start = len(counts), hits[left][0]
    return ("..." if start else "") + " ".join(words[start : start + width]) + ("..." if start + width < len(words) else "")


def match_snippet(body: Column, terms: Column, width: int = 40) -> Column:
    """The ``width``-word window holding the most distinct terms, earliest wins.

    ``terms`` are folded tokens.  Equal in purpose to the reference's passage,
    not byte-equal.  Meant for the final hits: one Arrow batch helper.
    """

    @F.pandas_udf(T.StringType())
    def passage(bodies: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([_best_passage(b or "", t if t is not None else (), width) for b, t in zip(bodies, wanted)])

    return passage(body, terms)


def doc_summary(doc: Column) -> Column:
    """First line of a comment block."""
    return F.trim(F.substring_index(F.trim(doc), "\n", 1))


def doc_block(doc: Column) -> Column:
    """The whole block when it has more than one line, else empty."""
    return F.when(F.contains(F.trim(doc), F.lit("\n")), F.trim(doc)).otherwise("")


def query_for_embedding(model: Column, text: Column) -> Column:
    """Adds the instruction prefix some models expect."""
    instruct = F.startswith(F.lower(F.trim(model)), F.lit(C.INSTRUCT_MODEL))
    return F.when(instruct, F.concat(F.lit(C.INSTRUCT_PREFIX), text)).otherwise(text)


def running_max(values: Column) -> Column:
    """Inclusive running maxima of an array, by doubling."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    return F.aggregate(rounds, values, lambda acc, k: F.transform(
        acc, lambda x, i: F.greatest(x, F.get(acc, i - F.pow(F.lit(2), k).cast("int")))))
