"""Source divergence audit: how the vocabulary of each source differs from the others of its language.

Counting: the terms of a batch of documents are put into buckets by length.  Up to 8 bytes are one 64-bit word and up
to 16 bytes two; each bucket is sorted by radix, 16 bits a pass, and equal neighbours are counted as runs.  Longer
terms have a bucket for each length, sorted as bytes.  Tokens enter the sorts in the order of (group, document), and
the sorts are stable, so one run gives both the occurrences in a group and the number of documents.
Spark adds the counts of the batches up by (lang, source, term), then keeps the terms of a language that at least
``MIN_DOCS`` of its documents hold.

Rates are integers, ``1 + floor(10^9 (count + 1) / (N + V))``, and all arithmetic is exact.  The divergence of two
sources, ``floor((p - q)^2 / q)`` summed over all kept terms, is added up by each task for its terms as a matrix of the
language's sources and then by Spark; the result has a row for each pair of sources, so that matrix is no larger than it.

Defined results: null text, lang and source count as empty strings; each row is a document, repeated rows too; a group
without terms, and a language without kept terms, still has its pairs (value 0).  An empty table gives an empty
result.  Ids are not read; other columns are ignored.  A text may have any length; a batch holds one at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written
from .terms import LETTERS, digits_of, find_terms, gathered, packed, radix_order, text_bytes

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Bytes of text counted at once, and bytes of terms matched against the sources at once.
BATCH_BYTES = 8 << 20
COUNTS = "lang string, source string, term string, n long, df long"
SUMS = "lang string, source string, part string, item string, value long"
#: Cells of one matrix of terms by sources.
CELLS = 1 << 20


def _runs(order: np.ndarray, changed: np.ndarray, groups: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """First token, group, occurrences and documents of each run of one term in one group."""
    groups, docs = groups[order], docs[order]
    new = changed.copy()
    new[1:] |= groups[1:] != groups[:-1]
    fresh = new.copy()
    fresh[1:] |= docs[1:] != docs[:-1]
    at = np.flatnonzero(new)
    return order[at], groups[at], np.diff(np.append(at, len(order))), np.add.reduceat(fresh.astype(np.int64), at)


def _changes(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def count_terms(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray, docs: np.ndarray) -> Iterator[tuple]:
    """Bytes of the terms, groups, occurrences and documents, one tuple a length bucket; tokens come by group, then document."""
    edges = [(0, 2), (2, 4), (4, 6), (6, 8), (8, 16)]
    for low, high in edges:
        here = np.flatnonzero((lengths > low) & (lengths <= high))
        if not len(here):
            continue
        s, size = starts[here], lengths[here]
        words = [packed(data, s, size)] + ([packed(data, s, size, 8)] if high == 16 else [])
        order = radix_order([d for w in words for d in digits_of(w, min(high, 8))])
        first, g, n, df = _runs(order, _changes(*[w[order] for w in words]), groups[here], docs[here])
        yield np.stack([w[first] for w in words], axis=1).astype("<u8").view(f"S{8 * len(words)}")[:, 0], g, n, df
    for length in np.unique(lengths[lengths > 16]):
        here = np.flatnonzero(lengths == length)
        values = data[starts[here][:, None] + np.arange(length)].view(f"S{length}")[:, 0]
        order = np.argsort(values, kind="stable")
        first, g, n, df = _runs(order, _changes(values[order]), groups[here], docs[here])
        yield values[first], g, n, df


def _count_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    for table in gathered(batches, BATCH_BYTES):
        lang, source = (pc.fill_null(table[c], "").combine_chunks() for c in ("lang", "source"))
        pairs = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"]).aggregate([])
        names = {x: i for i, x in enumerate(zip(pairs["lang"].to_pylist(), pairs["source"].to_pylist()))}
        group = np.array([names[x] for x in zip(lang.to_pylist(), source.to_pylist())], dtype=np.int64)
        data, offsets = text_bytes(table["text"])
        starts, lengths, docs = find_terms(data, offsets, LETTERS)
        groups = group[docs]
        by_group = radix_order([(groups & 0xFFFF).astype(np.uint16), (groups >> 16).astype(np.uint16)])
        none = np.arange(len(names))
        # a group's row without a term tells that the group occurs
        found = [(np.full(len(none), b"", dtype="S1"), none, np.zeros(len(none), dtype=np.int64), np.zeros(len(none), dtype=np.int64))]
        found += count_terms(data, starts[by_group], lengths[by_group], groups[by_group], docs[by_group])
        for terms, g, n, df in found:
            yield pa.RecordBatch.from_arrays([
                pairs["lang"].combine_chunks().take(pa.array(g)), pairs["source"].combine_chunks().take(pa.array(g)),
                pa.array(terms).cast(pa.string()), pa.array(n), pa.array(df)], names=["lang", "source", "term", "n", "df"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df``: occurrences and documents of every term; one row with an empty term for every group."""
    partial = map_batches(docs.select("lang", "source", "text"), _count_batches, COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def rates(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE (counts + 1) / total)`` by long division, three digits a step, so nothing overflows below 9 10^15."""
    out, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _best(values: np.ndarray, terms: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` largest values; among equal ones the terms that come first as UTF-8."""
    if len(values) <= top:
        return np.arange(len(values))
    least = np.partition(values, len(values) - top)[len(values) - top]
    over, level = np.flatnonzero(values > least), np.flatnonzero(values == least)
    return np.concatenate([over, level[np.argsort(terms[level].astype(object), kind="stable")[: top - len(over)]]])


class _Matcher:
    """Pair sums and best terms of one task."""

    def __init__(self, groups: dict[str, dict[str, int]], totals: dict[str, np.ndarray], langs: dict[str, int], top: int):
        self.groups, self.totals, self.langs, self.top = groups, totals, langs, top
        self.sums: dict[str, np.ndarray] = {}
        self.terms: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, lang: str, terms: np.ndarray, n: np.ndarray, row: np.ndarray, column: np.ndarray, count: np.ndarray) -> None:
        names, total = self.groups[lang], self.totals[lang]
        sums = self.sums.setdefault(lang, np.zeros((len(names), len(names)), dtype=np.int64))
        counts = np.zeros((len(terms), len(names)), dtype=np.int64)
        counts[row, column] = count
        p = rates(counts, total[None, :])
        for a in range(len(names)):
            sums[a] += divergence(p[:, a : a + 1], p).sum(axis=0)
        q = rates(n, np.int64(self.langs[lang]))
        for source, a in names.items():
            here = np.flatnonzero((counts[:, a] > 0) & (p[:, a] > q))
            values = divergence(p[here, a], q[here])
            best = _best(values, terms[here], self.top)
            self.terms.setdefault((lang, source), []).append((values[best], terms[here[best]]))

    def rows(self) -> Iterator[tuple]:
        for lang, sums in self.sums.items():
            names = list(self.groups[lang])
            for a, source in enumerate(names):
                yield from ((lang, source, "pair", names[b], int(v)) for b, v in enumerate(sums[a]) if b != a)
        for (lang, source), parts in self.terms.items():
            values, terms = (np.concatenate(x) for x in zip(*parts))
            for i in _best(values, terms, self.top):
                yield lang, source, "term", terms[i].decode("utf-8"), int(values[i])


def _match(batches: Iterator, make) -> Iterator:
    import pyarrow as pa

    matcher = make()
    for table in gathered(batches, BATCH_BYTES):
        lang = table["lang"].combine_chunks().dictionary_encode()
        terms = np.array(table["term"].cast(pa.binary()).to_pylist(), dtype=object)
        n, per = table["n"].to_numpy(), table["per"].combine_chunks()
        sizes = per.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(n)), sizes)
        entries = per.flatten()
        source = entries.field("source").dictionary_encode()
        codes, count = source.indices.to_numpy(), entries.field("n").to_numpy()
        for k, name in enumerate(lang.dictionary.to_pylist()):
            places = matcher.groups[name]
            column = np.array([places.get(s, -1) for s in source.dictionary.to_pylist()], dtype=np.int64)
            mine = lang.indices.to_numpy() == k
            step = max(1, CELLS // len(places))
            rows = np.flatnonzero(mine)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                local = np.full(len(n), -1)
                local[part] = np.arange(len(part))
                here = np.flatnonzero(local[row] >= 0)
                matcher.add(name, terms[part], n[part], local[row[here]], column[codes[here]], count[here])
    found = list(matcher.rows())
    for at in range(0, len(found), 50_000):
        yield pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "part", "item", "value"), r)) for r in found[at : at + 50_000]], schema=pa.schema(
            [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(lang, source, text)``.

    Part ``pair``: every other source of the language with the divergence from it.  Part ``term``: the ``top`` kept terms
    that the source has at a higher rate than its language, by their divergence.  Ranks follow the value downwards, then
    the item.  The driver sees one row for each group (lang, source).
    """
    counts = written(term_counts(docs), "term-counts")
    kept = written(
        counts.where("term <> ''").groupBy("lang", "term")
        .agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("per"))
        .where(F.col("df") >= min_docs).select("lang", "term", "n", "per"), "kept-terms")
    found = counts.where("term = ''").select("lang", "source")
    own = kept.select("lang", F.inline("per")).groupBy("lang", "source").agg(F.sum("n").alias("own"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("all"))
    seen = found.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0).orderBy("lang", "source").collect()
    groups: dict[str, dict[str, int]] = {}
    totals: dict[str, list[int]] = {}
    langs: dict[str, int] = {}
    for r in seen:
        groups.setdefault(r["lang"], {})[r["source"]] = len(totals.setdefault(r["lang"], []))
        totals[r["lang"]].append(r["own"] + r["kept"])
        langs[r["lang"]] = r["all"] + r["kept"]
    sums = {k: np.array(v, dtype=np.int64) for k, v in totals.items()}
    matched = written(map_batches(kept, lambda b: _match(b, lambda: _Matcher(groups, sums, langs, top)), SUMS), "divergences")
    pairs = found.join(found.withColumnRenamed("source", "item"), "lang").where("source <> item").join(
        matched.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), ["lang", "source", "item"], "left")
    shown = ["lang", "source", "part", "item", "value"]
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    # a first cut in parts of the terms, so that no source gathers what every task found
    parts = _ranked(matched.where("part = 'term'").select(*shown), [F.pmod(F.xxhash64("item"), F.lit(16))]).where(F.col("rank") <= top)
    return _ranked(pairs, []).union(_ranked(parts.select(*shown), []).where(F.col("rank") <= top))


def _ranked(rows: DataFrame, more: list) -> DataFrame:
    order = Window.partitionBy("lang", "source", *more).orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))
