"""Ranked lexical search over bit-sliced Bloom signatures.

Index: documents are put into blocks of like vocabulary size.  A block's signature is a bit matrix with a row for each
hash position and a column for each document; a document sets ``HASHES`` positions for each of its terms and, again,
for each higher step of ``STEPS`` that the term's number of occurrences reaches.  The rows at a term's positions, ANDed,
are a bitmap of the documents that may hold it so often: a document that does is always in it, others rarely are.
Beside the signature the block keeps the exact counts of its documents.

Search: the highest step whose bitmap has a document bounds the term's occurrences there, and the weighted sum over an
item's terms bounds its score.  Each task rescores exactly every document whose bound is not below the score that ``k``
documents it has rescored reach, so no document that can be among the best ``k`` is left out.

Documents never move: blocks are made, bounded and rescored where they lie, and only statistics of the asked terms and
the best ``k`` of each task are shuffled.  Asked items are cut into sets of about ``MAX_ASKED`` terms; each set travels with
the tasks of its passes.  Terms are told apart by 64-bit hashes.

Defined results: a null or empty text has no terms and is never found; every row is a document, repeated rows each by
itself; equal scores are ordered by ascending ``doc_id``, null last.  Rows of one ``item_id`` (null too) are one item with all
their terms; an item without terms, or whose terms no document holds, has no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written
from .shingles import mix
from .terms import LETTERS_DIGITS, find_terms, gathered, hashes, text_bytes

K = 50
SCALE = 1_000_000_000
#: Occurrences from which a term is entered once more.
STEPS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, 4096], dtype=np.int64)
#: Positions of an entry, and bits of a column for each of its entries.
HASHES, BITS = 4, 12
#: Documents, entries and bits of the signature of a block at most (a document with more is a block of its own).
BLOCK_DOCS, BLOCK_ENTRIES, BLOCK_BITS = 2048, 1 << 18, 1 << 23
#: Terms entered at once.
ENTERED = 1 << 16
#: Entries gathered before blocks are cut, so that blocks hold documents of like size.
GATHER = 1 << 21
#: Terms of one set of asked items, and cells of one matrix of terms by documents.
MAX_ASKED, CELLS = 200_000, 1 << 21
BATCH_BYTES = 2 << 20
#: Bytes of a row group of the index.  Blocks are large rows, so every one is weighed: else a task would hold a hundred of
#: them before it looks, and a reader all of a row group.
GROUP_BYTES = 16 << 20
GROUPED = {"parquet.block.size": str(GROUP_BYTES), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
           "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
BLOCKS = ("doc_ids binary, nulls binary, sizes binary, most binary, n_bits long, signature binary, vocabulary binary, holders binary, "
          "offsets binary, places binary, counts binary")


def _positions(terms: np.ndarray, step: int, n_bits: int) -> np.ndarray:
    """Signature rows of terms at one step: terms x HASHES."""
    one = mix(terms + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    two = mix(one ^ np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    return ((one[:, None] + np.arange(HASHES, dtype=np.uint64) * two[:, None]) % np.uint64(n_bits)).astype(np.int64)


@dataclass
class _Docs:
    """Documents with their distinct terms, one after another."""

    ids: np.ndarray
    nulls: np.ndarray
    sizes: np.ndarray  # terms with repeats
    distinct: np.ndarray
    entries: np.ndarray
    terms: np.ndarray
    counts: np.ndarray


def _read(table) -> _Docs | None:
    import pyarrow.compute as pc

    data, offsets = text_bytes(table["text"])
    starts, lengths, docs = find_terms(data, offsets, LETTERS_DIGITS)
    if not len(starts):
        return None
    found = hashes(data, starts, lengths)
    order = np.lexsort((found, docs))
    found, docs = found[order], docs[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(found)))
    held, distinct = np.unique(docs[at], return_counts=True)
    sizes = np.bincount(docs, minlength=table.num_rows)[held]
    entries = np.add.reduceat(np.searchsorted(STEPS, counts, side="right"), np.cumsum(distinct) - distinct)
    ids = table["doc_id"]
    return _Docs(pc.fill_null(ids, 0).to_numpy()[held], pc.is_null(ids).to_numpy()[held], sizes, distinct, entries, found[at],
                 counts.astype(np.uint32))


def _blocks(parts: list[_Docs]) -> Iterator[dict]:
    """Blocks of documents with like numbers of entries; takes the parts out of the list."""
    docs = _Docs(*[np.concatenate([getattr(p, f) for p in parts]) for f in _Docs.__dataclass_fields__])
    parts.clear()
    ends, entries = np.cumsum(docs.distinct), docs.entries
    order = np.argsort(entries, kind="stable")
    at = 0
    while at < len(order):
        near = entries[order[at : at + BLOCK_DOCS]]
        fit = (np.cumsum(near) <= BLOCK_ENTRIES) & (BITS * near * np.arange(1, len(near) + 1) <= BLOCK_BITS)  # both only grow
        part = order[at : at + max(1, int(fit.sum()))]
        at += len(part)
        spans = [slice(ends[i] - docs.distinct[i], ends[i]) for i in part]
        terms, counts = (np.concatenate([x[s] for s in spans]) for x in (docs.terms, docs.counts))
        column = np.repeat(np.arange(len(part)), docs.distinct[part])
        n_bits = int(max(64, BITS * entries[part[-1]]))
        bits = np.zeros((n_bits, len(part)), dtype=bool)
        for step, least in enumerate(STEPS):
            here = np.flatnonzero(counts >= least)
            if not len(here):
                break
            for some in np.split(here, range(ENTERED, len(here), ENTERED)):
                bits[_positions(terms[some], step, n_bits), column[some, None]] = True
        vocabulary, places, holders = np.unique(terms, return_inverse=True, return_counts=True)
        offsets = np.concatenate([[0], np.cumsum(docs.distinct[part])])
        most = np.maximum.reduceat(counts, offsets[:-1])
        yield {
            "doc_ids": docs.ids[part].astype("<i8"), "nulls": docs.nulls[part].astype("u1"), "sizes": docs.sizes[part].astype("<i8"),
            "most": most.astype("<i8"), "n_bits": n_bits, "signature": np.packbits(bits, axis=1), "vocabulary": vocabulary.astype("<u8"),
            "holders": holders.astype("<u4"), "offsets": offsets.astype("<i8"), "places": places.astype("<u4"), "counts": counts.astype("<u4"),
        }


def _index_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    held, size = [], 0

    def cut() -> Iterator:
        for block in _blocks(held):
            yield pa.RecordBatch.from_pydict({k: pa.array([v if isinstance(v, int) else v.tobytes()], pa.int64() if isinstance(v, int) else pa.binary())
                                              for k, v in block.items()})

    for table in gathered(batches, BATCH_BYTES):
        docs = _read(table)
        if docs is None:
            continue
        held.append(docs)
        size += len(docs.terms)
        if size >= GATHER:
            yield from cut()
            held, size = [], 0
    if held:
        yield from cut()


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of signatures and exact counts of ``docs(doc_id, text)``, not yet written."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), _index_batches, BLOCKS)


def _asked_terms(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for table in gathered(batches, BATCH_BYTES):
        data, offsets = text_bytes(table["text"])
        starts, lengths, docs = find_terms(data, offsets, LETTERS_DIGITS)
        found = hashes(data, starts, lengths).view(np.int64)
        ids = table["item_id"].combine_chunks().take(pa.array(docs))
        yield pa.RecordBatch.from_arrays([ids, pa.array(found)], names=["item_id", "term"])


class _Asked:
    """Items of one set: their terms as places in one sorted list, item after item."""

    def __init__(self, rows: list[tuple]):
        self.ids = sorted({r[0] for r in rows}, key=lambda x: (x is None, x or 0))
        number = {x: i for i, x in enumerate(self.ids)}
        pairs = np.unique(np.array([(number[i], t) for i, t in rows], dtype=np.int64), axis=0)
        terms = pairs[:, 1].copy().view(np.uint64)
        self.terms = np.unique(terms)
        self.places = np.searchsorted(self.terms, terms)
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.ids)))
        self.weights = np.zeros(len(self.terms), dtype=np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        """Weights of the terms; a term that no document holds weighs nothing."""
        self.n_docs, self.n_terms = n_docs, n_terms
        for place, n in df.items():
            self.weights[place] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))

    def sums(self, cells: np.ndarray) -> np.ndarray:
        """Sum over each item's terms of the columns of ``cells`` (terms x documents)."""
        out = np.empty((len(self.starts), cells.shape[1]), dtype=np.int64)
        stops = np.append(self.starts[1:], len(self.places))
        for i, (a, b) in enumerate(zip(self.starts, stops)):
            out[i] = cells[self.places[a:b]].sum(axis=0)
        return out


class _Block:
    """A block's arrays; the exact counts are decoded when they are first needed."""

    def __init__(self, row: dict, asked: _Asked):
        self.row, self.asked = row, asked
        self.sizes, self.most = np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["most"], "<i8")
        self.n = len(self.sizes)
        rows = np.frombuffer(row["signature"], np.uint8)
        self.signature = rows.reshape(row["n_bits"], -1)
        self.norm = 50 + (50 * self.sizes * asked.n_docs) // asked.n_terms
        self._of: np.ndarray | None = None

    def impact(self, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (SCALE * tf) // (1000 * tf + 20 * norm)

    def bounds(self, columns: slice) -> np.ndarray:
        """Upper bounds of the scores: items x documents of a range of columns that starts at a whole byte."""
        first, last = columns.start, min(columns.stop, self.n)
        part = self.signature[:, first >> 3 : (last + 7) >> 3]
        norm, most = self.norm[first:last], self.most[first:last]
        cells = np.zeros((len(self.asked.terms), last - first), dtype=np.int64)
        alive = np.flatnonzero(self.asked.weights > 0)
        for step in range(len(STEPS)):
            positions = _positions(self.asked.terms[alive], step, len(self.signature))
            bits = part[positions[:, 0]]
            for j in range(1, HASHES):
                bits = bits & part[positions[:, j]]
            some = bits.any(axis=1)
            alive, bits = alive[some], bits[some]
            if not len(alive):
                break
            highest = np.minimum(STEPS[step + 1] - 1, most) if step + 1 < len(STEPS) else most
            value = np.where(most >= STEPS[step], self.impact(np.maximum(highest, 1), norm), 0)
            t, d = np.nonzero(np.unpackbits(bits, axis=1, count=last - first))
            t = alive[t]
            # steps go up, so a higher one replaces a lower one
            cells[t, d] = np.maximum(cells[t, d], value[d] * self.asked.weights[t])
        return self.asked.sums(cells)

    def scores(self, documents: np.ndarray) -> np.ndarray:
        """Exact scores: items x the given documents."""
        if self._of is None:
            vocabulary = np.frombuffer(self.row["vocabulary"], "<u8")
            at = np.minimum(np.searchsorted(self.asked.terms, vocabulary), len(self.asked.terms) - 1)
            self._of = np.where(self.asked.terms[at] == vocabulary, at, -1)
            self.offsets = np.frombuffer(self.row["offsets"], "<i8")
            self.places, self.counts = np.frombuffer(self.row["places"], "<u4"), np.frombuffer(self.row["counts"], "<u4")
        sizes = self.offsets[documents + 1] - self.offsets[documents]
        column = np.repeat(np.arange(len(documents)), sizes)
        entry = np.arange(len(column)) + np.repeat(self.offsets[documents] - (np.cumsum(sizes) - sizes), sizes)
        term = self._of[self.places[entry]]
        hit = np.flatnonzero(term >= 0)
        term, column, tf = term[hit], column[hit], self.counts[entry[hit]].astype(np.int64)
        cells = np.zeros((len(self.asked.terms), len(documents)), dtype=np.int64)
        cells[term, column] = self.asked.weights[term] * self.impact(tf, self.norm[documents][column])
        return self.asked.sums(cells)


class _Best:
    """The best ``k`` documents of each item in one task: score down, id up, null last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, dtype=np.int64)  # a score below it cannot be among the best
        self.rows = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * n_items

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        rows = [np.concatenate(x) for x in zip(self.rows[item], (scores, ids, nulls))]
        order = np.lexsort((rows[1], rows[2], -rows[0]))[: self.k]
        self.rows[item] = tuple(r[order] for r in rows)
        if len(order) == self.k:
            self.least[item] = self.rows[item][0][-1]


def _rows(batches: Iterator) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _statistics(batches: Iterator, asked: _Asked) -> Iterator:
    """Documents of each asked term, all documents (place -1) and all terms (place -2) of one task."""
    import pyarrow as pa

    df = np.zeros(len(asked.terms), dtype=np.int64)
    n_docs = n_terms = 0
    for row in _rows(batches):
        vocabulary, holders = np.frombuffer(row["vocabulary"], "<u8"), np.frombuffer(row["holders"], "<u4")
        at = np.minimum(np.searchsorted(vocabulary, asked.terms), len(vocabulary) - 1)
        here = vocabulary[at] == asked.terms
        df[here] += holders[at[here]]
        sizes = np.frombuffer(row["sizes"], "<i8")
        n_docs, n_terms = n_docs + len(sizes), n_terms + int(sizes.sum())
    places = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"place": np.append(places, [-1, -2]), "n": np.append(df[places], [n_docs, n_terms])})


def _search_batches(batches: Iterator, asked: _Asked, k: int) -> Iterator:
    """The best ``k`` documents of each item in one task.  A document is left out only if its bound is below the score of
    ``k`` documents that the task has rescored already."""
    import pyarrow as pa

    best = _Best(len(asked.ids), k)
    width = max(8, CELLS // max(len(asked.terms), len(asked.ids)) // 8 * 8)  # sums are items by documents
    for row in _rows(batches):
        block = _Block(row, asked)
        ids, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["nulls"], "u1") > 0
        for first in range(0, block.n, width):
            wanted = block.bounds(slice(first, first + width)) >= best.least[:, None]
            some = np.flatnonzero(wanted.any(axis=0))
            if not len(some):
                continue
            scores, wanted = block.scores(first + some), wanted[:, some]
            wanted &= scores >= best.least[:, None]
            for i in np.flatnonzero(wanted.any(axis=1)):
                mine = np.flatnonzero(wanted[i])
                best.add(int(i), scores[i, mine], ids[first + some[mine]], nulls[first + some[mine]])
    sizes = [len(r[0]) for r in best.rows]
    if sum(sizes):
        score, doc_id, null = (np.concatenate(x) for x in zip(*best.rows))
        items = pa.array(asked.ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        yield pa.RecordBatch.from_arrays([items, pa.array(doc_id, mask=null), pa.array(score)], names=["item_id", "doc_id", "score"])


def _top(hits: DataFrame, keys: list, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of a written index for each item of ``items(item_id, text)``.

    A set of asked items (its terms, at most ``MAX_ASKED`` and one item's more) passes through the driver; texts,
    documents and scores do not.
    """
    asked = written(map_batches(items.select(F.col("item_id").cast("long"), "text"), _asked_terms, "item_id long, term long").distinct(), "asked-terms")
    n_sets = max(1, math.ceil(asked.count() / MAX_ASKED))
    found = []
    for number in range(n_sets):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_sets)) == number).collect()
        if not rows:
            continue
        terms = _Asked([tuple(r) for r in rows])
        counts = map_batches(index.select("vocabulary", "holders", "sizes"), lambda b, t=terms: _statistics(b, t), "place long, n long")
        df = {r["place"]: r["n"] for r in counts.groupBy("place").agg(F.sum("n").alias("n")).collect()}
        n_docs, n_terms = df.pop(-1, 0), df.pop(-2, 0)
        if not n_terms:
            break
        terms.weigh(n_docs, n_terms, df)
        found.append(map_batches(index, lambda b, t=terms: _search_batches(b, t, k), "item_id long, doc_id long, score long"))
    hits = items.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for part in found:
        hits = hits.union(part)
    # a first cut in parts of the documents, so that no item gathers what every task found
    parts = _top(hits, ["item_id", F.pmod(F.xxhash64("doc_id"), F.lit(16))], k).drop("rank")
    return _top(parts, ["item_id"], k).select("item_id", "rank", "doc_id", "score")
