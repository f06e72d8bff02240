"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of the labelled rows (``MAX_EXAMPLES`` of each class, smallest hash of the
id; equal texts count once).  The vocabulary is the words whose presence differs most between the classes (chi
square), at most ``MAX_TERMS``; document frequencies of these words are counted over every document.
A document is a vector (1 + ln tf) idf over the vocabulary, of length 1.

The index holds the examples in blocks.  For every word it keeps the largest weight in each block, so a query's
words bound the cosine that a block can reach; blocks are opened in the order of their bounds until the
next cannot beat the k-th neighbour found.  Neighbours are therefore exact.  Their votes, weighted by the square of
the cosine, and one prior vote give a raw score, which a logistic curve fitted on the examples (each left
out of its own neighbours, classes weighted as in all labelled rows) turns into a probability.

Null or empty text, or none of the words: no neighbours, the prior's score.  Ties between neighbours
go to the smaller id.  Repeated rows get equal scores; repeated labels count once, the larger label wins.  Without any
label every score is 0.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

MAX_EXAMPLES = 3000
MAX_TERMS = 8192
#: A word must stand in this many examples, and differ between the classes by this chi square (p about 0.003).
MIN_EXAMPLES = 4
MIN_CHI = 9.0
NEIGHBOURS = 25
BLOCK = 32
#: Weight of the prior's vote against a neighbour with cosine 1.
PRIOR_VOTE = 0.3
EDGES = " .,;:!?\"'()[]{}<>|#*$%&+-=_/\\~^`«»¿¡…–—“”‘’"


def word_counts(text: str | None) -> Counter:
    """Lower-cased words without punctuation at their edges."""
    out: Counter = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        if word := word.strip(EDGES):
            out[word] += n
    return out


@dataclass
class Index:
    """Examples as a block-max inverted index."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    prior: float
    #: Term t has the entries ``entries[t]`` to ``entries[t + 1]``, one a block: its number, largest weight and postings.
    entries: np.ndarray = None
    block: np.ndarray = None
    most: np.ndarray = None
    start: np.ndarray = None
    size: np.ndarray = None
    #: Postings: place of the example and weight of the term in it.
    place: np.ndarray = None
    weight: np.ndarray = None
    curve: tuple[float, float] = (1.0, 0.0)

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        found = [(t, n) for w, n in counts.items() if (t := self.terms.get(w)) is not None and self.idf[t] > 0]
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0)
        at = np.array([t for t, _ in found])
        weight = (1 + np.log([n for _, n in found])) * self.idf[at]
        return at, weight / np.sqrt((weight**2).sum())

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a cosine above 0, best first."""
        none = np.empty(0, dtype=np.int64), np.empty(0)
        lists = self.entries[at + 1] - self.entries[at] if len(at) else none[0]
        if not lists.sum():
            return none
        entry = _ragged(self.entries[at], lists)
        weight = np.repeat(weight, lists)
        block = self.block[entry]
        bound = np.bincount(block, self.most[entry] * weight)
        cosines = np.zeros(len(bound) * BLOCK)

        def open_blocks(wanted: np.ndarray) -> None:
            inside = wanted[block]
            size = self.size[entry[inside]]
            post = _ragged(self.start[entry[inside]], size)
            cosines[:] += np.bincount(self.place[post], self.weight[post] * np.repeat(weight[inside], size), minlength=len(cosines))

        best = np.zeros(len(bound), dtype=bool)
        best[np.argsort(-bound, kind="stable")[: k // BLOCK + 3]] = True
        open_blocks(best)
        found = cosines.copy()
        if without >= 0:
            found[without : without + 1] = 0.0
        least = np.partition(found, -k)[-k] if len(found) > k else 0.0
        rest = (bound >= max(least - 1e-9, 1e-12)) & ~best  # no other block can hold a neighbour
        if rest.any():
            open_blocks(rest)
        cosines = np.round(cosines, 9)
        if without >= 0:
            cosines[without : without + 1] = 0.0
        places = np.flatnonzero(cosines > 0)
        order = np.lexsort((self.ids[places], -cosines[places]))[:k]
        return places[order], cosines[places[order]]

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines**2
        return float(((w * self.labels[places]).sum() + PRIOR_VOTE * self.prior) / (w.sum() + PRIOR_VOTE))

    def score(self, vote: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * _logit(vote) + b))))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _fit_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on the logit of the vote, by Newton steps with a weak ridge."""
    x = np.stack([_logit(votes), np.ones(len(votes))])
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(c @ x)))
        slope = x @ (weights * (labels - p)) - 1e-3 * (c - [1.0, 0.0])
        step = np.linalg.solve((x * (weights * p * (1 - p))) @ x.T + 1e-3 * np.eye(2), slope)
        c = c + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0]), float(c[1])


def training_labels(labels: DataFrame, id_col: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Ids and labels outside the held-out fold (crc32 of the id as text, modulo 5, is 0)."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col)))
    return rows.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_y"))


def held_out(id_col):
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def examples(docs: DataFrame, known: DataFrame, text: str, id_col: str, most: int) -> DataFrame:
    """_id, _y, words and counts of the sampled examples; equal texts once, by their smallest id."""
    picked = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")  # 2 * most rows
    once = rows.groupBy(F.sha2("_text", 256).alias("_sha")).agg(
        F.min(F.struct("_id", "_y")).alias("_first"), F.first("_text").alias("_text"))

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, y, body in it:
            counts = word_counts(body)
            yield doc_id, y, list(counts), list(counts.values())

    return written(map_rows(once.select("_first._id", F.col("_first._y").cast("long").alias("_y"), "_text"), run,
                            "_id long, _y long, words array<string>, counts array<long>", lambda r: 100 + 20 * len(r[2])), "toxic-examples")


def vocabulary(found: DataFrame, most: int) -> list[str]:
    """Words whose presence differs most between the classes."""
    n = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("pos")).first()
    if not n["n"]:
        return []
    share = n["pos"] / n["n"]
    words = found.select("_y", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"), F.sum("_y").alias("a"))
    expect = F.col("df") * share
    chi = F.pow(F.col("a") - expect, 2) / expect + F.pow(F.col("a") - expect, 2) / (F.col("df") - expect)
    kept = words.where(F.col("df") >= MIN_EXAMPLES).withColumn("chi", chi).where(F.col("chi") >= MIN_CHI)
    return [r["w"] for r in kept.orderBy(F.desc("chi"), "w").limit(most).select("w").collect()]


def document_frequencies(docs: DataFrame, terms, text: str) -> tuple[dict[int, int], int]:
    """Documents that hold each word, over all documents; a task adds up its own before the shuffle."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        known, found, n = terms.value, Counter(), 0
        for (body,) in rows:
            n += 1
            found.update({t for w in word_counts(body) if (t := known.get(w)) is not None})
        yield from [(-1, n), *found.items()]

    sums = map_rows(docs.select(text), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in sums.collect()}  # at most MAX_TERMS + 1 rows
    return counts, counts.pop(-1, 0)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic",
          most: int = MAX_EXAMPLES, most_terms: int = MAX_TERMS) -> Index:
    spark = docs.sparkSession
    known = training_labels(labels, id_col, label)
    size = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    found = examples(docs, known, text, id_col, most)
    terms = {w: i for i, w in enumerate(vocabulary(found, most_terms))}
    df, n = document_frequencies(docs, spark.sparkContext.broadcast(terms), text)
    idf = np.array([max(0.0, np.log((n + 1) / (df.get(i, 0) + 1))) for i in range(len(terms))])
    wanted = spark.sparkContext.broadcast(terms)

    def only_terms(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, y, words, counts in rows:
            kept = [(wanted.value[w], c) for w, c in zip(words, counts) if w in wanted.value]
            yield doc_id, y, [t for t, _ in kept], [c for _, c in kept]

    rows = map_rows(found, only_terms, "_id long, _y long, terms array<int>, counts array<long>").collect()  # bounded both ways
    return build(rows, terms, idf, size.get(1, 0), size.get(0, 0))


def build(rows: list, terms: dict[str, int], idf: np.ndarray, positives: int, negatives: int) -> Index:
    """Index of examples (_id, _y, terms, counts), similar ones near each other, with its curve."""
    names = list(terms)
    index = Index(terms, idf, np.empty(0), np.empty(0), 0.0)
    vectors = [(r["_id"], r["_y"], *index.vector({names[t]: c for t, c in zip(r["terms"], r["counts"])})) for r in rows]
    vectors.sort(key=lambda v: (len(v[2]) == 0, int(v[2][np.argmax(v[3])]) if len(v[2]) else 0, v[0]))
    index.ids = np.array([v[0] for v in vectors], dtype=np.int64)
    index.labels = np.array([v[1] for v in vectors], dtype=np.float64)
    index.prior = positives / max(1, positives + negatives)
    sizes = np.array([len(v[2]) for v in vectors], dtype=np.int64)
    term = np.concatenate([v[2] for v in vectors]) if len(vectors) else np.empty(0, dtype=np.int64)
    weight = np.concatenate([v[3] for v in vectors]) if len(vectors) else np.empty(0)
    place = np.repeat(np.arange(len(vectors)), sizes)
    order = np.lexsort((place, term))
    term, index.place, index.weight = term[order], place[order], weight[order]
    block = index.place // BLOCK
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else place
    index.start, index.size, index.block = first, np.diff(np.append(first, len(term))), block[first]
    index.most = np.maximum.reduceat(index.weight, first) if len(first) else np.empty(0)
    index.entries = np.searchsorted(term[first], np.arange(len(terms) + 1))
    if 0 < index.labels.sum() < len(vectors):
        votes = np.array([index.vote(*index.nearest(at, w, without=i)) for i, (_, _, at, w) in enumerate(vectors)])
        share = index.labels.mean()
        weight = np.where(index.labels == 1, index.prior / share, (1 - index.prior) / (1 - share))
        index.curve = _fit_curve(votes, index.labels, weight)
    return index


def score(docs: DataFrame, index: Index, text: str = "text", id_col: str = "doc_id", evidence: int = 3) -> DataFrame:
    """doc_id, score and ``evidence``: ids of the nearest examples, best first."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        index = held.value
        none = index.score(index.prior) if len(index.ids) else 0.0
        for doc_id, body in rows:
            places, cosines = index.nearest(*index.vector(word_counts(body)))
            value = index.score(index.vote(places, cosines)) if len(places) else none
            yield doc_id, round(value, 9), index.ids[places[:evidence]].tolist()

    return map_rows(docs.select(F.col(id_col).cast("long").alias("_id"), text), run, "doc_id long, score double, evidence array<long>")
