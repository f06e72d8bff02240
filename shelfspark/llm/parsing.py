"""Document fingerprints by locally consistent parsing.

A text's code points are cut into phrases by deterministic coin tossing: each symbol's label is the
place and value of the lowest bit in which it differs from the symbol before it, taken again until
labels are small; phrases begin at local maxima of the labels.  Runs of one symbol are phrases of their own first.  A
phrase is named by a hash of its symbols, names are the symbols of the next level.  Whether a phrase begins at
a place depends on a few symbols around it only, so equal substrings have equal phrases inside, wherever
they stand.

The fingerprint keeps, for each level from ``FIRST_LEVEL`` on, the number of distinct names and the ``KEPT``
smallest of their hashes.  ``likeness`` estimates the Jaccard likeness of the names per level from those (bottom-k
sketch, exact for fewer names) and averages the levels by their numbers of names.

``edited_pairs`` lays documents out in descending id, cut into ranges; the first document after a range's end travels
with the range, so every document meets the next one without a window over the whole table.

Null text is empty.  Empty texts have the empty fingerprint; two of them are alike (1), an empty and another
are not (0).  Repeated rows follow each other; their order is that of the text's hash.  Null ids come last.  Empty tables
give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, map_rows
from .shingles import mix

FIRST_LEVEL = 1
LEVELS = 12
KEPT = 24
#: Ranges of ids a partition; each range costs one row on the driver and one copied document.
RANGES = 4
#: Code points parsed side by side (400 more for each text, so at most 512 texts and as many edited ones).
BATCH = 200_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


Sketch = dict[int, tuple[int, list[int]]]


def _labels(names: np.ndarray, first: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Small labels by coin tossing; neighbours differ when their names do.  ``first`` marks where a text begins."""
    x = names
    for _ in range(rounds):
        before = np.empty_like(x)
        before[1:] = x[:-1]
        before[first] = ~x[first]
        differ = x ^ before
        place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        x = place * np.uint64(2) + ((x >> place) & np.uint64(1))
    return x


def _name(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One hash per phrase, of its symbols in their order and of its length."""
    lengths = np.diff(np.append(starts, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(starts, lengths)
    salted = mix(symbols + (place.astype(np.uint64) + np.uint64(1)) * _A)
    return mix(np.add.reduceat(salted, starts) + lengths.astype(np.uint64) * _B)


def levels(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, phrase name) arrays of every level, in text order; level 0 are the code points with runs folded.

    All texts are parsed side by side; nothing crosses from one to the next.  A text that has become one symbol
    takes no part in higher levels.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    symbols = mix(points.astype(np.uint64) + np.uint64(1))
    for _ in range(LEVELS):
        if not len(symbols):
            return
        runs = np.flatnonzero(np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])]))
        if len(runs) < len(symbols):  # equal neighbours become one symbol named with their number
            lengths = np.diff(np.append(runs, len(symbols))).astype(np.uint64)
            symbols, owner = symbols[runs], owner[runs]
            symbols = np.where(lengths > 1, mix(symbols + lengths * _B), symbols)
        yield owner, symbols
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        alone = first & np.append(first[1:], True)
        if alone.any():
            symbols, owner, first = symbols[~alone], owner[~alone], first[~alone]
            if not len(symbols):
                return
        label = _labels(symbols, first).astype(np.int16)
        last = np.append(first[1:], True)
        left = np.where(first, np.int16(-1), np.concatenate([label[:1], label[:-1]]))
        right = np.where(last, np.int16(-1), np.concatenate([label[1:], label[:1]]))
        starts = np.flatnonzero(((label > left) & (label >= right)) | first)
        symbols, owner = _name(symbols, starts), owner[starts]


def sketches(texts: list[str]) -> list[Sketch]:
    """Per text and level: the number of distinct names and the smallest of their 52-bit hashes.  At most 4096 texts."""
    out: list[Sketch] = [{} for _ in texts]
    for k, (owner, names) in enumerate(levels(texts)):
        if k < FIRST_LEVEL:
            small = np.bincount(owner, minlength=len(texts)) == 1  # texts of one symbol have no higher level
            keep = small[owner]
            owner, names = owner[keep], names[keep]
        found = np.unique(owner.astype(np.uint64) << np.uint64(52) | mix(names * _A + np.uint64(k)) >> np.uint64(12))
        whose = (found >> np.uint64(52)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]])).tolist() if len(found) else []
        hashes = found & np.uint64((1 << 52) - 1)
        for a, b in zip(edges, [*edges[1:], len(found)]):
            out[whose[a]][k] = b - a, hashes[a : min(b, a + KEPT)].tolist()
    return out


def mark(sketch: Sketch) -> str:
    """``level:count:hash,hash...`` of each level, joined by ``;``."""
    return ";".join(f"{k}:{n}:" + ",".join([f"{x:013x}" for x in kept]) for k, (n, kept) in sketch.items())


def parse(text: str) -> Sketch:
    """The sketch that ``mark`` wrote."""
    parts = [p.split(":") for p in text.split(";")] if text else []
    return {int(k): (int(n), [int(x, 16) for x in kept.split(",")]) for k, n, kept in parts}


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated likeness of two fingerprints, 0 to 1; 1 for equal ones."""
    if a == b:
        return 1.0
    top = bottom = 0.0
    for k in a.keys() | b.keys():
        (n, p), (m, q) = a.get(k, (0, [])), b.get(k, (0, []))
        weight = max(n, m) ** 0.5  # lower levels have more names, higher ones say more
        union = sorted({*p, *q})
        if n > KEPT or m > KEPT:  # up to the smaller cut-off both sketches are complete
            limit = min(p[-1] if n > KEPT else 1 << 52, q[-1] if m > KEPT else 1 << 52)
            union = [h for h in union if h <= limit]
        bottom += weight
        top += weight * (len({*p} & {*union} & {*q}) / len(union) if union else 0.0)
    return round(top / bottom, 6) if bottom else 0.0


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


def _ranges(ids: DataFrame, parts: int) -> list[int]:
    """Ids that begin a new range in ascending order: at most ``parts``."""
    if parts < 2:
        return []
    row = ids.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)], 10_000)).first()[0]
    return sorted(set(row or []))


def _search(value, sorted_values):
    """Number of sorted values at or below ``value``, by binary search."""
    n = F.size(sorted_values)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + 2)).cast("int") + 1)

    def step(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = (s["low"] < s["high"]) & (F.get(sorted_values, middle) <= value)
        return F.struct(F.when(below, middle + 1).otherwise(s["low"]).alias("low"),
                        F.when(below, s["high"]).otherwise(middle).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), step)["low"]


def neighbours_together(docs: DataFrame, text: str, id_col: str, parts: int) -> DataFrame:
    """Rows (_part, _ghost, _id, _text), sorted in each range of ids by descending id; a ghost is the row that follows the range."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    starts = _ranges(rows.select("_id"), RANGES * parts)
    bounds = F.array(*[F.lit(s) for s in starts]).cast("array<long>")
    part = F.when(F.col("_id").isNull(), -1).otherwise(_search(F.col("_id"), bounds))
    rows = rows.withColumns({"_part": part.cast("int"), "_tie": F.xxhash64("_text")})
    first = F.max(F.struct(F.col("_id").isNotNull().alias("known"), F.col("_id").alias("id"), F.col("_tie").alias("tie")))
    heads = rows.groupBy("_part").agg(first.alias("h")).orderBy("_part").collect()  # one row a range
    ghosts = [(h["_part"], h["h"]["id"], h["h"]["tie"], heads[(k + 1) % len(heads)]["_part"]) for k, h in enumerate(heads)]
    table = spark.createDataFrame(ghosts, "part int, id long, tie long, _to int")
    same = (F.col("_part") == F.col("part")) & F.col("_id").eqNullSafe(F.col("id")) & (F.col("_tie") == F.col("tie"))
    marked = rows.join(F.broadcast(table), same, "left")
    places = F.array(F.struct(F.col("_part").alias("part"), F.lit(0).alias("ghost")), F.when(
        F.col("_to").isNotNull(), F.struct(F.col("_to").alias("part"), F.lit(1).alias("ghost"))))
    both = marked.select("_id", "_text", "_tie", F.explode(F.array_compact(places)).alias("_at"))
    out = both.select(F.col("_at.part").alias("_part"), F.col("_at.ghost").alias("_ghost"), "_id", "_tie", "_text")
    return out.repartition(parts, "_part").sortWithinPartitions("_part", "_ghost", F.desc_nulls_last("_id"), F.desc("_tie")).drop("_tie")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document's."""
    parts = parts or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []  # a row of the batch before, whose next row was not there yet
        for batch in batches_by_bytes(rows, lambda r: 400 + len(r[3] or ""), BATCH):
            held = [*held, *batch]
            yield from finish(held)
            held = held[-1:]

    def finish(batch: list[tuple]) -> Iterator[tuple]:
        texts = [r[3] or "" for r in batch]
        pairs = [i for i in range(len(batch) - 1) if not batch[i][1] and batch[i + 1][0] == batch[i][0]]
        new = [edited(texts[i], texts[i + 1]) for i in pairs]
        found = sketches([*texts, *new])
        for i, text, other in zip(pairs, new, found[len(texts) :]):
            sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            yield (batch[i][2], len(texts[i]), sha, mark(found[i]), mark(other), likeness(found[i], other), likeness(found[i], found[i + 1]))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_rows(neighbours_together(docs, text, id_col, parts), run, schema, lambda r: 200 + len(r[3]) + len(r[4]))
