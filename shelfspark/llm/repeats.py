"""Removing repeated byte strings: suffix arrays by two-stage sorting, over buckets of like contexts.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts earlier (smaller document id, or
earlier in the same document).  Suffixes of all texts are never sorted together:

1. ``anchors``: every start of a string belongs to one anchor, the gram with the smallest hash among those in
   the string (the first of equals).  It depends on the string alone, so equal strings have equal anchors at equal
   distance.  Neighbouring starts of one anchor make a segment.  A task settles equal segments
   among its own documents first, all but the earliest are repeats.
2. ``settle``: segments meet by anchor, in sorted order.  Equal ones are settled as before; of anchors
   that have different segments, one of each goes on.
3. ``suffix_repeats``: those segments, whole anchors together, are laid end to end in blocks.  In each block only
   suffixes smaller than their successor are sorted directly (on LENGTH bytes), the others follow from them in one
   scan over the buckets of first bytes; adjacent common prefixes of LENGTH bytes or more are repeats.  An anchor
   with more than ``WIDE`` segments would overfill a block: ``refined_repeats`` compares its strings by ever longer contexts,
   and drops what meets no other on the way.
4. ``removed``: the repeats of each document are joined to its bytes.

Null or empty text, and texts under LENGTH bytes: nothing removed.  Null ids count as the largest.  Rows with equal id and equal
text get equal results and do not remove each other's bytes; rows with equal id and different texts are ordered by a checksum of the
text.  Empty tables give empty results.  Other columns are ignored.  Segments are told apart by two 64-bit hashes,
parts of wide anchors by 128 bits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import lookup_join
from .common import batches_by_bytes, map_batches, map_rows, written
from .shingles import mix, _power

LENGTH = 100
GRAM = 24
#: Bytes parsed side by side, and bytes whose segments a task settles among themselves.
PIECE, SETTLE = 1 << 19, 8 << 20
#: Bytes of one block of segments, and segments of one anchor above which it goes its own way.
BLOCK, WIDE = 1 << 19, 2000
#: Distances to such an anchor that its strings are cut by, ever fewer.
WIDTHS = (16, 4, 1)
LAST = (1 << 63) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = [np.uint64(x) for x in (0xD1B54A32D192ED03, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB)]
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SEGMENT = "k long, d long, o long, place long, n long"


def _check(data: bytes) -> int:
    """31-bit checksum: places stay positive."""
    return zlib.crc32(data) >> 1


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each place (GRAM = 16 + 8)."""
    h = _BYTES[data]
    for step, odd in ((1, _ODD[0]), (2, _ODD[1]), (4, _ODD[2])):
        h = mix(h[:-step] * odd + h[step:])
    eight = h
    sixteen = mix(eight[:-8] * _ODD[3] + eight[8:])
    return mix(sixteen[: len(eight) - 16] * _ODD[4] + eight[16:])


def segments(data: np.ndarray, starts_ok: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, digest, first start and number of starts of each segment of concatenated texts.

    ``starts_ok`` tells, for each place, whether a whole string starts there inside one text.
    """
    if len(data) < LENGTH:
        return tuple(np.empty(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    grams = _grams(data)
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, want = 1, LENGTH - GRAM + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if want > width:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    anchor = (least & low).astype(np.int64)  # of the string from each place
    ok = starts_ok[: len(anchor)]
    begins = ok & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~ok[:-1]])
    first = np.flatnonzero(begins)
    ends = np.flatnonzero(ok & np.append(begins[1:] | ~ok[1:], True))
    n = ends - first + 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[data] * _power(_BASE, len(data)), dtype=np.uint64)])
    body = (sums[ends + LENGTH] - sums[first]) * _power(_BACK, len(data))[first]
    at = anchor[first]
    return grams[at], mix(mix(body) + (at - first).astype(np.uint64) * _ODD[0] + n.astype(np.uint64) * _ODD[1]), first, n


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text number, from, to) of about PIECE bytes; long texts are cut with LENGTH - 1 bytes of overlap."""
    def cuts() -> Iterator[tuple[int, int, int]]:
        for i, t in enumerate(texts):
            for a in range(0, max(1, len(t) - LENGTH + 1), PIECE):
                if len(t) >= LENGTH:
                    yield i, a, min(len(t), a + PIECE + LENGTH - 1)

    yield from batches_by_bytes(cuts(), lambda c: c[2] - c[1], PIECE)


def _runs(place: np.ndarray, n: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge starts that touch, of sorted segments; ``new`` marks a change of document."""
    ends = place + n.astype(np.uint64)  # places are unsigned
    at = np.flatnonzero(np.concatenate([[True], new[1:] | (place[1:] > ends[:-1])]))
    last = np.append(at[1:], len(place)) - 1
    return at, (ends[last] - place[at]).astype(np.int64)


def _settled(columns: tuple[np.ndarray, ...]) -> list[tuple]:
    """The earliest of equal segments, and the merged starts of the others (with negative n and a scattered k)."""
    k, d, o, place, n = columns
    order = np.lexsort((place, o, d, k))
    k, d, o, place, n = (c[order] for c in (k, d, o, place, n))
    again = np.concatenate([[False], (k[1:] == k[:-1]) & (d[1:] == d[:-1]) & ((o[1:] != o[:-1]) | (place[1:] != place[:-1]))])
    twin = np.concatenate([[False], (k[1:] == k[:-1]) & (d[1:] == d[:-1]) & ~again[1:]])  # a repeated row
    # a twin of the earliest is the earliest itself
    first = ~(again | twin)
    out = [(k[first], d[first], o[first], place[first], n[first])]
    if again.any():
        o, place, n = o[again], place[again], n[again]
        order = np.lexsort((place, o))
        o, place, n = o[order], place[order], n[order]
        at, merged = _runs(place, n, np.concatenate([[True], o[1:] != o[:-1]]))
        o, place = o[at], place[at]
        scattered = mix(o.astype(np.uint64) * _ODD[0] + place.astype(np.uint64))
        out.append((scattered, np.zeros(len(o), dtype=np.uint64), o, place, -merged))
    return out


def _arrow(columns: tuple[np.ndarray, ...], names: list[str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names)


def anchors(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """Segments of every document (o: its id, place: checksum and first start, n: starts), settled inside each task."""
    names = [c.split()[0] for c in SEGMENT.split(", ")]

    def parsed(batch: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
        keys = [LAST if r[0] is None else r[0] for r in batch]
        texts = [(r[1] or "").encode("utf-8", "surrogatepass") for r in batch]
        checks = [_check(t) << 32 for t in texts]
        for piece in _pieces(texts):
            data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in piece), dtype=np.uint8)
            sizes = np.array([b - a for _, a, b in piece])
            edges = np.cumsum([0, *sizes])
            ok = np.ones(len(data), dtype=bool)
            for e in edges[1:]:
                ok[max(0, e - LENGTH + 1) : e] = False
            k, d, first, n = segments(data, ok)
            whose = np.searchsorted(edges, first, side="right") - 1
            base = np.array([(checks[i] | a) for i, a, _ in piece], dtype=np.uint64)[whose]
            o = np.array([keys[i] for i, _, _ in piece], dtype=np.int64)[whose]
            yield k, d, o, (base + (first - edges[whose]).astype(np.uint64)), n

    def run(batches: Iterator) -> Iterator:
        rows = ((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for batch in batches_by_bytes(rows, lambda r: len(r[1] or ""), SETTLE):
            found = list(parsed(batch))
            if found:
                for columns in _settled(tuple(np.concatenate(c) for c in zip(*found))):
                    yield _arrow(columns, names)

    return map_batches(docs.select(F.col(id_col).cast("long").alias("o"), F.col(text).alias("_text")), run, SEGMENT)


def settle(found: DataFrame) -> DataFrame:
    """Repeats (k null) and, for anchors with different segments, one of each (k set)."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        last = None  # the row before this batch: (k, d, o, place, n), and whether it stands for others that were given out
        pending = None  # the only different segment so far of the anchor at the end

        def give(k, o, place, n, known: bool):
            return pa.RecordBatch.from_arrays([
                pa.array(k if known else [None] * len(o), pa.int64()), pa.array(o, pa.int64()), pa.array(place, pa.int64()),
                pa.array(n, pa.int64())], ["k", "o", "place", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            k, d, o, place, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            done = n < 0
            if done.any():
                yield give(None, o[done], place[done], -n[done], False)
                k, d, o, place, n = (c[~done] for c in (k, d, o, place, n))
                if not len(k):
                    continue
            before = last if last is not None else (None, None)
            new_k = np.concatenate([[k[0] != before[0]], k[1:] != k[:-1]])
            new = new_k | np.concatenate([[d[0] != before[1]], d[1:] != d[:-1]])
            # rows equal to the first of their kind are twins of it (a repeated row), not repeats
            head = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            ho = np.where(head >= 0, o[head], before[2] if last is not None else 0)
            hp = np.where(head >= 0, place[head], before[3] if last is not None else 0)
            again = ~new & ((o != ho) | (place != hp))
            if again.any():
                yield give(None, o[again], place[again], n[again], False)
            reps = np.flatnonzero(new)
            if len(reps):
                rk = k[reps]
                begins = new_k[reps]
                starts = np.flatnonzero(begins)
                size = np.diff(np.append(starts, len(rk)))
                several = np.repeat(size > 1, size) if len(starts) else np.empty(0, dtype=bool)
                carried = starts[0] if len(starts) else len(rk)  # reps of the anchor that began earlier
                keep = np.concatenate([np.ones(carried, dtype=bool), several])
                if carried and pending is not None:
                    yield give(*[np.array([v]) for v in pending], True)
                    pending = None
                if len(starts):
                    tail = reps[starts[-1]]
                    pending = (k[tail], o[tail], place[tail], n[tail]) if size[-1] == 1 else None
                    at = reps[keep]
                else:
                    at = reps
                if len(at):
                    yield give(k[at], o[at], place[at], n[at], True)
            h = head[-1]
            last = (k[-1], d[-1], ho[-1], hp[-1]) if h < 0 else (k[-1], d[-1], o[h], place[h])

    parts = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = found.repartition(parts, "k").sortWithinPartitions("k", "d", "o", "place")
    return written(map_batches(ranged, run, "k long, o long, place long, n long"), "repeats")


def packed_texts(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """doc_id, o, check and the compressed bytes of every document: less to move."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for doc_id, body in rows:
            data = (body or "").encode("utf-8", "surrogatepass")
            yield doc_id, LAST if doc_id is None else doc_id, _check(data), pack.compress(data)

    return map_rows(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text")), run,
                    "doc_id long, o long, t long, z binary", lambda r: 60 + len(r[3]))


def _by_document(rows: DataFrame, *fields: str) -> DataFrame:
    """One row a document: its starts (no more than it has anchors)."""
    start = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    check = F.shiftrightunsigned("place", 32)
    each = F.struct(*fields, start.alias("s"), F.col("n"))
    return rows.groupBy("o", check.alias("t")).agg(F.collect_list(each).alias("starts"))


def segment_bytes(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """k, o, place, n and the bytes of each segment that goes on."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for o, t, z, starts in rows:
            data = unpack.decompress(z)
            for x in starts:
                yield x["k"], o, t << 32 | x["s"], x["n"], data[x["s"] : x["s"] + x["n"] + LENGTH - 1]

    wanted = _by_document(reps, "k")
    once = docs.join(wanted, ["o", "t"]).select("o", "t", "z", "starts")  # repeated rows give repeated segments, dropped below
    return map_rows(once, run, "k long, o long, place long, n long, bytes binary", lambda r: 60 + len(r[4])).where("bytes IS NOT NULL")


def suffix_order(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of ``data`` (symbols from 1 to 255, one 0 at the end) in the order of their first ``depth`` symbols at least.

    Two-stage sorting: suffixes smaller than their successor are sorted directly; a scan over the buckets of first symbols, from
    the smallest up, puts each larger one at the head of its own bucket when its successor is met.
    """
    n = len(data)
    data = data.astype(np.uint8)
    next_up = np.zeros(n, dtype=bool)  # suffix smaller than its successor
    differ = np.flatnonzero(data[1:] != data[:-1])
    rises = data[differ + 1] > data[differ]
    following = np.searchsorted(differ, np.arange(n - 1))  # the next place where neighbours differ decides
    next_up[:-1] = np.append(rises, False)[following]
    next_up[-1] = True
    direct = np.flatnonzero(next_up)
    padded = np.concatenate([data, np.zeros(depth, dtype=np.uint8)])
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[direct])
    direct = direct[np.argsort(keys.view(f"S{depth}")[:, 0], kind="stable")]
    ends = np.cumsum(np.bincount(data, minlength=256))
    heads = ends - np.bincount(data, minlength=256)
    upper = ends - np.bincount(data[direct], minlength=256)  # sorted ones fill the upper part of each bucket
    order = np.full(n, -1, dtype=np.int64)
    first = data[direct]
    order[upper[first] + np.arange(len(direct)) - np.searchsorted(first, first)] = direct

    def induce(met: np.ndarray) -> None:
        """Place the larger suffixes that begin just before these, in their order."""
        before = met[met > 0] - 1
        before = before[~next_up[before]]
        symbols = data[before]
        by = np.argsort(symbols, kind="stable")
        before, symbols = before[by], symbols[by]
        order[heads[symbols] + np.arange(len(by)) - np.searchsorted(symbols, symbols)] = before
        heads[:] += np.bincount(symbols, minlength=256)

    for c in range(256):
        at = ends[c - 1] if c else 0
        while at < heads[c]:  # a run of one symbol grows its own bucket
            at, met = heads[c], order[at : heads[c]]
            induce(met)
        induce(order[upper[c] : ends[c]])
    return order


def block_repeats(rows: list[tuple]) -> Iterator[tuple]:
    """(o, place, n) of the repeated starts among segments (k, o, place, n, bytes) of whole anchors."""
    data = np.frombuffer(b"".join(r[4] + b"\0" for r in rows) + b"\0", dtype=np.uint8) + np.uint8(2)  # UTF-8 has no byte above 0xF4
    sizes = np.array([len(r[4]) + 1 for r in rows])
    base = np.cumsum(sizes) - sizes
    data[base + sizes - 1] = 1  # ends of segments
    data[-1] = 0
    owner = np.repeat(np.arange(len(rows)), sizes)
    inside = np.arange(len(owner)) - base[owner]
    starts = np.append(inside < np.array([r[3] for r in rows])[owner], False)
    order = suffix_order(data)
    order = order[starts[order]]
    # adjacent common prefixes: LENGTH symbols or more?
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    alike = np.ones(len(order) - 1, dtype=bool)
    for a in range(0, len(alike), 4096):
        b = min(len(alike), a + 4096)
        alike[a:b] = (windows[order[a:b]] == windows[order[a + 1 : b + 1]]).all(axis=1)
    group = np.cumsum(np.concatenate([[0], ~alike]))
    o = np.array([r[1] for r in rows], dtype=np.int64)[owner[order]]
    place = np.array([r[2] for r in rows], dtype=np.int64).view(np.uint64)[owner[order]] + inside[order].astype(np.uint64)
    by = np.lexsort((place, o, group))
    group, o, place = group[by], o[by], place[by]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    head = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    again = (o != o[head]) | (place != place[head])
    o, place = o[again], place[again]
    if len(o):
        by = np.lexsort((place, o))
        o, place = o[by], place[by]
        keep = np.concatenate([[True], (o[1:] != o[:-1]) | (place[1:] != place[:-1])])
        o, place = o[keep], place[keep]
        at, n = _runs(place, np.ones(len(o), dtype=np.int64), np.concatenate([[True], o[1:] != o[:-1]]))
        yield from zip(o[at].tolist(), place[at].view(np.int64).tolist(), n.tolist())


def suffix_repeats(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """Repeated starts among the segments of anchors, by suffix arrays over blocks of whole anchors."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        def anchors_whole() -> Iterator[list[tuple]]:
            held: list[tuple] = []
            for r in rows:
                if held and held[0][0] != r[0]:
                    yield held
                    held = []
                held.append(r)
            if held:
                yield held

        for group in batches_by_bytes(anchors_whole(), lambda g: sum(len(r[4]) for r in g), block):
            yield from block_repeats([r for g in group for r in g])

    parts = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = found.repartition(parts, "k").sortWithinPartitions("k", "o", "place")
    return map_rows(ranged, run, "o long, place long, n long")


def _anchor(k: int, n: int, data: bytes) -> int:
    """Place of the anchor in the bytes of a segment: the first gram of that hash that all its strings hold."""
    grams = _grams(np.frombuffer(data, dtype=np.uint8))[n - 1 :].view(np.int64)
    return n - 1 + int(np.flatnonzero(grams == k)[0])


def _classes(rows: Iterator[tuple], width: int) -> Iterator[tuple]:
    """Cut segments (k, p, o, place, n, bytes) by the distance of their strings to the anchor, ``width`` distances a part."""
    for k, p, o, place, n, data in rows:
        p = _anchor(k, n, data) if p is None else p
        for near in range((p - n + 1) // width * width, p + 1, width):
            far = min(near + width - 1, LENGTH - GRAM)
            first, last = min(p, far), max(p - n + 1, near)  # distances of this part's first and last string
            common = hashlib.blake2b(data[p - near : p - far + LENGTH], digest_size=16, salt=near.to_bytes(2, "big")).digest()
            own = data[p - first : p - last + LENGTH]
            same = hashlib.blake2b(own, digest_size=16, key=common, salt=first.to_bytes(2, "big")).digest()
            yield common, same, o, place + p - first, first - last + 1, first, own


def _earliest(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of equal parts, in the order of (same, o, place), the earliest as it is and the others as repeats (no x)."""
    head = None
    for r in rows:
        if head is None or r[1] != head[1]:
            head = r
            yield r
        elif r[2:4] != head[2:4]:  # a repeated row is no repeat of itself
            yield None, None, *r[2:5], None, None


def refined_repeats(found: DataFrame) -> DataFrame:
    """Repeated starts of anchors with very many segments, by contexts that grow until they are whole strings.

    The strings of a segment are cut into classes by their distance to the anchor.  All strings of a class hold the bytes between the
    start of its nearest and the end of its farthest one, so equal strings agree on them.  Equal parts are settled, first among those
    of a task; a part whose common bytes no different part shares is done, the others are cut into smaller classes.
    """
    spark, schema = found.sparkSession, "x binary, same binary, o long, place long, n long, p long, bytes binary"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    active = found.select("k", F.lit(None).cast("long").alias("p"), "o", "place", "n", "bytes")
    out = spark.createDataFrame([], "o long, place long, n long")
    for width in WIDTHS:
        def cut(rows: Iterator[tuple], width: int = width) -> Iterator[tuple]:
            for batch in batches_by_bytes(_classes(rows, width), lambda r: len(r[6]), SETTLE):
                yield from _earliest(sorted(batch, key=lambda r: r[1:4]))

        size = lambda r: 100 + len(r[6] or b"")
        split = written(map_rows(active, cut, schema, size), "repeats-parts")
        ranged = split.where("x IS NOT NULL").repartition(parts, "same").sortWithinPartitions("same", "o", "place")
        settled = written(map_rows(ranged, _earliest, schema, size), "repeats-settled")
        for done in (split, settled):
            out = out.unionByName(done.where("x IS NULL").select("o", "place", "n"))
        first = settled.where("x IS NOT NULL")
        several = written(first.groupBy("x").count().where("count > 1").select("x"), "repeats-shared")
        if width == 1 or several.isEmpty():
            break
        active = lookup_join(first, several, ["x"], "inner", spread=F.col("place")).select(
            F.lit(None).cast("long").alias("k"), "p", "o", "place", "n", "bytes")
    return out


def removed(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Counts and the digest of what is left of every document."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for doc_id, z, starts in rows:
            data = unpack.decompress(z)
            spans: list[list[int]] = []
            for a, n in sorted((x["s"], x["n"]) for x in starts or []):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], a + n + LENGTH - 1)
                else:
                    spans.append([a, a + n + LENGTH - 1])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            yield doc_id, len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [x for s in spans for x in s]

    joined = docs.join(_by_document(ranges), ["o", "t"], "left").select("doc_id", "z", "starts")
    return map_rows(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", wide: int = WIDE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (from, to, ...) of every document."""
    found = settle(anchors(docs, text, id_col))
    reps = found.where("k IS NOT NULL")
    texts = packed_texts(docs, text, id_col)
    parts = written(segment_bytes(texts, reps), "repeats-segments")
    many = parts.groupBy("k").count().where(F.col("count") > wide).select("k", F.lit(True).alias("_wide"))
    marked = lookup_join(parts, written(many, "repeats-wide-anchors"), ["k"], "left", spread=F.col("place"))
    columns = ("k", "o", "place", "n", "bytes")
    narrow = suffix_repeats(marked.where("_wide IS NULL").select(*columns), block)
    rest = refined_repeats(marked.where("_wide").select(*columns))
    repeats = written(found.where("k IS NULL").select("o", "place", "n").unionByName(narrow).unionByName(rest), "repeats-ranges")
    return removed(texts, repeats)
