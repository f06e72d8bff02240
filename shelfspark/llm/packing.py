"""Packing documents along a space-filling curve.

Each document becomes token ids plus an end id, and a vector of hashed word counts, projected
to ``DIMS`` dimensions by fixed signs.  The place on a Hilbert curve through those dimensions is its
sort key.  Documents are range-sorted by it and laid end to end; every 1024 ids make a sequence, so
neighbours on the curve share sequences and only the very last one can be short.  That one is cut
into sequences whose lengths are powers of two, which need no padding either.

Tokens are made once and written; the sort moves only keys and lengths, and the ids move once more to
their places.  Partition totals (one number a partition) are the only thing the driver sees.

Null or empty text: only the end id.  Repeated rows are packed each by itself, side by side.
Ids that are null keep null.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, tokenizer_path, written

TOKENIZER = "byte_bpe_50k"
END_ID = 0
LENGTH = 1024
DIMS, BITS = 4, 10
#: Buckets of the hashed word counts.
FEATURES = 1024

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of whole texts by the public byte-level vocabulary.

    Its rank form gives the same ids as the tokenizer, several times faster.  Texts with special tokens, or with white
    space on whose class the two could disagree, go to the tokenizer.
    """

    ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]|<[|]")
    _made: dict[str | None, "Encoder"] = {}

    def __init__(self, folder: str | None = None):
        import base64
        import os

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(tokenizer_path(TOKENIZER + ".json", folder))
        with open(tokenizer_path(TOKENIZER + ".tiktoken", folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding(TOKENIZER, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def shared(cls, folder: str | None = None) -> "Encoder":
        if folder not in cls._made:
            cls._made[folder] = cls(folder)
        return cls._made[folder]

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 16-bit integers, without the end id."""
        if self.ODD.search(text):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
        return np.asarray(self.ranks.encode_ordinary(text), dtype="<u2").tobytes()


def _signs(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(FEATURES, DIMS))


def project(ids: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Cells of one document: its hashed 2-gram and 1-gram counts, unit length, projected and cut into 2^BITS cells."""
    if not len(ids):
        return np.zeros(DIMS, dtype=np.int64)
    x = ids.astype(np.uint64)
    hashed = np.concatenate([x * np.uint64(0x9E3779B97F4A7C15), (x[:-1] * np.uint64(65537) + x[1:]) * np.uint64(0xD1B54A32D192ED03)])
    counts = np.sqrt(np.bincount((hashed >> np.uint64(54)).astype(np.int64), minlength=FEATURES))
    dims = counts @ signs / np.sqrt((counts**2).sum())  # about normal with variance 1
    return np.clip((dims + 4.0) / 8.0 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> int:
    """Place of a cell on the Hilbert curve (Skilling's transform of the coordinates, then bits interleaved)."""
    x = [int(c) for c in cells]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                t = (x[0] ^ x[i]) & low
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    key = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v >> b) & 1
    return key


def tokenized(docs: DataFrame, text: str = "text", id_col: str = "doc_id", folder: str | None = None) -> DataFrame:
    """doc_id, curve key, number of ids (with the end id) and the ids of every document, written once."""
    end = np.asarray([END_ID], dtype="<u2").tobytes()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        encoder, signs = Encoder.shared(folder), _signs()
        for doc_id, words in rows:
            ids = encoder.ids(words or "")
            key = hilbert_key(project(np.frombuffer(ids, dtype="<u2"), signs))
            yield doc_id, key, len(ids) // 2 + 1, ids + end

    made = map_rows(docs.select(id_col, text), run, "doc_id long, key long, n long, ids binary", lambda r: 40 + len(r[3]))
    return written(made.select(F.monotonically_increasing_id().alias("row"), "*"), "packing-ids")


def places(made: DataFrame) -> DataFrame:
    """row and ``at``, the first place of every document on the line, and the length of the line."""
    order = ["key", "doc_id", "row"]
    ranged = made.select("row", "doc_id", "key", "n").repartitionByRange(*order).sortWithinPartitions(*order)

    def running(rows: Iterator[tuple]) -> Iterator[tuple]:
        before = 0
        for row, n, part in rows:
            yield row, n, part, before
            before += n

    line = written(map_rows(ranged.select("row", "n", F.spark_partition_id()), running,
                            "row long, n long, part int, before long"), "packing-line")
    totals = line.groupBy("part").agg(F.sum("n").alias("in_part"))  # one row a partition
    order_of = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("in_part").over(order_of), F.lit(0)).alias("base"))
    size = totals.agg(F.coalesce(F.sum("in_part"), F.lit(0)).alias("size"))
    return line.join(F.broadcast(bases), "part").crossJoin(F.broadcast(size)).select(
        "row", (F.col("before") + F.col("base")).alias("at"), "size")


def _bounds(place: int, size: int, length: int) -> tuple[int, int, int]:
    """Sequence that holds a place of the line: id, first place, end."""
    full = size // length
    if place < full * length:
        k = place // length
        return k, k * length, (k + 1) * length
    start, rest, k = full * length, size - full * length, full
    while True:  # the short end: powers of two, largest first
        step = 1 << (rest.bit_length() - 1)
        if place < start + step:
            return k, start, start + step
        start, rest, k = start + step, rest - step, k + 1


def pieces(made: DataFrame, at: DataFrame, length: int = LENGTH) -> DataFrame:
    """Cut every document at the borders of sequences: one row a piece."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, n, ids, place, size in rows:
            wide = np.frombuffer(ids, dtype="<u2").astype("<u4")
            done = 0
            while done < n:
                k, first, end = _bounds(place + done, size, length)
                step = min(n - done, end - place - done)
                yield doc_id, done, step, zlib.crc32(wide[done : done + step].tobytes()), n, k, place + done - first
                done += step

    joined = made.select("row", "doc_id", "n", "ids").join(at, "row")
    return map_rows(joined.select("doc_id", "n", "ids", "at", "size"), run, PIECE, lambda r: 64)


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """Pack all documents into sequences of ``length`` ids; one row a piece."""
    made = tokenized(docs, text, id_col, folder)
    return pieces(made, places(made), length)
