"""Terms of whole texts as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .shingles import mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes of terms: ASCII letters and every byte of a character beyond ASCII; with or without digits.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[0x30:0x3A] = True
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Longer terms are hashed one by one.
LONG = 64


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z only) of a string column, eight zero bytes behind them, and the offset of each row and of
    the end.  Null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, dtype=np.int64)
    out = np.zeros(int(at[-1] - at[0]) + 8, dtype=np.uint8)
    if len(out) > 8:
        out[:-8] = _LOWER[np.frombuffer(data, dtype=np.uint8, count=len(out) - 8, offset=int(at[0]))]
    return out, at - at[0]


def find_terms(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of every maximal run of bytes of ``kind``; runs end with their row."""
    n = int(offsets[-1])
    inside = kind[data[:n]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < n]
    first[rows] = inside[rows]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, (np.flatnonzero(last) - starts + 1).astype(np.int64), (np.searchsorted(offsets, starts, side="right") - 1).astype(np.int32)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, the first byte lowest."""
    return np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: int = 0) -> np.ndarray:
    """Bytes ``at`` to ``at`` + 8 of terms as one number each, zero beyond the term.  No term holds a zero byte, so equal
    numbers are equal bytes."""
    left = np.clip(lengths - at, 0, 8)
    return _words(data)[np.where(left > 0, starts + at, 0)] & _KEEP[left]


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each term."""
    out = mix((packed(data, starts, lengths) + lengths.astype(np.uint64)) * _STEP)
    for at in range(8, LONG, 8):
        more = np.flatnonzero(lengths > at)
        if not len(more):
            return out
        out[more] = mix((out[more] + packed(data, starts[more], lengths[more], at)) * _STEP)
    for i in np.flatnonzero(lengths > LONG):
        term = data[starts[i] : starts[i] + lengths[i]].tobytes()
        out[i] = np.frombuffer(hashlib.blake2b(term, digest_size=8).digest(), dtype="<u8")[0]
    return out


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """Stable order by 16-bit digits, lowest first; a digit that never changes costs no pass."""
    order = None
    for digit in digits:
        if len(digit) and (digit != digit[0]).any():
            now = np.argsort(digit if order is None else digit[order], kind="stable")  # numpy sorts 16-bit numbers by radix
            order = now if order is None else order[now]
    return np.arange(len(digits[0])) if order is None else order


def digits_of(word: np.ndarray, n_bytes: int) -> list[np.ndarray]:
    return [(word >> np.uint64(8 * k)).astype(np.uint16) for k in range(0, n_bytes, 2)]


def gathered(batches: Iterator, limit: int) -> Iterator:
    """Arrow batches joined to tables of about ``limit`` bytes; a larger batch is a table of its own."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
