"""Vectorised text scans over the UTF-8 bytes of Arrow string columns (used inside tasks)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: space, and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Documents in a slice at most: a slice's row number fits the upper 12 bits of a 64-bit key.
SLICE_ROWS = 4096
#: Text in a slice, unless one document has more.
SLICE_BYTES = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Bytes whose words are hashed at a time: what is in use doesn't grow with the text.
_STEP = 1 << 18
#: Longer spans are hashed one by one.
_SHORT = 128
#: Which bits of eight bytes count when the first ``i`` bytes do.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def eights(raw: np.ndarray) -> np.ndarray:
    """For each place, the eight bytes from there on as one number (zeros stand behind the end)."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))


def lane(view: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first ``size`` bytes, eight at most, from each place of ``view``, as a number."""
    return view[at] & _KEEP[np.minimum(size, 8)]


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _cuts(column: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    lengths = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > max_bytes or i - start >= SLICE_ROWS):
            yield start, i - start
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths) - start


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``max_bytes`` of text and SLICE_ROWS rows; a longer text is a piece alone."""
    for start, n in _cuts(batch.column(column), max_bytes):
        yield batch.slice(start, n)


def pieces(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The same for one column."""
    for start, n in _cuts(column, max_bytes):
        yield column.slice(start, n)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def spans(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row)`` of the maximal runs of bytes not in ``breaks``; no run crosses a row."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~breaks[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal in every task; ``fold`` takes A-Z as a-z.

    ``start`` ascends. Spans of up to 128 bytes go eight bytes at a time through a
    bijection that mixes all bits, so that unlike bytes in one place never meet and in several only by
    chance; longer ones are hashed by BLAKE2.
    """
    out, size = np.zeros(len(start), np.uint64), end - start
    for i in np.flatnonzero(size > _SHORT).tolist():
        state = hashlib.blake2b(digest_size=8)
        for at in range(int(start[i]), int(end[i]), _STEP):
            part = raw[at : min(at + _STEP, int(end[i]))]
            state.update((_FOLD[part] if fold else np.ascontiguousarray(part)).data)
        out[i] = int.from_bytes(state.digest(), "little")
    short = np.flatnonzero(size <= _SHORT)
    steps = start[short] // _STEP
    edges = np.flatnonzero(np.diff(steps)) + 1
    for some in np.split(short, edges):
        if len(some):
            first = int(start[some[0]])
            part = raw[first : int(end[some].max())]
            out[some] = _short_hashes(_FOLD[part] if fold else part, start[some] - first, size[some])
    return out


def _short_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    view = eights(raw)
    out = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ lane(view, start, size))
    rows, done = np.flatnonzero(size > 8), 8
    while len(rows):
        out[rows] = mix64(out[rows] ^ lane(view, start[rows] + done, size[rows] - done))
        done += 8
        rows = rows[size[rows] > done]
    return out


def count_per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flagged bytes each row holds."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` rows begins in the sorted array ``rows``, and its end at last."""
    return np.searchsorted(rows, np.arange(n + 1))


def window_hashes(words: np.ndarray, rows: np.ndarray, n: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, first)``: a hash for each run of ``size`` words inside one row and its first word's place."""
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[: len(rows) - size + 1] == rows[size - 1 :])
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - size + 1 + k]
    return mix64(out[first]), first


def shingle_keys(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct keys ``row << 52 | hash``: the lower-cased word shingles of each row.

    A row with fewer than ``size`` words, but one at least, has its whole sequence as its one shingle.
    """
    n = len(offsets) - 1
    start, end, rows = spans(raw, offsets, SPACE)
    words = span_hashes(raw, start, end, fold=True)
    hashes, first = window_hashes(words, rows, n, size)
    keys = [(rows[first].astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12))]
    bounds = row_bounds(rows, n)
    lengths = np.diff(bounds)
    for row in np.flatnonzero((lengths > 0) & (lengths < size)):
        whole = np.uint64(lengths[row])
        for w in words[bounds[row] : bounds[row + 1]]:
            whole = np.uint64((int(whole) * 0x9FB21C651E98DF25 + int(w)) & 0xFFFFFFFFFFFFFFFF)
        keys.append((np.uint64(row) << np.uint64(52)) | (mix64(np.array([whole], np.uint64)) >> np.uint64(12)))
    return distinct(np.concatenate(keys))
